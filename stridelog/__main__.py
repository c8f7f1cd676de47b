import sys

from stridelog.report import main

sys.exit(main())
