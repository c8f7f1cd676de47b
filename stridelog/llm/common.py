"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """Folder for intermediate tables that driver and executors share.

    It is the one named in ``spark.checkpoint.dir``. Only where that is unset and the master is local (tests,
    a laptop) is a temporary folder made, recorded in the session and removed when the driver ends; a cluster without the setting raises.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="stridelog-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/stridelog-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts the lineage, and
    what is nondeterministic (partition ids, generated ids) keeps its value from then on."""
    spark, schema = df.sparkSession, df.schema
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have, whatever its columns are called (case doesn't tell names apart)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def text_or_empty(column: str):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """For what runs inside, Arrow batches of at most ``rows`` rows: texts are long, and ten thousand of them are more than a worker needs at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def give_back() -> None:
    """Returns memory that this process holds without use: workers outlive their tasks, and what they keep is missed by the next stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # only glibc has it
        pass


def by_bytes(batches: Iterator[pa.RecordBatch], column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts in ``column`` have at most ``most`` bytes; a longer text is a batch of its own. Memory kept from earlier tasks is given back before, that of the texts after."""
    give_back()
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(at, stop - at)
            at = stop
    batch = None
    give_back()


def bloom(keys: DataFrame, most: int = 1 << 26) -> np.ndarray:
    """Words of a Bloom filter of the longs in column h: 16 bits or more for each, up to ``most`` in all, so what it lets through besides grows only beyond four million keys."""
    size = min(most, 1 << max(10, (16 * keys.count()).bit_length()))
    at = keys.select(F.explode(F.array(F.col("h"), F.shiftrightunsigned("h", 32))).alias("x")).select(F.col("x").bitwiseAND(size - 1).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, int(at & 63)))").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint64)


def may_hold(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the longs ``h`` the filter lets through: all of its keys and few others."""
    out = np.ones(len(h), bool)
    for x in (h.view(np.uint64), h.view(np.uint64) >> np.uint64(32)):
        at = x & np.uint64(64 * len(words) - 1)
        out &= (words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return out


def may_hold_native(words: Column, h: Column, size: int) -> Column:
    """The same for a column ``h`` of longs and the filter's ``size`` words as a column of arrays, without Python."""
    tests = []
    for x in (h, F.shiftrightunsigned(h, 32)):
        at = x.bitwiseAND(64 * size - 1)
        tests.append(F.getbit(F.get(words, F.shiftright(at, 6).cast("int")), at.bitwiseAND(63).cast("int")) == 1)
    return tests[0] & tests[1]


def send(spark: SparkSession, value) -> Broadcast:
    """Broadcast of ``value``, pickled with its classes' code, for ``pickle.loads`` on an executor that lacks this package."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))
