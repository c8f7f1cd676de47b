"""Secret scanning with a random forest that removes false positives (native).

Candidates are runs of 16 or more key characters with a digit among them, and, where the context points to a secret (an assignment,
quotes, a secret word, a known prefix), also runs of letters only, shorter values and values with other marks. Each gets features of its own (length, shares
and transitions of character classes, dictionary coverage), of its path and of the words beside it; a forest trained on labelled
findings gives the chance that it is a secret. Everything is DataFrame and ML-pipeline expressions in the JVM.

Texts aren't shuffled: they are cut at the candidates where they are read, and only each candidate with at most
256 characters before and 64 after it moves on.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_KEY = "A-Za-z0-9+/=_\\-"
_WORD = "(?i:token|secret|passw|passphrase|passcode|pwd|auth|bearer|credential|private|key)"
_PREFIX = "A[KS]IA|gh[opsur]_|github_pat_|glpat-|[spr]k_(?:live|test)_|xox[abeoprs]-|AIza|sk-"
_QUOTE = "\"'`"
_NAMED = f"{_WORD}[\\w-]{{0,16}}[{_QUOTE}\\]]{{0,2}}\\s{{0,2}}"
_VALUE = f"[^\\s{_QUOTE}()<>]"
#: A run that itself holds name=value with a secret word leaves the value to the patterns for those.
_RUN = f"(?<![{_KEY}])(?!\\w{{0,24}}{_WORD}[\\w-]{{0,16}}={_VALUE}{{4}})(?=[A-Za-z+/=_\\-]*+[0-9])[{_KEY}]{{16,}}+"
#: No part backtracks over more than a bounded stretch, so it is linear in any text.
CANDIDATE = "|".join([
    *(f"(?<={q})(?<={_NAMED}(?:=>|[=:]{{1,2}}|[\\s(])\\s{{0,2}}{q})[^{q}\\r\\n]{{4,}}+(?={q})" for q in _QUOTE),
    f"(?<=[=:>]\\s{{0,2}})(?<={_NAMED}(?:=>|[=:]{{1,2}})\\s{{0,2}}){_VALUE}{{4,}}(?<![.,;])",
    f"(?<=\\s)(?=[A-Za-z.,-]{{0,64}}+[^\\sA-Za-z.,{_QUOTE}()<>-])(?<={_WORD}\\w{{0,8}}\\s{{1,2}}(?:is\\s{{1,2}})?){_VALUE}{{6,}}(?<![.,;:])",
    f"(?<![{_KEY}])(?:{_PREFIX})[{_KEY}]{{8,}}+",
    _RUN,
    f"(?<=[{_QUOTE}]|[=:]\\s{{0,2}})(?<![{_KEY}&&[^=]])[{_KEY}&&[^=]]{{16,}}+",
    f"(?<=[{_QUOTE}])(?![a-z+]{{2,8}}://)(?=[^\\s{_QUOTE}]*?[0-9@!$%^&*#])(?=[^\\s{_QUOTE}]*?[A-Za-z])[^\\s{_QUOTE}]{{8,}}+(?=[{_QUOTE}])",
])

DICTIONARY = (
    "about access account action address admin after again agent alert align alpha array asset async audit author auto back backup badge base batch beta binary block body bool boot border bottom "
    "branch bridge browser bucket buffer build bundle button byte cache call cancel case cert change channel char chart check child class clean clear click client clone close cloud code color column command "
    "comment commit common config connect const content context control copy core count create cross current custom daily data date debug deep default define delete demo deploy design detail device dialog "
    "direct disk display document domain down download driver dump dynamic echo edit element email empty enable encode end engine entry enum error event example exec export extend external factory fail false fast "
    "feature fetch field file filter final find first fixture flag float flow focus folder font footer force form format frame from front function gate general get global graph green grid group guard guide hand "
    "handle hash head header health hello help hidden high home hook host hour html http icon image import index info init inner input insert install instance int internal invalid item java join json jump kernel "
    "label lambda last layer layout left level library light limit line link linux list load local location lock log login long loop main make manager map mark master match max media member memory menu merge "
    "message meta method min mobile mock mode model module monitor month mouse move multi name native nav net network new next node none note null number object offset old open option order origin other out output "
    "owner package page panel param parent part patch path pattern pause pipe place plan platform play plugin point policy pool port post prefix press print private process product profile project prompt proxy public "
    "pull push query queue quick random range rate read ready record red ref region release remote remove render replace report request reset resource response rest result return right role root route row rule run "
    "sample save scale schema scope screen script scroll search second section select send server service session set setup shadow shape share shell show side sign simple single size sleep slice small socket sort "
    "source space spec split stack stage standard start state static status step stop storage store stream string style submit sub success suffix sum super support switch sync system table tag target task temp template "
    "test text theme thread time timeout title toggle tool top total trace track transform tree trigger true type under unit unknown update upgrade upload upper user util valid value variable vector version video view "
    "visible wait walk warn watch web week weight when wide widget width window with word work worker world wrap write year zone your changeme"
)

FEATURES = ("length", "digits", "upper", "lower", "symbols", "switches", "vowel_turns", "distinct", "hex", "uuid", "coverage", "placeholder", "path_test", "path_config", "secret_word", "hash_word", "assigned", "quoted", "in_url", "prefix")


def _share(c: Column, keep: str) -> Column:
    return F.length(F.regexp_replace(c, f"[^{keep}]", "")) / F.length(c)


def with_features(found: DataFrame) -> DataFrame:
    """Adds FEATURES as doubles to rows of candidate, left, right, path; nulls count as empty."""
    c, path = F.coalesce("candidate", F.lit("")), F.lower(F.coalesce("path", F.lit("")))
    left, right = F.lower(F.coalesce("left", F.lit(""))), F.coalesce("right", F.lit(""))
    low, n = F.lower(c), F.greatest(F.length(c), F.lit(1))
    words = "|".join(sorted(DICTIONARY.split(), key=lambda w: (-len(w), w)))
    near = F.regexp_extract(left, r"(\S*\s*\S*\s*\S*)$", 1)  # the last three words before it
    values = {
        "length": n,
        "digits": _share(c, "0-9"), "upper": _share(c, "A-Z"), "lower": _share(c, "a-z"), "symbols": 1 - _share(c, "A-Za-z0-9"),
        "switches": F.regexp_count(c, F.lit("(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])")) / n,
        "vowel_turns": F.regexp_count(low, F.lit("(?<=[aeiou])(?=[b-df-hj-np-tv-z])|(?<=[b-df-hj-np-tv-z])(?=[aeiou])")) / n,
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / F.least(n, F.lit(64)),
        "hex": low.rlike("^[0-9a-f]+$").cast("int"),
        "uuid": low.rlike("^[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}$").cast("int"),
        "coverage": 1 - F.length(F.regexp_replace(low, words, "")) / n,
        "placeholder": low.rlike(r"example|your|changeme|placeholder|dummy|sample|fake|(.)\1{4}|1234567|abcdef").cast("int"),
        "path_test": path.rlike("test|example|sample|mock|fixture|docs?/|readme").cast("int"),
        "path_config": path.rlike(r"\.env|config|\.ya?ml|\.ini|\.properties|credential|secret").cast("int"),
        "secret_word": near.rlike(r"token|secret|passw|pwd|api.?key|access.?key|auth|bearer|credential|private|\bkey\b").cast("int"),
        "hash_word": near.rlike(r"sha\d*|md5|commit|digest|checksum|uuid|guid|etag|revision|\brev\b|\bid\b|integrity").cast("int"),
        "assigned": left.rlike(r"""[=:]\s*["'`]?\s*$""").cast("int"),
        "quoted": (left.rlike("""["'`]$""") & right.rlike("""^["'`]""")).cast("int"),
        "prefix": c.rlike(f"^(?:{_PREFIX})").cast("int"),
        "in_url": left.rlike(r"(https?://|www\.)\S*$").cast("int"),
    }
    return found.withColumns({f"f_{k}": F.coalesce(values[k].cast("double"), F.lit(0.0)) for k in FEATURES})


def candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """doc_id, path, start, end (code points, end exclusive), candidate, left, right of every candidate in the whole texts of ``docs``."""
    d = docs.select(
        F.monotonically_increasing_id().alias("_uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col(path).cast("string").alias("path") if path in docs.columns else F.lit(None).cast("string").alias("path"),
        F.col("text").cast("string").alias("text"),
    ).filter(F.col("text").rlike(CANDIDATE))
    cut = d.select("_uid", "doc_id", "path", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("own"), F.split("text", CANDIDATE).alias("gaps"))
    pieces = cut.select(
        "_uid", "doc_id", "path",
        F.explode(F.expr("transform(sequence(0, size(own) - 1), i -> struct(i as i, own[i] as candidate, length(gaps[i]) as gap, right(gaps[i], 256) as left, left(gaps[i + 1], 64) as right))")).alias("p"),
    ).select("_uid", "doc_id", "path", "p.*")
    before = Window.partitionBy("_uid").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = pieces.withColumn("end", F.sum(F.col("gap") + F.length("candidate")).over(before))
    return placed.select("doc_id", "path", (F.col("end") - F.length("candidate")).alias("start"), "end", "candidate", "left", "right")


#: Kinds of values, as SQL over ``id``, ``h`` (64 hex digits), ``b`` (43 of base 64, letters and digits) ``w0`` to ``w3`` (words of the dictionary), ``v0`` and ``v1`` (made-up words), ``m`` (a mark). The first six are secrets.
KINDS = {
    "hex": "left(h, element_at(array(32, 40, 48, 64), 1 + pmod(id, 4)))",
    "base64": "left(b, 20 + pmod(id, 24))",
    "prefixed": "element_at(array(concat('AKIA', upper(left(b, 16))), concat('ghp_', left(b, 36)), concat('sk_live_', left(b, 24)), concat('xoxb-', pmod(id * 7919, 899999) + 100000, '-', left(b, 24)), concat('AIza', left(b, 35))), 1 + pmod(id, 5))",
    "letters": "translate(left(b, 18 + pmod(id, 14)), '0123456789', 'qRsTuVwXyZ')",
    "password": "element_at(array(concat(w0, m, pmod(id * 31, 9000), left(b, pmod(id, 4))), concat(lower(v0), pmod(id * 31, 100), m), concat(translate(w1, 'aeos', '@30$'), m, v0), concat(left(b, 4), m, left(h, 4), m), concat(v0, m, pmod(id * 31, 1000), w2), concat(translate(v0, 'aeos', '430$'), m, left(b, 2)), concat(w1, v1, pmod(id, 1000), m)), 1 + cast(pmod(xxhash64(id, 20), 7) as int))",
    "phrase": "concat(concat_ws(element_at(array(' ', ', ', '-', ' '), 1 + cast(pmod(xxhash64(id, 21), 4) as int)), w0, v0, w2, v1), element_at(array('!', '?', '.', '', m), 1 + cast(pmod(xxhash64(id, 22), 5) as int)))",
    "uuid": "regexp_replace(left(h, 32), '(.{8})(.{4})(.{4})(.{4})(.{12})', '$1-$2-$3-$4-$5')",
    "digits": "concat(pmod(id * 104729, 899999) + 100000, pmod(id * 7919, 899999) + 100000, pmod(id * 31, 89999) + 10000)",
    "stamp": "concat('2024', lpad(pmod(id, 12) + 1, 2, '0'), lpad(pmod(id, 28) + 1, 2, '0'), '-', pmod(id * 7919, 899999) + 100000, '-', pmod(id, 97))",
    "name": "concat(w0, '_', v0, '_', w2, '_', w3, pmod(id, 90))",
    "camel": "concat(w0, w1, v0, w3)",
    "call": "concat(w0, '.', w1, element_at(array('', '()', '_id'), 1 + pmod(id, 3)))",
    "word": "if(pmod(id, 2) = 0, lower(concat(w0, left(w1, pmod(id, 6)))), concat(v0, v1))",
    "placeholder": "element_at(array(concat('your-api-key-example-', pmod(id, 1000)), concat('your_', lower(w0)), concat('changeme', pmod(id, 100)), concat('0000000000', repeat(cast(pmod(id, 10) as string), 10 + pmod(id, 9))), concat('<insert-', lower(w1), '-here>')), 1 + pmod(id, 5))",
    "file": "concat(w0, '-', pmod(id, 100), '.', pmod(id, 7), element_at(array('.js', '.tar.gz', '.png'), 1 + pmod(id, 3)))",
    "path": "concat(lower(w0), '/', lower(w1), '-', pmod(id, 1000), '/', left(h, 12))",
}
#: Where a value stands: (SQL of what is before it, what is after it), over ``say`` (common words), ``cue`` (a secret's name), ``noun`` and ``mark`` (a digest's name).
PLACES = {
    "quoted": ("concat(say, ' ', cue, ' = \"')", "'\" and'"), "bare": ("concat(say, ' ', cue, ': ')", "concat(' ', say)"), "joined": ("concat('export ', upper(cue), '=')", "' '"), "json": ("concat('{\"', cue, '\": \"')", "'\",'"), "told": ("concat(say, ' ', cue, ' is ')", "', '"),
    "plain": ("concat(say, ' ')", "concat(' ', say)"), "named": ("concat(say, ' ', noun, ' = \"')", "'\"'"), "digest": ("concat(say, ' ', mark, ' ')", "' by'"), "digest_of": ("concat(cue, ' ', mark, ': ')", "' '"), "url": ("concat('https://', lower(noun), '.site/')", "concat('?', say)"),
}
_CUED, _SECRETS = ("quoted", "bare", "joined", "json", "told"), ("hex", "base64", "prefixed", "letters", "password", "phrase")


def label_of(kind: str, place: str) -> int | None:
    """What a reviewer says of a value of that kind in that place; None where it can't be told."""
    if (kind == "phrase" and place in ("bare", "joined", "told")) or (kind == "letters" and place == "told"):
        return None  # nothing shows where it ends, or that it is no word
    if place in _CUED:
        return 1 if kind in _SECRETS else None if kind in ("uuid", "digits") else 0
    if kind == "prefixed":
        return 1 if place in ("plain", "named") else None
    if kind == "base64":
        return 1 if place == "named" else None
    return None if kind in ("password", "phrase", "letters") else 0


def example_findings(spark: SparkSession, each: int = 40) -> DataFrame:
    """Labelled findings: candidate, left, right, path, label, kind, place; ``each`` rows of every pair of kind and place that has a label.

    Secrets named as such below a path of tests or examples are labelled 0: what stands there is made up. Values are drawn from hashes of row numbers.
    """
    cells = [(k, c, label) for k in KINDS for c in PLACES if (label := label_of(k, c)) is not None]
    pick = lambda values, at: "element_at(array(" + ", ".join("'" + v + "'" for v in values) + f"), 1 + cast(pmod({at}, {len(values)}) as int))"
    words = DICTIONARY.split()[::7]
    d = spark.range(0, each * len(cells), 1, 2).select(F.col("id").cast("int").alias("id"))
    for name, sql in {
        "cell": f"cast(pmod(id, {len(cells)}) as int)", "h": "sha2(concat('s', id), 256)", "b": "translate(base64(unhex(sha2(concat('b', id), 256))), '/+=', 'xYz')",
        **{f"w{k}": pick([w.title() if k % 2 else w for w in words], f"xxhash64(id, {k})") for k in range(4)},
        "v0": "translate(substring(h, 9, 4 + pmod(id, 4)), '0123456789abcdef', 'etaoinshrdlumcfb')", "v1": "translate(substring(h, 30, 3 + pmod(id, 5)), '0123456789abcdef', 'etaoinshrdlumcfb')", "m": pick(["@", "!", "$", "#", "%", "*", "^", "&"], "xxhash64(id, 8)"),
        "say": pick(["the value is", "and then", "we see that", "of this", "in some", "it was", "please note"], "xxhash64(id, 9)"), "cue": pick(["token", "api_key", "password", "secret", "client_secret", "access_key", "auth_token", "private_key", "passwd", "bearer"], "xxhash64(id, 10)"),
        "noun": pick(["name", "title", "value", "item", "theme", "region", "label", "view"], "xxhash64(id, 11)"), "mark": pick(["commit", "md5 checksum", "sha256 digest", "etag", "revision", "integrity", "uuid"], "xxhash64(id, 12)"),
        "path": pick(["src/app.py", "config/settings.yml", "deploy/prod.env", "notes/a.txt", "ci/run.sh", "web", "source", "tests/fixture/sample.py", "docs/readme.md"], "xxhash64(id, 13)"),
    }.items():
        d = d.withColumn(name, F.expr(sql))
    chosen = lambda values, by: F.expr("CASE " + by + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END")
    at = lambda k: F.get(F.array(*(F.lit(c[k]) for c in cells)), F.col("cell"))
    d = d.withColumns({"kind": at(0), "place": at(1), "label": at(2)})
    label = F.when(F.col("place").isin(*_CUED) & (F.col("kind") != "prefixed") & F.col("path").rlike("^(tests|docs)/"), 0).otherwise(F.col("label"))
    return d.select(chosen(KINDS, "kind").alias("candidate"), chosen({k: v[0] for k, v in PLACES.items()}, "place").alias("left"), chosen({k: v[1] for k, v in PLACES.items()}, "place").alias("right"), "path", label.cast("double").alias("label"), "kind", "place")


def train(labelled: DataFrame, trees: int = 24, depth: int = 7, seed: int = 17) -> RandomForestClassificationModel:
    """A forest from findings with a ``label`` of 1 (secret) or 0. Rows without a label are left out; both labels are needed."""
    rows = VectorAssembler(inputCols=[f"f_{k}" for k in FEATURES], outputCol="features").transform(with_features(labelled.filter("label IS NOT NULL").coalesce(2)))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt", subsamplingRate=0.8).fit(rows.select("features", "label"))


def classify(found: DataFrame, model: RandomForestClassificationModel) -> DataFrame:
    """``found`` with ``probability`` of being a secret; the features are dropped."""
    rows = VectorAssembler(inputCols=[f"f_{k}" for k in FEATURES], outputCol="_features").transform(with_features(found))
    model = model.copy().setFeaturesCol("_features").setPredictionCol("").setRawPredictionCol("").setProbabilityCol("_probability")
    return model.transform(rows).withColumn("probability", vector_to_array("_probability")[1]).drop("_features", "_probability", *(f"f_{k}" for k in FEATURES))


def scan_secrets(docs: DataFrame, labelled: DataFrame | None = None, least: float = 0.5) -> DataFrame:
    """doc_id, start, end, candidate_sha256, probability, is_secret of every candidate in ``docs`` (doc_id, text, source as the path; others are ignored).

    The candidates themselves aren't returned. Null or empty texts have none, an empty table gives no rows, repeated rows give theirs each.
    """
    model = train(example_findings(docs.sparkSession) if labelled is None else labelled)
    return classify(candidates(docs), model).select(
        "doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.sha2(F.col("candidate").cast("binary"), 256).alias("candidate_sha256"), "probability", (F.col("probability") >= least).alias("is_secret")
    )
