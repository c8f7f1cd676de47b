"""Groups of texts whose word shingles have a Jaccard similarity of 0.8 or more: SimHash links first, completed exactly by prefix filtering.

Prints of the five-word shingles are linked by the general pigeonhole search of ``simhash``; links that the shingles confirm make components. That alone can't give right results:
at a similarity of 0.8 two 64-bit prints differ in about 10 bits and often in more, which no pigeonhole search over 64 bits can cover, and short texts differ more. So what it leaves apart is searched by
prefix filtering, and only pairs of different components are compared there.

Two sets that share at least 0.8 of their union share one of the first n - ceil(0.8 n) + 1 shingles of each, whatever the order of
shingles is, so long as it is one for all. The order puts shingles of crowded ranges of hashes last; the ranges are of fixed number and counted over all texts.
Only sets that share such a shingle are compared, on all their shingles.

Sketches of parities bound from below in how many shingles two sets differ. They travel with the shared shingles, so a pair that cannot be similar is given up where it is found, before any set is moved; the others are compared on all shingles.

A shared shingle also bounds what two sets can share by what follows it in either order, since the first shared one must satisfy that too; so a set with many rare shingles of its own is compared with few others.

Groups of near copies make some shingles hot. Members of a hot shingle are first compared with the one of them that has the fewest rarer shingles, and joined into components;
then only pairs of different components are left, and those within a hot shingle's largest component are never formed.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bloom, by_bytes, materialize, may_hold, send, small_batches
from .components import components
from .simhash import majority, near_edges

#: Words of a shingle.
WORDS = 5
_SALTS = 16
#: Longs of a sketch that travels with shingles, and of one that is compared before whole sets are.
_LONGS, _WIDE = 4, 64
#: Ranges of hashes that are counted: 2 to this power.
_RANGE_BITS = 20


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct XXH64 of the shingles; fewer words than that are one shingle, no words none."""
    from xxhash import xxh64_intdigest

    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    own = map(b" ".join, zip(*(w[k:] for k in range(words)))) if len(w) > words else iter((b" ".join(w),))  # noqa: B905
    return np.unique(np.fromiter(map(xxh64_intdigest, own, repeat(42)), np.uint64))


def _key(own: np.ndarray) -> int:
    from xxhash import xxh3_64_intdigest

    return int(np.uint64(xxh3_64_intdigest(own.tobytes())).astype(np.int64))


def range_counts(texts: DataFrame, bits: int = _RANGE_BITS) -> np.ndarray:
    """[r]: how often a shingle of range r of hashes (their first ``bits`` bits) occurs in all ``texts`` (text), once a text that holds it."""
    width = min(1 << bits, 4096)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.int64)
        for batch in by_bytes(batches, 0):
            own = np.concatenate([shingles(t.as_py() or "") for t in batch.column(0)])
            at, n = np.unique(_range(own, bits), return_counts=True)
            counts[at] += n
        if counts.any():
            part = counts.reshape(-1, width)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(part))), pa.array([x.tobytes() for x in part], pa.binary())], names=["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(raw.as_buffer(), np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["part", "counts"])

    out = np.zeros((1 << bits) // width * width, np.int64).reshape(-1, width)
    with small_batches(texts.sparkSession):
        sums = texts.select("text").mapInArrow(count, "part long, counts binary").repartition("part").mapInArrow(add, "part long, counts binary").collect()
    for k, raw in sums:
        out[k] = np.frombuffer(raw, np.int64)
    return out.ravel()


def _range(own: np.ndarray, bits: int) -> np.ndarray:
    return (own >> np.uint64(64 - bits)).astype(np.int64)


def prefix(own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles one of which any set at 0.8 or more has among its own: those of the rarest ranges."""
    n = len(own)
    return own[np.lexsort((own, counts[_range(own, len(counts).bit_length() - 1)]))][: n - -(-4 * n // 5) + 1] if n else own


def sketch(own: np.ndarray, longs: int = _LONGS) -> np.ndarray:
    """Parities of the numbers of shingles in 64 * ``longs`` ranges of hashes: two sketches differ in no more bits than their sets differ in shingles."""
    parts = np.bincount((own >> np.uint64(64 - (64 * longs - 1).bit_length())).astype(np.int64), minlength=64 * longs)
    return np.packbits((parts & 1).astype(np.uint8)).view(np.int64)


def _salt(c: str) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(_SALTS))


def _beside(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """u, v, a, b: ``pairs`` with what ``of`` (key, x) holds of either. A leader is in very many pairs, so both sides are dealt by the other's hash too."""
    salted = pairs.select("u", "v", _salt("v").alias("su"), _salt("u").alias("sv"))
    left = salted.select("u", "su").distinct().join(of, F.col("u") == F.col("key")).select(F.col("u").alias("u1"), F.col("su").alias("s1"), F.col("x").alias("a"))
    right = salted.select("v", "sv").distinct().join(of, F.col("v") == F.col("key")).select(F.col("v").alias("v1"), F.col("sv").alias("s2"), F.col("x").alias("b"))
    return salted.join(left, (F.col("u") == F.col("u1")) & (F.col("su") == F.col("s1"))).join(right, (F.col("v") == F.col("v1")) & (F.col("sv") == F.col("s2"))).select("u", "v", "a", "b")


def _made(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, make: Callable[[np.ndarray], np.ndarray], name: str) -> DataFrame:
    """key, x: what ``make`` gives for the set of every key in ``pairs``. Texts aren't moved: they are read where they lie, and a filter of bounded size tells which are wanted."""
    needed = pairs.select(F.col("u").alias("k")).union(pairs.select("v")).distinct()
    sent = send(texts.sparkSession, bloom(materialize(nodes.join(needed, F.col("key") == F.col("k"), "left_semi").select("h"), "wanted")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = pickle.loads(sent.value), set()

        def wanted() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = np.flatnonzero(may_hold(words, batch.column(0).to_numpy(zero_copy_only=False)))
                new = [k for k, h in zip(at.tolist(), batch.column(0).take(pa.array(at)).to_pylist(), strict=True) if not (h in seen or seen.add(h))]
                yield batch.take(pa.array(new, pa.int64()))

        for batch in by_bytes(wanted(), 1):
            own = [shingles(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array([_key(s) for s in own], pa.int64()), pa.array([make(s) for s in own], pa.list_(pa.int64()))], names=["key", "x"])

    found = texts.select(F.xxhash64("text").alias("h"), "text").mapInArrow(run, "key long, x array<long>")
    with small_batches(texts.sparkSession):
        return materialize(found.dropDuplicates(["key"]), name)


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """u, v: the pairs of keys that reach the similarity on all shingles. Wide sketches are compared first, whole sets only of pairs that they leave."""
    pairs = materialize(pairs.distinct(), "pairs")
    wide = _made(pairs, nodes, texts, lambda own: np.append(sketch(own, _WIDE), len(own)), "wide")
    bits = F.aggregate(F.zip_with(F.slice("a", 1, _WIDE), F.slice("b", 1, _WIDE), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    likely = materialize(_beside(pairs, wide).filter(9 * bits <= F.col("a")[_WIDE] + F.col("b")[_WIDE]).select("u", "v"), "likely")
    both = _beside(likely, _made(likely, nodes, texts, lambda own: own.view(np.int64), "sets"))
    return materialize(both.filter(9 * F.size(F.array_intersect("a", "b")) >= 4 * (F.size("a") + F.size("b"))).select("u", "v"), "similar")


def print_pairs(nodes: DataFrame, distance: int = 2, bucket: int = 64) -> DataFrame:
    """u, v: keys of ``nodes`` (key, print) with equal prints or prints at most ``distance`` bits apart, each print standing for its least key."""
    first = materialize(nodes.groupBy("print").agg(F.min("key").alias("rep")), "reps")
    links = near_edges(first.select(F.col("print").alias("fp")), distance, bucket)
    a, b = (first.select(F.col("print").alias(p), F.col("rep").alias(r)) for p, r in (("pa", "ra"), ("pb", "rb")))
    apart = links.join(a, F.col("u") == F.col("pa")).join(b, F.col("v") == F.col("pb")).select(F.greatest("ra", "rb").alias("u"), F.least("ra", "rb").alias("v"))
    return apart.union(nodes.join(a, F.col("print") == F.col("pa")).filter("key <> ra").select(F.col("key").alias("u"), F.col("ra").alias("v")))


def similar_edges(nodes: DataFrame, texts: DataFrame, bucket: int = 64) -> DataFrame:
    """u, v: links among keys of ``nodes`` (key, n, h, print, sketch, prefix) that join all at 0.8 or more into the right components."""
    # two sets at 0.8 share 4/9 of their sizes' sum; no more than what follows the first shared shingle in either order (positions i and i2) can be shared
    fits = (4 * (F.col("n") + F.col("n2")) <= 9 * F.least(F.col("n") - F.col("i"), F.col("n2") - F.col("i2"))) & (5 * F.col("n") >= 4 * F.col("n2")) & (5 * F.col("n2") >= 4 * F.col("n"))
    # and they differ in at most a ninth of it
    differ = reduce(lambda a, b: a + b, (F.bit_count(F.col("sketch")[k].bitwiseXOR(F.col("sketch2")[k])) for k in range(_LONGS)))
    fits = fits & (9 * differ <= F.col("n") + F.col("n2"))
    ordered = lambda a, b: [F.greatest(a, b).alias("u"), F.least(a, b).alias("v")]
    salts = F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt")
    each = nodes.select("key", F.posexplode("prefix").alias("i", "sh"))
    shared = materialize(each.groupBy("sh").agg(F.count("*").alias("c")).filter("c > 1").select(F.col("sh").alias("s"), (F.col("c") > bucket).alias("hot")), "shared")
    # most shingles are in one set alone, so a post gets its set's size and sketch only once it is known to be shared
    marks = nodes.select(F.col("key").alias("k"), "n", "sketch")
    posts = materialize(each.join(shared, F.col("sh") == F.col("s")).drop("s").join(marks, F.col("key") == F.col("k")).drop("k"), "posts")
    # first links: those of the prints, and of each hot shingle's members to one of them
    leaders = posts.filter("hot").groupBy("sh").agg(F.min(F.struct("i", F.xxhash64("key").alias("x"), "key", "n", "sketch")).alias("m")).select(F.col("sh").alias("s"), F.col("m.key").alias("k2"), F.col("m.n").alias("n2"), F.col("m.i").alias("i2"), F.col("m.sketch").alias("sketch2"), salts)
    stars = posts.filter("hot").join(leaders, (F.col("sh") == F.col("s")) & (_salt("key") == F.col("salt"))).filter((F.col("key") != F.col("k2")) & fits)
    edges = _verified(print_pairs(nodes, bucket=bucket).union(stars.select(*ordered("key", "k2"))), nodes, texts)
    roots = materialize(components(edges), "roots")
    labelled = materialize(posts.join(roots, F.col("key") == F.col("node"), "left").withColumn("label", F.coalesce("root", "key")).drop("node", "root"), "labelled")
    # then all pairs of different components; of a hot shingle's pairs every one has a member outside its largest component
    major = labelled.filter("hot").groupBy("sh", "label").agg(F.count("*").alias("c")).groupBy("sh").agg(F.max_by("label", F.struct("c", "label")).alias("most"), F.count("*").alias("labels"))
    major = materialize(major.filter("labels > 1").select(F.col("sh").alias("s"), "most"), "major")
    outside = labelled.filter("hot").join(major, F.col("sh") == F.col("s")).filter(F.col("label") != F.col("most"))
    outside = outside.select(F.col("sh").alias("s"), F.col("key").alias("k2"), F.col("n").alias("n2"), F.col("i").alias("i2"), F.col("sketch").alias("sketch2"), F.col("label").alias("l2"), salts)
    apart = (F.col("label") != F.col("l2")) & fits
    crossed = labelled.filter("hot").join(outside, (F.col("sh") == F.col("s")) & (_salt("key") == F.col("salt"))).filter(apart).select(*ordered("key", "k2"))
    light = labelled.filter("NOT hot")
    other = light.select(F.col("sh").alias("s"), F.col("key").alias("k2"), F.col("n").alias("n2"), F.col("i").alias("i2"), F.col("sketch").alias("sketch2"), F.col("label").alias("l2"))
    pairs = light.join(other, (F.col("sh") == F.col("s")) & (F.col("key") > F.col("k2")) & apart).select(*ordered("key", "k2"))
    return edges.union(_verified(crossed.union(pairs), nodes, texts))


def similar_components(docs: DataFrame, bucket: int = 64) -> DataFrame:
    """doc_id, h (hash of the text), fp (the hash of the row's set of shingles), root, component_id of every row of ``docs`` (doc_id, text; other columns are ignored).

    root: a number of the component; component_id: the smallest doc_id reachable over links at 0.8 or more (null if none has one). Texts without words are one group.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sent = send(docs.sparkSession, range_counts(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = pickle.loads(sent.value)
        for batch in by_bytes(batches, 2):
            own = [shingles(t.as_py() or "") for t in batch.column(2)]
            prints = np.array([majority(s) for s in own], np.uint64).view(np.int64)
            first = [prefix(s, counts).view(np.int64) for s in own]
            marks = pa.array([sketch(s) for s in own], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([_key(s) for s in own], pa.int64()), pa.array([len(s) for s in own], pa.int64()), pa.array(prints), marks, pa.array(first, pa.list_(pa.int64()))],
                names=["doc_id", "h", "fp", "n", "print", "sketch", "prefix"],
            )

    with small_batches(docs.sparkSession):
        scanned = materialize(rows.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(run, "doc_id long, h long, fp long, n long, print long, sketch array<long>, prefix array<long>"), "shingled")
    # equal sets have equal prefixes
    nodes = materialize(scanned.groupBy(F.col("fp").alias("key")).agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.min("h").alias("h"), F.first("print").alias("print"), F.first("sketch").alias("sketch"), F.first("prefix").alias("prefix")), "nodes")
    roots = components(similar_edges(nodes.select("key", "n", "h", "print", "sketch", "prefix"), rows, bucket))
    named = materialize(nodes.join(roots, F.col("key") == F.col("node"), "left").select("key", "first", F.coalesce("root", "key").alias("root")), "named")
    ids = named.groupBy("root").agg(F.min("first").alias("component_id")).select(F.col("root").alias("r"), "component_id")
    labels = materialize(named.join(ids, F.col("root") == F.col("r")).select("key", "root", "component_id"), "labels")
    return scanned.select("doc_id", "h", "fp").join(labels, F.col("fp") == F.col("key")).select("doc_id", "h", "fp", "root", "component_id")
