"""SimHash near-duplicates by the general pigeonhole principle.

The 64 bits are dealt into groups so that correlated bits come together. For a distance of at most
``distance``, any thresholds t_i >= -1 of the groups with sum(t_i + 1) = distance + 1 lose no pair: two prints that near
agree within t_i bits in some group i (-1: the group isn't probed). Each print gets its own thresholds by dynamic
programming over the estimated candidates of each group and threshold, counted over all prints. It then
probes every value within t_i bits of its own in group i, and candidates are verified on all 64 bits.

Groups of near copies make some values hot. Values that more than ``bucket`` prints share are not paired: every
print that holds or probes one is posted under itself and its 64 one-bit neighbours, and prints posted together are
linked in a star. Two prints at most 2 bits apart always share such a post, and a post never
holds more than 65 prints, so this is exact and linear.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bloom, materialize, may_hold_native, send, unused
from .components import components

_CHUNK = 1 << 16


def majority(hashes: np.ndarray) -> int:
    """Unsigned print of a set of uint64 hashes: a bit is set if over half of them have it. None: 0."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        counts += np.unpackbits(hashes[at : at + _CHUNK].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """Unsigned print of one text: a bit is set if over half of the shingles' XXH64 have it. No words: 0."""
    from xxhash import xxh64_digest

    w = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z alone, and white space is \x20 \x09-\x0D
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[k:] for k in range(words)))) if len(w) > words else iter((b" ".join(w),))  # noqa: B905
    n, counts = 0, np.zeros(64, np.int64)
    digests = map(xxh64_digest, shingles, repeat(seed))
    while chunk := b"".join(d for _, d in zip(range(_CHUNK), digests)):  # noqa: B905
        bits = np.unpackbits(np.frombuffer(chunk, np.uint8)).reshape(-1, 64)
        n += len(bits)
        for at in range(0, len(bits), 255):  # sums of up to 255 bits fit a byte
            counts += bits[at : at + 255].sum(0, dtype=np.uint8)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, h (hash of the text), fp (the print as a signed long) of every row; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py() or "", words, seed) for t in batch.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints.view(np.int64))], names=["doc_id", "h", "fp"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text")).mapInArrow(run, "doc_id long, h long, fp long")


def group_bits(together: np.ndarray, total: int, groups: int) -> list[list[int]]:
    """Deals 64 bits into ``groups`` of equal width: each group in turn takes the bit most correlated with what it has.

    ``together[a, b]``: prints that have both bits.
    """
    p = np.diag(together) / max(total, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((together / max(total, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    left, out = set(range(64)), []
    for g in range(groups):
        width = len(left) // (groups - g)
        pool = sorted(left)
        first = max(pool, key=lambda b: (corr[b, pool].sum(), -b))
        own = [first]
        left.discard(first)
        while len(own) < width:
            best = max(sorted(left), key=lambda b: (corr[b, own].mean(), -b))
            own.append(best)
            left.discard(best)
        out.append(sorted(own))
    return out


def pick(prints: np.ndarray, bits: list[int]) -> np.ndarray:
    """Values of the ``bits`` (numbered from the least) of uint64 prints."""
    out = np.zeros(len(prints), np.uint64)
    for j, b in enumerate(bits):
        out |= ((prints >> np.uint64(b)) & np.uint64(1)) << np.uint64(j)
    return out


def near_share(hist: np.ndarray, width: int, most: int) -> np.ndarray:
    """[t, v]: counts of ``hist`` at exactly t bits from v."""
    v = np.arange(len(hist))
    out = [hist]
    for t in range(1, most + 1):
        out.append(sum((hist[v ^ sum(1 << b for b in c)] for c in combinations(range(width), t)), np.zeros_like(hist)))
    return np.stack(out)


class Plan:
    """Groups of bits, each with two halves whose histograms estimate candidates, and the allocation of thresholds."""

    def __init__(self, groups: list[list[int]], hists: list[list[np.ndarray]], total: int, distance: int):
        self.groups, self.total, self.distance = groups, total, distance
        self.halves = [[g[: len(g) // 2], g[len(g) // 2 :]] for g in groups]
        self.near = [[near_share(h / max(total, 1), len(bits), distance) for h, bits in zip(hh, halves, strict=True)] for hh, halves in zip(hists, self.halves, strict=True)]
        self.flips = [[[sum(1 << b for b in c) for t in range(most + 1) for c in combinations(range(len(g)), t)] for most in range(distance + 1)] for g in groups]

    def costs(self, prints: np.ndarray, i: int) -> np.ndarray:
        """[t + 1]: probes and estimated candidates of group ``i`` at threshold t."""
        (a, b), v = self.near[i], [pick(prints, h).astype(np.int64) for h in self.halves[i]]
        at = [sum(a[x][v[0]] * b[t - x][v[1]] for x in range(t + 1)) for t in range(self.distance + 1)]
        return np.stack([np.zeros(len(prints)), *(len(self.flips[i][t]) + self.total * sum(at[: t + 1]) for t in range(self.distance + 1))])

    def thresholds(self, prints: np.ndarray) -> np.ndarray:
        """[print, group]: the cheapest thresholds with sum(t + 1) = distance + 1."""
        need, n, m = self.distance + 1, len(prints), len(self.groups)
        best, took = np.full((need + 1, n), np.inf), []
        best[0] = 0
        for i in range(m):
            cost, new, arg = self.costs(prints, i), np.full((need + 1, n), np.inf), np.zeros((need + 1, n), np.int64)
            for s in range(need + 1):
                for k in range(s + 1):
                    c = best[s - k] + cost[k]
                    better = c < new[s]
                    new[s][better], arg[s][better] = c[better], k
            best = new
            took.append(arg)
        out, s, rows = np.zeros((n, m), np.int64), np.full(n, need), np.arange(n)
        for i in reversed(range(m)):
            k = took[i][s, rows]
            out[:, i], s = k - 1, s - k
        return out

    def postings(self, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i, g in enumerate(self.groups):
            yield pick(prints, g) | np.uint64(i << 56), prints

    def probes(self, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        t = self.thresholds(prints)
        for i, g in enumerate(self.groups):
            own = pick(prints, g) | np.uint64(i << 56)
            for k in range(self.distance + 1):
                at = np.flatnonzero(t[:, i] == k)
                for start in range(0, len(at), 4096):
                    part = at[start : start + 4096]
                    flips = np.array(self.flips[i][k], np.uint64)
                    yield (own[part][:, None] ^ flips).ravel(), np.repeat(prints[part], len(flips))


def _prints(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)


def make_plan(fps: DataFrame, distance: int) -> Plan:
    """From counts over all distinct prints: 64 x 64 pairs of bits, then the halves' histograms. Both have fixed sizes."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((64, 64), np.int64)
        for batch in batches:
            x = np.unpackbits(_prints(batch).astype(">u8").view(np.uint8)).reshape(-1, 64)[:, ::-1].astype(np.float32)
            sums += (x.T @ x).astype(np.int64)
        if sums.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(4096)), pa.array(sums.ravel())], names=["at", "n"])

    together = np.zeros(4096, np.int64)
    for at, n in fps.mapInArrow(pairs, "at long, n long").groupBy("at").agg(F.sum("n")).collect():
        together[at] = n
    total = fps.count()
    # three groups cost 3 probes and 3 n / 2^21 candidates a print, two groups 34 probes and 34 n / 2^32
    groups = group_bits(together.reshape(64, 64), total, distance + 1 if total < 25_000_000 or distance < 2 else distance)
    halves = [h for g in groups for h in (g[: len(g) // 2], g[len(g) // 2 :])]

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hist = [np.zeros(1 << len(h), np.int64) for h in halves]
        for batch in batches:
            x = _prints(batch)
            for c, h in zip(hist, halves, strict=True):
                c += np.bincount(pick(x, h).astype(np.int64), minlength=len(c))
        for k, c in enumerate(hist):
            if len(at := np.flatnonzero(c)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at), pa.array(c[at])], names=["half", "at", "n"])

    hists = [np.zeros(1 << len(h), np.float64) for h in halves]
    for k, at, n in fps.mapInArrow(counts, "half long, at long, n long").groupBy("half", "at").agg(F.sum("n")).collect():
        hists[k][at] = n
    return Plan(groups, [hists[2 * i : 2 * i + 2] for i in range(len(groups))], total, distance)


def near_edges(fps: DataFrame, distance: int = 2, bucket: int = 64) -> DataFrame:
    """u, v: links among distinct prints (fps: fp) that join all prints at ``distance`` or fewer bits into the right components.

    Pairs from small buckets are all given; those of hot buckets as stars over shared neighbours.
    """
    if not 0 <= distance <= 2:
        raise ValueError("distance must be 0, 1 or 2: hot buckets are linked through one-bit neighbours")
    plan = send(fps.sparkSession, make_plan(fps, distance))

    def rows(method: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            deal = getattr(pickle.loads(plan.value), method)
            for batch in batches:
                for key, fp in deal(_prints(batch)):
                    if len(key):
                        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fp.view(np.int64))], names=["key", "fp"])

        return fps.select("fp").mapInArrow(run, "key long, fp long")

    index, probes = rows("postings"), materialize(rows("probes"), "probes")
    hot = materialize(index.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > bucket).select("key"), "hot")
    light = index.join(hot, "key", "left_anti").select(F.col("key").alias("k2"), F.col("fp").alias("v"))
    near = (F.col("fp") != F.col("v")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("v"))) <= distance)
    pairs = probes.join(light, (F.col("key") == F.col("k2")) & near).select(F.greatest("fp", "v").alias("u"), F.least("fp", "v").alias("v"))
    crowded = index.union(probes).join(hot, "key", "left_semi").select("fp").distinct()
    # distance 2: itself and its neighbours; distance 1: its neighbours' posts would reach too far, so pairs are taken from posts directly
    posts = crowded.select("fp", F.explode(F.expr("transform(sequence(0, 64), b -> if(b = 64, fp, fp ^ shiftleft(1L, b)))")).alias("post"))
    if distance < 2:
        other = crowded.select(F.col("fp").alias("v"))
        stars = posts.join(other, (F.col("post") == F.col("v")) & (F.col("fp") > F.col("v"))).select(F.col("fp").alias("u"), "v") if distance else crowded.filter("false").select(F.col("fp").alias("u"), F.col("fp").alias("v"))
    else:
        shared = posts.groupBy("post").agg(F.sort_array(F.collect_list("fp")).alias("own")).filter(F.size("own") > 1)
        stars = shared.select(F.col("own")[0].alias("v"), F.explode(F.slice("own", 2, 65)).alias("u")).select("u", "v").distinct()
    return pairs.union(stars).distinct()


def near_components(docs: DataFrame, words: int = 3, distance: int = 2, bucket: int = 64) -> DataFrame:
    """doc_id, h (hash of the text), fp, root, component_id of every row of ``docs`` (doc_id, text; other columns are ignored).

    root: a number of the component; component_id: the smallest doc_id reachable over links between prints (null if none has one). Equal prints are one node,
    so groups of copies cost one row. A null or empty text has print 0 and is linked like any other; an empty table gives no rows.
    """
    prints = materialize(fingerprints(docs, words), "prints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    roots = components(near_edges(nodes.select("fp"), distance, bucket))
    named = materialize(nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "named")
    ids = named.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    labels = named.join(ids.filter("n > 1").select(F.col("root").alias("r"), "component_id"), F.col("root") == F.col("r"), "left").select(F.col("fp").alias("fp2"), "root", F.coalesce("component_id", "first").alias("component_id"))
    return prints.join(labels, F.col("fp") == F.col("fp2")).select("doc_id", "h", "fp", "root", "component_id")


def near_groups(docs: DataFrame) -> DataFrame:
    """The contract's digest: doc_id, fingerprint (16 lower-case hex digits), component_id."""
    return near_components(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, groups: Callable[[DataFrame], DataFrame] = near_components) -> DataFrame:
    """The rows of ``docs``, with their columns, of which exactly one for each near-duplicate group.

    ``groups`` gives doc_id, h (Spark's xxhash64 of the text as it is) and root (a number of the group) of every row; those of op5's contract if not said otherwise. Rows are told
    apart by id and text: the one with the smallest doc_id stays (rows without one only where the group has no other), of several with that id the one with the least hash of its text. Of rows that
    repeat both, one stays. So rows that share a doc_id but not a group are judged apart, and a group never loses all its rows.
    """
    found = materialize(groups(docs).select("doc_id", "h", "root"), "found")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("h").alias("h"))
    best = found.groupBy(F.col("root").alias("r")).agg(F.min(rank).alias("best"), F.count("*").alias("n")).filter("n > 1")
    crowd = materialize(found.join(best, F.col("root") == F.col("r")).select("doc_id", "h", (rank == F.col("best")).alias("stays")), "crowd")
    d, h, k, w = unused(docs, "_d", "_h", "_k", "_w")
    key = lambda df: df.select(F.col("doc_id").alias(d), F.col("h").alias(h))
    marked = docs.withColumn(k, F.xxhash64(F.col("text").cast("string")))
    same = lambda df: df[k].eqNullSafe(F.col(h)) & df["doc_id"].cast("long").eqNullSafe(F.col(d))
    losers = materialize(key(crowd.filter("NOT stays").distinct()), "losers")
    repeated = materialize(key(crowd.filter("stays").groupBy("doc_id", "h").agg(F.count("*").alias("n")).filter("n > 1")), "repeated")
    # most rows just stay, so their texts aren't moved: a filter of bounded size tells which may not, and the joins decide on those
    words = bloom(losers.union(repeated).select(F.xxhash64(d, h).alias("h")))
    sent = F.broadcast(docs.sparkSession.createDataFrame(pa.table({w: pa.array([words.view(np.int64)], pa.list_(pa.int64()))})))
    touched = may_hold_native(F.col(w), F.xxhash64(F.col("doc_id").cast("long"), F.col(k)), len(words))
    clear, rest = (marked.join(sent, touched, how) for how in ("left_anti", "left_semi"))
    kept = rest.join(losers, same(rest), "left_anti")
    if not repeated.isEmpty():
        once = kept.join(repeated, same(kept), "left_semi").dropDuplicates(["doc_id", k])
        kept = kept.join(repeated, same(kept), "left_anti").union(once)
    return clear.union(kept).drop(k)
