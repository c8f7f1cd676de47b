"""Nearest neighbours by a permutation index.

Pivots are drawn from the vectors. Each vector is represented by its ``posted`` nearest pivots in order and posted, with its place, in the inverted files
of those pivots. A query opens the files of its own ``opened`` nearest pivots. With an absent pivot counting as place L = ``opened``, the footrule distance of two such lists
falls by 2 * (L - max(place_x, place_q)) for each pivot that both have, so it is summed up from the opened files alone. The vectors nearest by footrule are reranked by inner products of
the original vectors.

The number of pivots and of reranked vectors grow with the root of the number of vectors N, so a query reads about ``posted`` * ``opened`` / pivots * N = 256 sqrt(N) postings and reranks
12 sqrt(N) vectors, until the pivots reach ``most_pivots``. The constants were chosen on random directions in 64 dimensions, the hardest case.

Inverted files are kept in blocks of vectors. Blocks of queries (a stated set) are sent to every block of vectors, which stays where it is; each meeting returns at most
``top`` + 1 rows a query, and these are merged. Copies of one vector are one entry that keeps the ``top`` + 1 smallest ids, all that can ever be among a query's ``top``.

Inner products become angles by one more coordinate, sqrt(M^2 - |x|^2) with M the largest norm, so pivots rank vectors of unequal norms rightly.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, send

_OUT = "query bigint, query_id bigint, vec_id bigint, score double"


def valid_vectors(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, v (array of double): distinct rows that can take part: an id, no null or non-finite component, not all zero."""
    v = F.col(embedding).cast("array<double>")
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id IS NOT NULL AND size(v) > 0")
    return rows.filter("forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf')) AND exists(v, x -> x <> 0)").distinct()


class Pivots:
    def __init__(self, vectors: np.ndarray, norm: float, posted: int, opened: int):
        self.norm, self.posted, self.opened = norm, min(posted, len(vectors)), min(opened, len(vectors))
        self.pivots = self.lift(vectors)

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(self.norm**2 - (x * x).sum(1), 0))[:, None]], 1)

    def nearest(self, x: np.ndarray, query: bool) -> np.ndarray:
        """[row, place]: the nearest pivots in order."""
        lifted, most = np.concatenate([x, np.zeros((len(x), 1))], 1) if query else self.lift(x), self.opened if query else self.posted
        out = np.empty((len(x), most), np.int64)
        for s in range(0, len(x), 1024):
            near = lifted[s : s + 1024] @ self.pivots.T
            at = np.argpartition(-near, most - 1, axis=1)[:, :most]
            out[s : s + 1024] = np.take_along_axis(at, np.argsort(-np.take_along_axis(near, at, 1), axis=1, kind="stable"), 1)
        return out


class Block:
    """The inverted files of some vectors: for each pivot the rows posted in it with their places, one after the other."""

    def __init__(self, x: np.ndarray, own: list[list[int]], rows: np.ndarray, places: np.ndarray, begins: np.ndarray):
        self.x, self.own, self.rows, self.places, self.begins = x, own, rows, places, begins
        self.least = np.array([o[0] for o in own])

    @staticmethod
    def post(x: np.ndarray, pivots: Pivots) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = pivots.nearest(x, False)
        at = np.argsort(order, axis=None, kind="stable")
        begins = np.concatenate([[0], np.cumsum(np.bincount(order.ravel(), minlength=len(pivots.pivots)))])
        return (at // order.shape[1]).astype(np.int32), (at % order.shape[1]).astype(np.int32), begins.astype(np.int64)

    def gains(self, opened: np.ndarray) -> np.ndarray:
        """[query, row]: half of what the footrule distance falls by, from the files that each query opens."""
        queries, length = opened.shape
        lo, n = self.begins[opened].ravel(), (self.begins[opened + 1] - self.begins[opened]).ravel()
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        place = np.repeat(np.tile(np.arange(length, dtype=np.int32), queries), n)
        cell = np.repeat(np.repeat(np.arange(queries) * len(self.x), length), n) + self.rows[at]
        return np.bincount(cell, length - np.maximum(self.places[at], place), queries * len(self.x)).reshape(queries, len(self.x))

    def search(self, q: np.ndarray, q_ids: np.ndarray, pivots: Pivots, share: float, top: int) -> Iterator[tuple[int, int, float]]:
        """(query's number, vec_id, score): each query's ``top`` rows of this block among those reranked."""
        n = len(self.x)
        most, step = min(n, max(4 * top, math.ceil(share * n))), max(1, (1 << 20) // n)
        for s in range(0, len(q), step):
            part = q[s : s + step]
            if most < n:
                near = np.argpartition(self.gains(pivots.nearest(part, True)), n - most, axis=1)[:, n - most :]
            else:
                near = np.broadcast_to(np.arange(n), (len(part), n))
            for j, at in enumerate(near, s):
                score = self.x[at] @ q[j]
                cut = np.lexsort((self.least[at], -score))[: top + 1]  # one more: the query's own vector may have no other id
                for best, i in sorted((-float(score[c]), i) for c in cut for i in self.own[at[c]] if i != q_ids[j])[:top]:
                    yield j, i, -best


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list]]:
    """(key, rows) of runs of equal first columns."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and row[0] != key:
                yield key, rows
                rows = []
            key = row[0]
            rows.append(row)
    if rows:
        yield key, rows


def nearest(df: DataFrame, top: int = 20, every: int = 20, posted: int = 32, opened: int = 128, pivots_per_root: float = 16, most_pivots: int = 4096, reranked_per_root: float = 12, block: int = 8192, queries: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by ``every`` its ``top`` nearest of all other rows found.

    Null, zero and non-finite vectors and rows without an id take no part. Vectors are searched among those of their own length. Repeated rows are one; rows of one id with
    different vectors are candidates each, but none for a query of that id. Ties go to the smaller vec_id. An empty table gives no rows. Other columns are ignored.
    """
    rows = materialize(valid_vectors(df), "vectors")
    lengths = [r.n for r in rows.select(F.size("v").alias("n")).distinct().orderBy("n").collect()]  # numbers of dimensions, as many as there are kinds of vectors
    found = [_nearest(rows.filter(F.size("v") == n), n, top, every, posted, opened, pivots_per_root, most_pivots, reranked_per_root, block, queries) for n in lengths]
    met = reduce(DataFrame.union, found) if found else rows.sparkSession.createDataFrame([], _OUT)
    best = Window.partitionBy("query", "query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def _nearest(rows: DataFrame, width: int, top: int, every: int, posted: int, opened: int, pivots_per_root: float, most_pivots: int, reranked_per_root: float, block: int, queries: int) -> DataFrame:
    """query (a number of the query's row), query_id, vec_id, score from each block, over vectors of one length."""
    # the copies of one vector: at most top + 1 of them leave each task, and they meet on the vector
    few = rows.withColumn("nth", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("nth") <= top + 1)
    distinct = materialize(few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("own")).withColumn("h", F.xxhash64("v")), "distinct")
    total, norm = distinct.agg(F.count("*"), F.max(F.expr("sqrt(aggregate(v, 0D, (s, x) -> s + x * x))"))).first()
    root = math.sqrt(total)
    drawn = np.array([r.v for r in distinct.orderBy("h", "own").select("v", "h", "own").limit(max(256, min(most_pivots, round(pivots_per_root * root)))).collect()])
    sent, share = send(rows.sparkSession, Pivots(drawn, float(norm), posted, opened)), min(1.0, reranked_per_root * root / total)
    blocks = -(-total // max(256, min(block, (32 << 20) // (8 * width))))
    q = rows.filter(F.col("vec_id") % every == 0)
    q_blocks = max(1, -(-q.count() // queries))
    ddl = "block long, kind int, q_block long, x binary, own array<array<long>>, rows binary, places binary, begins binary"

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = pickle.loads(sent.value)
        for key, got in _gather(batches):
            x = np.array([r[1] for r in got], np.float64)
            files = [pa.array([a.tobytes()]) for a in Block.post(x, at)]
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([0], pa.int32()), pa.array([0], pa.int64()), pa.array([x.tobytes()]), pa.array([[r[2] for r in got]]), *files], names=["block", "kind", "q_block", "x", "own", "rows", "places", "begins"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, got in _gather(batches):
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([np.array([r[1] for r in got], np.float64).tobytes()]), pa.array([[[r[2] for r in got]]])], names=["q_block", "x", "own"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's row and then its queries."""
        at, here = pickle.loads(sent.value), None
        for batch in (b.slice(k, 1) for b in batches for k in range(b.num_rows)):
            _, kind, key, x, own, *files = (c[0].as_py() for c in batch.columns)
            x = np.frombuffer(x).reshape(-1, width)
            if kind == 0:
                here = Block(x, own, *(np.frombuffer(f, t) for f, t in zip(files, (np.int32, np.int32, np.int64), strict=True)))
                continue
            ids = own[0]
            found = list(here.search(x, np.array(ids), at, share, top))
            if found:
                j, i, s = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([(width << 48) ^ (key << 20) ^ n for n in j], pa.int64()), pa.array([ids[n] for n in j], pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.float64())], names=["query", "query_id", "vec_id", "score"])

    def dealt(df: DataFrame, n: int, name: str) -> DataFrame:
        return df.withColumn(name, F.pmod("h", F.lit(n)).cast("long")).repartitionById(n, F.col(name).cast("int")).sortWithinPartitions(name)

    files = materialize(dealt(distinct, blocks, "block").select("block", "v", "own").mapInArrow(index, ddl), "files")
    asked = dealt(q.withColumn("h", F.xxhash64("vec_id", "v")), q_blocks, "q_block").select("q_block", "v", "vec_id").mapInArrow(ask, "q_block long, x binary, own array<array<long>>")
    none = F.lit(None).cast("binary")
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")).alias("block"), F.lit(1).alias("kind"), "q_block", "x", "own", none.alias("rows"), none.alias("places"), none.alias("begins"))
    return files.union(asked).repartitionById(blocks, F.col("block").cast("int")).sortWithinPartitions("block", "kind", "q_block").mapInArrow(meet, _OUT)
