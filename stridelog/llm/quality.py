"""Document quality by ordinal cumulative-link regression on graded ratings.

A text is a bag of hashed features: its words, their first letters, the shapes of words, and a few shares (repeated words, distinct words).
All grades share one weight for each feature; K - 1 ordered thresholds cut the score into K grades:
P(grade >= k) = logistic(score - threshold_k). The tail probability of the best grade selects documents.

Weights are fitted on the driver over a bounded sample of rated rows (``per_grade`` rows of each grade, those with the least hash of their id,
weighted back to the grades' true counts). Features are first screened on the executors: only those whose presence
depends on the grade (chi-square) are kept, ``most_features`` at most, so what the driver holds is bounded too.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, materialize, send, unused

BITS = 22
_EDGE = "\"'`.,;:!?()[]{}<>*$%&#|-_"


class Hashed(dict):
    """Raw word -> (shape's bucket or -1, buckets of the word and its first letters). Emptied when it holds ``most`` words.

    With ``keep``, only those buckets are given: what scoring needs of most words is then nothing or its shape.
    """

    def __init__(self, keep=None, most: int = 500_000):
        from xxhash import xxh3_64_intdigest

        super().__init__()
        self.keep, self.most, self.hash = keep, most, xxh3_64_intdigest
        self.shapes: dict[tuple[str, str], int] = {}

    def bucket(self, name: str) -> int:
        return self.hash(name.encode("utf-8", "surrogatepass")) >> (64 - BITS)

    def __missing__(self, raw: str) -> tuple[int, tuple[int, ...]]:
        core, keep = raw.strip(_EDGE), self.keep
        low = core.lower()
        tail = raw[len(raw.rstrip(_EDGE)) :][:3]
        case = "u" if len(core) > 1 and core.isupper() else "t" if core[:1].isupper() else "l" if core.islower() else "n" if any(c.isdigit() for c in core) else "o"
        shape = self.shapes.get((case, tail))
        if shape is None:
            shape = self.bucket(f"s {case}{tail}")
            if keep is not None and shape not in keep:
                shape = -1
            if len(self.shapes) < 10_000:
                self.shapes[case, tail] = shape
        n, digest = len(low), self.hash
        words = [digest(low.encode("utf-8", "surrogatepass")) >> (64 - BITS)] if n else []
        if n > 64:  # a text without white space: overlapping parts of it count
            words += [digest(f"part {low[k : k + 16]}".encode("utf-8", "surrogatepass")) >> (64 - BITS) for k in range(0, n - 15, 8)]
        for k in (4, 5, 6):
            if n >= k:
                words.append(digest(f"{k} {low[:k]}".encode("utf-8", "surrogatepass")) >> (64 - BITS))
        out = (shape, tuple(words) if keep is None else tuple(b for b in words if b in keep))
        if len(raw) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[raw] = out
        return out

    def features(self, text: str) -> dict[int, float]:
        raw = text.split()
        if not raw:
            out = {self.bucket("empty"): 1.0}
        else:
            n, shapes, words = len(raw), {}, {}
            counted = Counter(raw)
            for (shape, own), c in zip(map(self.__getitem__, counted), counted.values(), strict=True):
                if shape >= 0:
                    shapes[shape] = shapes.get(shape, 0) + c
                for b in own:
                    words[b] = words.get(b, 0) + c
            out = {b: math.log1p(c) for b, c in words.items()}
            for b, c in shapes.items():
                out[b] = out.get(b, 0.0) + 4 * math.sqrt(c / n)
            again = sum(map(eq, raw, islice(raw, 1, None))) / n
            out[self.bucket("bias")] = 1.0
            out[self.bucket("again")] = 4 * math.sqrt(again)
            out[self.bucket(f"again {min(4, int(again * 20))}")] = 1.0
            out[self.bucket(f"distinct {int(len(counted) / n * 8)} {min(4, int(math.log10(n)))}")] = 1.0
        return out if self.keep is None else {b: x for b, x in out.items() if b in self.keep}


def fit(rows: list[tuple[int, float, bytes, bytes]], grades: int, penalty: float = 1.0, steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) from (grade, weight, columns as int32 bytes, values as float32 bytes): penalized likelihood, full-batch Adam."""
    y, sw = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    cols, vals = np.frombuffer(b"".join(r[2] for r in rows), np.int32), np.frombuffer(b"".join(r[3] for r in rows), np.float32)
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r[2]) // 4 for r in rows])
    size = 1 + int(cols.max(initial=-1))
    sw /= sw.sum()
    share = np.array([sw[y >= k].sum() for k in range(1, grades)])
    start = np.log((1 - share + 1e-3) / (share + 1e-3))
    gaps = np.log(np.maximum(np.diff(start), 0.05))
    w, low = np.zeros(size), np.array([start[0]])
    p = [w, low, gaps]
    m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, steps + 1):
        theta = np.concatenate([p[1], p[1] + np.cumsum(np.exp(p[2]))])
        s = np.bincount(owner, p[0][cols] * vals, len(rows))
        tail = np.concatenate([np.ones((len(rows), 1)), sig(s[:, None] - theta), np.zeros((len(rows), 1))], 1)
        slope = tail * (1 - tail)
        at = np.arange(len(rows))
        prob = np.maximum(tail[at, y] - tail[at, y + 1], 1e-9)
        up, down = slope[at, y] / prob, slope[at, y + 1] / prob
        ds = -sw * (up - down)
        dtheta = np.zeros(grades - 1)
        np.add.at(dtheta, np.clip(y - 1, 0, None), np.where(y > 0, sw * up, 0))
        np.add.at(dtheta, np.clip(y, None, grades - 2), np.where(y < grades - 1, -sw * down, 0))
        after = np.cumsum(dtheta[::-1])[::-1]
        g = [np.bincount(cols, ds[owner] * vals, size) + penalty * p[0] / max(len(rows), 1), after[:1], after[1:] * np.exp(p[2])]
        rate = 0.1 * (1 - step / (steps + 1)) + 0.002
        for k in range(3):
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
            p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return p[0], np.concatenate([p[1], p[1] + np.cumsum(np.exp(p[2]))])


class Model:
    def __init__(self, weights: dict[int, float], thresholds: list[float]):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, score: float) -> list[float]:
        """P(grade >= k) for k = 1, 2, ..."""
        return [1 / (1 + math.exp(-max(-40.0, min(40.0, score - t)))) for t in self.thresholds]


def sample_rated(docs: DataFrame, ratings: DataFrame, grades: int, per_grade: int) -> DataFrame:
    """doc_id, grade, w, text of the sample: ``per_grade`` rated ids of each grade at most, by least hash; w: rated rows that one stands for.

    Ids rated more than once take their lowest grade. The ids, at most ``grades`` x ``per_grade`` of them, are broadcast.
    """
    rated = ratings.filter("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    counts = dict(rated.groupBy("grade").count().collect())
    ids = None
    for g in range(grades):
        if counts.get(g):
            part = rated.filter(F.col("grade") == g).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_grade).withColumn("w", F.lit(counts[g] / min(counts[g], per_grade)))
            ids = part if ids is None else ids.union(part)
    if ids is None:
        return docs.select("doc_id", F.lit(0).alias("grade"), F.lit(1.0).alias("w"), "text").filter("false")
    ids = ids.select(F.col("doc_id").alias("id"), "grade", "w")
    return docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("id")).select("doc_id", "grade", "w", "text")


def train(docs: DataFrame, ratings: DataFrame, grades: int = 3, per_grade: int = 4000, most_features: int = 10_000, least_rows: int = 8) -> Model:
    """A model from ``docs`` (doc_id, text) and ``ratings`` (doc_id, grade 0 to ``grades`` - 1).

    With no rated row, or all of one grade, the model gives every text the best grade: nothing is known against any.
    """
    sample = materialize(sample_rated(docs, ratings, grades, per_grade), "rated")

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, counts = Hashed(), np.zeros((grades, 1 << BITS), np.int32)
        for batch in batches:
            for g, text in zip(batch.column("grade").to_pylist(), batch.column("text"), strict=True):
                counts[g, list(hashed.features(text.as_py() or ""))] += 1
        for g in range(grades):
            if len(at := np.flatnonzero(counts[g])):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), g, np.int32)), pa.array(at.astype(np.int32)), pa.array(counts[g, at].astype(np.int64))], names=["grade", "bucket", "n"])

    sizes = dict(sample.groupBy("grade").count().collect())
    if len(sizes) < 2:
        return Model({}, [-40.0] * (grades - 1))
    total = sum(sizes.values())
    by = sample.mapInArrow(screen, "grade int, bucket int, n long").groupBy("bucket").agg(*(F.sum(F.when(F.col("grade") == g, F.col("n")).otherwise(0)).alias(f"n{g}") for g in range(grades)), F.sum("n").alias("n"))
    gap = sum(((F.col(f"n{g}") - F.col("n") * (sizes.get(g, 0) / total)) ** 2 / (F.col("n") * (max(sizes.get(g, 0), 1) / total)) for g in range(grades)), F.lit(0.0))
    kept = [r.bucket for r in by.filter(F.col("n") >= least_rows).withColumn("x", gap).filter("x >= 12").orderBy(F.desc("x"), "bucket").limit(most_features).select("bucket").collect()]
    column = {b: k for k, b in enumerate(sorted({*kept, Hashed().bucket("bias")}))}
    sent = send(docs.sparkSession, column)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = pickle.loads(sent.value)
        hashed = Hashed(keep)
        for batch in batches:
            rows = [hashed.features(t.as_py() or "") for t in batch.column("text")]
            cols = pa.array([np.array([keep[b] for b in sorted(r)], np.int32).tobytes() for r in rows], pa.binary())
            vals = pa.array([np.array([r[b] for b in sorted(r)], np.float32).tobytes() for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("grade"), batch.column("w"), cols, vals], names=["grade", "w", "cols", "vals"])

    rows = [(r.grade, r.w, bytes(r.cols), bytes(r.vals)) for r in sample.mapInArrow(project, "grade int, w double, cols binary, vals binary").collect()]
    weights, thresholds = fit(rows, grades)
    return Model({b: float(weights[k]) for b, k in column.items() if k < len(weights)}, [float(t) for t in thresholds])


def score(docs: DataFrame, model: Model, keep_columns: list[str] | None = None, names: tuple[str, str] = ("expected_grade", "tail")) -> DataFrame:
    """``keep_columns`` of ``docs`` (default: doc_id) with the expected grade and the tail (P of the best grade) under ``names``, from whole texts. A null text is empty."""
    sent, keep = send(docs.sparkSession, model), keep_columns if keep_columns is not None else ["doc_id"]
    at = len(keep)
    text, expected, tail = unused(docs, "_text", "_expected", "_tail")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(sent.value)
        w = model.weights
        hashed = Hashed(w)
        for batch in by_bytes(batches, at):
            tails = [model.tails(sum(w[b] * x for b, x in hashed.features(t.as_py() or "").items())) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array([sum(t) for t in tails], pa.float64()), pa.array([t[-1] for t in tails], pa.float64())], names=[*batch.schema.names[:at], expected, tail])

    narrow = docs.select(*keep, F.col("text").cast("string").alias(text))
    ddl = ", ".join([*(f"`{n}` {t}" for n, t in docs.select(*keep).dtypes), f"`{expected}` double", f"`{tail}` double"])
    return narrow.mapInArrow(run, ddl).withColumnsRenamed({expected: names[0], tail: names[1]})


def graded(labels: DataFrame) -> DataFrame:
    """doc_id, grade from quality and toxic marks: 0 poor, 1 well-formed but toxic, 2 good. Rows without a mark for quality aren't rated; a null toxic mark is none."""
    q, t = F.col("quality"), F.coalesce(F.col("toxic"), F.lit(0))
    return labels.filter("quality IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.when(q == 0, 0).when(t != 0, 1).otherwise(2).alias("grade"))


#: A document stays if the best grade is at least this likely.
KEEP = 0.5


def classify(docs: DataFrame, labels: DataFrame, least: float = KEEP, **options) -> DataFrame:
    """doc_id, expected_grade, tail, selected for every row of ``docs`` (doc_id, text; other columns are ignored).

    An empty table gives no rows; repeated rows are scored each; equal texts get equal scores.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return score(narrow, train(narrow, graded(labels), **options)).withColumn("selected", F.col("tail") >= least)


def select_documents(docs: DataFrame, labels: DataFrame, least: float = KEEP, **options) -> DataFrame:
    """The rows of ``docs``, with their columns, whose tail probability is ``least`` or more."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    grade, best = unused(docs, "_grade", "_best")
    return score(docs, train(narrow, graded(labels), **options), docs.columns, (grade, best)).filter(F.col(best) >= least).select(*docs.columns)
