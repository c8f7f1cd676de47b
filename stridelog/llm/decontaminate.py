"""Benchmark decontamination by spaced-seed hashing.

A mask keeps five of up to eight neighbouring tokens and ignores the others, so a substituted word breaks only the seeds that
keep it. Test items' seeds are hashed into an index; every seed of every training text is looked up in it (a hash join whose build
side is the test set), and around each hit the two texts are compared token by token on the hit's diagonal.

The three default masks together hit every aligned run of 8 to 20 tokens in which at most a fifth of the tokens are substituted (found
by trying all patterns), so with the default window nothing is missed: an item is found in a document if some
``window`` neighbouring tokens of it (all of them, if it has fewer) stand there with at least ``similarity`` of them equal.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, materialize, send

MASKS = ((0, 1, 2, 4, 5), (0, 1, 4, 6, 7), (0, 2, 5, 6, 7))
#: Items with fewer tokens are never reported: so few words prove nothing.
LEAST = 8
_WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_HITS = 1 << 14


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


class WordIds(dict):
    """Word -> 63-bit hash; emptied when it holds ``most`` words."""

    def __init__(self, most: int = 500_000):
        from xxhash import xxh3_64_intdigest

        super().__init__()
        self.most, self.hash = most, xxh3_64_intdigest

    def __missing__(self, word: str) -> int:
        out = self.hash(word.encode("utf-8", "surrogatepass")) >> 1
        if len(word) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[word] = out
        return out

    def ids(self, tokens: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))


def seeds(ids: np.ndarray, mask: tuple[int, ...], number: int) -> np.ndarray:
    """Hash of the seed that begins at each position where the mask fits."""
    n = len(ids) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, number + 1, np.uint64)
    x = ids.view(np.uint64)
    for o in mask:
        h = (h ^ x[o : o + n]) * _MIX
        h ^= h >> np.uint64(29)
    return h


class Index:
    """Seeds of a block of test items, sorted by hash, and the items' tokens."""

    def __init__(self, items: list[tuple[int, list[str]]], masks=MASKS, window: int = 20, similarity: float = 0.8):
        ids = WordIds()
        self.masks, self.window, self.similarity = masks, window, similarity
        self.items = np.array([i for i, _ in items], np.int64)
        self.size = np.array([len(t) for _, t in items], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.size)[:-1]]).astype(np.int64)
        self.tokens = np.concatenate([np.zeros(0, np.int64), *(ids.ids(t) for _, t in items)])
        owner = np.repeat(np.arange(len(items)), self.size)
        keys, places, kinds = [], [], []
        for k, m in enumerate(masks):
            h = seeds(self.tokens, m, k)
            at = np.arange(len(h))
            inside = owner[at] == owner[at + m[-1]] if len(h) else np.zeros(0, bool)
            keys.append(h[inside])
            places.append(at[inside])
            kinds.append(np.full(int(inside.sum()), k))
        keys, places, kinds = map(np.concatenate, (keys, places, kinds))
        order = np.argsort(keys, kind="stable")
        self.keys, self.places, self.kinds, self.owner = keys[order], places[order], kinds[order], owner
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.keys >> np.uint64(42)).astype(np.int64)] = True

    def hits(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(position in ``ids``, position in the items' tokens) of equal seeds, at most ``_HITS`` at once, however many items share a seed."""
        for k, m in enumerate(self.masks):
            h = seeds(ids, m, k)
            at = np.flatnonzero(self.maybe[(h >> np.uint64(42)).astype(np.int64)])
            lo, hi = np.searchsorted(self.keys, h[at], "left"), np.searchsorted(self.keys, h[at], "right")
            n = hi - lo
            ends = np.cumsum(n)
            for s in range(0, int(ends[-1]) if len(ends) else 0, _HITS):
                each = np.arange(s, min(s + _HITS, int(ends[-1])))
                which = np.searchsorted(ends, each, "right")
                yield at[which], self.places[lo[which] + each - (ends[which] - n[which])]

    def verify(self, ids: np.ndarray, begins: np.ndarray, ends: np.ndarray, at: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(item's number, equal tokens, window's length, window's start in ``ids``) of the best window around each hit that reaches the similarity.

        ``begins`` and ``ends``: the bounds of the text that each position ``at`` is in.
        """
        item = self.owner[place]
        first, size = self.first[item], self.size[item]
        length = np.minimum(size, self.window)
        # offsets from the hit: a window that holds the seed lies within window - 1 before and after it
        reach = np.arange(-(self.window - 1), self.window + max(m[-1] for m in self.masks))
        p, q = at[:, None] + reach, place[:, None] + reach
        good = (p >= begins[:, None]) & (p < ends[:, None]) & (q >= first[:, None]) & (q < (first + size)[:, None])
        same = good & (ids[np.where(good, p, 0)] == self.tokens[np.where(good, q, 0)])
        sums = [np.concatenate([np.zeros((len(at), 1), np.int32), np.cumsum(x, 1, dtype=np.int32)], 1) for x in (same, good)]
        cols = np.arange(len(reach))
        right = cols + length[:, None]
        fits = right <= len(reach)
        right = np.minimum(right, len(reach))
        took, there = (np.take_along_axis(s, right, 1) - s[:, :-1] for s in sums)
        took = np.where(fits & (there == length[:, None]), took, -1)
        best = took.argmax(1)
        most = took[np.arange(len(at)), best]
        keep = most >= np.ceil(self.similarity * length - 1e-9)
        return item[keep], most[keep], length[keep], (at + reach[best])[keep]


_OUT = [("doc_id", pa.int64()), ("item_id", pa.int64()), ("matched", pa.int32()), ("window", pa.int32()), ("similarity", pa.float64()), ("start_token", pa.int64())]
_DDL = "doc_id long, item_id long, matched int, window int, similarity double, start_token long"


def matches(index: Index, vocabulary: WordIds, texts, most: int = 1 << 19) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item's number, equal tokens, window, start token) of the best window of each item in each of ``texts`` (an Arrow column)."""
    group, first, held = [], 0, 0
    for row in range(len(texts) + 1):
        if row == len(texts) or held >= most:
            if held:
                ids, ends = np.concatenate(group), np.cumsum([len(x) for x in group])
                best: dict[tuple[int, int], tuple[int, int, int]] = {}
                for at, place in index.hits(ids):
                    doc = np.searchsorted(ends, at, "right")
                    begins = np.where(doc > 0, ends[doc - 1], 0)
                    for i, m, n, w in zip(*(x.tolist() for x in index.verify(ids, begins, ends[doc], at, place)), strict=True):
                        d = int(np.searchsorted(ends, w, "right"))
                        new = (m, n, w - (int(ends[d - 1]) if d else 0))
                        old = best.get((d, i))
                        if old is None or (-new[0], new[2]) < (-old[0], old[2]):
                            best[d, i] = new
                for (d, i), (m, n, w) in best.items():
                    yield first + d, i, m, n, w
            group, first, held = [], row, 0
        if row < len(texts):
            group.append(vocabulary.ids(words(texts[row].as_py())))
            held += len(group[-1])


def _finder(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, vocabulary = pickle.loads(sent.value), WordIds()
        for batch in by_bytes(batches, 1):
            ids = batch.column(0)
            rows = [(ids[r].as_py(), int(index.items[i]), m, n, m / n, w) for r, i, m, n, w in matches(index, vocabulary, batch.column(1))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _OUT, strict=True)], names=[n for n, _ in _OUT])

    return run


def blocks_of(tests: DataFrame, window: int, similarity: float, block_chars: int) -> Iterator[Index]:
    """Indexes over blocks of the test set of about ``block_chars`` characters at most; one empty index if there is nothing to look for."""
    if window > 20 or similarity < 0.8 or window < LEAST:
        raise ValueError("the masks are complete for windows of 8 to 20 tokens and a similarity of 0.8 or more")
    items = tests.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(chars) // block_chars))
    for b in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).sort("item_id", "text").collect()
        yield Index([(r.item_id, w) for r in part if len(w := words(r.text)) >= LEAST], window=window, similarity=similarity)


def drop_contaminated(docs: DataFrame, tests: DataFrame, window: int = 20, similarity: float = 0.8, block_chars: int = 4_000_000) -> DataFrame:
    """The rows of ``docs``, with their columns, in which no test item is found: one pass for each block of the test set, no shuffle."""
    at, kept = docs.columns.index("text"), docs
    for k, index in enumerate(blocks_of(tests, window, similarity, block_chars)):
        if k:  # the block before is done with, and so is its index
            kept = materialize(kept, "clean")
            sent.unpersist()
        sent = send(docs.sparkSession, index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index, vocabulary = pickle.loads(sent.value), WordIds()
            for batch in by_bytes(batches, at):
                keep = np.ones(batch.num_rows, bool)
                for r, *_ in matches(index, vocabulary, batch.column(at)):
                    keep[r] = False
                yield batch.filter(pa.array(keep))

        kept = kept.mapInArrow(run, docs.schema)
    return kept


def contaminated(docs: DataFrame, tests: DataFrame, window: int = 20, similarity: float = 0.8, block_chars: int = 4_000_000) -> DataFrame:
    """doc_id, item_id, matched, window, similarity, start_token: each pair of a document and a test item found in it.

    The reported window is the one with the most equal tokens, the first if several; start_token counts the document's tokens from 0.
    ``docs``: doc_id, text; ``tests``: item_id, text; other columns are ignored. Null or empty texts, and items of fewer than 8 tokens,
    give no pair; repeated rows of docs give their pairs each; repeated items are one (rows of one item_id with different texts are looked for each); a null doc_id is kept, items without an id are not looked for.

    The test set is indexed in blocks of at most about ``block_chars`` characters, measured first, each sent to the executors for one pass over ``docs``;
    so what is broadcast is bounded, and a larger test set takes more passes.
    """
    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = None
    for index in blocks_of(tests, window, similarity, block_chars):
        if out is not None:  # the block before is done with, and so is its index
            out = materialize(out, "found")
            sent.unpersist()
        sent = send(docs.sparkSession, index)
        part = narrow.mapInArrow(_finder(sent), _DDL)
        out = part if out is None else out.union(part)
    return out
