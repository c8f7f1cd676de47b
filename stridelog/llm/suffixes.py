"""Removal of repeated byte strings by suffix sorting with bucket-pointer refinement.

A byte is removed if a string of ``length`` bytes that covers it also starts earlier (in a smaller document id, or earlier in the document).

Sorting all suffixes of a corpus would move every byte position. Instead suffixes enter the sort in groups:

1. Every string of ``length`` bytes is assigned to one anchor, the least 32-gram in it, which its bytes alone decide, so equal strings always share their
   anchor's gram: these q-gram buckets are the initial buckets, about one suffix group for each 35 bytes. Neighbouring strings with one anchor travel as one row.
2. In a bucket, rows are refined by the identifier (a 64-bit hash beside the gram's own) of everything that their strings cover. Rows equal in both are taken as equal in all their strings:
   only the earliest can be a first occurrence. Buckets that fall apart into several identifiers keep one row of each, undecided.
3. The undecided rows' bytes are cut from the texts and their suffixes sorted by bucket-pointer refinement: 8-gram buckets, then buckets of pairs (bucket of a suffix, bucket of
   the suffix 8, 16, 32, ... later), each round using the identifiers that the last one made and leaving single buckets alone, to the full length. Exact bytes decide in this step; the steps before compare 128 bits of hash.

Rows that a task already knows to be repeats don't travel. A bucket with more than ``crowd`` undecided rows is not sorted in one task: its strings are dealt by their own
identifiers instead, where equal ones are again merged before they travel, so no key gathers more than one row of a batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import find_anchors
from .common import by_bytes, materialize
from .sharding import global_prefix

LENGTH = 100
_BUFFER, _STEP = 4 << 20, 8 << 20


# ---------------------------------------------------------------- bucket-pointer refinement


def refine(bucket: np.ndarray, offset: int) -> np.ndarray:
    """Buckets of twice the depth: suffixes of a bucket are told apart by the bucket of the suffix ``offset`` later. Single ones aren't looked at again."""
    n = len(bucket) - offset
    own, later = bucket[:n], bucket[offset:]
    shared = np.bincount(bucket)[own] > 1
    out = np.empty(n, np.int64)
    pairs, out[shared] = np.unique(own[shared] * (int(bucket.max(initial=0)) + 1) + later[shared], return_inverse=True)
    out[~shared] = len(pairs) + np.arange(n - int(shared.sum()))
    return out


def buckets(buffer: bytes, depth: int) -> np.ndarray:
    """For each place with ``depth`` (at least 8) bytes after it a number that is the same for equal bytes only."""
    n = len(buffer) - 7
    if n <= 0 or len(buffer) < depth:
        return np.zeros(0, np.int64)
    out = np.unique(np.ndarray((n,), ">u8", buffer, 0, (1,)).copy(), return_inverse=True)[1].astype(np.int64)
    at = 8
    while at < depth:
        step = min(at, depth - at)
        out, at = refine(out, step), at + step
    return out


def repeats(doc: np.ndarray, start: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by keys, doc and start; in that order: whether a row with the same keys is strictly earlier)."""
    order = np.lexsort((start, doc, *keys))
    d, s, k = doc[order], start[order], [x[order] for x in keys]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([x[1:] != x[:-1] for x in k], axis=0)
    first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(order) else np.zeros(0, np.int64)
    return order, (d != d[first]) | (s != s[first])


def runs(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of starts, merged where they meet."""
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    if not len(doc):
        return doc, lo, hi
    base = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    top = np.concatenate([np.maximum.accumulate(x) for x in np.split(hi, base[1:])])
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (lo[1:] > top[:-1] + 1)])
    first = np.flatnonzero(new)
    return doc[first], lo[first], top[np.concatenate([first[1:] - 1, [len(doc) - 1]])]


# ---------------------------------------------------------------- rows on the way


_ROW = "kind int, key long, id long, doc long, lo long, hi long, bytes binary"
_SCHEMA = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("id", pa.int64()), ("doc", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("bytes", pa.binary())])
#: kinds: 0 strings in order from lo to hi with key and id; 1 known repeats; 2 undecided strings with their bytes
GROUP, KNOWN, BYTES = 0, 1, 2


def _rows(kind: int, key, id_, doc, lo, hi, raw=None) -> pa.RecordBatch:
    n = len(doc)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *(pa.array(np.asarray(x, np.int64)) for x in (key, id_, doc, lo, hi)), pa.array(raw if raw is not None else [None] * n, pa.binary())], schema=_SCHEMA)


def _known(doc, lo, hi) -> Iterator[pa.RecordBatch]:
    doc, lo, hi = runs(doc, lo, hi)
    if len(doc):
        spread = (doc * 0x9E3779B1 + lo) & 0x7FFFFFFFFFFF  # they need not meet anything
        yield _rows(KNOWN, spread, spread, doc, lo, hi)


def _merged(key, id_, doc, lo, hi) -> Iterator[pa.RecordBatch]:
    """Rows of which only the earliest of equal key and id travels; the others are known repeats."""
    order, again = repeats(doc, lo, id_, key)
    keep, drop = order[~again], order[again]
    if len(keep):
        yield _rows(GROUP, key[keep], id_[keep], doc[keep], lo[keep], hi[keep])
    yield from _known(doc[drop], lo[drop], hi[drop])


def _digests(buffer: bytes, lo: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    from xxhash import xxh3_64_digest

    return np.frombuffer(b"".join([xxh3_64_digest(buffer[s:e], seed) for s, e in zip(lo.tolist(), end.tolist(), strict=True)]), ">i8").astype(np.int64)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple[int, int]], bytes, np.ndarray]]:
    """([(document, place of the part in it)], buffer, ends): whole texts together, texts beyond the step in overlapping parts."""
    names, texts, held = [], [], 0

    def full():
        return list(names), b"".join(texts), np.cumsum([len(t) for t in texts])

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = text.as_py()
            for at in range(0, max(1, len(raw) - LENGTH + 1), _STEP):
                part = raw[at : at + _STEP + LENGTH - 1]
                if len(part) < LENGTH:
                    continue
                names.append((doc, at))
                texts.append(part)
                held += len(part)
                if held >= _BUFFER:
                    yield full()
                    names, texts, held = [], [], 0
    if names:
        yield full()


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for names, buffer, ends in _parts(batches):
        _, h, lo, hi = find_anchors(buffer, ends, LENGTH)
        if not len(lo):
            continue
        own = np.searchsorted(ends, lo, "right")
        shift = np.array([at for _, at in names]) - np.concatenate([[0], ends[:-1]])
        doc = np.array([d for d, _ in names], np.int64)[own]
        yield from _merged(h.view(np.int64), _digests(buffer, lo, hi + LENGTH, 0), doc, lo + shift[own], hi + shift[own])


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, id, doc and lo -> known repeats, and (as GROUP) the earliest row of each id in keys with several ids.

    Only one row is held from batch to batch: the earliest of a key's first id, until a second id comes or the key ends.
    """
    last: tuple | None = None  # key, id, and doc and lo of the id's earliest
    pending: list[pa.RecordBatch] = []
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        known = batch.filter(pa.array(kind == KNOWN))
        if known.num_rows:
            yield known
        rows = batch.filter(pa.array(kind == GROUP))
        n = rows.num_rows
        if not n:
            continue
        key, id_, doc, lo, hi = (rows.column(c).to_numpy() for c in ("key", "id", "doc", "lo", "hi"))
        new_key = np.concatenate([[last is None or last[0] != key[0]], key[1:] != key[:-1]])
        new_id = new_key | np.concatenate([[last is None or last[1] != id_[0]], id_[1:] != id_[:-1]])
        first = np.maximum.accumulate(np.where(new_id, np.arange(n), -1))
        d0 = np.where(first >= 0, doc[first], last[2] if last else 0)
        l0 = np.where(first >= 0, lo[first], last[3] if last else 0)
        again = (doc != d0) | (lo != l0)
        yield from _known(doc[again], lo[again], hi[again])
        # of each key: how many ids begin in this batch, and whether some began before it
        group = np.cumsum(new_key) - (1 if new_key[0] else 0)  # 0: the key that goes on from the batch before
        ids = np.bincount(group, new_id)
        if new_key[0]:
            pending = []
        elif ids[0] and pending:
            yield pending.pop()
        several = ids[group] > 1
        if not new_key[0]:
            several |= group == 0
        tail = group[-1]
        out = new_id & several
        if out.any():
            yield rows.filter(pa.array(out))
        if tail > 0 or new_key[0]:
            at = np.flatnonzero(new_id & (group == tail))
            pending = [rows.slice(int(at[0]), 1)] if len(at) == 1 else []
        last = (key[-1], id_[-1], d0[-1], l0[-1])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their undecided rows -> the rows with their bytes; those of crowded keys as single strings by their own identifiers."""
    single: list[tuple[np.ndarray, ...]] = []
    held = 0
    for batch in by_bytes(batches, 1):
        doc, lo, hi, key, raw = [], [], [], [], []
        for d, text, own in zip(batch.column("doc").to_pylist(), batch.column("raw"), batch.column("own").to_pylist(), strict=True):
            if not own:
                continue
            t = text.as_py()
            for x in own:
                if x["crowded"]:
                    s = np.arange(x["lo"], x["hi"] + 1)
                    single.append((_digests(t, s, s + LENGTH, 1), _digests(t, s, s + LENGTH, 2), np.full(len(s), d, np.int64), s, s))
                    held += len(s)
                else:
                    doc.append(d), lo.append(x["lo"]), hi.append(x["hi"]), key.append(x["key"]), raw.append(t[x["lo"] : x["hi"] + LENGTH])
        if doc:
            yield _rows(BYTES, key, key, doc, lo, hi, raw)
        if held >= 500_000:
            yield from _merged(*map(np.concatenate, zip(*single, strict=True)))
            single, held = [], 0
    if single:
        yield from _merged(*map(np.concatenate, zip(*single, strict=True)))


def _sort_chunk(chunk: list[tuple[int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    """(doc, lo, hi, bytes) rows: their strings' buckets by bucket-pointer refinement; all but the earliest string of each bucket are repeats."""
    sizes = np.array([len(c[3]) for c in chunk])
    at = np.cumsum(sizes) - sizes
    many = np.array([c[2] - c[1] + 1 for c in chunk])
    which = np.repeat(np.arange(len(chunk)), many)
    step = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
    bucket = buckets(b"".join(c[3] for c in chunk), LENGTH)[at[which] + step]
    doc, start = np.array([c[0] for c in chunk], np.int64)[which], np.array([c[1] for c in chunk], np.int64)[which] + step
    order, again = repeats(doc, start, bucket)
    drop = order[again]
    yield from _known(doc[drop], start[drop], start[drop])


def _sort_undecided(batches: Iterator[pa.RecordBatch], most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Undecided rows sorted by key, in chunks that end where a key ends."""
    chunk, held, key = [], 0, None
    for batch in batches:
        for k, doc, lo, hi, raw in zip(*(batch.column(c).to_pylist() for c in ("key", "doc", "lo", "hi", "bytes")), strict=True):
            if held >= most and k != key:
                yield from _sort_chunk(chunk)
                chunk, held = [], 0
            key = k
            chunk.append((doc, lo, hi, raw))
            held += len(raw)
    if chunk:
        yield from _sort_chunk(chunk)


def _by_kind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by kind, key, id, doc and lo, each kind by its own rule; only known repeats come out."""
    later: list[pa.RecordBatch] = []

    def early() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            undecided = batch.column("kind").to_numpy() == BYTES
            if undecided.any():
                later.append(batch.filter(pa.array(undecided)))
                yield batch.filter(pa.array(~undecided))
                return
            yield batch

    for out in _resolve(early()):
        known = out.filter(pa.array(out.column("kind").to_numpy() == KNOWN))
        if known.num_rows:
            yield known

    def rest() -> Iterator[pa.RecordBatch]:
        yield from later
        yield from batches

    yield from _sort_undecided(rest())


# ---------------------------------------------------------------- the operator


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, doc (orders documents), raw. doc is doc_id; only if rows share an id but not their text, or have none, is it their place by id and text."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = d.select("doc_id", F.xxhash64("text").alias("h"))
    odd = ids.groupBy("doc_id").agg(F.min("h").alias("a"), F.max("h").alias("b")).filter("doc_id IS NULL OR a <> b").isEmpty()
    raw = F.col("text").cast("binary").alias("raw")
    if odd:
        return d.select("doc_id", F.col("doc_id").alias("doc"), raw)
    places = materialize(global_prefix(ids.distinct().withColumn("one", F.lit(1)), ["doc_id", "h"], "one").select(F.col("doc_id").alias("i"), F.col("h").alias("h"), F.col("_index").alias("doc")), "places")
    return d.join(places, d["doc_id"].eqNullSafe(F.col("i")) & (F.xxhash64("text") == F.col("h"))).select("doc_id", "doc", raw)


def repeated_strings(keyed: DataFrame, crowd: int = 4096) -> DataFrame:
    """doc, lo, hi: intervals of the starts of strings that also start earlier (stored; they may overlap or meet)."""
    rows = keyed.select("doc", "raw").mapInArrow(_anchor_rows, _ROW).select("kind", "key", "id", "doc", "lo", "hi")
    order = ["key", "id", "doc", "lo"]
    ddl = _ROW

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _resolve(batches):
            yield b if b.num_columns == 7 else pa.RecordBatch.from_arrays([*b.columns, pa.nulls(b.num_rows, pa.binary())], schema=_SCHEMA)

    first = materialize(rows.repartition("key").sortWithinPartitions(*order).mapInArrow(resolve, ddl).select("kind", "key", "doc", "lo", "hi"), "resolved")
    undecided = first.filter(F.col("kind") == GROUP).select("key", "doc", "lo", "hi")
    crowded = materialize(undecided.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > crowd).select(F.col("key").alias("k")), "crowded")
    marked = undecided.join(crowded, F.col("key") == F.col("k"), "left").select("doc", F.struct("key", "lo", "hi", F.col("k").isNotNull().alias("crowded")).alias("x"))
    # one document's rows are bounded by its length
    lists = marked.groupBy(F.col("doc").alias("d")).agg(F.collect_list("x").alias("own"))
    cut = keyed.select("doc", "raw").join(lists.hint("shuffle_hash"), F.col("doc") == F.col("d")).select("doc", "raw", "own").mapInArrow(_cut, _ROW)
    second = cut.repartition("key").sortWithinPartitions("kind", *order).mapInArrow(_by_kind, _ROW).select("kind", "key", "doc", "lo", "hi")
    return first.filter(F.col("kind") == KNOWN).select("doc", "lo", "hi").union(materialize(second, "sorted").select("doc", "lo", "hi"))


def kept_bytes(raw: bytes, spans: list[tuple[int, int]]) -> tuple[list[bytes], int, int]:
    """(pieces that stay, bytes removed, runs removed) for intervals of starts of repeated strings."""
    out, at, removed, n = [], 0, 0, 0
    end = -1
    for lo, hi in sorted(spans):
        e = hi + LENGTH
        if lo > end:
            out.append(raw[at:lo])
            n += 1
            removed += e - lo
            at = end = e
        elif e > end:
            removed += e - end
            at = end = e
    return [*out, raw[at:]], removed, n


def remove_repeats(docs: DataFrame, crowd: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``docs`` (doc_id, text; other columns are ignored).

    A null text is empty. A row that repeats another's id and text is that document again: neither is earlier, both get the same result. Rows that share an id but differ
    in text, or have no id, are ordered by id (nulls first) and a hash of the text. An empty table gives no rows; texts under 100 bytes lose nothing.
    """
    keyed = _keyed(docs)
    spans = repeated_strings(keyed, crowd).groupBy(F.col("doc").alias("d")).agg(F.collect_list(F.struct("lo", "hi")).alias("own"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, raw, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                t = raw.as_py()
                pieces, removed, n = kept_bytes(t, [(x["lo"], x["hi"]) for x in own or ()])
                h = hashlib.sha256()
                for p in pieces:
                    h.update(p)
                rows.append((doc_id, len(t), removed, n, h.hexdigest()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 4 + [pa.string()], strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = keyed.join(spans.hint("shuffle_hash"), F.col("doc") == F.col("d"), "left").select("doc_id", "raw", "own")
    return joined.mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
