"""Bounded-space online best-fit packing of tokenized documents.

Tokenizing: the vocabulary is sent once to each executor. White space never takes part in a
token and never joins what stands on its two sides, so each run between white space is encoded
by the tokenizer once and its ids are kept in a bounded table.

Packing: pieces are dealt to packers by a hash of their document, a fixed number of pieces to a packer on
average, and each packer streams over its pieces with a fixed number of open bins. A big
integer is the bitset of the free spaces that some open bin has; the smallest set bit at
or above the piece's length is the best fit. If no bin fits and all places are taken, the fullest bin is closed.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, materialize, small_batches

#: White space of the tokenizer's patterns (Unicode White_Space); str.split() also splits at U+001C to U+001F.
_SPACE = re.compile("[\t-\r \x85\xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])) + "]+")
_ODD = re.compile("[\x1c-\x1f]")


#: What the shortcut of ``IdBytes`` rests on, in a tokenizer's JSON. Fixed values.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class IdBytes(dict):
    """Run between white space -> its ids as little-endian unsigned 32-bit. Emptied once it holds ``most`` runs.

    ``learn`` encodes many new runs at once: those that are letters with ASCII marks after them are encoded as the lower-case letters
    and the marks apart (the tokenizer splits there too), and all new words of letters in one call, cut at the tokens that end a word.
    That holds for tokenizers that normalize and split as this one does (``by_run``); with any other each text is encoded whole.
    """

    def __init__(self, vocabulary: str, most: int = 400_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.most = Tokenizer.from_str(vocabulary), most
        self.letters: dict[str, bytes] = {}
        spec, n = json.loads(vocabulary), self.tokenizer.get_vocab_size()
        split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        self.by_run = (
            (spec.get("normalizer") or {}).get("normalizers") == _NORMALIZERS and split.get("pattern") == {"Regex": _SPLIT} and split.get("behavior") == "Removed" and split.get("invert") is True
            and (spec.get("model") or {}).get("end_of_word_suffix") == "</w>" and spec.get("post_processor") is None
        )
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(n)])

    def one(self, run: str) -> bytes:
        return np.array(self.tokenizer.encode(run, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, run: str) -> bytes:
        ids = self.one(run)
        if len(run) <= 64:
            self[run] = ids
        return ids

    def learn(self, runs: set[str]) -> None:
        new = runs.difference(self)
        if len(self) + len(new) > self.most:
            self.clear()
            new = runs
        if len(self.letters) > self.most:
            self.letters.clear()
        split: dict[str, tuple[str, str]] = {}
        for run in new:
            core = run.rstrip(_MARKS)
            if len(run) <= 64 and core.isalpha() and (core.isascii() or (is_normalized("NFC", core) and "\u03a3" not in core)):
                low = core.lower()
                if low.isalpha():
                    split[run] = low, run[len(core) :]
        fresh = list({low for low, _ in split.values()}.difference(self.letters))
        for at in range(0, len(fresh), 50_000):
            part = fresh[at : at + 50_000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(part):
                raw, last = ids.tobytes(), 0
                for w, e in zip(part, (4 * cut).tolist(), strict=True):
                    self.letters[w], last = raw[last:e], e
            else:
                self.letters.update((w, self.one(w)) for w in part)
        for run, (low, marks) in split.items():
            ids = self.letters[low]
            self[run] = ids + self[marks] if marks else ids

    def encode(self, words: list[str]) -> bytes:
        return b"".join(map(self.__getitem__, words))


def runs(text: str) -> list[str]:
    return _SPACE.split(text) if _ODD.search(text) else text.split()


class BestFit:
    """Online best-fit over ``space`` units with at most ``open_bins`` bins open."""

    def __init__(self, space: int, open_bins: int):
        self.space, self.open_bins = space, open_bins
        self.free: dict[int, list[int]] = {}
        self.bits = self.count = self.made = 0

    def _take(self, free: int) -> int:
        bins = self.free[free]
        found = bins.pop()
        if not bins:
            self.bits ^= 1 << free
        self.count -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece of 1 to ``space`` units."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            found = self._take(free)
        else:
            if self.count >= self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            free, found = self.space, self.made
            self.made += 1
        if left := free - length:
            self.free.setdefault(left, []).append(found)
            self.bits |= 1 << left
            self.count += 1
        return found, self.space - free


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def token_pieces(docs: DataFrame, vocabulary: str, space: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids with ``end_id`` after them, cut where longer than ``space``.

    A null or empty text is the end id alone. ``vocabulary`` is the tokenizer's JSON.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    step, end = 4 * space, end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = IdBytes(sent.value)
        for batch in by_bytes(batches, 1):
            out: list[tuple] = []
            rows = [(doc_id, runs(t) if words.by_run else t) for doc_id, t in zip(batch.column(0).to_pylist(), (text.as_py() or "" for text in batch.column(1)), strict=True)]
            if words.by_run:
                words.learn(set(chain.from_iterable(own for _, own in rows)))
            for doc_id, own in rows:
                ids = (words.encode(own) if words.by_run else words.one(own)) + end
                for k, at in enumerate(range(0, len(ids), step)):
                    piece = ids[at : at + step]
                    out.append((doc_id, k, at // 4, len(piece) // 4, zlib.crc32(piece)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _PIECES.types, strict=True)] if out else [pa.array([], t) for t in _PIECES.types], schema=_PIECES)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, space: int = 4096, open_bins: int = 1024, pieces_per_packer: int = 250_000) -> DataFrame:
    """``pieces`` (from token_pieces, stored) with sequence_id and offset.

    Packers are as many as the pieces need at ``pieces_per_packer``, so each one's work is bounded; each leaves
    at most ``open_bins`` sequences short. The order in a packer is by a hash, then by document and piece.
    """
    packers = max(1, -(-pieces.count() // pieces_per_packer))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    key = F.xxhash64("doc_id", "piece", "ids_crc32")
    schema = pa.schema([*_PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bins, first = BestFit(space, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [bins.place(n) for n in batch.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array([first + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())], schema=schema
            )

    return (
        pieces.select(*names)
        .repartition(packers, key)
        .sortWithinPartitions(key, "doc_id", "piece", "start")
        .mapInArrow(fill, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    )


def default_vocabulary() -> str:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def pack_documents(docs: DataFrame, vocabulary: str | None = None, space: int = 4096, open_bins: int = 1024, batch_rows: int = 1000) -> DataFrame:
    """Tokenize, cut and pack whole ``docs`` (doc_id, text; other columns are ignored).

    Null texts are empty, an empty table gives an empty result, repeated rows are packed each. Fewer ``batch_rows`` take less memory and more time.
    """
    with small_batches(docs.sparkSession, batch_rows):
        pieces = materialize(token_pieces(docs, vocabulary or default_vocabulary(), space), "pieces")
    return pack(pieces, space, open_bins)
