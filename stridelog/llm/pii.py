"""Personal data by bootstrapped contextual extraction.

Spans that four strict patterns find (e-mail, IP address, card, phone) are the seeds. The words around
them are lexical patterns; every identifier-like token in the corpus, seed or not, is an instance. Spark
scores the graph of patterns and instances in rounds: a pattern is trusted for a kind if nearly all its distinct instances are of
that kind, an instance is accepted if the trusted patterns that it stands in leave little doubt, and accepted instances
count as seeds of the next round. All occurrences of accepted instances are spans as well.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, materialize, unused

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can't begin inside a run of digits whose first digit failed, so the look-behind only saves time
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[0-9@]\S*")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"\S+")
#: Two to five groups of digits with a blank between each two.
_GROUPS = re.compile(r"[+(]?[0-9][0-9().-]*(?: [(]?[0-9][0-9().-]*){1,4}(?![^\s\"'`.,;:!?)\]}>])")
_EDGE = "\"'`.,;:!?()[]{}<>*$%&#|"


def _emails(t: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: the local part is the run of its characters before an @, as far as the match before."""
    end, at = 0, t.find("@")
    while at >= 0:
        s = at
        while s > end and t[s - 1] in _LOCAL:
            s -= 1
        if s < at and (m := _DOMAIN.match(t, at + 1)):
            end = m.end()
            yield s, end
        at = t.find("@", max(at + 1, end))


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(t: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) in code points, sorted."""
    out = [(s, 0, e) for s, e in _emails(t)]
    for m in _IP.finditer(t):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(t):
        if 14 <= m.end() - m.start() and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in t:
        for m in _PHONE.finditer(t):
            if 10 <= len(_DIGIT.findall(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _name(w: str) -> str:
    """``w``, or a hash of it where it is long: compared as a whole either way."""
    from xxhash import xxh3_128_hexdigest

    return w if len(w) <= 64 else "#" + xxh3_128_hexdigest(w.encode("utf-8", "surrogatepass"))


def _word(w: str) -> str:
    """Context words are compared in lower case, digits as 0."""
    return _name(_DIGIT.sub("0", w.lower()))


class Words:
    """The whole words of a text, and those beside a span."""

    def __init__(self, t: str):
        at = [m.span() for m in _WORD.finditer(t)]
        self.t, self.starts, self.ends = t, [s for s, _ in at], [e for _, e in at]

    def beside(self, s: int, e: int) -> tuple[list[str], list[str]]:
        """(up to two words before, up to one after); of a word that the span cuts, the part outside it."""
        i, k = bisect_left(self.starts, s), bisect_right(self.ends, e)
        before = [self.t[self.starts[j] : min(self.ends[j], s)] for j in range(max(0, i - 2), i)]
        return before, [self.t[max(self.starts[j], e) : self.ends[j]] for j in range(k, min(k + 1, len(self.starts)))]


def contexts(words: Words, s: int, e: int) -> list[str]:
    """The lexical patterns around a span: two words before; one before and one after; a label that ends in : or =."""
    before, after = ([_word(w) for w in part] for part in words.beside(s, e))
    out = []
    if len(before) == 2:
        out.append(f"2 {before[0]} {before[1]}")
    if before and after:
        out.append(f"b {before[-1]} {after[0]}")
    if before and before[-1][-1] in ":=":
        out.append(f"l {before[-1]}")
    return out


def fits(kind: int, token: str) -> bool:
    """Loose shapes that an unseen identifier of a kind must have."""
    n = len(_DIGIT.findall(token))
    return (kind == 0 and "@" in token) or (kind == 1 and n >= 4 and (token.count(".") >= 3 or token.count(":") >= 2)) or (kind == 2 and n >= 12 and n * 2 >= len(token)) or (kind == 3 and 7 <= n <= 15 and n * 2 >= len(token))


def occurrences(t: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int | None, int, int, str, int, list[str]]]:
    """(seed's kind, start, end, instance, bits of the kinds that its shape fits, patterns) of seeds and of other identifier-like tokens.

    A token stands between white space; groups of digits beside each other are one token if together they have the shape of a kind.
    """
    words = Words(t) if base or _TOKEN.search(t) else None
    for s, k, e in base:
        yield k, s, e, _norm(t[s:e]), 1 << k, contexts(words, s, e)
    taken, i, end = sorted((s, e) for s, _, e in base), 0, 0

    def trimmed(s: int, e: int) -> tuple[int, int]:
        while s < e and t[s] in _EDGE:
            s += 1
        while s < e and t[e - 1] in _EDGE:
            e -= 1
        return s, e

    def shapes_of(s: int, e: int) -> int:
        return sum(1 << k for k in range(4) if fits(k, t[s:e]))

    for m in _TOKEN.finditer(t):
        if m.start() < end:
            continue
        at = words.starts[bisect_right(words.starts, m.start()) - 1] if words.starts else m.start()
        at, stop = max(at, end), m.end()
        s, e = trimmed(at, stop)
        shapes = shapes_of(s, e)
        if (run := _GROUPS.match(t, at)) and run.end() > stop:
            s2, e2 = trimmed(at, run.end())
            if more := shapes_of(s2, e2) & 0b1100:
                s, e, stop, shapes = s2, e2, run.end(), more
        end = stop
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        if shapes and not (i < len(taken) and taken[i][0] < e):
            yield None, s, e, _norm(t[s:e]), shapes, contexts(words, s, e)


def _norm(token: str) -> str:
    return _name(token.lower().replace(" ", "").replace("-", ""))


_OCC = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("instance", pa.string()), ("shapes", pa.int32()), ("patterns", pa.list_(pa.string()))]))
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("k", pa.int32()), ("end", pa.int32())]))
_SCAN = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("h", pa.int64()), ("n_email", pa.int64()), ("n_ip", pa.int64()), ("n_card", pa.int64()), ("n_phone", pa.int64()), ("base_sha256", pa.string()), ("base", _SPAN), ("occ", _OCC)])
_SCAN_DDL = (
    "uid long, doc_id long, h long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<struct<start:int,k:int,end:int>>, "
    "occ array<struct<kind:int,start:int,end:int,instance:string,shapes:int,patterns:array<string>>>"
)


def scan(docs: DataFrame) -> DataFrame:
    """One stored row for each row of ``docs``: base counts, digest and spans, and the occurrences for the graph. No text is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 3):
            rows = []
            for uid, doc_id, h, text in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3), strict=True):
                t = text.as_py() or ""
                base = base_spans(t)
                n = [sum(k == j for _, k, _ in base) for j in range(4)]
                sha = hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest()
                occ = [dict(zip(("kind", "start", "end", "instance", "shapes", "patterns"), o, strict=True)) for o in occurrences(t, base)]
                rows.append((uid, doc_id, h, *n, sha, [{"start": s, "k": k, "end": e} for s, k, e in base], occ))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCAN, strict=True)], schema=_SCAN)

    text = F.col("text").cast("string")
    return materialize(docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text")).mapInArrow(run, _SCAN_DDL), "pii")


def bootstrap(scanned: DataFrame, least: int = 3, trust: float = 0.8, accept: float = 0.9, most_rounds: int = 100) -> DataFrame:
    """instance, kind: instances that are no seeds but that trusted patterns support.

    A pattern is trusted for a kind if it has ``least`` distinct instances of that kind and they are ``trust`` of all its distinct instances;
    its confidence is that share with one more failure. An instance is accepted for a kind that its shape fits if the chance that all its
    trusted patterns err is at most 1 - ``accept``; of several kinds the likeliest, ties to the first. What is accepted stays accepted, so
    rounds end when one accepts nothing new; it raises if ``most_rounds`` were not enough.
    """
    occ = scanned.select(F.explode("occ").alias("o")).select("o.*")
    # one row for each pattern and instance, however often they meet
    graph = materialize(
        occ.select(F.explode("patterns").alias("pattern"), "instance", "kind", "shapes").groupBy("pattern", "instance").agg(F.min("kind").alias("seed"), F.bit_or("shapes").alias("shapes")), "graph"
    )
    # a pattern with fewer instances than that can't be trusted now or later
    big = graph.groupBy("pattern").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    graph = materialize(graph.join(big.select(F.col("pattern").alias("p")), F.col("pattern") == F.col("p"), "left_semi"), "graph")
    found = graph.select("instance", F.lit(0).alias("kind")).filter("false")
    for _ in range(most_rounds):
        known = found.select(F.col("instance").alias("i"), F.col("kind").alias("k"))
        labelled = graph.join(known, F.col("instance") == F.col("i"), "left").withColumn("label", F.coalesce("seed", "k"))
        counts = [F.count_if(F.col("label") == k).alias(f"c{k}") for k in range(len(KINDS))]
        stats = labelled.groupBy("pattern").agg(F.count("*").alias("n"), *counts)
        trusted = stats.select("pattern", "n", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"c{k}").alias("c")) for k in range(len(KINDS))))).alias("x")).select(
            F.col("pattern").alias("p"), F.col("x.k").alias("tk"), (F.col("x.c") / (F.col("n") + 1)).alias("conf"), "n", F.col("x.c").alias("c")
        )
        trusted = materialize(trusted.filter((F.col("c") >= least) & (F.col("c") >= trust * F.col("n"))).select("p", "tk", "conf"), "trusted")
        pairs = labelled.filter("label IS NULL").join(trusted, (F.col("pattern") == F.col("p")) & (F.expr("shapes & shiftleft(1, tk)") != 0))
        score = pairs.groupBy("instance", "tk").agg((1 - F.exp(F.sum(F.log(1 - F.col("conf"))))).alias("score")).filter(F.col("score") >= accept)
        new = materialize(score.groupBy("instance").agg(F.max_by("tk", F.struct("score", -F.col("tk"))).alias("kind")), "found")
        if new.isEmpty():
            return found
        found = found.union(new)
    raise RuntimeError("identifiers were still being accepted after the last round")


def find_pii(docs: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """(the stored scan, extra spans: uid, doc_id, h, start, k, end)."""
    scanned = scan(docs)
    found = bootstrap(scanned, **options)
    occ = scanned.select("uid", "doc_id", "h", F.explode("occ").alias("o")).filter("o.kind IS NULL")
    extra = occ.join(found.select(F.col("instance").alias("i"), "kind"), F.col("o.instance") == F.col("i")).select("uid", "doc_id", "h", F.col("o.start").alias("start"), F.col("kind").alias("k"), F.col("o.end").alias("end"))
    return scanned, materialize(extra, "extra")


def pii_digest(docs: DataFrame) -> DataFrame:
    """The contract's digest of every row of ``docs`` (doc_id, text; other columns are ignored).

    A null text is empty: counts 0, no spans. An empty table gives no rows; repeated rows are rows each; a null doc_id stays null.
    """
    scanned, extra = find_pii(docs)
    more = extra.groupBy(F.col("uid").alias("u")).agg(F.collect_list(F.struct("start", "k", "end")).alias("more"))
    kinds = F.array(*map(F.lit, KINDS))
    spans = F.array_sort(F.concat("base", F.coalesce("more", F.expr("cast(array() as array<struct<start:int,k:int,end:int>>)"))))
    joined = F.array_join(F.transform(spans, lambda x: F.concat_ws(":", kinds[x["k"]], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return scanned.join(more, F.col("uid") == F.col("u"), "left").select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", joined.alias("spans"))


def redact_text(t: str, spans: list[tuple[int, int, int]]) -> str:
    """Each span becomes its kind in brackets; of overlapping spans the whole covered range takes the first one's kind."""
    out, at, last = [], 0, None
    for s, k, e in sorted(spans):
        if last is not None and s < last:
            last = at = max(last, e)
            continue
        out += [t[at:s], f"[{KINDS[k].upper()}]"]
        last = at = e
    return "".join([*out, t[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with the personal data in ``text`` replaced; all columns stay, ``n_chars`` (if there is one) follows the new text.

    A null text stays null. Extra spans are matched by doc_id and a hash of the text; the join is a broadcast only if their stored size allows it.
    """
    _, extra = find_pii(docs)
    d, h, spans = unused(docs, "_d", "_h", "_more")
    more = extra.groupBy(F.col("doc_id").alias(d), F.col("h").alias(h)).agg(F.array_distinct(F.collect_list(F.struct("start", "k", "end"))).alias(spans))
    more = materialize(more, "more")
    joined = docs.join(more, docs["doc_id"].cast("long").eqNullSafe(F.col(d)) & (F.xxhash64(docs["text"].cast("string")) == F.col(h)), "left").drop(d, h)
    fields, at = docs.schema, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, at):
            texts = []
            for text, more in zip(batch.column(at), batch.column(batch.num_columns - 1), strict=True):
                t = text.as_py()
                spans = base_spans(t) if t is not None else []
                spans += [(x["start"], x["k"], x["end"]) for x in more.as_py() or ()]
                texts.append(redact_text(t, spans) if spans else t)
            cols = list(batch.columns[:-1])
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names[:-1])

    out = joined.mapInArrow(run, fields)
    return out.withColumn("n_chars", F.length("text").cast(fields["n_chars"].dataType)) if "n_chars" in docs.columns else out
