"""Every query against brute force: on the smallest given tables, and on odd tables (nulls, empties, long texts, copies, extra columns, no rows)."""

import os
import random
import re
import sys
import zlib

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import brute

from stridelog.llm import queries as Q

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
WIDER = "/root/testdata/sf0.01"  # the smallest given table with planted secrets
WORDS = "alpha beta gamma delta river stone cloud paper green seven window garden copper market signal motion harbor winter letter bridge".split()


def odd_texts():
    r = random.Random(5)
    say = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    base, shared = say(60), say(30)
    near = base.split()
    near[7] = "changed"
    texts = [None, "", " \n\t ", "one", "Two Words", base, base, base.upper(), " ".join(near), say(5000), f"{say(20)} {shared} {say(20)}", f"{say(9)} {shared} {say(11)}", shared + " " + shared, "é" * 150, "x" * 400, "aé😀b " * 40, "\x1c\x1d odd\x85space here", base]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "s", 1, "clash", "h") for i, t in odd_texts()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, fp string")


@pytest.fixture(scope="module")
def none(odd):
    return odd.filter("false")


@pytest.fixture(scope="module")
def given(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def rows(df, *names):
    return [tuple(r) for r in df.select(*names).collect()]


# ---------------------------------------------------------------- WARC


def test_warc(spark):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    got = {r[0]: r[1:] for r in rows(Q.op2_warc_zip(spark, SF), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")}
    assert got == brute.warc(pages)


def test_warc_odd(spark):
    from stridelog.llm.warc import roundtrip

    pages = [(1, None, None), (2, "u\r\nX: y", ""), (3, "u", "a" * 1000), (4, "u", "a" * 1000), (5, None, "a" * 999), (6, "u", "a" * 999), (7, "u", "é" * 600), (8, "u", "a" * 1000)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, uri string")
    got = {r[0]: r[1:] for r in rows(roundtrip(df), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")}
    assert got == brute.warc([(i, h) for i, _, h in pages])
    assert roundtrip(df.filter("false")).count() == 0


def test_zip64(tmp_path):
    import io
    import zipfile

    from stridelog.llm.warc import central_directory, stored_range

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        with z.open(zipfile.ZipInfo("a/é.txt"), "w", force_zip64=True) as f:
            f.write(b"payload")
        z.writestr("b", b"more")
        z.comment = b"PK\x05\x06 in a comment"
    members = {m.name: m for m in central_directory(out)}
    at, n = stored_range(out, members["a/é.txt"])
    assert out.getvalue()[at : at + n] == b"payload" and set(members) == {"a/é.txt", "b"}
    with pytest.raises(ValueError):
        central_directory(io.BytesIO(b"no archive"))


# ---------------------------------------------------------------- neighbours


def exact(ids, x, queries, top=20):
    out = {}
    for q in queries:
        s = x @ x[q]
        order = sorted((-s[j], ids[j]) for j in range(len(ids)) if j != q)[:top]
        out[ids[q]] = [(i, -v) for v, i in order]
    return out


def test_neighbours(spark):
    r = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    r = [(i, v) for i, v in r if v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    ids, x = [i for i, _ in r], np.array([v for _, v in r], np.float64)
    want = exact(ids, x, [k for k, i in enumerate(ids) if i % 20 == 0])
    got = {}
    for q, rank, i, s in sorted(rows(Q.op3_permutation_index(spark, SF), "query_id", "rank", "vec_id", "score")):
        got.setdefault(q, []).append((rank, i, s))
    assert set(got) == set(want)
    hit = total = 0
    score = {(ids[a], ids[b]): x[a] @ x[b] for a in range(len(ids)) if ids[a] % 20 == 0 for b in range(len(ids))}
    for q, found in got.items():
        assert [f[0] for f in found] == list(range(1, len(want[q]) + 1))
        assert all(abs(s - score[q, i]) < 1e-9 for _, i, s in found)
        hit += len({i for _, i, _ in found} & {i for i, _ in want[q]})
        total += len(want[q])
    assert hit / total >= 0.9


def test_neighbours_odd(spark):
    from stridelog.llm.permutation import nearest

    data = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0, None]), (7, [2.0, 1.0]), (8, [1.0]), (None, [1.0, 1.0]), (40, [float("inf"), 0.0]), (7, [2.0, 1.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").selectExpr("*", "1 AS h", "2 AS block")
    got = sorted(rows(nearest(df), "query_id", "rank", "vec_id", "score"))
    assert got == [(0, 1, 7, 2.0), (0, 2, 20, 1.0), (20, 1, 7, 2.0), (20, 2, 0, 1.0)]
    assert nearest(df.filter("false")).count() == 0
    wide = spark.createDataFrame([(20, [1.0]), (21, [3.0]), (22, [2.0]), (40, [1.0, 1.0]), (41, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert sorted(rows(nearest(wide), "query_id", "rank", "vec_id", "score")) == [(20, 1, 21, 3.0), (20, 2, 22, 2.0), (40, 1, 41, 1.0)]


def test_neighbours_of_many_blocks(spark):
    """Recall against brute force where a block holds a part of the vectors, with copies, and every query gets its full list."""
    from stridelog.llm.permutation import nearest

    r = np.random.default_rng(2)
    x = r.normal(size=(3000, 24)) * r.uniform(0.5, 2, size=(3000, 1))
    x[100:160] = x[100]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for q, _, i, s in sorted(rows(nearest(df, block=700, queries=40), "query_id", "rank", "vec_id", "score")):
        got.setdefault(q, []).append((i, s))
    hit = 0
    for q in range(0, 3000, 20):
        s = x @ x[q]
        want = [int(i) for i in np.lexsort((np.arange(3000), -s)) if i != q][:20]
        assert len(got[q]) == 20 and all(abs(v - s[i]) < 1e-9 for i, v in got[q]) and [v for _, v in got[q]] == sorted((v for _, v in got[q]), reverse=True)
        hit += len({i for i, _ in got[q]} & set(want))
    assert hit / (150 * 20) >= 0.9


# ---------------------------------------------------------------- SimHash


def test_simhash(spark, given, odd, none):
    from stridelog.llm.simhash import keep_one, near_groups

    for df, docs in ((None, given), (odd, odd_texts())):
        got = {r[0]: (int(r[1], 16), r[2]) for r in rows(Q.op5_simhash_pigeonhole(spark, SF) if df is None else near_groups(df), "doc_id", "fingerprint", "component_id")}
        assert got == brute.components({i: brute.fingerprint(t) for i, t in docs})
    kept = keep_one(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {c for _, c in brute.components({i: brute.fingerprint(t) for i, t in odd_texts()}).values()}
    assert near_groups(none).count() == 0


def test_simhash_links(spark):
    """Random prints with planted neighbours, so that every threshold and hot values are met."""
    from stridelog.llm.components import components
    from stridelog.llm.simhash import near_edges

    r = random.Random(3)
    prints = {r.getrandbits(64) for _ in range(150)}
    for p in list(prints)[:60]:
        for _ in range(3):
            prints.add(p ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 3))))
    hot = r.getrandbits(64)
    prints |= {hot ^ (1 << b) for b in range(40)}
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    got = {n: root for n, root in rows(components(near_edges(df, 2, 8)), "node", "root")}
    want = brute.components({signed(p): p for p in prints})
    mine = {}
    for s in want:
        mine.setdefault(want[s][1], set()).add(s)
    theirs = {}
    for s in want:
        theirs.setdefault(got.get(s, s), set()).add(s)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


# ---------------------------------------------------------------- shards, packing


def test_shards(spark, given, odd, none):
    from stridelog.llm.sharding import shard_documents

    for df, docs in ((None, given), (odd, odd_texts())):
        got = rows(Q.op6_byte_shards(spark, SF) if df is None else shard_documents(df), "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
        raw = {i: (t or "").encode() for i, t in docs}
        assert {r[0]: r[1:3] for r in got} == {i: (len(b) + 8, zlib.crc32(b)) for i, b in raw.items()}
        assert {r[3] for r in got} == {"bytes"} and {r[6] for r in got} == {None} and all(0 <= r[4] < 24 for r in got)
        by = {}
        for r in got:
            by.setdefault(r[4], []).append(r)
        assert all(sorted(r[5] for r in own) == list(range(len(own))) for own in by.values())
        most, total = max(len(b) + 8 for b in raw.values()), sum(len(b) + 8 for b in raw.values())
        assert all(abs(sum(r[1] for r in own) - total / 24) <= most for own in by.values())
    assert shard_documents(none).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_packing(spark, given, odd, none, tokenizer):
    from stridelog.llm.packing import pack_documents

    for df, docs in ((None, given), (odd, odd_texts())):
        got = rows(Q.op7_best_fit(spark, SF) if df is None else pack_documents(df), "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
        assert sorted(r[:5] for r in got) == sorted(brute.pieces(docs, tokenizer))
        by = {}
        for r in got:
            by.setdefault(r[5], []).append((r[6], r[3]))
        for own in by.values():
            at = 0
            for offset, n in sorted(own):
                assert offset == at
                at += n
            assert at <= 4096
        assert len(by) <= 1.1 * sum(r[3] for r in got) / 4096 + 2
    assert pack_documents(none).count() == 0


def test_best_fit_closes_the_fullest():
    from stridelog.llm.packing import BestFit

    b = BestFit(10, 2)
    assert [b.place(n) for n in (6, 7, 3, 4, 9, 2, 1)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0), (3, 0), (2, 9)]


# ---------------------------------------------------------------- repeated strings


def test_repeats(spark, given, odd, none):
    from stridelog.llm.suffixes import remove_repeats

    for df, docs in ((None, given), (odd, odd_texts())):
        got = {r[0]: r[1:] for r in rows(Q.op8_bucket_pointers(spark, SF) if df is None else remove_repeats(df, crowd=2), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")}
        want = brute.repeats(docs)
        assert {i for i in want if got[i] != want[i]} == set()
    assert remove_repeats(none).count() == 0


def test_bucket_pointer_refinement():
    from stridelog.llm.suffixes import buckets

    r = random.Random(1)
    buffer = bytes(r.choice(b"ab") for _ in range(300)) * 2
    got = buckets(buffer, 100)
    first = {}
    for k in range(len(buffer) - 99):
        assert first.setdefault(buffer[k : k + 100], got[k]) == got[k]
    assert len(set(first.values())) == len(first)


# ---------------------------------------------------------------- personal data


def test_personal(spark, given, none):
    from stridelog.llm.pii import pii_digest, redact

    got = {r[0]: r[1:] for r in rows(Q.op9_bootstrapped_pii(spark, SF), "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")}
    for i, t in given:
        counts, sha, said = brute.personal(t)
        assert got[i][:5] == (*counts, sha) and set(said) <= set(got[i][5].split(","))
    hard = ["a@b a@b.c.d. x@y@z.w", "1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.4", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (555) 123-4567 +12 3", "é😀 q.r+s@t-u.vw", None, "", "++1 555 123 45678 4111111111111111."]
    df = spark.createDataFrame([(i, t, 0, "k") for i, t in enumerate(hard)], "doc_id long, text string, n_chars long, uid string")
    mine = {r[0]: r[1:] for r in rows(pii_digest(df), "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")}
    for i, t in enumerate(hard):
        counts, sha, _ = brute.personal(t)
        assert mine[i] == (*counts, sha), t
    clean = {r.doc_id: r for r in redact(df).collect()}
    assert redact(df).columns == df.columns and clean[5].text is None and "@" not in clean[4].text and clean[4].n_chars == len(clean[4].text)
    assert pii_digest(none).count() == 0


def test_bootstrapping_finds_unseen(spark):
    from stridelog.llm.pii import pii_digest

    seeds = [(i, f"please reach me under mail: user{i}@site{i}.org thanks") for i in range(12)]
    unseen = (99, "please reach me under mail: robin@localhost thanks")
    other = [(200 + i, f"the tag team{i}@home won again {i}") for i in range(5)]
    got = {r.doc_id: r.spans for r in pii_digest(spark.createDataFrame([*seeds, unseen, *other], "doc_id long, text string")).collect()}
    at = unseen[1].index("robin")
    assert got[99] == f"email:{at}:{at + len('robin@localhost')}" and all(got[200 + i] == "" for i in range(5))


# ---------------------------------------------------------------- benchmark passages


def test_contamination(spark, none):
    from stridelog.llm.decontaminate import contaminated, drop_contaminated, words

    item = " ".join(f"w{k}" for k in range(30))
    hurt = item.split()
    for k in (2, 7, 11, 16, 20, 27):
        hurt[k] = "sub"
    tests = spark.createDataFrame([(1, item), (2, "too short"), (3, None), (None, item), (4, " ".join(f"v{k}" for k in range(10)))], "item_id long, text string")
    docs = [(1, f"before {item} after"), (2, "x " + " ".join(hurt) + " y"), (3, " ".join(item.split()[:14])), (4, None), (5, ""), (6, "too short"), (7, "a " + " ".join(f"v{k}" for k in range(10)).upper()), (8, " ".join(reversed(item.split())))]
    df = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, matched int")

    def holds(t, q, window=20):
        a, b = words(t), words(q)
        n = min(window, len(b))
        return len(b) >= 8 and any(sum(x == y for x, y in zip(a[s : s + n], b[w : w + n], strict=True)) >= 0.8 * n for s in range(len(a) - n + 1) for w in range(len(b) - n + 1))

    want = {(d, i) for d, t in docs for i, q in ((1, item), (4, " ".join(f"v{k}" for k in range(10)))) if holds(t, q)}
    assert set(rows(contaminated(df, tests), "doc_id", "item_id")) == want == {(1, 1), (2, 1), (7, 4)}
    assert set(rows(contaminated(df, tests, block_chars=40), "doc_id", "item_id")) == want
    assert {r.doc_id for r in drop_contaminated(df, tests).collect()} == {3, 4, 5, 6, 8}
    assert contaminated(df.filter("false"), tests).count() == 0 and contaminated(df, tests.filter("false")).count() == 0
    table = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    given = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = set(rows(Q.op10_spaced_seeds(spark, SF), "doc_id", "item_id"))
    whole = {(d, r.item_id) for d, t in given for r in table if len(words(r.text)) >= 8 and " ".join(words(r.text)) in " ".join(words(t))}
    assert whole <= got


# ---------------------------------------------------------------- learned operators


def test_quality(spark, none, odd):
    from stridelog.llm.quality import classify, fit, select_documents

    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = docs.filter("doc_id % 3 = 0")
    table = spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in classify(docs, table.filter("doc_id % 3 <> 0")).collect()}
    known = [r.doc_id for r in held.collect() if r.doc_id in labels]
    right = sum(got[i].selected == (labels[i][0] == 1 and not labels[i][1]) for i in known)
    assert right / len(known) >= 0.75 and len(got) == docs.count()
    assert all(0 <= r.expected_grade <= 2 and 0 <= r.tail <= 1 for r in got.values())
    w, t = fit([(g, 1.0, np.array([0, 1], np.int32).tobytes(), np.array([1, g], np.float32).tobytes()) for g in (0, 1, 2) for _ in range(30)], 3)
    assert t[0] < t[1] and w[1] > 0
    assert classify(none, table).count() == 0 and classify(odd, table.filter("false")).filter("selected").count() == odd.count()
    assert select_documents(odd, table.filter("false")).columns == odd.columns


def test_secrets(spark, none):
    from pyspark.sql import functions as F

    from stridelog.llm import secrets as S

    found = S.example_findings(spark).cache()
    assert found.select("candidate", "left").distinct().count() > 4900
    # places and kinds that the forest has never seen
    for out in (F.col("place").isin("json", "digest_of"), F.col("kind").isin("letters", "uuid", "camel")):
        scored = S.classify(found.filter(out), S.train(found.filter(~out))).groupBy("label").agg(F.avg(((F.col("probability") >= 0.5) == (F.col("label") == 1)).cast("int")).alias("right")).collect()
        assert len(scored) == 2 and sum(r.right for r in scored) / 2 >= 0.85, scored
    planted = {(r.doc_id, m.start(1), m.end(1)) for r in spark.read.parquet(f"{WIDER}/documents.parquet").collect() for m in re.finditer(r'token = "([0-9a-f]{40})"', r.text or "")}
    said = rows(Q.op4_secret_forest(spark, WIDER).filter("is_secret"), "doc_id", "start", "end")
    assert planted and set(said) == planted and len(said) == len(set(said))
    texts = [(1, "é😀 set token = \"9f86d081884c7d659a2feaa0c55ad015a3bf4f1b\" and go", "src/a.py"), (2, "commit 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b by me", "CHANGELOG"), (3, None, None), (4, "", "x"), (5, "plain words only", "y")]
    df = spark.createDataFrame([(*t, 1) for t in texts], "doc_id long, text string, source string, start int")
    found = {r.doc_id: r for r in S.candidates(df).collect()}
    assert set(found) == {1, 2} and all(texts[i - 1][1][found[i].start : found[i].end] == found[i].candidate for i in found)
    got = {r.doc_id: r.is_secret for r in S.scan_secrets(df).collect()}
    assert got == {1: True, 2: False}
    assert S.scan_secrets(none).count() == 0


def bootstrap_by_hand(occ, least=3, trust=0.8, accept=0.9):
    """The graph of patterns and instances in plain Python: {instance: kind} accepted at the fixed point."""
    seed, shapes, at = {}, {}, {}
    for k, _, _, instance, own, patterns in occ:
        for p in patterns:
            at.setdefault(p, set()).add(instance)
            shapes[p, instance] = shapes.get((p, instance), 0) | own
            if k is not None:
                seed[p, instance] = min(k, seed.get((p, instance), 9))
    at = {p: own for p, own in at.items() if len(own) >= least}
    found = {}
    while True:
        score = {}
        for p, own in at.items():
            label = {i: seed.get((p, i), found.get(i)) for i in own}
            for k in range(4):
                n = sum(v == k for v in label.values())
                if n >= least and n >= trust * len(own):
                    for i in own:
                        if label[i] is None and shapes[p, i] >> k & 1:
                            score[i, k] = score.get((i, k), 1.0) * (1 - n / (len(own) + 1))
        new = {}
        for (i, k), miss in sorted(score.items()):
            if 1 - miss >= accept - 1e-12 and (i not in new or 1 - miss > new[i][0]):
                new[i] = (1 - miss, k)
        if not new:
            return found
        found |= {i: k for i, (_, k) in new.items()}


def test_bootstrapping_against_a_plain_graph(spark):
    """Chains of patterns (each round's finds support the next round's pattern), long tokens and spaced groups, against the plain graph."""
    from stridelog.llm.pii import base_spans, bootstrap, occurrences, scan

    texts = [f"please write to: user{i}@site{i}.org thanks a lot" for i in range(40)]
    texts += [f"please write to: agent{i}@intra thanks a lot" for i in range(8)]
    texts += [f"you can find agent{i}@intra there" for i in range(8)] + [f"you can find clerk@{'desk' * n} there" for n in (1, 30)]
    texts += [f"ring my phone: +1 555 01{i:02d} 4567 now" for i in range(14)] + [f"ring my phone: 020 7946 0{i:02d}1 now" for i in range(3)]
    texts += ["", None, "the score was 12@home 3"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    occ = [o for t in texts for o in occurrences(t or "", base_spans(t or ""))]
    want = bootstrap_by_hand(occ)
    got = {r.instance: r.kind for r in bootstrap(scan(df)).collect()}
    assert got == want
    assert {"agent3@intra", "clerk@desk", "02079460021"} <= set(got) and any(i.startswith("#") for i in got)


def test_shared_preambles_and_blocks(spark):
    """Many items that share a hot seed, substitutions of up to a fifth, and texts just below the bound, against brute force."""
    from stridelog.llm.decontaminate import contaminated, words

    r = random.Random(8)
    head = [f"p{k}" for k in range(9)]
    items = [(k, " ".join([*head, *(f"i{k}x{j}" for j in range(16))])) for k in range(40)]
    docs = []
    for d in range(60):
        w = items[d % 40][1].split()
        for k in r.sample(range(len(w)), d % 9):
            w[k] = "sub"
        docs.append((d, " ".join([*(f"f{d}y{j}" for j in range(d % 4)), *w, "end"])))
    want = set()
    for d, t in docs:
        a = words(t)
        for i, q in items:
            b = words(q)
            if any(sum(x == y for x, y in zip(a[s : s + 20], b[w : w + 20], strict=True)) >= 16 for s in range(len(a) - 19) for w in range(len(b) - 19)):
                want.add((d, i))
    tests = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert 20 < len(want) < 60
    assert set(rows(contaminated(df, tests), "doc_id", "item_id")) == want
    assert set(rows(contaminated(df, tests, block_chars=1500), "doc_id", "item_id")) == want


def test_other_tokenizers_encode_whole_texts(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    from stridelog.llm.packing import IdBytes, default_vocabulary, token_pieces

    t = Tokenizer(models.WordLevel({"[U]": 0, "a b": 5, "a": 1, "b": 2, "A": 3}, unk_token="[U]"))
    t.pre_tokenizer = pre_tokenizers.Split(",", "removed")
    assert IdBytes(default_vocabulary()).by_run and not IdBytes(t.to_str()).by_run
    got = token_pieces(spark.createDataFrame([(1, "a b,A,a"), (2, None)], "doc_id long, text string"), t.to_str()).collect()
    ids = np.array(t.encode("a b,A,a", add_special_tokens=False).ids + [1], "<u4")
    assert ids.tolist() == [5, 3, 1, 1] and {r.doc_id: (r.length, r.ids_crc32) for r in got}[1] == (4, zlib.crc32(ids.tobytes()))
