"""The pipeline's near-duplicate stage against brute-force Jaccard similarity of five-word shingles."""

import random

import pytest

WORDS = [f"{a}{b}" for a in "ba ce di fo gu ha je ki lo mu".split() for b in "ran ston vel mir dak pon".split()]


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 5 else {tuple(w)} if w else set()


def groups(texts):
    """{id: smallest id reachable over pairs at 0.8 or more}"""
    own, up = {i: grams(t) for i, t in texts}, {i: i for i, _ in texts}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in up:
        for b in up:
            if a < b and (own[a] == own[b] or 5 * len(own[a] & own[b]) >= 4 * len(own[a] | own[b])):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: root(i) for i in up}


@pytest.fixture(scope="module")
def texts():
    r = random.Random(11)
    out = [None, "", " \n", "one", "One", "one two three", "one two three four five", "one two three four five six"]
    for _ in range(25):
        base = [r.choice(WORDS) for _ in range(r.choice((12, 40, 120, 200)))]
        out.append(" ".join(base))
        for _ in range(3):  # similarities about 0.7 to 0.97
            copy = list(base)
            for k in r.sample(range(len(base)), max(1, len(base) * r.randint(1, 5) // 200)):
                copy[k] = "changed"
            out.append(" ".join(copy[: len(copy) - r.randint(0, len(copy) // 8)]))
    chain = [r.choice(WORDS) for _ in range(60)]
    for _ in range(40):  # neighbours alike, ends not
        out.append(" ".join(chain))
        chain[r.randrange(60)] = r.choice(WORDS)
    hot = [r.choice(WORDS) for _ in range(100)]
    out += [" ".join(["lead", str(k), *hot[: 100 - k % 3]]) for k in range(30)]
    return list(enumerate(out))


def near(texts, groups):
    own = [(i, grams(t)) for i, t in texts]
    return [(i, j) for i, a in own for j, b in own if i < j and a != b and 5 * len(a & b) >= 4 * len(a | b)]


def test_similar_groups(spark, texts):
    from stridelog.llm.similar import similar_components

    df, want = spark.createDataFrame(texts, "doc_id long, text string"), groups(texts)
    pairs = near(texts, want)
    assert len(pairs) > 300
    for bucket in (64, 4):
        got = {r.doc_id: r.component_id for r in similar_components(df, bucket).collect()}
        assert sum(got[i] == got[j] for i, j in pairs) == len(pairs)
        assert got == want
    assert similar_components(df.filter("false")).count() == 0


def test_stage_keeps_one_of_near_copies(spark, texts):
    from corpus_pipeline import near_dedup

    rows = spark.createDataFrame([(i, t, "en") for i, t in texts], "doc_id long, text string, lang string")
    kept = near_dedup(spark, rows, "")
    assert kept.columns == rows.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(groups(texts).values()))


def test_sketches_never_differ_in_more_bits_than_sets_in_shingles():
    from stridelog.llm.similar import shingles, sketch

    r = random.Random(5)
    none = shingles("")
    for size in (1, 30, 400, 5000):
        for changed in (0, 1, size // 20, size // 2):
            words = [r.choice(WORDS) for _ in range(size)]
            a = shingles(" ".join(words))
            for k in r.sample(range(size), changed):
                words[k] = "changed"
            b = shingles(" ".join(words))
            for x, y in ((a, b), (a, none), (a, a)):
                for longs in (4, 64):
                    bits = sum(int(v).bit_count() for v in (sketch(x, longs) ^ sketch(y, longs)).view("uint64"))
                    assert bits <= len(set(x.tolist()) ^ set(y.tolist()))


def test_ranges_are_counted_over_all_texts(spark):
    from stridelog.llm.similar import _range, prefix, range_counts, shingles

    r = random.Random(9)
    data = [None, "", *(" ".join(r.choices(WORDS, k=r.randint(1, 12))) for _ in range(20_000)), *["one text that is very frequent here"] * 3000]
    got, want = range_counts(spark.createDataFrame([(t,) for t in data], "text string").repartition(5), 14), [0] * (1 << 14)
    for t in data:
        for k in _range(shingles(t or ""), 14):
            want[k] += 1
    assert got.tolist() == want
    frequent, mixed = shingles("one text that is very frequent here"), shingles("one text that is very frequent here as nowhere else in all of them")
    assert not set(prefix(mixed, got).tolist()) & set(frequent.tolist())
    assert not range_counts(spark.createDataFrame([], "text string"), 3).any()


def test_texts_are_compared_where_they_lie(spark):
    """Less is shuffled than the texts have, though most are compared; the filter loses no key and its size is bounded."""
    import numpy as np
    from stridelog.llm.similar import bloom, may_hold, similar_components

    r, data = random.Random(3), []
    for _ in range(60):
        base = [f"{r.getrandbits(240):060x}" for _ in range(600)]
        data += [" ".join(base), " ".join([*base[:300], "changed", *base[301:]]), " ".join(base)]
    texts = spark.createDataFrame(list(enumerate(data)), "doc_id long, text string")
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = lambda: {s.stageId(): s.shuffleWriteBytes() for s in (lambda x: [x.apply(k) for k in range(x.size())])(store.stageList(None, False, False, none, spark.sparkContext._jvm.java.util.ArrayList()))}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        last = max(stages(), default=-1)
        got = similar_components(texts)
        written = sum(n for k, n in stages().items() if k > last)
        assert {x.doc_id: x.component_id for x in got.collect()} == {k: k // 3 * 3 for k in range(len(data))}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert written < sum(map(len, data)), written
    keys = [r.getrandbits(64) - (1 << 63) for _ in range(5000)]
    for most in (1 << 26, 1 << 12):
        words = bloom(spark.createDataFrame([(k,) for k in keys], "h long"), most)
        assert 64 * len(words) <= most and may_hold(words, np.array(keys)).all()
    other = np.array([r.getrandbits(64) - (1 << 63) for _ in range(5000)])
    assert may_hold(bloom(spark.createDataFrame([(k,) for k in keys], "h long")), other).mean() < 0.03
    assert not may_hold(bloom(spark.createDataFrame([], "h long")), other).any()


@pytest.mark.parametrize("bits", [1 << 26, 64])
def test_texts_that_stay_are_not_moved(spark, monkeypatch, bits):
    """Rows that no copy touches keep their texts where they lie; a filter that lets everything through gives the same rows."""
    from stridelog.llm import simhash

    r, none = random.Random(8), [(None, None), (None, ""), (7, None)]
    alone = [(k, f"{r.getrandbits(8000):02000x}") for k in range(1000, 1600)]
    again = [(k, f"{r.getrandbits(8000):02000x}") for k in range(20)]
    data = [*alone, *again, *((k + 100, t) for k, t in again), *again[:3], (None, again[0][1]), (1000, again[5][1]), *none]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    plain = simhash.bloom
    monkeypatch.setattr(simhash, "bloom", lambda keys: plain(keys, bits))
    store, sizes = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = lambda: {s.stageId(): s.shuffleWriteBytes() for s in (lambda x: [x.apply(k) for k in range(x.size())])(store.stageList(None, False, False, sizes, spark.sparkContext._jvm.java.util.ArrayList()))}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = simhash.materialize(df, "docs")
        kept = simhash.keep_one(docs, lambda x: x.select("doc_id", simhash.F.xxhash64("text").alias("h"), simhash.F.xxhash64(simhash.F.coalesce("text", simhash.F.lit(""))).alias("root")))
        last = max(stages(), default=-1)
        got = kept.collect()
        written = sum(n for k, n in stages().items() if k > last)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want = [*alone, *again, (7, None)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bits == 64 or written < sum(len(t) for _, t in alone) / 4, written
