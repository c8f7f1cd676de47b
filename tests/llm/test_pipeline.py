"""The near-duplicate decision row by row, and the pipeline's run() and stages on the given and on odd tables."""

import os
import random

import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
WORDS = "harbor lantern meadow copper violet thunder orchard ribbon saddle tunnel walnut zephyr basket cradle dagger ember falcon garnet hollow island".split()


def say(seed, n=60):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def near(text):
    w = text.split()
    w[len(w) // 2] = "altered"
    return " ".join(w)


@pytest.mark.parametrize("name", ["near_components", "similar_components"])
def test_rows_are_judged_by_id_and_text(spark, name):
    from stridelog.llm import similar, simhash

    groups = getattr(simhash, name, None) or getattr(similar, name)
    a, b, c, d, e, f = (say(k) for k in range(6))
    data = [(1, a), (5, a), (5, b), (7, c), (7, d), (None, a), (None, e), (None, e), (8, f), (8, f), (9, f), (None, b), (3, None), (4, ""), (None, None)]
    df = spark.createDataFrame([(*x, 0, "k", k) for k, x in enumerate(data)], "doc_id long, text string, _d int, _h string, root int")
    kept = simhash.keep_one(df, groups)
    assert kept.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(1, a), (5, b), (7, c), (7, d), (None, e), (8, f), (3, None)], key=str)
    assert simhash.keep_one(df.filter("false"), groups).count() == 0


def test_groups_without_ids_and_with_repeats(spark):
    """Every group keeps exactly one row, whatever repeats."""
    from stridelog.llm.simhash import keep_one
    from stridelog.llm.similar import similar_components

    r, data = random.Random(4), []
    for k in range(12):
        text = say(100 + k, 80)
        data += [(r.choice([None, 2, 3, k]), r.choice([text, near(text)])) for _ in range(9)]
    kept = keep_one(spark.createDataFrame(data, "doc_id int, text string"), similar_components).collect()
    assert len(kept) == 12


@pytest.fixture
def folder(spark, tmp_path):
    bad, good = "zz qq xx " * 30, [say(k, 120) for k in range(60)]
    leak = say(999, 40)
    docs = [(k, t, "en", "web", len(t)) for k, t in enumerate(good)]
    docs += [(100, near(good[0]), "en", "web", 1), (101, good[1], "en", "web", 1), (102, f"{good[2][:300]} {leak} {say(55, 20)}", "en", "web", 1), (103, f"{say(77, 80)} mail kim.lo@site.org or call +1 555 123 4567", "en", "web", 1), (104, None, "en", None, None), (105, "", None, "web", 0), (None, say(88, 90), "en", "web", 1)]
    docs += [(200 + k, bad + str(k), "en", "web", 1) for k in range(20)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(k, 1, 0) for k in range(0, 60, 2)] + [(200 + k, 0, 0) for k in range(0, 20, 2)] + [(201, None, None), (None, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), docs


def test_run_and_its_stages(spark, folder):
    from corpus_pipeline import STAGES, run
    from stridelog.llm.common import materialize

    sf, docs = folder
    assert [n for n, _ in STAGES] == ["quality", "near_dedup", "decontaminate", "pii", "pack"]
    at, seen = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in STAGES:
        before = at.columns
        at = materialize(stage(spark, at, sf), f"test-{name}")
        assert name == "pack" or at.columns == before
        seen[name] = {r.doc_id: r for r in at.collect()}
    assert not any(i in seen["quality"] for i in range(200, 220)) and all(k in seen["quality"] for k in range(60))
    gone = set(seen["quality"]) - set(seen["near_dedup"])
    assert gone - {104, 105} == {100, 101}
    assert set(seen["near_dedup"]) - set(seen["decontaminate"]) == {102}
    changed = {i for i, r in seen["pii"].items() if r.text != seen["decontaminate"][i].text}
    assert changed == {103} and "kim.lo" not in seen["pii"][103].text and seen["pii"][103].n_chars == len(seen["pii"][103].text)
    whole = sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.ids_crc32) for r in run(spark, sf).collect())
    assert whole == sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.ids_crc32) for r in at.collect())
    assert {(i or -1) for _, i, *_ in whole} >= {-1, *range(1, 60)} - {0}


def test_given_near_dedup_against_brute_force(spark):
    from corpus_pipeline import near_dedup
    from test_similar import groups

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted(set(groups([(r.doc_id, r.text) for r in docs.collect()]).values()))
    assert sorted(r.doc_id for r in near_dedup(spark, docs, SF).collect()) == want
