"""The pipeline's stages, one by one, against what their operators decide, on a small table and on awkward ones."""

from collections import Counter

import pytest

import corpus_pipeline
from lexloom.llm import language_id, ngram_join

DATA = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)
NAMES = list(STAGES)


def test_stages(spark, tmp_path):
    docs, kept = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append({(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()} if k < 4 else None)
    assert kept[1] <= kept[0] and kept[2] <= kept[1] and kept[3] <= kept[2]
    assert len({t for _, t in kept[1]}) == len(kept[1]) and {t for _, t in kept[1]} == {t for _, t in kept[0]}
    sets = [ngram_join.shingles(t) for _, t in kept[2]]
    assert not any(a and b and len(a & b) >= 0.8 * len(a | b) for i, a in enumerate(sets) for b in sets[i + 1 :])
    assert docs.count() and docs.groupBy("sequence_id").sum("length").filter("`sum(length)` > 1024").isEmpty()


def test_run_leaves_only_its_last_table(spark, tmp_path):
    from pathlib import Path

    from lexloom.llm.common import shared_dir

    at = Path(shared_dir(spark).removeprefix("file://"))
    before = set(at.iterdir()) if at.exists() else set()
    out = corpus_pipeline.run(spark, DATA)
    assert out.count() and len(set(at.iterdir()) - before) == 1


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, key string, copy int, _row string"
BASE = "the quick brown fox jumps over the lazy dog while many other words follow in the same old order of things"
ROWS = [
    (1, "a a a", "en", "a"),
    (1, "b b b", "en", "a"),
    (2, "a a a", "en", None),
    (2, "a a a", "en", None),
    (None, BASE, "en", "a"),
    (None, BASE, "en", "a"),
    (None, None, None, None),
    (None, "", None, "b"),
    (5, BASE + " end", "en", "b"),
    (6, "word " * 30_000, "en", "b"),
    (7, "12 34", "en", "b"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(*r, i % 3, "?", "?", 1, "?") for i, r in enumerate(ROWS)], SCHEMA)


@pytest.mark.parametrize("name", NAMES)
def test_empty_and_awkward_tables(spark, awkward, name):
    none = STAGES[name](spark, awkward.limit(0), DATA)
    some = STAGES[name](spark, awkward, DATA)
    assert none.count() == 0
    if name != "packing":
        assert some.schema == awkward.schema and {tuple(r) for r in some.collect()} <= {tuple(r) for r in awkward.collect()}
    else:
        assert some.filter("start = 0").count() == len(ROWS)


def test_language_judges_each_row(spark, awkward):
    got = Counter(tuple(r) for r in STAGES["language ID"](spark, awkward, DATA).collect())
    assert all(any(map(str.isalpha, r[1] or "")) for r in got)
    decided = {(r.doc_id, r.rejected) for r in language_id.identify_language(awkward).collect()}
    assert {r[0] for r in got} == {i for i, rejected in decided if not rejected}


def test_dedup_leaves_one_row_of_a_text(spark, awkward):
    got = Counter((r.doc_id, r.text or "") for r in STAGES["exact dedup"](spark, awkward, DATA).collect())
    assert got == Counter([(2, "a a a"), (1, "b b b"), (None, BASE), (None, ""), (5, BASE + " end"), (6, "word " * 30_000), (7, "12 34")])


def test_near_dedup_leaves_one_row_of_a_class(spark, awkward):
    got = Counter((r.doc_id, r.text or "") for r in STAGES["n-gram Jaccard join"](spark, awkward, DATA).collect())
    assert got == Counter([(1, "a a a"), (1, "b b b"), (None, ""), (5, BASE + " end"), (6, "word " * 30_000), (7, "12 34")])


def test_mix_is_the_same_again(spark, awkward):
    mix = STAGES["mixing sources to target weights"]
    rows = [Counter(tuple(r) for r in mix(spark, x, DATA).collect()) for x in (awkward, awkward.repartition(5))]
    assert rows[0] == rows[1] and rows[0] and all(r[1].split() for r in rows[0])
