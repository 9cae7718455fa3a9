"""Micro-fixtures of the column functions and the sequential operators."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexloom.functions import legal
from lexloom.functions import text as tx
from lexloom.operators import metrics, quality, ranking, splits, structure
from lexloom.sources import exams


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize("raw,vnd", [("2.090.000", 2090000), ("2.0", 2000000), ("6.5", 6000000), ("1,5", 1000000), ("18", 18000), ("400000", 400000), ("100.50", 100000), ("1.2345", 12345000), ("200.", 200000), ("", 0), ("abc", 0)])
def test_vnd(spark, raw, vnd):
    assert one(spark, legal.vnd(F.col("a")), a=raw) == vnd


@pytest.mark.parametrize("pred,hit", [("phạt tiền từ 6001000 đồng đến 8000000 đồng", True), ("phạt tiền từ 7000000 đồng đến 8000000 đồng", False), ("phạt 5 triệu đồng", True), ("không rõ", False)])
def test_fine_match(spark, pred, hit):
    assert one(spark, legal.fine_matches(F.lit("4.000.000"), F.lit("6.000.000"), F.col("a")), a=pred) is hit
    assert one(spark, legal.fine_matches(F.lit(""), F.lit(""), F.col("a")), a=pred) is False


def test_fine_match_takes_the_tolerance_in_floating_point(spark):
    assert 400_000 * 1.15 < 460_000
    for said, hit in (("phạt tiền từ 460.000 đồng đến 560.000 đồng", False), ("phạt tiền từ 459.000 đồng đến 559.000 đồng", True)):
        assert one(spark, legal.fine_matches(F.lit("400.000"), F.lit(""), F.col("a")), a=said) is hit


def test_fine_match_with_a_decimal_tolerance_is_exact(spark):
    from decimal import Decimal

    for said, hit in (("phạt tiền từ 460.000 đồng đến 560.000 đồng", True), ("phạt tiền từ 461.000 đồng đến 561.000 đồng", False), ("phạt tiền từ 200.000 đồng đến 340.000 đồng", True), ("phạt tiền từ 200.000 đồng đến 339.000 đồng", False)):
        assert one(spark, legal.fine_matches(F.lit("400.000"), F.lit(""), F.col("a"), Decimal("0.15")), a=said) is hit


def test_fine_match_without_a_maximum(spark):
    said = "phạt tiền từ 400.000 đồng đến 600.000 đồng"
    for high in (None, "", "400.000"):
        assert one(spark, legal.fine_matches(F.lit("400.000"), F.col("h"), F.col("a")), a=said, h=high) is True
    assert one(spark, legal.fine_matches(F.lit("200"), F.col("h"), F.col("a")), a=said, h=None) is False  # gold is read as it stands


def test_expand(spark):
    assert one(spark, tx.expand(F.col("a"), legal.QUERY_EXPANSIONS), a="GPLX là gì") == "GPLX là gì giấy phép lái xe"
    assert one(spark, tx.expand(F.col("a"), legal.QUERY_EXPANSIONS), a="gplx giấy phép lái xe") == "gplx giấy phép lái xe"


def test_normalize_and_clip(spark):
    assert one(spark, tx.normalize(F.col("a")), a=" a\t b\r\n\r\n\r\n\rc ") == "a b\n\nc"
    assert one(spark, tx.clip(F.col("a"), 7), a="abc defg hij") == "abc ..."
    assert one(spark, tx.clip(F.col("a"), 70), a="abc") == "abc"


@pytest.mark.parametrize("p,r,f", [("a a b", "a b c", 2 / 3), ("a a a", "a", 0.5), ("", "", 1.0), ("", "x", 0.0)])
def test_token_f1(spark, p, r, f):
    assert one(spark, metrics.token_f1(tx.tokens(F.col("p")), tx.tokens(F.col("r"))), p=p, r=r) == pytest.approx(f)


def test_aliases(spark):
    found = one(spark, legal.aliases(F.col("a"), F.lit("")), a="tt_65_2024_tt_bca")
    assert {"65/2024", "65-2024", "thông tư 65"} <= set(found)


def test_chunks_short_and_long_clause(spark):
    text = "Mở đầu.\nĐiều 1. Phạm vi\nNội dung.\nĐiều 2. Đối tượng\nDẫn nhập.\n1. Khoản một.\n2. Khoản hai {}\na) điểm a;\nb) điểm b."
    docs = spark.createDataFrame([(1, text.format("y" * 400)), (2, text.format(""))], "doc_id long, text string")
    n = {r.doc_id: r["count"] for r in structure.chunks(docs).groupBy("doc_id").count().collect()}
    units = {r.doc_id: r["count"] for r in structure.legal_units(docs).groupBy("doc_id").count().collect()}
    assert n == {1: 7, 2: 5} and units == {1: 6, 2: 6}


def test_quality_gate_order(spark):
    w = "w" * 150
    rows = [(0, "x" * 149), (1, "dự thảo" + "y" * 143), (2, "z" * 2001), (3, w), (4, w), (5, f" {w} ")]
    out = quality.quality_gate(spark.createDataFrame(rows, "pos long, text string"), ["pos"], ["dự thảo"])
    assert {r.pos: r.reason for r in out.collect()} == {0: "short", 1: "legacy", 2: "long", 3: "keep", 4: "dup", 5: "dup"}


def test_quality_gate_leaves_copies_that_fail_an_earlier_gate(spark):
    rows = [(0, "x"), (1, "x"), (2, "z" * 2001), (3, "z" * 2001), (4, None), (5, None)]
    out = quality.quality_gate(spark.createDataFrame(rows, "pos long, text string"), ["pos"], ["dự thảo"])
    got = {r.pos: r.reason for r in out.collect()}
    assert [got[i] for i in range(4)] == ["short", "short", "long", "long"] and len(got) == 6


def test_rrf(spark):
    lists = {"dense": (["a", "b", "c"], 0.6), "bm25": (["b", "d"], 0.4)}
    dfs = [(spark.createDataFrame([(1, d, i + 1) for i, d in enumerate(x)], "query_id long, doc string, rank long"), n, w) for n, (x, w) in lists.items()]
    for order in (dfs, dfs[::-1]):
        got = {r.doc: r.score for r in ranking.rrf(order).collect()}
        assert got == {"b": 0.0162348, "a": 0.00983607, "c": 0.00952381, "d": 0.00645161}


def test_exam_parsing(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"questions": [{"STT": 1, "Cau_hoi": "Câu hỏi dài?", "chon_a": "a", "chon_b": "b", "chon_c": "c", "chon_d": "d", "dap_an": "2"}, {"STT": 2, "Cau_hoi": "?", "chon_a": "a", "dap_an": "9"}]}')
    got = exams.parse_exam(exams.read_exam(spark, str(tmp_path / "x.json"))).collect()
    assert [(r.id, r.answer, len(r.choices)) for r in got] == [("1", "B", 4)]
    assert {r.id for r in exams.excluded(spark, "5,25->28").collect()} == {5, 25, 26, 27, 28}


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.text("abc", min_size=1, max_size=4), st.integers(1, 50), min_size=1))
def test_groups_never_straddle(sizes):
    out = splits.assign_groups(sizes)
    assert set(out) == set(sizes) and set(out.values()) <= {"train", "dev", "test"}


@settings(max_examples=50, deadline=None)
@given(st.text("ab \nĐiều1.", max_size=300), st.integers(20, 60))
def test_recursive_split_bounds(text, size):
    parts = structure.split_recursive(text, size, 5)
    assert all(0 < len(p) <= size for p in parts)
    assert set("".join(text.split())) == set("".join("".join(parts).split()))


def test_stream_append_is_idempotent(spark, tmp_path):
    from lexloom.streaming import events as ev

    src, target = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(50)
    for _ in range(2):
        rows.write.mode("append").parquet(src)
    for k in range(2):
        ev.append_new(ev.read_events(spark, src), "event_id", target, str(tmp_path / f"cp{k}")).awaitTermination(60)
    assert spark.read.parquet(target).count() == rows.select("event_id").distinct().count()


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old, row = row, [0]
        for j, y in enumerate(b):
            row.append(old[j] + 1 if x == y else max(old[j + 1], row[-1]))
    return row[-1]


def test_rouge_l_scores_whole_texts(spark):
    from lexloom.plans import QUERIES
    from lexloom.plans.metrics import rouge_pairs

    data = "/root/testdata/sf0.001"
    rows = {(r.conv_id, r.turn): (r.p, r.r) for r in rouge_pairs(spark, data).collect()}
    got = {(r.conv_id, r.turn): r.rouge_l for r in QUERIES["rouge_l"](spark, data).collect()}
    assert set(got) == set(rows) and any(len(p) > 40 and len(r) > 40 for p, r in rows.values())
    for key, (p, r) in rows.items():
        n = plain_lcs(p, r)
        assert abs(got[key] - (2 * n / (len(p) + len(r)) if n else 0)) < 1e-6


def test_context_recall_minds_word_order(spark):
    from lexloom.plans import QUERIES
    from lexloom.plans.metrics import rouge_pairs

    data, by_conv = "/root/testdata/sf0.001", {}
    for r in rouge_pairs(spark, data).collect():
        by_conv.setdefault(r.conv_id, []).append((r.p, r.r))
    f = lambda p, r: 2 * plain_lcs(p, r) / (len(p) + len(r)) if p and r else 0
    got = {r.conv_id: r for r in QUERIES["context_recall"](spark, data).collect()}
    assert set(got) == set(by_conv)
    for c, turns in by_conv.items():
        best = max(f(p, r) for p, _ in turns for _, r in turns)
        assert abs(got[c].best - best) < 1e-6 and got[c].hit == (best >= 0.5)
