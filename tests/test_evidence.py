"""Retrieval, evidence, generation and sources against plain versions on small fixtures."""

import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexloom import pipeline
from lexloom.functions import legal
from lexloom.functions import text as tx
from lexloom.operators import evidence, generate, metrics, ordinal, search, splits, structure
from lexloom.sources import evalsets, exams, reports, web


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


CHUNKS = [(f"c{i}", i // 5, str(i % 5 // 2 + 1) if i % 5 else None, i, t) for i, t in enumerate(["mở đầu một", "xe máy vượt đèn đỏ phạt tiền", "xe máy", "ô tô", "đèn đỏ", "nghị định khác", "xe đạp đèn", "mô tô", "vượt đèn đỏ", "phạt"])]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(CHUNKS, "doc string, doc_id long, article_number string, ord long, text string")


def test_bm25_gives_k_rows_even_without_shared_words(spark, chunks):
    q = spark.createDataFrame([(1, "đèn đỏ đỏ"), (2, "zzz"), (3, ""), (4, None)], "query_id long, question string")
    got = search.Bm25(chunks, "doc").search(q, 4).collect()
    words = {c[0]: c[4].lower().split() for c in CHUNKS}
    n, mean = len(words), sum(map(len, words.values())) / len(words)
    df = Counter(t for w in words.values() for t in set(w))
    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    idf = {t: r if r >= 0 else 0.25 * sum(raw.values()) / len(raw) for t, r in raw.items()}

    def score(q, w):
        return round(sum(idf.get(t, 0) * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / mean)) for t in q if t in w), 6)

    for i, text in ((1, "đèn đỏ đỏ"), (2, "zzz")):
        want = sorted(((-score(text.split(), w), c) for c, w in words.items()))[:4]
        assert [(-r.score, r.doc) for r in sorted((r for r in got if r.query_id == i), key=lambda r: r.rank)] == [(pytest.approx(s, abs=2e-6), c) for s, c in want]
    assert {r.query_id for r in got} == {1, 2}
    assert search.Bm25(chunks, "doc").search(q.limit(0), 4).count() == 0 and search.Bm25(chunks.limit(0), "doc").search(q, 4).count() == 0
    pairs = spark.createDataFrame([(1, "c1"), (1, "c0"), (2, "c2")], "query_id long, doc string")
    assert {(r.query_id, r.doc): r.score for r in search.Bm25(chunks, "doc").score_pairs(pairs, q).collect()} == {(1, "c1"): pytest.approx(score("đèn đỏ đỏ".split(), words["c1"]), abs=2e-6), (1, "c0"): 0.0, (2, "c2"): 0.0}


def test_vector_top_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "MOST_QUERIES", 3)
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(200)] + [(900, None), (901, [1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = search.vector_top(v, v.filter("vec_id < 10").withColumnRenamed("vec_id", "query_id"), 4).collect()
    for q in range(10):
        dots = sorted((-round(sum(a * b for a, b in zip(rows[q][1], e)), 5), i) for i, e in rows[:200])[:4]
        assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [(pytest.approx(s), i) for s, i in dots]


def test_containing_and_holding_against_loops(spark):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choices("ab c", k=n))
    questions, phrases = [(i, text(12)) for i in range(30)], [(i, text(rng.randrange(1, 4))) for i in range(20)]
    q, p = spark.createDataFrame(questions, "query_id long, question string"), spark.createDataFrame(phrases, "doc long, alias string")
    assert {tuple(r) for r in search.containing(q, p).select("query_id", "doc").collect()} == {(i, k) for i, t in questions for k, a in phrases if a and a in t}
    words = lambda n: " ".join(rng.choices(["x", "yy", "z"], k=n))
    rows, passages = [(i, words(rng.randrange(0, 30))) for i in range(40)], [(i, words(rng.randrange(1, 8))) for i in range(30)] + [(99, " yy z "), (98, "")]
    found = search.holding(spark.createDataFrame(rows, "doc long, text string"), spark.createDataFrame(passages, "query_id long, passage string"))
    assert {tuple(r) for r in found.select("query_id", "doc").collect()} == {(i, k) for i, t in passages for k, d in rows if t and t in d}


def test_holding_over_long_texts_is_linear(spark):
    import time

    long = " ".join(f"w{i}" for i in range(60_000))
    rows = spark.createDataFrame([(i, f"{i} {long} end{i}") for i in range(4)] + [(9, None)], "doc long, text string")
    passages = spark.createDataFrame([(1, "w5 w6 w7 w8"), (1, "w59999 end2"), (2, "w8 w7 w6"), (3, "59998 w59999 end3"), (4, "w1 w2 w3\n")], "query_id int, passage string")
    began = time.perf_counter()
    found = sorted(tuple(r) for r in search.holding(rows, passages).collect())
    assert found == [(1, 0), (1, 1), (1, 2), (1, 2), (1, 3), (3, 3)] and time.perf_counter() - began < 20


def test_diagnostics_read_the_gold_once(spark):
    from lexloom.plans.retrieval import retrieval_diagnostics

    plan = retrieval_diagnostics(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2  # a pass for the search and one for the passages


def test_chunk_ids_of_seven_digits_as_in_the_sql(spark, monkeypatch):
    import duckdb

    from lexloom.plans import kb

    ordinals = [0, 999_999, 1_000_000, 1_234_567]
    rows = spark.createDataFrame([(7, f"7:{o:06d}", o, "t") for o in ordinals], "doc_id long, doc string, ord long, text string")
    monkeypatch.setattr(kb, "build", lambda spark, sf_dir: rows)
    want = [duckdb.sql(f"SELECT concat(7, ':', lpad(({o})::varchar, 6, '0'))").fetchall()[0][0] for o in ordinals]
    assert sorted(r.chunk_id for r in kb.chunk_ids(spark, "").collect()) == sorted(want)


def test_bm25_of_pairs_reads_the_texts_twice_at_most(spark, chunks):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(t):
        read.add(1)
        return t

    q = spark.createDataFrame([(1, "đèn đỏ")], "query_id long, question string")
    pairs = spark.createDataFrame([(1, "c1")], "query_id long, doc string")
    assert search.Bm25(chunks.withColumn("text", seen.asNondeterministic()("text")), "doc").score_pairs(pairs, q).count() == 1
    assert read.value <= 2 * len(CHUNKS)


def test_retrieval_settings(spark):
    spark.conf.set("lexloom.retrieval.fuse_k", "7")
    spark.conf.set("lexloom.retrieval.w_dense", "much")
    spark.conf.set("lexloom.retrieval.use_window", "off")
    try:
        assert search.Retrieval.of(spark) == search.Retrieval(fuse_k=7)
    finally:
        for k in ("fuse_k", "w_dense", "use_window"):
            spark.conf.unset(f"lexloom.retrieval.{k}")


def test_units_fall_back_to_all(spark):
    units = structure.legal_units(spark.createDataFrame([(1, "Điều 1. Đèn\n1. Vượt đèn đỏ\na) xe máy;\nb) ô tô."), (2, "Điều 1. Mũ\nkhông đội mũ"), *[(i, f"Điều 1. Khác\nviệc {i} của cơ quan {i}") for i in range(3, 12)]], "doc_id long, text string"))
    q = spark.createDataFrame([(1, "xe máy"), (2, "mũ")], "query_id long, question string")
    seeds = spark.createDataFrame([(1, 1, "1"), (2, 2, "1")], "query_id long, doc_id long, article_number string")
    got = {(r.query_id, r.rank): r.unit_id for r in search.retrieve_units(units, q, seeds, 2).collect()}
    assert {got[1, 1], got[1, 2]} == {"1::article::1::clause::1", "1::article::1::clause::1::point::a"} and got[2, 1] == "2::article::1" and len(got) == 4


def test_window_widens_only_where_asked_or_voted(spark, chunks):
    q = spark.createDataFrame([(1, "theo Điều 2"), (2, "không rõ")], "query_id long, question string")
    seeds = spark.createDataFrame([(1, "c2", 1), (1, "c4", 2), (2, "c3", 1), (2, "c0", 2)], "query_id long, doc string, rank long")
    got = [(r.query_id, r.doc) for r in search.window(seeds, chunks, q, 1, "selective").orderBy("query_id", "rank").collect()]
    assert got == [(1, "c2"), (1, "c3"), (1, "c4"), (2, "c3"), (2, "c0")]
    packed = evidence.packed(seeds, chunks, k=1).orderBy("query_id", "place").collect()
    assert [(r.query_id, r.doc, r.relation[:4]) for r in packed] == [(1, "c2", "seed"), (1, "c3", "same"), (2, "c3", "seed"), (2, "c2", "same")]


CLAUSE = "Điều 1. Xe\n\n1. Phạt tiền từ 400.000 đồng đến 600.000 đồng đối với người:\na) vượt đèn đỏ;\nb) không đội mũ " + "rất dài " * 60


def test_spans_pair_bullets_and_cut_long_ones():
    got = evidence.spans(CLAUSE, 120)
    assert got[:3] == ["Điều 1. Xe", "1. Phạt tiền từ 400.000 đồng đến 600.000 đồng đối với người:", "1. Phạt tiền từ 400.000 đồng đến 600.000 đồng a) vượt đèn đỏ;"]
    assert all(len(s) <= 240 for s in got) and len(got) > 4
    assert evidence.spans("Một câu. Hai câu! Ba?") == ["Một câu.", "Hai câu!", "Ba?"] and evidence.spans(" \n") == []
    assert evidence.shortened("a" * 25, 10) == ["a" * 10, "a" * 10, "a" * 5] and evidence.shortened("aaa bbbbbb ccc", 9) == ["aaa bbbbb", "b ccc"]


def test_spans_are_ranked_and_varied(spark):
    docs = [{"text": CLAUSE, "score": 0.9, "doc_id": "1", "article_number": "1"}, {"text": "Vượt đèn đỏ là sai. Đội mũ khi lái xe. Phạt 5 điểm.", "score": 0.1, "doc_id": "2", "article_number": None}]
    ranked = evidence.rank_spans("vượt đèn đỏ", docs, 3)
    assert "đèn đỏ" in ranked[0]["text"] and ranked[0]["score"] >= ranked[1]["score"] >= ranked[2]["score"]
    assert evidence.rank_spans("vượt đèn đỏ", docs, 1, dense=lambda q, s: [float("mũ khi" in x) * 9 for x in s])[0]["text"] == "Đội mũ khi lái xe."
    rel = {c["text"]: c["rel"] for c in evidence.relevance("mất 5 điểm", docs)}
    plain = {c["text"]: c["rel"] for c in evidence.relevance("mất 5 điểm", docs, clause_aware=False)}
    assert rel["Phạt 5 điểm."] == pytest.approx(plain["Phạt 5 điểm."] + 0.1)
    # against a plain greedy loop
    found = evidence.relevance("vượt đèn đỏ đội mũ", docs)
    order, left = [], list(range(len(found)))
    while left and len(order) < 4:
        value = lambda i: 0.72 * found[i]["score"] - 0.28 * max([sum(min(found[i]["terms"][t], found[j]["terms"][t]) for t in found[i]["terms"]) / min(sum(found[i]["terms"].values()), sum(found[j]["terms"].values())) for j in order] or [0])
        order.append(max(left, key=value))
        left.remove(order[-1])
    texts = [found[i]["text"] for i in order]
    assert [c["text"] for c in evidence.varied("vượt đèn đỏ đội mũ", docs, 4, order="rank")] == texts
    assert [c["text"] for c in evidence.varied("vượt đèn đỏ đội mũ", docs, 4)] == [texts[0], texts[2], texts[3], texts[1]]
    assert evidence.varied("?", docs) is None
    hits = spark.createDataFrame([(1, 1, "x", "một câu"), (2, 1, "y", "")], "query_id long, rank long, doc string, text string")
    q = spark.createDataFrame([(1, ""), (2, "gì đó")], "query_id long, question string")
    assert {(r.query_id, r.doc, r.text) for r in evidence.spans_by(hits, q, evidence.varied).collect()} == {(1, "x", "một câu"), (2, "y", "")}


def test_card_picks_clause_and_point_by_the_question(spark):
    text = "Điều 6. Xử phạt\n1. Phạt tiền từ 1.000 đồng đến 2.000 đồng:\na) đi xe đạp\nb) vượt đèn đỏ\n2. Không nói gì về đèn đỏ"
    card = one(spark, evidence.card(F.lit("vượt đèn đỏ"), F.col("t"), F.lit("nd_1")), t=text).split("\n")
    assert card[1] == "Căn cứ: nd_1 Điều 6 khoản 1 điểm b" and "Mức phạt: phạt tiền từ 1.000 đồng đến 2.000 đồng" in card and "Hành vi/điều kiện liên quan: vượt đèn đỏ" in card
    known = one(spark, evidence.card(F.lit("?"), F.col("t"), clause_number=F.lit("9"), point_letter=F.lit("đ"), clause_lead=F.lit("phạt tiền 7.000 đồng"), point_text=F.lit("điểm riêng")), t=text).split("\n")
    assert known[1] == "Căn cứ: Điều 6 khoản 9 điểm đ" and "Mức phạt: phạt tiền 7.000 đồng" in known and "Hành vi/điều kiện liên quan: điểm riêng" in known
    assert one(spark, evidence.card(F.lit("?"), F.col("t")), t=None).split("\n") == ["EVIDENCE_CARD", evidence.CARD_END]


def test_domain_expansion_against_a_loop(spark):
    rows = [*legal.LEGAL_TERMS, "thời tiết", "12 điểm được phục hồi", "xe máy vượt đèn đỏ phạt bao nhiêu"]
    df = spark.createDataFrame([(q,) for q in rows], "q string").coalesce(1)
    for r in df.select("q", legal.intents(F.col("q")).alias("found"), legal.expand_domain(F.col("q")).alias("expanded")).collect():
        added = [v for k, v in legal.INTENT_PHRASES.items() if k in r.found] + [v for k, v in legal.INTENT_MORE.items() if k in r.found]
        for k, v in legal.LEGAL_TERMS.items():
            if k in r.q.lower() and v not in "\n".join(added):
                added.append(v)
        assert r.expanded == (r.q + "\n" + "\n".join(dict.fromkeys(added)) if added else r.q)


@pytest.mark.parametrize("said,found", [('```json\n{"a": 1}\n```', '{"a": 1}'), ('so {"a": {"b": 2}} it is', '{"a": {"b": 2}}'), ("{bad", None), ("", None), ('```\n[1]```', "[1]"), ('x {"a": } y', None)])
def test_json_salvage(spark, said, found):
    got = one(spark, tx.json_salvage(F.col("a")), a=said)
    assert (got and got.strip()) == found


def test_small_text_functions(spark):
    import hashlib

    assert one(spark, tx.stable_int(F.col("a")), a="câu") == int(hashlib.sha256("câu".encode()).hexdigest()[:16], 16)
    assert one(spark, tx.segmented(F.col("a"), lambda t: t.replace("xe máy", "xe_máy")), a="Đi  Xe Máy") in ("đi xe_máy", "đi xe máy")
    assert one(spark, tx.segmented(F.col("a"), lambda t: 1 / 0), a=" A  b ") == "a b"
    assert one(spark, tx.chunk_key(F.lit(None), F.col("d"), F.col("a")), d=None, a="x") == "unknown:" + hashlib.md5(b"x").hexdigest()[:8]
    assert one(spark, legal.infer_article(F.col("a")), a="x Điều 5a. Tên  điều\nkhác") == "Điều 5a. Tên điều"
    assert one(spark, legal.from_first_article(F.col("a")), a="Mục lục\n\nĐiều 2. X\nĐiều 3") == "Điều 2. X\nĐiều 3"
    assert one(spark, legal.choice_on_topic(F.col("a"), F.array(F.lit("Biển BÁO"))), a="?") is True
    assert one(spark, legal.suspension(F.col("a")), a="bị tước quyền sử dụng từ 2 tháng đến 4 tháng; x") == "tước quyền sử dụng từ 2 tháng đến 4 tháng"


def test_chunker_splits_long_and_plain_texts(spark):
    long = "Điều 1. Tên\n1. " + "chữ " * 900
    plain = "không có điều nào " * 200
    rows = structure.chunks(spark.createDataFrame([(1, long), (2, plain), (3, ""), (4, None)], "doc_id long, text string")).orderBy("doc_id", "place").collect()
    own = [r for r in rows if r.doc_id == 1]
    assert [r.legal_split_part for r in own] == list(range(1, len(own) + 1)) and len(own) > 2 and all("Điều 1. Tên" in r.text[:32] for r in own)
    assert [r.text for r in rows if r.doc_id == 2] == structure.split_recursive(plain.strip()) and {r.doc_id for r in rows} == {1, 2}


def test_meteor_against_hand_counts():
    assert metrics.meteor_exact("a b c d".split(), "a b c d".split()) == pytest.approx(1 - 0.5 / 64)
    assert metrics.meteor_exact("a x b".split(), "a b".split()) == pytest.approx((2 / 3 * 1) / (0.9 * 2 / 3 + 0.1) * (1 - 0.5))
    assert metrics.meteor_exact(["a"], ["b"]) == 0


def test_ordinals_and_places(spark):
    rng = random.Random(2)
    rows = [(rng.choice("abcdefgh") + str(rng.randrange(40)), i) for i in range(500)] + [(None, 500), (None, 501)]
    df = spark.createDataFrame(rows, "k string, i long")
    want = {i: n for n, (_, i) in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])))}
    assert {r.i: r.o for r in ordinal.numbered(df, "k", ["i"], "o").collect()} == want
    assert ordinal.numbered(df.limit(0), "k", ["i"], "o").count() == 0
    assert {r.i for r in splits.at_places(df.select("i"), "i", [0, 501]).collect()} == {0, 501}
    with pytest.raises(IndexError):
        splits.at_places(df.select("i"), "i", [502])


def test_greedy_split_against_a_loop(spark):
    rows = [(f"g{i}", j) for i in range(40) for j in range(i % 9 + 1)]
    got = splits.greedy_split(spark.createDataFrame(rows, "g string, j long"), "g").select("g", "split").distinct().collect()
    sizes, total = Counter(g for g, _ in rows), len(rows)
    want = splits.assign_groups({f"g:{g}": n for g, n in sizes.items()})
    assert {f"g:{r.g}": r.split for r in got} == want and len(got) == 40
    share = Counter()
    for r in got:
        share[r.split] += sizes[r.g]
    assert abs(share["train"] - 0.8 * total) <= 9 and abs(share["dev"] - 0.1 * total) <= 9


def ask(picked, phase):
    return picked.withColumn("question", F.concat(F.lit(f"{phase.key}: "), F.substring("context", 1, 40), F.lit("?"))).withColumn("answer", F.substring("context", 1, 60))


LAWS = [(i, f"Nghị định {i}/2024/NĐ-CP", "\n".join(f"Điều {a}. Tên điều {a} của văn bản {i}\n1. " + f"nội dung số {a} của {i} rất dài " * 14 for a in range(1, 5))) for i in range(1, 7)]


def test_pipeline_from_texts_to_figures(spark, tmp_path):
    docs = spark.createDataFrame(LAWS, "doc_id long, title string, text string")
    plan = [generate.Phase("general", 0, 80, 5), generate.Phase("penalties", 20, 80, 9)]
    report = pipeline.run(spark, docs, str(tmp_path), ask, plan)
    raw = spark.read.json(f"{tmp_path}/raw_pairs")
    assert {r.phase: r["count"] for r in raw.groupBy("phase").count().collect()} == {"general": 5, "penalties": 4}
    made = spark.read.parquet(f"{tmp_path}/pairs")
    n = {r.corpus: r["count"] for r in made.groupBy("corpus").count().collect()}
    assert n == {"local_text": 9, "negative": 9}
    wrong = made.filter("corpus = 'negative'").join(made.filter("corpus = 'local_text'").select("id", F.col("doc_id").alias("own")), "id")
    assert wrong.filter("doc_id = own").isEmpty() and wrong.filter(F.col("answer") != legal.REFUSAL_ANSWER).isEmpty()
    assert report["n"] == made.filter("split = 'test' AND corpus = 'local_text'").count() and reports.read_report(spark, f"{tmp_path}/report") == json.loads(json.dumps(report))
    again = pipeline.run(spark, docs, str(tmp_path), ask, plan, pipeline.Stages(rebuild=False, evaluate=False))
    assert again is None and spark.read.json(f"{tmp_path}/raw_pairs").count() == 9  # a rerun adds nothing
    assert [p.target for p in generate.phases(True, 100)][:3] == [24, 48, 96] and generate.phases(True)[-1].target == 4000


def test_rewrites(spark):
    q = spark.createDataFrame([(1, "a hỏi"), (2, "b hỏi"), (3, "c hỏi")], "query_id long, question string")
    cache = spark.createDataFrame([("a hỏi", "A cũ xưa")], "question string, rewritten string")
    made = generate.rewrite_cache(q, lambda c: F.when(c == "b hỏi", F.concat(F.lit('"Câu hỏi pháp lý: '), c, F.lit(" viết lại\nthêm"))).otherwise("ngắn"), cache)
    assert {r.question: r.rewritten for r in made.collect()} == {"a hỏi": "A cũ xưa", "b hỏi": "b hỏi viết lại"}
    assert {r.query_id: r.question for r in generate.rewritten(q, made).collect()} == {1: "A cũ xưa", 2: "b hỏi viết lại", 3: "c hỏi"}


def test_embedding_batches(spark):
    df = spark.range(300).select(F.col("id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text")).coalesce(1)
    got = search.embedded(df, lambda texts: [[len(texts), len(t)] for t in texts]).collect()
    assert Counter(int(r.embedding[0]) for r in got) == {128: 256, 44: 44} and all(r.embedding[1] == len(r.text) for r in got) and len(got) == 300


def test_main_text_by_selectors():
    a, b = "câu " * 90, "dài " * 150
    assert web.extract_main(f"<div>{b}</div><div class='x content y'><script>no</script><p>{a}</p><p>z</p></div>") == f"{a.strip()}\nz"
    assert web.extract_main(f"<div id='main-content-1'><b>{a}</b></div><article class='content'>ngắn</article>") == a.strip()
    assert web.extract_main(f"<div><div>{b}</div></div><p>{b}{b}</p>") == b.strip()
    assert web.extract_main("<div>ngắn</div>") == "" == web.extract_main(None)


def test_eval_sets(spark, tmp_path):
    rows = [{"question": f"q{i}", "category": "unsupported" if i % 5 == 0 else None if i % 7 == 0 else "law", "expected_doc_ids": [f"d{i % 3}"] if i % 2 else []} for i in range(50)]
    (tmp_path / "pairs.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    path = str(tmp_path / "pairs.jsonl")
    tail = evalsets.eval_set(spark, None, [str(tmp_path / "no.jsonl")], path)
    assert tail.count() == 5 and {r.question for r in tail.collect()} == {r.question for r in evalsets.eval_set(spark, pairs=path).collect()}
    assert evalsets.eval_set(spark, None, [str(tmp_path / "no.jsonl"), path], first=3).count() == 3
    with pytest.raises(FileNotFoundError):
        evalsets.eval_set(spark, str(tmp_path / "no.jsonl"), [path])
    counts, unknown = evalsets.validate(evalsets.expected_ids(evalsets.eval_set(spark, path)), spark.createDataFrame([("d0",), ("d1",)], "doc_id string"))
    c = counts.first()
    sup = [r for r in rows if r["category"] != "unsupported"]
    assert (c.n, c.missing_category, c.measurable, c.supported_without_expected) == (50, sum(r["category"] is None for r in rows), sum(bool(r["expected_doc_ids"]) for r in sup), sum(not r["expected_doc_ids"] for r in sup))
    assert {r.doc_id: r["rows"] for r in unknown.collect()} == {"d2": sum(r["expected_doc_ids"] == ["d2"] for r in rows)}


def test_exam_files_and_counts(spark, tmp_path):
    rows = [{"id": str(i), "question": f"Câu hỏi số {i}?", "A": "a", "B": "b", "C": "c", "D": "d" if i != 3 else "", "answer": "abcd"[i % 4]} for i in range(1, 9)]
    (tmp_path / "x.jsonl").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "x.csv").write_text("\ufeffid,question,A,B,C,D,answer\n" + "\n".join(",".join(r.values()) for r in rows), encoding="utf-8")
    for name in ("x.jsonl", "x.csv"):
        raw = exams.read_exam(spark, str(tmp_path / name))
        items = exams.parse_exam(raw)
        assert {r.id for r in items.collect()} == {str(i) for i in range(1, 9) if i != 3} and items.filter(exams.valid_item()).count() == 7
        counted = exams.import_counts(raw.withColumn("place", F.col("id").cast("int")), "1,5->6", "place").first()
        assert (counted.excluded, counted.bad, counted.ok) == (3, 1, 4)
