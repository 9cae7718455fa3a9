"""Answer and retrieval metrics. Pairs are user turns (references) and the assistant turns after them (predictions)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import legal
from ..functions import text as tx
from ..operators import metrics as m
from ..registry import query, table
from .sql import PAIRS, tok

KEY = ["conv_id", "turn"]


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, question, answer, r and p (their tokens)."""
    w = W.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations")
    c = c.withColumn("nr", F.lead("role").over(w)).withColumn("answer", F.lead("text").over(w)).filter("role = 'user' AND nr = 'assistant'")
    return c.select("conv_id", "turn", F.col("text").alias("question"), "answer", tx.tokens(F.col("text")).alias("r"), tx.tokens(F.col("answer")).alias("p"))


ROUGE = f"{PAIRS}, tp AS (SELECT conv_id, turn, regexp_extract_all(lower(question), '[a-z0-9]+') AS r, regexp_extract_all(lower(answer), '[a-z0-9]+') AS p FROM pairs)"
TOKS = f"{PAIRS}, tp AS (SELECT conv_id, turn, question, answer, {tok('question')} AS r, {tok('answer')} AS p FROM pairs)"
F1 = "CASE WHEN len(p) = 0 AND len(r) = 0 THEN 1.0 WHEN len(p) = 0 OR len(r) = 0 OR len(list_intersect(list_distinct(p), list_distinct(r))) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect(list_distinct(p), list_distinct(r))) / (len(p) + len(r)) END"


@query(f"WITH {TOKS} SELECT conv_id, turn, round(({F1})::double, 6) AS f1 FROM tp")
def token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select(*KEY, F.round(m.token_f1(F.col("p"), F.col("r")), 6).alias("f1"))


@query(f"WITH {TOKS} SELECT round(avg((trim(question) = trim(answer))::int)::double, 6) AS exact, count(*)::bigint AS n FROM tp")
def exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).agg(F.round(F.avg((F.trim("question") == F.trim("answer")).cast("int")), 6).alias("exact"), F.count(F.lit(1)).alias("n"))


def grams(n: int) -> str:
    g = lambda c: f"CASE WHEN len({c}) >= {n} THEN list_transform(generate_series(1, len({c}) - {n - 1}), lambda i: array_to_string(list_slice({c}, i, i + {n - 1}), ' ')) ELSE [] END"
    return f"g{n} AS (SELECT conv_id, turn, unnest({g('p')}) AS g, 0 AS v FROM tp UNION ALL SELECT conv_id, turn, unnest({g('r')}), 1 FROM tp), o{n} AS (SELECT conv_id, turn, sum(least(a, b)) AS mt, sum(a) AS pr, sum(b) AS ex FROM (SELECT conv_id, turn, g, sum(1 - v) AS a, sum(v) AS b FROM g{n} GROUP BY ALL) GROUP BY ALL)"


def rouge_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with the tokens that ROUGE is defined on: runs of a-z and 0-9."""
    return pairs(spark, sf_dir).select(*KEY, tx.rouge_tokens(F.col("question")).alias("r"), tx.rouge_tokens(F.col("answer")).alias("p"))


@query(f"WITH {ROUGE}, {grams(1)}, {grams(2)} SELECT conv_id, turn, round(CASE WHEN o1.mt > 0 THEN 2.0::double * o1.mt / (o1.pr + o1.ex) ELSE 0 END, 6) AS rouge_1, round(CASE WHEN o2.mt > 0 THEN 2.0::double * o2.mt / (o2.pr + o2.ex) ELSE 0 END, 6) AS rouge_2 FROM tp LEFT JOIN o1 USING (conv_id, turn) LEFT JOIN o2 USING (conv_id, turn)")
def rouge_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = rouge_pairs(spark, sf_dir)
    f = lambda n: m.overlap(p, KEY, "p", "r", n).select(*KEY, F.round(m.f_measure(F.col("matched"), F.col("predicted"), F.col("expected")), 6).alias(f"rouge_{n}"))
    return f(1).join(f(2), KEY)


@query(f"WITH {TOKS}, {', '.join(grams(n) for n in (1, 2, 3, 4))}, c AS (SELECT (SELECT sum(len(p)) FROM tp) AS pl, (SELECT sum(len(r)) FROM tp) AS rl, {', '.join(f'(SELECT sum(mt) FROM o{n}) AS m{n}, (SELECT sum(pr) FROM o{n}) AS t{n}' for n in (1, 2, 3, 4))}) SELECT round((CASE WHEN least(m1, m2, m3, m4) = 0 THEN 0 ELSE exp((ln(m1 / t1) + ln(m2 / t2) + ln(m3 / t3) + ln(m4 / t4)) / 4) * CASE WHEN pl >= rl THEN 1 ELSE exp(1 - rl / pl) END END)::double, 6) AS bleu FROM c")
def bleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus BLEU-4 over word tokens: clipped counts summed over all pairs, brevity penalty."""
    p = pairs(spark, sf_dir)
    out = p.agg(F.sum(F.size("p")).alias("pl"), F.sum(F.size("r")).alias("rl"))
    for n in (1, 2, 3, 4):
        out = out.join(F.broadcast(m.overlap(p, KEY, "p", "r", n).agg(F.sum("matched").alias(f"m{n}"), F.sum("predicted").alias(f"t{n}"))))  # one row
    logs = sum((F.log(F.col(f"m{n}") / F.col(f"t{n}")) for n in (1, 2, 3, 4)), F.lit(0.0)) / 4
    brevity = F.when(F.col("pl") >= F.col("rl"), 1.0).otherwise(F.exp(1 - F.col("rl") / F.col("pl")))
    return out.select(F.round(F.when(F.least("m1", "m2", "m3", "m4") == 0, 0.0).otherwise(F.exp(logs) * brevity), 6).alias("bleu"))


def lcs_sql(rows: str) -> str:
    """CTEs that end in ``lcs`` (id, n): longest common subsequence of the lists x and y of rows (id, x, y), a row of the usual table at a step."""
    return f"""lx AS (SELECT id, unnest(generate_series(1, len(x)))::int AS i, unnest(x) AS t FROM {rows}), ly AS (SELECT id, 0 AS j, NULL::varchar AS t FROM {rows} UNION ALL SELECT id, unnest(generate_series(1, len(y)))::int, unnest(y) FROM {rows}),
lr AS (SELECT id, 0 AS i, j, 0 AS v FROM ly UNION ALL SELECT id, i, j, max(w) OVER (PARTITION BY id ORDER BY j)::int FROM (SELECT lr.id, lx.i, lr.j, CASE WHEN ly.t = lx.t THEN lag(v) OVER (PARTITION BY lr.id ORDER BY lr.j) + 1 ELSE v END AS w FROM lr JOIN lx ON lx.id = lr.id AND lx.i = lr.i + 1 JOIN ly ON ly.id = lr.id AND ly.j = lr.j)),
lcs AS (SELECT id, arg_max(v, (i, j)) AS n FROM lr GROUP BY id)"""


@query(f"WITH RECURSIVE {ROUGE}, t AS (SELECT conv_id * 100000 + turn AS id, p AS x, r AS y FROM tp), {lcs_sql('t')} SELECT conv_id, turn, round(CASE WHEN n > 0 THEN 2.0::double * n / (len(p) + len(r)) ELSE 0 END, 6) AS rouge_l FROM tp JOIN lcs ON id = conv_id * 100000 + turn")
def rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROUGE-L F over whole texts."""
    from ..shipping import ship

    ship(spark)
    return rouge_pairs(spark, sf_dir).select(*KEY, F.round(m.rouge_l(F.col("p"), F.col("r")), 6).alias("rouge_l"))


@query()
def meteor(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.udf("double", useArrow=True)
    def score(p, r):
        return m.meteor_exact(list(p), list(r))

    from ..shipping import ship

    ship(spark)
    return pairs(spark, sf_dir).select(*KEY, F.round(score("p", "r"), 6).alias("meteor"))


VEC = "SELECT vec_id // 10 AS g, vec_id % 2 AS side, vec_id, embedding::double[] AS e FROM embeddings"


@query(f"WITH v AS ({VEC}), s AS (SELECT a.g, a.vec_id AS x, b.vec_id AS y, list_dot_product(a.e, b.e) AS c FROM v a JOIN v b ON a.g = b.g AND a.side = 0 AND b.side = 1), p AS (SELECT g, avg(c) AS p FROM (SELECT g, x, max(c) AS c FROM s GROUP BY ALL) GROUP BY g), r AS (SELECT g, avg(c) AS r FROM (SELECT g, y, max(c) AS c FROM s GROUP BY ALL) GROUP BY g) SELECT g, round(p, 5) AS p, round(r, 5) AS r, round(CASE WHEN p + r <> 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1 FROM p JOIN r USING (g)")
def maxsim_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy matching of two vector sets: the mean best cosine either way. Groups are of ten vectors."""
    from ..operators.ranking import dot

    v = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 10).cast("long").alias("g"), (F.col("vec_id") % 2).alias("side"), "vec_id", "embedding")
    a, b = (v.filter(F.col("side") == k).select("g", F.col("vec_id").alias(n), F.col("embedding").alias("e" + n)) for k, n in ((0, "x"), (1, "y")))
    s = a.join(b, "g").select("g", "x", "y", dot(F.col("ex"), F.col("ey")).alias("c"))
    mean = lambda k, n: s.groupBy("g", k).agg(F.max("c").alias("c")).groupBy("g").agg(F.avg("c").alias(n))
    p, r = F.col("p"), F.col("r")
    return mean("x", "p").join(mean("y", "r"), "g").select("g", F.round(p, 5).alias("p"), F.round(r, 5).alias("r"), F.round(F.when(p + r != 0, 2 * p * r / (p + r)).otherwise(0.0), 4).alias("f1"))


CTX = f"WITH RECURSIVE {ROUGE}, d AS (SELECT a.conv_id, a.turn, b.turn AS other, a.r AS y, b.p AS x FROM tp a JOIN tp b USING (conv_id)), t AS (SELECT conv_id * 100000000 + turn * 10000 + other AS id, x, y FROM d), {lcs_sql('t')}, h AS (SELECT conv_id, max(CASE WHEN n > 0 THEN 2.0::double * n / (len(x) + len(y)) ELSE 0 END) AS best FROM d JOIN lcs ON id = conv_id * 100000000 + turn * 10000 + other GROUP BY 1)"


@query(f"{CTX} SELECT conv_id, round(best, 6) AS best, best >= 0.5 AS hit FROM h")
def context_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's questions against all its answers as retrieved contexts: best ROUGE-L F, hit at 0.5."""
    from ..shipping import ship

    ship(spark)
    p = rouge_pairs(spark, sf_dir)
    met = p.select("conv_id", "r").join(p.select("conv_id", "p"), "conv_id")
    best = met.groupBy("conv_id").agg(F.max(m.rouge_l(F.col("p"), F.col("r"))).alias("b"))
    return best.select("conv_id", F.round("b", 6).alias("best"), (F.col("b") >= 0.5).alias("hit"))


@query("WITH j AS (SELECT event_id, concat('<think>A</think> Answer ', CASE event_id % 5 WHEN 4 THEN '?' ELSE chr((65 + event_id % 4)::int) END) AS raw, chr((65 + event_id % 3)::int) AS gold FROM events), p AS (SELECT *, nullif(regexp_extract(regexp_replace(raw, '(?s)<think>.*?</think>', '', 'g'), '\\b([A-D])\\b', 1), '') AS label FROM j) SELECT round(avg(coalesce((label = gold)::int, 0)), 6) AS accuracy, sum((label IS NULL)::int)::bigint AS unparsed, count(*)::bigint AS n FROM p")
def mc_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of labels parsed from raw answers, thinking left out; an answer without a label is wrong."""
    e = table(spark, sf_dir, "events")
    letter = lambda k: F.element_at(F.array(*[F.lit(c) for c in "ABCD"]), (F.col("event_id") % k + 1).cast("int"))
    raw = F.concat(F.lit("<think>A</think> Answer "), F.when(F.col("event_id") % 5 == 4, "?").otherwise(letter(4)))
    label = F.regexp_extract(tx.strip_think(raw), r"\b([A-D])\b", 1)
    scored = e.select(F.when(label != "", label).alias("label"), letter(3).alias("gold"))
    return scored.agg(F.round(F.avg(F.coalesce((F.col("label") == F.col("gold")).cast("int"), F.lit(0))), 6).alias("accuracy"), F.sum(F.col("label").isNull().cast("int")).alias("unparsed"), F.count(F.lit(1)).alias("n"))


SLOTS = "SELECT o_orderkey AS id, CASE WHEN o_custkey % 7 > 0 THEN concat(o_custkey % 900 + 100, '.000') END AS low, CASE WHEN o_custkey % 3 > 0 THEN concat(o_custkey % 900 + 200, '.000') ELSE '' END AS high, o_orderkey % 900 + 100 AS said, o_orderkey % 9 AS points, CASE WHEN o_custkey % 5 > 0 THEN (o_custkey % 9)::varchar END AS gold FROM orders"


@query(f"WITH s AS ({SLOTS}), h AS (SELECT *, low IS NOT NULL AND said * 1000 <= (CASE WHEN high = '' THEN replace(low, '.', '') ELSE replace(high, '.', '') END)::double * 1.15 AND (said + 50) * 1000 >= replace(low, '.', '')::double * 0.85 AS fine, points::varchar = gold AS pts FROM s) SELECT round(avg(fine::int) FILTER (WHERE low IS NOT NULL), 4) AS fine_recall, count(low)::bigint AS fines, round(avg(pts::int) FILTER (WHERE gold IS NOT NULL), 4) AS points_recall, count(gold)::bigint AS points FROM h")
def slot_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fines and deducted points of predictions against gold slots; rows without a slot don't count for it. Amounts come from order and customer numbers."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    amount = lambda k: F.concat(k.cast("string"), F.lit(".000"))
    said = F.concat(F.lit("phạt tiền từ "), amount(o % 900 + 100), F.lit(" đồng đến "), amount(o % 900 + 150), F.lit(" đồng và trừ "), (o % 9).cast("string"), F.lit(" điểm"))
    rows = table(spark, sf_dir, "orders").select(F.when(c % 7 > 0, amount(c % 900 + 100)).alias("low"), F.when(c % 3 > 0, amount(c % 900 + 200)).otherwise("").alias("high"), F.when(c % 5 > 0, (c % 9).cast("string")).alias("gold"), said.alias("said"))
    return m.slot_recall(rows.withColumnRenamed("gold", "points"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to judge: the assistant's turns, every fourth a refusal, every tenth with a superseded law; every fifth question can't be answered."""
    k = F.col("conv_id") * 7 + F.col("turn")
    answer = F.when(k % 4 == 0, F.concat(F.lit("Rất tiếc, "), F.lit(legal.REFUSAL_ANSWER))).when(k % 4 == 1, F.concat("answer", F.lit(" KHÔNG đủ thông tin"))).otherwise(F.col("answer"))
    answer = F.when(k % 10 == 3, F.concat(answer, F.lit(" theo Nghị định 100/2019"))).otherwise(answer)
    expected = F.when(k % 6 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("d"), (k % 7).cast("string"))))
    got = F.array(F.concat(F.lit("d"), (k % 5).cast("string")), F.concat(F.lit("d"), (k % 3).cast("string")))
    return pairs(spark, sf_dir).select(*KEY, F.when(k % 5 == 0, "unsupported").when(k % 5 < 4, "supported").alias("category"), answer.alias("answer"), expected.alias("expected"), got.alias("got"))


_ANY = lambda terms: " OR ".join(f"contains(lower(answer), '{t.lower()}')" for t in terms)
LABELLED = f"""{PAIRS}, lk AS (SELECT *, conv_id * 7 + turn AS k FROM pairs), la AS (SELECT *, CASE k % 4 WHEN 0 THEN concat('Rất tiếc, ', '{legal.REFUSAL_ANSWER}') WHEN 1 THEN concat(answer, ' KHÔNG đủ thông tin') ELSE answer END AS a1 FROM lk),
lb AS (SELECT conv_id, turn, k, CASE WHEN k % 10 = 3 THEN concat(a1, ' theo Nghị định 100/2019') ELSE a1 END AS answer, CASE WHEN k % 5 = 0 THEN 'unsupported' WHEN k % 5 < 4 THEN 'supported' END AS category, CASE WHEN k % 6 = 0 THEN [] ELSE [concat('d', k % 7)] END AS expected, [concat('d', k % 5), concat('d', k % 3)] AS got FROM la)"""


@query(f"WITH {LABELLED} SELECT round(avg(({_ANY([legal.REFUSAL_ANSWER, legal.REFUSAL_KEY])})::int) FILTER (WHERE category = 'unsupported'), 6) AS refusal_rate, round(avg(({_ANY(legal.REFUSAL_PHRASES)})::int) FILTER (WHERE category IS DISTINCT FROM 'unsupported'), 6) AS false_refusal_rate, count(*)::bigint AS n FROM lb")
def refusal_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refusals among questions that can't be answered, by the narrow test, and among the others, by the broad one."""
    return m.rates(labelled(spark, sf_dir)).select(F.round("refusal_rate", 6).alias("refusal_rate"), F.round("false_refusal_rate", 6).alias("false_refusal_rate"), "n")


@query(f"WITH {LABELLED} SELECT round(avg((len(list_intersect(expected, got)) > 0)::int) FILTER (WHERE len(expected) > 0), 6) AS source_hit_rate, round(avg(({_ANY([legal.REFUSAL_ANSWER, legal.REFUSAL_KEY])})::int) FILTER (WHERE category = 'unsupported'), 6) AS refusal_rate, round(avg(({_ANY(legal.REFUSAL_PHRASES)})::int) FILTER (WHERE category IS DISTINCT FROM 'unsupported'), 6) AS false_refusal_rate, round(avg(({_ANY(legal.FORBIDDEN_TERMS)})::int), 6) AS forbidden_rate, count(*)::bigint AS n FROM lb")
def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conditional rates in one row; a rate without rows is null."""
    found = m.rates(labelled(spark, sf_dir))
    return found.select(*[F.round(c, 6).alias(c) for c in ("source_hit_rate", "refusal_rate", "false_refusal_rate", "forbidden_rate")], "n")


@query(f"WITH {LABELLED} SELECT e AS doc_id, round(avg((list_contains(got, e))::int), 4) AS rate, count(*)::bigint AS n FROM (SELECT unnest(expected) AS e, got FROM lb) GROUP BY e")
def hit_by_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.hits_by_document(labelled(spark, sf_dir))


PROVISIONS = "SELECT query_id, rank, article_number, clause_number, CASE WHEN legal_block = 'point' THEN point_letter END AS point_letter FROM re JOIN kb ON kb.chunk_id = re.doc WHERE rank <= 5"


def provision_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(gold labels of the questions, what was retrieved for them): article item % 5 + 1, clause 1 for even items, point a for every third."""
    from . import kb, retrieval

    i = F.col("query_id")
    none = F.array().cast("array<string>")
    gold = retrieval.questions(spark, sf_dir).select("query_id", F.when(i % 4 < 3, F.array((i % 5 + 1).cast("string"))).otherwise(none).alias("articles"), F.when(i % 2 == 0, F.array(F.lit("1"))).otherwise(none).alias("clauses"), F.when(i % 3 == 0, F.array(F.lit("a"), F.lit("c"))).otherwise(none).alias("points"))
    chunks = kb.base(spark, sf_dir)
    return gold, retrieval.retrieved(spark, sf_dir, 5, chunks).join(chunks.select("doc", "article_number", "clause_number", "point_letter"), "doc")


def _provision_sql() -> str:
    from . import retrieval

    return f"""WITH {retrieval.RERANKED}, rt AS ({PROVISIONS}), gd AS (SELECT query_id, (query_id % 5 + 1)::varchar AS article, query_id % 2 = 0 AS has_clause, query_id % 3 = 0 AS has_point FROM qa WHERE query_id % 4 < 3),
x AS (SELECT gd.query_id, min(rank) FILTER (WHERE article_number = article) AS first, coalesce(bool_or(has_clause AND clause_number = '1'), false) AS c, coalesce(bool_or(has_point AND point_letter IN ('a', 'c')), false) AS p FROM gd LEFT JOIN rt USING (query_id) GROUP BY 1)
SELECT round(avg((first IS NOT NULL)::int), 4) AS article_recall, count(*)::bigint AS n, round(avg(c::int), 4) AS clause_recall, round(avg(p::int), 4) AS point_recall, round(avg(coalesce(1.0::double / first, 0)), 4) AS article_mrr FROM x"""


@query(_provision_sql())
def provision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of articles, clauses and points among what was retrieved, each level by itself, over rows with gold articles; reciprocal rank of the first right article."""
    return m.provisions(*provision_rows(spark, sf_dir))


@query("SELECT round(avg(nullif(regexp_extract(concat('Điểm: ', event_id % 7, ' /5'), '[1-5]', 0), '')::int) / 5, 6) AS score, count(nullif(regexp_extract(concat('Điểm: ', event_id % 7, ' /5'), '[1-5]', 0), ''))::bigint AS scored, count(*)::bigint AS n FROM events")
def judge_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge's written marks: the first digit from 1 to 5 of each, mean over 5; marks without one are left out."""
    said = F.concat(F.lit("Điểm: "), (F.col("event_id") % 7).cast("string"), F.lit(" /5"))
    return m.judge(table(spark, sf_dir, "events").select(said.alias("said"))).select(F.round("score", 6).alias("score"), "scored", "n")


AUDIT = "list_filter(list_distinct(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]+')), lambda t: length(t) >= 3 AND NOT list_contains([{s}], t))"


def _audit_sql() -> str:
    words = lambda c: AUDIT.format(c=c, s=", ".join(f"'{w}'" for w in tx.AUDIT_STOP))
    return f"""WITH RECURSIVE {PAIRS}, au AS (SELECT conv_id, turn, question AS q, answer AS gold, coalesce(lead(answer) OVER (PARTITION BY conv_id ORDER BY turn), '') AS top, conv_id % 3 = 0 AS same FROM pairs),
aw AS (SELECT *, {words('q')} AS qw, {words('gold')} AS gw, {words('top')} AS tw, regexp_extract_all(lower(gold), '[a-z0-9]+') AS y, regexp_extract_all(lower(top), '[a-z0-9]+') AS x FROM au), t AS (SELECT conv_id * 100000 + turn AS id, x, y FROM aw), {lcs_sql('t')},
ar AS (SELECT conv_id, turn, same, len(list_intersect(qw, gw))::double / greatest(len(qw), 1) AS g, len(list_intersect(qw, tw))::double / greatest(len(qw), 1) AS o, CASE WHEN n > 0 THEN 2.0::double * n / (len(x) + len(y)) ELSE 0 END AS rl FROM aw JOIN lcs ON id = conv_id * 100000 + turn),
af AS (SELECT *, g < 0.12 AS low, o >= g + 0.18 AND rl < 0.35 AS better FROM ar) SELECT conv_id, turn, round(g, 4) AS gold_overlap, round(o, 4) AS top_overlap, round(rl, 4) AS top_rouge, low AS gold_low, better AS retrieved_better, (low OR better) AND NOT same AS noise FROM af"""


@query(_audit_sql())
def label_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags on labels: the gold context shares little with the question, what came first shares more and is another text, and noise where the document differs too.

    The gold context of a question is its answer, what came first is the conversation's next answer."""
    from ..shipping import ship

    ship(spark)
    p = pairs(spark, sf_dir)
    top = F.coalesce(F.lead("answer").over(W.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    return m.label_audit(p.select(*KEY, "question", F.col("answer").alias("gold"), top.alias("top"), (F.col("conv_id") % 3 == 0).alias("same")), KEY)


@query("SELECT label, round(avg(hit), 6) AS recall, count(*)::bigint AS groups FROM (SELECT label, g, max(pos) AS hit FROM (SELECT label, vec_id // 50 AS g, (vec_id % 7 = 0)::int AS pos, row_number() OVER (PARTITION BY label, vec_id // 50 ORDER BY md5(vec_id::varchar)) AS r FROM embeddings) WHERE r <= 3 GROUP BY ALL) GROUP BY label")
def group_recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of groups with a positive among the three best."""
    e = table(spark, sf_dir, "embeddings").select("label", F.floor(F.col("vec_id") / 50).alias("g"), (F.col("vec_id") % 7 == 0).cast("int").alias("pos"), F.md5(F.col("vec_id").cast("string")).alias("o"))
    r = F.row_number().over(W.partitionBy("label", "g").orderBy("o"))
    hits = e.withColumn("r", r).filter("r <= 3").groupBy("label", "g").agg(F.max("pos").alias("hit"))
    return hits.groupBy("label").agg(F.round(F.avg("hit"), 6).alias("recall"), F.count(F.lit(1)).alias("groups"))
