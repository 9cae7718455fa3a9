"""Question-answer filters, sampling, splits and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import legal
from ..functions import text as tx
from ..operators import generate, quality, splits
from ..operators.generate import question_key
from ..registry import query, table
from .metrics import KEY, TOKS, pairs
from .sql import PAIRS, h32


#: Every fifth question asks for the text's own data, every sixth answer is none, every fourth question speaks of "this text".
PLANTED = f"""{PAIRS}, qk AS (SELECT *, conv_id * 7 + turn AS k FROM pairs),
qp AS (SELECT conv_id, turn, CASE WHEN k % 3 = 0 THEN 'negative' ELSE 'local_text' END AS corpus, concat(CASE WHEN k % 4 = 0 THEN 'Điều này quy định về vấn đề ' ELSE '' END, question, CASE WHEN k % 5 = 0 THEN ' NGÀY ban hành' ELSE '' END) AS question, concat(answer, CASE WHEN k % 6 = 0 THEN ' không đề cập' ELSE '' END) AS answer FROM qk)"""
_ANY = lambda c, terms: "(" + " OR ".join(f"contains(lower({c}), '{t}')" for t in terms) + ")"


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("conv_id") * 7 + F.col("turn")
    question = F.concat(F.when(k % 4 == 0, "Điều này quy định về vấn đề ").otherwise(""), "question", F.when(k % 5 == 0, " NGÀY ban hành").otherwise(""))
    answer = F.concat("answer", F.when(k % 6 == 0, " không đề cập").otherwise(""))
    return pairs(spark, sf_dir).select(*KEY, F.when(k % 3 == 0, "negative").otherwise("local_text").alias("corpus"), question.alias("question"), answer.alias("answer"))


@query(f"WITH {PLANTED} SELECT conv_id, turn FROM qp WHERE NOT ({_ANY('question', legal.TRIVIAL_QUESTION)} OR {_ANY('answer', legal.NO_ANSWER)})")
def qa_trivial_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planted(spark, sf_dir).filter(~legal.trivial(F.col("question"), F.col("answer"))).select(*KEY)


@query(f"WITH {TOKS}, g AS (SELECT conv_id, turn, CASE WHEN len(list_distinct(p)) > 0 THEN len(list_intersect(list_distinct(p), list_distinct(r)))::double / len(list_distinct(p)) ELSE 0 END AS share FROM tp) SELECT conv_id, turn, round(share, 6) AS share, share >= 0.35 AS grounded FROM g")
def qa_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the answer's distinct tokens that the context has; grounded from 0.35 on, an empty answer never."""
    n = F.size(F.array_distinct("p"))
    share = F.when(n > 0, F.size(F.array_intersect("p", "r")) / n).otherwise(F.lit(0.0))
    return pairs(spark, sf_dir).select(*KEY, F.round(share, 6).alias("share"), (share >= 0.35).alias("grounded"))


_BAD = "(corpus = 'local_text' AND (length(answer) > 500 OR (starts_with(question, 'Điều') AND (contains(question, 'văn bản này') OR contains(question, 'quy định về vấn đề')))))"


@query(f"WITH {PLANTED} SELECT conv_id, turn, corpus FROM qp WHERE NOT {_BAD}")
def qa_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.qa_flags(planted(spark, sf_dir)).filter("NOT (long_answer OR self_referring)").select(*KEY, "corpus")


@query(f"WITH {PLANTED} SELECT corpus, count(*)::bigint AS before, sum((NOT {_BAD})::int)::bigint AS after, sum((corpus = 'local_text' AND length(answer) > 500)::int)::bigint AS long_answers, round(100.0::double * sum((NOT {_BAD})::int) / count(*), 1) AS retention FROM qp GROUP BY ROLLUP (corpus)")
def qa_filter_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.sum((~(F.col("long_answer") | F.col("self_referring"))).cast("int"))
    flagged = quality.qa_flags(planted(spark, sf_dir))
    return flagged.rollup("corpus").agg(F.count(F.lit(1)).alias("before"), kept.alias("after"), F.sum(F.col("long_answer").cast("int")).alias("long_answers"), F.round(100.0 * kept / F.count(F.lit(1)), 1).alias("retention"))


@query("SELECT min(concat(lpad(conv_id::varchar, 8, '0'), ':', lpad(turn::varchar, 4, '0'))) AS first, lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS question, count(*)::bigint AS n FROM conversations WHERE role = 'user' GROUP BY lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))")
def qa_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "conversations").filter("role = 'user'")
    first = F.min(F.concat(F.lpad(F.col("conv_id").cast("string"), 8, "0"), F.lit(":"), F.lpad(F.col("turn").cast("string"), 4, "0")))
    return q.groupBy(question_key(F.col("text")).alias("question")).agg(first.alias("first"), F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT lower(regexp_replace(n.text, '^\\s+|\\s+$', '', 'g')) AS question FROM conversations n WHERE role = 'user' AND conv_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM conversations o WHERE o.role = 'user' AND o.conv_id % 2 = 0 AND lower(regexp_replace(o.text, '^\\s+|\\s+$', '', 'g')) = lower(regexp_replace(n.text, '^\\s+|\\s+$', '', 'g')))")
def qa_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an append adds: new questions that the table doesn't have yet."""
    q = table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", question_key(F.col("text")).alias("question"))
    return q.filter("conv_id % 2 = 1").select("question").distinct().join(q.filter("conv_id % 2 = 0").select("question"), "question", "left_anti")


@query(f"WITH p AS (SELECT doc_id, source, {h32('42', 'doc_id')} AS h FROM documents) SELECT source, arg_min(doc_id, (h, doc_id)) AS doc_id FROM p GROUP BY source")
def qa_sample_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One seeded random row of each record."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", tx.stable_hash(F.lit(42), F.col("doc_id")).alias("h"))
    return d.groupBy("source").agg(F.min(F.struct("h", "doc_id")).alias("m")).select("source", F.col("m.doc_id").alias("doc_id"))


NEGATIVE = f"""us AS (SELECT source, doc_id, text FROM documents WHERE length(text) >= 300 AND NOT {_ANY('text', [t.lower() for t in legal.FORBIDDEN_TERMS])}), ow AS (SELECT source, arg_min(text, ({h32('42', 'source', 'doc_id')}, doc_id)) AS context FROM us GROUP BY source),
ri AS (SELECT source AS other, context, row_number() OVER (ORDER BY source) - 1 AS nth, count(*) OVER () AS n FROM ow), ps AS (SELECT conv_id * 100 + turn AS id, concat('src', conv_id % 25) AS source FROM pairs),
ch AS (SELECT id, CASE WHEN ri.nth IS NULL THEN {h32('42', 'id')} % (SELECT max(n) FROM ri) ELSE (ri.nth + 1 + {h32('42', 'id')} % ((SELECT max(n) FROM ri) - 1)) % (SELECT max(n) FROM ri) END AS nth FROM ps LEFT JOIN ri ON ri.other = ps.source)"""


@query(f"WITH {PAIRS}, {NEGATIVE} SELECT id, other, md5(context) AS context FROM ch JOIN ri USING (nth)")
def negative_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question with a chunk of another source and the set refusal."""
    asked = pairs(spark, sf_dir).select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.concat(F.lit("src"), (F.col("conv_id") % 25).cast("string")).alias("source"), "question")
    chunks = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("place"), "text")
    return generate.negatives(asked, chunks, "source").select("id", "other", F.md5("context").alias("context"))


@query(f"WITH {PAIRS}, k AS (SELECT *, conv_id * 7 + turn AS k FROM pairs), hp AS (SELECT conv_id, turn, question, answer, list_filter([k % 300, k % 70, k % 11], lambda x: x % 2 = 0)[1] AS f FROM k WHERE conv_id % 2 = 1), al AS (SELECT question, answer, '' AS negative FROM k WHERE conv_id % 2 = 0 UNION ALL SELECT question, answer, CASE WHEN f IS NULL THEN '' ELSE concat('Điều ', f, chr(10), 'Trừ điểm: ', f % 5) END FROM hp), st AS (SELECT regexp_replace(question, '^\\s+|\\s+$', '', 'g') AS anchor, regexp_replace(answer, '^\\s+|\\s+$', '', 'g') AS positive, negative FROM al) SELECT md5(anchor) AS anchor, md5(positive) AS positive, negative FROM st WHERE anchor <> '' AND positive <> '' ORDER BY {h32('42', 'st.anchor', 'st.positive', 'negative')}, st.anchor, st.positive, negative LIMIT 8000")
def contrastive_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchor, positive and first known hard negative; facts have even numbers, so that odd ids are unknown."""
    k = F.col("conv_id") * 7 + F.col("turn")
    p = pairs(spark, sf_dir).select("conv_id", "question", F.col("answer").alias("context"), F.array(k % 300, k % 70, k % 11).alias("hard"))
    n = F.col("id")
    facts = spark.range(300).filter("id % 2 = 0").select(n.alias("fact_id"), generate.fact_text(F.concat(F.lit("Điều "), n.cast("string")), F.lit(""), F.lit(None).cast("string"), n % 5).alias("text"))
    out = generate.contrastive(p.filter("conv_id % 2 = 0"), p.filter("conv_id % 2 = 1"), facts)
    return out.select(F.md5("anchor").alias("anchor"), F.md5("positive").alias("positive"), "negative")


@query(f"WITH {PAIRS}, a AS (SELECT conv_id * 100 + turn AS id, question, answer, concat(question, ' ', CASE WHEN conv_id % 2 = 0 THEN answer ELSE '' END) AS context FROM pairs), w AS (SELECT *, list_distinct(regexp_extract_all(lower(answer), '[\\p{{L}}\\p{{N}}_]+')) AS aw, lower(regexp_replace(question, '^\\s+|\\s+$', '', 'g')) AS key FROM a), ok AS (SELECT * FROM w WHERE key <> '' AND len(aw) > 0 AND len(list_intersect(aw, regexp_extract_all(lower(context), '[\\p{{L}}\\p{{N}}_]+')))::double / len(aw) >= 0.35 AND NOT {_ANY('question', legal.TRIVIAL_QUESTION)} AND NOT {_ANY('answer', legal.NO_ANSWER)}) SELECT min(id) AS id FROM ok GROUP BY key")
def qa_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What generation keeps of question-answer pairs: grounded, not trivial, each question once."""
    p = pairs(spark, sf_dir).select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "question", "answer", F.concat_ws(" ", "question", F.when(F.col("conv_id") % 2 == 0, F.col("answer")).otherwise("")).alias("context"))
    return generate.accepted(p).select("id")


@query("WITH f AS (SELECT vec_id, [(vec_id * 7 + 3) % 500, vec_id, (vec_id * 11 + 5) % 500, (vec_id * 13) % 500] AS ids FROM embeddings), x AS (SELECT vec_id, unnest(generate_series(1, 3))::bigint AS i, unnest(list_slice(ids, 1, 3)) AS id FROM f), j AS (SELECT x.vec_id, i, id FROM x JOIN embeddings e ON e.vec_id = x.id WHERE id <> x.vec_id AND e.label <> 0) SELECT vec_id, arg_min(id, i) AS negative FROM j GROUP BY 1")
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first usable of three listed negatives of each row."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    v = F.col("vec_id")
    ids = e.select(v, F.posexplode(F.slice(F.array((v * 7 + 3) % 500, v, (v * 11 + 5) % 500, (v * 13) % 500), 1, 3)).alias("i", "id"))
    usable = ids.join(e.select(F.col("vec_id").alias("id"), "label"), "id").filter("id <> vec_id AND label <> 0")
    return usable.groupBy("vec_id").agg(F.min_by("id", "i").alias("negative"))


SPLIT = f"CASE WHEN {h32('42', 'source')} % 1000 < 800 THEN 'train' WHEN {h32('42', 'source')} % 1000 < 900 THEN 'dev' ELSE 'test' END"


@query(f"SELECT doc_id, {SPLIT} AS split FROM documents")
def group_split_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", splits.hash_split(F.col("source")).alias("split"))


@query()
def group_split_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.greedy_split(table(spark, sf_dir, "documents").select("doc_id", "source"), "source").select("doc_id", "source", "split")


@query(f"SELECT count(*)::bigint AS straddling FROM (SELECT source FROM (SELECT source, {SPLIT} AS split FROM documents) GROUP BY source HAVING count(DISTINCT split) > 1)")
def split_leak_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", splits.hash_split(F.col("source")).alias("split"))
    return d.groupBy("source").agg(F.countDistinct("split").alias("n")).filter("n > 1").agg(F.count(F.lit(1)).alias("straddling"))


@query("SELECT source, lang, count(*)::bigint AS n FROM documents GROUP BY ALL")
def split_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT doc_id, quality, CASE WHEN row_number() OVER (PARTITION BY quality ORDER BY {h32('42', 'doc_id')}, doc_id) <= greatest(1, floor(count(*) OVER (PARTITION BY quality) * 0.1)) THEN 'val' ELSE 'train' END AS part FROM labels")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.stratified(table(spark, sf_dir, "labels").select("doc_id", "quality"), "quality", 0.1, "doc_id").select("doc_id", "quality", "part")


@query(f"SELECT {SPLIT} AS split, count(*)::bigint AS rows, count(DISTINCT source)::bigint AS groups, bit_xor({h32('doc_id', 'text')})::bigint AS digest FROM documents GROUP BY 1")
def split_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, groups and an order-free digest of each split."""
    d = table(spark, sf_dir, "documents").withColumn("split", splits.hash_split(F.col("source")))
    return splits.split_meta(d, "split", "source", ["doc_id", "text"])


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) > floor(count(*) OVER () * 0.9) THEN 'validation' ELSE 'train' END AS part FROM documents")
def tail_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last tenth in order of ids is for validation."""
    return splits.tail_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id").select("doc_id", "part")


@query("SELECT doc_id AS id, quality, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'old' END AS config FROM labels")
def overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of one run laid over those of another."""
    l = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality")
    return splits.overlay(l.withColumn("config", F.lit("old")), l.filter("id % 3 = 0").withColumn("config", F.lit("new")), "id")


MIX = f"{h32('42', 'doc_id')} % 1000"


@query(f"SELECT doc_id, CASE WHEN source = 'src0' THEN 'raw' WHEN {MIX} < 500 THEN 'card' WHEN {MIX} < 900 THEN 'raw' ELSE 'none' END AS form FROM documents")
def format_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form of each row's context: half cards, four tenths raw, the rest without; one kind always keeps it."""
    at = tx.stable_hash(F.lit(42), F.col("doc_id")) % 1000
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("source") == "src0", "raw").when(at < 500, "card").when(at < 900, "raw").otherwise("none").alias("form"))


@query("SELECT conv_id, md5(string_agg(concat('<|', role, '|>', chr(10), trim(text)), chr(10) ORDER BY turn)) AS prompt, count(*)::bigint AS turns FROM conversations GROUP BY conv_id")
def prompt_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    turns = F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("<|"), "role", F.lit("|>\n"), F.trim("text")).alias("t"))))
    return c.groupBy("conv_id").agg(F.md5(F.array_join(F.transform(turns, lambda x: x["t"]), "\n")).alias("prompt"), F.count(F.lit(1)).alias("turns"))


@query("WITH r AS (SELECT unnest([5, 25, 26, 27, 28]) AS id) SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT id FROM r)")
def exclude_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.exams import excluded

    return table(spark, sf_dir, "documents").select("doc_id").join(excluded(spark, "5,25->28"), F.col("doc_id") == F.col("id"), "left_anti")


@query("SELECT sum((text IS NULL OR trim(text) = '')::int)::bigint AS empty, sum((doc_id IS NULL)::int)::bigint AS unlabeled, sum((l.doc_id IS NOT NULL AND d.doc_id IS NULL)::int)::bigint AS unknown, count(*)::bigint AS n FROM (SELECT doc_id, toxic FROM labels) l FULL JOIN documents d USING (doc_id)".replace("(doc_id IS NULL)", "(l.doc_id IS NULL)").replace("(text IS NULL OR trim(text) = '')", "(d.text IS NULL OR trim(d.text) = '')"))
def validate_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of rows with empty text, without label, and of labels for unknown documents."""
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("lid"))
    j = table(spark, sf_dir, "documents").join(lab, F.col("doc_id") == F.col("lid"), "full")
    flag = lambda c: F.sum(c.cast("int"))
    return j.agg(flag(F.col("text").isNull() | (F.trim("text") == "")).alias("empty"), flag(F.col("lid").isNull()).alias("unlabeled"), flag(F.col("lid").isNotNull() & F.col("doc_id").isNull()).alias("unknown"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {TOKS}, d AS (SELECT conv_id, turn, list_distinct(p) AS p, list_distinct(r) AS r FROM tp) SELECT conv_id, turn, round(CASE WHEN len(p) + len(r) > 0 THEN len(list_intersect(p, r))::double / len(list_distinct(list_concat(p, r))) ELSE 0 END, 6) AS jaccard FROM d")
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select(*KEY, F.round(tx.jaccard(F.array_distinct("p"), F.array_distinct("r")), 6).alias("jaccard"))


@query(f"""WITH {TOKS}, a AS (SELECT conv_id, turn, t, count(*) AS n FROM (SELECT conv_id, turn, unnest(p) AS t FROM tp) GROUP BY ALL), b AS (SELECT conv_id, turn, t, count(*) AS n FROM (SELECT conv_id, turn, unnest(r) AS t FROM tp) GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM a GROUP BY 1), n AS (SELECT count(*) AS n FROM tp), w AS (SELECT t, ln((n + 1) / (df + 0.5)) + 1 AS w FROM df, n), d AS (SELECT conv_id, turn, sum(a.n * b.n * w * w) AS d FROM a JOIN b USING (conv_id, turn, t) JOIN w USING (t) GROUP BY ALL),
x AS (SELECT conv_id, turn, sqrt(sum(n * n * w * w)) AS x FROM a JOIN w USING (t) GROUP BY ALL), y AS (SELECT conv_id, turn, sqrt(sum(n * n * w * w)) AS y FROM b JOIN w USING (t) GROUP BY ALL) SELECT conv_id, turn, round(d / (x * y), 6) AS cosine FROM d JOIN x USING (conv_id, turn) JOIN y USING (conv_id, turn)""")
def tfidf_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir)
    count = lambda c, n: p.select(*KEY, F.explode(c).alias("t")).groupBy(*KEY, "t").agg(F.count(F.lit(1)).alias(n))
    a, b = count("p", "na"), count("r", "nb")
    total = p.agg(F.count(F.lit(1)).alias("n"))  # one row
    w = a.groupBy("t").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(total)).select("t", (F.log((F.col("n") + 1) / (F.col("df") + 0.5)) + 1).alias("w"))
    met = a.join(b, [*KEY, "t"], "full").join(w, "t")
    sq = F.col("w") * F.col("w")
    s = met.groupBy(*KEY).agg(F.sum(F.col("na") * F.col("nb") * sq).alias("d"), F.sqrt(F.sum(F.col("na") * F.col("na") * sq)).alias("x"), F.sqrt(F.sum(F.col("nb") * F.col("nb") * sq)).alias("y"))
    return s.filter("d is not null").select(*KEY, F.round(F.col("d") / (F.col("x") * F.col("y")), 6).alias("cosine"))
