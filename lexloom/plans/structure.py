"""Structural chunking, spans and field extraction."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import legal
from ..functions import text as tx
from ..operators import structure
from ..registry import query, table
from . import kb
from .sql import LINES


@query("SELECT doc_id, s::bigint AS start, md5(substr(text, s + 1, 1600)) AS digest FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(length(text) - 1, 0), 1420)) AS s FROM documents)")
def sliding_char_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.windows(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "start", F.md5("text").alias("digest"))


@query()
def split_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..shipping import ship

    ship(spark)
    return structure.split_long(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query()
def split_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..shipping import ship

    ship(spark)
    return structure.split_long(table(spark, sf_dir, "documents").select("doc_id", "text"), most=0, size=400, overlap=60)


@query(r"WITH s AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(trim(text), '[\s]+', ' ', 'g'), '([.!?;:])\s+', '\1' || chr(1), 'g'), chr(1)) AS l FROM documents), x AS (SELECT doc_id, unnest(generate_series(1, len(l)))::bigint AS span, trim(unnest(l)) AS t FROM s) SELECT doc_id, span, md5(t) AS digest FROM x WHERE t <> ''")
def split_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence spans: split after end marks, where no numbered structure is there."""
    parts = F.split(tx.compact(F.col("text")), r"(?<=[.!?;:])\s+")
    s = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(parts).alias("p", "t"))
    return s.filter(F.trim("t") != "").select("doc_id", (F.col("p") + 1).cast("long").alias("span"), F.md5(F.trim("t")).alias("digest"))


@query(f"WITH {kb.KX}, c AS (SELECT doc_id, a, r, t, last_value(CASE WHEN r IN (2, 5) THEN concat(left(t, 2), ' ', regexp_extract(t, 'Phạt tiền từ [0-9.]+ đồng đến [0-9.]+ đồng', 0)) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS head FROM ky) SELECT doc_id, a + 1 AS article, r, md5(CASE WHEN r IN (3, 4, 6, 7) THEN concat(head, ' ', t) ELSE t END) AS digest FROM c")
def clause_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points carry the number and fine of the clause that they stand under."""
    l = kb.laws(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "t")).filter("p > 0").withColumn("pos", F.col("p") - 1)
    head = F.when(F.col("t").rlike(structure.CLAUSE_NO), F.concat_ws(" ", F.regexp_extract("t", r"^(\d+\.)", 1), F.regexp_extract("t", r"Phạt tiền từ [\d.]+ đồng đến [\d.]+ đồng", 0)))
    w = W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    c = l.withColumn("head", F.last(head, ignorenulls=True).over(w))
    text = F.when(F.col("t").rlike(structure.POINT_NO), F.concat_ws(" ", "head", "t")).otherwise(F.col("t"))
    return c.select("doc_id", (F.floor(F.col("pos") / 8) + 1).cast("long").alias("article"), (F.col("pos") % 8).cast("long").alias("r"), F.md5(text).alias("digest"))


AMOUNTS = "SELECT o_orderkey AS id, o_custkey % 900 + 100 AS k, o_orderkey % 6 AS f FROM orders"


@query(f"SELECT id, CASE f WHEN 1 THEN (k % 9 + 1) * 1000000 WHEN 3 THEN k * 1000000 + 250000 WHEN 4 THEN 0 ELSE k * 1000 END::bigint AS vnd FROM ({AMOUNTS})")
def parse_vnd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts in six spellings, made of order and customer numbers."""
    k = F.col("o_custkey") % 900 + 100
    text, f = k.cast("string"), F.col("o_orderkey") % 6
    said = F.when(f == 0, F.concat(text, F.lit(".000"))).when(f == 1, F.concat((k % 9 + 1).cast("string"), F.lit(",5"))).when(f == 2, text).when(f == 3, F.concat(text, F.lit(".250.000"))).when(f == 4, F.concat(F.lit("abc"), text)).otherwise(F.concat(text, F.lit(".")))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), legal.vnd(said).cast("long").alias("vnd"))


FINES = "SELECT o_orderkey AS id, concat('Mức: phạt tiền từ ', o_custkey, '.000 đồng đến ', o_custkey + 100, '.000 đồng; trừ ', o_custkey % 9, ' điểm') AS t FROM orders"


def fines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_custkey")
    text = F.concat(F.lit("Mức: phạt tiền từ "), k.cast("string"), F.lit(".000 đồng đến "), (k + 100).cast("string"), F.lit(".000 đồng; trừ "), (k % 9).cast("string"), F.lit(" điểm"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", text.alias("t"))


@query(f"SELECT id, concat('phạt tiền từ ', regexp_extract(t, 'từ ([0-9.]+) đồng', 1), ' đồng đến ', regexp_extract(t, 'đến ([0-9.]+) đồng', 1), ' đồng') AS fine, regexp_extract(t, 'trừ ([0-9]+) điểm', 1) AS points FROM ({FINES})")
def fine_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fines(spark, sf_dir).select("id", legal.fine_phrase(F.col("t")).alias("fine"), legal.deducted(F.col("t")).alias("points"))


@query("SELECT o_orderkey AS id, (o_custkey <= CASE WHEN o_orderkey % 2 = 0 THEN 500 ELSE 400 END * 1.15 AND o_custkey + 100 >= 400 * 0.85) AS hit FROM orders WHERE o_custkey >= 100 AND o_custkey < 1000 - 100")
def fine_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fines against a gold range; odd orders have no maximum, so that it is the minimum. The SQL's 1.15 and 0.85 are decimals."""
    f = fines(spark, sf_dir).filter("o_custkey >= 100 AND o_custkey < 900")
    return f.select("id", legal.fine_matches(F.lit("400.000"), F.when(F.col("id") % 2 == 0, "500.000"), F.col("t"), Decimal("0.15")).alias("hit"))


@query("SELECT doc_id, list_sort(CASE doc_id % 4 WHEN 0 THEN [concat(n, '/2024'), concat(n, '-2024'), concat('nghị định ', n), concat(n, '/2024/nđ-cp'), concat(n, '/2024/nd-cp')] WHEN 1 THEN [concat(n, '/2024'), concat(n, '-2024'), concat('thông tư ', n)] WHEN 2 THEN [concat(n, '/2024'), concat(n, '-2024'), concat('luật ', n), 'luật đường bộ'] ELSE [concat(n, '/2024'), concat(n, '-2024'), concat('qcvn ', n), 'quy chuẩn báo hiệu'] END) AS aliases FROM (SELECT doc_id, (doc_id % 5000)::varchar AS n FROM documents)")
def doc_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of decrees, circulars, laws and standards, numbered by the documents' ids."""
    i, n = F.col("doc_id") % 4, (F.col("doc_id") % 5000).cast("string")
    key = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("nd_", "tt_", "luat_", "qcvn_")]), (i + 1).cast("int")), n, F.lit("_2024"))
    title = F.when(i == 0, F.concat(F.lit("Nghị định "), n, F.lit("/2024/NĐ-CP"))).when(i == 1, "Quy định").when(i == 2, "Luật Đường bộ").otherwise("Quy chuẩn báo hiệu")
    return table(spark, sf_dir, "documents").select("doc_id", legal.aliases(key, title).alias("aliases"))


SAID = [*legal.LEGAL_TERMS, "phục hồi điểm", "12 điểm được phục hồi khi nào", "vỉa hè", "khi nào có hiệu lực", "người ngồi sau", "", "thời tiết hôm nay"]
_Q = f"lower(concat(text, ' ', list_extract([{', '.join(f"'{x}'" for x in SAID)}], (item_id % {len(SAID)})::int + 1)))"


def _intent_sql() -> str:
    has = lambda t: f"contains(q, '{t}')"
    pair = lambda n: f"({has(legal.PAIRED_INTENTS[n][0])} OR ({has(legal.PAIRED_INTENTS[n][1][0])} AND {has(legal.PAIRED_INTENTS[n][1][1])}))"
    tests = [f"CASE WHEN {pair(n) if n in legal.PAIRED_INTENTS else ' OR '.join(map(has, terms))} THEN '{n}' END" for n, terms in legal.INTENTS.items()]
    return f"SELECT query_id, list_filter([{', '.join(tests)}], lambda x: x IS NOT NULL) AS intents FROM (SELECT item_id AS query_id, {_Q} AS q FROM benchmark)"


def spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that each say one of the terms that people use."""
    term = F.element_at(F.array(*[F.lit(x) for x in SAID]), (F.col("item_id") % len(SAID) + 1).cast("int"))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat_ws(" ", "text", term).alias("question"))


@query(_intent_sql())
def intent_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spoken(spark, sf_dir).select("query_id", legal.intents(F.col("question")).alias("intents"))


@query()
def domain_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with the phrases of their intents and terms; each phrase hangs on those before it, so tests hold it against a loop."""
    return spoken(spark, sf_dir).select("query_id", legal.expand_domain(F.col("question")).alias("expanded"))


_CLIP = lambda t, n: f"CASE WHEN length({t}) <= {n} THEN {t} ELSE concat(trim(regexp_replace(left({t}, {n}), ' [^ ]*$', '')), ' ...') END"
CARD = f"""concat_ws(chr(10), 'EVIDENCE_CARD', concat('Căn cứ: ', doc_id, ' Điều ', a + 1, ' khoản ', c, CASE WHEN points > 0 THEN ' điểm a' ELSE '' END), concat('Điều luật: ', {_CLIP('title', 180)}), concat('Mức phạt: ', fine), concat('Kết luận tiền phạt: ', fine),
CASE WHEN points >= 2 THEN concat('Trừ điểm: ', a % 9 + 1, ' điểm') END, concat('Hành vi/điều kiện liên quan: ', CASE WHEN points > 0 THEN {_CLIP('point', 320)} ELSE {_CLIP('said', 320)} END), 'Chỉ trả lời bằng kết luận ngắn gọn từ các trường trên; không chép lại thẻ.')"""


@query(f"WITH {kb.KX}, p AS (SELECT doc_id, a, c, CASE WHEN count(*) > 1 THEN regexp_replace(arg_min(substr(t, 4), r), '\\.$', '') ELSE arg_min(substr(t, 4), r) END AS point FROM kp GROUP BY ALL), cd AS (SELECT kc.doc_id, a, c, title, points, lower(left(regexp_extract(lead, 'Phạt tiền từ [0-9.]+ đồng đến [0-9.]+ đồng', 0), 1)) || substr(regexp_extract(lead, 'Phạt tiền từ [0-9.]+ đồng đến [0-9.]+ đồng', 0), 2) AS fine, point, lead AS said FROM kc JOIN ka USING (doc_id, a) LEFT JOIN p USING (doc_id, a, c)) SELECT doc_id, (a + 1)::varchar AS article_number, c::varchar AS clause_number, md5({CARD}) AS card FROM cd")
def evidence_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The card of every clause chunk for a question without a shared word: the first clause with a fine and the first point."""
    from ..operators.evidence import card

    c = kb.law_chunks(spark, sf_dir).filter("legal_block = 'clause'")
    return c.select("doc_id", "article_number", "clause_number", F.md5(card(F.lit("?"), F.col("text"), F.col("doc_id"))).alias("card"))


EXAM = rf"{LINES}, ex AS (SELECT doc_id, pos, pos // 6 + 1 AS q, pos % 6 AS r, trim(regexp_replace(text, '[\s\p{{Z}}]+', ' ', 'g')) AS x FROM lines)"


@query(f"WITH {EXAM} SELECT doc_id, q::varchar AS number, md5(string_agg(CASE r WHEN 0 THEN concat('Câu ', q, '. ', x) ELSE concat('tiếp ', x) END, ' ' ORDER BY pos) FILTER (WHERE r < 2)) AS question, count(*) FILTER (WHERE r >= 2) AS choices, md5(string_agg(concat(r - 1, '. ', x), '|' ORDER BY pos) FILTER (WHERE r >= 2)) AS said, CASE WHEN doc_id % 5 > 0 AND max(r) > doc_id % 5 THEN chr((64 + doc_id % 5)::int) END AS answer, count(*) FILTER (WHERE r >= 2) >= 2 AND doc_id % 5 > 0 AND max(r) > doc_id % 5 AS valid FROM ex GROUP BY doc_id, q")
def parse_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exam questions made of the documents' lines, six a question; choice doc_id % 5 is underlined, none for 0."""
    from .corpus import lines

    l = lines(spark, sf_dir).withColumn("x", tx.compact(F.col("text"))).withColumn("r", F.col("pos") % 6)
    head = F.concat(F.lit("Câu "), (F.floor(F.col("pos") / 6) + 1).cast("string"), F.lit(". "), "x")
    text = F.when(F.col("r") == 0, head).when(F.col("r") == 1, F.concat(F.lit("tiếp "), "x")).otherwise(F.concat((F.col("r") - 1).cast("string"), F.lit(". "), "x"))
    rows = l.select("doc_id", "pos", text.alias("text"), ((F.col("r") >= 2) & (F.col("r") - 1 == F.col("doc_id") % 5)).alias("underlined"))
    b = structure.question_blocks(rows)
    return b.select("doc_id", "number", F.md5("question").alias("question"), F.size("choices").cast("long").alias("choices"), F.when(F.size("choices") > 0, F.md5(F.array_join("choices", "|"))).alias("said"), "answer", "valid")
