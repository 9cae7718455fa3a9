"""Corpus scans, cleaning, gates and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import legal
from ..functions import text as tx
from ..operators import quality, structure
from ..registry import query, table
from .sql import tok



def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as chunks."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "text")).select("doc_id", F.col("p").cast("long").alias("pos"), "text")


@query(r"""SELECT doc_id, lang, source, length(t)::bigint AS chars FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t FROM documents) WHERE length(t) >= 500""")
def scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("t", tx.normalize(F.col("text")))
    return docs.filter(F.char_length("t") >= 500).select("doc_id", "lang", "source", F.char_length("t").cast("long").alias("chars"))


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM documents""")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.normalize(F.col("text"))).alias("digest"))


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM documents""")
def unicode_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.clean_unicode(F.col("text"))).alias("digest"))


@query("SELECT doc_id, md5(trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', '_', 'g'), '_')) AS digest FROM documents")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.slug(F.col("text"))).alias("digest"))


#: Every ninth document speaks of the topic, every eleventh of superseded law; every thirteenth has a title on the topic.
TOPICAL = "SELECT doc_id, concat(text, CASE WHEN doc_id % 9 = 0 THEN ' Nồng độ CỒN' ELSE '' END, CASE WHEN doc_id % 11 = 0 THEN ' bản DỰ THẢO' ELSE '' END) AS text, CASE WHEN doc_id % 13 = 0 THEN 'Luật Đường bộ' ELSE 'Văn bản' END AS title FROM documents"
_HAS = lambda c, terms: "(" + " OR ".join(f"contains(lower({c}), '{t.lower()}')" for t in terms) + ")"


def topical(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    text = F.concat("text", F.when(i % 9 == 0, " Nồng độ CỒN").otherwise(""), F.when(i % 11 == 0, " bản DỰ THẢO").otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"), F.when(i % 13 == 0, "Luật Đường bộ").otherwise("Văn bản").alias("title"))


@query(f"SELECT doc_id, {_HAS('title', legal.TITLE_KEYWORDS)} AS by_title FROM ({TOPICAL}) WHERE {_HAS('title', legal.TITLE_KEYWORDS)} OR {_HAS('text', legal.CONTENT_KEYWORDS)}")
def keyword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = topical(spark, sf_dir).filter(legal.on_topic(F.col("title"), F.col("text")))
    return kept.select("doc_id", tx.contains_any(F.col("title"), legal.TITLE_KEYWORDS).alias("by_title"))


@query("SELECT lang, source, count(*)::bigint AS n, sum(n_chars)::bigint AS chars FROM documents GROUP BY ROLLUP (lang, source)")
def corpus_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").rollup("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT min(doc_id) AS doc_id, sha256(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS digest, count(*)::bigint AS copies FROM documents GROUP BY sha256(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))")
def dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(tx.strip(F.col("text")), 256).alias("digest"))
    return docs.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query(f"SELECT term, count(DISTINCT doc_id)::bigint AS df, count(*)::bigint AS cf FROM (SELECT doc_id, unnest({tok('text')}) AS term FROM documents) GROUP BY term")
def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.term_stats(docs.select("doc_id", F.explode(tx.tokens(F.col("text"))).alias("term"))).select("term", "df", "cf")


@query("SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(trim(x), '^\\d{1,4}$') AND NOT starts_with(upper(trim(x)), 'CÔNG BÁO')), chr(10)) AS text FROM documents")
def clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", structure.clean_lines(F.col("text")).alias("text"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->|<[^>]+>', ' ', 'g'), '[\s\p{Z}]+', ' ', 'g')) AS text FROM pages""")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.web import html_text

    return table(spark, sf_dir, "pages").select("page_id", html_text(F.col("html")).alias("text"))


@query(r"""WITH blocks AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<(?:p|article|main|div|section)[^>]*>([^<]*)', 1)) AS b FROM pages), t AS (SELECT page_id, trim(regexp_replace(b, '[\s\p{Z}]+', ' ', 'g')) AS text FROM blocks)
SELECT page_id, max(length(text))::bigint AS chars, arg_max(text, (length(text), text)) AS text FROM t GROUP BY page_id""")
def page_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.web import main_block

    return main_block(table(spark, sf_dir, "pages"))


@query("SELECT event_id, CASE WHEN event_id % 5 < 4 THEN (props::json->>'$.k')::bigint ELSE -1 END AS k FROM events")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of JSON inside fences, inside talk, as it stands, and cut off, which gives none (-1)."""
    e, p = F.col("event_id") % 5, F.col("props")
    said = F.when(e == 0, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(e == 1, F.concat(F.lit("Here it is: "), p, F.lit(" as asked."))).when(e == 2, F.concat(F.lit("```\n"), p, F.lit("```"))).when(e == 3, p).otherwise(F.concat(F.lit("{"), p))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.get_json_object(tx.json_salvage(said), "$.k").cast("long"), F.lit(-1)).cast("long").alias("k"))


@query("SELECT source, count(*)::bigint AS documents, sum(length(text))::bigint AS chars, min(sha256(text)) AS first_digest, max(sha256(text)) AS last_digest FROM documents GROUP BY source")
def kb_build_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", "text", F.sha2("text", 256).alias("d"))
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.char_length("text")).alias("chars"), F.min("d").alias("first_digest"), F.max("d").alias("last_digest"))


@query(f"SELECT avg({_HAS('text', legal.FORBIDDEN_TERMS)}::int)::double AS rate, count(*)::bigint AS n FROM ({TOPICAL})")
def forbidden_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = tx.contains_any(F.col("text"), legal.FORBIDDEN_TERMS).cast("int")
    return topical(spark, sf_dir).agg(F.avg(hit).alias("rate"), F.count(F.lit(1)).alias("n"))


CENTROID = "c AS (SELECT i, avg(v::double) AS m FROM (SELECT generate_subscripts(embedding, 1) AS i, unnest(embedding) AS v FROM embeddings) GROUP BY i)"


@query(f"WITH {CENTROID} SELECT i::bigint AS dim, round(m, 6) AS mean FROM c")
def centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.posexplode("embedding").alias("p", "v"))
    return e.groupBy((F.col("p") + 1).cast("long").alias("dim")).agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("mean"))


@query(f"WITH {CENTROID}, d AS (SELECT vec_id, sum(v::double * m) / sqrt(sum(v::double * v::double)) / (SELECT sqrt(sum(m * m)) FROM c) AS cos FROM (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS v FROM embeddings) JOIN c USING (i) GROUP BY vec_id) SELECT vec_id, round(cos, 5) AS cosine, label = 3 OR round(cos, 5) >= 0.1 AS near FROM d JOIN embeddings USING (vec_id)")
def centroid_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    mean = e.select(F.posexplode("embedding").alias("p", "v")).groupBy("p").agg(F.avg(F.col("v").cast("double")).alias("m"))
    one = mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "m"))), lambda x: x["m"]).alias("center"))  # as long as a vector
    return quality.topic_gate(e, F.col("label") == 3, "embedding", one, 0.1).select("vec_id", "cosine", "near")
