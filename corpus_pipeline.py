"""Corpus pipeline: language filter, exact and near deduplication, source mix, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns the columns of
``documents``; the last returns the packed pieces.

Rows are told apart by id and whole text, in the mix by source too, never by id alone. Defined results for all
stages: a null text is empty; null ids are ids like any other; rows that repeat what tells rows apart are one
document, shown by the smallest of them in the order of its columns; a very long text travels once a shuffle and
else as its digest; an empty table stays empty; further columns, whatever their names, are kept as they are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import drop_scratch, drop_table, scratch_mark, shared_dir, text_of
from lexloom.llm.exact_dedup import exact_dedup
from lexloom.llm.language_id import accepted_language
from lexloom.llm.mixing import mix_sources
from lexloom.llm.ngram_join import ngram_jaccard_join
from lexloom.llm.packing import pack

#: Not expressible in SQL (compression, MinHash classes, tokenisation); tests hold each stage against brute force.
ORACLE_SQL = None


def row_key(*parts: Column) -> Column:
    """128 bits over the parts, null apart from any text."""
    marked = [F.coalesce(F.concat(F.lit("="), F.hex(F.encode(p.cast("string"), "UTF-8"))), F.lit("")) for p in parts]
    return F.unhex(F.md5(F.encode(F.concat_ws("|", *marked), "UTF-8")))


def chosen(docs: DataFrame, key: Column, decided: DataFrame) -> DataFrame:
    """For each row (key, times) of ``decided`` the document with that key, ``times`` times.

    Rows that repeat a key are reduced to one before the shuffle, so a hot key costs a row a task. Nothing is broadcast:
    ``decided`` has a row a document.
    """
    ordered = not any(k in docs.schema.simpleString() for k in ("map<", "variant"))
    rows = docs.select(key.alias("key"), F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"))
    one = rows.groupBy("key").agg((F.min if ordered else F.first)("row").alias("row"))
    met = one.join(decided.hint("merge"), "key").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return met.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the compression test accepts. Null texts and texts without a letter go; repeated
    rows share their decision and all stay."""
    return accepted_language(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each set of equal texts, the one with the largest id."""
    decided = exact_dedup(docs).filter("kept").select(row_key(F.col("doc_id"), F.col("text_sha256")).alias("key"), F.lit(1).alias("times"))
    return chosen(docs, row_key(F.col("doc_id"), F.sha2(text_of(), 256)), decided)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class: the one with the smallest id, nulls last, then the smallest text digest."""
    found = ngram_jaccard_join(docs, nodes=True)
    first = found.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("x"))
    decided = first.select(row_key(F.col("x.doc_id"), F.hex("x.node")).alias("key"), F.lit(1).alias("times"))
    return chosen(docs, row_key(F.col("doc_id"), F.upper(F.md5(F.encode(text_of(), "UTF-8")))), decided)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, to the nearest whole number; documents not taken go.

    Rows that repeat id, text and source are one document, as often as the mix takes all of them."""
    found = mix_sources(docs, keys=True).filter("size > 0")
    times = F.sum(F.round(F.col("taken") / F.col("size"))).cast("int")
    decided = found.groupBy(row_key(F.col("doc_id"), F.col("source"), F.col("tie")).alias("key")).agg(times.alias("times")).filter("times > 0")
    return chosen(docs, row_key(F.col("doc_id"), F.col("source"), F.xxhash64(text_of())), decided)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens; each row is a document of its own, a null text its end alone."""
    return pack(docs, added=True)


STAGES = [("language ID", language), ("exact dedup", dedup), ("n-gram Jaccard join", near_dedup), ("mixing sources to target weights", mix), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's scratch tables go when its result is written, and that when the next one's is."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        path, mark = f"{shared_dir(spark)}/lexloom-stage{k}-{uuid.uuid4().hex}", scratch_mark()
        stage(spark, docs, sf_dir).write.parquet(path)
        drop_scratch(spark, mark)
        if last:
            drop_table(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs
