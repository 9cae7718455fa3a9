"""The whole way from texts to figures: build the base, make pairs, filter and split them, retrieve and evaluate.

Each stage writes a table below ``out`` and reads what the stages before wrote, so a run can start anywhere.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import legal
from .operators import generate, quality, search, splits, structure
from .shipping import ship
from .sources import manifest, reports


@dataclasses.dataclass(frozen=True)
class Stages:
    """Which stages run; what a stage left is read where it doesn't."""

    rebuild: bool = True
    regenerate: bool = True
    evaluate: bool = True


def build(spark: SparkSession, docs: DataFrame, out: str) -> DataFrame:
    """docs: doc_id, title, text. Chunks past the gate with their ids, saved with a record of their sources."""
    ship(spark)
    gated = quality.quality_gate(structure.chunks(docs), ["doc_id", "place"], legal.FORBIDDEN_TERMS)
    kept = quality.with_chunk_ids(gated.filter("reason = 'keep'"), ["place"]).drop("reason")
    titled = kept.join(docs.select("doc_id", "title"), "doc_id")
    manifest.save_base(titled, docs.select("doc_id", "text"), f"{out}/base")
    return manifest.load_base(spark, f"{out}/base")


def pairs(base: DataFrame, out: str, ask: Callable[[DataFrame, generate.Phase], DataFrame], plan: Sequence[generate.Phase], seed: int = 42) -> DataFrame:
    """Question-answer pairs by phases, with negatives, filtered, and split so that no article is on two sides: id,
    question, answer, context, corpus, doc_id, split."""
    spark = base.sparkSession
    generate.generate(base, ask, f"{out}/raw_pairs", plan)
    raw = spark.read.schema("id string, question string, answer string, context string, phase string, corpus string").json(f"{out}/raw_pairs")
    own = raw.join(base.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("context")).dropDuplicates(["context"]), "context").select("id", "question", "answer", "context", "corpus", "doc_id")
    chunks = base.withColumn("doc_id", F.col("doc_id").cast("string")).select("doc_id", "place", "text")
    wrong = generate.negatives(own, chunks, "doc_id", seed).select("id", "question", "answer", "context", "corpus", F.col("other").alias("doc_id"))
    flagged = quality.qa_flags(own.unionByName(wrong)).filter("NOT (long_answer OR self_referring)").drop("long_answer", "self_referring")
    article = F.regexp_extract(legal.infer_article(F.col("context")), r"Điều\s+(\d+)", 1)
    flagged.withColumn("split", splits.hash_split(F.concat_ws("|", "doc_id", article), seed=seed)).write.mode("overwrite").parquet(f"{out}/pairs")
    return spark.read.parquet(f"{out}/pairs")


def evaluate(base: DataFrame, test: DataFrame, out: str, k: int = 5, embed: Callable[[Column], Column] | None = None) -> dict:
    """Retrieval figures over the positives of a split, written as a report: source recall and reciprocal rank of the right document."""
    chunks = base.select(F.col("chunk_id").alias("doc"), F.col("doc_id").cast("string").alias("doc_id"), "article_number", "ord", "text")
    asked = test.filter("corpus = 'local_text'").select(F.col("id").alias("query_id"), "question", "doc_id")
    found = search.retrieve(chunks, asked, k, embed=embed).join(chunks.select("doc", F.col("doc_id").alias("got")), "doc")
    first = asked.join(found, "query_id", "left").groupBy("query_id").agg(F.min(F.when(F.col("got") == F.col("doc_id"), F.col("rank"))).alias("first"))
    figures = first.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("first").isNotNull().cast("double")).alias("source_recall"), F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"))
    report = reports.summary(figures)
    reports.write_report(base.sparkSession, report, f"{out}/report")
    return report


def run(spark: SparkSession, docs: DataFrame, out: str, ask: Callable[[DataFrame, generate.Phase], DataFrame], plan: Sequence[generate.Phase] | None = None, stages: Stages = Stages()) -> dict | None:
    base = build(spark, docs, out) if stages.rebuild else manifest.load_base(spark, f"{out}/base")
    made = pairs(base, out, ask, plan or generate.phases()) if stages.regenerate else spark.read.parquet(f"{out}/pairs")
    return evaluate(base, made.filter("split = 'test'"), out) if stages.evaluate else None
