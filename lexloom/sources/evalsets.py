"""Evaluation sets: which file is read, and what its rows must have."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.splits import tail_split

SCHEMA = "id long, question string, answer string, context string, category string, doc_id string, expected_doc_ids array<string>, gold_article_numbers array<string>"


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The JSON lines at a path; None if nothing is there."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    return None


def eval_set(spark: SparkSession, explicit: str | None = None, known: Sequence[str] = (), pairs: str | None = None, first: int | None = None, seed: int = 42, ratio: float = 0.1, schema: str = SCHEMA) -> DataFrame:
    """The set that is named, else the first of the known ones that is there, else the last tenth of the pairs in a seeded order.

    A named set that isn't there raises; so does a call that finds none."""
    if explicit is not None:
        rows = read_lines(spark, explicit, schema)
        if rows is None:
            raise FileNotFoundError(explicit)
    else:
        rows = next((r for r in (read_lines(spark, p, schema) for p in known) if r is not None), None)
        if rows is None:
            rows = read_lines(spark, pairs, schema) if pairs else None
            if rows is None:
                raise FileNotFoundError("no evaluation set and no pairs")
            placed = rows.withColumn("_place", F.concat(F.lpad(tx.stable_hash(F.lit(seed), F.col("question")).cast("string"), 10, "0"), F.coalesce("question", F.lit(""))))
            rows = tail_split(placed, "_place", ratio).filter("part = 'validation'").drop("_place", "part")
    return rows if first is None else rows.limit(first)


def expected_ids(rows: DataFrame) -> DataFrame:
    """``rows`` with ``expected``: the listed documents without empty names, else the row's own document."""
    listed = F.filter(F.coalesce("expected_doc_ids", F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
    return rows.withColumn("expected", F.when(F.size(listed) > 0, listed).when(F.length("doc_id") > 0, F.array("doc_id")).otherwise(F.array().cast("array<string>")))


def validate(rows: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row of counts, doc_id and rows of each expected document that isn't known). rows: category, expected; known: doc_id."""
    unsupported, some = F.col("category").eqNullSafe("unsupported"), F.size("expected") > 0
    count = lambda c: F.sum(c.cast("int"))
    counts = rows.agg(
        F.count(F.lit(1)).alias("n"),
        count(F.coalesce(F.col("category"), F.lit("")) == "").alias("missing_category"),
        count(~unsupported & ~some).alias("supported_without_expected"),
        count(unsupported & some).alias("unsupported_with_expected"),
        count(~unsupported & some).alias("measurable"),
    )
    named = rows.select(F.explode(F.array_distinct("expected")).alias("doc_id"))
    return counts, named.join(known.select("doc_id").distinct(), "doc_id", "left_anti").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"))
