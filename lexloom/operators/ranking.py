"""Rank fusion, neighbours and order of results: one plan for all queries of a batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RRF_K = 60


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a)) / F.sqrt(dot(b, b))


def top(df: DataFrame, k: int, by: str, score: Column, *ties: Column) -> DataFrame:
    """The k best rows of each ``by`` with their 1-based rank; rows are cut before the shuffle."""
    ranked = df.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(score.desc(), *ties)).cast("long"))
    return ranked.filter(F.col("rank") <= k)


def dealt_anew(union: DataFrame, *keys: str) -> DataFrame:
    """A union dealt by its keys. Where all parts of a union are dealt by one key, the planner may take the union to be
    dealt by it too, though adaptive execution has coalesced each part in its own way, and then rows of a key are
    grouped apart; an exchange of its own settles it."""
    return union.repartition(*keys)


def rrf(lists: Sequence[tuple[DataFrame, str, float]], k: int = RRF_K, top_m: int | None = None) -> DataFrame:
    """Weighted reciprocal-rank fusion of (rows of query_id, doc, rank; name; weight): query_id, doc, score, parts, rank."""
    union = None
    for df, name, weight in lists:
        if weight > 0:
            one = df.select("query_id", "doc", F.lit(name).alias("list"), (F.lit(float(weight)) / (k + F.col("rank"))).alias("part"))
            union = one if union is None else union.unionByName(one)
    parts = F.map_from_entries(F.collect_list(F.struct("list", F.round("part", 8))))
    union = dealt_anew(union, "query_id", "doc")
    scores = union.groupBy("query_id", "doc").agg(F.round(F.sum("part"), 8).alias("score"), parts.alias("parts"))
    return top(scores, top_m or 1 << 30, "query_id", F.col("score"), F.col("doc"))
