"""Running ordinals over a whole table without one task for all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Groups that bounds are drawn from, and buckets between bounds.
SAMPLE, BUCKETS = 4096, 256


def bounds_of(keys: DataFrame, key: str, sample: int = SAMPLE, buckets: int = BUCKETS) -> list:
    """Ascending values that part the keys into buckets of about the same number: from the ``sample`` lowest hashes."""
    drawn = sorted(r[0] for r in keys.select(key).filter(F.col(key).isNotNull()).distinct().orderBy(F.xxhash64(key)).limit(sample).collect())
    step = max(1, len(drawn) // buckets)
    return drawn[step::step]


def numbered(rows: DataFrame, key: str, order: list[Column | str], name: str) -> DataFrame:
    """``rows`` with the 0-based ordinal ``name`` in the order (key, order).

    Each group of ``key`` is numbered on its own; groups are counted, their counts summed up inside buckets of the
    key, and the buckets' totals, one row each, over all. Null keys come first.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    bounds = bounds_of(counts, key)
    at = F.coalesce(F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col(key))), F.lit(-1)) if bounds else F.lit(0)
    counts = counts.withColumn("_bucket", at)
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    totals = counts.groupBy("_bucket").agg(F.sum("_n").alias("_n"))
    offsets = totals.select("_bucket", before(W.orderBy("_bucket")).alias("_base"))  # a row for each bucket
    starts = counts.withColumn("_inside", before(W.partitionBy("_bucket").orderBy(F.col(key).asc_nulls_first()))).join(F.broadcast(offsets), "_bucket")
    starts = starts.select(F.col(key).alias("_key"), (F.col("_base") + F.col("_inside")).alias("_start"))
    placed = rows.withColumn("_at", F.row_number().over(W.partitionBy(key).orderBy(*order)) - 1)
    return placed.join(starts, placed[key].eqNullSafe(starts["_key"])).withColumn(name, (F.col("_start") + F.col("_at")).cast("long")).drop("_key", "_start", "_at")
