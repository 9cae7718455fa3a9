"""Exact deduplication with a heavy-hitter split.

A frequent-items sketch of the Misra-Gries family (``approx_top_k``, merged map-side) names the digests
that may be frequent. One exact count verifies them; the verified winners, at most ``1 / share`` rows by
the pigeonhole principle, are broadcast and their rows are settled where they are read. All other digests
go through an ordinary shuffle in which no group exceeds ``share`` of the rows.

Defined results: a null text counts as empty; of equal texts the row with the largest doc_id stays, non-null
before null; of rows that repeat both doc_id and text one stays, whichever the scratch table numbered last (all
that the result shows of them is equal); a very long text takes part as its digest, so only that is shuffled; an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import columns_of, materialize, text_of

#: Digests with at least this share of all rows are settled map-side.
SHARE = 1 / 1024
#: Counters of the sketch. Its error is below rows / TRACKED, well under SHARE.
TRACKED = 16384


def heavy_digests(rows: DataFrame, n: int, share: float = SHARE, tracked: int = TRACKED) -> DataFrame:
    """``digest, group_size, last`` (doc_id and row of the one that stays) of every digest with at least ``share`` of ``n`` rows."""
    least = max(2, int(n * share))
    k = min(tracked, int(2 / share))
    sketch = rows.agg(F.expr(f"approx_top_k(xxhash64(digest), {k}, {tracked})").alias("top"))
    named = sketch.select(F.inline("top")).filter(F.col("count") >= least).select(F.col("item").alias("h"))
    return (
        rows.withColumn("h", F.xxhash64("digest"))
        .join(F.broadcast(named), "h", "left_semi")  # at most k rows
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "row")).alias("last"))
        .filter(F.col("group_size") >= least)
    )


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept (one row of each group), text_sha256."""
    digests = columns_of(df, doc_id=id_col, text=text_col).select("doc_id", F.unhex(F.sha2(text_of(), 256)).alias("digest"))
    rows = materialize(digests.withColumn("row", F.monotonically_increasing_id()), "digests")  # written, so a row keeps its number
    heavy = materialize(heavy_digests(rows, rows.count(), share), "heavy")
    split = rows.join(F.broadcast(heavy), "digest", "left")  # at most 1 / share rows
    group = W.partitionBy("digest")
    rest = split.filter(F.col("group_size").isNull()).select("digest", "doc_id", "row", F.count(F.lit(1)).over(group).alias("group_size"), F.max(F.struct("doc_id", "row")).over(group).alias("last"))
    settled = split.filter(F.col("group_size").isNotNull()).select("digest", "doc_id", "row", "group_size", "last")
    return settled.unionByName(rest).select("doc_id", F.col("last.doc_id").alias("keep_id"), F.col("group_size").cast("long").alias("group_size"), (F.col("row") == F.col("last.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
