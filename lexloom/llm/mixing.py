"""Mixing sources to target weights by Sainte-Lague apportionment.

A source's target is its weight's share of all words, at most ``max_epochs`` times its own size, the excess
shared again by weight. Words are dealt in blocks of ``block_words``; shard k gets blocks by highest
quotients target / (2 q + 1), continued from shard to shard, so its quotas are whole numbers and the sums
over shards are again an apportionment (the method is house-monotone). Within a source a seeded hash lays
the documents out on an axis of words; the source's blocks are the consecutive blocks from the axis' start,
and those of shard k follow those of shard k - 1. As the documents lie in seeded order, this is a seeded
choice of blocks, and it needs no list of blocks: what a document gives follows from its place on the axis.

The axis needs one shuffle of (id, source, size, hash) rows, dealt by source *and* hash bucket, so a source
that holds a third of all rows is spread over ``buckets`` windows. Their number grows with the rows. A row's
place hangs on its id and text, so that rows with null ids are spread too; rows that are equal in both share a
bucket.

Defined results: null and empty texts have size 0 and give nothing; a very long text counts whole and only its
size travels; the null source is a source and comes last; repeated rows lie side by side on the axis; an empty
table gives no rows; other columns are ignored.
No document exceeds max_epochs times its size, as the chosen blocks cover the axis at most that often.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import columns_of, global_prefix, materialize, text_of, word_count

WEIGHTS = (5, 2, 1)
BLOCK_WORDS = 16
SHARDS = 16
#: Buckets of a source's axis at least, and rows of a bucket that ask for more.
BUCKETS, BUCKET_ROWS, MOST_BUCKETS = 1024, 50_000, 1 << 17
MAX_EPOCHS = 3


def source_order() -> list[Column]:
    """Sources are kept as "=name", and the null source as "": in code point order with null last."""
    return [(F.col("source") == "").asc(), F.col("source").asc()]


def targets(sources: DataFrame, weights: Sequence[float], max_epochs: int) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``: water-filling in closed form.

    Sorted by how soon a source is full (limit / weight), the first ones are full as long as the level that
    is left for the others is above them; both come from prefix sums, so there is no loop.
    """
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    ranked = global_prefix(sources, source_order(), {}, "place", "sources")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weight = F.element_at(cycle, (F.col("place") % len(weights) + 1).cast("int"))
    full = ranked.withColumn("weight", weight).withColumn("limit", F.col("source_size").cast("double") * max_epochs).withColumn("ratio", F.col("limit") / F.col("weight"))
    full = materialize(global_prefix(full, [F.col("ratio"), F.col("place")], {"limit": "limits", "weight": "weights"}, "filled", "levels"), "filled")
    all_weights = full.agg(F.sum("weight")).first()[0] or 1.0
    level = (F.lit(float(total)) - F.col("limits")) / (F.lit(float(all_weights)) - F.col("weights"))
    first = full.filter(F.col("ratio") >= level).agg(F.min(F.struct("filled", level.alias("level"))).alias("x")).first()["x"]
    water = first["level"] if first is not None else float("inf")
    return full.select("source", "place", "source_size", F.least(F.col("limit"), F.col("weight") * F.lit(float(water))).alias("target"))


def apportion(sources: DataFrame, houses: list[int], block_words: int, max_epochs: int) -> DataFrame:
    """``place, quotas``: quotas[k] whole blocks of the first houses[k] go to the source at ``place``.

    Of n sources, one with share p ends within p n / 2 + 1 / 2 seats of its ideal share, since scaling the
    divisor by 1 -+ n / (2 seats) moves the sum of roundings past any house. Seats below that range are
    given at once; only the p n + 2 seats of each source in the range are ranked by their quotients.
    """
    total, n = sources.filter("target > 0").agg(F.sum("target"), F.count(F.lit(1))).first()
    share = F.col("target") / F.lit(float(total or 1.0))
    grid = sources.select("place", "target", "source_size", F.posexplode(F.array(*[F.lit(h).cast("long") for h in houses])).alias("house", "seats"))
    grid = materialize(grid.withColumn("base", F.greatest(F.floor(share * F.col("seats") - share * n / 2 - 0.5), F.lit(0)).cast("long")), "grid")
    left = grid.groupBy("house").agg((F.first("seats") - F.sum("base")).alias("left"))  # a row for each shard
    seats = grid.filter("target > 0").withColumn("j", F.explode(F.sequence(F.lit(0), F.ceil(share * n).cast("int") + 2)))
    seats = seats.withColumn("quotient", F.col("target") / (2 * (F.col("base") + F.col("j")) + 1))
    ranked = seats.withColumn("r", F.row_number().over(W.partitionBy("house").orderBy(F.col("quotient").desc(), "place")))
    more = ranked.join(F.broadcast(left), "house").filter("r <= left").groupBy("house", "place").agg(F.count(F.lit(1)).alias("more"))
    most = F.floor(F.col("source_size") * max_epochs / block_words)
    quota = F.least(F.col("base") + F.coalesce("more", F.lit(0)), most).cast("long")
    listed = F.array_sort(F.collect_list(F.struct("house", quota.alias("q"))))  # as many as shards
    return grid.join(more, ["house", "place"], "left").groupBy("place").agg(F.transform(listed, lambda x: x["q"]).alias("quotas"))


def covered(upto: Column, start: Column, size: Column, axis: Column) -> Column:
    """Words of the document at [start, start + size) in the first ``upto`` words of the endless axis."""
    turns = F.floor(upto / F.when(axis > 0, axis))
    rest = upto - turns * axis
    return F.coalesce(turns * size + F.least(F.greatest(rest - start, F.lit(0)), size), F.lit(0))


def mix_sources(
    df: DataFrame, weights: Sequence[float] = WEIGHTS, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS, shards: int = SHARDS, buckets: int | None = None, max_epochs: int = MAX_EPOCHS, keys: bool = False
) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken, and by_shard (words given to each shard);
    with ``keys`` also source and tie (64-bit hash of the text), which tell rows of one id apart."""
    text = text_of()
    key = F.xxhash64(F.lit(seed), F.col("doc_id"), text)
    rows = columns_of(df, doc_id=id_col, text=text_col, source=source_col).select("doc_id", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("source"), word_count(text).alias("size"), key.alias("h"), F.xxhash64(text).alias("tie"))
    rows = materialize(rows, "axis")
    if buckets is None:
        buckets = min(MOST_BUCKETS, max(BUCKETS, rows.count() // BUCKET_ROWS))
    rows = rows.withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))
    cells = materialize(rows.groupBy("source", "bucket").agg(F.sum("size").alias("cell_size")), "cells")
    sources = cells.groupBy("source").agg(F.sum("cell_size").cast("long").alias("source_size"))
    aims = materialize(targets(sources, weights, max_epochs), "targets")
    total = aims.agg(F.sum("target")).first()[0] or 0.0
    blocks = round(total / block_words)
    houses = [blocks * (k + 1) // shards for k in range(shards)]
    quotas = apportion(aims, houses, block_words, max_epochs)
    table = aims.join(quotas, "place").select("source", "source_size", "target", "quotas")
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = cells.withColumn("cell_start", F.coalesce(F.sum("cell_size").over(before), F.lit(0)))
    starts = materialize(starts.join(table, "source").drop("cell_size"), "starts")
    inside = W.partitionBy("source", "bucket").orderBy("h", "doc_id", "size", "tie").rowsBetween(W.unboundedPreceding, 0)
    placed = rows.withColumn("run", F.sum("size").over(inside) - F.col("size"))
    joined = placed.join(starts, ["source", "bucket"]).withColumn("start", F.col("run") + F.col("cell_start"))
    upto = lambda q: covered(q * block_words, F.col("start"), F.col("size"), F.col("source_size"))
    cum = F.transform("quotas", upto)
    return joined.withColumn("cum", cum).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        F.element_at("cum", -1).cast("long").alias("taken"),
        F.transform("cum", lambda x, i: (x - F.when(i > 0, F.get("cum", i - 1)).otherwise(F.lit(0))).cast("long")).alias("by_shard"),
        *([F.when(F.col("source") != "", F.substring("source", 2, 1 << 30)).alias("source"), "tie"] if keys else []),
    )
