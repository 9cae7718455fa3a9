"""Leak-free splits and samples by stable hashes."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import stable_hash
from .ordinal import numbered

RATIOS = {"train": 0.8, "dev": 0.1, "test": 0.1}


def hash_split(group: Column, ratios: Mapping[str, float] = RATIOS, seed: int = 42) -> Column:
    """The split of a group: rows of a group can't straddle, and no shuffle is needed."""
    at, out, low = stable_hash(F.lit(seed), group) % 1000, None, 0.0
    names = list(ratios)
    for name in names[:-1]:
        low += ratios[name]
        out = F.when(at < round(low * 1000), name) if out is None else out.when(at < round(low * 1000), name)
    return out.otherwise(names[-1])


def assign_groups(sizes: Mapping[str, int], ratios: Mapping[str, float] = RATIOS, seed: int = 42) -> dict[str, str]:
    """Largest group first, each to the split with the most room left; ties by a seeded hash."""
    import hashlib

    total, room = sum(sizes.values()), {}
    room = {name: total * r for name, r in ratios.items()}
    tie = lambda *x: hashlib.md5("|".join(map(str, (seed, *x))).encode()).hexdigest()
    out = {}
    for g, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        name = max(room, key=lambda s: (room[s], tie(g, s)))
        out[g] = name
        room[name] -= n
    return out


def greedy_split(rows: DataFrame, group: str, ratios: Mapping[str, float] = RATIOS, heads: int = 10_000, seed: int = 42) -> DataFrame:
    """``rows`` with ``split``: the ``heads`` largest groups are assigned by size, which is what the greedy rule is
    about; the many small ones go by hash into bins that are then assigned like groups. The driver sees at most
    2 * heads sizes."""
    spark = rows.sparkSession
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    largest = sizes.orderBy(F.col("_n").desc(), group).limit(heads).select(group, F.lit(True).alias("_head"))
    binned = sizes.join(largest, group, "left").withColumn("_bin", F.when(F.col("_head"), F.concat(F.lit("g:"), F.col(group).cast("string"))).otherwise(F.concat(F.lit("b:"), (stable_hash(F.col(group)) % heads).cast("string"))))
    totals = {r["_bin"]: r["n"] for r in binned.groupBy("_bin").agg(F.sum("_n").alias("n")).collect()}
    table = spark.createDataFrame(list(assign_groups(totals, ratios, seed).items()), "_bin string, split string")
    return rows.join(binned.select(group, "_bin").join(table, "_bin").drop("_bin"), group)


#: Parts of the hash range that a class is counted in.
PARTS = 4096


def stratified(rows: DataFrame, label: str, ratio: float, key: str, seed: int = 42) -> DataFrame:
    """``rows`` with ``part``: in each class the max(1, floor(n * ratio)) rows with the lowest seeded hashes of their key are ``val``.

    A class is counted in PARTS ranges of the hash; ranges below the border are settled by their counts, and only
    the rows of the border's range are ranked, so no task sees a class.
    """
    hashed = rows.withColumn("_h", stable_hash(F.lit(seed), F.col(key))).withColumn("_p", F.floor(F.col("_h") * PARTS / (1 << 32)).cast("int"))
    counts = hashed.groupBy(label, "_p").agg(F.count(F.lit(1)).alias("_n"))
    per = W.partitionBy(label)  # PARTS rows a class at most
    before = F.coalesce(F.sum("_n").over(per.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cells = counts.select(F.col(label).alias("_label"), F.col("_p").alias("_q"), (F.greatest(F.lit(1), F.floor(F.sum("_n").over(per) * ratio)) - before).alias("_room"), F.col("_n"))
    met = hashed.join(cells, hashed[label].eqNullSafe(cells["_label"]) & (F.col("_p") == F.col("_q")))
    border = (F.col("_room") > 0) & (F.col("_room") < F.col("_n"))
    rank = F.row_number().over(W.partitionBy(label, "_p").orderBy("_h", key))
    settled = met.filter(~border).withColumn("part", F.when(F.col("_room") > 0, "val").otherwise("train"))
    ranked = met.filter(border).withColumn("part", F.when(rank <= F.col("_room"), "val").otherwise("train"))
    return settled.unionByName(ranked).drop("_h", "_p", "_q", "_room", "_n", "_label")


def split_meta(rows: DataFrame, split: str, group: str, columns: list[str]) -> DataFrame:
    """split, rows, groups, digest (exclusive or of row hashes, whatever the order)."""
    return rows.groupBy(split).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(group).alias("groups"), F.bit_xor(stable_hash(*[F.col(c) for c in columns])).alias("digest"))


def tail_split(rows: DataFrame, key: str, ratio: float = 0.1) -> DataFrame:
    """``rows`` with ``part``: the last ``ratio`` in order of the key are ``validation``."""
    n = rows.count()
    cut = math.floor(n * (1 - ratio))
    return numbered(rows, key, [key], "_ord").withColumn("part", F.when(F.col("_ord") >= cut, "validation").otherwise("train")).drop("_ord")


def at_places(rows: DataFrame, key: str, places: list[int]) -> DataFrame:
    """The rows at the 0-based places in order of the key; a place outside the table raises."""
    n = rows.count()
    if wrong := [p for p in places if not 0 <= p < n]:
        raise IndexError(f"no rows {wrong} in a table of {n}")
    return numbered(rows, key, [key], "_ord").filter(F.col("_ord").isin(places)).drop("_ord")


def overlay(rows: DataFrame, over: DataFrame, key: str) -> DataFrame:
    """``rows`` with those of ``over`` in place of rows of the same key."""
    return rows.join(over.select(key), key, "left_anti").unionByName(over)
