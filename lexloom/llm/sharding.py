"""Byte-balanced sharding by Karmarkar-Karp differencing.

Equal texts form a group that stays together unless it has more bytes than a shard's fair part; then its rows
are split by id into ``parts`` items. Groups above ``1 / cells`` of all bytes are items of their
own (at most ``cells`` of them); the other groups are bundled by hash into ``cells`` items. The differencing
then repeatedly combines the two partial partitions with the largest spread, the largest part of one with
the smallest of the other. ``cells`` grows with the rows, so that a cell's window stays small, up to MOST_CELLS; the
differencing sees at most ``2 * cells + shards * parts`` numbers, and the map from item to shard that it returns has
as many rows. A bundle is indivisible like a group: it has at most about 1 / ``cells`` of all bytes, which bounds
what bundling can cost the balance. Rows are never collected.

Defined results: a null text has 0 bytes (size 1) and the checksum of the empty text, and groups with the
empty text; only the size of a very long text travels; a row, or rows of one id and text, larger than a shard's fair part make their shard the largest; slots follow (item, part
of the item, doc_id, checksum), so repeated rows get neighbouring slots; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import columns_of, materialize, text_of

#: Cells at least, rows of a cell that ask for more, and cells at most.
CELLS, CELL_ROWS, MOST_CELLS = 4096, 50_000, 1 << 16
#: Parts that a large group's rows are numbered in.
PARTS = 64


def difference(sizes: dict[int, int], ways: int) -> dict[int, int]:
    """Karmarkar-Karp: item to shard. Ties go by the order in which partial partitions came about."""
    if not sizes:
        return {}
    heap = []
    for serial, (item, size) in enumerate(sorted(sizes.items(), key=lambda x: (-x[1], x[0]))):
        parts = [(0, None)] * (ways - 1) + [(size, item)]  # ascending; a part is (sum, tree of items)
        heap.append((-size, serial, parts))
    heapq.heapify(heap)
    serial = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        parts = [(x[0] + y[0], (x[1], y[1]) if x[1] is not None and y[1] is not None else x[1] if y[1] is None else y[1]) for x, y in zip(a, reversed(b), strict=True)]
        parts.sort(key=lambda x: x[0])
        least = parts[0][0]
        heapq.heappush(heap, (least - parts[-1][0], serial, parts))
        serial += 1
    shard_of: dict[int, int] = {}
    for shard, (_, tree) in enumerate(reversed(heap[0][2])):
        stack = [tree]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack += x
            elif x is not None:
                shard_of[x] = shard
    return shard_of


def shard_by_bytes(df: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", cells: int | None = None, parts: int = PARTS) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = df.sparkSession
    text = text_of()
    rows = materialize(
        columns_of(df, doc_id=id_col, text=text_col).select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("grp")), "sizes"
    )
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    cells = cells or min(MOST_CELLS, max(CELLS, n // CELL_ROWS))
    least = max(1, -(-total // cells))
    heavy = rows.groupBy("grp").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") >= least)
    heavy = materialize(heavy.select("grp", F.lit(True).alias("large"), (F.col("bytes") * shards > total).alias("split")), "large-groups")  # at most `cells` rows, as their bytes add up to total at most
    cell = F.pmod(F.xxhash64("grp"), F.lit(cells))
    item = F.when(F.col("large"), F.col("grp")).otherwise(cell)
    part = F.when(F.col("large"), F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(parts))).otherwise(F.lit(0))
    placed = rows.join(F.broadcast(heavy), "grp", "left").select("doc_id", "size", "text_crc32", F.coalesce("large", F.lit(False)).alias("large"), item.alias("item"), F.when(F.col("split"), part).otherwise(0).cast("int").alias("piece"), part.cast("int").alias("part"))
    keys = ["large", "item", "piece"]
    bundles = materialize(placed.groupBy(*keys, "part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")), "bundles")
    sums = bundles.groupBy(*keys).agg(F.sum("bytes").alias("bytes")).collect()  # at most 2 * cells + shards * parts rows
    number = {(r.large, r.item, r.piece): i for i, r in enumerate(sorted(sums, key=lambda r: (r.large, r.item, r.piece)))}
    shard_of = difference({number[r.large, r.item, r.piece]: r.bytes for r in sums}, shards)
    shard_map = spark.createDataFrame([(*key, i, shard_of[i]) for key, i in number.items()], "large boolean, item long, piece int, number int, shard int")
    order = W.partitionBy("shard").orderBy("number", "part").rowsBetween(W.unboundedPreceding, -1)
    starts = bundles.join(F.broadcast(shard_map), keys).select(*keys, "part", "shard", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("start"))
    inside = W.partitionBy(*keys, "part").orderBy("doc_id", "text_crc32", "size")
    return (
        placed.withColumn("_pos", F.row_number().over(inside) - 1)
        .join(F.broadcast(materialize(starts, "starts")), [*keys, "part"])  # at most cells * (1 + parts) rows
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("_pos")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
