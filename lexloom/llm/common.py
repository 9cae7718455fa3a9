"""Shared plumbing: scratch tables that outlive executors, offsets, column picking."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shipping import ship

#: A word is a run of anything but the space and the five ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
BATCH_BYTES = 8 << 20
#: Scratch tables that this process has written and not dropped.
_scratch: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. A local master without the setting gets its own temp folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="lexloom-")
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared folder and return a scan of it.

    The lineage ends there, so a lost executor costs a re-read and not a recomputation, and what a
    plan assigned by chance (range bounds, partition numbers) can't change between two uses.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexloom-{tag}-{uuid.uuid4().hex}"
    _scratch.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_mark() -> int:
    """How many scratch tables there are now, for ``drop_scratch``."""
    return len(_scratch)


def drop_scratch(spark: SparkSession, mark: int = 0) -> None:
    """Delete the scratch tables written since the mark. Only for when all that reads them has been written out."""
    while len(_scratch) > mark:
        drop_table(spark, _scratch.pop())


def drop_table(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def python_ready(spark: SparkSession, rows: int) -> None:
    """Before a Python pass: the package goes to the executors once a session, and Arrow batches hold at most
    ``rows`` rows and, beyond their first row, BATCH_BYTES, so that a batch of very long texts stays small."""
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{key}").lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))
    ship(spark)


def text_of(name: str = "text") -> Column:
    """The text column with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def columns_of(df: DataFrame, **names: str) -> DataFrame:
    """Only the named columns under the operator's own names, so that further columns can't clash."""
    return df.select(*[F.col(f"`{src}`").alias(to) for to, src in names.items()])


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def global_prefix(df: DataFrame, order: list[Column], sums: dict[str, str], rank: str, tag: str) -> DataFrame:
    """Exclusive running sums (column to new column) and 0-based rank in a total order, with no task for all.

    Range partitions are frozen in a scratch table; one row of totals for each partition is prefix-summed,
    then each partition adds its own running sums to its offsets.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = df.withColumn("_one", F.lit(1).cast("long"))
    sums = sums | {"_one": rank}
    dealt = materialize(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), tag)
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    totals = dealt.groupBy("_part").agg(*[F.sum(c).alias(c) for c in sums])
    offsets = totals.select("_part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_at_{c}") for c in sums])
    inside = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    running = dealt.select("*", *[(F.sum(c).over(inside) - F.col(c)).alias(f"_in_{c}") for c in sums])
    joined = running.join(F.broadcast(offsets), "_part")  # a row for each partition
    return joined.select(*[c for c in df.columns if c != "_one"], *[(F.col(f"_in_{c}") + F.col(f"_at_{c}")).alias(out) for c, out in sums.items()])
