"""Tables that a session builds once, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_built: dict[tuple[str, str], str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. A local master without the setting gets a temp folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='lexloom-')}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def once(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table of that name, written when the session first asks for it."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _built:
        path = f"{shared_dir(spark)}/lexloom-{uuid.uuid4().hex}"
        build().write.parquet(path)
        _built[key] = path
    return spark.read.parquet(_built[key])


def settled(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder: for small results that several plans read, which else compute them anew."""
    path = f"{shared_dir(df.sparkSession)}/lexloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
