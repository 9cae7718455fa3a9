"""Reports and small results as JSON in any store that Spark reaches."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def write_report(spark: SparkSession, report: Mapping, path: str) -> None:
    """One JSON document, as a folder of one file."""
    text = json.dumps(report, ensure_ascii=False, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_report(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r.value for r in spark.read.text(path).collect()))  # one document


def write_rows(rows: DataFrame, path: str) -> None:
    """Predictions, audits and the like, a JSON line each."""
    rows.write.mode("overwrite").json(path)


def summary(rows: DataFrame) -> dict:
    """A table of one row as a dictionary, for ``write_report``."""
    return rows.first().asDict(recursive=True)
