"""Exam files: json (list or wrapped), jsonl, csv; fuzzy columns, answer labels, exclusions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Accepted column names and answer forms.
FIELDS = {"id": ["id", "stt"], "question": ["question", "cau_hoi"], "A": ["A", "chon_a"], "B": ["B", "chon_b"], "C": ["C", "chon_c"], "D": ["D", "chon_d"], "answer": ["answer", "dap_an"]}
WRAPPERS = ["data", "questions", "items", "records"]
LABELS = {"1": "A", "2": "B", "3": "C", "4": "D", "A": "A", "B": "B", "C": "C", "D": "D"}


def read_exam(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Raw rows of a json, jsonl or csv file."""
    kind = kind or path.rsplit(".", 1)[-1].lower()
    if kind == "csv":
        df = spark.read.csv(path, header=True, encoding="utf-8", multiLine=True)
        return df.toDF(*[c.lstrip("﻿") for c in df.columns])
    df = spark.read.json(path, multiLine=kind == "json")
    wrapped = next((c for c in WRAPPERS if c in df.columns and df.schema[c].dataType.typeName() == "array"), None)
    return df.select(F.explode(wrapped).alias("_r")).select("_r.*") if wrapped else df


def find_field(columns: Sequence[str], candidates: Sequence[str]) -> str | None:
    """The column of the first candidate that matches but for case and blanks."""
    known = {c.strip().lower(): c for c in columns}
    return next((known[c.strip().lower()] for c in candidates if c.strip().lower() in known), None)


def answer_label(c: Column) -> Column:
    """1 to 4 and a to d to A to D; anything else is null."""
    table = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    return F.try_element_at(table, F.upper(F.trim(c.cast("string"))))


def parse_exam(raw: DataFrame) -> DataFrame:
    """id, question, choices, answer; rows without four choices, a question or a known answer are left out."""
    found = {k: find_field(raw.columns, v) for k, v in FIELDS.items()}
    text = lambda k: F.trim(F.col(f"`{found[k]}`").cast("string")) if found[k] else F.lit(None).cast("string")
    rows = raw.select(text("id").alias("id"), text("question").alias("question"), F.array(*[text(k) for k in "ABCD"]).alias("choices"), answer_label(text("answer")).alias("answer"))
    whole = F.forall("choices", lambda c: c.isNotNull() & (c != ""))
    return rows.filter(whole & F.col("answer").isNotNull() & (F.length("question") > 0))


def parse_ranges(spec: str) -> list[tuple[int, int]]:
    """'5,25->28' to inclusive ranges."""
    out = []
    for part in filter(None, (p.strip() for p in spec.split(","))):
        low, _, high = re.sub(r"\s", "", part).partition("->")
        out.append((int(low), int(high or low)))
    return out


def excluded(spark: SparkSession, spec: str) -> DataFrame:
    """The ids of a specification, one a row."""
    return spark.createDataFrame(parse_ranges(spec), "low long, high long").select(F.explode(F.sequence("low", "high")).alias("id"))


def valid_item() -> Column:
    """Four choices, an answer from A to D, a question of ten characters or more; missing parts make it false."""
    return F.coalesce((F.size("choices") == 4) & F.col("answer").isin("A", "B", "C", "D") & (F.char_length("question") >= 10), F.lit(False))


def import_counts(raw: DataFrame, spec: str, place: str) -> DataFrame:
    """One row: excluded (1-based places in the specification), bad (of the others, rows that ``parse_exam`` leaves out), ok."""
    out = F.exists(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in parse_ranges(spec) or [(1, 0)]]), lambda r: F.col(place).between(r["a"], r["b"]))
    total, gone = raw.agg(F.count(F.lit(1)).alias("total"), F.sum(out.cast("int")).alias("excluded")), raw.filter(~out)
    ok = parse_exam(gone.drop(place)).agg(F.count(F.lit(1)).alias("ok"))
    return total.join(F.broadcast(ok)).select(F.coalesce("excluded", F.lit(0)).alias("excluded"), (F.col("total") - F.coalesce("excluded", F.lit(0)) - F.col("ok")).alias("bad"), "ok")  # one row each
