"""Quality gate, deduplication and corpus counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.legal import self_referring
from ..functions.text import contains_any, strip
from .ordinal import numbered

SHORT, LONG = 150, 2000


def quality_gate(chunks: DataFrame, order: Sequence[str], terms: Sequence[str], short: int = SHORT, long: int = LONG) -> DataFrame:
    """Adds ``reason``: short, long, legacy, dup or keep, in this order; of equal texts that pass, the first stays.

    The chunks are read once: those that fail an earlier gate are dealt by a hash of their order instead of a digest,
    so they neither gather in one task nor meet those that pass.
    """
    n = F.char_length("text")
    gated = chunks.withColumn("reason", F.when(n < short, "short").when(n > long, "long").when(contains_any(F.col("text"), terms), "legacy").otherwise("keep"))
    passed = F.col("reason") == "keep"
    keyed = gated.withColumn("_d", F.when(passed, F.sha2(strip(F.col("text")), 256)).otherwise(F.hex(F.xxhash64(*order))))
    copy = F.row_number().over(W.partitionBy("_d").orderBy(*order))
    return keyed.withColumn("reason", F.when(passed & (copy > 1), "dup").otherwise(F.col("reason"))).drop("_d")


def qa_flags(pairs: DataFrame, most: int = 500) -> DataFrame:
    """Adds ``long_answer`` and ``self_referring`` to pairs of corpus, question, answer; negatives have neither."""
    own = F.col("corpus") == "local_text"
    return pairs.withColumn("long_answer", own & (F.char_length("answer") > most)).withColumn("self_referring", own & self_referring(F.col("question")))


def topic_gate(rows: DataFrame, keyword: Column, vector: str, center: DataFrame, least: float = 0.6) -> DataFrame:
    """``rows`` with ``near``: a keyword, or a vector as close as ``least`` to the center (one row of ``center``). Without either, false."""
    from .ranking import cosine

    close = F.round(cosine(F.col(vector), F.col("center")), 5)
    return rows.join(F.broadcast(center.select("center"))).withColumn("cosine", close).withColumn("near", keyword | F.coalesce(close >= least, F.lit(False))).drop("center")


def with_chunk_ids(kept: DataFrame, order: Sequence[str], label: str = "doc_id") -> DataFrame:
    """``ord``, the ordinal over all survivors in the order (label, order), and ``chunk_id`` = label:ordinal."""
    return numbered(kept, label, list(order), "ord").withColumn("chunk_id", F.format_string("%s:%06d", F.col(label).cast("string"), F.col("ord")))


def term_stats(tokens: DataFrame) -> DataFrame:
    """term, df, cf from (doc_id, term) rows."""
    per_doc = tokens.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    return per_doc.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
