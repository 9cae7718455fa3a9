"""Question-answer data: what goes into generation, phases with targets, negatives, rewrites, contrastive pairs.

A model is a function that is handed in; nothing here calls a service.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import legal
from ..functions import text as tx


@dataclasses.dataclass(frozen=True)
class Phase:
    """A phase adds rows until the shared table has ``target`` of them."""

    key: str
    seed: int
    least: int
    target: int


# Phases with their seeds, shortest chunks and targets.
PHASES = [Phase("general", 0, 80, 500), Phase("definitions", 10, 80, 1000), Phase("penalties", 20, 80, 1800), Phase("procedures", 30, 100, 2400), Phase("prohibited", 40, 80, 2800), Phase("scenarios", 50, 120, 3200), Phase("realistic", 60, 80, 4000)]
SMOKE = {"general": 24, "definitions": 48, "penalties": 96, "procedures": 128, "prohibited": 160, "scenarios": 192}
LEAST_NEGATIVE, MOST_PAIRS, LISTED = 300, 8000, 3


def phases(smoke: bool = False, cap: int | None = None) -> list[Phase]:
    """The phases with their targets; a smoke run lowers those that it names, a cap all."""
    out = [dataclasses.replace(p, target=SMOKE.get(p.key, p.target)) if smoke else p for p in PHASES]
    return [dataclasses.replace(p, target=min(p.target, cap)) for p in out] if cap is not None else out


def usable(chunks: DataFrame, least: int) -> DataFrame:
    """Chunks that are long enough and name no superseded law."""
    return chunks.filter((F.char_length("text") >= least) & ~tx.contains_any(F.col("text"), legal.FORBIDDEN_TERMS))


def sampled(chunks: DataFrame, group: str, order: str, seed: int) -> DataFrame:
    """One seeded random chunk of each record."""
    h = tx.stable_hash(F.lit(seed), F.col(group), F.col(order))
    rest = [c for c in chunks.columns if c != group]
    return chunks.groupBy(group).agg(F.min(F.struct(h.alias("_h"), order, F.struct(*rest).alias("_row"))).alias("_x")).select(group, *[F.col("_x._row")[c].alias(c) for c in rest])


def question_key(c: Column) -> Column:
    return F.lower(tx.strip(c))


def accepted(pairs: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Answers that can be used: grounded in their context, neither trivial nor naming a superseded law, each question once.

    pairs: question, answer, context and an ``id`` that decides which of equal questions stays; seen: question."""
    own, ctx = F.array_distinct(tx.tokens(F.col("answer"))), tx.tokens(F.col("context"))
    grounded = F.size(F.array_intersect(own, ctx)) / F.greatest(F.size(own), F.lit(1)) >= 0.35
    bad = legal.trivial(F.col("question"), F.col("answer")) | tx.contains_any(F.concat_ws(" ", "question", "answer"), legal.FORBIDDEN_TERMS)
    rows = pairs.filter((F.char_length(tx.strip(F.col("question"))) > 0) & (F.size(own) > 0) & grounded & ~bad).withColumn("_key", question_key(F.col("question")))
    if seen is not None:
        rows = rows.join(seen.select(question_key(F.col("question")).alias("_key")).distinct(), "_key", "left_anti")
    first = rows.groupBy("_key").agg(F.min("id").alias("_first"))
    return rows.join(first, "_key").filter(F.col("id") == F.col("_first")).drop("_key", "_first")


def generate(chunks: DataFrame, ask: Callable[[DataFrame, Phase], DataFrame], path: str, plan: Sequence[Phase], group: str = "doc_id", order: str = "place", rounds: int = 3) -> dict[str, int]:
    """Run the phases on one JSON-lines table; returns its rows after each phase.

    A pass samples a chunk of each record, ``ask`` adds question and answer, what is accepted and new is appended.
    A phase stops at its target, after ``rounds`` passes, or when a pass adds nothing; a rerun goes on from what is there.
    """
    spark, counts = chunks.sparkSession, {}
    schema = "id string, question string, answer string, context string, phase string, corpus string"

    def there() -> DataFrame:
        try:
            return spark.read.schema(schema).json(path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return spark.createDataFrame([], schema)

    for p in plan:
        for k in range(rounds):
            now = there()
            have = now.count()
            if have >= p.target:
                break
            picked = sampled(usable(chunks, p.least), group, order, p.seed + k).withColumn("context", F.col("text")).withColumn("id", F.concat_ws(":", F.lit(p.key), F.lit(str(k)), F.col(group).cast("string")))
            new = accepted(ask(picked, p), now).select("id", "question", "answer", "context", F.lit(p.key).alias("phase"), F.lit("local_text").alias("corpus"))
            new = new.orderBy(F.xxhash64("id"), "id").limit(p.target - have)  # the phase's own target
            new.write.mode("append").json(path)
            if there().count() == have:
                break
        counts[p.key] = there().count()
    return counts


def negatives(positives: DataFrame, chunks: DataFrame, doc: str = "doc_id", seed: int = 42, least: int = LEAST_NEGATIVE, most: int | None = None) -> DataFrame:
    """Each positive's question with a chunk of another document and the set refusal as its answer.

    The other document is a seeded step along the ring of documents that have a usable chunk, so no row meets all of
    them; none, if there is only one. positives: id, question, doc; chunks: doc, place, text.
    """
    from .ordinal import numbered

    own = sampled(usable(chunks, least).select(doc, "place", "text"), doc, "place", seed).select(F.col(doc).alias("other"), F.col("text").alias("context"))
    ring = numbered(own, "other", ["context"], "at")
    n = own.count()
    if n < 2:
        return positives.limit(0).select("id", "question", F.lit(None).cast("string").alias("answer"), F.lit(None).alias("other"), F.lit(None).cast("string").alias("context"), F.lit(None).cast("string").alias("corpus"))
    asked = positives.select("id", "question", doc).join(ring.select(F.col("other").alias(doc), F.col("at").alias("_own")), doc, "left")
    h = tx.stable_hash(F.lit(seed), F.col("id"))
    at = F.when(F.col("_own").isNull(), h % n).otherwise((F.col("_own") + 1 + h % (n - 1)) % n)
    out = asked.withColumn("at", at).join(ring, "at").select("id", "question", F.lit(legal.REFUSAL_ANSWER).alias("answer"), "other", "context", F.lit("negative").alias("corpus"))
    return out if most is None else out.orderBy(tx.stable_hash(F.lit(seed + 1), F.col("id")), "id").limit(most)


def rewritten(questions: DataFrame, cache: DataFrame) -> DataFrame:
    """query_id, question: the cached rewrite of a question, else the question. cache: question, rewritten."""
    return questions.join(cache.dropDuplicates(["question"]), "question", "left").select("query_id", F.coalesce("rewritten", "question").alias("question"))


def rewrite_cache(questions: DataFrame, rewrite: Callable[[Column], Column], cache: DataFrame | None = None) -> DataFrame:
    """question, rewritten: the cache and, for questions that it lacks, what the model's first line gives, without label
    and quotes; rewrites of five characters or fewer are left out, to be asked for again."""
    asked = questions.select("question").distinct()
    if cache is not None:
        asked = asked.join(cache.select("question"), "question", "left_anti")
    said = tx.strip(F.regexp_replace(F.regexp_replace(tx.strip(rewrite(F.col("question"))), r"^[\"'`*\-•\s]+", ""), r"^Câu hỏi pháp lý[:\-]*\s*", ""))
    new = asked.select("question", F.split(said, "\n")[0].alias("rewritten")).filter(F.char_length("rewritten") > 5)
    return new if cache is None else cache.select("question", "rewritten").unionByName(new)


def fact_text(citation: Column, violation: Column, fine: Column, points: Column) -> Column:
    """A sanction as lines, without those that are missing."""
    some = lambda label, c: F.when(F.length(c.cast("string")) > 0, F.concat(F.lit(label), c.cast("string")))
    return F.concat_ws("\n", some("", citation), some("", violation), some("Mức phạt: ", fine), some("Trừ điểm: ", points))


def contrastive(plain: DataFrame, with_negatives: DataFrame, facts: DataFrame, most: int = MOST_PAIRS, seed: int = 42) -> DataFrame:
    """anchor, positive, negative: pairs without and with a hard negative, at most ``most`` of them by a seeded hash.

    plain: question, context; with_negatives: also hard (ids in order), of whose first three the first known fact is
    the negative; facts: fact_id, text. Rows without question or context are left out; no negative is the empty text."""
    whole = lambda df: df.filter((F.char_length(tx.strip(F.col("question"))) > 0) & (F.char_length(tx.strip(F.col("context"))) > 0))
    listed = whole(with_negatives).select(F.monotonically_increasing_id().alias("_id"), "question", "context", "hard")
    met = listed.select("_id", "question", "context", F.posexplode_outer(F.slice("hard", 1, LISTED)).alias("p", "fact_id")).join(facts.select("fact_id", "text"), "fact_id", "left")
    hard = met.groupBy("question", "context", "_id").agg(F.min(F.when(F.col("text").isNotNull(), F.struct("p", "text"))).alias("x")).select("question", "context", F.col("x.text").alias("negative"))
    both = whole(plain).select("question", "context", F.lit(None).cast("string").alias("negative")).unionByName(hard)
    rows = both.select(tx.strip(F.col("question")).alias("anchor"), tx.strip(F.col("context")).alias("positive"), F.coalesce("negative", F.lit("")).alias("negative"))
    return rows.orderBy(tx.stable_hash(F.lit(seed), F.col("anchor"), F.col("positive"), F.col("negative")), "anchor", "positive", "negative").limit(most)
