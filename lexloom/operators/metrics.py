"""Answer-quality metrics on aligned columns of predictions and references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import legal
from ..functions.text import audit_tokens, contains_any, rouge_tokens


def token_f1(p: Column, r: Column) -> Column:
    """Set intersection over list lengths; both empty give 1, one empty 0."""
    common = F.size(F.array_intersect(p, r)).cast("double")
    precision, recall = common / F.size(p), common / F.size(r)
    return F.when((F.size(p) == 0) & (F.size(r) == 0), 1.0).when((F.size(p) == 0) | (F.size(r) == 0) | (common == 0), 0.0).otherwise(2 * precision * recall / (precision + recall))


def ngrams(toks: Column, n: int) -> Column:
    """array<string> of n-grams, with repeats."""
    size = F.size(toks)
    return F.when(size >= n, F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(toks, i, n), " "))).otherwise(F.array().cast("array<string>"))


def overlap(pairs: DataFrame, key: list[str], p: str, r: str, n: int) -> DataFrame:
    """key, matched, predicted, expected: clipped n-gram counts of token columns p and r."""
    side = lambda c, v: F.transform(ngrams(F.col(c), n), lambda g: F.struct(g.alias("g"), F.lit(v).alias("v")))
    rows = pairs.select(*key, F.explode(F.concat(side(p, 0), side(r, 1))).alias("x")).select(*key, "x.g", "x.v")
    both = rows.groupBy(*key, "g").agg(F.sum(1 - F.col("v")).alias("a"), F.sum("v").alias("b"))
    sums = both.groupBy(*key).agg(F.sum(F.least("a", "b")).alias("matched"), F.sum("a").alias("predicted"), F.sum("b").alias("expected"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("matched", "predicted", "expected")]
    return pairs.select(*key).join(sums, key, "left").select(*key, *zero)


def f_measure(matched: Column, predicted: Column, expected: Column) -> Column:
    return F.when(matched > 0, 2 * matched / (predicted + expected)).otherwise(F.lit(0.0))


def lcs_of(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a row of the usual table at a time as the bits of one number."""
    places: dict[str, int] = {}
    for j, t in enumerate(b):
        places[t] = places.get(t, 0) | (1 << j)
    whole = (1 << len(b)) - 1
    row = whole  # a 0 where the length goes up
    for t in a:
        met = row & places.get(t, 0)
        row = ((row + met) | (row - met)) & whole
    return len(b) - row.bit_count()


def rouge_l(p: Column, r: Column) -> Column:
    """ROUGE-L F of token arrays, in Arrow batches."""

    @F.udf("long", useArrow=True)
    def shared(a, b):
        return lcs_of(list(a), list(b))

    return f_measure(shared(p, r), F.size(p), F.size(r))


def rates(rows: DataFrame) -> DataFrame:
    """One row: source_hit_rate, refusal_rate, false_refusal_rate, forbidden_rate, n. rows: category, answer, expected, got.

    Hits count where something is expected; a rate without rows is null."""
    unsupported = F.col("category").eqNullSafe("unsupported")
    among = lambda test, of: F.avg(F.when(of, test.cast("double")))
    return rows.agg(
        among(F.arrays_overlap("expected", "got"), F.size("expected") > 0).alias("source_hit_rate"),
        among(legal.refuses(F.col("answer")), unsupported).alias("refusal_rate"),
        among(legal.seems_to_refuse(F.col("answer")), ~unsupported).alias("false_refusal_rate"),
        F.avg(contains_any(F.col("answer"), legal.FORBIDDEN_TERMS).cast("double")).alias("forbidden_rate"),
        F.count(F.lit(1)).alias("n"),
    )


def hits_by_document(rows: DataFrame) -> DataFrame:
    """doc_id, rate, n: how often a document was among what was got where it was expected. rows: expected, got."""
    each = rows.select(F.explode(F.array_distinct("expected")).alias("doc_id"), "got")
    return each.groupBy("doc_id").agg(F.round(F.avg(F.array_contains("got", F.col("doc_id")).cast("double")), 4).alias("rate"), F.count(F.lit(1)).alias("n"))


def provisions(gold: DataFrame, got: DataFrame) -> DataFrame:
    """One row: article_recall, n, clause_recall, point_recall, article_mrr over questions with gold articles.

    gold: query_id, articles, clauses, points; got: query_id, rank, article_number, clause_number, point_letter. Levels
    are matched each by itself; a level that no question has is null."""
    asked = gold.filter(F.size("articles") > 0)
    met = asked.join(got, "query_id", "left")
    within = lambda c, all_: F.coalesce(F.array_contains(all_, F.col(c)), F.lit(False))
    each = met.groupBy("query_id").agg(
        F.min(F.when(within("article_number", "articles"), F.col("rank"))).alias("first"),
        F.max(within("clause_number", "clauses")).alias("clause"),
        F.max(within("point_letter", "points")).alias("point"),
        F.max(F.size("clauses") > 0).alias("has_clause"),
        F.max(F.size("points") > 0).alias("has_point"),
    )
    share = lambda c: F.round(F.avg(c.cast("double")), 4)
    return each.agg(
        share(F.col("first").isNotNull()).alias("article_recall"),
        F.count(F.lit(1)).alias("n"),
        F.when(F.max("has_clause"), share(F.col("clause"))).alias("clause_recall"),
        F.when(F.max("has_point"), share(F.col("point"))).alias("point_recall"),
        share(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("article_mrr"),
    )


def slot_recall(rows: DataFrame) -> DataFrame:
    """One row: fine_recall, fines, points_recall, points. rows: low, high, points (gold, null or empty where missing), said."""
    has = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    points = F.regexp_extract("said", r"(?iU)trừ\s+(\d+)\s*điểm", 1) == F.col("points")
    return rows.agg(
        F.round(F.avg(F.when(has("low"), legal.fine_matches(F.col("low"), F.col("high"), F.col("said")).cast("double"))), 4).alias("fine_recall"),
        F.sum(has("low").cast("int")).alias("fines"),
        F.round(F.avg(F.when(has("points"), points.cast("double"))), 4).alias("points_recall"),
        F.sum(has("points").cast("int")).alias("points"),
    )


def judge(rows: DataFrame) -> DataFrame:
    """score (mean mark over 5; 0 without marks), scored, n from what a judge said: its first digit from 1 to 5."""
    mark = F.nullif(F.regexp_extract("said", "[1-5]", 0), F.lit("")).cast("int")
    return rows.select(mark.alias("m")).agg(F.coalesce(F.avg("m") / 5, F.lit(0.0)).alias("score"), F.count("m").alias("scored"), F.count(F.lit(1)).alias("n"))


def label_audit(rows: DataFrame, key: list[str], least: float = 0.12, gain: float = 0.18, unlike: float = 0.35) -> DataFrame:
    """key, gold_overlap, top_overlap, top_rouge, gold_low, retrieved_better, noise.

    rows: question, gold (context), top (the first retrieved text), same (it is of an expected document)."""
    share = lambda c: F.size(F.array_intersect(F.col("qw"), audit_tokens(F.col(c)))) / F.greatest(F.size("qw"), F.lit(1))
    scored = rows.withColumn("qw", audit_tokens(F.col("question"))).select(*key, "same", share("gold").alias("g"), share("top").alias("o"), rouge_l(rouge_tokens(F.col("top")), rouge_tokens(F.col("gold"))).alias("rl"))
    low, better = F.col("g") < least, (F.col("o") >= F.col("g") + gain) & (F.col("rl") < unlike)
    return scored.select(*key, F.round("g", 4).alias("gold_overlap"), F.round("o", 4).alias("top_overlap"), F.round("rl", 4).alias("top_rouge"), low.alias("gold_low"), better.alias("retrieved_better"), ((low | better) & ~F.col("same")).alias("noise"))


def meteor_exact(p: list[str], r: list[str], alpha: float = 0.9, beta: float = 3.0, gamma: float = 0.5) -> float:
    """METEOR with exact matches only: greedy alignment from the left, chunk penalty."""
    used: set[int] = set()
    match = []
    for i, t in enumerate(p):
        j = next((j for j, u in enumerate(r) if u == t and j not in used), None)
        if j is not None:
            used.add(j)
            match.append((i, j))
    if not match:
        return 0.0
    precision, recall = len(match) / len(p), len(match) / len(r)
    mean = precision * recall / (alpha * precision + (1 - alpha) * recall)
    chunks = 1 + sum(b != (a[0] + 1, a[1] + 1) for a, b in zip(match, match[1:], strict=False))
    return mean * (1 - gamma * (chunks / len(match)) ** beta)
