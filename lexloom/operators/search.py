"""Search of a batch of questions over a whole table: BM25, dense vectors, aliases, article numbers, and their composition.

Questions are a stated set: they are collected in passes of at most MOST_QUERIES, and the rows go by once a pass,
each task keeping the best rows for each question. So what is shuffled is a few rows a question and task,
whatever the table's size.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import legal
from ..functions import text as tx
from ..scratch import settled
from ..shipping import ship
from .ranking import dealt_anew, rrf, top

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Questions of one pass, and (row, question) scores held at once in a task.
MOST_QUERIES, SCORES = 4096, 2_000_000


def passes(queries: DataFrame, key: str = "query_id") -> Iterator[list]:
    """The rows of the question table, at most about MOST_QUERIES at a time."""
    n = -(-queries.count() // MOST_QUERIES)
    for k in range(n):
        part = queries if n == 1 else queries.filter(F.pmod(F.xxhash64(key), F.lit(n)) == k)
        if rows := part.collect():  # MOST_QUERIES rows, about
            yield rows


def best(rows: DataFrame, key: str, names: list, score: Callable[[pa.RecordBatch], Iterator], k: int, digits: int) -> DataFrame:
    """query_id, key, score: for each of ``names`` the k rows with the highest scores of each task, ties to the smaller key.

    ``score`` gives (slice of the batch, array of rows times names) for a batch, piece by piece.
    """
    id_type, name_type = rows.schema[key].dataType.simpleString(), "string" if isinstance(names[0], str) else "long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held = None
        for b in batches:
            ids = np.array(b.column(key).to_pylist())
            for part, scores in score(b):
                found = np.round(np.asarray(scores.T, np.float64), digits)
                keys = np.broadcast_to(ids[part], found.shape)
                if held is not None:
                    found, keys = np.concatenate([held[0], found], axis=1), np.concatenate([held[1], keys], axis=1)
                order = np.lexsort((keys, -found), axis=1)[:, :k]
                held = np.take_along_axis(found, order, 1), np.take_along_axis(keys, order, 1)
        if held is not None:
            n = held[0].shape[1]
            q = [x for x in names for _ in range(n)]
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(held[1].ravel().tolist()), pa.array(held[0].ravel())], ["query_id", key, "score"])

    return rows.mapInArrow(run, f"query_id {name_type}, {key} {id_type}, score double")


def union(parts: list[DataFrame], empty: DataFrame) -> DataFrame:
    out = parts[0] if parts else empty
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


class Bm25:
    """Okapi BM25 over one table. Statistics cover all rows; only what a pass asks for is kept."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k1: float = K1, b: float = B, epsilon: float = EPSILON):
        self.texts = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        self.words = self.texts.select("doc", tx.tokens(F.col("text")).alias("w"))
        self.k1, self.b, self.epsilon, self.counted = k1, b, epsilon, None

    def counts(self) -> tuple[int, float | None, DataFrame]:
        """(rows, mean length, table of term and df), from one pass over the texts; the null term stands for the rows."""
        if self.counted is None:
            each = self.words.select(F.size("w").alias("len"), F.explode(F.concat(F.array_distinct("w"), F.array(F.lit(None).cast("string")))).alias("term"))
            table = settled(each.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum(F.when(F.col("term").isNull(), F.col("len"))).alias("words")))
            row = table.filter("term IS NULL").select("df", "words").first()
            self.counted = (row.df, row.words / row.df, table) if row else (0, None, table)
        return self.counted[0], self.counted[1], self.counted[2].filter("term IS NOT NULL").select("term", "df")

    def stats(self, terms: list[str]) -> tuple[float, dict[str, float]]:
        """(mean length, weight of each of the terms that occur). A term's negative weight is a share of the mean weight."""
        n, mean, df = self.counts()
        raw = df.select("term", (F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
        asked = self.words.sparkSession.createDataFrame([(t, True) for t in terms], "term string, asked boolean")  # of one pass
        row = raw.join(F.broadcast(asked), "term", "left").agg(F.avg("raw").alias("mean"), F.collect_list(F.when(F.col("asked"), F.struct("term", "raw"))).alias("found")).first()
        return mean or 1.0, {r.term: r.raw if r.raw >= 0 else self.epsilon * row["mean"] for r in row.found}

    def questions(self, queries: DataFrame, query_id: str, text: str) -> DataFrame:
        return queries.select(F.col(query_id).alias("query_id"), tx.tokens(F.coalesce(F.col(text), F.lit(""))).alias("asked")).filter(F.size("asked") > 0)

    def weigh(self, asked: list) -> tuple[list[str], list, list, list, float]:
        """(terms, starts, questions, weights, mean length): for each term the questions that have it, with count times weight."""
        from collections import Counter

        terms = sorted({t for r in asked for t in r.asked})
        mean, idf = self.stats(terms)
        terms = [t for t in terms if t in idf]
        by_term: dict[str, list] = {t: [] for t in terms}
        for q, r in enumerate(asked):
            for t, m in Counter(r.asked).items():
                if t in idf:
                    by_term[t].append((q, m * idf[t]))
        starts, who, how = [0], [], []
        for t in terms:
            who += [q for q, _ in by_term[t]]
            how += [w for _, w in by_term[t]]
            starts.append(len(who))
        return terms, starts, who, how, mean

    def search(self, queries: DataFrame, k: int, query_id: str = "query_id", text: str = "question") -> DataFrame:
        """query_id, doc, score, rank: the k best rows of each question that has a word, those without a shared word included.
        A question's repeated words count each time."""
        spark = self.words.sparkSession
        ship(spark)
        k1, b = self.k1, self.b
        parts = []
        for asked in passes(self.questions(queries, query_id, text)):
            names = [r.query_id for r in asked]
            terms, starts, who, how, mean = self.weigh(asked)

            def score(batch, names=names, terms=terms, starts=starts, who=who, how=how, mean=mean):
                import numpy as np
                import pyarrow.compute as pc

                known, q = pa.array(terms, pa.string()), len(names)
                start, who, how = np.array(starts), np.array(who, np.int64), np.array(how)
                words = batch.column("w")
                sizes = np.asarray(pc.list_value_length(words), np.int64)
                at = np.asarray(pc.fill_null(pc.index_in(words.flatten(), value_set=known), -1), np.int64)
                row = np.repeat(np.arange(len(sizes)), sizes)[at >= 0]
                cells, tf = np.unique(row * max(1, len(terms)) + at[at >= 0], return_counts=True)
                row, term = np.divmod(cells, max(1, len(terms)))
                part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * sizes[row] / mean))
                step = max(1, SCORES // q)
                for low in range(0, len(sizes), step):
                    high = min(low + step, len(sizes))
                    i, j = np.searchsorted(row, [low, high])
                    counts = start[term[i:j] + 1] - start[term[i:j]]
                    places = np.repeat(start[term[i:j]], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                    into = np.repeat(row[i:j] - low, counts) * q + who[places]
                    yield slice(low, high), np.bincount(into, np.repeat(part[i:j], counts) * how[places], (high - low) * q).reshape(high - low, q)

            parts.append(best(self.words, "doc", names, score, k, 6))
        kinds = (queries.schema[query_id].dataType.simpleString(), self.words.schema["doc"].dataType.simpleString())
        empty = spark.createDataFrame([], f"query_id {kinds[0]}, doc {kinds[1]}, score double")
        return top(union(parts, empty), k, "query_id", F.col("score"), F.col("doc"))

    def score_pairs(self, pairs: DataFrame, queries: DataFrame, query_id: str = "query_id", text: str = "question") -> DataFrame:
        """query_id, doc, score of given pairs only; a pair without a shared word has 0. Statistics are still the whole table's."""
        asked = self.questions(queries, query_id, text)
        terms = asked.select(F.explode("asked").alias("term")).distinct()
        n, mean, df = self.counts()
        raw = df.withColumn("raw", F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
        level = raw.agg(F.avg("raw").alias("level"))  # one row
        idf = raw.join(terms, "term", "left_semi").join(F.broadcast(level)).select("term", F.when(F.col("raw") >= 0, F.col("raw")).otherwise(self.epsilon * F.col("level")).alias("idf"))
        weights = asked.select("query_id", F.explode("asked").alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("m")).join(idf, "term").select("query_id", "term", (F.col("m") * F.col("idf")).alias("weight"))
        met = pairs.select("query_id", "doc").distinct().join(asked.select("query_id"), "query_id", "left_semi").join(self.texts, "doc").withColumn("w", tx.tokens(F.col("text"))).select("query_id", "doc", F.size("w").alias("len"), F.explode_outer("w").alias("term"))
        tf = met.groupBy("query_id", "doc", "len", "term").agg(F.count(F.lit(1)).alias("tf")).join(weights, ["query_id", "term"], "left")
        k1, b = self.k1, self.b
        part = F.col("weight") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.lit(mean or 1.0)))
        return tf.groupBy("query_id", "doc").agg(F.round(F.coalesce(F.sum(part), F.lit(0.0)), 6).alias("score"))


def vector_top(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", digits: int = 5) -> DataFrame:
    """query_id, vec_id, score, rank by inner product, exact: batches of vectors times a block of questions. Vectors of another length than the question's are left out."""
    spark = vectors.sparkSession
    ship(spark)
    parts = []
    rows = vectors.select(F.col(id_col), F.col("embedding").cast("array<double>").alias("embedding")).filter("embedding IS NOT NULL")
    for asked in passes(queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding")).filter("embedding IS NOT NULL")):
        for width in sorted({len(r.embedding) for r in asked}):
            own = [r for r in asked if len(r.embedding) == width]
            names, block = [r.query_id for r in own], [r.embedding for r in own]

            def score(batch, block=block, width=width):
                import numpy as np

                table = np.asarray(batch.column("embedding").flatten(), np.float64).reshape(-1, width)
                q = np.array(block)
                step = max(1, SCORES // len(q))
                for low in range(0, len(table), step):
                    yield slice(low, low + step), table[low : low + step] @ q.T

            parts.append(best(rows.filter(F.size("embedding") == width), id_col, names, score, k, digits))
    kinds = (queries.schema["query_id"].dataType.simpleString(), vectors.schema[id_col].dataType.simpleString())
    return top(union(parts, spark.createDataFrame([], f"query_id {kinds[0]}, {id_col} {kinds[1]}, score double")), k, "query_id", F.col("score"), F.col(id_col))


def embedded(rows: DataFrame, model: Callable[[list[str]], list], batch: int = 128, text: str = "text") -> DataFrame:
    """``rows`` with ``embedding`` by a model that takes lists of texts; calls hold ``batch`` texts but for a task's last."""
    ship(rows.sparkSession)
    names = rows.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", embedding array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(some: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(some).combine_chunks()
            vectors = pa.array([[float(x) for x in v] for v in model(table.column(text).to_pylist())], pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays([*[c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in table.columns], vectors], [*names, "embedding"])

        held, n = [], 0
        for b in batches:
            while b.num_rows:
                take = b.slice(0, batch - n)
                held, n, b = [*held, take], n + take.num_rows, b.slice(take.num_rows)
                if n == batch:
                    yield out(held)
                    held, n = [], 0
        if n:
            yield out(held)

    return rows.mapInArrow(run, fields)


def hashed_embedding(c: Column, width: int = 16) -> Column:
    """A unit vector of word counts by hash: what stands in for an embedding model that isn't given. A word's bucket is
    computed once a worker, not once an occurrence."""
    from hashlib import md5

    class Buckets(dict):
        def __missing__(self, word):
            if len(self) >= 200_000:
                self.clear()
            x = self[word] = int(md5(word.encode()).hexdigest()[:8], 16) % width
            return x

    buckets = Buckets()

    @F.arrow_udf("array<double>")
    def vectors(words: pa.Array) -> pa.Array:
        import numpy as np
        import pyarrow.compute as pc

        sizes, coded = np.asarray(pc.list_value_length(words), np.int64), words.flatten().dictionary_encode()
        at = np.array([buckets[w] for w in coded.dictionary.to_pylist()], np.int64)[np.asarray(coded.indices)]
        n = np.bincount(np.repeat(np.arange(len(sizes)) * width, sizes) + at, minlength=len(sizes) * width).reshape(-1, width).astype(np.float64)
        norm = np.sqrt((n * n).sum(axis=1, keepdims=True))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * width, pa.int32()), pa.array((n / np.where(norm > 0, norm, 1)).ravel()))

    return vectors(tx.tokens(F.coalesce(c, F.lit(""))))


def containing(questions: DataFrame, phrases: DataFrame) -> DataFrame:
    """query_id, doc where a phrase (doc, alias) is a substring of the lower-case question.

    A substring test without a nested loop: the question's substrings of the lengths that phrases have, as many as
    its characters a length, meet the phrases by equality.
    """
    lengths = [r[0] for r in phrases.select(F.char_length("alias").alias("n")).filter("n > 0").distinct().collect()]  # as many as the longest phrase has characters
    if not lengths:
        return questions.join(phrases.select("doc"), F.lit(False)).select("query_id", "doc")
    low = questions.select("query_id", F.lower("question").alias("q")).filter("q <> ''")
    cut = low.select("query_id", "q", F.explode(F.array(*[F.lit(n) for n in sorted(lengths)])).alias("n")).filter(F.char_length("q") >= F.col("n"))
    pieces = cut.select("query_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length("q") - F.col("n") + 1), lambda i: F.substr(F.col("q"), i, F.col("n"))))).alias("alias"))
    return pieces.join(phrases.select("doc", "alias").distinct(), "alias").select("query_id", "doc").distinct()


def alias_list(questions: DataFrame, chunks: DataFrame, aliases: DataFrame, cap: int) -> DataFrame:
    """query_id, doc (chunk), rank: chunks, in corpus order, of the documents one of whose aliases the question names.

    chunks: doc (chunk), doc_id, ord; aliases: doc_id, alias. Only the first ``cap`` chunks of a document can count.
    """
    first = top(chunks.select("doc_id", "doc", "ord"), cap, "doc_id", F.lit(0), F.col("ord")).select("doc_id", "doc", "ord")
    named = containing(questions, aliases.select(F.col("doc_id").alias("doc"), "alias")).withColumnRenamed("doc", "doc_id")
    return top(named.join(first, "doc_id").select("query_id", "doc", "ord"), cap, "query_id", F.lit(0), F.col("ord")).select("query_id", "doc", "rank")


def article_asked(question: Column) -> Column:
    """The number of the first article that a question names; empty if none."""
    return F.regexp_extract(question, legal.ARTICLE_ASKED, 1)


def article_list(questions: DataFrame, chunks: DataFrame, cap: int) -> DataFrame:
    """query_id, doc, rank: chunks, in corpus order, of the article that the question names. A number's chunks are cut
    before they meet the questions, so a number that every document has costs ``cap`` rows a question."""
    asked = questions.select("query_id", article_asked(F.col("question")).alias("article_number")).filter("article_number <> ''")
    first = top(chunks.filter("article_number IS NOT NULL").select("article_number", "doc", "ord"), cap, "article_number", F.lit(0), F.col("ord")).select("article_number", "doc", "ord")
    return top(asked.join(first, "article_number").select("query_id", "doc", "ord"), cap, "query_id", F.lit(0), F.col("ord")).select("query_id", "doc", "rank")


@dataclasses.dataclass(frozen=True)
class Retrieval:
    """What the retriever does. ``of`` reads settings of the session; a value that can't be read is the default."""

    dense_k: int = 50
    sparse_k: int = 50
    fuse_k: int = 40
    rerank_k: int = 12
    rrf_k: int = 60
    w_dense: float = 0.6
    w_sparse: float = 0.4
    w_alias: float = 0.03
    w_article: float = 0.07
    use_expansion: bool = True
    use_bm25: bool = True
    use_alias: bool = True
    use_article: bool = True
    use_rerank: bool = True
    use_documents: bool = False
    documents: int = 4
    use_window: bool = False
    window_radius: int = 1
    window_policy: str = "selective"

    @classmethod
    def of(cls, spark: SparkSession, prefix: str = "lexloom.retrieval.") -> Retrieval:
        read = {}
        for f in dataclasses.fields(cls):
            if (raw := spark.conf.get(prefix + f.name, None)) is not None:
                try:
                    read[f.name] = raw.strip().lower() not in {"0", "false", "no", "off"} if isinstance(f.default, bool) else type(f.default)(raw)
                except ValueError:
                    pass
        return cls(**read)


def best_documents(scored: DataFrame, chunks: DataFrame, n: int) -> DataFrame:
    """Fused chunks of the n documents with the highest summed scores of each question."""
    with_doc = scored.join(chunks.select("doc", "doc_id"), "doc")
    sums = with_doc.groupBy("query_id", "doc_id").agg(F.round(F.sum("score"), 8).alias("total"))
    keep = top(sums, n, "query_id", F.col("total"), F.col("doc_id")).select("query_id", "doc_id")
    return with_doc.join(keep, ["query_id", "doc_id"]).drop("doc_id")  # a row of keep for each pair


def window(seeds: DataFrame, chunks: DataFrame, questions: DataFrame, radius: int, policy: str) -> DataFrame:
    """query_id, doc, rank: each seed, then its siblings of the same document and article within ``radius``; first mention wins.

    ``selective`` widens a seed only if the question names its article or two of the ten best seeds share it.
    seeds: query_id, doc, rank.
    """
    known = chunks.select("doc", "doc_id", "article_number", "ord")
    s = seeds.select("query_id", "doc", "rank").join(known, "doc").join(questions.select("query_id", article_asked(F.col("question")).alias("asked")), "query_id")
    votes = F.sum((F.col("rank") <= 10).cast("int")).over(W.partitionBy("query_id", "doc_id", "article_number"))
    wide = F.col("article_number").isNotNull() & (F.lit(policy == "all") | (F.col("article_number") == F.col("asked")) | (votes >= 2))
    s = s.withColumn("wide", F.coalesce(wide, F.lit(False)))
    order = F.row_number().over(W.partitionBy("doc_id", "article_number").orderBy("ord"))
    mine = known.filter("article_number IS NOT NULL").join(s.filter("wide").select("doc_id", "article_number").distinct(), ["doc_id", "article_number"], "left_semi").withColumn("at", order)
    seed_at = s.filter("wide").join(mine.select("doc", "at"), "doc").select("query_id", "rank", "doc_id", "article_number", F.col("at").alias("seed_at"))
    near = seed_at.join(mine, ["doc_id", "article_number"]).filter(F.abs(F.col("at") - F.col("seed_at")) <= radius)
    rows = s.select("query_id", "doc", "rank", F.lit(0).alias("side"), F.lit(0).alias("at")).unionByName(near.select("query_id", "doc", "rank", F.lit(1).alias("side"), "at"))
    first = dealt_anew(rows, "query_id", "doc").groupBy("query_id", "doc").agg(F.min(F.struct("rank", "side", "at")).alias("x"))
    return first.select("query_id", "doc", F.row_number().over(W.partitionBy("query_id").orderBy("x.rank", "x.side", "x.at")).cast("long").alias("rank"))


def lexical_share(question: Column, text: Column) -> Column:
    """The share of the question's distinct words that the text has: what stands in for a cross-encoder that isn't given."""
    asked = F.array_distinct(tx.tokens(question))
    return F.round(F.size(F.array_intersect(asked, tx.tokens(text))) / F.greatest(F.size(asked), F.lit(1)), 6)


def retrieve(chunks: DataFrame, questions: DataFrame, k: int, aliases: DataFrame | None = None, embed: Callable[[Column], Column] | None = None, rerank: Callable[[Column, Column], Column] = lexical_share, config: Retrieval = Retrieval()) -> DataFrame:
    """query_id, doc, rank, score: expansion, four rank lists, weighted fusion, documents, reranker, window, the first k.

    chunks: doc, doc_id, article_number, ord, text; questions: query_id, question. Alias and article lists read the
    question as it was asked, the others and the reranker the expanded one. Without ``embed`` the dense list is empty.
    """
    asked = questions.select("query_id", "question")
    full = asked.select("query_id", (tx.expand(F.col("question"), legal.QUERY_EXPANSIONS) if config.use_expansion else F.col("question")).alias("question"))
    lists = []
    if embed is not None:
        vectors = chunks.select(F.col("doc"), embed(F.col("text")).alias("embedding"))
        lists.append((vector_top(vectors, full.select("query_id", embed(F.col("question")).alias("embedding")), config.dense_k, "doc"), "dense", config.w_dense))
    if config.use_bm25:
        lists.append((Bm25(chunks, "doc").search(full, config.sparse_k), "bm25", config.w_sparse))
    if config.use_alias and aliases is not None:
        lists.append((alias_list(asked, chunks, aliases, config.dense_k), "alias", config.w_alias))
    if config.use_article:
        lists.append((article_list(asked, chunks, config.dense_k), "article", config.w_article))
    fused = rrf(lists, config.rrf_k)
    if config.use_documents:
        fused = best_documents(fused, chunks, config.documents)
    ranked = top(fused.select("query_id", "doc", "score"), config.fuse_k, "query_id", F.col("score"), F.col("doc"))
    if config.use_rerank:
        met = ranked.select("query_id", "doc").join(chunks.select("doc", "text"), "doc").join(full, "query_id").select("query_id", "doc", rerank(F.col("question"), F.col("text")).alias("score"))
        ranked = top(met, config.rerank_k, "query_id", F.col("score"), F.col("doc"))
    if config.use_window:
        scores = ranked.select("query_id", "doc", "score")
        ranked = window(ranked, chunks, asked, config.window_radius, config.window_policy).join(scores, ["query_id", "doc"], "left")
    return ranked.filter(F.col("rank") <= k).select("query_id", "doc", "rank", "score")


def units_for(units: DataFrame, seeds: DataFrame, allowed: tuple[str, ...] = ("point", "clause")) -> DataFrame:
    """query_id, unit_id: the allowed units of the seeds' articles; a question whose seeds have none gets all units of any type.

    units: unit_id, unit_type, doc_id, article_number; seeds: query_id, doc_id, article_number.
    """
    own = units.filter(F.col("unit_type").isin(*allowed)).select("unit_id", "doc_id", "article_number").distinct()
    return seeds.select("query_id", "doc_id", "article_number").distinct().join(own, ["doc_id", "article_number"]).select("query_id", "unit_id").distinct()


def retrieve_units(units: DataFrame, questions: DataFrame, seeds: DataFrame, k: int = 8, candidates: int = 30, allowed: tuple[str, ...] = ("point", "clause"), rerank: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """query_id, unit_id, score, rank: BM25 over the units' paths and texts among the units of the seeds' articles.

    Where the seeds have no unit, all units compete. With ``rerank`` the ``candidates`` best are ordered by it."""
    one, seeds = units.dropDuplicates(["unit_id"]), settled(seeds)
    index = Bm25(one.select(F.col("unit_id"), F.concat_ws("\n", F.coalesce("legal_path", F.lit("")), "text").alias("body")), "unit_id", "body")
    pairs = settled(units_for(units, seeds, allowed))
    scored = index.score_pairs(pairs.select("query_id", F.col("unit_id").alias("doc")), questions)
    most = max(k, candidates)
    ranked = top(scored, most, "query_id", F.col("score"), F.col("doc")).select("query_id", "doc", "score", "rank")
    others = settled(questions.join(pairs.select("query_id").distinct(), "query_id", "left_anti"))
    ranked = ranked.unionByName(index.search(others, most).select("query_id", "doc", "score", "rank"))
    if rerank is not None:
        met = ranked.select("query_id", "doc").join(one.select(F.col("unit_id").alias("doc"), "text"), "doc").join(questions, "query_id")
        ranked = top(met.select("query_id", "doc", rerank(F.col("question"), F.col("text")).alias("score")), k, "query_id", F.col("score"), F.col("doc"))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("doc").alias("unit_id"), "score", "rank")


def holding(rows: DataFrame, passages: DataFrame) -> DataFrame:
    """query_id, doc where the row's text holds the passage verbatim.

    A passage's inner words stand whole in any text that holds it, so the longest of them is its key: a text is split
    once, its words meet the keys by hash, and only then the passages are looked for. Passages of two words or fewer
    have no inner word; they alone are looked for in every text. Passages are collected in passes of MOST_QUERIES.
    """
    spark = rows.sparkSession
    ship(spark)
    rows = rows.select("doc", "text").filter("text IS NOT NULL")
    asked = passages.filter("passage <> ''").select("query_id", "passage")
    schema = f"query_id {passages.schema['query_id'].dataType.simpleString()}, doc {rows.schema['doc'].dataType.simpleString()}"
    kind, parts = to_arrow_type(passages.schema["query_id"].dataType), []
    for some in passes(asked):
        keyed, every = {}, []
        for q, p in some:
            inner = p.split()[1:-1]
            (keyed.setdefault(max(inner, key=len), []) if inner else every).append((q, p))

        def run(batches: Iterator[pa.RecordBatch], keyed=keyed, every=every) -> Iterator[pa.RecordBatch]:
            keys = keyed.keys()
            for b in batches:
                found = []
                for i, text in enumerate(b.column("text").to_pylist()):
                    near = keys & set(text.split()) if keyed else ()
                    found += [(q, i) for some in (every, *(keyed[k] for k in near)) for q, p in some if p in text]
                ids = b.column("doc").take(pa.array([i for _, i in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in found], kind), ids], ["query_id", "doc"])

        parts.append(rows.mapInArrow(run, schema))
    return union(parts, spark.createDataFrame([], schema))
