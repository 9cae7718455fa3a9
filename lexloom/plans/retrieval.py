"""Search, fusion, reranking and context over the knowledge base, the documents and the embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import legal
from ..functions import text as tx
from ..operators import evidence, search
from ..operators.ranking import dealt_anew, rrf, top
from ..registry import query, table
from ..scratch import settled
from . import kb
from .sql import tok

#: A third of the questions names an article, a third a decree, a third asks for a fine.
QA = "qa AS (SELECT item_id AS query_id, text AS passage, concat(text, CASE item_id % 3 WHEN 0 THEN concat(' theo Điều ', item_id % 5 + 1) WHEN 1 THEN concat(' tại nghị định ', item_id % 97) ELSE ' mức phạt 400.000 đồng' END) AS question FROM benchmark)"
EXPANDED = "concat_ws(' ', question, " + ", ".join(f"CASE WHEN contains(lower(question), '{k}') AND NOT contains(lower(question), '{v}') THEN '{v}' END" for k, v in legal.QUERY_EXPANSIONS.items()) + ")"
QE = f"{QA}, qe AS (SELECT query_id, question, {EXPANDED} AS expanded FROM qa)"


def bm25_sql(name: str, rows: str, key: str, text: str, queries: str, question: str, k: int, pairs: str | None = None) -> str:
    """CTEs that end in ``name``: query_id, key, score, rank over all rows, or over the given pairs (query_id, key)."""
    n = name
    cross = f"(SELECT query_id, {key} FROM {pairs}) JOIN (SELECT DISTINCT query_id FROM {n}_q) USING (query_id)" if pairs else f"(SELECT DISTINCT query_id FROM {n}_q) CROSS JOIN (SELECT {key} FROM {rows})"
    return f"""{n}_w AS (SELECT {key}, {tok(text)} AS w FROM {rows}), {n}_tf AS (SELECT {key}, term, count(*) AS tf FROM (SELECT {key}, unnest(w) AS term FROM {n}_w) GROUP BY ALL),
{n}_st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM {n}_w), {n}_raw AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS r FROM {n}_tf, {n}_st GROUP BY term, n),
{n}_idf AS (SELECT term, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM {n}_raw) ELSE r END AS idf FROM {n}_raw), {n}_q AS (SELECT query_id, unnest({tok(question)}) AS term FROM {queries}),
{n}_s AS (SELECT query_id, {key}, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / mean))) AS s FROM {n}_q JOIN {n}_idf USING (term) JOIN {n}_tf USING (term) JOIN {n}_w USING ({key}), {n}_st GROUP BY ALL),
{name} AS (SELECT query_id, {key}, round(coalesce(s, 0), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(s, 0), 6) DESC, {key}) AS rank FROM {cross} LEFT JOIN {n}_s USING (query_id, {key}) QUALIFY rank <= {k})"""


RAW = bm25_sql("bm", "documents", "doc_id", "text", "(SELECT item_id AS query_id, text AS question FROM benchmark)", "question", 5)
KBQ = f"{kb.KB}, {QE}, kt AS (SELECT chunk_id AS doc, doc_id, article_number, article, ord, text FROM kb)"
NAMED = " OR ".join(f"contains(lower(question), {a})" for a in ("concat('nghị định ', doc_id % 5000)", "concat(doc_id % 5000, '/2024')", "concat(doc_id % 5000, '-2024')"))
ALIAS = f"al AS (SELECT query_id, doc, row_number() OVER (PARTITION BY query_id ORDER BY ord) AS rank FROM qa JOIN kt ON {NAMED} QUALIFY rank <= 50)"
ARTICLE = r"ar AS (SELECT query_id, doc, row_number() OVER (PARTITION BY query_id ORDER BY ord) AS rank FROM qa JOIN kt ON article_number = regexp_extract(question, '[Đđ]i\S*u\s+(\d+)', 1) QUALIFY rank <= 50)"


def bucket_sql(rows: str, key: str, text: str) -> str:
    return f"(SELECT {key}, b, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS v FROM (SELECT {key}, ('0x' || substr(md5(t), 1, 8))::bigint % 16 AS b, count(*)::double AS n FROM (SELECT {key}, unnest({tok(text)}) AS t FROM {rows}) GROUP BY ALL))"


DENSE_KB = f"dv AS {bucket_sql('kt', 'doc', 'text')}, dq AS {bucket_sql('qe', 'query_id', 'expanded')}, dn AS (SELECT query_id, doc, rank FROM (SELECT query_id, doc, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc) AS rank FROM (SELECT query_id, doc, round(sum(dq.v * dv.v), 5) AS s FROM dq JOIN dv USING (b) GROUP BY ALL)) WHERE rank <= 50)"
FUSED = f"{KBQ}, {bm25_sql('kbm', 'kt', 'doc', 'text', 'qe', 'expanded', 50)}, {ALIAS}, {ARTICLE}, {DENSE_KB}, fu AS (SELECT query_id, doc, round(sum(w / (60 + rank)), 8) AS score FROM (SELECT query_id, doc, rank, 0.6::double AS w FROM dn UNION ALL SELECT query_id, doc, rank, 0.4::double FROM kbm UNION ALL SELECT query_id, doc, rank, 0.03::double FROM al UNION ALL SELECT query_id, doc, rank, 0.07::double FROM ar) GROUP BY ALL), fur AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM fu QUALIFY rank <= 40)"
SHARE = f"round(len(list_intersect(list_distinct({tok('expanded')}), {tok('text')}))::double / greatest(len(list_distinct({tok('expanded')})), 1), 6)"
RERANKED = f"{FUSED}, rx AS (SELECT query_id, doc, {SHARE} AS score FROM fur JOIN kt USING (doc) JOIN qe USING (query_id)), re AS (SELECT query_id, doc, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM rx QUALIFY rank <= 12)"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("item_id")
    more = F.when(i % 3 == 0, F.concat(F.lit(" theo Điều "), (i % 5 + 1).cast("string"))).when(i % 3 == 1, F.concat(F.lit(" tại nghị định "), (i % 97).cast("string"))).otherwise(" mức phạt 400.000 đồng")
    return table(spark, sf_dir, "benchmark").select(i.alias("query_id"), F.col("text").alias("passage"), F.concat("text", more).alias("question"))


def expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select("query_id", tx.expand(F.col("question"), legal.QUERY_EXPANSIONS).alias("question"))


def aliases(chunks: DataFrame) -> DataFrame:
    ids = chunks.select("doc_id", "title").distinct()
    key = F.concat(F.lit("nd_"), (F.col("doc_id") % 5000).cast("string"), F.lit("_2024"))
    return ids.select("doc_id", F.explode(legal.aliases(key, F.col("title"))).alias("alias"))


@query(f"WITH {RAW} SELECT query_id, doc_id AS doc, score, rank FROM bm")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return search.Bm25(table(spark, sf_dir, "documents")).search(q, 5)


DENSE = "dn AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, round(list_dot_product(a.embedding::double[], b.embedding::double[]), 5) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0), dnr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM dn)"


@query(f"WITH {DENSE} SELECT query_id, vec_id, score, rank FROM dnr WHERE rank <= 5")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return search.vector_top(e, e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 5)


@query(f"WITH {KBQ}, {ALIAS} SELECT query_id, doc, rank FROM al")
def alias_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = kb.base(spark, sf_dir)
    return search.alias_list(questions(spark, sf_dir), chunks, aliases(chunks), 50)


@query(f"WITH {KBQ}, {ARTICLE} SELECT query_id, doc, rank FROM ar")
def article_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.article_list(questions(spark, sf_dir), kb.base(spark, sf_dir), 50)


@query(f"WITH {KBQ} SELECT query_id, expanded FROM qe")
def query_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expanded(spark, sf_dir).select("query_id", F.col("question").alias("expanded"))


def lists(spark: SparkSession, sf_dir: str, chunks: DataFrame) -> list:
    asked, full = questions(spark, sf_dir), expanded(spark, sf_dir)
    vectors = chunks.select("doc", search.hashed_embedding(F.col("text")).alias("embedding"))
    dense = search.vector_top(vectors, full.select("query_id", search.hashed_embedding(F.col("question")).alias("embedding")), 50, "doc")
    return [(dense, "dense", 0.6), (search.Bm25(chunks, "doc").search(full, 50), "bm25", 0.4), (search.alias_list(asked, chunks, aliases(chunks), 50), "alias", 0.03), (search.article_list(asked, chunks, 50), "article", 0.07)]


@query(f"WITH {FUSED} SELECT query_id, doc, score, rank FROM fur")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rrf(lists(spark, sf_dir, kb.base(spark, sf_dir)), top_m=40).select("query_id", "doc", "score", "rank")


@query(f"WITH {FUSED}, s AS (SELECT query_id, doc_id, round(sum(score), 8) AS total FROM fu JOIN kt USING (doc) GROUP BY ALL), kd AS (SELECT query_id, doc_id FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY total DESC, doc_id) <= 4) SELECT query_id, doc, score FROM fu JOIN kt USING (doc) SEMI JOIN kd USING (query_id, doc_id)")
def rrf_doc_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = kb.base(spark, sf_dir)
    return search.best_documents(rrf(lists(spark, sf_dir, chunks)), chunks, 4).select("query_id", "doc", "score")


def retrieved(spark: SparkSession, sf_dir: str, k: int, chunks: DataFrame | None = None, **config) -> DataFrame:
    chunks = kb.base(spark, sf_dir) if chunks is None else chunks
    return search.retrieve(chunks, questions(spark, sf_dir), k, aliases(chunks), search.hashed_embedding, config=search.Retrieval(**config))


@query(f"WITH {RERANKED} SELECT query_id, doc, score, rank FROM re")
def rerank_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieved(spark, sf_dir, 12)


@query(f"WITH {RERANKED} SELECT query_id, doc, score, rank FROM re WHERE rank <= 8")
def hybrid_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expansion, dense, BM25, alias and article lists, fusion, reranker and the first eight, for all questions in one plan."""
    return retrieved(spark, sf_dir, 8)


SIBLINGS = "sb AS (SELECT doc, doc_id, article_number, row_number() OVER (PARTITION BY doc_id, article_number ORDER BY ord) AS nth FROM kt WHERE article_number IS NOT NULL)"
WINDOW = rf"""{RERANKED}, {SIBLINGS}, sd AS (SELECT re.query_id, re.doc, re.rank, re.score, sb.doc_id, sb.article_number, sb.nth, (sb.article_number IS NOT NULL AND (sb.article_number = regexp_extract(question, '[Đđ]i\S*u\s+(\d+)', 1) OR sum((re.rank <= 10)::int) OVER (PARTITION BY re.query_id, sb.doc_id, sb.article_number) >= 2)) AS wide FROM re JOIN qa USING (query_id) LEFT JOIN sb USING (doc)),
wr AS (SELECT query_id, doc, rank, 0 AS side, 0 AS nth FROM sd UNION ALL SELECT s.query_id, n.doc, s.rank, 1, n.nth FROM sd s JOIN sb n ON s.wide AND n.doc_id = s.doc_id AND n.article_number = s.article_number AND abs(n.nth - s.nth) <= 1),
wf AS (SELECT query_id, doc, rank, side, nth FROM wr QUALIFY row_number() OVER (PARTITION BY query_id, doc ORDER BY rank, side, nth) = 1),
ww AS (SELECT query_id, doc, row_number() OVER (PARTITION BY query_id ORDER BY rank, side, nth) AS rank FROM wf)"""


@query(f"WITH {WINDOW} SELECT ww.query_id, ww.doc, ww.rank, re.score FROM ww LEFT JOIN re ON re.query_id = ww.query_id AND re.doc = ww.doc WHERE ww.rank <= 20")
def article_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieved(spark, sf_dir, 20, use_window=True)


PACKED = rf"""{RERANKED}, {SIBLINGS}, s2 AS (SELECT re.query_id, re.doc, re.rank, doc_id, article_number, nth FROM re LEFT JOIN sb USING (doc) WHERE re.rank <= 2),
pr AS (SELECT query_id, doc, rank, 0 AS side, 0 AS nth FROM s2 UNION ALL SELECT s.query_id, n.doc, s.rank, 1, n.nth FROM s2 s JOIN sb n ON n.doc_id = s.doc_id AND n.article_number = s.article_number AND abs(n.nth - s.nth) = 1),
pf AS (SELECT query_id, doc, rank, side, nth FROM pr QUALIFY row_number() OVER (PARTITION BY query_id, doc ORDER BY rank, side, nth) = 1),
pk AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, side, nth) AS place, doc, CASE side WHEN 0 THEN 'seed' ELSE 'same_article_neighbor' END AS relation FROM pf QUALIFY place <= 4),
pt AS (SELECT query_id, place, doc, relation, CASE WHEN length(text) > 1400 THEN concat(regexp_replace(CASE WHEN contains(left(text, 1400), ' ') THEN regexp_replace(left(text, 1400), ' [^ ]*$', '') ELSE left(text, 1400) END, '\s+$', ''), ' ...') ELSE text END AS text FROM pk JOIN kt USING (doc))"""


def pack(spark: SparkSession, sf_dir: str, chunks: DataFrame, found: DataFrame | None = None) -> DataFrame:
    return evidence.packed(settled(retrieved(spark, sf_dir, 8, chunks)) if found is None else found, chunks)


@query(f"WITH {PACKED} SELECT query_id, place, doc, relation, md5(text) AS digest FROM pt")
def pack_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, sf_dir, kb.base(spark, sf_dir)).select("query_id", "place", "doc", "relation", F.md5("text").alias("digest"))


UNITS = kb.UN.removeprefix(f"{kb.KX}, ")
SEEDS = f"{RERANKED}, sk AS (SELECT DISTINCT query_id, doc_id, article_number FROM re JOIN kt USING (doc) WHERE rank <= 8 AND article_number IS NOT NULL), {UNITS}, cu AS (SELECT DISTINCT query_id, unit_id FROM sk JOIN un USING (doc_id, article_number) WHERE unit_type IN ('point', 'clause'))"


def seed_articles(spark: SparkSession, sf_dir: str, chunks: DataFrame, k: int = 8, found: DataFrame | None = None) -> DataFrame:
    found = retrieved(spark, sf_dir, k, chunks) if found is None else found
    return found.join(chunks.select("doc", "doc_id", "article_number"), "doc").filter("article_number IS NOT NULL").select("query_id", "doc_id", "article_number").distinct()


@query(f"WITH {SEEDS} SELECT query_id, unit_id FROM cu")
def candidate_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.units_for(kb.units(spark, sf_dir), seed_articles(spark, sf_dir, kb.base(spark, sf_dir)))


def unit_sql(k: int) -> str:
    index = "(SELECT unit_id, concat(legal_path, chr(10), text) AS body FROM un)"
    return f"{SEEDS}, {bm25_sql('ub', index, 'unit_id', 'body', 'qa', 'question', k, 'cu')}, {bm25_sql('ua', index, 'unit_id', 'body', '(SELECT * FROM qa WHERE query_id NOT IN (SELECT query_id FROM cu))', 'question', k)}, uu AS (SELECT * FROM ub UNION ALL SELECT * FROM ua)"


def ranked_units(spark: SparkSession, sf_dir: str, chunks: DataFrame, k: int, found: DataFrame | None = None) -> DataFrame:
    q = questions(spark, sf_dir).select("query_id", "question")
    return search.retrieve_units(kb.units(spark, sf_dir), q, seed_articles(spark, sf_dir, chunks, found=found), k)


@query(f"WITH {unit_sql(8)} SELECT query_id, unit_id, score, rank FROM uu")
def unit_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 over legal paths and texts of the units under the seeds' articles."""
    return ranked_units(spark, sf_dir, kb.base(spark, sf_dir), 8)


#: Spans of the two best chunks of a question. A chunk of one piece falls into sentences, others into their lines; points carry the clause's number and fine.
SPLIT = r"list_filter(list_transform(string_split(regexp_replace(trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')), '([.!?;:]) ', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"
LTOK = lambda c: f"list_filter({tok(c)}, lambda t: length(t) > 1)"
SPANS = rf"""{RERANKED}, h2 AS (SELECT query_id, rank, doc, score, kb.doc_id, kb.article_number, kb.legal_block, kb.text FROM re JOIN kb ON kb.chunk_id = re.doc WHERE rank <= 2),
hl AS (SELECT *, CASE WHEN legal_block IN ('clause', 'point') THEN list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') ELSE {SPLIT} END AS l, regexp_extract(text, '\n(\d+\.) ', 1) AS no, regexp_extract(text, '\n\d+\. (Phạt tiền từ [0-9.]+ đồng đến [0-9.]+ đồng)', 1) AS fine FROM h2),
hx AS (SELECT query_id, rank, doc, score, doc_id, article_number, legal_block, no, fine, unnest(generate_series(0, len(l) - 1))::bigint AS span, unnest(l) AS x FROM hl),
hs AS (SELECT query_id, rank, doc, score, doc_id, article_number, span, CASE WHEN legal_block = 'clause' AND span >= 2 THEN concat(no, ' ', fine, ' ', x) ELSE x END AS text FROM hx),
sp AS (SELECT *, {LTOK('text')} AS st FROM hs WHERE len({LTOK('text')}) > 0), qs AS (SELECT query_id, question, {LTOK('question')} AS qt FROM qa),
n AS (SELECT query_id, count(*) AS n FROM sp GROUP BY 1), w AS (SELECT query_id, t, ln((n + 1) / (count(*) + 0.5)) + 1 AS idf FROM (SELECT query_id, unnest(list_distinct(st)) AS t FROM sp) JOIN n USING (query_id) GROUP BY query_id, t, n),
stf AS (SELECT query_id, doc, span, t, count(*) AS tf FROM (SELECT query_id, doc, span, unnest(st) AS t FROM sp) GROUP BY ALL), qtf AS (SELECT query_id, t, count(*) AS tf, coalesce(max(idf), 1.0) AS idf FROM (SELECT query_id, unnest(qt) AS t FROM qs) LEFT JOIN w USING (query_id, t) GROUP BY query_id, t),
sn AS (SELECT query_id, doc, span, sqrt(sum(tf * idf * tf * idf)) AS s FROM stf JOIN w USING (query_id, t) GROUP BY ALL), qn AS (SELECT query_id, sqrt(sum(tf * idf * tf * idf)) AS s FROM qtf GROUP BY ALL),
dotp AS (SELECT s.query_id, s.doc, s.span, sum(s.tf * q.tf * w.idf * w.idf) AS d FROM stf s JOIN qtf q USING (query_id, t) JOIN w USING (query_id, t) GROUP BY ALL),
sc AS (SELECT sp.*, question, qt, coalesce(d / (sn.s * qn.s), 0) AS cos, len(list_intersect(list_distinct(st), list_distinct(qt)))::double / len(list_distinct(list_concat(st, qt))) AS jac FROM sp JOIN qs USING (query_id) JOIN sn USING (query_id, doc, span) JOIN qn USING (query_id) LEFT JOIN dotp USING (query_id, doc, span)),
mm AS (SELECT query_id, min(score) AS lo, max(score) AS hi FROM sc GROUP BY 1)"""


def hits(spark: SparkSession, sf_dir: str, k: int = 2) -> DataFrame:
    chunks = kb.base(spark, sf_dir)
    return retrieved(spark, sf_dir, k, chunks).join(chunks.select("doc", "doc_id", "article_number", "text"), "doc")


WIDE = 1 << 20  # longer than any span, as SQL has no twin of the cut of long ones


@query(f"WITH {SPANS}, f AS (SELECT query_id, doc, span, rank AS r, 0.45 * cos + 0.2 * jac + 0.1 * CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0 END AS s FROM sc JOIN mm USING (query_id)) SELECT query_id, doc, span, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, r, span) AS rank FROM f QUALIFY rank <= 5")
def span_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best spans of the question's two best chunks."""
    found = evidence.spans_by(hits(spark, sf_dir), questions(spark, sf_dir), lambda q, ds: evidence.rank_spans(q, ds, 5, WIDE))
    return found.select("query_id", "doc", "span", F.round("score", 6).alias("score"), "rank")


_AMOUNT = r"(?i)\b\d+(?:[.,]\d+)?\s*(?:mg/lít|mg/100\s*ml|điểm|tháng|năm|km/h|đồng|triệu|%)"
_CLAUSE = r"(?i)(?:^|[^\p{L}\p{N}_])(?:khoản|mục)\s+(\d+[a-z]?)"


@query(rf"WITH {SPANS}, tops AS (SELECT query_id, doc_id, article_number, regexp_extract_all(text, '{_CLAUSE}', 1) AS named FROM h2 WHERE rank = 1), u AS (SELECT sc.*, tops.doc_id AS td, tops.article_number AS ta, named, regexp_extract_all(lower(replace(sc.text, ',', '.')), '{_AMOUNT}') AS am, regexp_extract_all(lower(replace(question, ',', '.')), '{_AMOUNT}') AS qm, regexp_extract_all(sc.text, '{_CLAUSE}', 1) AS cl FROM sc JOIN tops USING (query_id)) SELECT query_id, doc, span, round(cos + CASE WHEN regexp_matches(text, '^\s*\d+\.\s*[a-zđ]\)') THEN 0.08 ELSE 0 END + 0.10::double * len(list_intersect(list_distinct(am), list_distinct(qm))) + CASE WHEN td = doc_id AND coalesce(ta, '') = coalesce(article_number, '') AND len(list_intersect(named, cl)) > 0 THEN 0.10 ELSE 0 END + 0.02::double / rank, 6) AS relevance FROM u")
def mmr_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate span's relevance, with the bonuses of amounts and clauses and the prior of its chunk."""
    found = evidence.spans_by(hits(spark, sf_dir), questions(spark, sf_dir), lambda q, ds: evidence.relevance(q, ds, WIDE))
    return found.select("query_id", "doc", "span", F.round("score", 6).alias("relevance"))


@query()
def mmr_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greedy choice of six spans of a question's four best chunks, second best last."""
    return evidence.spans_by(hits(spark, sf_dir, 4), questions(spark, sf_dir), evidence.varied).select("query_id", "rank", "doc", "span", F.round("score", 6).alias("score"), "text")


_LABEL = lambda place, doc, path, title: f"concat('[Nguồn ', {place}, ' | ', {doc}, ' | ', {path}, '] Tiêu đề: ', {title}"
_CUT = r"CASE WHEN length(text) > 1400 THEN concat(regexp_replace(CASE WHEN contains(left(text, 1400), ' ') THEN regexp_replace(left(text, 1400), ' [^ ]*$', '') ELSE left(text, 1400) END, '\s+$', ''), ' ...') ELSE text END"
CONTEXT = f"""{PACKED}, {SEEDS.removeprefix(f"{RERANKED}, ")}, {unit_sql(3).removeprefix(f"{SEEDS}, ")},
ev AS (SELECT query_id, 0 AS side, rank AS r, un.doc_id, legal_path AS path, legal_path, un.text FROM uu JOIN un USING (unit_id) UNION ALL SELECT query_id, 1, place, kt.doc_id, coalesce(article, ''), '', pt.text FROM pt JOIN kt USING (doc)),
eo AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY side, r) AS place FROM ev),
ep AS (SELECT query_id, place, doc_id, concat('[Nguồn ', place, ' | ', doc_id, CASE WHEN path <> '' THEN concat(' | ', path) ELSE '' END, '] Tiêu đề: ', {kb.TITLE}, CASE WHEN legal_path <> '' THEN concat(chr(10), 'Cấu trúc: ', legal_path) ELSE '' END, chr(10), {_CUT}) AS part FROM eo)"""


@query(f"WITH {CONTEXT} SELECT query_id, md5(string_agg(part, concat(chr(10), chr(10), '---', chr(10), chr(10)) ORDER BY place)) AS digest, list(doc_id::varchar ORDER BY place) AS sources FROM ep GROUP BY query_id")
def context_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context of each question: three legal units, then the packed chunks that aren't units already."""
    chunks = kb.base(spark, sf_dir)
    null = F.lit(None).cast("string")
    found = settled(retrieved(spark, sf_dir, 8, chunks))  # eight rows a question, which both parts go on from
    kept = pack(spark, sf_dir, chunks, found).select("query_id", F.col("place").alias("rank"), "doc", "text").join(chunks.select("doc", "doc_id", "title", "article"), "doc")
    docs = kept.select("query_id", "rank", "doc", "doc_id", "title", null.alias("legal_path"), "article", "text", null.alias("unit_id"))
    named = kb.units(spark, sf_dir).select("unit_id", "doc_id", "legal_path", "text")
    units = settled(ranked_units(spark, sf_dir, chunks, 3, found)).join(named, "unit_id").dropDuplicates(["query_id", "unit_id"]).select("query_id", "rank", F.col("unit_id").alias("doc"), "doc_id", kb.numbered_title(F.col("doc_id")).alias("title"), "legal_path", null.alias("article"), "text", "unit_id")
    out = evidence.context(docs, units, backup=True)
    return out.select("query_id", F.md5("context").alias("digest"), "sources")


@query("SELECT item_id AS query_id, coalesce(CASE WHEN item_id % 3 = 0 THEN concat('again: ', text) END, text) AS question FROM benchmark")
def query_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.generate import rewritten

    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    cache = q.filter("query_id % 3 = 0").select("question", F.concat(F.lit("again: "), "question").alias("rewritten"))
    return rewritten(q, cache)


GOLD = "gold AS (SELECT b.item_id AS query_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, doc of the documents that hold the passage verbatim."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    return search.holding(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text"), q)


@query(f"WITH {RAW}, {GOLD}, h AS (SELECT query_id, min(rank) FILTER (WHERE (query_id, doc_id) IN (SELECT query_id, doc_id FROM gold)) AS first FROM bm WHERE query_id IN (SELECT query_id FROM gold) GROUP BY 1) SELECT count(*)::bigint AS n, round(avg((first IS NOT NULL)::int), 6) AS recall, round(avg(coalesce(1.0::double / first, 0)), 6) AS mrr FROM h")
def source_recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = gold(spark, sf_dir).withColumn("hit", F.lit(1))
    hit = bm25_topk(spark, sf_dir).join(g.select("query_id").distinct(), "query_id", "left_semi").join(g, ["query_id", "doc"], "left").groupBy("query_id").agg(F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"))
    return hit.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("first").isNotNull().cast("int")), 6).alias("recall"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


@query(f"WITH {RAW}, {GOLD}, qq AS (SELECT item_id AS query_id, text AS question FROM benchmark) SELECT query_id, list_sort(list(b.doc_id)) AS retrieved, coalesce(list_sort(list_distinct(list(g.doc_id) FILTER (WHERE g.doc_id IS NOT NULL))), []) AS hits, any_value(x.n) AS expected, CASE WHEN any_value(x.n) > 0 THEN count(g.doc_id) > 0 END AS source_hit FROM bm b LEFT JOIN gold g USING (query_id, doc_id) LEFT JOIN (SELECT item_id AS query_id, (SELECT count(*) FROM gold WHERE gold.query_id = item_id)::bigint AS n FROM benchmark) x USING (query_id) GROUP BY 1")
def retrieval_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each question what was retrieved and expected, and whether they meet (null where nothing is expected)."""
    found = bm25_topk(spark, sf_dir).select("query_id", "doc", F.lit(1).alias("got"), F.lit(0).alias("held"))
    both = dealt_anew(found.unionByName(gold(spark, sf_dir).select("query_id", "doc", F.lit(0).alias("got"), F.lit(1).alias("held"))), "query_id", "doc")
    pairs = both.groupBy("query_id", "doc").agg(F.sum("got").cast("int").alias("got"), F.sum("held").alias("held"))  # either side is computed once
    times = F.col("got") * F.greatest(F.col("held"), F.lit(1)).cast("int")
    rows = pairs.groupBy("query_id").agg(F.array_sort(F.flatten(F.collect_list(F.array_repeat("doc", times)))).alias("retrieved"), F.array_sort(F.collect_set(F.when((F.col("got") > 0) & (F.col("held") > 0), F.col("doc")))).alias("hits"), F.sum("held").alias("expected"))
    return rows.filter(F.size("retrieved") > 0).select("query_id", "retrieved", "hits", "expected", F.when(F.col("expected") > 0, F.size("hits") > 0).alias("source_hit"))
