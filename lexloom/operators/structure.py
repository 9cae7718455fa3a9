"""Structural chunking: article, clause and point, by lookahead splits that keep each header with its body."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import compact, strip

# The headers that structure is read from, and the chunker's bounds.
ARTICLE_CUT, CLAUSE_CUT, POINT_CUT = r"(?m)(?=^Điều\s+\d+[a-zA-Z]?\.\s*[^\n]+)", r"(?m)(?=^\d+\.\s+)", r"(?m)(?=^[a-zđ]\)\s+)"
ARTICLE_HEAD, ARTICLE_NO, CLAUSE_NO, POINT_NO = r"^Điều\s+\d+[a-zA-Z]?\.\s*[^\n]+", r"^Điều\s+(\d+[a-zA-Z]?)\.", r"^(\d+)\.\s+", r"^([a-zđ])\)\s+"
LEAST_POINTS, LEAST_CLAUSE = 2, 400
MOST_CHARS, PIECE_CHARS, OVERLAP = 2000, 1600, 180
SEPARATORS = ("Điều ", "Khoản ", "Điểm ", "\n\n", "\n", " ", "")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def pieces(text: Column, cut: str) -> Column:
    """The text cut before each header, stripped, without empty pieces."""
    return F.filter(F.transform(F.split(text, cut), strip), lambda p: F.char_length(p) > 0)


def articles(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, kept columns, article_pos, article_number (null for the preamble), article (title line), body."""
    cut = docs.select("doc_id", *keep, F.posexplode(pieces(F.col("text"), ARTICLE_CUT)).alias("article_pos", "body"))
    number = F.regexp_extract("body", ARTICLE_NO, 1)
    return cut.select("doc_id", *keep, "article_pos", F.when(number != "", number).alias("article_number"), F.when(number != "", compact(F.regexp_extract("body", ARTICLE_HEAD, 0))).alias("article"), "body")


def numbered(parts: Column, header: str) -> Column:
    return F.filter(parts, lambda p: p.rlike(header))


def entry(**fields) -> Column:
    return F.struct(*[(F.lit(v) if v is None or isinstance(v, str) else v).cast("string").alias(k) for k, v in fields.items()])


def chunks(docs: DataFrame, most: int | None = MOST_CHARS) -> DataFrame:
    """All chunks of the hierarchy: doc_id, place (ascending inside a document), legal_section, legal_block, article,
    article_number, clause_number, point_letter, legal_split_part, text.

    Preamble; articles without clauses whole; the lead where there is more than the title; each clause under its
    title; points, in addition, of clauses that are long enough and have enough of them. Chunks beyond ``most``
    characters, and texts without an article, are split by separators; parts of an article carry its title.
    Everything stays inside a row, so nothing is shuffled.
    """
    marked = docs.withColumn("structured", F.coalesce(F.col("text").rlike("(?m)" + ARTICLE_HEAD), F.lit(False)))
    rows = articles(marked, "structured").withColumn("parts", pieces(F.col("body"), CLAUSE_CUT))
    title = F.col("article")

    def points(clause: Column, number: Column) -> Column:
        def listed(cut: Column) -> Column:
            lead = F.when(cut[0].rlike(POINT_NO), F.lit("")).otherwise(cut[0])
            head = F.concat(F.lit("Khoản "), number, F.lit("."), F.when(lead != "", F.concat(F.lit(" "), lead)).otherwise(F.lit("")))
            each = F.transform(numbered(cut, POINT_NO), lambda p: entry(section="article", block="point", clause=number, point=F.regexp_extract(p, POINT_NO, 1), text=F.concat_ws("\n\n", title, head, p)))
            return F.when((F.size(each) >= LEAST_POINTS) & (F.char_length(clause) >= LEAST_CLAUSE), each).otherwise(F.filter(each, lambda _: F.lit(False)))

        return let(pieces(clause, POINT_CUT), listed)

    def of_clause(clause: Column) -> Column:
        number = F.regexp_extract(clause, CLAUSE_NO, 1)
        whole = entry(section="article", block="clause", clause=number, point=None, text=F.concat_ws("\n\n", title, clause))
        return F.concat(F.array(whole), points(clause, number))

    first = F.col("parts")[0]
    lead = F.array(entry(section="article", block="article_lead", clause=None, point=None, text=first))
    inner = F.flatten(F.transform(numbered(F.col("parts"), CLAUSE_NO), of_clause))
    with_lead = F.when(~first.rlike(CLAUSE_NO) & (compact(first) != title), F.concat(lead, inner)).otherwise(inner)
    whole = F.array(entry(section=F.when(title.isNotNull(), "article").when(F.col("structured"), "preamble"), block=None, clause=None, point=None, text=F.col("body")))
    listed = F.when(title.isNotNull() & (F.size(numbered(F.col("parts"), CLAUSE_NO)) > 0), with_lead).otherwise(whole)
    rows = rows.select("doc_id", "article_pos", "structured", "article", "article_number", F.posexplode(listed).alias("inner_pos", "c"))
    text, part, place = F.col("c.text"), F.lit(None).cast("int"), F.shiftleft(F.col("article_pos").cast("long"), 40) + F.shiftleft(F.col("inner_pos").cast("long"), 20)
    if most is not None:

        @F.pandas_udf("array<string>")
        def split(texts):
            return texts.map(lambda t: None if t is None else split_recursive(t))

        long = (F.char_length(text) > most) & (F.col("c.section") == "article")
        rows = rows.withColumn("cut", split(F.when(long | ~F.col("structured"), text)))
        named = F.transform("cut", lambda p: F.when(F.col("structured") & ~F.substr(p, F.lit(1), F.char_length("article") + 20).contains(F.col("article")), F.concat_ws("\n\n", "article", p)).otherwise(p))
        parts = F.coalesce(F.when(F.col("structured"), named).otherwise(F.col("cut")), F.array(text))
        rows = rows.select("*", F.posexplode(parts).alias("split_pos", "piece"))
        part, text, place = F.when(F.col("cut").isNotNull() & F.col("structured"), F.col("split_pos") + 1), F.col("piece"), place + F.col("split_pos")
    return rows.select("doc_id", place.alias("place"), F.col("c.section").alias("legal_section"), F.col("c.block").alias("legal_block"), "article", "article_number", F.col("c.clause").alias("clause_number"), F.col("c.point").alias("point_letter"), part.alias("legal_split_part"), text.alias("text"))


def legal_units(docs: DataFrame) -> DataFrame:
    """Every article, clause and point, however short: doc_id, place, unit_type, unit_id, legal_path, article,
    article_number, clause_number, point_letter, clause_lead, point_text, text. ``docs`` may have a title."""
    docs = docs if "title" in docs.columns else docs.withColumn("title", F.lit(""))
    rows = articles(docs, "title").filter("article_number IS NOT NULL").withColumn("parts", pieces(F.col("body"), CLAUSE_CUT))
    path = F.concat(F.coalesce("title", F.lit("")), F.lit(" > "), "article")
    ident = lambda *more: F.concat_ws("::", F.col("doc_id").cast("string"), F.lit("article"), "article_number", *more)

    def points(clause: Column, number: Column) -> Column:
        def listed(cut: Column) -> Column:
            lead = F.when(cut[0].rlike(POINT_NO), F.lit("")).otherwise(cut[0])

            def one(p: Column) -> Column:
                letter = F.regexp_extract(p, POINT_NO, 1)
                text = strip(F.concat(F.col("article"), F.lit("\nKhoản "), number, F.lit(" điểm "), letter, F.lit("\n\n"), lead, F.lit("\n"), p))
                return entry(unit_type="point", unit_id=ident(F.lit("clause"), number, F.lit("point"), letter), legal_path=F.concat(path, F.lit(" > khoản "), number, F.lit(" > điểm "), letter), clause_number=number, point_letter=letter, clause_lead=compact(lead), point_text=compact(p), text=text)

            return F.transform(numbered(cut, POINT_NO), one)

        return let(pieces(clause, POINT_CUT), listed)

    def of_clause(clause: Column) -> Column:
        number = F.regexp_extract(clause, CLAUSE_NO, 1)
        text = F.concat(F.col("article"), F.lit("\nKhoản "), number, F.lit("\n\n"), clause)
        whole = entry(unit_type="clause", unit_id=ident(F.lit("clause"), number), legal_path=F.concat(path, F.lit(" > khoản "), number), clause_number=number, point_letter=None, clause_lead=None, point_text=None, text=text)
        return F.concat(F.array(whole), points(clause, number))

    article = entry(unit_type="article", unit_id=ident(), legal_path=path, clause_number=None, point_letter=None, clause_lead=None, point_text=None, text=F.col("body"))
    listed = F.concat(F.array(article), F.flatten(F.transform(numbered(F.col("parts"), CLAUSE_NO), of_clause)))
    rows = rows.select("doc_id", "article_pos", "article", "article_number", F.posexplode(listed).alias("inner_pos", "u"))
    place = F.shiftleft(F.col("article_pos").cast("long"), 20) + F.col("inner_pos")
    return rows.select("doc_id", place.alias("place"), "article", "article_number", "u.*")


def cached(spark, path: str, build) -> DataFrame:
    """The rows at ``path``; where there are none yet, ``build()`` is written there first."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    build().write.parquet(path)
    return spark.read.parquet(path)


def split_recursive(text: str, size: int = PIECE_CHARS, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters: cut at the first separator that occurs, again inside what is still
    too long, then neighbours merged greedily, the next piece starting with up to ``overlap`` characters of the last."""
    if len(text) <= size:
        return [text.strip()] if text.strip() else []
    k = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    sep = separators[k]
    if sep:
        first, *rest = text.split(sep)
        units = [first, *(sep + r for r in rest)]
    else:
        units = list(text)
    out: list[str] = []
    held: list[str] = []
    total = 0

    def flush():
        if joined := "".join(held).strip():
            out.append(joined)

    for u in filter(None, units):
        if len(u) > size and sep:
            flush()
            held, total = [], 0
            out += split_recursive(u, size, overlap, separators[k + 1 :] or ("",))
            continue
        if total + len(u) > size:
            flush()
            while held and (total > overlap or total + len(u) > size):
                total -= len(held.pop(0))
        held.append(u)
        total += len(u)
    flush()
    return out


def split_long(docs: DataFrame, most: int = 2000, size: int = 1600, overlap: int = 180) -> DataFrame:
    """doc_id, part (1-based), text: texts up to ``most`` pass, longer ones are split. Arrow batches, no shuffle."""

    @F.pandas_udf("array<string>")
    def parts(texts):
        return texts.map(lambda t: [t] if len(t) <= most else split_recursive(t, size, overlap))

    return docs.select("doc_id", F.posexplode(parts(F.coalesce("text", F.lit("")))).alias("p", "text")).select("doc_id", (F.col("p") + 1).cast("long").alias("part"), "text")


def windows(docs: DataFrame, size: int = 1600, overlap: int = 180) -> DataFrame:
    """doc_id, start (0-based), text: fixed character windows."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.char_length("text") - 1, F.lit(0)), F.lit(step))
    return docs.select("doc_id", "text", F.explode(starts).alias("start")).select("doc_id", F.col("start").cast("long").alias("start"), F.expr(f"substring(text, start + 1, {size})").alias("text"))


def clean_lines(text: Column) -> Column:
    """Without bare page numbers (one to four digits) and gazette headers."""
    kept = F.filter(F.split(text, "\n"), lambda x: ~compact(x).rlike(r"^\d{1,4}$") & ~F.upper(compact(x)).rlike(r"^CÔNG BÁO"))
    return F.array_join(kept, "\n")


def question_blocks(lines: DataFrame) -> DataFrame:
    """Exam questions from lines (doc_id, pos, text, underlined): gaps and islands from headers 'Câu N.' and choices 'k.'.

    Other lines go on with what stands before them; questions of one number in a document are merged, so that a
    page break doesn't part them. doc_id, number, question, choices (at most four), answer (the underlined one's
    letter) and valid: two choices or more and exactly one underlined.
    """
    from pyspark.sql import Window as W

    w = W.partitionBy("doc_id").orderBy("pos")
    header = F.regexp_extract("text", r"^Câu\s+(\d+)\.", 1)
    choice = F.regexp_extract("text", r"^([1-4])\.\s", 1)
    flags = lines.withColumn("number", F.last(F.when(header != "", header), ignorenulls=True).over(w)).filter("number IS NOT NULL")
    flags = flags.withColumn("opens", F.when(header != "", 0).when(choice != "", choice.cast("int")))
    inner = W.partitionBy("doc_id", "number").orderBy("pos")
    parts = flags.withColumn("part", F.last("opens", ignorenulls=True).over(inner))
    joined = parts.groupBy("doc_id", "number", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("text"), F.max("underlined").alias("under"))
    at = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col("part") > 0, F.struct("part", c)))), lambda x: x[c])
    whole = joined.groupBy("doc_id", "number").agg(F.max(F.when(F.col("part") == 0, F.col("text"))).alias("question"), at("text").alias("choices"), at("under").alias("under"))
    marked = F.size(F.filter("under", lambda u: u))
    answer = F.element_at(F.array(*[F.lit(x) for x in "ABCD"]), F.array_position("under", F.lit(True)).cast("int"))
    return whole.select("doc_id", "number", "question", "choices", F.when(marked == 1, answer).alias("answer"), ((F.size("choices") >= 2) & (marked == 1)).alias("valid"))
