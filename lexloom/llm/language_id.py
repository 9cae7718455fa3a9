"""Language identification by compression.

For each language a Zstandard raw-content dictionary is cut from a bounded sample of labelled rows. A text is
compressed, in blocks, with each dictionary; the language whose dictionary gives the fewest bytes wins. Every
block, long or short, is coded behind ``PRIMERS`` primers of the language, whose own bytes are taken off again:
alone, a short block is too short for entropy coding and has the same size in every language. The margin is the
share of bytes that the winner saves over the runner-up; below ``min_margin`` the answer is rejected.

Bounds of the fit: the ``LANGS`` languages with most labelled rows; ``SAMPLE_ROWS`` texts a language and
``SAMPLE_ALL`` in all, one seeded window of ``WINDOW`` characters from each; ``DICT_BYTES`` for all dictionaries
together. Every text is classified whole.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and rejected; rows with null
lang teach nothing; with no labelled row every text is ``und``; a very long text is coded whole, block by block;
ties go to the language first in code point order; equal texts, so repeated rows too, get equal answers; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import python_ready, columns_of

SAMPLE_ROWS, SAMPLE_ALL, LANGS = 96, 6144, 512
WINDOW = 2048
DICT_BYTES = 4 << 20
#: A language's part of DICT_BYTES, at most this.
DICT_EACH = 96 << 10
BLOCK = 4096
PRIMERS, PRIMER = 2, 512
FOLDS = 5
#: Share of bytes saved over the runner-up below which an answer is rejected. Case is folded first.
MIN_MARGIN = 0.004


def held_out_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """True where crc32 of the id as text falls in the fold; a null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % folds == fold


def fit_dictionaries(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, window: int = WINDOW) -> dict[str, bytes]:
    """Language to dictionary, from ``text, lang``.

    The sample is the lowest text hash in each of 4 * sample_rows classes of hashes, and of these the lowest
    sample_rows. Copies share a hash, so they teach once; partial aggregation keeps a language that holds
    most rows down to that many rows a task before anything is shuffled, and each class is reduced by itself.
    """
    usable = labelled.filter("lang is not null and text is not null")
    known = [r.lang for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "lang").limit(LANGS).collect()]
    sample_rows = max(1, min(sample_rows, SAMPLE_ALL // max(1, len(known))))
    h = F.xxhash64("text", F.lit("language sample"))
    start = F.pmod("h", F.greatest(F.char_length("text") - window + 1, F.lit(1))).cast("int") + 1
    usable = usable.filter(F.col("lang").isin(known)).select("lang", "text", h.alias("h"))
    cut = usable.select("lang", F.pmod("h", F.lit(4 * sample_rows)).alias("slot"), F.struct("h", F.substring("text", start, F.lit(window)).alias("piece")).alias("x"))
    least = cut.groupBy("lang", "slot").agg(F.min("x").alias("x"))
    found = least.select("lang", "x.h", F.lower("x.piece").alias("piece")).collect()  # 4 * SAMPLE_ALL windows at most
    rows = [r for _, rs in groupby(sorted(found, key=lambda r: (r.lang, r.h)), key=lambda r: r.lang) for r in islice(rs, sample_rows)]
    pieces: dict[str, list] = {}
    for r in rows:
        pieces.setdefault(r.lang, []).append(r.piece.encode())
    each = min(DICT_EACH, DICT_BYTES // max(1, len(pieces)))
    return {lang: b"\n".join(x)[:each] for lang, x in pieces.items()}


def coder(dictionary: bytes, block: int = BLOCK):
    """bytes -> bytes that they add to the primers of the dictionary's language."""
    import zstandard as zstd

    primers = [dictionary[i * PRIMER : (i + 1) * PRIMER] for i in range(PRIMERS)]
    rest = dictionary[PRIMERS * PRIMER :]
    own = zstd.ZstdCompressionDict(rest, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    params = zstd.ZstdCompressionParameters.from_level(6, source_size=block + PRIMER, dict_size=len(rest), min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False)
    code = zstd.ZstdCompressor(dict_data=own, compression_params=params).compress
    alone = sum(len(code(p)) for p in primers)
    return lambda x: max(0, sum(len(code(p + x)) for p in primers) - alone)


def predictor(dictionaries: dict[str, bytes], block: int = BLOCK):
    """text -> (language, margin)."""
    langs = sorted(dictionaries)
    coders = [coder(dictionaries[x], block) for x in langs]

    def one(text: str | None) -> tuple[str, float]:
        if not langs or text is None or not any(map(str.isalpha, text)):
            return "und", 0.0
        data = text.lower().encode("utf-8", "replace")
        cut = [data[i : i + block] for i in range(0, len(data), block)]
        sizes = [sum(map(size, cut)) for size in coders]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        rest = [s for i, s in enumerate(sizes) if i != best]
        return langs[best], (min(rest) - sizes[best]) / max(1, min(rest)) if rest else 1.0

    return one


def classifier(dictionaries: dict[str, bytes], block: int = BLOCK):
    """A scalar pandas UDF: text to struct<lang, margin>."""

    @F.pandas_udf("lang string, margin double")
    def classify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        one = predictor(dictionaries, block)
        for texts in batches:
            yield pd.DataFrame([one(t) for t in texts], columns=["lang", "margin"])

    return classify


def answers(df: DataFrame, id_col: str, text_col: str, lang_col: str, folds: int) -> tuple[Column, Column]:
    """(held_out, struct<lang, margin>) as columns of ``df``; the fit is one bounded collect."""
    python_ready(df.sparkSession, 1000)
    held = held_out_fold(F.col(f"`{id_col}`"), folds, 0)
    learn = columns_of(df.filter(~held), text=text_col, lang=lang_col).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return held, classifier(fit_dictionaries(learn))(F.col(f"`{text_col}`").cast("string"))


def rejected(answer: Column, min_margin: float = MIN_MARGIN) -> Column:
    return (answer["lang"] == "und") | (answer["margin"] < min_margin)


def identify_language(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = FOLDS, min_margin: float = MIN_MARGIN) -> DataFrame:
    """doc_id, held_out, lang_pred, score (0 to 1: margin / (margin + ``min_margin``), so 1/2 where rejection begins), margin, rejected.

    Learns only from rows outside fold 0. The fit is one bounded collect; prediction is one narrow pass.
    """
    held, answer = answers(df, id_col, text_col, lang_col, folds)
    out = df.select(F.col(f"`{id_col}`").alias("doc_id"), held.alias("held_out"), answer.alias("a"))
    lang, margin = F.col("a.lang"), F.col("a.margin")
    return out.select("doc_id", "held_out", lang.alias("lang_pred"), F.when(lang == "und", F.lit(0.0)).otherwise(margin / (margin + min_margin)).alias("score"), margin.alias("margin"), rejected(F.col("a"), min_margin).alias("rejected"))


def accepted_language(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = FOLDS, min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows of ``df`` whose language isn't rejected, as they are, without a shuffle: each row is judged by its own text."""
    _, answer = answers(df, id_col, text_col, lang_col, folds)
    rows = df.select(F.struct(*[f"`{c}`" for c in df.columns]).alias("row"), answer.alias("a")).filter(~rejected(F.col("a"), min_margin))
    return rows.select(*[F.col("row")[c].alias(c) for c in df.columns])
