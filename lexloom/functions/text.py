"""Column functions on text. Regular expressions are Unicode-aware where the class matters."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"(?U)\w+"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def compact(c: Column) -> Column:
    """White space runs to one space, ends stripped."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize(c: Column) -> Column:
    """Line ends to LF, blanks and tabs to one space, at most one blank line in a row, ends stripped."""
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def long_tokens(c: Column, least: int = 2) -> Column:
    return F.filter(tokens(c), lambda t: F.char_length(t) >= least)


def rouge_tokens(c: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-case text: accented letters part words."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


# Words that say nothing about a label.
AUDIT_STOP = ["của", "và", "là", "theo", "được", "các", "cho", "trong", "khi", "nào", "gì", "về", "tại", "này", "đó"]


def audit_tokens(c: Column) -> Column:
    """Distinct words of three letters or more without stop words."""
    return F.array_except(long_tokens(c, 3), F.array(*[F.lit(w) for w in AUDIT_STOP]))


def segmented(c: Column, segmenter: Callable[[str], str] | None = None) -> Column:
    """Lower-case text with its words marked by the segmenter, white space compact; without one, or where it fails, the plain lower case."""
    if segmenter is None:
        return compact(F.lower(c))

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return None if t is None else segmenter(t)
            except Exception:  # the segmenter's own failure, whatever it is
                return t

        return texts.map(one)

    return compact(run(F.lower(c)))


def contains_any(c: Column, terms: Sequence[str]) -> Column:
    """Case-insensitive: any of the terms occurs as a substring."""
    low = F.lower(c)
    out = F.lit(False)
    for t in terms:
        out = out | low.contains(t.lower())
    return out


def clip(c: Column, limit: int) -> Column:
    """At most ``limit`` characters, cut at the last space, with an ellipsis."""
    text = compact(c)
    head = F.substring(text, 1, limit)
    cut = F.trim(F.when(head.contains(" "), F.regexp_replace(head, r"(?s) [^ ]*$", "")).otherwise(head))
    return F.when(F.char_length(text) <= limit, text).otherwise(F.concat(cut, F.lit(" ...")))


def expand(question: Column, rules: Mapping[str, str]) -> Column:
    """Append the phrase of each trigger that occurs, unless the question has the phrase already."""
    low = F.lower(question)
    added = [F.when(low.contains(k) & ~low.contains(v), F.lit(v)) for k, v in rules.items()]
    return F.concat_ws(" ", question, *added)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def stable_hash(*parts: Column) -> Column:
    """The first 32 bits of an md5: the same number in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def stable_int(c: Column) -> Column:
    """The first 64 bits of a sha256 as an unsigned whole number."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def chunk_key(chunk_id: Column, doc_id: Column, text: Column) -> Column:
    """The chunk's id, or one made of its document and a digest of its first 200 characters."""
    return F.coalesce(chunk_id.cast("string"), F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("unknown")), F.substring(F.md5(F.encode(F.substring(text, 1, 200), "UTF-8")), 1, 8)))


def json_salvage(c: Column) -> Column:
    """The JSON of a model's answer: inside its first fence, else as it stands, else from the first { to the last }; null if none parses."""
    t = strip(c)
    fenced = F.get(F.split(t, "```"), F.lit(1))
    inner = F.when(fenced.startswith("json"), strip(F.substr(fenced, F.lit(5)))).otherwise(fenced)
    t = F.when(t.startswith("```"), inner).otherwise(t)
    middle = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    valid = lambda x: F.try_parse_json(x).isNotNull()
    return F.when(valid(t), t).when((middle != "") & valid(middle), middle)


def strip_think(c: Column) -> Column:
    """Model output without its thinking blocks and role names."""
    c = F.regexp_replace(c, r"(?s)<think>.*?</think>", "")
    c = F.regexp_replace(c, r"(?i)^\s*(assistant|user|system)\s*:?\s*", "")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def unicode_form(c: Column, form: str = "NFC") -> Column:
    """A Unicode normal form; Spark has no built-in function for it, so this is an Arrow pass."""

    @F.pandas_udf("string")
    def formed(texts: pd.Series) -> pd.Series:
        return texts.astype("object").str.normalize(form)

    return formed(c)


def clean_unicode(c: Column) -> Column:
    """NFC, blanks and tabs to one space, at most one blank line in a row, ends stripped."""
    c = F.regexp_replace(unicode_form(c), r"[ \t]+", " ")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def slug(c: Column) -> Column:
    """Lower case without combining marks, everything else than a-z and 0-9 as single underscores."""
    bare = F.regexp_replace(unicode_form(c, "NFD"), r"[\u0300-\u036f]", "")
    return F.regexp_replace(F.regexp_replace(F.lower(bare), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
