"""Text out of HTML pages: with built-in functions, and by content selectors in an Arrow pass."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import compact


def html_text(html: Column) -> Column:
    """Page text without scripts, styles, comments and tags."""
    no_code = F.regexp_replace(html, r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return compact(F.regexp_replace(no_code, r"(?s)<!--.*?-->|<[^>]+>", " "))


def main_block(pages: DataFrame) -> DataFrame:
    """page_id, chars, text of the longest text block of each page."""
    blocks = F.regexp_extract_all("html", F.lit(r"(?s)<(?:p|article|main|div|section)[^>]*>([^<]*)"), F.lit(1))
    t = pages.select("page_id", F.explode(blocks).alias("b")).select("page_id", compact(F.col("b")).alias("text"))
    t = t.withColumn("chars", F.char_length("text").cast("long"))
    return t.groupBy("page_id").agg(F.max("chars").alias("chars"), F.max_by("text", F.struct("chars", "text")).alias("text"))


# Content selectors as (tag or None, attribute, value, whole value), and the least lengths of their text and of a block's.
SELECTORS = [(None, "id", "toanvan"), (None, "class", "content1"), (None, "id", "noidung"), (None, "class", "full-content"), ("article", "class", "content"), ("div", "class", "content"), (None, "id", "vanban"), (None, "class", "vanban-content"), (None, "id", "divNoidung"), (None, "class", "box-content"), ("div", "id*", "content")]
LEAST_SELECTED, LEAST_BLOCK = 300, 500
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


def selected(tag: str, attrs: dict[str, str | None], selector: tuple[str | None, str, str]) -> bool:
    name, key, value = selector
    if name and name != tag:
        return False
    own = attrs.get(key.rstrip("*")) or ""
    return value in own.split() if key == "class" else value in own if key.endswith("*") else own == value


class Blocks(HTMLParser):
    """Texts of the first element of each selector and of all ``div``: strings stripped, one a line, scripts and styles left out."""

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, list[list[str]]]] = []
        self.found: dict[int, list[str]] = {}
        self.divs: list[list[str]] = []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        named, into = dict(attrs), []
        for k, s in enumerate(SELECTORS):
            if k not in self.found and selected(tag, named, s):
                into.append(self.found.setdefault(k, []))
        if tag == "div":
            self.divs.append([])
            into.append(self.divs[-1])
        self.open.append((tag, into))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        text = data.strip()
        if text and not any(t in ("script", "style") for t, _ in self.open):
            for _, into in self.open:
                for x in into:
                    x.append(text)


def extract_main(page: str | None) -> str:
    """The longest text of more than 300 characters that a selector finds, else the longest of a ``div`` of more than 500, else none."""
    blocks = Blocks(page or "")
    for texts, least in ((blocks.found.values(), LEAST_SELECTED), (blocks.divs, LEAST_BLOCK)):
        long = [t for t in map("\n".join, texts) if len(t) > least]
        if long:
            return max(long, key=len)
    return ""


def main_text(html: Column) -> Column:
    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(extract_main)

    return run(html)
