"""Licence scanning: Dice coefficient over word bigrams against licence templates.

The units are all runs of words of a document, across lines and sentences; a line and the whole document are
such runs. Words are normalised (lower case, punctuation aside), and a run is compared to a template by
2 |A n B| / (|A| + |B|) over their sets of word bigrams. As |A n B| is at most |A|, only a document that holds
s t / (2 - t) of a template's s bigrams can reach the threshold t, so almost all documents meet no template at
all. For the rest, a run with the best coefficient can be found among those that begin and end with a bigram of
the template, hold their first bigram once and have at most s (2 - t) / t bigrams.

Of overlapping matches the one that shares most bigrams with its template stays, so that a whole text goes
before its parts.

Defined results: a null or empty text has no licence; a text of one word has no bigram and matches nothing;
among equal shares the higher coefficient, then the longer template, the name and the place decide; repeated rows each get their row; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import python_ready, columns_of, text_of
from .license_templates import TEMPLATES

THRESHOLD = 0.8
WORD = re.compile(r"[^\W_]+(?:\.[^\W_]+)*")
WORDS, PLACES = WORD.findall, WORD.finditer


def bigrams(text: str) -> frozenset[tuple[str, str]]:
    words = WORDS(text.lower().replace("licence", "license"))
    return frozenset(zip(words, words[1:], strict=False))


def dice(a: frozenset, b: frozenset) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


class Templates:
    """Templates by size, with the size bounds of the threshold."""

    def __init__(self, templates: Mapping[str, list[str]], threshold: float):
        self.threshold = threshold
        self.all = sorted(((bigrams(t), name) for name, texts in templates.items() for t in texts), key=lambda x: (len(x[0]), x[1]))
        self.sizes = [len(b) for b, _ in self.all]
        self.needed = [math.ceil(s * threshold / (2 - threshold) - 1e-9) for s in self.sizes]
        self.least = min(self.needed, default=1)
        self.index: dict[tuple[str, str], list[int]] = {}
        for k, (grams, _) in enumerate(self.all):
            for g in grams:
                self.index.setdefault(g, []).append(k)

    def best(self, unit: str) -> tuple[float, str] | None:
        grams = bigrams(unit)
        size, t = len(grams), self.threshold
        if not size:
            return None
        low, high = bisect_left(self.sizes, size * t / (2 - t) - 1e-9), bisect_right(self.sizes, size * (2 - t) / t + 1e-9)
        found = [(dice(grams, b), len(b), name) for b, name in self.all[low:high]]
        found = [x for x in found if x[0] >= t]
        if not found:
            return None
        top = max(found, key=lambda x: (x[0], x[1], [-ord(c) for c in x[2]]))
        return top[0], top[2]


def lowered(text: str) -> str:
    """Lower case with every character in its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def runs(grams: list[int], size: int, held: frozenset[int], threshold: float) -> Iterator[tuple[int, float, int, int]]:
    """(shared, dice, first, last) of the best run from each place; grams are numbered bigrams, ``held`` those of the template."""
    most = size * (2 - threshold) / threshold + 1e-9
    for first, gram in enumerate(grams):
        if gram not in held:
            continue
        seen, shared, best = {gram}, 1, (2 / (1 + size), 1, first)
        for last in range(first + 1, len(grams)):
            x = grams[last]
            if x == gram:
                break  # the run from here is as good
            if x in seen:
                continue
            seen.add(x)
            if len(seen) > most:
                break
            if x in held:
                shared += 1
                best = max(best, (2 * shared / (len(seen) + size), shared, last))
        if best[0] >= threshold:
            yield best[1], best[0], first, best[2]


def scan(text: str, templates: Templates) -> list[tuple[int, int, str, float]]:
    """(start, end, licence, dice) of the matches in order; no two overlap."""
    low = lowered(text).replace("licence", "license")
    words = WORDS(low)
    common = templates.index.keys() & set(zip(words, words[1:], strict=False)) if len(words) > 1 else ()
    if len(common) < templates.least:
        return []
    shares = Counter(k for g in common for k in templates.index[g])
    places = [m.span() for m in PLACES(low)]
    ids: dict[tuple[str, str], int] = {}
    grams = [ids.setdefault(g, len(ids)) for g in zip(words, words[1:], strict=False)]
    found = []
    for k, n in shares.items():
        template, name = templates.all[k]
        if n < templates.needed[k]:
            continue
        held = frozenset(ids[g] for g in template if g in ids)
        found += [(-shared, -d, -len(template), name, first, last) for shared, d, first, last in runs(grams, len(template), held, templates.threshold)]
    taken, starts, out = [], [], []
    for _, d, _, name, first, last in sorted(found):
        i = bisect_right(starts, last + 1)  # matches that begin by this one's last word
        if i and taken[i - 1][1] >= first:
            continue
        starts.insert(i, first)
        taken.insert(i, (first, last + 1))
        out.append((places[first][0], places[last + 1][1], name, -d))
    return sorted(out)


def scan_licenses(df: DataFrame, templates: Mapping[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, license (best), dice, n_matches, spans (array<struct<start, end, license, dice>>)."""
    python_ready(df.sparkSession, 1000)
    rows = columns_of(df, doc_id=id_col, text=text_col).select("doc_id", text_of().alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("license", pa.string()), ("dice", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates, threshold)
        for b in batches:
            spans = [[dict(zip(("start", "end", "license", "dice"), s, strict=True)) for s in scan(t, known)] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(spans, pa.list_(span))], ["doc_id", "spans"])

    found = rows.mapInArrow(run, f"doc_id {kind}, spans array<struct<start:long,end:long,license:string,dice:double>>")
    best = F.element_at(F.array_sort(F.transform("spans", lambda s: F.struct((-s["dice"]).alias("d"), s["start"].alias("start"), s["license"].alias("license")))), 1)
    best = F.when(F.size("spans") > 0, best)
    return found.select("doc_id", best["license"].alias("license"), (-best["d"]).alias("dice"), F.size("spans").cast("long").alias("n_matches"), "spans")
