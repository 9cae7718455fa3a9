"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs: lines, inside a line its sentences, and all of these after words whose checksum
is 0 modulo ``CUT``, so that an edit moves no cut far away and a text without marks has paragraphs too. The n-th
copy of a paragraph counts as a paragraph of its own, so the digests are a set. A sketch has cells of (count,
xor of digests, xor of check sums); each digest falls in three cells. Subtracting two sketches leaves the
differing digests, which are recovered by peeling cells that hold one digest. If peeling gets stuck, both
sketches are built again, sixteen times as large; sizes that the numbers of paragraphs rule out are passed over.
The likeness of two versions is the Jaccard similarity of their paragraph sets, from the numbers of paragraphs
and of recovered differences.

The fingerprint that is returned is the smallest sketch, ``CELLS`` cells as text. ``decoded`` subtracts and peels
two of them, and says None where they differ by more than such sketches can give; then ``fingerprint`` with more
cells is needed, as it is inside ``likeness``, which starts from the same sketches.

``pair_versions`` meets each document with the next one in descending id order: one range shuffle deals the
texts, neighbours meet inside their partition, and each partition leaves its first and last text as boundary
records, which are matched in a small second step. No partition needs another one's texts.

Defined results: a null text is empty; empty texts have an empty sketch, and two empty texts have likeness
1; equal texts have equal fingerprints; a very long text is cut and sketched whole, in time linear in its length;
documents come in descending doc_id with nulls last, repeated ids by text hash; the document after the last is
the first, so a single document is its own next; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import python_ready, columns_of, materialize, text_of

CELLS, HASHES, GROWTH = 18, 3, 16
#: A sentence ends with a run of marks before white space; the run is taken whole, so dot leaders cost no second look.
PARAGRAPH = re.compile(rb"[^\n]*?(?<![.!?])[.!?]++(?:\s+|$)|[^\n]+").findall
CUT = 32


def paragraphs(text: str) -> list[int]:
    """64-bit digests, distinct: the n-th copy of a paragraph has a digest of its own."""
    seen: dict[bytes, int] = {}
    out, crc, digest = [], zlib.crc32, xxhash.xxh64_intdigest
    for p in PARAGRAPH(text.encode("utf-8", "replace")):
        words = p.split()
        ends = [k + 1 for k, w in enumerate(words) if not crc(w) % CUT]
        if not ends or ends[-1] < len(words):
            ends.append(len(words))
        at = 0
        for end in ends:
            if part := b" ".join(words[at:end]):
                n = seen.get(part, 0)
                seen[part] = n + 1
                out.append(digest(part, n))
            at = end
    return out


def mixed(digests, factor, shift):
    return (digests ^ (digests >> shift)) * factor


class Sketch:
    """Cells as three arrays: counts, xor of digests, xor of checks. A digest has one cell in each third."""

    def __init__(self, digests, cells: int = CELLS, mask: int = (1 << 64) - 1):
        import numpy as np

        self.cells, self.mask = cells, np.uint64(mask)  # the bits of the check sums that are known
        self.count, self.key, self.check = np.zeros(cells, np.int64), np.zeros(cells, np.uint64), np.zeros(cells, np.uint64)
        if len(digests):
            self.toggle(np.asarray(digests, np.uint64), 1)

    def toggle(self, digests, sign) -> None:
        import numpy as np

        u, third = np.uint64, self.cells // HASHES
        spread = np.arange(HASHES, dtype=u)[:, None]
        at = ((mixed(digests, u(0x9E3779B97F4A7C15), u(31)) >> (spread * u(20))) & u(0xFFFFF)) % u(third) + spread * u(third)
        at = at.astype(np.int64).ravel()  # one third after the other
        all_ = lambda x: np.concatenate([x] * HASHES)
        np.add.at(self.count, at, sign if np.isscalar(sign) else all_(sign))
        np.bitwise_xor.at(self.key, at, all_(digests))
        np.bitwise_xor.at(self.check, at, all_(self.checks(digests)))

    @staticmethod
    def checks(digests):
        import numpy as np

        return mixed(digests, np.uint64(0xBF58476D1CE4E5B9), np.uint64(29))

    def minus(self, other: Sketch) -> Sketch:
        out = Sketch((), self.cells, int(self.mask & other.mask))
        out.count, out.key, out.check = self.count - other.count, self.key ^ other.key, self.check ^ other.check
        return out

    def peel(self) -> tuple[list[int], list[int]] | None:
        """(digests only in the first, only in the second), or None if some can't be recovered. Empties the sketch.

        All cells that hold one digest go at once. A sketch of n cells can't give more than n digests: beyond
        that, a chance agreement of check sums has led astray, and the sketch counts as failed.
        """
        import numpy as np

        only: tuple[list[int], list[int]] = ([], [])
        while True:
            pure = np.flatnonzero(np.abs(self.count) == 1)
            if len(pure):
                pure = pure[((self.checks(self.key[pure]) ^ self.check[pure]) & self.mask) == 0]
            if not len(pure):
                return only if not self.count.any() and not self.key.any() else None
            digests, first = np.unique(self.key[pure], return_index=True)
            signs = self.count[pure[first]]
            only[0].extend(digests[signs > 0].tolist())
            only[1].extend(digests[signs < 0].tolist())
            if len(only[0]) + len(only[1]) > self.cells:
                return None
            self.toggle(digests, -signs)

    def text(self, n: int) -> str:
        """Number of paragraphs and cells as URL-safe base64: 4 bytes, then 2 + 8 + 2 bytes a cell, low bits of counts and checks."""
        import base64

        import numpy as np

        cell = np.zeros(self.cells, [("n", ">u2"), ("k", ">u8"), ("c", ">u2")])
        cell["n"], cell["k"], cell["c"] = self.count & 0xFFFF, self.key, self.check & np.uint64(0xFFFF)
        return base64.urlsafe_b64encode(n.to_bytes(4, "big") + cell.tobytes()).decode()


def read_text(fingerprint: str) -> tuple[int, Sketch]:
    """(number of paragraphs, sketch) from ``Sketch.text``; counts are known modulo 2 ** 16, check sums by 16 bits."""
    import base64

    import numpy as np

    data = base64.urlsafe_b64decode(fingerprint)
    cell = np.frombuffer(data[4:], [("n", ">u2"), ("k", ">u8"), ("c", ">u2")])
    sketch = Sketch((), len(cell), 0xFFFF)
    sketch.count, sketch.key, sketch.check = cell["n"].astype(np.int64), cell["k"].astype(np.uint64), cell["c"].astype(np.uint64)
    return int.from_bytes(data[:4], "big"), sketch


def decoded(a: str, b: str) -> float | None:
    """Likeness of two texts from their fingerprints alone, None where their sketches are too small for it."""
    (m, x), (n, y) = read_text(a), read_text(b)
    if x.cells != y.cells:
        return None
    gap = x.minus(y)
    gap.count = (gap.count + 0x8000) % 0x10000 - 0x8000
    found = gap.peel()
    if found is None:
        return None
    first, second = map(len, found)
    return 1.0 if not m + second else (m - first) / (m + second)


def difference(a: list[int], b: list[int], first: Sketch | None = None, second: Sketch | None = None) -> tuple[list[int], list[int]]:
    """Differing digests by sketches of growing size. Digests that share all their cells at every size (chance of
    2 ** -60 a pair) would never peel; beyond 64 times the paragraphs the sets themselves are subtracted."""
    cells, least = CELLS, abs(len(a) - len(b))
    while cells <= 64 * (len(a) + len(b)) + CELLS * GROWTH:
        if cells >= least:  # else there are more differences than cells
            x, y = (first, second) if cells == CELLS and first and second else (Sketch(a, cells), Sketch(b, cells))
            if (found := x.minus(y).peel()) is not None:
                return found
        cells *= GROWTH
    x, y = set(map(int, a)), set(map(int, b))
    return list(x - y), list(y - x)


def likeness(a: list[int], b: list[int], first: Sketch | None = None, second: Sketch | None = None) -> float:
    x, y = difference(a, b, first, second)
    both = (len(a) + len(b) - len(x) - len(y)) // 2
    union = both + len(x) + len(y)
    return both / union if union else 1.0


def fingerprint(text: str, cells: int = CELLS) -> str:
    digests = paragraphs(text)
    return Sketch(digests, cells).text(len(digests))


def edited(text: str, other: str) -> str:
    """The last third of the text gives way to the start of the other."""
    k = len(text) // 3
    return text[: len(text) - k] + other[:k]


class Version:
    """A text with what comparing it needs."""

    def __init__(self, text: str):
        import numpy as np

        self.text, self.digests = text, np.array(paragraphs(text), np.uint64)
        self.table = Sketch(self.digests)

    def like(self, other: Version) -> float:
        return likeness(self.digests, other.digests, self.table, other.table)

    def __str__(self) -> str:
        return self.table.text(len(self.digests))


RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compared(this: Version, after: Version) -> dict:
    import hashlib

    new = Version(edited(this.text, after.text))
    return {"n_chars": len(this.text), "edited_sha256": hashlib.sha256(new.text.encode("utf-8", "replace")).hexdigest(), "fingerprint": str(this), "edited_fingerprint": str(new), "near_edited": this.like(new), "near_next": this.like(after)}


def pair_versions(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id and the columns of RESULT."""
    spark = df.sparkSession
    python_ready(spark, 500)
    rows = columns_of(df, doc_id=id_col, text=text_col).select("doc_id", text_of().alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    names = [c.split()[0] for c in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, first = TaskContext.get().partitionId(), None, None
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

        def batch(ids, rows):
            columns = [pa.array([r.get(c) for r in rows], t) for c, t in zip(names, types, strict=True)]
            more = [pa.array([part] * len(rows), pa.int32()), pa.array([r.get("first") for r in rows], pa.string()), pa.array([r.get("last") for r in rows], pa.string())]
            return pa.RecordBatch.from_arrays([ids, *columns, *more], ["doc_id", *names, "part", "first", "last"])

        for b in batches:
            out, ids, texts = [], b.column("doc_id"), b.column("text").to_pylist()
            if not texts:
                continue
            at = ids if last is None else pa.concat_arrays([last[0], ids])
            for k, t in enumerate(texts):
                now = Version(t)
                if last is not None:
                    out.append(compared(last[1], now))
                else:
                    first = t
                last = (ids.slice(k, 1), now)
            yield batch(at.slice(0, len(out)), out)
        if last is not None:  # the last row waits for the next partition's first text
            yield batch(last[0], [{"first": first, "last": last[1].text}])

    passed = materialize(dealt.mapInArrow(run, f"doc_id {kind}, {RESULT}, part int, first string, last string"), "versions")
    edges = passed.filter(F.col("last").isNotNull())
    # As many rows as partitions: each non-empty one learns which comes next, by number alone, and then gets its text.
    parts = edges.select("part")
    follows = parts.select("part", F.coalesce(F.lead("part").over(W.orderBy("part")), F.min("part").over(W.partitionBy())).alias("next"))
    starts = edges.select(F.col("part").alias("next"), F.col("first").alias("after"))
    met = edges.select("doc_id", "part", "last").join(follows, "part").join(starts, "next")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [compared(Version(x), Version(y)) for x, y in zip(b.column("last").to_pylist(), b.column("after").to_pylist(), strict=True)]
            columns = [pa.array([r[c] for r in rows], t) for c, t in zip(names, [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], ["doc_id", *names])

    finished = met.select("doc_id", "last", "after").mapInArrow(finish, f"doc_id {kind}, {RESULT}")
    return passed.filter(F.col("last").isNull()).select("doc_id", *names).unionByName(finished)
