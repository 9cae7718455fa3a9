"""Concatenate and cut: tokenised documents on one axis of tokens, cut into fixed windows.

Pass one tokenises each document once, where it is read, and writes its ids with its place inside its
partition. One total per partition is prefix-summed into global offsets (as many rows as partitions). Pass
two cuts what pass one wrote at the multiples of the window and writes a record for each piece; a document
across a boundary gives one record on either side. Nothing is shuffled but the totals, and only the last
sequence is padded.

Defined results: a null text is empty and gives the end id alone; repeated rows are documents of their own;
an empty table gives no rows; other columns are ignored. Strings that name the file's added tokens are those tokens with
``added`` and ordinary text without.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import python_ready, columns_of, materialize, text_of

WINDOW = 1024
END_ID = 0
#: Entries of a worker's cache of piece to ids; it is emptied when full.
CACHE = 400_000
#: Unicode white space. A pre-token never holds white space after something else, so texts can be cut there.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


@functools.cache
def piece_encoder(vocabulary: str, added: bool = False):
    """text -> bytes of little-endian 16-bit ids, for a byte-level BPE file of at most 65536 ids.

    With ``added``, a text is first cut at the file's added tokens, which have ids of their own.

    Merges are ranked by id, as the file lists them, so the faster ``tiktoken`` gives the ids that
    ``tokenizers`` gives (a test holds them against each other); the ids of a word are kept for its next use.
    """
    import json
    import re

    import numpy as np
    import tiktoken

    with open(vocabulary, encoding="utf-8") as f:
        file = json.load(f)
    model = file["model"]
    own = {t["content"]: t["id"] for t in file["added_tokens"]} if added else {}
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["id"] >= 1 << 16 for t in file["added_tokens"] if added):
        raise ValueError("only added tokens that match as they stand, with 16-bit ids")
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    merged = {a + b for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if len(token) == 1 or token in merged}
    assert len(model["vocab"]) <= 1 << 16
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    encode = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    class Cache(dict):
        def __missing__(self, piece: str) -> bytes:
            if len(self) >= CACHE:
                self.clear()
            ids = np.array(encode(piece), "<u2").tobytes()
            if len(piece) <= 64:
                self[piece] = ids
            return ids

    cut, known = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+").findall, Cache()
    plain = lambda text: b"".join(map(known.__getitem__, cut(text)))
    if not own:
        return plain
    apart = re.compile("(" + "|".join(map(re.escape, sorted(own, key=len, reverse=True))) + ")").split
    ids_of = {t: i.to_bytes(2, "little") for t, i in own.items()}
    return lambda text: b"".join(ids_of[x] if k % 2 else plain(x) for k, x in enumerate(apart(text)))


def tokenize(df: DataFrame, vocabulary: str, end_id: int, added: bool = False) -> DataFrame:
    """doc_id, part, start (in the part), doc_tokens, ids (16-bit), written once."""
    rows = df.select("doc_id", text_of().alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part, at = piece_encoder(vocabulary, added), TaskContext.get().partitionId(), 0
        end = end_id.to_bytes(2, "little")
        for b in batches:
            ids = [encode(t) + end for t in b.column("text").to_pylist()]
            sizes = [len(x) // 2 for x in ids]
            starts = list(accumulate(sizes, initial=at))
            at = starts.pop()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([part] * len(ids), pa.int32()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "part", "start", "doc_tokens", "ids"])

    return materialize(rows.mapInArrow(run, f"doc_id {kind}, part int, start long, doc_tokens long, ids binary"), "tokens")


def pack(df: DataFrame, vocabulary: str | None = None, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, added: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, 16-bit)."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    python_ready(df.sparkSession, 1000)
    tokens = tokenize(columns_of(df, doc_id=id_col, text=text_col), vocabulary, end_id, added)
    totals = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    placed = tokens.join(F.broadcast(offsets), "part").select("doc_id", (F.col("start") + F.col("part_start")).alias("at"), "doc_tokens", "ids")  # a row for each partition

    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            of, rows, lists = [], [], []
            for k, (at, n, ids) in enumerate(zip(*(b.column(c).to_pylist() for c in ("at", "doc_tokens", "ids")), strict=True)):
                wide, start = np.frombuffer(ids, "<u2").astype("<u4"), 0
                while start < n:
                    seq, off = divmod(at + start, window)
                    size = min(window - off, n - start)
                    of.append(k)
                    rows.append((start, size, zlib.crc32(wide[start : start + size]), n, seq, off))
                    if with_ids:
                        lists.append(ids[2 * start : 2 * (start + size)])
                    start += size
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] or [pa.array([], pa.int64())] * len(names)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(of, pa.int64())), *columns, *[pa.array(lists, pa.binary())] * with_ids], ["doc_id", *names, *["ids"] * with_ids])

    kind = placed.schema["doc_id"].dataType.simpleString()
    return placed.mapInArrow(cut, ", ".join([f"doc_id {kind}", *[f"{n} long" for n in names], *["ids binary"] * with_ids]))
