"""N-gram Jaccard join: near-duplicate texts by MinHash banding, verified on full n-gram sets.

Texts are compared by their sets of five-word shingles; a link is a Jaccard similarity of at least 0.8.
Bands and rows follow from the recall wanted at the threshold (``banding``). The steps:

1. one pass gives each text a signature; equal texts become one node;
2. band hashes are shuffled; a bucket's members are tied to its smallest node, its hub, and each tie is
   verified on the two full sets, which is linear in the members;
3. linked nodes form classes (smallest label spreads over links, with pointer jumping);
4. buckets whose members are still in different classes are compared in full: members are cut into blocks,
   a task compares one pair of blocks, skips pairs in one class and pairs it knows from an earlier band, and
   returns the links that join classes. No candidate is dropped, and no list of pairs is written;
5. links are counted exactly inside each class, again by pairs of blocks. A class of more than a block is laid in
   rings around its first text first: by the triangle inequality of the Jaccard distance, the texts of two rings
   near the middle are all linked and those of two rings far from each other are not, so that only the other
   pairs of rings are compared.

So every candidate pair is verified or already in one class, and all links within a class are counted. Texts
are reduced to distinct ones before they meet anything, and what a large class or bucket needs to know of itself
is joined by group and salt.

Defined results: a null text is empty; a text of fewer than five words has one shingle, all its words, and a
text without words has none and links to nothing; a very long text is compared whole, in blocks of few texts;
equal texts share a class; null ids take part, and a class takes the smallest id that isn't null; repeated rows
are copies; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import python_ready, columns_of, materialize, text_of

WORDS, THRESHOLD, RECALL, HASHES = 5, 0.8, 0.999, 128
#: A block of a group holds about so many texts, and about so many characters.
BLOCK, BLOCK_CHARS = 256, 1_000_000
#: Parts that a group is salted into where it meets what is known of it; rings of a class by distance.
SALTS, RINGS = 32, 100


def banding(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective rows whose bands still find a pair at the threshold with ``recall``."""
    best = (1, 1)
    for rows in range(1, hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= hashes:
            best = (bands, rows)
    return best


def shingles(text: str, n: int = WORDS) -> set[tuple[str, ...]]:
    words = text.encode("utf-8", "replace").split()
    return set(zip(*(words[i:] for i in range(n)), strict=False)) if len(words) >= n else {tuple(words)} if words else set()


def signer(bands: int, rows: int, n: int = WORDS, seed: int = 7):
    """text -> band hashes (empty for a text without words)."""
    import numpy as np
    import xxhash

    rng = np.random.default_rng(seed)
    draw = lambda size: rng.integers(1, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    mul, add, word_mul, row_mul = draw(bands * rows), draw(bands * rows), draw(n), draw(rows)

    class Hashes(dict):
        def __missing__(self, word):
            if len(self) >= 100_000:
                self.clear()
            h = self[word] = xxhash.xxh64_intdigest(word)
            return h

    hashes = Hashes()

    def mix(x):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        return x ^ (x >> np.uint64(33))

    def sign(text: str):
        words = text.encode("utf-8", "replace").split()
        if not words:
            return None
        h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
        k = max(1, len(h) - n + 1)
        grams = np.zeros(k, np.uint64)
        for i in range(min(n, len(h))):
            grams += mix(h[i : i + k] * word_mul[i])
        grams = mix(grams)
        low = np.full(bands * rows, np.uint64(0xFFFFFFFFFFFFFFFF))
        for at in range(0, k, 2048):
            low = np.minimum(low, (grams[at : at + 2048, None] * mul + add).min(axis=0))
        return mix((low.reshape(bands, rows) * row_mul).sum(axis=1, dtype=np.uint64)).view(np.int64)

    return sign


def signatures(nodes: DataFrame, bands: int, rows: int) -> DataFrame:
    """node, bands (array of long) from node, text; texts without words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = signer(bands, rows)
        for b in batches:
            signed = [sign(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([None if s is None else s.tolist() for s in signed], pa.list_(pa.int64()))], ["node", "bands"])

    return nodes.mapInArrow(run, "node binary, bands array<long>").filter("bands is not null")


def met(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join that shuffles both sides, never a broadcast: every table here grows with the input, and the planner goes
    by compressed bytes, of which a table salted or sorted by its key has a small part of what the driver would hold."""
    return left.join(right.hint("merge"), on, how)


def verified(edges: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold."""

    @F.pandas_udf("boolean")
    def similar(x, y):
        import pandas as pd

        def reach(s, t):
            s, t = shingles(s), shingles(t)
            both = len(s & t)
            return both >= threshold * (len(s) + len(t) - both)

        return pd.Series([reach(s, t) for s, t in zip(x, y, strict=True)], dtype="bool")

    joined = met(met(edges, texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a"), texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    return joined.filter(similar("x", "y")).select("a", "b")


def classes_of(edges: DataFrame) -> DataFrame:
    """node, class (the smallest node that links lead to), for nodes with a link. Each round is written out."""
    both = materialize(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("class")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = met(both, labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("class").alias("near"))
        least = met(labels, near, labels["node"] == near["a"], "left").select("node", F.col("class").alias("was"), F.least("class", "near").alias("class"))
        jump = labels.select(F.col("node").alias("class"), F.col("class").alias("further"))
        moved = materialize(met(least, jump, "class", "left").select("node", "was", F.least("class", "further").alias("class")), "labels")
        labels = moved.select("node", "class")
        if moved.filter(F.col("was") != F.col("class")).isEmpty():
            return labels


def salted(members: DataFrame, known: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``members`` joined to what is ``known`` of their groups, with no group in one task: ``known`` is repeated for each salt."""
    salt = F.pmod(F.xxhash64("node", F.lit("salt")), F.lit(SALTS)).cast("int")
    spread = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return met(members.withColumn("salt", salt), spread, [*keys, "salt"], how).drop("salt")


def blocks_of(count, chars):
    return F.greatest(F.ceil(count / BLOCK), F.ceil(chars / BLOCK_CHARS), F.lit(1)).cast("int")


def in_blocks(members: DataFrame, work, schema: str) -> DataFrame:
    """Run ``work`` on each pair of blocks of each group. members: grp, node, text and further columns.

    ``work`` gets two lists of rows (the same list twice for a block with itself) and returns column lists.
    """
    sizes = members.groupBy("grp").agg(blocks_of(F.count(F.lit(1)), F.sum(F.char_length("text"))).alias("blocks"))
    many = materialize(sizes.filter("blocks > 1"), "many-blocks")  # one of BLOCK texts or BLOCK_CHARS characters at most
    blocks = F.coalesce("blocks", F.lit(1))
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    dealt = salted(members, many, ["grp"], "left").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return compared(dealt.select(*members.columns, "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")), work, schema)


def compared(dealt: DataFrame, work, schema: str) -> DataFrame:
    """``work`` on the rows of each (grp, i, j), of which those with own = i are the left and those with own = j the right."""
    spark = dealt.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = dealt.repartition(n, "grp", "i", "j").sortWithinPartitions("grp", "i", "j")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out, kinds = None, [], [], None

        def done():
            left = [r for r in rows if r["own"] == key[1]]
            right = left if key[1] == key[2] else [r for r in rows if r["own"] == key[2]]
            return work(left, right, left is right) if left and right else []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kinds[k]) for k in range(len(names))], names)

        kinds = [{"binary": pa.binary(), "long": pa.int64()}[c.split()[1]] for c in schema.split(", ")]
        for b in batches:
            for r in b.to_pylist():
                now = (r["grp"], r["i"], r["j"])
                if now != key:
                    if rows:
                        out += done()
                    key, rows = now, []
                    if len(out) > 10_000:
                        yield batch()
                        out = []
                rows.append(r)
        if rows:
            out += done()
        yield batch()

    return sorted_.mapInArrow(run, schema)


def similarities(left: list[dict], right: list[dict]) -> Iterator[tuple[int, object]]:
    """For each row of ``left``: its index and the Jaccard similarities to all of ``right``."""
    import numpy as np

    number: dict = {}
    ids = [np.fromiter((number.setdefault(s, len(number)) for s in shingles(r["text"])), np.int64) for r in right]
    sizes = np.array([len(x) for x in ids])
    whole, starts = np.concatenate(ids), np.concatenate([[0], np.cumsum(sizes)[:-1]])
    mine = ids if left is right else None
    for k, r in enumerate(left):
        mark = np.zeros(len(number), np.int32)
        s = mine[k] if mine else shingles(r["text"])
        known = s if mine else np.array([number[x] for x in s if x in number], np.int64)
        mark[known] = 1
        both = np.add.reduceat(mark[whole], starts)
        yield k, both / (len(s) + sizes - both)


def joining_links(threshold: float):
    """Block work: pairs of different classes that reach the threshold, one for each two classes that they join."""

    def work(left, right, same):
        import numpy as np

        found, joined = [], {}

        def root(c):
            while joined.get(c, c) != c:
                c = joined[c]
            return c

        if len({r["class"] for r in left} | {r["class"] for r in right}) == 1:
            return []
        bands = np.array([r["bands"] for r in right])
        classes = np.array([r["class"] for r in right], object)
        own = left[0]["band"]
        for k, near in similarities(left, right):
            a = left[k]
            open_ = (near >= threshold) & (classes != a["class"]) & ~(bands[:, :own] == np.array(a["bands"][:own])).any(axis=1)
            for i in np.flatnonzero(open_):
                x, y = root(a["class"]), root(classes[i])
                if x != y:
                    joined[max(x, y)] = min(x, y)
                    found.append((a["node"], right[i]["node"]))
        return found

    return work


def counting_links(threshold: float):
    """Block work: for each row, how many rows of the other block it is linked to."""

    def work(left, right, same):
        import numpy as np

        counts, back = [], np.zeros(len(right), np.int64)
        for k, near in similarities(left, right):
            hits = near >= threshold
            if same:
                hits[k] = False
            counts.append((left[k]["node"], int(hits.sum())))
            back += hits
        return counts if same else counts + [(r["node"], int(n)) for r, n in zip(right, back, strict=True)]

    return work


def links_in_classes(classes: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """node, n_links from node, class: how many texts of its class each is linked to."""

    @F.pandas_udf("int")
    def ring(x, y):
        import pandas as pd

        def far(s, t):
            s, t = shingles(s), shingles(t)
            both = len(s & t)
            return int(RINGS * (1 - both / max(1, len(s) + len(t) - both)))

        return pd.Series([far(s, t) for s, t in zip(x, y, strict=True)], dtype="int32")

    schema = "node binary, n_links long"
    large = materialize(classes.groupBy("class").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK).select("class", F.lit(True).alias("large")), "large-classes")
    marked = materialize(salted(classes, large, ["class"], "left"), "class-members")
    few = met(marked.filter("large IS NULL").select(F.col("class").alias("grp"), "node"), texts, "node")
    found = in_blocks(few, counting_links(threshold), schema)
    if large.isEmpty():
        return found
    middles = met(large.select("class"), texts.select(F.col("node").alias("class"), F.col("text").alias("middle")), "class")
    members = met(salted(marked.filter("large").select("class", "node"), middles, ["class"]), texts, "node")
    rings = materialize(members.select("class", "node", ring("text", "middle").alias("ring"), F.char_length("text").alias("chars")), "rings")
    cells = materialize(rings.groupBy("class", "ring").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars")).select("class", "ring", "n", blocks_of(F.col("n"), F.col("chars")).alias("blocks")), "ring-cells")
    other = cells.select("class", F.col("ring").alias("ring2"), F.col("n").alias("n2"), F.col("blocks").alias("blocks2"))
    limit = (1 - threshold) * RINGS
    sure = F.col("ring") + F.col("ring2") + 2 <= limit  # texts of ring k are nearer than (k + 1) / RINGS
    apart = F.abs(F.col("ring") - F.col("ring2")) - 2 >= limit
    codes = F.transform(F.sequence(F.lit(0), F.col("blocks2") - 1), lambda k: F.col("ring2").cast("long") * (1 << 32) + k)
    pairs = met(cells, other, "class")  # at most (RINGS + 1) ** 2 rows a large class
    known = pairs.groupBy("class", "ring", "blocks").agg(
        (F.coalesce(F.sum(F.when(sure, F.col("n2"))), F.lit(0)) - F.max((sure & (F.col("ring") == F.col("ring2"))).cast("int"))).alias("certain"),
        F.flatten(F.collect_list(F.when(~sure & ~apart, codes))).alias("others"),  # a block for each BLOCK texts or BLOCK_CHARS characters of the class
    )
    placed = materialize(salted(rings, known, ["class", "ring"]), "ringed")
    own = F.col("ring").cast("long") * (1 << 32) + F.pmod(F.xxhash64("node"), F.col("blocks"))
    dealt = met(placed.select(F.col("class").alias("grp"), "node", own.alias("own"), F.explode("others").alias("other")), texts, "node")
    dealt = dealt.select("grp", "node", "text", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    return found.unionByName(compared(dealt, counting_links(threshold), schema)).unionByName(placed.select("node", F.col("certain").cast("long").alias("n_links")))


def ngram_jaccard_join(df: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text", nodes: bool = False) -> DataFrame:
    """One row per input row: doc_id, class_id, copy_id, n_copies, n_links; with ``nodes`` also node (md5 of the text)
    and class (the smallest node of the class), which tell texts and classes of one id apart.

    class_id is the smallest doc_id that links and copies lead to, copy_id the smallest with an equal text,
    n_links the number of different texts that are linked to this one.
    """
    python_ready(df.sparkSession, 1000)
    bands, rows = banding(threshold, recall)
    docs = columns_of(df, doc_id=id_col, text=text_col).select("doc_id", text_of().alias("text")).withColumn("node", F.unhex(F.md5(F.encode("text", "UTF-8"))))
    ids = materialize(docs.select("doc_id", "node"), "ids")
    signed = materialize(signatures(docs.select("node", "text"), bands, rows).groupBy("node").agg(F.first("bands").alias("bands")), "signatures")
    members = signed.select("node", F.posexplode("bands").alias("band", "h")).select("node", "band", F.xxhash64("band", "h").alias("grp"))
    hubs = members.groupBy("grp").agg(F.min("node").alias("hub"), F.max("node").alias("top")).filter("hub <> top").select("grp", "hub")
    members = materialize(met(members, hubs, "grp"), "buckets")  # only buckets of two texts or more
    edges = materialize(members.filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct(), "ties")
    involved = members.select("node").distinct()
    texts = materialize(met(docs.groupBy("node").agg(F.first("text").alias("text")), involved, "node", "left_semi"), "texts")
    links = materialize(verified(edges, texts, threshold), "ties-verified")
    classes = classes_of(links)
    labelled = met(members, classes, "node", "left").select("grp", "band", "node", F.coalesce("class", "node").alias("class"))
    mixed = labelled.groupBy("grp").agg(F.min("class").alias("x"), F.max("class").alias("y")).filter("x <> y").select("grp")
    unsettled = met(met(salted(labelled, materialize(mixed, "mixed"), ["grp"]), texts, "node"), signed, "node")
    more = materialize(in_blocks(unsettled, joining_links(threshold), "a binary, b binary"), "more-links")
    if not more.isEmpty():
        classes = classes_of(links.unionByName(more))
    counted = links_in_classes(classes, texts, threshold).groupBy("node").agg(F.sum("n_links").alias("n_links"))
    copies = ids.groupBy("node").agg(F.min("doc_id").alias("copy_id"), F.count(F.lit(1)).alias("n_copies"))
    joined = met(copies, met(classes, counted, "node", "left"), "node", "left")
    grouped = materialize(joined.withColumn("class", F.coalesce("class", "node")), "groups")  # an unlinked text is its own class
    first = grouped.groupBy("class").agg(F.min("copy_id").alias("class_id"))
    table = met(grouped, first, "class").select("node", "class", "class_id", "copy_id", "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return met(ids, table, "node").select("doc_id", "class_id", "copy_id", "n_copies", "n_links", *["node", "class"] * nodes)
