"""Language-model scoring by context-tree weighting over bytes.

Each byte is coded as eight binary decisions. For each decision a context tree over the preceding bytes
holds counts of both outcomes; every node's Krichevsky-Trofimov estimate is mixed with the product of its
children, half and half, over all depths from 0 to ``DEPTH``. After training, the chance of a byte is the
posterior mixture along its context path; a context without counts answers 1/2.

The tree holds every counted context. Pass one counts all (DEPTH + 1)-grams of all texts (in training texts and
anywhere) and all words of the training texts, partly summed in each task, summed by one shuffle. A context's
subtree depends only on grams that share its last ``SPLIT`` bytes, so grams are dealt by these, and each task
builds whole subtrees, one bit position at a time, and writes for every gram the mixture below depth SPLIT.
The nodes above are at most 256 ** (SPLIT - 1) contexts; their children's weights are summed by node and
mixed on the driver. Then every gram has its log chance; one seen in no training text runs through nodes
without counts, which answer 1/2.

Pass two scores every text where it is read. Chances of the frequent grams (at least ``1 / GRAMS`` of all
counts, so by the pigeonhole principle at most GRAMS) are broadcast; the rest of each text's grams meet theirs
in a shuffle. The bound of the broadcast decides which way a chance takes and not what it is.

The word baseline needs exact counts of all words. The frequent ones (at least ``1 / WORDS`` of all tokens, at
most WORDS of at most ``WORD_BYTES`` bytes) are broadcast; the rest of each text's words meet their counts in
a shuffle, one row for each text and word.

Defined results: a null text is empty and scores its end alone; a null id counts as the empty text in the
fold; a text's score has its end as a last symbol; with nothing to learn from, each bit costs one bit;
repeated rows each get their row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import python_ready, columns_of, materialize, text_of
from .language_id import held_out_fold

DEPTH = 5
#: Bytes of context that tell subtrees apart.
SPLIT = 2
GRAMS = 1 << 22
#: Distinct grams that a task builds subtrees of, about.
TREE_GRAMS = 250_000
WORDS = 1 << 20
WORD_BYTES = 64
FOLDS, HELD_OUT = 7, 2
#: Bytes of text that a task counts or scores at once.
CHUNK = 4 << 20


def lower_bytes(text: str | None) -> bytes:
    """Only A-Z become lower case, as bytes.lower does."""
    return (text or "").encode("utf-8", "replace").lower()


def grams_of(texts: list[bytes], depth: int):
    """(gram at each scored byte, scored bytes of each text): DEPTH zero bytes precede a text, one ends it."""
    import numpy as np

    pad = bytes(depth)
    data = np.frombuffer(pad + pad.join(texts) + pad if depth else b"".join(texts), np.uint8).astype(np.int64)
    grams = np.zeros(len(data) - depth, np.int64)
    for i in range(depth + 1):
        grams = (grams << 8) | data[i : len(data) - depth + i]
    sizes = np.array([len(t) for t in texts], np.int64) + 1
    scored = np.ones(len(grams), bool)  # of the depth zero bytes after a text, only the first is its end
    ends = np.cumsum(sizes + depth - 1) - (depth - 1)
    for i in range(depth - 1):
        gone = ends + i
        scored[gone[gone < len(grams)]] = False
    return grams[scored], sizes


def word_hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word) - (1 << 63)


def count_pass(depth: int):
    """Batches of texts to partly summed (kind, key, n, everywhere): kind 0 grams, kind 1 words by 64-bit hash; n counts in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        import numpy as np

        words: Counter = Counter()
        none = np.zeros(0, np.int64)
        held_keys, held_counts, held_all = none, none, none

        def rows(kind, keys, counts, everywhere):
            for i in range(0, len(keys), 100_000):
                k, n, m = (x[i : i + 100_000] for x in (keys, counts, everywhere))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(n), pa.array(m)], ["kind", "key", "n", "everywhere"])

        def chunks():
            some, size = ([], []), 0
            for b in batches:
                for t, held in zip(b.column("text").to_pylist(), b.column("held_out").to_pylist(), strict=True):
                    t = lower_bytes(t)
                    some[bool(held)].append(t)
                    size += len(t)
                    if size >= CHUNK:
                        yield some
                        some, size = ([], []), 0
            if some[0] or some[1]:
                yield some

        def hashed(words):
            counts = np.array(list(words.values()), np.int64)
            return np.array([word_hash(w) for w in words], np.int64), counts, counts

        for train, held in chunks():
            keys, counts = np.unique(grams_of(train, depth)[0], return_counts=True) if train else (none, none)
            more, others = np.unique(grams_of(held, depth)[0], return_counts=True) if held else (none, none)
            merged, at = np.unique(np.concatenate([held_keys, keys, more]), return_inverse=True)
            held_counts = np.bincount(at, np.concatenate([held_counts, counts, 0 * others])).astype(np.int64)
            held_all = np.bincount(at, np.concatenate([held_all, counts, others])).astype(np.int64)
            held_keys = merged
            if len(held_keys) > 2_000_000:
                yield from rows(0, held_keys, held_counts, held_all)
                held_keys, held_counts, held_all = none, none, none
            words.update(b"\n".join(train).split())
            if len(words) > 500_000:
                yield from rows(1, *hashed(words))
                words.clear()
        yield from rows(0, held_keys, held_counts, held_all)
        yield from rows(1, *hashed(words))

    return run


class Table:
    """int64 keys to rows of values by open addressing, looked up in whole arrays."""

    FREE = -1

    def __init__(self, keys, values):
        import numpy as np

        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.keys = np.full(1 << self.bits, self.FREE, np.int64)
        self.values = np.zeros((1 << self.bits, values.shape[1]))
        left = np.arange(len(keys))
        at = self.slots(keys)
        while len(left):
            free = self.keys[at[left]] == self.FREE
            won, first = np.unique(at[left[free]], return_index=True)
            who = left[free][first]
            self.keys[won], self.values[won] = keys[who], values[who]
            done = np.zeros(len(keys), bool)
            done[who] = True
            left = left[~done[left]]
            at[left] = (at[left] + 1) & (len(self.keys) - 1)

    def slots(self, keys):
        import numpy as np

        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys):
        """(values, found) for each key."""
        import numpy as np

        at = self.slots(keys)
        seen = self.keys[at]
        open_ = np.flatnonzero((seen != keys) & (seen != self.FREE))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            seen[open_] = self.keys[at[open_]]
            open_ = open_[(seen[open_] != keys[open_]) & (seen[open_] != self.FREE)]
        return self.values[at], seen == keys


def log_kt(a, b):
    """Natural log of the Krichevsky-Trofimov block estimate for counts a and b (whole arrays)."""

    def log_gamma(x):  # Stirling's series, moved up by 8
        import numpy as np

        x = np.asarray(x, np.float64)
        shift = sum(np.log(x + i) for i in range(8))
        y = x + 8
        return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift

    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1.0) - math.log(math.pi)


def mixtures(grams, counts, first: int, last: int, below=None):
    """For each of the eight bits of a gram's last byte: (nodes at depth ``first``, their log weights, mixture at each gram, levels).

    A node is (context << 8) | the bits of the byte so far after a leading 1. The context tree of a bit position is
    independent of the others. Nodes at depth ``last`` are leaves, or have the summed log weights of their children
    from ``below`` (nodes ascending, sums). ``levels`` holds (depth, nodes, weight of the own estimate, estimate of a 1).
    """
    import numpy as np

    byte, context = grams & 255, (grams >> 8) & ((1 << (8 * last)) - 1)
    for i in range(8):
        bit = (byte >> (7 - i)) & 1
        nodes, at = np.unique((context << 8) | ((256 | byte) >> (8 - i)), return_inverse=True)
        b = np.bincount(at, counts * bit, len(nodes))
        a = np.bincount(at, counts * (1 - bit), len(nodes))
        split = None if below is None else below[1][np.searchsorted(below[0], nodes)]
        levels = []
        for d in range(last, first - 1, -1):
            if d < last:
                kids, (nodes, up) = nodes, np.unique((((nodes >> 8) & ((1 << (8 * d)) - 1)) << 8) | (nodes & 255), return_inverse=True)
                a, b, split = (np.bincount(up, x, len(nodes)) for x in (a, b, weighted))
                at = up[at]
            own, one = log_kt(a, b), (b + 0.5) / (a + b + 1)
            if split is None:
                weighted, mine = own, np.ones(len(nodes))
            else:
                weighted = np.logaddexp(own, split) - math.log(2)
                mine = np.exp(np.minimum(own - math.log(2) - weighted, 0))
            chance = np.where(bit == 1, one[at], 1 - one[at])
            mixed = chance if d == last else mine[at] * chance + (1 - mine[at]) * mixed
            levels.append((d, nodes, mine, one))
        yield nodes, weighted, mixed, levels


def subtrees(depth: int, split: int):
    """All grams of whole subtrees to (key, n, everywhere, mixed: eight doubles), and (node above, summed log weight) rows with a null mixed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        names = ["key", "n", "everywhere", "weight", "mixed"]
        got = [tuple(np.asarray(b.column(c), np.int64) for c in names[:3]) for b in batches]
        if not sum(len(g[0]) for g in got):
            return
        keys, counts, everywhere = (np.concatenate(x) for x in zip(*got, strict=True))
        mixed = np.zeros((len(keys), 8))
        for i, (nodes, weights, chance, _) in enumerate(mixtures(keys, counts, split, depth)):
            mixed[:, i] = chance
            if split:
                above, up = np.unique((((nodes >> 8) & ((1 << (8 * split - 8)) - 1)) << 8) | (nodes & 255), return_inverse=True)
                n, sums = len(above), np.bincount(up, weights, len(above))
                yield pa.RecordBatch.from_arrays([pa.array(above), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(sums), pa.nulls(n, pa.binary())], names)
        for i in range(0, len(keys), 50_000):
            some = slice(i, i + 50_000)
            n = len(keys[some])
            data = pa.array([x.tobytes() for x in mixed[some]], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(keys[some]), pa.array(counts[some]), pa.array(everywhere[some]), pa.nulls(n, pa.float64()), data], names)

    return run


def finish(top: list):
    """(key, everywhere, mixed) to (key, everywhere, log10 of the chance), mixing in the nodes above: top is (depth, own weight, estimate of a 1), deepest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            keys = np.asarray(batch.column("key"), np.int64)
            mixed = np.frombuffer(b"".join(batch.column("mixed").to_pylist()), np.float64).reshape(-1, 8)
            byte, total = keys & 255, np.zeros(len(keys))
            for i in range(8):
                node, bit, p = (256 | byte) >> (8 - i), (byte >> (7 - i)) & 1, mixed[:, i]
                for d, mine, one in top:
                    at = (((keys >> 8) & ((1 << (8 * d)) - 1)) << 8) | node
                    p = mine[at] * np.where(bit == 1, one[at], 1 - one[at]) + (1 - mine[at]) * p
                total += np.log10(p)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("everywhere"), pa.array(total)], ["key", "everywhere", "chance"])

    return run


def fit(rows: DataFrame, depth: int = DEPTH):
    """(scratch table of key, everywhere, chance of every gram of ``rows``, scratch table of word counts) from ``text`` and ``held_out`` columns."""
    import numpy as np

    counts = rows.mapInArrow(count_pass(depth), "kind int, key long, n long, everywhere long").groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("everywhere").alias("everywhere"))
    counts = materialize(counts, "counts")
    grams, words = counts.filter("kind = 0").select("key", "n", "everywhere"), counts.filter("kind = 1").select("key", "n")
    split = min(SPLIT, depth)
    low = lambda d: F.col("key").bitwiseAND(F.lit((1 << (8 * d + 8)) - 1))
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-grams.count() // TREE_GRAMS))
    dealt = grams.repartition(tasks, F.shiftright(low(split), 8))
    built = materialize(dealt.mapInArrow(subtrees(depth, split), "key long, n long, everywhere long, weight double, mixed binary"), "subtrees")
    top = []
    if split:
        sums = built.filter("mixed IS NULL").groupBy("key").agg(F.sum("weight").alias("weight")).toArrow().sort_by("key")  # at most 256 ** split rows
        few = grams.groupBy(low(split - 1).alias("key")).agg(F.sum("n").alias("n")).toArrow()  # at most 256 ** split rows
        below = np.asarray(sums.column("key"), np.int64), np.asarray(sums.column("weight"), np.float64)
        dense = {d: (np.ones(256 << (8 * d)), np.full(256 << (8 * d), 0.5)) for d in range(split - 1, -1, -1)}
        if len(few):
            for *_, levels in mixtures(np.asarray(few.column("key"), np.int64), np.asarray(few.column("n"), np.int64), 0, split - 1, below):
                for d, nodes, mine, one in levels:
                    dense[d][0][nodes], dense[d][1][nodes] = mine, one
        top = [(d, *x) for d, x in dense.items()]
    scored = built.filter("mixed IS NOT NULL").select("key", "everywhere", "mixed").mapInArrow(finish(top), "key long, everywhere long, chance double")
    return materialize(scored, "chances"), words


_tables: dict = {}


def worker_table(key: str, often) -> Table:
    if key not in _tables:
        _tables.clear()
        _tables[key] = Table(often[0], often[1][:, None])
    return _tables[key]


def lm_score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, held_out: int = HELD_OUT, depth: int = DEPTH, grams: int = GRAMS, words_kept: int = WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte."""
    import uuid

    import numpy as np

    spark = df.sparkSession
    python_ready(spark, 1000)
    rows = columns_of(df, doc_id=id_col, text=text_col).select("doc_id", text_of().alias("text"), held_out_fold(F.col("doc_id"), folds, held_out).alias("held_out"))
    chances, words = fit(rows.select("text", "held_out"), depth)
    counted = chances.agg(F.sum("everywhere")).first()[0] or 0
    often = chances.filter(F.col("everywhere") >= max(1, -(-counted // grams))).select("key", "chance").toArrow()  # at most `grams` rows of a long and a double
    often = np.asarray(often.column("key"), np.int64), np.asarray(often.column("chance"), np.float64)
    n_words, distinct = words.agg(F.sum("n"), F.count(F.lit(1))).first()
    n_train = rows.filter(~F.col("held_out")).agg(F.count(F.lit(1))).first()[0]
    total, distinct = (n_words or 0) + n_train, distinct + (n_train > 0)
    unseen = -math.log10(total + distinct + 1)  # log10 of 1 / (N + V + 1)
    frequent = words.filter(F.col("n") >= max(1, -(-total // words_kept))).toArrow()  # at most `words_kept` rows of two longs
    table = dict(zip(frequent.column("key").to_pylist(), (np.log10(np.asarray(frequent.column("n"), np.float64) + 1) + unseen).tolist(), strict=True))
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, often, table, math.log10(n_train + 1) + unseen))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        from pyspark import TaskContext

        key, often, table, end = shared.value
        known, uid = worker_table(key, often), TaskContext.get().partitionId() << 40
        memo: dict = {}
        for b in batches:
            if not b.num_rows:
                continue
            texts = [lower_bytes(t) for t in b.column("text").to_pylist()]
            scores, gone, gone_ends = [], [], [0]
            i = 0
            while i < len(texts):  # a few megabytes at once
                j, size = i, 0
                while j < len(texts) and (j == i or size < CHUNK):
                    size += len(texts[j])
                    j += 1
                keys, sizes = grams_of(texts[i:j], depth)
                values, found = known.find(keys)
                starts = np.cumsum(sizes) - sizes
                scores.append(np.add.reduceat(np.where(found, values[:, 0], 0.0), starts))
                gone.append(keys[~found])
                gone_ends += (gone_ends[-1] + np.cumsum(np.add.reduceat((~found).astype(np.int64), starts))).tolist()
                i = j
            n_tokens, n_common, base, rare_keys, rare_counts = [], [], [], [], []
            for t in texts:
                found, common, s, keys, counts = Counter(t.split()), 0, end, [], []
                for w, n in found.items():
                    h = memo.get(w)
                    if h is None:
                        h = word_hash(w)
                        if len(w) <= WORD_BYTES and len(memo) < 500_000:
                            memo[w] = h
                    p = table.get(h)
                    if p is None:
                        keys.append(h)
                        counts.append(n)
                    else:
                        common += n
                        s += n * p
                n_tokens.append(sum(found.values()) + 1)
                n_common.append(common)
                base.append(s)
                rare_keys.append(keys)
                rare_counts.append(counts)
            uids = list(range(uid, uid + len(texts)))
            uid += len(texts)
            long, real, longs = pa.int64(), pa.float64(), pa.list_(pa.int64())
            data = [(uids, long), (n_tokens, long), (n_common, long), (base, real), (np.concatenate(scores), real), ([len(t) for t in texts], long), (rare_keys, longs), (rare_counts, longs)]
            rare_grams = pa.ListArray.from_arrays(pa.array(gone_ends, pa.int32()), pa.array(np.concatenate(gone), long))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), *[pa.array(x, kind) for x, kind in data], rare_grams], SCORED)

    SCORED = ["doc_id", "held_out", "uid", "n_tokens", "n_common", "base", "score", "n_bytes", "rare", "rare_n", "grams"]
    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(score, f"doc_id {kind}, held_out boolean, uid long, n_tokens long, n_common long, base double, score double, n_bytes long, rare array<long>, rare_n array<long>, grams array<long>")
    scored = materialize(scored, "scored")
    pairs = scored.select("uid", F.explode(F.arrays_zip("rare", "rare_n")).alias("x")).select("uid", F.col("x.rare").alias("key"), F.col("x.rare_n").alias("m"))
    met = pairs.join(words, "key", "left")
    tail = met.groupBy("uid").agg(F.sum(F.when(F.col("n").isNotNull(), F.col("m"))).alias("rare_known"), F.sum(F.col("m") * (F.log10(F.coalesce("n", F.lit(0)) + 1.0) + unseen)).alias("rare_base"))
    asked = scored.select("uid", F.explode("grams").alias("key"))
    far = asked.join(chances.select("key", "chance"), "key").groupBy("uid").agg(F.sum("chance").alias("far"))
    end_known = 1 if n_train else 0
    out = scored.drop("rare", "rare_n", "grams").join(tail, "uid", "left").join(far, "uid", "left").withColumn("score", F.col("score") + F.coalesce("far", F.lit(0.0)))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_common") + F.coalesce("rare_known", F.lit(0)) + end_known).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
        "score",
        "n_bytes",
        (-F.col("score") / math.log10(2) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
