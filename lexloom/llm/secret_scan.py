"""Secret scanning: fixed patterns plus a battery of randomness tests. Built-in functions only.

Matches get positions without a Python pass: each match is fenced with a control character (which the text's
own copies of it can't disturb, as they are replaced one for one), the text is split at the fences, and the
lengths of the pieces add up to offsets in code points. The pieces are gone through in blocks of about the root
of their number, so that what is found isn't copied at every step.

The battery looks at every maximal run of 20 or more base64 or base64url characters that touches no base span;
a shorter run can't tell a random string from a word. The encoding is inferred from the characters used
(hexadecimal, base32, base64). Three tests ask whether the token is random, the last two two-sided:

* chi-squared uniformity of the symbol counts over the alphabet (Wilson-Hilferty approximation; too even is no
  offence, as typed secrets are),
* the number of runs above and below the middle of the alphabet (Wald-Wolfowitz),
* the serial correlation of neighbouring symbols.

Their p-values are combined, by twice the smaller of Fisher's and Bonferroni's answer; where randomness is
rejected at ``ORDER_ALPHA`` (counters, patterns, words) the token's p-value below is 1.

The evidence that a token isn't natural text is its chi-squared distance read the other way: under the null
hypothesis "letters as in prose" it is noncentral chi-squared with a noncentrality that grows with the length,
so a short token can hardly be significant and a long one easily is; the lower tail (normal approximation) is
the p-value. Over the other candidates of the corpus the false-discovery rate is held at ``FDR`` for each
encoding and length class by itself, as short tokens and small alphabets can't reach the p-values of long ones:
Benjamini-Hochberg with Storey's estimate of the null tokens of the class, from those with p-values above 1/2.
Where hardly any candidate of a class looks like prose, its limit is far above ``FDR``. The thresholds come from
histograms of log p-values with a fixed number of bins.

Defined results: null and empty texts have no spans; a very long text is scanned whole; repeated rows each get
their row; overlapping kinds are all listed; a random span that touches a base span is left out, as it is found
already; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_of, materialize, text_of

FENCE, SAFE = "\x01", "\x02"
#: Kind, pattern, its test. Fixed values of the contract.
ASSIGN = r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Candidates of the battery.
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"
FDR, ORDER_ALPHA, BINS = 0.001, 0.001, 600
#: Least noncentrality a symbol, where prose hardly differs from a uniform alphabet (hexadecimal).
LEAST_DRIFT = 0.8
#: Sum of squared letter frequencies of prose (index of coincidence), for mixed-case text in which capitals are rare.
PROSE = 0.066
ALPHABETS = (("hex", "0123456789abcdef"), ("HEX", "0123456789ABCDEF"), ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scanned(items: Column, start: Column, step, none: Column) -> Column:
    """All that ``step(state, item)``, a struct<state, found>, finds one item after the other; ``none`` is an empty
    array of that type. Items go in blocks of about the root of their number: n items cost n ** 1.5 references."""
    more = lambda found, x: F.struct(x["state"].alias("state"), F.when(F.size(x["found"]) > 0, F.concat(found, x["found"])).otherwise(found).alias("found"))
    one = lambda acc, x: let(step(acc["state"], x), lambda y: more(acc["found"], y))
    zero = lambda state: F.struct(state.alias("state"), none.alias("found"))
    block = lambda acc, b: let(F.aggregate(b, zero(acc["state"]), one), lambda y: more(acc["found"], y))

    def whole(all_: Column) -> Column:
        size = F.greatest(F.ceil(F.sqrt(F.size(all_).cast("double"))), F.lit(1)).cast("int")
        cut = let(size, lambda n: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(all_) / n) - 1, F.lit(0)).cast("int")), lambda k: F.slice(all_, k * n + 1, n)))
        return F.aggregate(cut, zero(start), block, lambda acc: acc["found"])

    return let(items, whole)


SPAN = "array<struct<s:long,e:long,v:string>>"


def spans_of(text: Column, pattern: str, test=None) -> Column:
    """array<struct<s, e, v>> of leftmost non-overlapping matches, in code points, that pass ``test(match)``."""
    none = F.array().cast(SPAN)
    clean = F.translate(text, FENCE, SAFE)
    pieces = F.split(F.regexp_replace(clean, pattern, f"{FENCE}$0{FENCE}"), FENCE)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(False).alias("hit"))

    def step(state: Column, piece: Column) -> Column:
        end = state["at"] + F.char_length(piece)
        passed = state["hit"] if test is None else state["hit"] & test(piece)
        found = F.when(passed, F.array(F.struct(state["at"].alias("s"), end.alias("e"), piece.alias("v")))).otherwise(none)
        return F.struct(F.struct(end.alias("at"), (~state["hit"]).alias("hit")).alias("state"), found.alias("found"))

    return F.when(F.regexp_like(text, F.lit(pattern)), scanned(pieces, start, step, none)).otherwise(none)


def apart(tokens: Column, assign: Column) -> Column:
    """The tokens that touch no base span. Access and hexadecimal matches lie inside one token, as their characters
    are a token's; assignments are met by going through both in order, forwards and backwards."""
    free = F.filter(tokens, lambda x: ~F.regexp_like(x["v"], F.lit(ACCESS)) & ~F.regexp_like(x["v"], F.lit(HEX)))
    entry = lambda x, kind: F.struct(x["s"].alias("s"), F.lit(kind).alias("kind"), x["e"].alias("e"), x["v"].alias("v"))
    none = F.array().cast("array<struct<s:long,kind:int,e:long,v:string>>")
    most = F.lit(1 << 62).cast("long")

    def forwards(far: Column, x: Column) -> Column:
        keep = (x["kind"] == 0) | (far <= x["s"])
        return F.struct(F.when(x["kind"] == 0, F.greatest(far, x["e"])).otherwise(far).alias("state"), F.when(keep, F.array(x)).otherwise(none).alias("found"))

    def backwards(near: Column, x: Column) -> Column:
        keep = (x["kind"] == 1) & (near >= x["e"])
        return F.struct(F.when(x["kind"] == 0, F.least(near, x["s"])).otherwise(near).alias("state"), F.when(keep, F.array(x)).otherwise(none).alias("found"))

    both = F.array_sort(F.concat(F.transform(assign, lambda x: entry(x, 0)), F.transform(free, lambda x: entry(x, 1))))
    left = scanned(F.reverse(scanned(both, F.lit(0).cast("long"), forwards, none)), most, backwards, none)
    plain = lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v"))
    return F.when(F.size(assign) > 0, F.transform(F.reverse(left), plain)).otherwise(free)


def long_value(match: Column) -> Column:
    return F.char_length(F.regexp_extract(match, ASSIGN, 2)) >= 6


def tail_log10(z: Column) -> Column:
    """log10 of the standard normal tail above z, for z >= 0 (Mills ratio by a continued fraction's start)."""
    mills = 1 / (z + 1 / (z + 2 / (z + 3 / (z + 4 / (z + 2)))))
    return -(z * z) / (2 * F.ln(F.lit(10.0))) + F.log10(mills) - 0.39909


def staged(items: Column, *stages) -> Column:
    """Transform an array of structs stage by stage: each stage adds fields, and each is computed once."""
    kept: list[str] = []

    def step(stage, kept):
        return lambda x: F.struct(*[x[k].alias(k) for k in kept], *[v.alias(k) for k, v in stage(x).items()])

    for stage in stages:
        items = F.transform(items, step(stage, tuple(kept)))
        kept += list(stage(F.struct()))
    return items


def tested(tokens: Column) -> Column:
    """array<struct<..., encoding, log_p>> from candidates (s, e, v): the battery of each, log_p 0 if it fails."""
    alphabets = F.array(*[F.lit(a) for _, a in ALPHABETS])
    halves = F.array(*[F.lit("0" * (len(a) // 2) + "1" * (len(a) // 2)) for _, a in ALPHABETS])
    names = F.array(*[F.lit(n) for n, _ in ALPHABETS])

    def body(x):
        return {"s": x["s"], "e": x["e"], "body": F.regexp_replace(F.translate(x["v"], "-_", "+/"), "=+$", "")}

    def inferred(x):
        t = x["body"]
        mixed = F.regexp_like(t, F.lit("[0-9]")) & F.regexp_like(t, F.lit("[A-Za-z]"))
        kind = F.when(F.regexp_like(t, F.lit("^[0-9a-f]+$")), 1).when(F.regexp_like(t, F.lit("^[0-9A-F]+$")), 2).when(F.regexp_like(t, F.lit("^[A-Z2-7]+$")), 3).otherwise(4)
        return {"kind": F.when(mixed, kind).otherwise(0), "n": F.char_length(t).cast("double")}

    def symbols(x):
        real, alphabet = x["kind"] > 0, F.element_at(alphabets, F.greatest(x["kind"], F.lit(1)))
        places = F.transform(F.split(x["body"], ""), lambda c: F.call_function("instr", alphabet, c).cast("double"))
        signs = F.call_function("translate", x["body"], alphabet, F.element_at(halves, F.greatest(x["kind"], F.lit(1))))
        return {"k": F.char_length(alphabet).cast("double"), "places": F.when(real, places), "signs": F.when(real, signs)}

    def sums(x):
        squares = F.aggregate(F.array_distinct(x["places"]), F.lit(0.0), lambda a, c: a + F.pow(F.size(F.filter(x["places"], lambda y: y == c)).cast("double"), F.lit(2.0)))
        total = F.aggregate(x["places"], F.lit(0.0), lambda a, y: a + y)
        count = lambda t: (x["n"] - F.char_length(F.replace(x["signs"], F.lit(t), F.lit("")))) / len(t)
        return {"squares": squares, "mean": total / x["n"], "ones": count("1"), "turns": count("01") + count("10")}

    def serial(x):
        zero = F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("v"), F.lit(0.0).alias("last"))
        step = lambda a, y: F.struct((a["c"] + a["last"] * (y - x["mean"])).alias("c"), (a["v"] + (y - x["mean"]) * (y - x["mean"])).alias("v"), (y - x["mean"]).alias("last"))
        return {"serial": F.aggregate(x["places"], zero, step), "runs": 2 * x["ones"] * (x["n"] - x["ones"]) / x["n"] + 1}

    def tests(x):
        n, k = x["n"], x["k"]
        chi = x["squares"] * k / n - n
        z_even = (F.pow(chi / (k - 1), F.lit(1 / 3)) - 1 + 2 / (9 * (k - 1))) / F.sqrt(2 / (9 * (k - 1)))
        spread = F.sqrt((x["runs"] - 1) * (x["runs"] - 2) / (n - 1))
        z_runs = F.when(spread > 0, (1 + x["turns"] - x["runs"]) / spread).otherwise(F.lit(99.0))
        v = x["serial"]["v"]
        z_serial = F.when(v > 0, (x["serial"]["c"] / v + 1 / n) * F.sqrt(n)).otherwise(F.lit(99.0))
        drift = n * F.greatest(k * PROSE - 1, F.lit(LEAST_DRIFT))
        two_sided = lambda z: F.least(tail_log10(F.least(F.abs(z), F.lit(30.0))) + math.log10(2), F.lit(0.0))
        return {"even": F.when(z_even > 0, tail_log10(F.least(z_even, F.lit(30.0)))).otherwise(F.lit(0.0)), "order": two_sided(z_runs), "chain": two_sided(z_serial), "z": (k - 1 + drift - chi) / F.sqrt(2 * (k - 1 + 2 * drift))}

    def scores(x):
        half = -math.log(10) * (x["even"] + x["order"] + x["chain"])  # half of Fisher's statistic, chi-squared with six degrees
        fisher = F.exp(-half) * (1 + half + half * half / 2)
        least = 3 * F.pow(F.lit(10.0), F.least(x["even"], x["order"], x["chain"]))
        return {"random": 2 * F.least(fisher, least) >= ORDER_ALPHA}

    done = staged(tokens, body, inferred, symbols, sums, serial, tests, scores)
    return F.transform(
        done,
        lambda x: F.struct(
            x["s"].alias("start"), F.lit(3).alias("o"), x["e"].alias("end"), F.lit("random").alias("kind"), F.when(x["kind"] > 0, F.element_at(names, F.greatest(x["kind"], F.lit(1)))).alias("encoding"), F.when((x["kind"] > 0) & x["random"] & (x["z"] > 0), tail_log10(x["z"])).otherwise(F.lit(0.0)).alias("log_p")
        ),
    )


def class_of(token: Column) -> Column:
    """Encoding and length class (half a power of two, at most 40) of a candidate."""
    return F.concat_ws(":", F.coalesce(token["encoding"], F.lit("none")), F.least(F.floor(2 * F.log2((token["end"] - token["start"]).cast("double"))), F.lit(40)).cast("string"))


def fdr_thresholds(tokens: DataFrame, fdr: float = FDR, bins: int = BINS) -> dict[str, float]:
    """For each class the largest log10 p-value that may pass, from counts in bins of width 0.1 of columns class and log_p."""
    width = 0.1
    counts = tokens.groupBy("class", F.least(F.floor(-F.col("log_p") / width), F.lit(bins)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 5 * 41 * (bins + 1) rows
    by_class = defaultdict(dict)
    for r in counts:
        by_class[r["class"]][r.bin] = r.n
    thresholds = {}
    first = math.ceil(-math.log10(0.5) / width)  # the first bin whose p-values are all below 1/2
    for name, n_of in by_class.items():
        nulls, passed = min(sum(n_of.values()), 2 * (1 + sum(n for b, n in n_of.items() if b < first))), 0
        for b in sorted(n_of, reverse=True):
            passed += n_of[b]
            top = -b * width  # the largest log p of the bin
            if b >= first and 10**top * nulls <= fdr * passed:
                thresholds[name] = top
    return thresholds


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """One row per input row: doc_id, found (array<struct<start, end, kind, encoding, log_p>>), n_assign, n_access, n_hex.

    The text is read once; what it holds of matches and candidates goes to a scratch table.
    """
    text = text_of()
    rows = columns_of(df, doc_id=id_col, text=text_col).select("doc_id", text.alias("text"))
    rows = rows.select("doc_id", spans_of(F.col("text"), ASSIGN, long_value).alias("assign"), spans_of(F.col("text"), ACCESS).alias("access"), spans_of(F.col("text"), HEX).alias("hex"), spans_of(F.col("text"), TOKEN).alias("tokens"))
    kind = lambda name, order: F.transform(name, lambda x: F.struct(x["s"].alias("start"), F.lit(order).alias("o"), x["e"].alias("end"), F.lit(name).alias("kind"), F.lit(None).cast("string").alias("encoding"), F.lit(None).cast("double").alias("log_p")))
    base = F.concat(kind("assign", 0), kind("access", 1), kind("hex", 2))
    rows = materialize(rows.select("doc_id", F.array_sort(base).alias("base"), tested(apart(F.col("tokens"), F.col("assign"))).alias("tokens"), *[F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]), "secrets")
    limits = fdr_thresholds(rows.select(F.explode("tokens").alias("x")).select(class_of(F.col("x")).alias("class"), F.col("x.log_p").alias("log_p")), fdr)
    passes = lambda x: F.coalesce(x["log_p"] <= F.element_at(F.create_map(*[F.lit(v) for kv in limits.items() for v in kv]), class_of(x)), F.lit(False))
    added = F.filter("tokens", passes if limits else lambda x: F.lit(False))
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", "base", F.array_sort(F.concat("base", added)).alias("found"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
