"""Secret scans by DataFrame functions only: fixed patterns, and a randomness test battery for other tokens.

Base kinds are regular expressions; ``assign`` matches whose value has under 12
characters are dropped after they have consumed their text. The method adds
``random``: tokens of 20 or more characters whose encoding (hexadecimal, base32
or base64) can be inferred are held against the hypothesis that their symbols
are independent and uniform, by

* a chi-squared test of the alphabet's uniformity,
* a runs test of symbols in the upper half of the alphabet,
* a test of the serial correlation at lag one,

joined by Bonferroni. Over all tokens of the corpus, a Benjamini-Hochberg step
with weights in proportion to length (longer tokens can be told from random
ones more safely) picks the tokens that are not random; the others are
secrets. So the rate at which true secrets are among the dismissed is bounded.
The step works on a histogram of p values with 50 bins a decade, whose rows are
bounded in number, rounding towards fewer dismissals.

Spans count code points, end exclusive. Defined cases: null text is empty; equal texts are
judged alike; tokens that touch a base span add nothing; with no tokens nothing
is dismissed; texts of any length are whole, at a cost that grows with the square
of the matches in one text; repeated rows are judged each and count each in the
battery; of spans with one start the earlier kind comes first; a column named
secrets gives way to the result, other columns stay; empty tables give empty
results.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ["assign", "access", "hex", "random"]
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Tokens with a digit; the inference of an encoding takes it from there.
TOKEN = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20,}"
#: Bound on the false-discovery rate.
RATE = 0.05
_BINS, _MOST = 50, 15
_UP, _LOW, _DIG = string.ascii_uppercase, string.ascii_lowercase, string.digits
SPAN = "array<struct<start:int,rank:int,end:int,body:string>>"


def located(text: Column, pattern: str, rank: int, group: int = 0, least: int = 0) -> Column:
    """Leftmost non-overlapping matches as (start, rank, end, body); those whose ``group`` is shorter than ``least`` go."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    rows = F.arrays_zip(whole.alias("m"), part.alias("g"), F.slice(F.split(text, pattern, -1), 1, F.size(whole)).alias("gap"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["m"])
        span = F.struct(start.cast("int").alias("start"), F.lit(rank).alias("rank"), end.cast("int").alias("end"), x["g"].alias("body"))
        return F.struct(end.cast("int").alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    found = F.aggregate(rows, F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")), step, lambda acc: acc["out"])
    if least:
        found = F.filter(found, lambda s: F.length(s["body"]) >= least)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPAN))


# --- the battery ------------------------------------------------------------------------------


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _two_sided(z: Column) -> Column:
    """P(|Z| > |z|), by the rational form of the complementary error function."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def _upper(z: Column) -> Column:
    return F.when(z > 0, _two_sided(z) / 2).otherwise(1 - _two_sided(z) / 2)


def encoded(token: Column) -> Column:
    """(alphabet, body): the inferred encoding and the token's symbols in it; null if none fits."""
    bare = F.regexp_replace(token, "=+$", "")
    has = lambda c: token.rlike(f"[{c}]")
    kind = lambda alphabet, body: F.struct(F.lit(alphabet).alias("alphabet"), body.alias("body"))
    return (
        F.when(token.rlike("^([0-9a-f]+|[0-9A-F]+)$") & has("0-9") & has("a-fA-F"), kind(_DIG + "abcdef", F.lower(token)))
        .when(token.rlike("^[A-Z2-7]+=*$") & has("2-7") & has("A-Z"), kind(_UP + "234567", bare))
        .when(has("0-9") & has("a-z") & has("A-Z") & token.rlike("^[A-Za-z0-9+/_-]+=*$"), kind(_UP + _LOW + _DIG + "+/", F.translate(bare, "-_", "+/")))
    )


def p_value(token: Column) -> Column:
    """The battery's joint p value under randomness; null for tokens without an encoding."""

    def of(e: Column) -> Column:
        k, n = F.length(e["alphabet"]).cast("double"), F.length(e["body"]).cast("double")
        count = lambda s: n - F.length(F.replace(e["body"], F.substring(e["alphabet"], s, F.lit(1))))
        squares = F.aggregate(F.sequence(F.lit(1), k.cast("int")), F.lit(0.0), lambda acc, s: acc + count(s) * count(s))
        chi = squares * k / n - n
        v = 2 / (9 * (k - 1))
        p_chi = _upper((F.cbrt(F.greatest(chi, F.lit(0.0)) / (k - 1)) - (1 - v)) / F.sqrt(v))
        codes = F.transform(F.split(e["body"], ""), lambda c: (F.call_function("locate", c, e["alphabet"]) - 1).cast("double"))

        def series(c: Column) -> Column:
            total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
            next_ = F.slice(c, 2, F.size(c) - 1)
            pairs = F.arrays_zip(F.slice(c, 1, F.size(c) - 1).alias("x"), next_.alias("y"))
            high = F.size(F.filter(c, lambda x: x >= k / 2)).cast("double")
            runs = 1.0 + F.size(F.filter(pairs, lambda q: (q["x"] >= k / 2) != (q["y"] >= k / 2)))
            both = 2 * high * (n - high)
            spread = both * (both - n) / (n * n * (n - 1))
            p_runs = F.when(spread > 0, _two_sided((runs - both / n - 1) / F.sqrt(spread))).otherwise(0.0)
            m = total(c) / n
            var = total(F.transform(c, lambda x: (x - m) * (x - m)))
            lag = total(F.transform(pairs, lambda q: (q["x"] - m) * (q["y"] - m)))
            p_serial = F.when(var > 0, _two_sided((lag / var + 1 / n) * F.sqrt(n))).otherwise(0.0)
            return F.least(F.lit(1.0), 3 * F.least(p_chi, p_runs, p_serial))

        return _let(codes, series)

    return _let(encoded(token), lambda e: F.when(e.isNotNull(), of(e)))


def _bin(p: Column, length: Column, mean: float) -> Column:
    """Place of the weighted p value on the logarithmic scale; higher is less random."""
    weighted = F.greatest(p * mean / length, F.lit(10.0**-_MOST))
    return F.greatest(F.floor(-F.log10(weighted) * _BINS), F.lit(0)).cast("int")


def tokens_of(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(body, n, p) of every token with an encoding."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(F.explode(F.when(text.rlike(TOKEN), F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)))).alias("body"))
    return found.select("body", F.length("body").alias("n"), p_value(F.col("body")).alias("p")).where("p is not null")


def dismissal(docs: DataFrame, text_col: str = "text", rate: float = RATE) -> tuple[int | None, float]:
    """(least bin of tokens that are not random, mean length), by weighted Benjamini-Hochberg over all tokens."""
    hist = tokens_of(docs, text_col).groupBy("n", F.floor(-F.log10(F.greatest("p", F.lit(10.0**-_MOST))) * _BINS).cast("int").alias("b")).count()
    # lengths are folded into powers of 2**(1/16) before the driver sees them, so rows are bounded
    folded = hist.groupBy(F.floor(F.log2("n") * 16).cast("int").alias("w"), "b").agg(F.sum("count").alias("c"), F.sum(F.col("count") * F.col("n")).alias("l")).collect()
    m = sum(r.c for r in folded)
    if not m:
        return None, 1.0
    mean = sum(r.l for r in folded) / m
    bins: dict[int, int] = {}
    for r in folded:
        b = math.floor(r.b + _BINS * math.log10(2 ** (r.w / 16) / mean))
        bins[b] = bins.get(b, 0) + r.c
    least, seen = None, 0
    for b in sorted(bins, reverse=True):
        seen += bins[b]
        if 10 ** (-b / _BINS) <= rate * seen / m:
            least = b
    return least, mean


# --- per document -----------------------------------------------------------------------------


def scan(docs: DataFrame, text_col: str = "text", rate: float = RATE) -> DataFrame:
    """``docs`` with ``secrets``: array of (start, rank, end, body), by start, then kind; ``rank`` indexes ``KINDS``."""
    least, mean = dismissal(docs, text_col, rate)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = F.concat(located(text, ASSIGN, 0, 1, 12), located(text, ACCESS, 1), located(text, HEX, 2))
    kept = [c for c in docs.columns if c != "secrets"]
    rows = docs.select(*kept, F.explode(F.array(F.struct(base.alias("base"), located(text, TOKEN, 3).alias("more")))).alias("_f"))
    free = lambda s: ~F.exists("_f.base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    p = lambda s: p_value(s["body"])
    like_random = (lambda s: p(s).isNotNull()) if least is None else (lambda s: F.coalesce(_bin(p(s), F.length(s["body"]), mean) < least, F.lit(False)))
    more = F.when(F.size("_f.more") > 0, F.filter("_f.more", lambda s: free(s) & like_random(s))).otherwise(F.array().cast(SPAN))
    return rows.select(*kept, F.sort_array(F.concat("_f.base", more)).alias("secrets"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "[SECRET]", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """``docs`` with every secret's span replaced by ``mark``; overlapping spans become one."""
    found = scan(docs, text_col, rate)
    text = F.col(text_col)
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        out = F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], gap, F.lit(mark)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    new = F.aggregate("secrets", zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return found.withColumn(text_col, F.when(F.size("secrets") > 0, new).otherwise(text)).select(*docs.columns)
