"""Quality rules by DataFrame functions only.

Base statistics are row-local array expressions. The method's verdict is a
hashed n-gram log-likelihood ratio: unigrams and bigrams of words fall into
``BUCKETS`` buckets, whose counts over all documents and over trusted ones give
two smoothed multinomials; a document's score is the mean of
log(p_trusted / p_raw) over its n-grams, and every document is held against
one fixed threshold.

The counting pass combines before its shuffle, so at most ``BUCKETS`` rows leave
a task. The ratios, a single array of ``BUCKETS`` integers (millionths, so that
sums don't depend on order), are a literal of the scoring pass, which has
neither join nor shuffle. Trusted rows are the labelled ones, at most
``MAX_TRUSTED`` by least hash, which bounds the broadcast of their ids.

Defined cases: null text has no words; without trusted rows the base rules
decide alone; repeated rows count and are judged each; ids may be null; texts of
any length are whole; a score equal to the threshold is kept; columns that bear
the name of a result give way to it, others stay; empty tables give empty
results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
#: Bound on the labelled rows that form the trusted target.
MAX_TRUSTED = 50_000
#: Counts added to every bucket, with raw counts scaled to the trusted total: where little is known, the ratio stays near zero.
PRIOR = 16
#: Mean log ratio from which a document is kept.
THRESHOLD = -0.065
_WS = " \t\n\x0b\f\r"


def words(text: Column) -> Column:
    """Maximal runs outside ASCII white space."""
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(_WS))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, r"[\x20\x09-\x0D]+"))


def with_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``_words``, computed once a row: an explode of one element keeps the optimiser from inlining the split."""
    return docs.select("*", F.explode(F.array(words(F.col(text_col)))).alias("_words"))


def n_dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return F.size(lines) - F.size(F.array_distinct(lines))


def n_repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more."""
    n = F.size(w)
    two = F.zip_with(F.slice(w, 1, n - 2), F.slice(w, 2, n - 2), lambda a, b: F.xxhash64(a, b))
    grams = F.zip_with(two, F.slice(w, 3, n - 2), lambda h, c: F.xxhash64(h, c))

    def of(g: Column) -> Column:
        placed = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        near = lambda p: F.filter(F.zip_with(F.slice(p, 1, n - 3), F.slice(p, 2, n - 3), lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"]))), lambda x: x.isNotNull())
        covered = lambda at: F.size(F.array_distinct(F.flatten(F.transform(F.array_distinct(F.flatten(at)), lambda i: F.array(i, i + 1, i + 2)))))
        return F.when(F.size(F.array_distinct(g)) == n - 2, 0).otherwise(covered(_let(placed, near)))

    return F.when(n < 4, 0).otherwise(_let(grams, of))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _bucket(*c: Column) -> Column:
    return F.xxhash64(*c).bitwiseAND(F.lit(BUCKETS - 1))


def _grams(w: Column) -> Column:
    """(a, b): each word and the next, null after the last."""
    return F.arrays_zip(w.alias("a"), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))).alias("b"))


def trusted_ids(labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", most: int = MAX_TRUSTED) -> DataFrame:
    """At most ``most`` ids labelled 1."""
    good = labels.where((F.col(label_col) == 1) & F.col(id_col).isNotNull()).select(id_col).distinct()
    return good.orderBy(F.xxhash64(id_col), id_col).limit(most)


def log_ratios(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row: ``ratios``, millionths of log(p_trusted / p_raw) by bucket, null if no row is trusted."""
    flag = trusted.select(F.col(id_col).alias("_id"), F.lit(1).alias("_trusted"))
    rows = docs.select(id_col, text_col).join(F.broadcast(flag), F.col(id_col) == F.col("_id"), "left")  # ids: at most MAX_TRUSTED
    pairs = with_words(rows.select("_trusted", text_col), text_col).select("_trusted", F.inline(_grams(F.col("_words"))))
    # a word and its bigram fall into buckets of one space; the last word has no bigram
    both = pairs.select("_trusted", F.explode(F.array(_bucket(F.col("a")), F.when(F.col("b").isNotNull(), _bucket(F.col("a"), F.col("b"))))).alias("bucket")).where("bucket is not null")
    counts = both.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("_trusted").alias("good"))
    spark = docs.sparkSession
    full = spark.range(BUCKETS).select(F.col("id").alias("bucket")).join(counts, "bucket", "left").na.fill(0, ["raw", "good"])
    one = full.agg(F.sort_array(F.collect_list(F.struct("bucket", "raw", "good"))).alias("x"), F.sum("raw").alias("n_raw"), F.sum("good").alias("n_good"))
    ratio = lambda x: F.round(1e6 * F.ln((x["good"] + PRIOR) / (x["raw"] * (F.col("n_good") / F.col("n_raw")) + PRIOR))).cast("long")
    return one.select(F.when(F.col("n_good") > 0, F.transform("x", ratio)).alias("ratios"))


def judge(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, ratio and kept.

    Columns of ``docs`` with these names give way to the new ones.
    """
    found = log_ratios(docs, trusted, id_col, text_col).first()["ratios"]  # BUCKETS integers or null
    ratios = F.split(F.lit(",".join(map(str, found or [0] * BUCKETS))), ",").cast("array<bigint>")  # folds to one literal
    w, n, text = F.col("_words"), F.size("_words"), F.col(text_col)
    at = lambda *c: F.get(ratios, _bucket(*c).cast("int"))
    scores = F.zip_with(w, F.slice(w, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: at(a) + F.when(b.isNull(), F.lit(0).cast("long")).otherwise(at(a, b)))
    total = F.aggregate(scores, F.lit(0).cast("long"), lambda acc, x: acc + x)
    out = {
        "n_words": n.cast("long"),
        "word_chars": F.length(F.concat_ws("", w)).cast("long"),
        "n_symbols": F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": n_dup_lines(text).cast("long"),
        "n_repeat_words": n_repeat_words(w).cast("long"),
        "ratio": F.when(n > 0, total / (2 * n - 1) / 1e6) if found else F.lit(None).cast("double"),
    }
    kept = [c for c in docs.columns if c not in {*out, "base_failed", "kept"}]
    # one Project a step, so that no statistic is computed twice
    stats = with_words(docs.select(*kept), text_col).select(*kept, F.explode(F.array(F.struct(*(c.alias(k) for k, c in out.items())))).alias("_s")).select(*kept, "_s.*")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.coalesce("ratio", F.lit(threshold)) >= threshold))
