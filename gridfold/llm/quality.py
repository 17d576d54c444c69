"""Quality rules by a hashed n-gram log-likelihood ratio.

Two multinomials over hashed word 1- and 2-grams are estimated: one from a
trusted sample, one from the whole raw corpus.  A document's score is the
mean of log(p_trusted / p_raw) over its n-grams, in whole units of
1/``UNIT`` so that sums do not depend on their order; documents below a fixed
threshold are rejected.  Everything on the path is DataFrame functions.

The number of buckets grows with the square root of the corpus' length, about
as its vocabulary does (``bucket_number``); bucket counts are combined
map-side.  Up to ``ARRAY_MOST`` buckets the finished weights go into the plan
as one constant array and no text is shuffled; beyond it each document's
bucket counts are joined to the table of weights.  Both ways give the same
sums.

Defined results: a null text has no words; a text without words has score 0
and fails the base rules; with no trusted documents all weights are 0 and
only the base rules reject; repeated rows are judged alike, each by itself;
an empty table gives an empty result; other columns of the input are neither
read nor returned by ``quality_scores`` and are kept by ``quality_filter``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfold.llm.common import col, held, text_of, unpack, whole_row, words, written

BUCKETS = 1 << 16         # fewest buckets
BUCKETS_PER_ROOT = 4      # buckets for the square root of the corpus' length in characters
ARRAY_MOST = 1 << 22      # weights that are sent along with the plan, at most
TRUSTED_ROWS = 20_000     # bound of the trusted sample (ids are broadcast: 8 bytes each)
THRESHOLD = -0.125        # mean log ratio per n-gram (natural log) below which a text goes
SMOOTHING = 4.0           # added to each bucket's trusted and expected count
PRIOR_GRAMS = 8           # neutral n-grams added to each text's length
UNIT = 1 << 20
WINDOW = 5


def ngram_buckets(w: Column, buckets: int = BUCKETS) -> Column:
    """Bucket of each word and of each pair of neighbouring words."""
    n = F.lit(buckets).cast("long")
    ones = F.transform(w, lambda x: F.pmod(F.xxhash64(x), n).cast("int"))
    twos = F.when(F.size(w) < 2, F.array().cast("array<int>")).otherwise(F.transform(
        F.sequence(F.lit(0), F.size(w) - 2),
        lambda i: F.pmod(F.xxhash64(F.get(w, i), F.get(w, i + 1)), n).cast("int")))
    return F.concat(ones, twos)


def bucket_number(docs: DataFrame) -> int:
    """Buckets for a corpus: a power of two, at least ``BUCKETS``."""
    chars = docs.agg(F.sum(F.length(text_of())).alias("n")).first()["n"] or 0
    wanted = BUCKETS_PER_ROOT * math.sqrt(chars)
    return max(BUCKETS, 1 << math.ceil(math.log2(max(wanted, 1))))


def trusted_ids(labels: DataFrame, limit: int = TRUSTED_ROWS) -> DataFrame:
    """Ids of trusted documents (quality 1, not toxic), at most ``limit``: those
    of the smallest hash of the id."""
    ok = labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
                      & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return ok.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def fit_weights(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS,
                smoothing: float = SMOOTHING) -> DataFrame:
    """(bucket, weight): log ratio of each bucket in units of 1/UNIT, for the
    buckets that occur in the corpus.  ``trusted``: doc_id, a bounded table."""
    mark = F.broadcast(trusted.select(F.col("doc_id").alias("_tid"), F.lit(1).alias("_in")))
    grams = (docs.select(col("doc_id").alias("_id"), words(text_of()).alias("_w"))
             .join(mark, F.col("_id") == F.col("_tid"), "left")
             .select(F.coalesce("_in", F.lit(0)).alias("_in"),
                     F.explode(ngram_buckets(F.col("_w"), buckets)).alias("bucket")))
    # at most ``buckets`` rows, written once: the totals below reread them
    counts = written(grams.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("raw"), F.sum("_in").alias("good")), "bucket-counts")
    total = counts.agg(F.sum("raw").alias("raws"), F.sum("good").alias("goods"))
    # trusted count against the count expected from the raw corpus, both drawn
    # to 1 by ``smoothing``: buckets with few expected counts say nothing
    expected = F.col("raw") * F.col("goods") / F.col("raws")
    ratio = F.log((F.col("good") + smoothing) / (expected + smoothing))
    return (counts.withColumn("raws", total.select("raws").scalar())
            .withColumn("goods", total.select("goods").scalar())
            .select("bucket", F.when(F.col("goods") == 0, F.lit(0))
                    .otherwise(F.round(ratio * UNIT)).cast("long").alias("weight")))


def weight_array(weights: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row: the weights as an array indexed by bucket (0 where none).
    Its length is ``buckets``, whatever the input's size."""
    full = weights.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    rows = full.join(weights, "bucket", "left").select(
        "bucket", F.coalesce("weight", F.lit(0)).cast("long").alias("weight"))
    return rows.agg(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "weight"))),
                                lambda x: x["weight"]).alias("w"))


def base_columns(df: DataFrame, text: str = "_text", w: str = "_w") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words to a
    frame with the text and its words."""
    t, ws = F.col(text), F.col(w)
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\f\r")) != "")
    out = (df.withColumn("n_words", F.size(ws).cast("long"))
           .withColumn("word_chars", F.length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", "")).cast("long"))
           .withColumn("n_symbols", F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long"))
           .withColumn("_lines", lines)
           .withColumn("_win", F.when(F.size(ws) < WINDOW, F.array().cast("array<bigint>"))
                       .otherwise(F.transform(
                           F.sequence(F.lit(0), F.size(ws) - WINDOW),
                           lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(WINDOW)])))))
    out = out.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    # only texts with a repeated window need the sorted (window, place) pairs
    again = F.size(F.array_distinct("_win")) < F.size("_win")
    out = out.withColumn("_sorted", F.when(again, F.sort_array(
        F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    s = F.col("_sorted")
    out = out.withColumn("_starts", F.sort_array(F.transform(
        F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])),
        lambda x: x["i"])))
    st = F.col("_starts")
    covered = F.aggregate(
        F.transform(st, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(st, k + 1) - p, F.lit(WINDOW)))),
        F.lit(0).cast("long"), lambda a, x: a + x)
    return (out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))
            .drop("_lines", "_win", "_sorted", "_starts"))


FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
           "n_grams", "llr_sum"]


def array_sums(d: DataFrame, weights: DataFrame, buckets: int) -> DataFrame:
    """Adds llr_sum of the buckets ``_g``, looked up in one constant array."""
    values = weight_array(weights, buckets).first()["w"]
    lookup = F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")    # folded once
    return d.withColumn("llr_sum", F.aggregate("_g", F.lit(0).cast("long"), lambda a, b: a + F.coalesce(
        F.get(lookup, b), F.lit(0).cast("long"))))


def joined_sums(d: DataFrame, weights: DataFrame) -> DataFrame:
    """Adds llr_sum of the buckets ``_g`` by a join of each row's counts with
    the weights (AQE splits the buckets of common words)."""
    d = written(d.withColumn("_id", F.monotonically_increasing_id()), "quality-grams")
    counts = (d.select("_id", F.explode("_g").alias("bucket")).groupBy("_id", "bucket")
              .agg(F.count(F.lit(1)).alias("n")))
    sums = (counts.join(weights, "bucket").groupBy(F.col("_id").alias("_sid"))
            .agg(F.sum(F.col("n") * F.col("weight")).alias("_sum")))
    return (d.join(sums, F.col("_id") == F.col("_sid"), "left")
            .withColumn("llr_sum", F.coalesce("_sum", F.lit(0).cast("long"))).drop("_id", "_sid", "_sum"))


def _scored(docs: DataFrame, labels: DataFrame, threshold: float, buckets: int | None,
            trusted_rows: int, keep: Column, array_most: int) -> DataFrame:
    """``_keep`` and the figures, score and kept of every document.  Words,
    figures and sums are held: a condition on the result is not moved below
    them, where it would repeat their expressions for each of their uses."""
    buckets = buckets or bucket_number(docs)
    weights = fit_weights(docs, trusted_ids(labels, trusted_rows), buckets)
    d = held(docs.select(keep.alias("_keep"), text_of().alias("_text")), "_w", words(F.col("_text")))
    d = base_columns(d).withColumn("_g", ngram_buckets(F.col("_w"), buckets))
    d = d.withColumn("n_grams", F.size("_g").cast("long"))
    d = d.withColumn("base_failed", (F.col("n_words") < 10)
                     | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    if buckets <= array_most:
        d = array_sums(d, weights, buckets)
    else:
        d = joined_sums(d.drop("_text", "_w"), weights)
    d = held(d.select("_keep", F.struct(*FIGURES).alias("_f")), "_r", F.col("_f")).select("_keep", "_r.*")
    # whole numbers on both sides: the decision is the same on every run
    grams = F.col("n_grams") + PRIOR_GRAMS
    ok = F.col("llr_sum") >= F.lit(round(threshold * UNIT)).cast("long") * grams
    return (d.withColumn("score", F.col("llr_sum") / (F.lit(float(UNIT)) * grams))
            .withColumn("kept", ~F.col("base_failed") & ok))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD,
                   buckets: int | None = None, trusted_rows: int = TRUSTED_ROWS,
                   array_most: int = ARRAY_MOST) -> DataFrame:
    """One row per document: doc_id, the base figures, score, base_failed, kept.
    ``buckets``: their number, by default that of ``bucket_number``."""
    d = _scored(docs, labels, threshold, buckets, trusted_rows, col("doc_id"), array_most)
    return d.select(F.col("_keep").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                    "n_repeat_words", "base_failed", "kept", "score", "n_grams")


def quality_filter(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD,
                   buckets: int | None = None, trusted_rows: int = TRUSTED_ROWS,
                   array_most: int = ARRAY_MOST) -> DataFrame:
    """The kept documents with all their columns."""
    d = _scored(docs, labels, threshold, buckets, trusted_rows, whole_row(docs), array_most)
    return unpack(d.where("kept"), docs.columns, "_keep")
