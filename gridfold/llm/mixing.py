"""Mixing sources to target weights with hash-threshold histograms.

Every document has a fixed 60-bit hash.  Per source, sizes are summed by hash
bucket (the first digits of the hash); the running sum finds the bucket in
which the source's budget ends, and only that bucket is divided again by the
next digits, until the hash is used up.  The result is one threshold per
source: documents at or below it are taken once more, without any sort.
A larger budget only raises the threshold, so selections are nested.

Budgets: sources in code point order (null last) weigh 5, 2, 1, repeating, and
share the total size by weight; a source's target stops at ``cap`` times its
size and the excess is reshared by weight.  A target above a source's size
takes whole copies of the source first, then the threshold for the rest.

Rows with equal id and text share a hash.  Where a budget ends within such
rows, they are divided in the same way by a hash of their row number.

Defined results: a null text has size 0 and is never taken; null is a source
of its own; of equal rows as many are taken as come nearest to the budget; an
empty table gives an empty result; other columns are ignored by
``mix_counts`` and kept by ``mixed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridfold.llm.common import col, text_of, unpack, whole_row, words, written

WEIGHTS = (5, 2, 1)
CAP = 3
HASH_DIGITS = 15          # hex digits of the hash
LEVEL_DIGITS = 3          # digits per refinement: 4096 buckets a source


def doc_hash(doc_id: Column, text: Column) -> Column:
    """The first 15 hex digits of md5(id|text) as a whole number."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), text)
    return F.conv(F.substring(F.md5(key), 1, HASH_DIGITS), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size) -> also target.  One row per source, so its
    windows over all rows are small; sources that reach their cap come first
    in the order of cap / weight."""
    every = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.get(F.lit(list(weights)), F.pmod(F.row_number().over(every) - 1, F.lit(len(weights))))
    s = sizes.withColumn("_w", w.cast("double")).withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    # share per weight left for this and all later sources, if all before are capped
    level = ((F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
             / (F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
    s = s.withColumn("_level", level)
    open_ = F.col("_cap") > F.col("_level") * F.col("_w")
    s = s.withColumn("_share", F.first(F.when(open_, F.col("_level")), ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return s.select("source", "source_size", F.round(F.coalesce(
        F.least(F.col("_cap"), F.col("_share") * F.col("_w")), F.col("_cap")), 6).alias("target"))


def boundaries(digest: DataFrame, budgets: DataFrame, level_digits: int = LEVEL_DIGITS) -> DataFrame:
    """(_source, _prefix, _left, _bucket_size): the hash at which the running
    size, in hash order, passes the source's budget, what is left of the budget
    there, and the size of the rows with that hash.  A source that its budget
    takes whole has no row.

    ``digest``: _source, _size, _hash; ``budgets``: _source, _budget.  One row
    per source and bucket leaves each task; each level keeps only the rows of
    the boundary buckets."""
    bits = 4 * level_digits
    rest = digest.where("_size > 0").select("_source", "_size", "_hash")
    state = budgets.select("_source", F.col("_budget").cast("double").alias("_left"),
                           F.lit(0).cast("long").alias("_prefix"))
    shift = 4 * HASH_DIGITS
    while shift > 0:
        shift -= min(bits, shift)
        hist = (rest.groupBy("_source", F.shiftright("_hash", shift).alias("_b"))
                .agg(F.sum("_size").alias("_s")))
        run = Window.partitionBy("_source").orderBy("_b")
        open_ = state.select(F.col("_source").alias("_os"), "_left")
        hist = (hist.join(open_, F.col("_source").eqNullSafe(F.col("_os")))
                .withColumn("_upto", F.sum("_s").over(run)))
        # the boundary: the first bucket whose running sum passes the budget
        cut = (hist.where(F.col("_upto") > F.col("_left"))
               .groupBy("_source").agg(F.min(F.struct("_b", "_upto", "_s", "_left")).alias("c"))
               .select("_source", F.col("c._b").alias("_prefix"),
                       (F.col("c._left") - (F.col("c._upto") - F.col("c._s"))).alias("_left"),
                       F.col("c._s").alias("_bucket_size")))
        state = written(cut, "mix-boundary")
        edge = state.select(F.col("_source").alias("_bs"), F.col("_prefix").alias("_bp"))
        rest = rest.join(edge, F.col("_source").eqNullSafe(F.col("_bs"))
                         & (F.shiftright("_hash", shift) == F.col("_bp"))).drop("_bs", "_bp")
    return state


def thresholds(digest: DataFrame, budgets: DataFrame, level_digits: int = LEVEL_DIGITS) -> DataFrame:
    """(_source, threshold, _edge, _left, _bucket_size): rows up to the
    threshold make a running size nearest to the budget (below it on a tie); -1
    takes none.  ``_edge`` is the hash at which the budget ends."""
    last = boundaries(digest, budgets, level_digits).select(
        F.col("_source").alias("_ls"), F.col("_prefix").alias("_edge"), "_left", "_bucket_size")
    # the last bucket is one hash value: in, if that comes nearer to the budget
    near = F.when(F.col("_bucket_size") - F.col("_left") < F.col("_left"), F.col("_edge")).otherwise(F.col("_edge") - 1)
    # a source without a boundary is taken whole
    return (budgets.join(last, F.col("_source").eqNullSafe(F.col("_ls")), "left").select(
        "_source", F.coalesce(near, F.lit((1 << 60) - 1).cast("long")).alias("threshold"), "_edge", "_left", "_bucket_size"))


def _plan(docs: DataFrame, weights, cap: int, keep: list[Column], level_digits: int):
    """Digest of all documents (written), and per source: size, target, copies, threshold."""
    w = docs.select(*keep, col("source").cast("string").alias("_source"), text_of().alias("_text"))
    w = w.select(*[c for c in w.columns if c != "_text"],
                 F.size(words(F.col("_text"))).cast("long").alias("_size"),
                 doc_hash(F.col("_id"), F.col("_text")).alias("_hash"))
    return w


def mix_counts(docs: DataFrame, weights=WEIGHTS, cap: int = CAP,
               level_digits: int = LEVEL_DIGITS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every document."""
    digest = written(_plan(docs, weights, cap, [col("doc_id").alias("_id")], level_digits), "mix-digest")
    p = _per_source(digest, weights, cap, level_digits)
    return _copied(digest, p, cap, level_digits).select(
        F.col("_id").alias("doc_id"), F.col("_source").alias("source"), F.col("_size").alias("size"),
        "source_size", "target", (F.col("_size") * F.col("_copies")).alias("taken"))


def _per_source(digest: DataFrame, weights, cap: int, level_digits: int) -> DataFrame:
    """Per source: sizes, target, whole copies, threshold; and where equal rows
    stand at the end of the budget (_split) what is left for them."""
    sizes = digest.groupBy(F.col("_source").alias("source")).agg(F.sum("_size").alias("source_size"))
    t = targets(sizes, weights, cap)
    size = F.col("source_size")
    t = t.withColumn("_full", F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("long"))
    t = written(t.withColumn("_budget", F.col("target") - F.col("_full") * size), "mix-targets")
    thr = thresholds(digest, t.select(F.col("source").alias("_source"), "_budget"), level_digits)
    p = written(t.join(thr, F.col("source").eqNullSafe(F.col("_source")))
                .select(F.col("source").alias("_s"), "source_size", "target", "_full", "_edge", "_left",
                        # a budget of 0 needs no threshold
                        F.when(F.col("_budget") > 0, F.col("threshold")).otherwise(F.lit(-1)).alias("_thr"),
                        (F.col("_budget") > 0).alias("_open")), "mix-thresholds")
    # how many rows stand at the end of each budget
    ends = p.where("_open").select("_s", "_edge")
    rows = (digest.where("_size > 0").join(ends, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_hash") == F.col("_edge")))
            .groupBy("_s").agg(F.count(F.lit(1)).alias("_n")).select(F.col("_s").alias("_rs"), "_n"))
    return written(p.join(rows, F.col("_s").eqNullSafe(F.col("_rs")), "left")
                   .withColumn("_split", F.coalesce(F.col("_n") > 1, F.lit(False))).drop("_rs", "_n"), "mix-plan")


def _copied(rows: DataFrame, p: DataFrame, cap: int, level_digits: int) -> DataFrame:
    """Adds the figures of a row's source and _copies, how often it is taken."""
    d = rows.join(p, F.col("_source").eqNullSafe(F.col("_s")), "left")
    more = F.col("_hash") <= F.col("_thr")
    if not p.where("_split").isEmpty():
        # equal rows at the end of a budget: numbered by a written table and
        # divided by a hash of the number, as the others by theirs
        ends = F.col("_split") & (F.col("_hash") == F.col("_edge")) & (F.col("_size") > 0)
        tied = written(d.where(ends).withColumn("_nth", F.monotonically_increasing_id()), "mix-ties")
        tied = tied.withColumn("_sub", F.shiftrightunsigned(F.xxhash64("_nth"), 64 - 4 * HASH_DIGITS))
        sub = thresholds(tied.select("_source", "_size", F.col("_sub").alias("_hash")),
                         p.where("_split").select(F.col("_s").alias("_source"), F.col("_left").alias("_budget")),
                         level_digits).select(F.col("_source").alias("_ts"), F.col("threshold").alias("_tt"))
        tied = (tied.join(sub, F.col("_source").eqNullSafe(F.col("_ts")), "left")
                .withColumn("_more", F.col("_sub") <= F.col("_tt")).drop("_nth", "_sub", "_ts", "_tt"))
        d = d.where(~F.coalesce(ends, F.lit(False))).withColumn("_more", more).unionByName(tied)
    else:
        d = d.withColumn("_more", more)
    return d.withColumn("_copies", F.least(F.col("_full") + F.col("_more").cast("long"), F.lit(cap).cast("long")))


def mixed(docs: DataFrame, weights=WEIGHTS, cap: int = CAP,
          level_digits: int = LEVEL_DIGITS) -> DataFrame:
    """The mixture: every document with all its columns, as often as it is
    taken (documents without words are not taken)."""
    digest = written(_plan(docs, weights, cap, [col("doc_id").alias("_id")], level_digits), "mix-digest")
    p = _per_source(digest, weights, cap, level_digits)
    d = _plan(docs, weights, cap, [whole_row(docs), col("doc_id").alias("_id")], level_digits)
    d = _copied(d, p, cap, level_digits)
    d = d.withColumn("_copies", F.when(F.col("_size") > 0, F.col("_copies")).otherwise(F.lit(0).cast("long")))
    d = d.where("_copies > 0").withColumn("_c", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return unpack(d, docs.columns)
