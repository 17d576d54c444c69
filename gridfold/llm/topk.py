"""Exact top-k by inner product with MaxScore.

A vector's dimensions are terms; a posting list holds the rows in which a term
is not 0.  For a query, a term can add at most its bound (the largest product
of the query's weight with a weight in the list).  Terms are taken by falling
bound: the last ones, whose bounds together stay below the k-th best score so
far, are non-essential.  Only essential lists are traversed; a row found there
is probed in the other lists while its partial score and the bounds left
still reach the k-th best score.  Rows in no essential list cannot reach it.

Queries are dealt into blocks and rows into shards, both of bounded size; each
(shard, block) pair is one task, and the shards' best rows are merged by a
window.  Equal vectors tie, so of each vector only the k + 1 rows of smallest
id can be among anyone's k best (the query's own row may be one of them); the
others are dropped before the shuffle, which keeps the result whole however
often a vector repeats.

Defined results: vectors that are null, hold a null or non-finite component,
or whose squared integer norm reaches 2^62 (scores would not fit a long) take
no part; vectors of other lengths count as 0 where they end; a row without id
is no query and, as a candidate, stands behind all ids of its score; only the
query's own row is left out, so another row with the same id counts; repeated
query rows give repeated results; fewer than k candidates give all of them; an
empty table gives an empty result; other columns are neither read nor returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridfold.llm.common import col, written

# a row sent to a block is scored against all its queries, which costs far
# more than the sending; so shards and blocks can be small
SHARD_ROWS = 1 << 13
BLOCK_ROWS = 1 << 9
STRIP = 1 << 12           # rows whose scores are summed at a time
NORM_LIMIT = float(1 << 62)
SLACK = 1 + 1e-9          # bounds are floating-point, scores whole: rounding never lowers a bound
RESULT = "q long, query_id long, copies long, vec_id long, score long"


def whole_vector(v: Column, factor: int) -> Column:
    """floor(factor * x) of each component as long; null where a component is
    null or not finite, or the vector is too long for whole scores."""
    scaled = F.transform(v, lambda x: F.floor(F.lit(float(factor)) * x.cast("double")))
    # (x - x) is 0 for finite numbers only
    finite = F.forall(v, lambda x: F.coalesce((x - x) == 0, F.lit(False)))
    norm = F.aggregate(v, F.lit(0.0), lambda a, x: a + F.pow(F.floor(F.lit(float(factor)) * x.cast("double")).cast("double"), 2))
    return F.when(finite & (norm < NORM_LIMIT), scaled)


class Strip:
    """Posting lists of a strip of rows, with the bounds of each list."""

    def __init__(self, rows: np.ndarray):
        self.rows, self.n = rows, len(rows)
        self.lists = []
        for weights in rows.T:
            at = np.flatnonzero(weights)
            self.lists.append((None if len(at) == self.n else at, np.ascontiguousarray(weights[at])))
        self.hi, self.lo = rows.max(0, initial=0), rows.min(0, initial=0)

    def competitive(self, query: np.ndarray, floor: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose score is at least ``floor`` (None: all) and their scores."""
        terms = np.flatnonzero(query)
        weight = query[terms].astype(float)
        bound = np.maximum(np.maximum(weight * self.hi[terms], weight * self.lo[terms]), 0) * SLACK
        order = np.argsort(-bound, kind="stable")
        terms, bound = terms[order], bound[order]
        left = np.append(np.cumsum(bound[::-1])[::-1], 0)      # bounds from each term on
        open_ = floor is None or floor <= 0
        essential = len(terms) if open_ else int(np.searchsorted(-left, -floor, side="right"))
        score, seen = np.zeros(self.n, query.dtype), np.zeros(self.n, bool)
        for t in terms[:essential]:
            at, weights = self.lists[t]
            if at is None:
                score += query[t] * weights
                seen[:] = True
            else:
                score[at] += query[t] * weights
                seen[at] = True
        if open_:
            rows = np.arange(self.n) if floor is None else np.flatnonzero(score >= floor)
            return rows, score[rows]
        rows = np.flatnonzero(seen & (score + left[essential] >= floor))
        score = score[rows]
        for i in range(essential, len(terms)):
            if not len(rows):
                break
            score += query[terms[i]] * self.rows[rows, terms[i]]
            stay = score + left[i + 1] >= floor
            if not stay.all():
                rows, score = rows[stay], score[stay]
        return rows, score


def _matrix(vectors: pa.ListArray, width: int) -> np.ndarray:
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(vectors), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out


def _shard_best(k: int):
    def best(rows: pa.Table, queries: pa.Table) -> pa.Table:
        vectors, asked = (t.column("v").combine_chunks() for t in (rows, queries))
        width = max([0, *(int(x.value_lengths().to_numpy(zero_copy_only=False).max(initial=0)) for x in (vectors, asked))])
        points, wanted = _matrix(vectors, width), _matrix(asked, width)
        nameless = rows.column("id").is_null().to_numpy()
        ids = rows.column("id").fill_null(0).to_numpy()
        strips = [(lo, Strip(points[lo:lo + STRIP])) for lo in range(0, len(points), STRIP)]
        by_id = np.argsort(ids, kind="stable")
        names = queries.column("query_id").to_numpy()
        q_out, at_out, score_out = [], [], []
        for i, query in enumerate(wanted):
            own = by_id[np.searchsorted(ids[by_id], names[i]):np.searchsorted(ids[by_id], names[i], side="right")]
            own = [r for r in own if not nameless[r] and (points[r] == query).all()][:1]
            at, score, floor = np.zeros(0, np.int64), np.zeros(0, np.int64), None
            for lo, strip in strips:
                more, their = strip.competitive(query, floor)
                if len(own):
                    other = more + lo != own[0]
                    more, their = more[other], their[other]
                if len(more):
                    at, score = np.append(at, more + lo), np.append(score, their)
                    top = np.lexsort((ids[at], nameless[at], -score))[:k]
                    at, score = at[top], score[top]
                    floor = int(score[-1]) if len(score) == k else None
            q_out.append(np.full(len(at), i))
            at_out.append(at)
            score_out.append(score)
        q, at = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (q_out, at_out))
        return pa.table({
            "q": queries.column("q").take(pa.array(q)), "query_id": queries.column("query_id").take(pa.array(q)),
            "copies": queries.column("copies").take(pa.array(q)),
            "vec_id": pa.array(ids[at], mask=nameless[at]),
            "score": pa.array(np.concatenate([np.zeros(0, np.int64), *score_out]).astype(np.int64))})
    return best


def top_k(vectors: DataFrame, asked: Column, k: int = 5, factor: int = 256, id_column: str = "vec_id",
          vector_column: str = "embedding", shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows of each row for
    which ``asked`` (a condition on ``id``) holds."""
    spark = vectors.sparkSession
    all_rows = vectors.select(col(id_column).cast("long").alias("id"),
                              whole_vector(col(vector_column), factor).alias("v")).where(F.col("v").isNotNull())
    same = Window.partitionBy("v").orderBy(F.col("id").asc_nulls_last())
    rows = written(all_rows.withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= k + 1)
                   .select("id", "v"), "topk-rows")
    queries = written(all_rows.where(F.col("id").isNotNull() & asked).groupBy("id", "v")
                      .agg(F.count(F.lit(1)).alias("copies"))
                      .select(F.monotonically_increasing_id().alias("q"), F.col("id").alias("query_id"), "copies", "v"),
                      "topk-queries")
    n_shards = max(1, -(-rows.count() // shard_rows))
    n_blocks = max(1, -(-queries.count() // block_rows))
    # every shard meets every block: rows go once to each block, queries once to each shard
    left = rows.select("id", "v", F.pmod(F.xxhash64("id", "v"), F.lit(n_shards)).alias("shard"),
                       F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))
    right = queries.select("q", "query_id", "copies", "v", F.pmod(F.xxhash64("q"), F.lit(n_blocks)).alias("block"),
                           F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"))
    best = left.groupBy("shard", F.col("block").cast("long").alias("block")).cogroup(
        right.groupBy(F.col("shard").cast("long").alias("shard"), "block")).applyInArrow(_shard_best(k), RESULT)
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    merged = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return (merged.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
            .select("query_id", "rank", "vec_id", "score"))


def ordered_neighbours(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """The k best rows of every row whose id is divisible by ``every``."""
    return top_k(vectors, F.col("id") % every == 0, k)
