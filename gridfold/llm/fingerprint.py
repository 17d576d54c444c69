"""Bottom-k sketches of word-shingle hashes as document fingerprints.

A sketch is the sorted array of the ``k`` smallest distinct 64-bit hashes of a
text's shingles (five consecutive words; a shorter text is one shingle; a text
without words has none).  Sketches of parts merge into the sketch of the
whole, and estimate resemblance, containment and the number of distinct
shingles.  All of it is DataFrame functions.

Defined results: a null text is an empty text; two empty sketches resemble
each other fully (1.0), an empty and a non-empty one not at all (0.0); equal
texts have equal fingerprints whatever row they stand in; ties cannot occur
(hashes are distinct within a sketch); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridfold.llm.common import col, held, text_of, words

K = 64
SHINGLE = 5
# hashes are shifted to 0 .. 2^64 - 1 for the estimate of distinct counts
HASH_SPAN = 2.0 ** 64


def shingle_hashes(w: Column, size: int = SHINGLE) -> Column:
    """Hashes of all runs of ``size`` words; fewer words are one run.  ``w``
    should be a plain column: it is read once per place."""
    n = F.size(w)
    runs = F.transform(F.sequence(F.lit(0), n - size),
                       lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))
    short = F.array(F.xxhash64(w))
    return (F.when(n == 0, F.array().cast("array<bigint>"))
            .when(n < size, short).otherwise(runs))


def bottom_k(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(w: Column, k: int = K, size: int = SHINGLE) -> Column:
    return bottom_k(shingle_hashes(w, size), k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_agg(c: Column, k: int = K) -> Column:
    """Aggregate: sketch of all parts of a group (each at most k hashes)."""
    return bottom_k(F.flatten(F.collect_list(c)), k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of common shingles among all: of the k smallest hashes
    of both, the part that is in both."""
    u = merge(a, b, k)
    both = F.array_intersect(F.array_intersect(u, a), b)
    return (F.when(F.size(u) == 0, F.lit(1.0))
            .otherwise(F.size(both) / F.size(u).cast("double")))


def distinct_shingles(s: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    top = F.element_at(s, -1).cast("double") + F.lit(2.0 ** 63)
    return (F.when(F.size(s) < k, F.size(s).cast("double"))
            .otherwise((k - 1) * F.lit(HASH_SPAN) / top))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that are also in b; 1 for an empty a."""
    j = resemblance(a, b, k)
    na, nb = distinct_shingles(a, k), distinct_shingles(b, k)
    common = j * (na + nb) / (1 + j)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), common / na))


def as_text(s: Column) -> Column:
    """A sketch as a string: 16 hex digits per hash."""
    return F.array_join(F.transform(s, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def fingerprints(docs: DataFrame, k: int = K, size: int = SHINGLE) -> DataFrame:
    """doc_id, _text and _sketch of every document."""
    d = docs.select(col("doc_id").alias("doc_id"), text_of().alias("_text"))
    d = held(d, "_w", words(F.col("_text")))
    return held(d, "_sketch", sketch(F.col("_w"), k, size)).drop("_w")


def with_next(docs: DataFrame, payload: list[str], parts: int) -> DataFrame:
    """Adds ``_next``: the payload of the next row in descending doc_id order
    (nulls last, equal ids by payload), the first row's after the last.

    Rows are dealt by doc_id ranges whose upper bounds are existing ids, so a
    range's successor row is known beforehand: the rows of a bound are also
    sent to the range above, where they stand after its own rows.  No window
    spans more than one range; at most ``parts`` bounds reach the driver."""
    ids = docs.where(F.col("doc_id").isNotNull())
    probs = [i / parts for i in range(1, parts)] + [1.0]
    bounds = sorted(set(ids.approxQuantile("doc_id", probs, 0.25 / parts)))
    lo = ids.agg(F.max("doc_id").alias("m"), F.count(F.lit(1)).alias("n")).first()
    if lo["n"]:
        bounds = sorted({int(b) for b in bounds} | {lo["m"]})
    n = len(bounds)
    ladder = F.lit(bounds) if n else None
    nulls = docs.where(F.col("doc_id").isNull()).limit(1).count()
    # part 0 holds the null ids, part i the ids up to bounds[i - 1]
    part = (F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(
        1 + F.size(F.filter(ladder, lambda b: b < F.col("doc_id")))) if n else F.lit(0))
    d = docs.withColumn("_part", part)
    if n:
        at_bound = F.array_contains(ladder, F.col("doc_id"))
        # the top row of part i follows the last row of part i + 1; the very
        # first row follows the very last one
        target = F.when(F.col("_part") == n, F.lit(0 if nulls else 1)).otherwise(F.col("_part") + 1)
        d = d.withColumn("_to", F.when(at_bound, F.array(
            F.struct(F.col("_part").alias("p"), F.lit(0).alias("g")),
            F.struct(target.alias("p"), F.lit(1).alias("g")))).otherwise(
            F.array(F.struct(F.col("_part").alias("p"), F.lit(0).alias("g")))))
        if nulls:   # the first null id follows the smallest id
            first_null = docs.where(F.col("doc_id").isNull()).select(
                F.min(F.struct(*payload)).alias("_p")).select("_p.*")
            extra = first_null.select(F.lit(None).cast("bigint").alias("doc_id"), *payload,
                                      F.lit(1).alias("_p"), F.lit(1).alias("_g"))
    else:
        d = d.withColumn("_to", F.array(F.struct(F.lit(0).alias("p"), F.lit(0).alias("g"))))
    d = d.select("doc_id", *payload, F.explode("_to").alias("_t")).select(
        "doc_id", *payload, F.col("_t.p").alias("_p"), F.col("_t.g").alias("_g"))
    if n and nulls:
        d = d.unionByName(extra)
    w = Window.partitionBy("_p").orderBy("_g", F.col("doc_id").desc_nulls_last(), *payload)
    pay = F.struct(*payload)
    d = d.withColumn("_next", F.lead(pay).over(w))
    if not n:   # only null ids, if any: the last is followed by the first
        d = d.withColumn("_next", F.coalesce("_next", F.first(pay).over(w)))
    return d.where(F.col("_g") == 0).drop("_p", "_g")


def edited_fingerprints(docs: DataFrame, k: int = K, size: int = SHINGLE,
                        parts: int | None = None) -> DataFrame:
    """Each document with its fingerprint, its edited text's (the last
    floor(n / 2) code points replaced by the first as many of the next
    document in descending doc_id) and their likeness."""
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = with_next(fingerprints(docs, k, size), ["_text", "_sketch"], parts)
    n = F.length("_text")
    half = F.floor(n / 2).cast("int")
    d = held(d.withColumn("n_chars", n.cast("long")), "_edited", F.concat(
        F.substring("_text", F.lit(1), n - half), F.substring(F.col("_next._text"), F.lit(1), half)))
    d = held(held(d, "_w", words(F.col("_edited"))), "_es", sketch(F.col("_w"), k, size))
    return d.select(
        "doc_id", "n_chars", F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("_sketch")).alias("fingerprint"), as_text(F.col("_es")).alias("edited_fingerprint"),
        resemblance(F.col("_sketch"), F.col("_es"), k).alias("near_edited"),
        resemblance(F.col("_sketch"), F.col("_next._sketch"), k).alias("near_next"),
        distinct_shingles(F.col("_sketch"), k).alias("distinct_shingles"),
        containment(F.col("_sketch"), F.col("_es"), k).alias("contained_in_edited"))
