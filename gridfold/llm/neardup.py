"""Near-duplicates by SuperMinHash, banding, verification and union-find.

1. Documents with the same word sequence form one class; only one signature
   per class is built (a group of copies costs no pairs at all).
2. SuperMinHash: every shingle draws one permutation of the registers and one
   fraction per step; register p of step j gets j + fraction if that is
   smaller.  Steps end as soon as no register can still fall (early stopping).
3. Banding: classes with equal registers in a band share a bucket.  In each
   bucket the member with the most neighbours over all bands is the centre,
   and every other member is one candidate pair with it: as many pairs as
   members, however large the bucket.
4. Verification: candidate pairs are confirmed on the full shingle sets.
5. Union-find over confirmed links.  Buckets whose members then lie in more
   than one component are searched exhaustively across components: the members
   outside the bucket's main component meet the bucket's members in blocks of
   ``BLOCK`` classes, on full sets, and only links between components leave the
   task.  Together with 3 every pair of a bucket that could still join two
   components is tested, so no confirmed link of a bucket is lost.

With 43 bands of 10 registers a pair of similarity 0.85 shares no bucket with
probability 1e-4, at 0.9 with 3e-8; ``bands_for`` gives the numbers for other
thresholds.  Everything else is exact.

Defined results: a null text and a text without words have an empty set and
are linked with nothing; fewer than five words are one shingle; repeated rows
and rows with equal ids fall into one class if their words agree; rows with a
null id are linked by their text and never give their group's id unless all
ids of the group are null (component_id is null then, and kept is true);
an empty table gives an empty result; other columns are neither read nor
returned by ``near_duplicates`` and kept by ``deduplicated``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridfold.llm.common import SPACE_CHARS, col, text_of, unpack, whole_row, written

SHINGLE = 5
ROWS = 10                 # registers per band
MISS = 1e-4               # accepted chance that a pair at the threshold shares no bucket
BLOCK = 128               # classes compared at once in a bucket
CHUNK = 4096              # shingles that draw permutations at once
SIGN_ROWS = 1024          # documents signed at once
LAZY = 12                 # swaps of a permutation that are looked up one by one
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def bands_for(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands needed so that a pair at the threshold is missed with at most ``miss``."""
    return math.ceil(math.log(miss) / math.log(1.0 - threshold ** rows))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hash of each word, remembered for up to ``limit`` words."""

    def __init__(self, limit: int = 500_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        import xxhash
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def normal_words(text: str) -> list[bytes]:
    """Words of a text, A-Z lower-cased (bytes split at the six ASCII blanks)."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_set(w: list[bytes], hashes: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w))
    n = max(1, len(w) - size + 1)
    with np.errstate(over="ignore"):
        s = np.full(n, np.uint64(min(len(w), size)), np.uint64)
        for k in range(min(size, len(w))):
            s = mix64(s * _STEP + h[k:k + n])
    return np.unique(s)


def superminhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash registers (one row per set) of sets of 64-bit elements.

    Sets of like size are drawn together (the smallest need the most steps),
    long ones in parts of ``CHUNK`` elements, so memory is bounded by
    CHUNK * m whatever the sets' sizes."""
    out = np.full((len(sets), m), np.inf)
    parts: list[tuple[int, np.ndarray]] = []
    held = 0
    for k in sorted(range(len(sets)), key=lambda k: len(sets[k])):
        s = sets[k]
        for at in range(0, len(s), CHUNK):
            parts.append((k, s[at:at + CHUNK]))
            held += len(parts[-1][1])
            if held >= CHUNK:
                _draw(parts, out, m)
                parts, held = [], 0
    if parts:
        _draw(parts, out, m)
    return out


def _draw(parts: list[tuple[int, np.ndarray]], out: np.ndarray, m: int) -> None:
    """Lowers the registers of the parts' sets by their elements.

    Permutations are drawn by swaps (Fisher-Yates).  The first ``LAZY`` swaps
    are only noted and looked up; elements that need more get theirs in full."""
    flat = out.reshape(-1)
    owner = np.repeat([k for k, _ in parts], [len(e) for _, e in parts])
    docs = np.array(sorted({k for k, _ in parts}))
    with np.errstate(over="ignore"):
        state = mix64(np.concatenate([e for _, e in parts]) + _STEP)
        swaps: list[tuple[np.ndarray, np.ndarray]] = []     # (place, value moved there) of each step
        perm, at = None, None
        for j in range(m):
            # early stop: registers at or below j cannot be lowered any more
            open_ = out[docs].max(axis=1) > j
            if not open_.any():
                return
            if not open_.all():
                docs = docs[open_]
                live = np.zeros(len(out), bool)
                live[docs] = True
                alive = live[owner]
                owner, state = owner[alive], state[alive]
                swaps = [(p[alive], v[alive]) for p, v in swaps]
                if perm is not None:
                    perm, at = perm[:, alive], np.arange(len(state))
            if j == LAZY:
                at = np.arange(len(state))
                perm = np.repeat(np.arange(m, dtype=np.int16)[:, None], len(state), axis=1)
                for i, (place, _) in enumerate(swaps):
                    moved = perm[place, at]
                    perm[place, at], perm[i] = perm[i], moved
                swaps = []
            state = mix64(state + _STEP)
            frac = (state >> np.uint64(24)).astype(np.float64) * 2.0 ** -40
            pick = j + (((state & np.uint64(0xFFFFFF)) * np.uint64(m - j)) >> np.uint64(24)).astype(np.int64)
            if perm is None:
                chosen, here = pick.copy(), np.full(len(pick), j)
                for place, value in swaps:                  # a later move hides an earlier one
                    np.copyto(chosen, value, where=place == pick)
                    np.copyto(here, value, where=place == j)
                swaps.append((pick, here))
            else:
                chosen = perm[pick, at]
                perm[pick, at], perm[j] = perm[j], chosen
            np.minimum.at(flat, owner * m + chosen, j + frac)


def band_keys(registers: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band (its number included)."""
    bits = registers.view(np.uint64).reshape(bands, rows)
    with np.errstate(over="ignore"):
        key = np.arange(1, bands + 1, dtype=np.uint64) * _STEP
        for k in range(rows):
            key = mix64(key + bits[:, k])
    return key.view(np.int64)


def _signed(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """doc_id, raw (hash of the text), class (of its words, null without any),
    n_shingles and keys (one per band) of each row; keys are null where the same words came before in
    the batch."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib
        hashes = WordHashes()
        for b in batches:
            for at in range(0, len(b), SIGN_ROWS):
                part = b.iloc[at:at + SIGN_ROWS]
                cls, n, sets, where, first = [], [], [], [], {}
                for text in part["_text"]:
                    w = normal_words(text)
                    c = hashlib.md5(b" ".join(w)).digest() if w else None
                    cls.append(c)
                    if c is not None and c not in first:
                        sets.append(shingle_set(w, hashes, size))
                        first[c] = len(sets[-1])
                        where.append(len(n))
                    n.append(first.get(c, 0))
                keys = np.full(len(part), None, object)
                for k, registers in zip(where, superminhash(sets, bands * rows)):
                    keys[k] = band_keys(registers, bands, rows)
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").array,
                                    "raw": part["raw"].array, "class": cls,
                                    "n_shingles": n, "keys": keys})

    src = docs.select(col("doc_id").cast("bigint").alias("doc_id"), _raw(), text_of().alias("_text"))
    return src.mapInPandas(run, "doc_id bigint, raw binary, class binary, n_shingles bigint, keys array<bigint>")


def _sets(docs: DataFrame, size: int, signed: DataFrame, wanted: DataFrame) -> DataFrame:
    """(class, set) of the wanted classes, one row each: built from one text
    of each class, found by the hash of its raw text."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for b in batches:
            yield pd.DataFrame({"class": b["class"], "set": [
                shingle_set(normal_words(t), hashes, size).view(np.int64) for t in b["_text"]]})

    raw = (signed.select("class", "raw").join(wanted.select("class"), "class", "left_semi")
           .groupBy("class").agg(F.min("raw").alias("raw")))
    src = docs.select(_raw(), text_of().alias("_text"))
    one = src.join(raw, "raw").dropDuplicates(["class"])
    return one.select("class", "_text").mapInPandas(run, "class binary, set array<bigint>")


def _raw():
    return F.unhex(F.md5(text_of().cast("binary"))).alias("raw")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets satisfy 100 * common >= percent * union."""
    left = sets.select(F.col("class").alias("a"), F.col("set").alias("_sa"))
    right = sets.select(F.col("class").alias("b"), F.col("set").alias("_sb"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("_sa", "_sb"))
    return both.where(100 * common >= percent * (F.size("_sa") + F.size("_sb") - common)).select("a", "b")


def components(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(class, root) of every class in a link: its component's smallest class.

    Large-star / small-star rounds: every node hands its larger neighbours to
    its smallest one, then its smaller ones.  Each round is a partial-aggregate
    minimum and one join, written before the next."""
    edges = written(links.where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "dedup-links")
    for _ in range(max_rounds):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("_m", "u").alias("_m"))
        large = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("_m").alias("v"))
                 .where("u <> v").distinct())
        low2 = large.groupBy("u").agg(F.min("v").alias("_m"))
        moved = large.join(low2, "u")
        small = (moved.where("v <> _m").select(F.col("v").alias("u"), F.col("_m").alias("v"))
                 .unionByName(low2.select("u", F.col("_m").alias("v"))).where("u <> v").distinct())
        nxt = written(small, "dedup-round")
        # converged: every node has one parent, and no parent has one itself
        parents = nxt.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        open_ = (parents.where("n > 1").select("u")
                 .unionByName(nxt.select(F.col("v").alias("u")).join(nxt.select("u"), "u", "left_semi")))
        edges = nxt
        if open_.isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("class"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("class"), F.col("v").alias("root")).distinct())


def _cross_links(members: DataFrame, comps: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Links between different components inside buckets, tested in blocks."""
    labelled = members.select("key", "class").join(comps, "class", "left").withColumn(
        "root", F.coalesce("root", "class"))
    per = labelled.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    main = (per.groupBy("key").agg(F.count(F.lit(1)).alias("roots"), F.sum("n").alias("size"),
                                   F.max_by("root", F.struct("n", "root")).alias("main"))
            .where("roots > 1").select("key", "main", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")))
    open_ = written(labelled.join(main, "key"), "dedup-open")
    if open_.isEmpty():
        return None
    block = F.pmod(F.xxhash64("class", "key"), F.col("blocks")).cast("int")
    home = open_.select("key", "class", "root", block.alias("block"), F.lit(False).alias("guest"))
    guests = (open_.where("root <> main")
              .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("key", "class", "root", "block", F.lit(True).alias("guest")))
    rows = home.unionByName(guests).join(sets, "class")

    def cross(pdf: pd.DataFrame) -> pd.DataFrame:
        inner, outer = pdf[~pdf["guest"]], pdf[pdf["guest"]]
        found = []
        if len(inner) and len(outer):
            sizes = inner["set"].map(len).to_numpy()
            values = np.concatenate(inner["set"].tolist())
            owner = np.repeat(np.arange(len(inner)), sizes)
            order = np.argsort(values, kind="stable")
            values, owner = values[order], owner[order]
            roots, names = inner["root"].tolist(), inner["class"].tolist()
            joined = set()
            for name, root, own in zip(outer["class"], outer["root"], outer["set"]):
                lo, hi = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
                n = hi - lo
                if not n.sum():
                    continue
                at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                common = np.bincount(owner[at], minlength=len(inner))
                near = 100 * common >= percent * (sizes + len(own) - common)
                for k in np.flatnonzero(near):
                    # one link between two components is enough
                    if roots[k] != root and (root, roots[k]) not in joined:
                        joined |= {(root, roots[k]), (roots[k], root)}
                        found.append((name, names[k]))
        return pd.DataFrame(found, columns=["a", "b"])

    return rows.groupBy("key", "block").applyInPandas(cross, "a binary, b binary")


def near_duplicates(docs: DataFrame, percent: int = 80, size: int = SHINGLE, rows: int = ROWS,
                    miss: float = MISS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, group (the class of its root;
    null without words) and raw (hash of the text) of every document."""
    bands = bands_for(percent / 100.0, rows, miss)
    signed = written(_signed(docs, size, bands, rows), "dedup-signed")
    classes = signed.select("doc_id", "raw", "class", "n_shingles")
    # copies in different tasks give the same rows: one row per class first
    one = signed.where(F.col("keys").isNotNull()).groupBy("class").agg(F.first("keys").alias("keys"))
    keys = one.select("class", F.explode("keys").alias("key"))
    buckets = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = written(keys.join(buckets, "key"), "dedup-members")
    degree = members.groupBy("class").agg(F.sum("size").alias("degree"))
    centres = (members.join(degree, "class").groupBy("key")
               .agg(F.max_by("class", F.struct("degree", "class")).alias("a")))
    pairs = (members.select("key", F.col("class").alias("b")).join(centres, "key").where("a <> b")
             .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    sets = written(_sets(docs, size, signed, members.select("class").distinct()), "dedup-sets")
    links = written(_verified(pairs, sets, percent), "dedup-verified")
    comps = components(links)
    more = _cross_links(members, comps, sets, percent)
    if more is not None:
        more = written(more, "dedup-cross")
        if not more.isEmpty():
            comps = components(links.unionByName(more))
    return _labelled(classes, comps)


def _labelled(classes: DataFrame, comps: DataFrame) -> DataFrame:
    """Component and verdict of every row of ``classes`` (doc_id, raw, class, n_shingles)."""
    low = classes.where(F.col("class").isNotNull()).groupBy("class").agg(F.min("doc_id").alias("low"))
    rooted = (low.join(comps, "class", "left").withColumn("root", F.coalesce("root", "class")))
    first = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    names = rooted.select("class", "root").join(first, "root")
    out = classes.join(names, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"),
                      F.col("root").alias("group"), "raw")


def deduplicated(docs: DataFrame, percent: int = 80, **kw) -> DataFrame:
    """One document of each group, with all its columns; documents without
    words all stay.  Of repeated rows one stays."""
    # one row of each group, by id and raw text; rows without words all stay
    kept = near_duplicates(docs, percent, **kw).where("kept and group is not null")
    one = kept.groupBy("group").agg(F.min(F.struct("doc_id", "raw")).alias("_k")).select("_k.*")
    one = one.select(F.col("doc_id").alias("_kid"), F.col("raw").alias("_kraw"))
    d = docs.select(whole_row(docs), col("doc_id").cast("bigint").alias("_id"), _raw(),
                    F.btrim(text_of(), F.lit(SPACE_CHARS)).alias("_t"))
    full = (d.where("_t <> ''").join(one, F.col("_id").eqNullSafe(F.col("_kid")) & (F.col("raw") == F.col("_kraw")))
            .drop("_kid", "_kraw"))
    # repeated rows (equal id and text) leave one
    full = full.withColumn("_r", F.row_number().over(Window.partitionBy("_id", "raw").orderBy("_id"))).where("_r = 1")
    return unpack(full.select("_row").unionByName(d.where("_t = ''").select("_row")), docs.columns)
