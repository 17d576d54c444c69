"""URL filters by sorted digest arrays.

Listed keys (host suffix + path prefix) are held as a sorted array of 64-bit
xxhash digests beside the full strings.  A task maps the array of its shard
from a file, probes it with vectorised binary search and confirms the stored
strings, so two keys with one digest are told apart.

A URL has one probe per host suffix and listed path length.  Only distinct
probe keys are dealt to the shards, by digest, next to the list's own keys: no
task holds more than its share of either, and a key that a third of all URLs
ask for is probed once.  Hits (at most as many as listed keys) are joined back
to the distinct host and path heads, and those to the pages.

Explicit rules (allow or block) come before the list, the longest fitting rule
wins (then the longer host); a listed key blocks; anything else is allowed.

Defined results: a null URL or one without ``://`` has empty host and path,
fits no rule and is allowed; a rule's path must be a prefix of the URL's path;
repeated rows are judged alike; an empty list or table is fine; other columns
are neither read nor returned.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfold.llm.common import col

RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"),
         ("com/fr/", "allow"), ("com/de/", "block")]
# parts of host names that put a host on the list (fixed values)
BLOCKED_TERMS = ("adult ads bet bets betting casino escort gambling jackpot lottery payday pharma pills poker"
                 " porn sex slots spam viagra xxx")


def digests(keys: list[bytes]) -> np.ndarray:
    import xxhash
    return np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), np.uint64, len(keys))


class DigestArray:
    """Sorted digests and their strings in one folder, memory-mapped."""

    def __init__(self, folder: str, hash_keys: Callable[[list[bytes]], np.ndarray] = digests):
        self.hash_keys = hash_keys
        self.digests, self.ends, self.blob = (
            self._map(os.path.join(folder, name), kind) for name, kind in
            (("digests", np.uint64), ("ends", np.int64), ("blob", np.uint8)))

    @staticmethod
    def _map(path: str, kind) -> np.ndarray:
        # an empty file cannot be mapped
        return np.memmap(path, kind, "r") if os.path.getsize(path) else np.empty(0, kind)

    @staticmethod
    def write(folder: str, keys: list[bytes], hash_keys=digests) -> np.ndarray:
        """Writes the arrays; returns the keys' order in them."""
        h = hash_keys(keys)
        order = np.argsort(h, kind="stable")
        h[order].tofile(os.path.join(folder, "digests"))
        np.cumsum([len(keys[i]) for i in order], dtype=np.int64).tofile(os.path.join(folder, "ends"))
        np.frombuffer(b"".join(keys[i] for i in order), np.uint8).tofile(os.path.join(folder, "blob"))
        return order

    def key(self, place: int) -> bytes:
        start = int(self.ends[place - 1]) if place else 0
        return self.blob[start:int(self.ends[place])].tobytes()

    def probe(self, keys: list[bytes]) -> np.ndarray:
        """Place of each key in the array, -1 where it is not listed."""
        out = np.full(len(keys), -1, np.int64)
        h = self.hash_keys(keys)
        at = np.searchsorted(self.digests, h, "left")
        upto = np.searchsorted(self.digests, h, "right")
        for i in np.flatnonzero(upto > at):
            for place in range(at[i], upto[i]):      # more than one only if digests collide
                if self.key(place) == keys[i]:
                    out[i] = place
                    break
        return out


def host_of(url: Column) -> Column:
    a = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, a, a.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def listed_hosts(urls: DataFrame, terms: str = BLOCKED_TERMS) -> DataFrame:
    """(key): hosts of the corpus with a blocked term between dots or hyphens."""
    pattern = rf"(?:^|[.\-])(?:{'|'.join(terms.split())})(?:[.\-]|$)"
    hosts = urls.select(host_of(col("url").cast("string")).alias("h")).distinct()
    return hosts.where(F.col("h").rlike(pattern)).select(F.concat("h", F.lit("/")).alias("key"))


def entries(spark, rules=None, listed: DataFrame | None = None) -> DataFrame:
    """(key, verdict, is_rule) of rules and list; rules shadow equal listed keys."""
    rules = RULES if rules is None else rules
    e = spark.createDataFrame([(k, v, True) for k, v in rules], "key string, verdict string, is_rule boolean")
    if listed is not None:
        e = e.unionByName(listed.select("key").distinct().select(
            "key", F.lit("block").alias("verdict"), F.lit(False).alias("is_rule")))
    return e.groupBy("key").agg(F.max_by("verdict", "is_rule").alias("verdict"), F.max("is_rule").alias("is_rule"))


def _lookup(keys: DataFrame, table: DataFrame, shards: int) -> DataFrame:
    """Entries whose key is among ``keys``."""
    def probe(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(held):
            return pd.DataFrame(columns=["key", "verdict", "is_rule"])
        with tempfile.TemporaryDirectory() as folder:
            order = DigestArray.write(folder, [k.encode() for k in held["key"]])
            place = DigestArray(folder).probe([k.encode() for k in asked["key"]])
        rows = order[place[place >= 0]]
        return held.iloc[rows][["key", "verdict", "is_rule"]]

    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("_shard")
    return (keys.select("key", shard).groupBy("_shard")
            .cogroup(table.select("key", "verdict", "is_rule", shard).groupBy("_shard"))
            .applyInPandas(probe, "key string, verdict string, is_rule boolean"))


def judged(pages: DataFrame, table: DataFrame, shards: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, listed of every page's url.

    ``table``: (key, verdict, is_rule) with keys ``host/path-prefix``."""
    spark = pages.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path_at = F.locate("/", F.col("key"))
    lengths = sorted(r["n"] for r in table.select(
        (F.length("key") - path_at + 1).alias("n")).distinct().collect())   # distinct path lengths of the list
    url = col("url").cast("string")
    p = pages.select(col("page_id").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    p = p.withColumn("_head", F.substring("path", 1, max(lengths, default=0)))
    heads = p.groupBy("host", "_head").agg(F.count(F.lit(1)).alias("_n")).where("host <> ''")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(
        F.slice(labels, i, F.size(labels)), "."))
    lens = F.array(*[F.lit(n) for n in lengths]) if lengths else F.array().cast("array<int>")
    starts = F.transform(F.filter(lens, lambda n: n <= F.length("_head")),
                         lambda n: F.substring(F.col("_head"), F.lit(1), n))
    probes = (heads.select("host", "_head", F.explode(suffixes).alias("_suffix"), starts.alias("_starts"))
              .select("host", "_head", "_suffix", F.explode("_starts").alias("_start"))
              .select("host", "_head", F.concat("_suffix", "_start").alias("key")))
    hits = _lookup(probes.select("key").distinct(), table, shards)
    best = (probes.join(hits, "key").groupBy("host", "_head").agg(
        F.max(F.struct("is_rule", F.length("key").alias("n"), F.locate("/", "key").alias("h"), "key", "verdict"))
        .alias("m"))
        .select(F.col("host").alias("_h"), F.col("_head").alias("_p"), "m"))
    out = p.join(best, (F.col("host") == F.col("_h")) & (F.col("_head") == F.col("_p")), "left")
    return out.select("page_id", "host", "path", F.when(F.col("m.is_rule"), F.col("m.key")).alias("rule"),
                      F.coalesce("m.verdict", F.lit("allow")).alias("verdict"),
                      F.coalesce(~F.col("m.is_rule"), F.lit(False)).alias("listed"))
