"""Infill, exact top-k and periodic runs against brute force, and their edge cases."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridfold.llm import infill, periodic, topk
from gridfold.llm.common import read
from tests.conftest import SF_SMALL
from tests.llm.test_operators import LONG, ODD, SCHEMA


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    extra = [(None, None), (None, "x y"), (5_000_001, "holds <S> itself"), (5_000_002, "é日本🙂 naïve  \n\t end"),
             (5_000_003, LONG), (5_000_003, LONG), (5_000_004, "<"), (5_000_005, "a<P"), (5_000_006, "7" * 200_000)]
    more = spark.createDataFrame(extra, "doc_id bigint, text string")
    return read(spark, SF_SMALL, "documents").select("doc_id", "text").unionByName(more).cache()


# 11 infill

def infill_brute(doc_id, text):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    x = sha("1:" + ("" if doc_id is None else str(doc_id)))
    h = [int(x[8 * i:8 * i + 8], 16) for i in range(4)]
    n = len(tokens)
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b, c = "".join(tokens[:lo]), "".join(tokens[lo:hi]), "".join(tokens[hi:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    if h[3] % 100 < 20:
        return doc_id, n, "spm", len(a), len(b), sha(f"<S>{c}<P>{a}<M>{b}"), sha(text)
    return doc_id, n, "psm", len(a), len(b), sha(f"<P>{a}<S>{c}<M>{b}"), sha(text)


def test_infill_matches_brute_force(docs):
    got = sorted(map(tuple, infill.infill_report(docs).collect()), key=str)
    assert got == sorted((infill_brute(*r) for r in docs.collect()), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_infill_outputs_are_texts(docs):
    out = infill.infilled(docs).withColumn("back", infill.restored(F.col("output"), F.col("form")))
    assert out.where("back <> text").count() == 0
    assert out.where("form <> 'plain'").count() > 100
    assert infill.infilled(docs, spm_below=100, plain_from=101).where("form = 'psm'").count() == 0


@pytest.mark.parametrize("shape", ["sparse", "dense", "runs", "mixed", "one", "none"])
def test_boundary_set_selects(shape):
    rng = np.random.default_rng(3)
    n = 3 * infill.SPAN + 77
    mask = {"sparse": rng.random(n) < 0.002, "dense": rng.random(n) < 0.6, "runs": np.arange(n) % 5000 < 4000,
            "mixed": rng.random(n) < np.repeat([0.001, 0.5, 1.0, 0.0], infill.SPAN)[:n],
            "one": np.arange(n) == n - 1, "none": np.zeros(n, bool)}[shape]
    places, members = infill.BoundarySet(mask), np.flatnonzero(mask)
    assert len(places) == len(members)
    some = range(len(members)) if len(members) < 5000 else rng.integers(0, len(members), 4000).tolist() + [0, len(members) - 1]
    assert all(places.select(k) == members[k] for k in some)
    if shape == "mixed":
        assert [c[1] for c in places.containers][:3] == ["array", "bitmap", "run"]


# 12 exact top-k

def topk_brute(rows, k, every):
    good = []
    for i, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            w = [math.floor(256 * float(np.float32(x))) for x in v]
            if sum(x * x for x in w) < 2 ** 62:
                good.append((i, w))
    out = []
    for a, (i, q) in enumerate(good):
        if i is None or i % every:
            continue
        best = sorted((-sum(x * y for x, y in zip(q, v)), j is None, j or 0) for b, (j, v) in enumerate(good) if b != a)
        out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(best[:k])]
    return sorted(out, key=str)


def vectors(kind, rng):
    if kind == "dense":
        return [(i, rng.normal(size=16).tolist()) for i in range(400)]
    if kind == "sparse":
        return [(i, (rng.normal(size=40) * (rng.random(40) < 0.1)).tolist()) for i in range(500)]
    if kind == "few values":
        return [(i, rng.integers(-1, 2, 4).astype(float).tolist()) for i in range(300)]
    if kind == "one vector":
        return [(i, [0.5, -0.25]) if i % 3 else (i, rng.normal(size=2).tolist()) for i in range(300)]
    if kind == "negative":
        return [(i, (1 if i % 10 else -1) * np.abs(rng.normal(size=5)) + 0.0) for i in range(200)]
    return [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [3.0]), (10, None), (20, [1.0, None]), (30, [float("nan"), 1.0]),
            (40, [float("inf"), 1.0]), (50, []), (60, [1e30, 1.0]), (None, [1.0, 2.0]), (None, [5.0, 5.0, 5.0]),
            (70, [-1.0, -1.0]), (80, [65000.0, -65000.0]), (81, [65000.0, 65000.0]), (90, [0.0, 0.0])]


@pytest.mark.parametrize("kind", ["dense", "sparse", "few values", "one vector", "negative", "odd"])
def test_topk_matches_brute_force(spark, kind):
    rows = [(i, v if v is None else [x if x is None else float(x) for x in v]) for i, v in vectors(kind, np.random.default_rng(5))]
    d = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id bigint, embedding array<float>, rank int, score double")
    for shard, block in ((64, 8), (1 << 13, 1 << 9)):
        got = topk.top_k(d, F.col("id") % 10 == 0, 5, shard_rows=shard, block_rows=block)
        assert sorted(map(tuple, got.collect()), key=str) == topk_brute(rows, 5, 10)
    assert topk.ordered_neighbours(d.limit(0)).collect() == []


def test_topk_skips_rows_without_essential_terms():
    rng = np.random.default_rng(1)
    rows = rng.integers(-9, 10, (500, 30)) * (rng.random((500, 30)) < 0.2)
    strip = topk.Strip(rows)
    query = rng.integers(-9, 10, 30)
    full = rows @ query
    for floor in (None, -5, 0, 1, 60, 150, 10_000):
        at, score = strip.competitive(query, floor)
        assert (score == full[at]).all()
        assert set(at) >= set(np.flatnonzero(full >= floor) if floor is not None else range(500))
        assert floor is None or (score >= floor).all()


# 13 periodic runs

def runs_brute(w, least=6, times=4):
    n, seen = len(w), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                seen.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, q, e - s) for (s, e), q in seen.items())


def report_brute(doc_id, text, least=6, times=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = runs_brute(w, least, times)
    gone = {i for s, q, size in runs for i in range(s + q, s + size)}
    best = max(runs, key=lambda r: (r[2], -r[0], -r[1]), default=None)
    return (doc_id, len(runs), *((best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4),
            sha("".join(f"{s},{size},{q}\n" for s, q, size in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_runs_match_brute_force(docs):
    d = docs.where("doc_id is null or length(text) < 6000")
    got = sorted(map(tuple, periodic.run_report(d).collect()), key=str)
    assert got == sorted((report_brute(*r) for r in d.collect()), key=str)
    assert sum(r[1] > 0 for r in got) > 10


def test_runs_of_invented_words():
    rng = random.Random(11)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(0, 6)):
            n, k = rng.randint(0, 90), rng.choice([1, 2, 3, 5, 30])
            w = [rng.randrange(k) for _ in range(n)]
            if n and rng.random() < 0.6:
                a, p = rng.randrange(n), rng.randint(1, 9)
                w = [x if i < a + p or rng.random() < 0.03 else w[a + (i - a) % p] for i, x in enumerate(w)]
            texts.append([str(x) for x in w])
        for least, times in ((6, 4), (12, 5)):
            runs, left = periodic._found([" ".join(x).encode() for x in texts], least, times)
            assert [[(s, q, size) for s, size, q in r] for r in runs] == [runs_brute(x, least, times) for x in texts]


@pytest.mark.parametrize("words,runs", [
    (["a"] * 60_000, [(0, 60_000, 1)]), ([str(i % 777) for i in range(60_000)], [(0, 60_000, 777)]),
    ([str(i) for i in range(60_000)], []), (["x", "y"] * 5 + ["z"] * 6 + ["x", "y"] * 5, [(0, 10, 2), (10, 6, 1), (16, 10, 2)])])
def test_long_texts_have_their_runs(words, runs):
    assert periodic._found([" ".join(words).encode()], 6, 4)[0] == [runs]


def test_grammar_shares_nodes():
    w = np.array([i % 50 for i in range(5000)], np.int64)
    (node, lo, mid, hi), left = periodic.grammar(w, np.zeros(5000, np.int64), np.arange(5000))
    assert len(np.unique(node)) < 500 and len(left[0]) < 20
    for k in np.unique(node)[:80]:                      # every place of a node derives the same words
        at = np.flatnonzero(node == k)
        assert len({tuple(w[lo[i]:hi[i]]) for i in at}) == 1 and (mid[at] - lo[at] == mid[at[0]] - lo[at[0]]).all()


# all three

def test_odd_rows_and_empty_tables(spark):
    odd = spark.createDataFrame(ODD, SCHEMA)
    for op in (infill.infilled, infill.infill_report, periodic.run_report):
        assert op(odd).count() == len(ODD) and len(op(odd).collect()) == len(ODD)
        assert op(odd.limit(0)).collect() == []
        assert op(odd).where("doc_id > 3").groupBy("doc_id").count().count() == 4
    assert sorted(map(str, (report_brute(r[0], r[1]) for r in ODD if len(r[1] or "") < 9000))) == sorted(
        map(str, map(tuple, periodic.run_report(odd.where("text is null or length(text) < 9000")).collect())))
