"""Runs of repeated words, found on a Re-Pair grammar of the word ids.

A run is a stretch of consecutive words with smallest period q whose length is
at least max(``least``, ``times`` * q) and that no neighbouring word extends.
For each text the word ids are compressed by Re-Pair: in rounds, the pairs of
neighbouring symbols that occur more often than the pairs they overlap are
replaced by a new nonterminal.  What is left of a text is a balanced tree over
its last symbols.  Every run lies in a lowest node of the derivation and
crosses the boundary between that node's two parts.  So the runs across the
boundary are computed once for each node, at its first place, copied to all
places where the node is derived, and merged: pieces of a run found in lower
nodes lie within the whole run found higher up.

Texts are handled some at a time inside an Arrow UDF (``BATCH_BYTES``
bytes, or one text), whole; rows are never shuffled.  Before the grammar is built, a
text is cut at pairs that occur too seldom to lie within a run (a run holds
each of its pairs at least ``times`` - 1 times): no run spans such a place, so
the cut loses none.

Defined results: a null or wordless text has no runs and an empty collapsed
text; repeated rows are treated alike, each by itself; an empty table gives an
empty result; other columns are neither read nor returned.
"""

from __future__ import annotations

from itertools import chain, count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfold.llm.common import col, text_of

LEAST, TIMES = 6, 4
BATCH_BYTES = 1 << 21
HASH_BITS = 20            # of the pair counts that cut a text; shared cells only cut less
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _dense(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1]


def _cut(ids: np.ndarray, text: np.ndarray, least: int, times: int) -> np.ndarray:
    """Places (ascending) of the words that may lie in a run: stretches of at
    least ``least`` words whose pairs all occur ``times`` - 1 times or more."""
    n = len(ids)
    if n < least:
        return np.zeros(0, np.int64)
    mixed = (ids[:-1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
             + ids[1:].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
             + text[1:].astype(np.uint64) * np.uint64(0x165667B19E3779F9))
    mixed ^= mixed >> np.uint64(29)
    cell = (mixed * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - HASH_BITS)).astype(np.int64)
    often = (np.bincount(cell, minlength=1 << HASH_BITS)[cell] >= times - 1) & (text[1:] == text[:-1])
    edge = np.flatnonzero(np.diff(np.concatenate(([0], often, [0]))))
    starts, ends = edge[::2], edge[1::2]                   # stretches of pairs
    long_ = ends - starts >= least - 1
    starts, ends = starts[long_], ends[long_]
    size = ends - starts + 1                               # words
    return np.repeat(starts, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


def _chosen(rank: np.ndarray, live: np.ndarray) -> np.ndarray:
    """Pairs (by their first place) to replace in a round: of higher rank than
    the pairs they overlap; of a chain of equal pairs every other one."""
    n = len(rank)
    before = np.concatenate(([-1], np.where(live[:-1], rank[:-1], -1)))
    after = np.concatenate((np.where(live[1:], rank[1:], -1), [-1]))
    first = np.flatnonzero(live & (before != rank))        # of each chain
    chain = np.zeros(n, np.int64)
    chain[first] = first
    offset = np.arange(n) - np.maximum.accumulate(chain)
    return live & (offset % 2 == 0) & (before <= rank) & (after <= rank)


def grammar(symbols: np.ndarray, piece: np.ndarray, start: np.ndarray) -> tuple:
    """Re-Pair of several pieces side by side.  ``symbols``: ids that differ
    between texts; ``piece``: which piece each belongs to; ``start``: its place.
    Returns the derivations (node, place, boundary, end), one row for each
    place of each nonterminal, and the symbols left over (piece, start, end)."""
    none = np.zeros(0, np.int64)
    end = start + 1
    found, rest = [(none,) * 4], [(none,) * 3]
    fresh = int(symbols.max(initial=0)) + 1
    while len(symbols) > 1:
        same = piece[:-1] == piece[1:]
        pair, of, often = np.unique(np.where(same, symbols[:-1] * fresh + symbols[1:], -1),
                                    return_inverse=True, return_counts=True)
        live = same & (often[of] >= 2)
        if not live.any():
            break
        # pieces without a repeated pair are done; set aside once they are many
        open_ = np.zeros(int(piece[-1]) + 1, bool)
        open_[piece[:-1][live]] = True
        done = ~open_[piece]
        if 4 * done.sum() > len(done):
            rest.append((piece[done], start[done], end[done]))
            symbols, piece, start, end = symbols[~done], piece[~done], start[~done], end[~done]
            continue
        rank = np.empty(len(pair), np.int64)
        # equally frequent pairs in scattered order, so that many fit into a round
        rank[np.lexsort((pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), often))] = np.arange(len(pair))
        take = np.flatnonzero(_chosen(rank[of], live))
        node = fresh + _dense(of[take])
        found.append((node, start[take], start[take + 1], end[take + 1]))
        symbols, end = symbols.copy(), end.copy()
        symbols[take], end[take] = node, end[take + 1]
        fresh = int(node.max()) + 1
        keep = np.ones(len(symbols), bool)
        keep[take + 1] = False
        symbols, piece, start, end = symbols[keep], piece[keep], start[keep], end[keep]
    rest.append((piece, start, end))
    return [np.concatenate(x) for x in zip(*found)], [np.concatenate(x) for x in zip(*rest)]


def tree(piece: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Nodes (place, boundary, end) of a balanced binary tree over the symbols
    left of each piece."""
    order = np.argsort(start, kind="stable")
    piece, start, end = piece[order], start[order], end[order]
    out = [(np.zeros(0, np.int64),) * 3]
    while len(piece) > 1:
        first = np.flatnonzero(np.diff(piece, prepend=-1))
        number = np.arange(len(piece)) - np.repeat(first, np.diff(first, append=len(piece)))
        left = np.flatnonzero((number[:-1] % 2 == 0) & (piece[1:] == piece[:-1]))
        if not len(left):
            break
        out.append((start[left], start[left + 1], end[left + 1]))
        end[left] = end[left + 1]
        keep = number % 2 == 0
        piece, start, end = piece[keep], start[keep], end[keep]
    return [np.concatenate(x) for x in zip(*out)]


def _matches(w: np.ndarray, i: int, j: int, most: int) -> int:
    """How many words from i and from j on are equal, ``most`` at most."""
    done, step = 0, 16
    while done < most:
        step = min(step, most - done)
        differs = w[i + done:i + done + step] != w[j + done:j + done + step]
        if differs.any():
            return done + int(differs.argmax())
        done, step = done + step, 2 * step
    return most


def _smallest(w: np.ndarray, s: int, e: int, q: int) -> bool:
    """Whether q, a period of the words s .. e, is their smallest: over two
    rounds a smaller one divides q, so q over one of its primes is one too."""
    rest, p = q, 2
    while rest > 1:
        p = p if p * p <= rest else rest
        if rest % p == 0:
            if _matches(w, s, s + q // p, e - s - q // p) == e - s - q // p:
                return False
            while rest % p == 0:
                rest //= p
        p += 1
    return True


def _squares(w: np.ndarray, lo: np.ndarray, mid: np.ndarray, hi: np.ndarray, times: int):
    """(node, q, right, left): periods for which the two rounds to the right or
    to the left of the node's boundary may be equal, by some of their
    words.  A run over a boundary has ``times`` >= 4 rounds, so two on one side."""
    most = (hi - lo) // times
    for at in np.array_split(np.arange(len(lo)), 1 + int(most.sum() // (1 << 20))):
        node = np.repeat(at, most[at])
        q = np.arange(len(node)) - np.repeat(np.cumsum(most[at]) - most[at], most[at]) + 1
        c = mid[node]
        fits = c + 2 * q <= hi[node]
        i, d = np.where(fits, c, 0), np.where(fits, q, 0)
        right = fits & (w[i] == w[i + d]) & (w[i + d - 1] == w[i + 2 * d - 1])
        fits = c - 2 * q >= lo[node]
        i, d = np.where(fits, c, 0), np.where(fits, q, 0)
        left = fits & (w[i - 1] == w[i - d - 1]) & (w[i - d] == w[i - 2 * d])
        for part in (2, 3, 5):                             # a few words between, where the ends agree
            hit = np.flatnonzero(right)
            i, d = c[hit] + q[hit] // part, q[hit]
            right[hit] = w[i] == w[i + d]
            hit = np.flatnonzero(left)
            i, d = c[hit] - 1 - q[hit] // part, q[hit]
            left[hit] = w[i] == w[i - d]
        hit = np.flatnonzero(left | right)
        yield from zip(node[hit].tolist(), q[hit].tolist(), right[hit].tolist(), left[hit].tolist())


def crossing(w: np.ndarray, lo: np.ndarray, mid: np.ndarray, hi: np.ndarray, least: int, times: int) -> np.ndarray:
    """Rows (node, start, end, q) of the runs within each node that cross its
    boundary."""
    out, node, known = [], -1, []
    back, n = w[::-1], len(w)
    for k, q, right, left in _squares(w, lo, mid, hi, times):
        l, c, r = int(lo[k]), int(mid[k]), int(hi[k])
        if k != node:
            node, known = k, []
        # two rounds within a run of a divisor of q belong to that run
        sides = [side for side, on, a, b in ((q, right, c, c + 2 * q), (-q, left, c - 2 * q, c))
                 if on and not any(q % p == 0 and s <= a and b <= e for s, e, p in known)]
        for d in sides:
            # words i and i + q, from the boundary (right) or from a round before it (left)
            i = c if d > 0 else c - q
            e = i + q + _matches(w, i, i + q, r - i - q)
            s = i - _matches(back, n - i, n - i - q, i - l)
            if s < c < e and e - s >= max(least, times * q) and _smallest(w, s, e, q):
                known.append((s, e, q))
                out.append((k, s, e, q))
    return np.array(out, np.int64).reshape(-1, 4)


def _merged(start: np.ndarray, end: np.ndarray, q: np.ndarray) -> list[np.ndarray]:
    """Maximal intervals of each period, and of equal intervals the one of
    smallest period.  Pieces of a run lie within it."""
    order = np.lexsort((-end, start, q))
    start, end, q = start[order], end[order], q[order]
    base = int(end.max(initial=0)) + 1
    reach = np.maximum.accumulate(end + q * base)          # per period: q ascends
    keep = np.ones(len(q), bool)
    keep[1:] = (end + q * base)[1:] > reach[:-1]
    start, end, q = start[keep], end[keep], q[keep]
    order = np.lexsort((q, end, start))
    start, end, q = start[order], end[order], q[order]
    keep = np.ones(len(q), bool)
    keep[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, q = start[keep], end[keep], q[keep]
    order = np.lexsort((q, start))
    return [start[order], end[order], q[order]]


def runs_of(ids: np.ndarray, text: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[np.ndarray]:
    """(start, end, period) of all runs, by start and period.  ``ids``: the words of
    several texts one after another; ``text``: the number of each word's text."""
    at = _cut(ids, text, least, times)
    if not len(at):
        return [np.zeros(0, np.int64)] * 3
    w, t = ids[at], text[at]
    piece = np.cumsum((np.diff(at, prepend=at[0] - 1) != 1) | (np.diff(t, prepend=t[0]) != 0))
    place = np.arange(len(at))
    (node, lo, mid, hi), left = grammar(_dense(t * (int(w.max()) + 1) + w), piece, place)
    top = tree(*left)
    # the first place of each nonterminal, then the tree's nodes
    order = np.argsort(node, kind="stable")
    node, lo, mid, hi = node[order], lo[order], mid[order], hi[order]
    first = np.flatnonzero(np.diff(node, prepend=-1))
    copies = np.append(np.diff(first, append=len(node)), np.ones(len(top[0]), np.int64))
    places = np.append(lo, top[0])
    first = np.append(first, len(node) + np.arange(len(top[0])))
    lo, mid, hi = (np.append(a, b) for a, b in zip((lo, mid, hi), top))
    k, s, e, q = crossing(w, lo[first], mid[first], hi[first], least, times).T
    # to every place of the node
    n = copies[k]
    row = np.repeat(np.arange(len(k)), n)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    shift = places[first[k[row]] + nth] - lo[first[k[row]]]
    start, end, q = _merged(s[row] + shift, e[row] + shift, q[row])
    return [at[start], at[end - 1] + 1, q]


def _found(texts: list[bytes], least: int, times: int) -> tuple[list, list[str]]:
    """Runs and collapsed text of each text."""
    split = [t.split() for t in texts]
    sizes = np.array([len(x) for x in split], np.int64)
    number = dict(zip(dict.fromkeys(chain.from_iterable(split)), count()))
    ids = np.fromiter(map(number.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
    ends = np.cumsum(sizes)
    start, end, q = runs_of(ids, np.repeat(np.arange(len(texts)), sizes), least, times)
    drop = np.zeros(len(ids) + 1, np.int64)
    np.add.at(drop, start + q, 1)
    np.add.at(drop, end, -1)
    dropped = np.cumsum(drop)[:-1] > 0
    of = np.searchsorted(ends, start, side="right")
    begins = ends - sizes
    runs: list[list] = [[] for _ in texts]
    for i, s, e, p in zip(of.tolist(), (start - begins[of]).tolist(), (end - begins[of]).tolist(), q.tolist()):
        runs[i].append((s, e - s, p))
    out = []
    for i, ws in enumerate(split):
        if runs[i]:
            ws = [x for x, gone in zip(ws, dropped[begins[i]:ends[i]].tolist()) if not gone]
        out.append(b" ".join(ws).decode())
    return runs, out


def _batched(texts: pd.Series, least: int, times: int) -> pd.DataFrame:
    """``_found`` on as many texts at a time as BATCH_BYTES hold, one at least."""
    runs, left, batch, size = [], [], [], 0
    for text in texts:
        raw = text.encode()
        if batch and size + len(raw) > BATCH_BYTES:
            a, b = _found(batch, least, times)
            runs, left, batch, size = runs + a, left + b, [], 0
        batch.append(raw)
        size += len(raw)
    a, b = _found(batch, least, times)
    return pd.DataFrame({"runs": runs + a, "collapsed": left + b})


def periodic_runs(text: Column, least: int = LEAST, times: int = TIMES) -> Column:
    """Struct of ``runs`` (start, length, period; by start, then period) and
    ``collapsed``: the words that no run repeats, joined by single blanks.
    ``text`` must not be null; ``times`` is 4 or more."""
    def found(texts: pd.Series) -> pd.DataFrame:
        return _batched(texts, least, times)
    return F.pandas_udf(found, f"runs {RUNS}, collapsed string")(text)


def _echo(texts: pd.Series, keys: pd.Series) -> pd.Series:
    out = []
    for text, h in zip(texts, keys):
        if h == h and h is not None and int(h) % 10 == 0 and (ws := text.encode().split()):
            g, n = int(h) // 10, len(ws)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            text = b" ".join(ws[:a] + [ws[a + i % p] for i in range(n - a)]).decode()
        out.append(text)
    return pd.Series(out, dtype=object)


def echoed(text: Column, key: Column) -> Column:
    """The text; where ``key`` (0 or more) is divisible by ten, its words from
    one that the key picks on repeat a round of as many as the key says."""
    return F.pandas_udf(_echo, "string")(text, key)


def run_report(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """The runs of every document of the edited corpus (``echoed`` by the crc32
    of the id; a null id edits nothing) in figures and hashes."""
    key = F.coalesce(F.crc32(col("doc_id").cast("string").cast("binary")), F.lit(1)).cast("long")
    d = docs.select(col("doc_id").alias("doc_id"), periodic_runs(echoed(text_of(), key), least, times).alias("_r"))
    runs = F.col("_r.runs")
    best = F.array_max(F.transform(runs, lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("short"))))
    lines = F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size(runs) == 0, F.lit("")).otherwise(F.concat(F.array_join(lines, "\n"), F.lit("\n")))
    return d.select(
        "doc_id", F.size(runs).cast("long").alias("n_runs"),
        (-best["back"]).alias("start"), best["length"].alias("length"), (-best["short"]).alias("period"),
        F.floor(1000 * best["length"] / (-best["short"])).alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("_r.collapsed").cast("binary"), 256).alias("collapsed_sha256"))
