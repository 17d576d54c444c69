"""Language identification in two steps: family first, then one-versus-one
linear support vector machines among the languages of that family.

Features are counts of hashed letter 1- to 3-grams of the whole text (letters
in lower case, anything else one blank), square-rooted and scaled to length 1.  The
classifiers are fitted on a bounded sample of labelled rows: about
``per_language`` documents of each of the ``MAX_LANGUAGES`` most frequent
languages, picked by a hash of their id; the feature vectors of the sample (at
most ``max_rows`` * ``dims`` numbers) are the only thing that reaches the driver.  Predictions run in ``mapInPandas`` over
all documents.

Defined results: a text that is null or has no letter is ``und`` with score 0;
ties go to the language that sorts first; labels that occur in no family are a
family of their own; with no labelled rows everything is ``und``; very long
texts are read whole; an empty table gives an empty result; only text is an
input of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfold.llm.common import col, text_of

DIMS = 4096
PER_LANGUAGE = 600
MAX_ROWS = 6000
MAX_LANGUAGES = 200       # languages learned at most: bounds the broadcast of their counts
EPOCHS = 12
LAMBDA = 1e-4
UNKNOWN = "und"

# families of closely related languages by ISO 639-1 code (fixed values)
FAMILIES = {
    "germanic": "de en nl sv da no is af",
    "romance": "fr es it pt ro ca gl",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk",
    "uralic": "fi et hu",
    "indic": "hi bn mr ne pa gu",
    "sinitic": "zh yue",
}
FAMILY_OF = {lang: fam for fam, langs in FAMILIES.items() for lang in langs.split()}


def _letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text with 0 for each run of other signs."""
    a = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    keep = _is_letter(a)
    a = np.where(keep, a, 0)
    if len(a) > 1:
        a = a[np.concatenate(([True], (a[1:] != 0) | (a[:-1] != 0)))]
    return np.concatenate(([0], a, [0])).astype(np.uint32)


_TABLE: list[np.ndarray] = []


def _is_letter(a: np.ndarray) -> np.ndarray:
    if not _TABLE:
        _TABLE.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _TABLE[0][a]


def features(text: str, dims: int = DIMS) -> np.ndarray | None:
    """The feature vector of a text; None without letters."""
    a = _letters(text)
    if not a.any():
        return None
    out = np.zeros(dims, np.float64)
    with np.errstate(over="ignore"):
        h = a * np.uint32(2654435761)
        for n in (1, 2, 3):
            if n > 1:
                h = (h[:-1] * np.uint32(31) + a[n - 1:]) * np.uint32(2246822519)
            out += np.bincount((h ^ (h >> np.uint32(15))) % np.uint32(dims), minlength=dims)
    out = np.sqrt(out)
    return (out / np.linalg.norm(out)).astype(np.float32)


def fit_svm(x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, lam: float = LAMBDA, seed: int = 7) -> np.ndarray:
    """Linear SVM (hinge loss) by averaged stochastic subgradient steps; y is
    +1 / -1.  The last weight is the bias.  Classes weigh alike."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    rng = np.random.default_rng(seed)
    share = {s: 0.5 * len(y) / max(1, (y == s).sum()) for s in (1, -1)}
    w, mean = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    t = 0
    for epoch in range(epochs):
        for i in rng.permutation(len(y)):
            t += 1
            rate = 1.0 / (lam * (t + 1000.0))
            w *= 1.0 - rate * lam
            if y[i] * (x[i] @ w) < 1.0:
                w += rate * share[y[i]] * y[i] * x[i]
            if epoch == epochs - 1:
                mean += w
    return mean / max(1, len(y))


@dataclass
class Model:
    """Weights of all pairs: among families, and among each family's languages."""
    dims: int
    families: dict[str, list[str]]
    weights: dict[tuple[str, str], np.ndarray]

    def vote(self, x: np.ndarray, names: list[str]) -> tuple[str, float]:
        """Winner of all pairs and its confidence (0 to 1)."""
        wins = dict.fromkeys(names, 0.0)
        least = dict.fromkeys(names, 1.0)
        for a, b in combinations(names, 2):
            w = self.weights[a, b]
            p = 1.0 / (1.0 + np.exp(-2.0 * np.clip(x @ w[:-1] + w[-1], -30, 30)))
            wins[a if p >= 0.5 else b] += 1
            least[a], least[b] = min(least[a], p), min(least[b], 1.0 - p)
        best = min(names, key=lambda n: (-wins[n], -least[n], n))
        return best, float(least[best])

    def predict(self, text: str | None) -> tuple[str, float]:
        x = features(text, self.dims) if text and self.families else None
        if x is None:
            return UNKNOWN, 0.0
        family, p = self.vote(x, sorted(self.families))
        lang, q = self.vote(x, self.families[family])
        return lang, min(1.0, max(0.0, p * q))


def train_model(langs: list[str], x: np.ndarray, dims: int = DIMS) -> Model:
    family = [FAMILY_OF.get(v, f"only:{v}") for v in langs]
    tree = {f: sorted({v for v, g in zip(langs, family) if g == f}) for f in set(family)}
    weights = {}

    def pairs(names: list[str], labels: np.ndarray) -> None:
        for a, b in combinations(names, 2):
            rows = np.flatnonzero((labels == a) | (labels == b))
            weights[a, b] = fit_svm(x[rows], np.where(labels[rows] == a, 1, -1)).astype(np.float32)

    pairs(sorted(tree), np.array(family))
    for names in tree.values():
        pairs(names, np.array(langs))
    return Model(dims, tree, weights)


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, max_rows: int = MAX_ROWS,
        dims: int = DIMS) -> Model:
    """Fits a model on (doc_id, text, lang); rows without text or lang are left out."""
    rows = labelled.select(col("doc_id").alias("_id"), col("lang").cast("string").alias("lang"),
                           text_of().alias("_text")).where("lang is not null and _text rlike '\\\\p{L}'")
    counts = (rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
              .orderBy(F.col("n").desc(), "lang").limit(MAX_LANGUAGES))
    # a hash below per_language / n of its range: about per_language rows each
    place = F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) / float(1 << 30)
    # texts stay where they are: only the counts travel
    picked = rows.join(F.broadcast(counts), "lang").where(place * F.col("n") < per_language)

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            v = [features(t, dims) for t in b["_text"]]
            ok = [k for k, f in enumerate(v) if f is not None]
            yield pd.DataFrame({"h": b["h"].iloc[ok], "lang": b["lang"].iloc[ok], "x": [v[k].tobytes() for k in ok]})

    got = (picked.select(F.xxhash64("_id", "_text").alias("h"), "lang", "_text")
           .mapInPandas(vectors, "h bigint, lang string, x binary")
           .orderBy("h", "lang", "x").limit(max_rows).collect())
    got.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    if not got:
        return Model(dims, {}, {})
    return train_model([r["lang"] for r in got],
                       np.stack([np.frombuffer(bytes(r["x"]), np.float32) for r in got]), dims)


def predict(docs: DataFrame, model: Model, *keep: Column) -> DataFrame:
    """keep columns, lang_pred and score of every document's whole text."""
    src = docs.select(*keep, col("text").cast("string").alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)   # (families + pairs) * dims numbers
    fields = [f for f in src.schema.fields if f.name != "_text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            out = [m.predict(t) for t in b["_text"]]
            kept = {f.name: b[f.name].astype("Int64") if f.dataType.simpleString() == "bigint" else b[f.name]
                    for f in fields}
            yield pd.DataFrame(kept | {"lang_pred": [o[0] for o in out], "score": [o[1] for o in out]})

    return src.mapInPandas(run, f"{schema}, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from; a null id counts as held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))


def identified(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Fits on the rows that are not held out and predicts all rows."""
    model = fit(docs.where(~held_out(col("doc_id"))), per_language)
    return predict(docs, model, col("doc_id").cast("bigint").alias("doc_id"),
                   held_out(col("doc_id")).alias("held_out"))
