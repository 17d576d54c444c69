"""Fill-in-the-middle documents, cut at token boundaries held in a
Roaring-style boundary set.

A text's token boundaries (``[A-Za-z]+|[^A-Za-z]`` over code points) are a set
of places from 0 to its length.  ``BoundarySet`` keeps them in containers of
65,536 places each: a sorted array, a bitmap or runs, whichever is smallest,
with the cumulative cardinalities of the containers.  The place of the k-th
boundary is a binary search over the containers and a local select, so the two
cuts of a text never list its tokens.  The set is built and asked inside one
Arrow UDF that returns two places; cutting, joining, undoing and hashing are
DataFrame functions.

Defined results: a null text is an empty text; an empty text and one that
holds a sentinel stay plain; a null id hashes as an empty id; repeated rows
are treated alike, each by itself; an empty table gives an empty result; other
columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfold.llm.common import col, text_of

# fixed values of the output format
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM = 90           # of 100: documents left plain from here on
SPM_BELOW = 20            # of 100: documents in suffix-first order

SPAN = 1 << 16            # places a container covers
ARRAY_MOST = 4096         # members an array container holds at most


class BoundarySet:
    """A set of places in 0 .. ``size`` with ``select``; built from a mask."""

    def __init__(self, mask: np.ndarray):
        self.containers, counts = [], [0]
        for lo in range(0, len(mask), SPAN):
            part = mask[lo:lo + SPAN]
            members = np.flatnonzero(part)
            self.containers.append((lo, *self._container(part, members)))
            counts.append(len(members))
        self.upto = np.cumsum(counts)

    @staticmethod
    def _container(part: np.ndarray, members: np.ndarray):
        """(kind, data): the smallest of the three forms, in bytes."""
        if not len(members):
            return "array", members.astype(np.uint16)
        first = np.flatnonzero(np.diff(members, prepend=-2) != 1)     # of each run
        if 4 * len(first) < min(2 * len(members), SPAN // 8):
            lengths = np.diff(first, append=len(members))
            return "run", (members[first], np.cumsum(lengths))
        if len(members) <= ARRAY_MOST:
            return "array", members.astype(np.uint16)
        words = np.packbits(np.pad(part, (0, -len(part) % 64)), bitorder="little").view("<u8")
        return "bitmap", (words, np.cumsum(np.bitwise_count(words), dtype=np.int64))

    def __len__(self) -> int:
        return int(self.upto[-1])

    def select(self, k: int) -> int:
        """The k-th smallest member, from 0."""
        c = int(np.searchsorted(self.upto, k, side="right")) - 1
        lo, kind, data = self.containers[c]
        k -= int(self.upto[c])
        if kind == "array":
            return lo + int(data[k])
        starts, upto = data
        i = int(np.searchsorted(upto, k, side="right"))
        k -= int(upto[i - 1]) if i else 0
        if kind == "run":
            return lo + int(starts[i]) + k
        word = int(starts[i])
        for _ in range(k):
            word &= word - 1
        return lo + 64 * i + (word & -word).bit_length() - 1


def boundary_mask(text: str) -> np.ndarray:
    """Whether a token starts or ends at each place 0 .. len(text)."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    letter = ((code | 32) - 97) < 26
    mask = np.ones(len(code) + 1, bool)
    mask[1:-1] = ~(letter[:-1] & letter[1:])
    return mask


def _cuts(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, firsts, seconds in batches:
        rows = []
        for text, a, b in zip(texts, firsts, seconds):
            places = BoundarySet(boundary_mask(text))
            n = len(places) - 1                       # boundaries but the one at 0
            rows.append((n, *(places.select(k) for k in sorted((int(a) % (n + 1), int(b) % (n + 1))))))
        yield pd.DataFrame(rows, columns=["n", "lo", "hi"])


def token_cuts(text: Column, first: Column, second: Column) -> Column:
    """Struct of n (tokens) and the places lo <= hi (code points) that end the
    smaller and the larger of ``first % (n + 1)`` and ``second % (n + 1)``
    tokens."""
    return F.pandas_udf(_cuts, "n long, lo long, hi long")(text, first, second)


def infilled(docs: DataFrame, spm_below: int = SPM_BELOW, plain_from: int = PLAIN_FROM) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output and text of every
    document."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    d = docs.select(col("doc_id").alias("doc_id"), text_of().alias("text"),
                    token_cuts(text_of(), h[0], h[1]).alias("_c"),
                    (h[2] % 100).alias("_plain"), (h[3] % 100).alias("_spm"))
    t = F.col("text")
    plain = (t == "") | t.contains(PREFIX) | t.contains(SUFFIX) | t.contains(MIDDLE) | (F.col("_plain") >= plain_from)
    form = F.when(plain, "plain").when(F.col("_spm") < spm_below, "spm").otherwise("psm")
    lo, hi = F.col("_c.lo").cast("int"), F.col("_c.hi").cast("int")
    prefix, middle, suffix = F.substring(t, F.lit(1), lo), F.substring(t, lo + 1, hi - lo), F.substring(t, hi + 1, F.length(t) - hi)
    d = d.withColumn("form", form)
    f = F.col("form")
    return d.select(
        "doc_id", F.col("_c.n").alias("n"), "form",
        F.when(f != "plain", F.col("_c.lo")).alias("prefix_chars"),
        F.when(f != "plain", F.col("_c.hi") - F.col("_c.lo")).alias("middle_chars"),
        F.when(f == "plain", t)
        .when(f == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)).alias("output"),
        t.alias("text"))


def restored(output: Column, form: Column) -> Column:
    """The text again, from an output and its form.  The text of a cut document
    holds no sentinel, so each stands once."""
    part = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)))
    p = [F.get(part, F.lit(i)) for i in range(4)]
    return (F.when(form == "plain", output)
            .when(form == "psm", F.concat(p[1], p[3], p[2]))
            .otherwise(F.concat(p[2], p[3], p[1])))


def infill_report(docs: DataFrame) -> DataFrame:
    """``infilled`` with the hashes of the output and of the restored text."""
    return infilled(docs).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"))
