"""Packing token pieces into sequences by vector best-fit.

Documents are tokenized in ``mapInPandas`` and cut into pieces; pieces are
dealt at random into groups of bounded size, and each group is packed by
itself: in order of falling length, every piece goes to the open sequence that
fits all three capacities (tokens, documents, attention cost = sum of squared
piece lengths) and has either the largest weighted dot-product of demand and
residual capacity or the smallest norm of the residual left.  Only lengths
travel to the groups, not ids.

A group of ``group_rows`` pieces wastes less than one sequence's tokens at its
end, so splitting costs about 1 sequence in ``group_rows`` / 2.  The number of
groups follows the number of pieces, and pieces are dealt by their row, so
equal pieces do not meet in one group.

At the default capacities only tokens can bind: a piece has at least one
token, so 1024 documents never exceed a sequence, and the squared lengths of a
sequence never exceed a full one's.  Documents and cost then only weigh in the
choice; smaller capacities bind, at the price of more sequences.

Defined results: a null text is an empty text (its only id is the end id); a
repeated row is packed again as a row of its own; ties between sequences go to
the one opened first; an empty table gives an empty result; other columns are
neither read nor returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfold.llm.common import col, text_of, written
from gridfold.llm.tokens import id_encoder

MAX_TOKENS = 1024
MAX_DOCS = MAX_TOKENS
MAX_COST = MAX_TOKENS * MAX_TOKENS     # sum of squared lengths, at most one full piece's
END_ID = 2
GROUP_ROWS = 20_000
WEIGHTS = (1.0, 0.05, 0.05)            # of tokens, documents, cost, each as a share of its capacity


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def token_pieces(docs: DataFrame, tokenizer: str | None = None, max_tokens: int = MAX_TOKENS,
                 end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ids).
    A document of more than ``max_tokens`` ids is cut so that all pieces but
    the first are full."""
    path = tokenizer or default_tokenizer()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zlib
        encode = id_encoder(path)
        end = np.uint32(end_id).astype("<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["_text"]):
                data = encode(text) + end
                n = len(data) // 4
                first = n if n <= max_tokens else (n % max_tokens or max_tokens)
                at, k = 0, 0
                while at < n:
                    size = first if k == 0 else max_tokens
                    part = data[4 * at:4 * (at + size)]
                    rows.append((doc_id, k, at, size, zlib.crc32(part))
                                + ((np.frombuffer(part, "<u4").astype(np.int64),) if with_ids else ()))
                    at, k = at + size, k + 1
            out = pd.DataFrame(rows, columns=names)
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    schema += ", ids array<bigint>" if with_ids else ""
    names = [c.split()[0] for c in schema.split(", ")]
    src = docs.select(col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("_text"))
    # nulls of doc_id stay nulls, not floats
    return src.mapInPandas(_int_ids(cut), schema)


def _int_ids(fn):
    def run(batches):
        def fixed():
            for b in batches:
                if b["doc_id"].dtype.kind == "f":
                    b = b.assign(doc_id=b["doc_id"].astype("Int64"))
                yield b
        return fn(fixed())
    return run


def fit(lengths: np.ndarray, max_tokens: int = MAX_TOKENS, max_docs: int = MAX_DOCS,
        max_cost: int = MAX_COST, rule: str = "norm", weights=WEIGHTS) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece of one group."""
    n = len(lengths)
    seq, off = np.empty(n, np.int64), np.zeros(n, np.int64)
    caps = np.array([max_tokens, max_docs, max_cost], np.float64)
    wt = np.asarray(weights, np.float64)
    left = np.empty((3, max(n, 1)), np.float64)      # residual shares of the open sequences
    ids = np.empty(max(n, 1), np.int64)              # their numbers
    opened = live = 0
    eps = 1e-12
    for i in np.argsort(-lengths, kind="stable"):
        need = np.array([lengths[i], 1.0, float(lengths[i]) ** 2]) / caps
        if (need > 1 + eps).any():
            raise ValueError(f"a piece of {lengths[i]} tokens exceeds a sequence's capacities")
        best = -1
        if live:
            r = left[:, :live]
            ok = (r[0] >= need[0] - eps) & (r[1] >= need[1] - eps) & (r[2] >= need[2] - eps)
            where = np.flatnonzero(ok)
            if len(where):
                rest = r[:, where]
                score = (-(wt * need) @ rest if rule == "dot"
                         else (wt @ (rest - need[:, None]) ** 2))
                best = where[np.lexsort((ids[where], score))[0]]
        if best < 0:
            best, left[:, live], ids[live] = live, 1.0, opened
            live, opened = live + 1, opened + 1
        seq[i] = ids[best]
        off[i] = round((1.0 - left[0, best]) * max_tokens)
        left[:, best] -= need
        # a sequence without room for one more token or document is closed
        if left[0, best] * max_tokens < 0.5 or left[1, best] * max_docs < 0.5:
            live -= 1
            left[:, best], ids[best] = left[:, live], ids[live]
    return seq, off


def pack(pieces: DataFrame, groups: int, max_tokens: int = MAX_TOKENS, max_docs: int = MAX_DOCS,
         max_cost: int = MAX_COST, rule: str = "norm", weights=WEIGHTS) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length,
    ids_crc32, and _row, a number of the piece's row).  ``groups``: number of
    independently packed groups."""
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        # a fixed order, so that a group repeated on another executor agrees
        pdf = pdf.sort_values(["length", "_row"], ascending=[False, True], kind="stable")
        seq, off = fit(pdf["length"].to_numpy(), max_tokens, max_docs, max_cost, rule, weights)
        return pdf.assign(sequence_id=pdf["_g"].to_numpy(np.int64) * (1 << 32) + seq, offset=off)[out_cols]

    out_cols = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    # dealt by a hash, so that each group gets all lengths alike
    g = F.pmod(F.xxhash64("_row"), F.lit(groups)).cast("int")
    keyed = pieces.select("doc_id", "piece", "start", "length", "ids_crc32", "_row", g.alias("_g"))
    return keyed.groupBy("_g").applyInPandas(_keep_ids(one), (
        "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint,"
        " sequence_id bigint, offset bigint"))


def _keep_ids(fn):
    def run(pdf):
        return fn(pdf.assign(doc_id=pdf["doc_id"].astype("Int64")))
    return run


def pack_documents(docs: DataFrame, tokenizer: str | None = None, group_rows: int = GROUP_ROWS,
                   **capacities) -> DataFrame:
    """Tokenizes, cuts and packs all documents."""
    pieces = token_pieces(docs, tokenizer, capacities.get("max_tokens", MAX_TOKENS))
    # written once (lengths only): the rows' numbers stay what they are
    pieces = written(pieces.withColumn("_row", F.monotonically_increasing_id()), "pack-pieces")
    return pack(pieces, max(1, math.ceil(pieces.count() / group_rows)), **capacities)
