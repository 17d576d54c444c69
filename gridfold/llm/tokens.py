"""Token counts by trie-shared dynamic programming, and byte-level ids.

``token_counts`` segments every pre-token by a unigram model over a public
vocabulary: the best split is the one with the highest sum of piece scores.
Distinct pre-tokens are inserted in a trie; each node holds the best score and
token count of the string that ends there, computed once from its ancestors,
so pre-tokens with a common prefix share that work, and a terminal node's
count answers every later occurrence.  The trie lives in the task, is bounded
in nodes and is begun anew when full, so memory does not grow with the corpus
and no vocabulary of the corpus is shuffled, collected or broadcast.

The unigram scores come from the vocabulary's order (Zipf's law): piece number
r has score -ln(r + 1).  A code point outside the vocabulary is one token with
a score below all others.  Ties go to fewer tokens.

Defined results: a null or empty text has 0 tokens and 0 pre-tokens; very long
texts are read whole; repeated rows count alike; an empty table gives an empty
result; other columns are neither read nor returned.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfold.llm.common import col, text_of

MAX_NODES = 400_000
LONG_WORD = 2000
VERIFIED_TEXTS = 5
# how byte-level vocabularies of this kind divide a text (fixed value)
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# pre-tokens: a word with the blank before it, or other white space
PRE_TOKEN = re.compile(r" ?[^\W\d_]+| ?\d+| ?[^\s\w]+| ?_+|\s")


def _shown_bytes() -> dict[str, int]:
    """Byte-level files write each byte as one visible character."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


def vocabulary(path: str) -> dict[str, float]:
    """Piece -> unigram score of a tokenizer file with a byte-level vocabulary."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    byte_of = _shown_bytes()
    out = {}
    for piece, rank in vocab.items():
        if all(c in byte_of for c in piece):
            try:
                text = bytes(byte_of[c] for c in piece).decode()
            except UnicodeDecodeError:
                continue              # part of a character: not a piece of text
            out[text] = -math.log(rank + 1.0)
    return out


class PrefixTrie(dict):
    """Token counts of strings (the terminal nodes' counts), filled through a
    trie whose nodes hold the best segmentation of their prefix."""

    def __init__(self, scores: dict[str, float], max_nodes: int = MAX_NODES):
        super().__init__()
        self.scores, self.max_nodes = scores, max_nodes
        self.longest = max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - 10.0
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.children: list[dict[str, int]] = [{}]
        self.best: list[float] = [0.0]       # forward score of the node's prefix
        self.tokens: list[int] = [0]         # its tokens

    def __missing__(self, token: str) -> int:
        if len(self.best) + len(token) > self.max_nodes:
            self.clear()
        children, best, tokens, scores = self.children, self.best, self.tokens, self.scores
        path, node, end = [0], 0, 0
        for c in token:
            end += 1
            kids = children[node]
            node = kids.get(c)
            if node is None:                 # beyond the shared prefix: one forward step
                last = path[-1]
                top, n = best[last] + scores.get(c, self.unknown), tokens[last] + 1
                for start in range(max(0, end - self.longest), end - 1):
                    piece = scores.get(token[start:end])
                    if piece is not None:
                        before = path[start]
                        score = best[before] + piece
                        if score > top or (score == top and tokens[before] + 1 < n):
                            top, n = score, tokens[before] + 1
                node = kids[c] = len(best)
                children.append({})
                best.append(top)
                tokens.append(n)
            path.append(node)
        self[token] = tokens[node]
        return tokens[node]

    def count(self, token: str) -> int:
        """Number of tokens of the best segmentation."""
        return self[token]


def token_counts(docs: DataFrame, vocabulary_path: str, max_nodes: int = MAX_NODES) -> DataFrame:
    """doc_id, n_pretokens, n_tokens of every document's whole text."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = PrefixTrie(vocabulary(vocabulary_path), max_nodes)
        for batch in batches:
            pre, tok = [], []
            for text in batch["_text"]:
                parts = PRE_TOKEN.findall(text)
                pre.append(len(parts))
                tok.append(sum(map(trie.__getitem__, parts)))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"),
                                "n_pretokens": pre, "n_tokens": tok})

    src = docs.select(col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("_text"))
    return src.mapInPandas(run, "doc_id bigint, n_pretokens bigint, n_tokens bigint")


def byte_ranks(path: str) -> dict[bytes, int]:
    """Bytes -> id of a byte-level vocabulary file, special tokens left out."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec.get("added_tokens", ())}
    byte_of = _shown_bytes()
    return {bytes(byte_of[c] for c in piece): i for piece, i in spec["model"]["vocab"].items()
            if piece not in special}


def id_encoder(path: str) -> Callable[[str], bytes]:
    """A function from a text to its ids as little-endian 32-bit bytes.

    The ids are those that ``tokenizers`` gives for the file.  The merging
    itself is done by ``tiktoken`` on the file's vocabulary, several times as
    fast; texts with a word of more than ``LONG_WORD`` characters go to
    ``tokenizers``, whose time does not grow with the square of a word.  The
    first texts of every task are encoded by both and must agree."""
    import numpy as np
    import tiktoken
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True            # their strings are ordinary text
    fast = tiktoken.Encoding("file", pat_str=BYTE_PATTERN, mergeable_ranks=byte_ranks(path), special_tokens={})
    left = VERIFIED_TEXTS

    def exact(text: str) -> bytes:
        return np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(text: str) -> bytes:
        nonlocal left
        if max(map(len, text.split()), default=0) > LONG_WORD:
            return exact(text)
        ids = fast.encode_to_numpy(text).astype("<u4", copy=False).tobytes()
        if left and text:
            left -= 1
            if ids != exact(text):
                raise ValueError(f"{path} is not a byte-level vocabulary in merge order")
        return ids

    return encode
