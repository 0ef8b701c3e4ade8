"""Token counts of a unigram model, computed once for every prefix that pre-tokens share.

The best segmentation of a pre-token's prefix depends on the prefix alone. So distinct pre-tokens are
inserted in a trie whose nodes hold the best forward score and its number of tokens; inserting one
computes only the nodes that no earlier pre-token has made, and the count at its last node is stored
for every later occurrence. A text's count is the sum over its pre-tokens.

Each Python worker grows a trie of bounded size over the rows it reads. Nothing is shuffled: a table
of all pre-tokens of the corpus would have to be joined back to every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from rentgrain.llm.bpe import PRE_TOKEN, Vocabulary, default_vocabulary
from rentgrain.llm.frames import documents, map_batches

#: Nodes of a worker's trie, and pre-tokens with a stored count, before it starts anew; pre-tokens
#: longer than ``SHARED_BYTES`` are counted without being stored.
NODES, TERMINALS, SHARED_BYTES = 1_500_000, 400_000, 64


def rank_scores(path: str) -> dict[bytes, float]:
    """Log-probabilities of a vocabulary: by Zipf's law on the ids, which are in order of frequency."""
    vocabulary = Vocabulary(path)
    total = np.log(sum(1.0 / (n + 1) for n in vocabulary.bytes_of))
    special = set(vocabulary.specials.values())
    return {token: float(-np.log(n + 1) - total) for n, token in vocabulary.bytes_of.items() if n not in special}


class Trie:
    """Forward scores and token counts by prefix."""

    def __init__(self, scores: dict[bytes, float]) -> None:
        self.scores = scores
        self.lengths = sorted({len(t) for t in scores})
        self.pre_tokens = regex.compile(PRE_TOKEN)
        self.computed = 0
        self.clear()

    def clear(self) -> None:
        self.children: dict[int, int] = {}  # 256 * node + byte -> node
        self.best, self.count = [0.0], [0]
        self.terminals = _Terminals(self)

    def forward(self, data: bytes, end: int, best: list[float], count: list[int]) -> tuple[float, int]:
        """Best score and its number of tokens for ``data[:end]``, given those of all shorter prefixes.

        Of equal scores the one with the shortest last token counts.
        """
        self.computed += 1
        top, tokens = -np.inf, 0
        for length in self.lengths:
            if length > end:
                break
            score = self.scores.get(data[end - length : end])
            if score is not None and best[end - length] + score > top:
                top, tokens = best[end - length] + score, count[end - length] + 1
        return top, tokens

    def insert(self, data: bytes) -> tuple[int, float]:
        """Tokens and forward score of a pre-token, making the nodes it does not share."""
        node, best, count = 0, [0.0], [0]
        share = len(data) <= SHARED_BYTES
        for end, byte in enumerate(data, 1):
            after = self.children.get(256 * node + byte, -1) if node >= 0 else -1
            if after >= 0:
                best.append(self.best[after])
                count.append(self.count[after])
            else:
                top, tokens = self.forward(data, end, best, count)
                best.append(top)
                count.append(tokens)
                if share:
                    after = self.children[256 * node + byte] = len(self.best)
                    self.best.append(top)
                    self.count.append(tokens)
            node = after
        return count[-1], best[-1]

    def measure(self, text: str) -> tuple[int, int, float]:
        """Pre-tokens, tokens and forward score of a whole text."""
        found = [self.terminals[x] for x in self.pre_tokens.findall(text)]
        return len(found), sum(n for n, _ in found), float(sum(s for _, s in found))


class _Terminals(dict):
    """Stored results of the pre-tokens inserted so far."""

    def __init__(self, trie: Trie) -> None:
        super().__init__()
        self.trie = trie

    def __missing__(self, pre_token: str) -> tuple[int, float]:
        data = pre_token.encode("utf-8", "replace")
        if len(self.trie.best) >= NODES or len(self) >= TERMINALS:
            self.trie.children.clear()
            self.trie.best, self.trie.count = [0.0], [0]
            self.clear()
        found = self.trie.insert(data)
        if len(data) <= SHARED_BYTES:
            self[pre_token] = found
        return found


_TRIES: dict[str, Trie] = {}


def trie(path: str) -> Trie:
    """The trie over a vocabulary file, one for each Python process."""
    if path not in _TRIES:
        _TRIES[path] = Trie(rank_scores(path))
    return _TRIES[path]


def count_tokens(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with n_pre_tokens, n_tokens and forward_score, columns of these names replaced.

    A null or empty text has no tokens and score 0. Repeated rows stay repeated.
    """
    new = ["n_pre_tokens", "n_tokens", "forward_score"]
    rest = docs.drop(*new)
    names, where = [*rest.columns, *new], rest.columns.index(text)
    kinds = (T.LongType, T.LongType, T.DoubleType)
    fields = [T.StructField(n, t()) for n, t in zip(new, kinds, strict=True)]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = trie(path)
        for part in parts:
            found = [model.measure(x or "") for x in part.column(where).to_pylist()]
            columns = [list(x) for x in zip(*found, strict=True)] or [[], [], []]
            added = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns, *added], names=names)

    return map_batches(rest, batches, T.StructType([*rest.schema.fields, *fields]))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pre-tokens, tokens and forward score of every document."""
    found = count_tokens(documents(spark, sf_dir).select("doc_id", "text"), default_vocabulary())
    return found.select("doc_id", "n_pre_tokens", "n_tokens", "forward_score")
