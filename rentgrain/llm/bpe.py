"""Byte-pair encoding and decoding by dynamic programming over prefixes.

The encoding of every prefix of a pre-token ends in exactly one token, and that token is the only
vocabulary entry ending there which is compatible with the last token of the prefix before it. So
one pass over the matches of an automaton fills a table of last tokens, and following the table
backwards from the end gives the ids. Compatibility of two neighbours is tested by undoing merges
on both sides of their border: the pair stands if no merge across the border had an earlier turn.

Texts are never shuffled: every task encodes its own rows, keeping the ids of short pre-tokens in a
table of bounded size that lives as long as the Python worker.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rentgrain.llm.frames import documents, map_batches

#: Fixed value: how byte-level tokenizers of this family cut text into pre-tokens.
PRE_TOKEN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Pre-tokens whose ids a worker keeps, and the longest of them in characters.
KEPT_PRE_TOKENS, KEPT_LENGTH = 300_000, 48
KEPT_PAIRS = 500_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file, by letter.

    Printable bytes stand for themselves; the others follow from code point 256 on.
    """
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Vocabulary:
    """A byte-level vocabulary file: bytes of each id, merges in their order, special tokens."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        letters = byte_letters()
        model = content["model"]
        spelled = {token: bytes(map(letters.__getitem__, token)) for token in model["vocab"]}
        self.bytes_of = {number: spelled[token] for token, number in model["vocab"].items()}
        # Steps number the tokens in the order in which merging can make them: bytes, then merges.
        singles = sorted(number for token, number in model["vocab"].items() if len(spelled[token]) == 1)
        self.id_of_step: list[int] = list(singles)
        step_of = {spelled[t]: -1 for t in model["vocab"]}
        for step, number in enumerate(singles):
            step_of[self.bytes_of[number]] = step
        self.parts: list[tuple[int, int]] = [(step, step) for step in range(len(singles))]
        self.merged: dict[tuple[int, int], int] = {}
        for merge in model["merges"]:
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            pair = (step_of[spelled[left]], step_of[spelled[right]])
            whole = spelled[left] + spelled[right]
            if pair in self.merged or step_of[whole] >= 0:
                continue
            step = len(self.parts)
            step_of[whole] = self.merged[pair] = step
            self.parts.append(pair)
            self.id_of_step.append(model["vocab"][left + right])
        self.n_bytes = len(singles)
        self.specials = {x["content"]: x["id"] for x in content.get("added_tokens", [])}
        self.bytes_of |= {number: token.encode() for token, number in self.specials.items()}
        self.step_bytes = [self.bytes_of[number] for number in self.id_of_step]


class PrefixEncoder:
    """Encodes whole texts with a vocabulary, exactly as merging pair by pair would."""

    def __init__(self, path: str) -> None:
        self.vocabulary = vocabulary = Vocabulary(path)
        self.matches = ahocorasick.Automaton()
        for step, token in enumerate(vocabulary.step_bytes):
            self.matches.add_word(token.decode("latin-1"), step)
        self.matches.make_automaton()
        self.pre_tokens = regex.compile(PRE_TOKEN)
        names = sorted(vocabulary.specials, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.lengths, self.id_of_step = list(map(len, vocabulary.step_bytes)), vocabulary.id_of_step
        self.compatible: dict[int, bool] = {}
        self.known = _Known(self)

    def stands(self, left: int, right: int) -> bool:
        """Whether merging leaves ``left`` followed by ``right`` as two tokens."""
        parts, merged = self.vocabulary.parts, self.vocabulary.merged
        earliest = len(parts)  # merges from this step on come too late to disturb the pair
        while True:
            across = merged.get((left, right))
            if across is not None and across < earliest:
                return False
            splittable_left, splittable_right = left >= self.vocabulary.n_bytes, right >= self.vocabulary.n_bytes
            if not splittable_left and not splittable_right:
                return True
            # Undo the later of the two merges. When both ends carry the same step the left one
            # was finished first, so the right one is undone.
            if splittable_left and left > right:
                earliest, left = left, parts[left][1]
            else:
                earliest, right = right + 1, parts[right][0]

    def pair_stands(self, left: int, right: int) -> bool:
        """``stands``, kept by pair."""
        if len(self.compatible) >= KEPT_PAIRS:
            self.compatible.clear()
        found = self.compatible[left << 20 | right] = self.stands(left, right)
        return found

    def pre_token_ids(self, pre_token: str) -> list[int]:
        """Ids of one pre-token: last token of every prefix, then back from the end."""
        spelled = pre_token.encode("utf-8").decode("latin-1")
        known, lengths = self.compatible, self.lengths
        last = [-1] * (len(spelled) + 1)
        for end, step in self.matches.iter(spelled):
            after = end + 1
            if last[after] >= 0:
                continue
            before = after - lengths[step]
            if before:
                left = last[before]
                if left < 0:
                    continue
                stands = known.get(left << 20 | step)
                if not (self.pair_stands(left, step) if stands is None else stands):
                    continue
            last[after] = step
        ids, at = [], len(spelled)
        while at:
            step = last[at]
            ids.append(self.id_of_step[step])
            at -= lengths[step]
        return ids[::-1]

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text; strings of special tokens get the special ids."""
        if self.special is None or not self.special.search(text):
            return list(chain.from_iterable(map(self.known.__getitem__, self.pre_tokens.findall(text))))
        ids: list[int] = []
        for piece in self.special.split(text):
            if piece in self.vocabulary.specials:
                ids.append(self.vocabulary.specials[piece])
            else:
                ids.extend(chain.from_iterable(map(self.known.__getitem__, self.pre_tokens.findall(piece))))
        return ids

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids, special tokens included; broken UTF-8 becomes replacement characters."""
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, ids)).decode("utf-8", errors="replace")


class _Known(dict):
    """Ids of pre-tokens met before, in two generations.

    When the younger one is full it becomes the older one, from which what is met again moves up.
    """

    def __init__(self, encoder: PrefixEncoder) -> None:
        super().__init__()
        self.encoder = encoder
        self.older: dict[str, list[int]] = {}

    def __missing__(self, pre_token: str) -> list[int]:
        ids = self.older.get(pre_token) or self.encoder.pre_token_ids(pre_token)
        if len(pre_token) <= KEPT_LENGTH:
            if len(self) >= KEPT_PRE_TOKENS:
                self.older = dict(self)
                self.clear()
            self[pre_token] = ids
        return ids


_ENCODERS: dict[str, PrefixEncoder] = {}


def encoder(path: str) -> PrefixEncoder:
    """The encoder of a vocabulary file, built once per Python process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PrefixEncoder(path)
    return _ENCODERS[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_decode(
    docs: DataFrame, path: str, text: str = "text", ids: str = "token_ids", decoded: str = "decoded_text"
) -> DataFrame:
    """``docs`` with two more columns: the ids of ``text`` (array<int>) and the text decoded from them.

    A null or empty text has no ids and decodes to the empty text. ``path`` is the vocabulary file,
    present on every executor. Columns of ``docs`` named like the new ones are replaced; rows are
    neither dropped nor merged, so repeated rows stay repeated.
    """
    kept = docs.drop(ids, decoded)
    names, where = [*kept.columns, ids, decoded], kept.columns.index(text)
    fields = [*kept.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for part in parts:
            rows = [bpe.encode(x) if x else [] for x in part.column(where).to_pylist()]
            added = [pa.array(rows, pa.list_(pa.int32())), pa.array(map(bpe.decode, rows), pa.string())]
            yield pa.RecordBatch.from_arrays([*part.columns, *added], names=names)

    return map_batches(kept, batches, T.StructType(fields))


def op9_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    coded = encode_decode(documents(spark, sf_dir).select("doc_id", "text"), path or default_vocabulary())
    return coded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("token_ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded_text", 256).alias("decoded_sha256"),
    )
