"""Language identification with error-correcting output codes.

Each language gets a codeword of bits. For every bit a binary n-gram classifier (log-odds of hashed
byte trigrams between the languages with and without the bit) gives a margin; the languages' losses
are sums of exponential losses of the margins against their codewords, weighted by how well a bit
separates the languages. The smallest loss wins; texts whose two best losses are close are flagged.

The model is learned from trigram totals of all training documents: one row for each language and
bucket, whatever the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rentgrain.llm.frames import documents, map_batches
from rentgrain.llm.grams import bucket_counts

BITS = 13
UNDETERMINED = "und"
#: Share of the probability that the second language must reach for a text to be called ambiguous.
AMBIGUOUS = 0.25


def _letters_only() -> np.ndarray:
    """ASCII letters in lower case and all other scripts stay, everything else becomes a space."""
    table = np.full(256, 32, dtype=np.uint8)
    table[97:123] = np.arange(97, 123)
    table[65:91] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    return table


LETTERS = _letters_only()


def text_counts(text: str) -> np.ndarray:
    """Trigram counts of a text; upper and lower case are the same, runs of other characters are one space."""
    return bucket_counts(b" " + text.lower().encode("utf-8", "replace") + b" ", BITS, table=LETTERS)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class Model:
    """languages, codewords (-1/1 by language and bit), trigram weights by bit, scale and weight of bits."""

    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    scale: np.ndarray
    trust: np.ndarray

    def predict(self, text: str) -> tuple[str, float, bool]:
        """Language, probability from 0 to 1, and whether a second language is close."""
        if not self.languages or not has_letter(text):
            return UNDETERMINED, 0.0, False
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        counts = text_counts(text)
        margins = self.weights @ counts / max(1, counts.sum()) / self.scale
        losses = (self.trust * np.exp(np.clip(-self.codes * margins, -3, 3))).sum(axis=1)
        odds = np.exp(losses.min() - losses)
        shares = odds / odds.sum()
        best = int(np.argmax(shares))
        second = np.delete(shares, best).max()
        return self.languages[best], float(shares[best]), bool(second >= AMBIGUOUS)


def codewords(count: int, seed: int = 7) -> np.ndarray:
    """-1/1 codewords: every split of up to five languages, beyond that the best spread of random splits."""
    if count <= 5:
        columns = [[1 if k >> i & 1 else -1 for i in range(count)] for k in range(1, 1 << (count - 1))]
        return np.array(columns).T.reshape(count, -1)
    random, length = np.random.default_rng(seed), int(np.ceil(10 * np.log2(count)))
    best, apart = None, -1
    for _ in range(50):
        code = np.where(np.argsort(random.random((count, length)), axis=0) < count // 2, 1, -1)
        distances = (length - code @ code.T) // 2
        least = int(distances[~np.eye(count, dtype=bool)].min())
        if least > apart:
            best, apart = code, least
    return best


def fit(totals: dict[str, np.ndarray]) -> Model:
    """The model of trigram totals by language."""
    languages = sorted(totals)
    if len(languages) < 2:
        return Model(languages, *(np.zeros((0, 0)),) * 2, np.zeros(0), np.zeros(0))
    floor = 1e-7
    shares = np.array([totals[x] / max(1, totals[x].sum()) for x in languages]) + floor
    shares /= shares.sum(axis=1, keepdims=True)
    codes = codewords(len(languages))
    weights = np.array([np.log(shares[bit > 0].mean(axis=0) / shares[bit < 0].mean(axis=0)) for bit in codes.T])
    expected = codes * (shares @ weights.T)  # mean margin of each language towards its own side
    scale = np.maximum(np.abs(expected).mean(axis=0), 1e-6) / 2
    trust = np.clip(expected.min(axis=0) / scale, 0.05, 2)
    return Model(languages, codes, weights, scale, trust * 2 / trust.sum() * len(trust))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Fits the model on all rows of ``docs`` with a language and a text."""
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")

    def totals(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for part in parts:
            for language, content in zip(*(part.column(k).to_pylist() for k in range(2)), strict=True):
                if language not in sums:
                    sums[language] = np.zeros(1 << BITS, dtype=np.int64)
                if has_letter(content):
                    sums[language] += text_counts(content)
        for language, counts in sums.items():
            at = np.arange(len(counts), dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([language] * len(at)), pa.array(at), pa.array(counts)], names=["lang", "bucket", "n"]
            )

    summed = map_batches(rows, totals, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = summed.toPandas()  # one row for each language and bucket
    found = {}
    for language, part in table.groupby("lang"):
        found[language] = np.zeros(1 << BITS)
        found[language][part["bucket"].to_numpy()] = part["n"].to_numpy()
    return fit(found)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and ambiguous, columns of these names replaced.

    Null texts and texts without a letter are ``und`` with score 0. A tie goes to the language that
    sorts first.
    """
    new = ["lang_pred", "score", "ambiguous"]
    kept = docs.drop(*new)
    names, where = [*kept.columns, *new], kept.columns.index(text)
    fields = [T.StructField(n, t()) for n, t in zip(new, (T.StringType, T.DoubleType, T.BooleanType), strict=True)]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [model.predict(x or "") for x in part.column(where).to_pylist()]
            columns = [list(x) for x in zip(*found, strict=True)] or [[], [], []]
            added = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns, *added], names=names)

    return map_batches(kept, batches, T.StructType([*kept.schema.fields, *fields]))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from three quarters of the labelled ones.

    Documents without an id are not learned from and count as held out.
    """
    docs = documents(spark, sf_dir).withColumn(
        "held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(True))
    )
    model = learn(docs.where(~F.col("held_out")).select("text", "lang"))
    found = identify(docs.select("doc_id", "held_out", "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
