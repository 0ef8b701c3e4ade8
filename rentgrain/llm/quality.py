"""A quality classifier without labels.

Heuristic labellers vote good, junk or nothing on every text. Expectation-maximisation over the
patterns of votes estimates how accurate each labeller is and how likely each pattern is a good
text. These posteriors are the training labels of a linear scorer over hashed features, which then
scores every text, also those on which no labeller had an opinion.

All rows are voted on and scored where they lie. The only things gathered are the counts of vote
patterns (at most 3 to the number of labellers) and the features of ``SAMPLE`` training rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import pairwise
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rentgrain.llm.frames import documents, map_batches
from rentgrain.llm.grams import bucket_counts

#: The scorer is fitted on this many rows at most, half of them of each posterior class.
SAMPLE = 4_000
#: Buckets of hashed byte trigrams, and of hashed measurements, of the scorer.
GRAM_BITS, MEASURE_BUCKETS = 10, 512
#: Texts scored below this are rejected.
THRESHOLD = 0.5
WORD_ENDS = frozenset(".,;:?!)'\"»”’…")
SYMBOLS = frozenset(b"#*$%&|<>{}[]^~=\\@!")


def _class_table() -> np.ndarray:
    """A class for each byte: 0 other, 1 lower, 2 upper, 3 digit, 4 symbol, 5 space, 6 stop, 7 beyond ASCII."""
    table = np.zeros(256, dtype=np.uint8)
    table[97:123], table[65:91], table[48:58] = 1, 2, 3
    table[sorted(SYMBOLS)] = 4
    table[[9, 10, 11, 12, 13, 32]] = 5
    table[[46, 63]] = 6
    table[128:] = 7
    return table


CLASSES = _class_table()


def measurements(text: str) -> dict[str, float]:
    """What the labellers look at, each as a share or a mean."""
    data = text.encode("utf-8", "replace")
    n = np.bincount(CLASSES[np.frombuffer(data, dtype=np.uint8)], minlength=8)
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    letters = n[1] + n[2]
    count = max(1, len(words))
    ends = Counter(w[-1] for w in words)
    return {
        "words": float(len(words)),
        "lines": float(len(lines)),
        "upper": n[2] / max(1, letters + n[7] / 2),
        "symbols": n[4] / count,
        "digits": n[3] / max(1, len(data)),
        "stops": n[6] / count,
        "word_length": sum(map(len, words)) / count,
        "repeated": sum(map(eq, words, words[1:])) / count,
        "distinct": len(set(words)) / count,
        "density": n[4] / max(1, len(data)),
        "odd": sum(k for c, k in ends.items() if c not in WORD_ENDS and not c.isalnum()) / count,
        "loud": ends["!"] / count,
        "repeated_lines": 1 - len(set(lines)) / len(lines) if lines else 0.0,
    }


def _between(name: str, good: tuple[float, float], junk_above: float, words: int = 5) -> Callable[[dict[str, float]], int]:
    def vote(m: dict[str, float]) -> int:
        if m["words"] < words:
            return 0
        return -1 if m[name] > junk_above else 1 if good[0] <= m[name] <= good[1] else 0

    return vote


def _sentences(m: dict[str, float]) -> int:
    if m["words"] < 30:
        return 0
    return 1 if 0.03 <= m["stops"] <= 0.5 else -1 if m["stops"] < 0.004 else 0


def _variety(m: dict[str, float]) -> int:
    if m["words"] < 30:
        return 0
    return -1 if m["distinct"] < 0.2 and m["words"] < 1000 else 1 if m["distinct"] > 0.35 else 0


def _word_length(m: dict[str, float]) -> int:
    if m["words"] < 5:
        return 0
    return 1 if 3 <= m["word_length"] <= 10 else -1 if m["word_length"] > 20 or m["word_length"] < 1.5 else 0


def _lines(m: dict[str, float]) -> int:
    if m["lines"] < 4:
        return 0
    return -1 if m["repeated_lines"] > 0.5 else 1 if m["repeated_lines"] < 0.1 else 0


#: The labellers: 1 good, -1 junk, 0 no opinion.
LABELLERS: tuple[Callable[[dict[str, float]], int], ...] = (
    _between("upper", (0.0, 0.15), 0.5),
    _between("symbols", (0.0, 0.02), 0.25),
    _between("density", (0.0, 0.004), 0.04),
    _between("odd", (0.0, 0.03), 0.2),
    _between("loud", (0.0, 0.03), 0.25),
    _between("repeated", (0.0, 0.03), 0.3, words=10),
    _between("digits", (0.0, 0.1), 0.4),
    _sentences,
    _variety,
    _word_length,
    _lines,
)


def votes(m: dict[str, float]) -> list[int]:
    return [labeller(m) for labeller in LABELLERS]


def pattern_of(given: list[int]) -> int:
    """A pattern of votes as a number in base three."""
    number = 0
    for vote in given:
        number = 3 * number + vote + 1
    return number


def votes_of(pattern: int) -> list[int]:
    found = []
    for _ in LABELLERS:
        pattern, vote = divmod(pattern, 3)
        found.append(vote - 1)
    return found[::-1]


@dataclass
class LabelModel:
    """Share of good texts, chances of each vote, posterior of good by vote pattern.

    ``chances[c, l, v]``: how often labeller l votes v - 1 on texts of class c, 0 junk and 1 good.
    A labeller's accuracy on a class is its chance of the right vote among its votes there.
    """

    prior: float
    chances: np.ndarray
    posterior: dict[int, float]

    def accuracy(self) -> np.ndarray:
        """Accuracy by class (junk, good) and labeller, abstentions left out."""
        given = self.chances[:, :, 0] + self.chances[:, :, 2]
        return np.array([self.chances[0, :, 0], self.chances[1, :, 2]]) / given


#: Votes expected before the first round: junk, nothing, good; on junk and on good texts. A defect is
#: seen by few labellers, and hardly ever on a good text.
EXPECTED = ((0.4, 0.2, 0.4), (0.005, 0.2, 0.795))
#: Weight of these expectations in every round, as a share of all texts.
BELIEF = 0.03


def posteriors(given: np.ndarray, prior: float, chances: np.ndarray) -> np.ndarray:
    """Probability of good for rows of votes, the labellers voting independently within a class."""
    at = given.astype(int) + 1
    logs = np.log(chances / (1 - chances[:, :, 1:2]))
    logs[:, :, 1] = 0.0  # no opinion says nothing about the text
    junk, good = (np.take_along_axis(logs[c][None], at[:, :, None], axis=2)[:, :, 0].sum(axis=1) for c in (0, 1))
    return 1 / (1 + np.exp(np.clip(junk - good - np.log(prior / (1 - prior)), -50, 50)))


def estimate(counts: dict[int, int], rounds: int = 50) -> LabelModel:
    """Expectation-maximisation over the counts of vote patterns.

    Good stays the class on which a labeller votes junk less often, so the classes can't swap.
    """
    prior, chances = 0.8, np.array([[row] * len(LABELLERS) for row in EXPECTED])
    keys = sorted(counts)
    if not keys:
        return LabelModel(prior, chances, {})
    given, weight = np.array([votes_of(k) for k in keys]), np.array([counts[k] for k in keys], dtype=float)
    belief = BELIEF * weight.sum() * np.array([[row] * len(LABELLERS) for row in EXPECTED])
    cast = [given == v for v in (-1, 0, 1)]
    for _ in range(rounds):
        good = posteriors(given, prior, chances)
        seen = [np.stack([(weight * part) @ c for c in cast], axis=1) for part in (1 - good, good)]
        chances = np.array(seen) + belief
        chances /= chances.sum(axis=2, keepdims=True)
        chances[1, :, 0] = np.minimum(chances[1, :, 0], chances[0, :, 0])
        chances /= chances.sum(axis=2, keepdims=True)
        prior = float(np.clip(weight @ good / weight.sum(), 0.05, 0.99))
    return LabelModel(prior, chances, dict(zip(keys, posteriors(given, prior, chances).tolist(), strict=True)))


def features(text: str, m: dict[str, float]) -> np.ndarray:
    """Hashed features: square roots of trigram shares, and one bucket for each measurement's level."""
    grams = np.sqrt(bucket_counts(text.encode("utf-8", "replace"), GRAM_BITS).astype(np.float32))
    found = np.zeros(len(grams) + MEASURE_BUCKETS, dtype=np.float32)
    found[: len(grams)] = grams / max(1e-6, float(np.linalg.norm(grams)))
    for k, (name, value) in enumerate(sorted(m.items())):
        level = int(np.log2(1 + value)) if name in ("words", "lines", "word_length") else int(min(value, 3.9) * 10)
        found[len(grams) + (k * 40503 + level * 2654435761) % MEASURE_BUCKETS] += 0.5
    return found


def train(rows: np.ndarray, target: np.ndarray, rounds: int = 300, penalty: float = 1e-4) -> np.ndarray:
    """Weights and bias of a logistic scorer on soft labels, by full-batch gradient descent with momentum."""
    weights = np.zeros(rows.shape[1] + 1)
    step = np.zeros_like(weights)
    if len(rows) == 0:
        weights[-1] = 5.0
        return weights
    data = np.hstack([rows, np.ones((len(rows), 1), dtype=rows.dtype)])
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-data @ weights)) - target
        step = 0.9 * step - 1.0 * (data.T @ error / len(data) + penalty * weights)
        weights = weights + step
    return weights


@dataclass
class QualityModel:
    labels: LabelModel
    weights: np.ndarray

    def score(self, text: str) -> tuple[float, float]:
        """Posterior of the text's votes and the scorer's probability of good."""
        m = measurements(text)
        given = votes(m)
        posterior = posteriors(np.array([given]), self.labels.prior, self.labels.chances)[0]
        margin = float(features(text, m) @ self.weights[:-1] + self.weights[-1])
        return float(posterior), float(1 / (1 + np.exp(-np.clip(margin, -50, 50))))


def fit(docs: DataFrame, text: str = "text", key: str = "doc_id", sample: int = SAMPLE) -> QualityModel:
    """Label model over the votes on all rows, then the scorer on ``sample`` rows at most.

    The training rows of a class are those with the smallest hashes of ``key``.
    """
    rows = docs.select(F.xxhash64(key).alias("order"), F.col(text).alias("text")).where("text IS NOT NULL")

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [pattern_of(votes(measurements(x))) for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32())], names=["pattern"])

    patterns = map_batches(rows, count, "pattern int").groupBy("pattern").count().collect()
    labels = estimate({r["pattern"]: r["count"] for r in patterns})
    sizes = {good: sum(r["count"] for r in patterns if (labels.posterior[r["pattern"]] >= 0.5) == good) for good in (True, False)}
    # Of each class about twice the rows that it may give, so that the ranking below has its choice.
    shares = {good: min(1.0, sample / max(1, size)) for good, size in sizes.items()}
    posterior = labels.posterior

    def examples(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found: list[tuple[int, float, bytes]] = []
            for order, content in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                place = (order + (1 << 63)) / 2.0**64
                if place < max(shares.values()):
                    m = measurements(content)
                    target = posterior[pattern_of(votes(m))]
                    if place < shares[target >= 0.5]:
                        found.append((order, target, features(content, m).astype(np.float16).tobytes()))
            columns = [list(x) for x in zip(*found, strict=True)] or [[], [], []]
            kinds = (pa.int64(), pa.float64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["order", "target", "row"])

    chosen = map_batches(rows, examples, "order long, target double, row binary")
    halves = [chosen.where(c).orderBy("order").limit(sample // 2).collect() for c in ("target >= 0.5", "target < 0.5")]
    picked = [r for half in halves for r in half]
    width = (1 << GRAM_BITS) + MEASURE_BUCKETS
    data = np.array([np.frombuffer(r["row"], dtype=np.float16) for r in picked], dtype=np.float32).reshape(-1, width)
    return QualityModel(labels, train(data, np.array([r["target"] for r in picked])))


def classify(docs: DataFrame, model: QualityModel, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with posterior, score and kept, columns of these names replaced.

    A null or empty text is scored as a text without words, on which no labeller has an opinion; it
    gets score 0 and is rejected. Repeated rows get equal results.
    """
    new = ["posterior", "score", "kept"]
    rest = docs.drop(*new)
    names, where = [*rest.columns, *new], rest.columns.index(text)
    fields = [T.StructField(n, t()) for n, t in zip(new, (T.DoubleType, T.DoubleType, T.BooleanType), strict=True)]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [model.score(x) if x and not x.isspace() else (model.labels.prior, 0.0) for x in part.column(where).to_pylist()]
            added = [
                pa.array([p for p, _ in found], pa.float64()),
                pa.array([s for _, s in found], pa.float64()),
                pa.array([s >= threshold for _, s in found], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays([*part.columns, *added], names=names)

    return map_batches(rest, batches, T.StructType([*rest.schema.fields, *fields]))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior, score and verdict of every document."""
    docs = documents(spark, sf_dir)
    model = fit(docs)
    return classify(docs.select("doc_id", "text"), model).select("doc_id", "posterior", "score", "kept")
