"""Stupid-backoff scores of a model of n-grams of up to ``ORDER`` words, computed relationally.

The score of a word w after u v is C(uvw) / C(uv) if uvw occurs, else ``ALPHA`` times the score of w after v,
which is C(vw) / C(v) if vw occurs, else ``ALPHA`` times C(w) / N. A text's score is the sum of the logarithms
over its words; its first words have shorter contexts. Counts are over all texts, less what the scored text
itself adds to them (``apart``): with its own occurrences counted, every n-gram of a corpus that scores itself
would be seen, and the model would never back off. A word that occurs in no other text counts ``UNSEEN``.

The tables, in order:

* ``packed``: texts in packs of up to ``PACK`` bytes, stored; an n-gram repeated within a pack is one entry.
* ``exploded``: the distinct n-grams of each pack with their counts, dealt by ranges of their hash. A row holds
  the entries of one pack in one range, in hash order.
* ``totals``: the count table of a range joined to the entries of all packs in it. What goes back is the count
  elsewhere in the corpus, in the order of the entries, so the n-grams themselves are not sent twice.
* ``score``: each pack meets its counts and gives the sums of its texts.

The number of ranges follows the bytes of the corpus, so a task holds the entries of about ``RANGE`` bytes of
text at every size. An n-gram in every text is one entry for each pack: no key is hot. N-grams are compared by
64-bit hashes; with 10^10 different n-grams about three pairs of them share one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rentgrain.llm.frames import documents, map_batches, stored

#: Longest n-grams; n-grams met less often are taken as unseen; factor for backing off; count of an unseen word.
ORDER, LEAST, ALPHA, UNSEEN = 3, 1, 0.4, 0.5
#: Bytes of text in a pack, and in the corpus for each range of hashes.
PACK, RANGE = 5 << 20, 8 << 20
#: Bytes of text in the corpus for each task of a shuffle, so that tasks do not grow with it.
SHARE = 16 << 20
WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def packed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(pack, keys, sizes, body): rows of a task put together; sizes are bytes of each text in lower case."""
    kind = docs.schema[key].dataType

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, number = TaskContext.get().partitionId() << 32, 0
        keys: list[pa.Array] = []
        texts: list[bytes] = []

        def flushed() -> pa.RecordBatch:
            nonlocal number
            together = pa.chunked_array(keys).combine_chunks()
            sizes = pa.array([len(x) for x in texts], pa.int64())
            rows = pa.array([0, len(texts)], pa.int32())
            columns = [pa.array([place + number], pa.int64()), pa.ListArray.from_arrays(rows, together)]
            columns += [pa.ListArray.from_arrays(rows, sizes), pa.array([zstandard.compress(b"".join(texts), 3)], pa.binary())]
            number += 1
            keys.clear()
            texts.clear()
            return pa.RecordBatch.from_arrays(columns, names=["pack", "keys", "sizes", "body"])

        for part in parts:
            size, begin = sum(map(len, texts)), 0
            for at, value in enumerate(part.column(1).to_pylist()):
                body = (value or "").lower().encode("utf-8", "replace")
                if texts and size + len(body) > PACK:
                    keys.append(part.column(0).slice(begin, at - begin))
                    yield flushed()
                    size, begin = 0, at
                texts.append(body)
                size += len(body)
            keys.append(part.column(0).slice(begin))
        if texts:
            yield flushed()

    fields = [T.StructField("pack", T.LongType()), T.StructField("keys", T.ArrayType(kind)), T.StructField("sizes", T.ArrayType(T.LongType()))]
    return map_batches(docs.select(key, text), batches, T.StructType([*fields, T.StructField("body", T.BinaryType())]))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams_of(sizes: list[int], body: bytes, order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """For every word of a pack the number of its text, and for each length n a hash of the n words that end there.

    The hash means nothing where the text has fewer words so far; ``ends`` gives the other places.
    """
    whole, at, words, counts = zstandard.decompress(body), 0, [], []
    for size in sizes:
        found = WORD.findall(whole[at : at + size].decode("utf-8"))
        words.extend(found)
        counts.append(len(found))
        at += size
    row = np.repeat(np.arange(len(sizes), dtype=np.int32), counts)
    if not words:
        return row, [np.zeros(0, np.uint64)] * order
    coded = pa.array(words, pa.string()).dictionary_encode()
    codes = np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    word = codes[coded.indices.to_numpy()]
    hashes = [_mixed(word)]
    for n in range(2, order + 1):
        before = np.concatenate([hashes[-1][:1], hashes[-1][:-1]])
        hashes.append(_mixed(before * np.uint64(0x9E3779B97F4A7C15) + word + np.uint64(n)))
    return row, hashes


def ends(row: np.ndarray, n: int) -> np.ndarray:
    """Places of the words that end an n-gram of their text."""
    return np.arange(len(row)) if n == 1 else np.flatnonzero(row[n - 1 :] == row[: len(row) - n + 1]) + n - 1


def _runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal sorted values begin."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


def _range_borders(distinct: np.ndarray, ranges: int) -> np.ndarray:
    """Places at which each of the equal ranges of hashes begins, and the end."""
    firsts = [-(-(k << 64) // ranges) for k in range(1, ranges)]
    return np.concatenate([[0], np.searchsorted(distinct, np.array(firsts, np.uint64)), [len(distinct)]])


def _squeezed(values: np.ndarray) -> bytes:
    """Numbers as planes of equal bytes, compressed."""
    return zstandard.compress(values.view(np.uint8).reshape(len(values), 8).T.tobytes(), 1)


def _opened(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view(np.uint64).ravel()


def exploded(packs: DataFrame, ranges: int, order: int) -> DataFrame:
    """(part, pack, n_words, grams, times): distinct n-grams of each pack by range of hashes, as differences."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for pack, sizes, body in zip(*(c.to_pylist() for c in part.columns), strict=True):
                row, hashes = grams_of(sizes, body, order)
                every = np.sort(np.concatenate([h[ends(row, n)] for n, h in enumerate(hashes, 1)]))
                first = _runs(every)
                distinct, times = every[first], np.diff(np.append(first, len(every))).astype(np.uint64)
                border = _range_borders(distinct, ranges)
                full = np.flatnonzero(np.diff(border))
                columns: list[list] = [[], [], [], [], []]
                for k in full:
                    some = slice(border[k], border[k + 1])
                    grams = np.diff(distinct[some], prepend=np.uint64(0))
                    values = (int(k), pack, len(row) if k == full[0] else 0, _squeezed(grams), _squeezed(times[some]))
                    for column, value in zip(columns, values, strict=True):
                        column.append(value)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=["part", "pack", "n_words", "grams", "times"])

    return map_batches(packs.select("pack", "sizes", "body"), batches, "part long, pack long, n_words long, grams binary, times binary")


def totals(entries: DataFrame, tasks: int) -> DataFrame:
    """(pack, part, n_words, elsewhere): for each entry its count in all other packs, in the order of the entries."""

    def joined(table: pa.Table) -> pa.Table:
        grams = [np.cumsum(_opened(x), dtype=np.uint64) for x in table["grams"].to_pylist()]
        times = np.concatenate([_opened(x) for x in table["times"].to_pylist()])
        every = np.concatenate(grams)
        order = np.argsort(every)
        first = _runs(every[order])
        counts = np.add.reduceat(times[order], first)
        elsewhere = np.empty(len(every), np.uint64)
        elsewhere[order] = np.repeat(counts, np.diff(np.append(first, len(every))))
        elsewhere -= times
        border = np.cumsum([0, *map(len, grams)])
        sent = [_squeezed(elsewhere[a:b]) for a, b in zip(border, border[1:])]
        return pa.table([table["pack"], table["part"], table["n_words"], pa.array(sent, pa.binary())], names=["pack", "part", "n_words", "elsewhere"])

    return entries.repartition(tasks, "part").groupBy("part").applyInArrow(joined, "pack long, part long, n_words long, elsewhere binary")


def scores_of(row: np.ndarray, hashes: list[np.ndarray], elsewhere: np.ndarray, texts: int, total: int, least: int, apart: bool) -> np.ndarray:
    """Sums of logarithms of the texts of one pack, given the counts of its distinct n-grams in other packs."""
    places = [ends(row, n) for n in range(1, len(hashes) + 1)]
    every = np.concatenate([h[p] for h, p in zip(hashes, places, strict=True)])
    owner = np.concatenate([row[p] for p in places])
    # Stable: occurrences of one n-gram stay in the order of their texts, so those of one text are together.
    order = np.argsort(every, kind="stable")
    sizes = np.diff(np.append(_runs(every[order]), len(every)))
    counted = np.repeat(elsewhere.astype(np.int64) + sizes, sizes)
    if apart:
        ordered, by = every[order], owner[order]
        begin = np.flatnonzero(np.concatenate([[True], (ordered[1:] != ordered[:-1]) | (by[1:] != by[:-1])]))
        own = np.diff(np.append(begin, len(every)))
        counted = counted - np.repeat(own, own)
    count = np.empty(len(every), np.float64)
    count[order] = counted
    words = np.bincount(row, minlength=texts)
    others = np.maximum(1, total - words[row]) if apart else np.full(len(row), max(1, total))
    used = len(row)
    before = count[:used]
    score = np.log(np.maximum(before, UNSEEN)) - np.log(others)
    for place in places[1:]:
        found = count[used : used + len(place)]
        used += len(place)
        context = before[place - 1]
        seen = found >= max(1, least)
        score[place] = np.where(seen, np.log(np.where(seen, found, 1)) - np.log(np.where(seen, context, 1)), np.log(ALPHA) + score[place])
        # Counts by word again, for the contexts of the next length.
        before = np.zeros(len(row))
        before[place] = found
    return np.bincount(row, weights=score, minlength=texts).astype(np.float64)


def score(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, order: int = ORDER, apart: bool = True
) -> DataFrame:
    """(key, n_words, score, mean_score) of every row of ``docs``.

    Words are runs of letters, digits and underscores in lower case. A null text and one without words
    have score 0 and no mean. Repeated rows and copies are other texts to each other, so they score high; they
    and rows with null or equal keys come out as often as they occur. An empty table gives an empty one, a
    corpus of one text scores it from ``UNSEEN`` alone. Other columns are not read. A text longer than ``PACK``
    is a pack of its own, which a task holds whole.
    """
    kind = docs.schema[key].dataType
    packs = stored(packed(docs, key, text))
    size = packs.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b))).first()[0] or 0
    tasks = max(1, -(-size // SHARE))
    found = stored(totals(exploded(packs, max(1, -(-size // RANGE)), order), tasks))
    total = found.agg(F.sum("n_words")).first()[0] or 0
    schema = T.StructType(
        [T.StructField(key, kind), T.StructField("n_words", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("mean_score", T.DoubleType())]
    )

    def summed(pack: pa.Table, counts: pa.Table) -> pa.Table:
        # One row, as packs have their own numbers.
        sizes, body = pack["sizes"][0].as_py(), pack["body"][0].as_py()
        keys = pack["keys"].combine_chunks().flatten()
        row, hashes = grams_of(sizes, body, order)
        words = np.bincount(row, minlength=len(sizes))
        if len(row):
            parts = sorted(zip(counts["part"].to_pylist(), counts["elsewhere"].to_pylist(), strict=True))
            sums = scores_of(row, hashes, np.concatenate([_opened(x) for _, x in parts]), len(sizes), total, least, apart)
        else:
            sums = np.zeros(len(sizes))
        mean = pa.array(sums / np.maximum(1, words), mask=words == 0)
        return pa.table([keys, pa.array(words, pa.int64()), pa.array(sums), mean], names=schema.names)

    counts = found.select("pack", "part", "elsewhere").repartition(tasks, "pack").groupBy("pack")
    return packs.repartition(tasks, "pack").groupBy("pack").cogroup(counts).applyInArrow(summed, schema)


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model's score of every document, from the n-grams of all others."""
    return score(documents(spark, sf_dir).select("doc_id", "text"))
