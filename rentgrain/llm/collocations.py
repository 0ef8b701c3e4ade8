"""Phrases whose words go together, from count streams in prefix order and in suffix order.

Counting goes by length. Every phrase that occurs ``LEAST`` times has only parts that do, so words are
counted first, then pairs of words that are frequent, then phrases of three and four words whose pairs
all are. Which words and pairs are frequent reaches the tasks as a filter of hashed bits, which has no
false negatives: what it lets through by mistake is counted and found too rare.

The frequent phrases are one stream of counts. In *prefix order* (word by word) the parts that a phrase
begins with come right before it, and what extends it to the right comes right after it; in *suffix order*
(word by word from the end) the same holds for endings and extensions to the left. So one pass in each
order, keeping the phrases that are still open (four at most), meets all counts in lockstep: no phrase is
looked up in a table. The order is dealt out in ranges between split points; where a split falls inside
the extensions of a phrase, the ranges behind it get a copy of that phrase, which only lends its count
and brings back what it met.

A longer candidate that holds a phrase at ``COVER`` percent or more of its count drops it. Any phrase that
holds it does so through one that is a single word longer and at least as frequent, so extensions by one
word are enough.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rentgrain.llm.frames import documents, map_batches, stored

LONGEST, LEAST, COVER, SCALE, TOP = 4, 30, 80, 2_000_000, 2_000
#: Bytes of text counted together before counts are handed on.
BUFFER = 12 << 20
#: Bits of a filter for each frequent phrase, and the most a filter may have. A full filter only saves less.
BITS_EACH, MOST_BITS = 16, 1 << 27
#: Phrases of the sample that gives each split point.
SAMPLE = 8

_TABLE = bytearray(range(256))
_TABLE[65:91] = bytes(range(97, 123))
_TABLE[9] = 32
for _byte in b".,;:!?\n\x0b\x0c\r":
    _TABLE[_byte] = 10
_TABLE = bytes(_TABLE)


class _Numbers(dict):
    """Numbers of byte strings in the order in which they are met; 0 stands for no word, 1 for a border."""

    def __init__(self) -> None:
        super().__init__({b"": 0, b"\n": 1})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _words(texts: list[str]) -> tuple[np.ndarray, list[bytes]]:
    """The words of texts as numbers, with 1 at borders of pieces and of texts, and the words by number."""
    data = "\n".join(texts).encode("utf-8", "replace").translate(_TABLE).replace(b"\n", b" \n ")
    numbers = _Numbers()
    words = data.split(b" ")
    found = np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words))
    return found[found > 0], list(numbers)


def _in(filter_bits: np.ndarray, lang: str, phrases: list[bytes]) -> np.ndarray:
    """Which phrases the filter lets through."""
    start, mask = lang.encode() + b"\n", len(filter_bits) * 64 - 1
    at = np.fromiter((xxhash.xxh64_intdigest(start + p, 42) & mask for p in phrases), dtype=np.int64, count=len(phrases))
    return (filter_bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


def _counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.unique(codes, return_inverse=True, return_counts=True)


def _joined(words: pa.Array, places: list[np.ndarray]) -> pa.Array:
    parts = [words.take(pa.array(p)) for p in places]
    return pc.binary_join_element_wise(*parts, pa.scalar(b" ", words.type)) if len(parts) > 1 else parts[0]


def _phrases(lang: str, texts: list[str], low: int, word_bits: np.ndarray | None, pair_bits: np.ndarray | None):
    """(phrases, counts) of the texts: words, pairs of frequent words, or longer phrases of frequent pairs."""
    found, words = _words(texts)
    if low == 1:
        counts = np.bincount(found, minlength=len(words))[2:]
        yield pa.array(words[2:], pa.binary()), counts
        return
    fits = np.zeros(len(words), dtype=bool)
    fits[2:] = _in(word_bits, lang, words[2:])
    names = pa.array(words, pa.binary())
    frequent = fits[found]
    pair = np.flatnonzero(frequent[:-1] & frequent[1:])
    codes, place, counts = _counted(found[pair] << 32 | found[pair + 1])
    phrases = _joined(names, [codes >> 32, codes & 0xFFFFFFFF])
    if low == 2:
        yield phrases, counts
        return
    linked = np.zeros(len(found) + LONGEST, dtype=bool)
    linked[pair] = _in(pair_bits, lang, phrases.to_pylist())[place]
    number = np.zeros(len(found) + LONGEST, dtype=np.int64)
    number[pair] = place
    for size in range(low, LONGEST + 1):
        at = np.flatnonzero(linked[: len(found)] & linked[size - 2 : len(found) + size - 2])
        for k in range(1, size - 2):
            at = at[linked[at + k]]
        # Codes of the first words, numbered anew, with the next word: exact at every length.
        code = number[at]
        for k in range(2, size):
            _, code, _ = _counted(code)
            code = code << 32 | found[at + k]
        _, first, counts = np.unique(code, return_index=True, return_counts=True)
        yield _joined(names, [found[at[first] + k] for k in range(size)]), counts


def count_stream(
    docs: DataFrame, low: int, words: Broadcast | None = None, pairs: Broadcast | None = None
) -> DataFrame:
    """(lang, phrase, n) of (lang, text), summed over all rows: words for ``low`` = 1, pairs for 2, longer ones for 3."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[str]] = defaultdict(list)
        size = 0

        def counted() -> Iterator[pa.RecordBatch]:
            for lang, texts in waiting.items():
                bits = [x.value if x else None for x in (words, pairs)]
                for phrases, counts in _phrases(lang, texts, low, *bits):
                    for start in range(0, len(phrases), 50_000):
                        some, n = phrases[start : start + 50_000], counts[start : start + 50_000]
                        langs = pa.array([lang]).take(pa.array(np.zeros(len(some), dtype=np.int64)))
                        yield pa.RecordBatch.from_arrays(
                            [langs, some.cast(pa.string()), pa.array(n.astype(np.int64))], names=["lang", "phrase", "n"]
                        )
            waiting.clear()

        for part in parts:
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                waiting[lang].append(text)
                size += len(text)
            if size >= BUFFER:
                yield from counted()
                size = 0
        yield from counted()

    found = map_batches(docs, batches, "lang string, phrase string, n long")
    return found.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def filter_of(frequent: DataFrame) -> Broadcast:
    """The bits of the hashes of (lang, phrase), as 64-bit words; at most ``MOST_BITS`` of them reach the driver."""
    count, bits = frequent.count(), 1 << 10
    while bits < min(BITS_EACH * count, MOST_BITS):
        bits *= 2
    at = F.xxhash64(F.concat("lang", F.lit("\n"), "phrase")).bitwiseAND(F.lit(bits - 1))
    set_ = frequent.select(at.alias("at")).select(
        F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, CAST(at & 63 AS INT))").alias("bit")
    )
    rows = set_.groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    table = np.zeros(bits // 64, dtype=np.uint64)
    table[rows.column("word").to_numpy()] = rows.column("bit").to_numpy().view(np.uint64)
    return frequent.sparkSession.sparkContext.broadcast(table)


def frequent_phrases(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(lang, words, n) of all phrases met ``least`` times, single words included, and (lang, total) of all words."""
    singles = stored(count_stream(docs, 1))
    totals = singles.groupBy("lang").agg(F.sum("n").alias("total"))
    often = lambda counts: counts.where(F.col("n") >= least)
    words = filter_of(often(singles))
    doubles = stored(often(count_stream(docs, 2, words)))
    longer = often(count_stream(docs, 3, words, filter_of(doubles)))
    every = often(singles).unionByName(doubles).unionByName(longer)
    return stored(every.select("lang", F.split("phrase", " ").alias("words"), "n")), totals


def split_points(stream: DataFrame, order: Column) -> list[tuple[str, tuple[str, ...]]]:
    """Where the order is cut into ranges: as many as Spark shuffles into, from a sample of fixed size by hash."""
    ranges = int(stream.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = stream.select("lang", order.alias("key"))
    some = keys.orderBy(F.xxhash64("lang", "key"), "lang", "key").limit(SAMPLE * ranges).collect()
    drawn = sorted((r["lang"].encode(), tuple(w.encode() for w in r["key"])) for r in some)
    return sorted(set(drawn[SAMPLE // 2 :: SAMPLE]))


def in_ranges(stream: DataFrame, splits: list) -> DataFrame:
    """``stream`` (lang, key, own, ...) with its range, and copies (own false) for the ranges that begin among its extensions."""
    names = stream.columns

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows, ranges, own = [], [], []
            langs, keys = part.column(names.index("lang")).to_pylist(), part.column(names.index("key")).to_pylist()
            for row, (lang, key) in enumerate(zip(langs, keys, strict=True)):
                lang, key = lang.encode(), tuple(w.encode() for w in key)
                at = bisect_right(splits, (lang, key))
                rows.append(row)
                ranges.append(at)
                own.append(True)
                while at < len(splits) and splits[at][0] == lang and splits[at][1][: len(key)] == key:
                    at += 1
                    rows.append(row)
                    ranges.append(at)
                    own.append(False)
            taken = part.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*taken.columns, pa.array(own, pa.bool_()), pa.array(ranges, pa.int32())], names=[*names, "own", "range"]
            )

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema.fields)
    return map_batches(stream, batches, f"{types}, own boolean, range int")


def lockstep(stream: DataFrame) -> DataFrame:
    """(lang, key, n, parts, longest, own, carried) from one pass over each range of ``in_ranges``.

    ``parts`` are the counts of what the key begins with, from one word on; ``longest`` is the highest count of
    its extensions by one word. Of a copy only ``longest`` means something.
    """

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[list] = []
        at = None
        for part in parts:
            done: list[list] = []
            for lang, key, n, carried, own, range_ in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if (lang, range_) != at:
                    done += reversed(open_)
                    open_, at = [], (lang, range_)
                while open_ and key[: len(open_[-1][1])] != open_[-1][1]:
                    done.append(open_.pop())
                if open_ and len(open_[-1][1]) == len(key) - 1:
                    open_[-1][4] = max(open_[-1][4], n)
                open_.append([lang, key, n, [x[2] for x in open_], 0, own, carried])
            yield of(done)
        yield of(list(reversed(open_)))

    def of(rows: list[list]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * 7
        arrays = [pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=["lang", "key", "n", "parts", "longest", "own", "carried"])

    numbers = pa.list_(pa.int64())
    kinds = [pa.string(), pa.list_(pa.string()), pa.int64(), numbers, pa.int64(), pa.bool_(), numbers]
    together = stream.select("lang", "key", "n", "carried", "own", "range").repartition("range")
    schema = "lang string, key array<string>, n long, parts array<long>, longest long, own boolean, carried array<long>"
    return map_batches(together.sortWithinPartitions("range", "lang", "key"), batches, schema)


def _pass(stream: DataFrame) -> DataFrame:
    """One pass in the order of ``key``; copies brought together with their phrases."""
    splits = split_points(stream, F.col("key"))
    met = lockstep(in_ranges(stream, splits))
    own = lambda c: F.max(F.when(F.col("own"), F.col(c))).alias(c)
    return met.groupBy("lang", "key").agg(own("n"), own("parts"), F.max("longest").alias("longest"), own("carried"))


def collocations(
    docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, top: int | None = TOP
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of 2 to 4 words of each lang, None for all.

    A-Z count as a-z; phrases do not cross ``.,;:!?`` or line ends. A null lang is ``und``, a null or empty text has no
    words. ``a`` counts a phrase, ``l`` and ``r`` what is left and right of its weakest cut, ``n`` the words of the lang;
    score is floor(2000000 * a / (l + r)), exact for any counts below 2^63. Of equal cuts the leftmost counts,
    phrases of equal score go by a, then by bytes. Repeated rows count again, very long texts are counted whole,
    other columns are ignored, an empty table gives no rows.
    """
    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text")).where(F.octet_length("text") > 0)
    every, totals = frequent_phrases(rows, least)
    none = F.array().cast("array<long>")
    forward = stored(_pass(every.select("lang", F.col("words").alias("key"), "n", none.alias("carried"))))
    carried = F.concat(F.array("longest"), "parts").alias("carried")
    back = stored(_pass(forward.select("lang", F.reverse("key").alias("key"), "n", carried)))
    # carried: highest right extension, then counts of beginnings; parts: counts of endings, shortest first.
    weakest = F.expr(f"""array_min(transform(sequence(1, size(key) - 1), k -> named_struct(
        'score', CAST({SCALE}BD * CAST(n AS DECIMAL(19, 0)) div (CAST(element_at(carried, k + 1) AS DECIMAL(20, 0)) + element_at(parts, size(key) - k)) AS LONG),
        'k', k, 'l', element_at(carried, k + 1), 'r', element_at(parts, size(key) - k))))""")
    held = F.greatest("longest", F.element_at("carried", 1)).cast("decimal(20,0)")
    scored = (
        back.where((F.size("key") > 1) & (held * 100 < F.col("n").cast("decimal(20,0)") * COVER))
        .select("lang", F.concat_ws(" ", F.reverse("key")).alias("phrase"), F.col("n").alias("a"), weakest.alias("cut"))
        .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order).cast("long"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of every lang."""
    return collocations(documents(spark, sf_dir))


OP12_SQL = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS r, lang, piece
  FROM (SELECT coalesce(lang, 'und') AS lang,
               unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents WHERE text IS NOT NULL)
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), totals AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang
), grams AS (
  SELECT lang, w[i:i + k - 1] AS p
  FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i
        FROM words, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)
), f AS (
  SELECT lang, p, CAST(count(*) AS HUGEINT) AS a FROM grams GROUP BY lang, p HAVING count(*) >= 30
), cuts AS (
  SELECT lang, p, a, unnest(generate_series(1, len(p) - 1)) AS k FROM f WHERE len(p) > 1
), scored AS (
  SELECT c.lang, c.p, c.a, c.k, x.a AS l, y.a AS r, 2000000 * c.a // (x.a + y.a) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.p = c.p[1:c.k] JOIN f y ON y.lang = c.lang AND y.p = c.p[c.k + 1:len(c.p)]
), weakest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1
), inner_ AS (
  SELECT lang, p, a, s, unnest(generate_series(1, len(p) - s + 1)) AS i
  FROM f, (SELECT unnest([2, 3]) AS s) WHERE len(p) > s
), longest AS (
  SELECT lang, p[i:i + s - 1] AS p, max(a) AS longest FROM inner_ GROUP BY 1, 2
), ranked AS (
  SELECT w.lang, array_to_string(w.p, ' ') AS phrase, w.a, w.l, w.r, w.score,
         row_number() OVER (PARTITION BY w.lang ORDER BY w.score DESC, w.a DESC, array_to_string(w.p, ' ')) AS rank
  FROM weakest w LEFT JOIN longest g ON g.lang = w.lang AND g.p = w.p
  WHERE coalesce(100 * g.longest < 80 * w.a, true)
)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
