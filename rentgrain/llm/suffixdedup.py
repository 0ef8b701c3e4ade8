"""Removal of byte strings that occur more than once, exactly and across all texts.

A byte goes if some string of ``SPAN`` bytes around it starts anywhere else too. Each such window
takes an anchor by its content, so equal windows take equal anchors at equal distances. Windows of one
anchor are cut into blocks of ``BLOCK`` starts, all of which contain one core of bytes; equal windows
lie in blocks with equal cores. That shares the work out by cores:

* A core met once holds no repeated window.
* A block whose bytes (context) are met twice is repeated in full. Copies are counted before the
  shuffle, so thousands of them weigh like two.
* Contexts that differ around one core decide by suffix arrays, where the core is a single symbol
  between the few bytes that may differ: windows are repeated where neighbours in the array share
  ``BLOCK`` symbols. Arrays are built by the linear grouping of ``lyndon``.
* A core with more than ``LONG`` contexts is decided by counting its windows' own bytes instead, so no
  task ever holds a group of unbounded size.

Texts move through one shuffle, in which equal texts are folded; all else are numbers and short spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rentgrain.llm.anchors import GRAM, POWERS, anchors, mixed
from rentgrain.llm.frames import documents, map_batches, small, stored
from rentgrain.llm.lyndon import suffix_array

#: Bytes of a string that must not start twice, window starts in a block, contexts of one core that
#: still meet in one suffix array.
SPAN, BLOCK, LONG = 400, 32, 64
#: Symbols of a suffix array.
ARRAY = 60_000


def print_of(text: Column) -> Column:
    """128 bits that stand for a whole text; a null text is an empty one."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)), 1, 16)


def _bytes(value: str | None) -> bytes:
    return (value or "").encode("utf-8", "replace")


def anchor_prints(docs: DataFrame, text: str, span: int) -> DataFrame:
    """(print, anchor, n): the distinct anchors of every row's text and how often each occurs in it."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [anchors(np.frombuffer(_bytes(x), dtype=np.uint8), span)[3] for x in part.column(1).to_pylist()]
            pairs = [np.unique(a, return_counts=True) for a in found]
            names = np.repeat(np.arange(len(pairs)), [len(v) for v, _ in pairs])
            values = np.concatenate([v for v, _ in pairs]) if pairs else np.zeros(0, dtype=np.int64)
            counts = np.concatenate([c for _, c in pairs]) if pairs else np.zeros(0, dtype=np.int64)
            columns = [part.column(0).take(pa.array(names)), pa.array(values, pa.int64()), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["print", "anchor", "n"])

    rows = docs.select(print_of(F.col(text)).alias("print"), F.col(text).alias("text")).where(F.octet_length("text") >= span)
    return map_batches(rows, batches, "print binary, anchor long, n long")


def _blocks(data: np.ndarray, kept: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """Blocks of the windows whose anchors are in ``kept``.

    Gives for each block hashes of its core and its context, first and last window start, and the
    place of the core.
    """
    at, first, last, value = anchors(data, span)
    chosen = np.isin(value, kept)
    at, first, last = at[chosen], first[chosen], last[chosen]
    low, high = (at - last) // BLOCK, (at - first) // BLOCK
    times = high - low + 1
    number = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    at, first, last = np.repeat(at, times), np.repeat(first, times), np.repeat(last, times)
    begin = np.maximum(first, at - (number + 1) * BLOCK + 1)
    end = np.minimum(last, at - number * BLOCK)
    core = at - number * BLOCK
    up, down = POWERS.get(len(data) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])])
    hashed = lambda a, b: mixed((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)).view(np.int64)
    return hashed(core, core + span - BLOCK + 1), hashed(begin, end + span), begin, end, core


def block_rows(held: DataFrame, span: int) -> DataFrame:
    """(core, context, print, begin, end, place, weight) of the kept anchors' blocks in (print, text, copies, kept)."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["core", "context", "print", "begin", "end", "place", "weight"]
        for part in parts:
            columns = part.to_pydict()
            for name, text, copies, kept in zip(*(columns[k] for k in ("print", "text", "copies", "kept")), strict=True):
                core, context, begin, end, place = _blocks(np.frombuffer(_bytes(text), dtype=np.uint8), np.array(kept), span)
                fixed = [pa.array([name] * len(core), pa.binary())]
                numbers = [pa.array(x.astype(np.int32)) for x in (begin, end, place, np.full(len(core), min(copies, 2)))]
                yield pa.RecordBatch.from_arrays([pa.array(core), pa.array(context), *fixed, *numbers], names=names)

    schema = "core long, context long, print binary, begin int, end int, place int, weight int"
    return map_batches(held, batches, schema)


def context_bytes(held: DataFrame, wanted: DataFrame, span: int) -> DataFrame:
    """``wanted`` blocks (core, n, print, begin, end, place) with the bytes before and after the core."""
    of_text = wanted.groupBy("print").agg(F.collect_list(F.struct("core", "n", "begin", "end", "place")).alias("blocks"))
    rows = held.select("print", F.coalesce("text", F.lit("")).cast("binary").alias("text")).join(of_text, "print")
    block = rows.select("print", "text", F.explode("blocks").alias("b"))
    cut = lambda a, b: F.substring(F.col("text"), a + 1, b - a)
    after = F.col("b.place") + span - BLOCK + 1
    return block.select(
        "b.core", "b.n", "print", "b.begin", "b.end",
        cut(F.col("b.begin"), F.col("b.place")).alias("head"), cut(after, F.col("b.end") + span).alias("tail"),
    )


def repeated_starts(contexts: list[tuple[int, bytes, bytes]]) -> list[list[int]]:
    """For each context (core, bytes before, bytes after), the offsets of its windows that are met twice.

    The contexts are set after one another, each closed by a symbol of its own below all others, so no
    match runs over a border.
    """
    codes = {core: k for k, core in enumerate(dict.fromkeys(c for c, _, _ in contexts))}
    lowest = len(contexts)
    text: list[int] = []
    owner: list[int] = []
    for k, (core, head, tail) in enumerate(contexts):
        symbols = [*(x + lowest for x in head), lowest + 256 + codes[core], *(x + lowest for x in tail), k]
        text.extend(symbols)
        owner.extend([k] * len(symbols))
    starts, at = [], 0
    for _, head, tail in contexts:
        starts.append(at)
        at += len(head) + len(tail) + 2
    found: list[set[int]] = [set() for _ in contexts]
    order = suffix_array(text)
    for left, right in zip(order, order[1:]):
        if text[left : left + BLOCK] == text[right : right + BLOCK]:
            for i in (left, right):
                found[owner[i]].add(i - starts[owner[i]])
    return [sorted(x) for x in found]


def by_suffix_arrays(contexts: DataFrame, span: int) -> DataFrame:
    """(print, start, stop) of repeated windows among contexts of few per core, which lie together."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[dict] = []
        size = 0
        for part in parts:
            for row in part.to_pylist():
                # An array is closed only between cores; a core has at most LONG contexts.
                if size >= ARRAY and row["core"] != waiting[-1]["core"]:
                    yield _spans(waiting)
                    waiting, size = [], 0
                waiting.append(row)
                size += len(row["head"]) + len(row["tail"]) + 2
        if waiting:
            yield _spans(waiting)

    def _spans(rows: list[dict]) -> pa.RecordBatch:
        spans = []
        for row, offsets in zip(rows, repeated_starts([(r["core"], r["head"], r["tail"]) for r in rows]), strict=True):
            if row["n"] == 1 and offsets:
                at = np.array(offsets) + row["begin"]
                cut = np.flatnonzero(np.diff(at) > 1)
                for a, b in zip(at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])], strict=True):
                    spans.append((row["print"], int(a), int(b) + span))
        columns = [list(x) for x in zip(*spans, strict=True)] or [[], [], []]
        kinds = (pa.binary(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["print", "start", "stop"])

    together = contexts.repartition("core").sortWithinPartitions("core")
    return map_batches(together, batches, "print binary, start int, stop int")


def by_counting(contexts: DataFrame, span: int) -> DataFrame:
    """As ``by_suffix_arrays``, for cores of any number of contexts: each window's bytes are counted."""
    window = contexts.select(
        "core", "n", "print", "begin", "head", "tail", F.explode(F.sequence(F.lit(0), F.col("end") - F.col("begin"))).alias("k")
    ).select(
        "core", "n", "print", (F.col("begin") + F.col("k")).alias("start"),
        (F.octet_length("head") - F.col("k")).alias("before"),
        F.expr(f"concat(substring(head, k + 1, {BLOCK}), substring(tail, 1, {BLOCK} - 1 - octet_length(head) + k))").alias("rim"),
    )
    key = ["core", "before", "rim"]
    twice = window.groupBy(*key).agg(F.sum("n").alias("total")).where("total > 1").select(*key)
    return window.where("n = 1").join(twice, key, "left_semi").select("print", "start", (F.col("start") + span).alias("stop"))


def repeated_spans(docs: DataFrame, text: str = "text", span: int = SPAN) -> DataFrame:
    """(print, spans) of the texts with repeated strings; spans are in bytes.

    ``span`` must leave room for an anchor and a block: ``GRAM`` + ``BLOCK`` bytes or more.
    """
    if span < GRAM + BLOCK:
        raise ValueError(f"a span has {GRAM + BLOCK} bytes or more, not {span}")
    rows = docs.select(F.col(text).alias("text")).where(F.octet_length("text") >= span)
    found = stored(anchor_prints(rows, "text", span).groupBy("print", "anchor").agg(F.sum("n").alias("n")))
    twice = found.groupBy("anchor").agg(F.sum("n").alias("total")).where("total > 1").select("anchor")
    kept = found.join(twice, "anchor").groupBy("print").agg(F.collect_list("anchor").alias("kept"))
    distinct = rows.groupBy(print_of(F.col("text")).alias("print")).agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    held = stored(distinct.join(kept, "print"))

    blocks = stored(block_rows(held, span))
    source = F.struct("print", "begin", "end", "place")
    contexts = stored(blocks.groupBy("core", "context").agg(F.sum("weight").alias("n"), F.min(source).alias("source")))
    cores = contexts.groupBy("core").agg(F.count("*").alias("several")).where("several > 1")
    whole = (
        blocks.join(contexts.where("n > 1").select("core", "context"), ["core", "context"], "left_semi")
        .select("print", F.col("begin").alias("start"), (F.col("end") + span).alias("stop"))
    )
    unsure = contexts.join(cores, "core").select("core", "several", "n", "source.*")
    unsure = stored(
        context_bytes(held, unsure.drop("several"), span).join(small(stored(cores.where(F.col("several") > LONG))), "core", "left")
    )
    few = by_suffix_arrays(unsure.where("several IS NULL"), span)
    many = by_counting(unsure.where("several IS NOT NULL"), span)
    spans = whole.unionByName(few).unionByName(many)
    return spans.groupBy("print").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Spans sorted and joined where they touch or overlap."""
    found: list[tuple[int, int]] = []
    for start, stop in sorted((s["start"], s["stop"]) for s in spans or []):
        if found and start <= found[-1][1]:
            found[-1] = (found[-1][0], max(stop, found[-1][1]))
        else:
            found.append((start, stop))
    return found


def without_repeats(docs: DataFrame, text: str = "text", span: int = SPAN, as_text: bool = False) -> DataFrame:
    """``docs`` with n_bytes, removed_spans and kept_bytes (binary), columns of these names replaced.

    With ``as_text`` kept_text takes the place of kept_bytes, without the pieces of characters that were
    cut through.
    A null text is an empty one. Every copy of a repeated string goes, the first included; repeated
    rows count as copies of each other. Texts shorter than ``span`` stay whole.
    """
    new = ["n_bytes", "removed_spans", "kept_text" if as_text else "kept_bytes"]
    rest = docs.drop(*new)
    spans = stored(repeated_spans(rest, text, span))
    marked = rest.withColumn("_print", print_of(F.col(text)))
    spans = spans.select(F.col("print").alias("_print"), F.col("spans").alias("_spans"))
    joined = marked.join(spans, "_print", "left").drop("_print")
    where, at = joined.columns.index(text), joined.columns.index("_spans")
    names = [*(c for c in joined.columns if c != "_spans"), *new]
    pair = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))
    added = [T.StructField(n, t) for n, t in zip(new, (T.LongType(), pair, T.StringType() if as_text else T.BinaryType()), strict=True)]
    schema = T.StructType([*(f for f in joined.schema.fields if f.name != "_spans"), *added])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = [_bytes(x) for x in part.column(where).to_pylist()]
            cuts = [merged(s) for s in part.column(at).to_pylist()]
            rests = []
            for data, cut in zip(texts, cuts, strict=True):
                edges = [0, *(x for pair in cut for x in pair), len(data)]
                rests.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            listed = [[{"start": a, "stop": b} for a, b in cut] for cut in cuts]
            old = [c for k, c in enumerate(part.columns) if k != at]
            left = pa.array([x.decode("utf-8", "ignore") for x in rests], pa.string()) if as_text else pa.array(rests, pa.binary())
            new_columns = [pa.array(map(len, texts), pa.int64()), pa.array(listed, kind), left]
            yield pa.RecordBatch.from_arrays([*old, *new_columns], names=names)

    return map_batches(joined, batches, schema)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to repeated strings, and a digest of what it keeps."""
    found = without_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    removed = F.aggregate("removed_spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed_spans").cast("long").alias("n_spans"),
        F.sha2("kept_bytes", 256).alias("kept_sha256"),
    )
