"""Near-duplicate documents by bottom-k sketches.

One hash function orders the shingles of all texts, and a text's sketch is its ``K`` smallest hashes.
Texts with the same shingles are one class from the start. Classes meet in the inverted lists of the
values they retain; overlaps of sketches and the union sketch filter them, and every link is confirmed
on full shingle sets.

A list of more than ``LONG`` classes never gives all pairs. What a long list could link is found
exactly in another way:

* Two linked classes share ``needed`` retained values or more, but for a chance below 1e-7. A class
  with fewer values in long lists than that shares a value of a short list with each partner.
* Classes with as many or more (dense ones) are compared on full sets, unless all their lists lie
  inside one component by then. In any order that holds for all of them, partners share one of
  the first 15 % of their shingles (100 - ``percent``); the order is by rising frequency, so shingles that
  no other dense class has leave most of them without candidates.

``percent`` is the similarity from which texts are linked; all bounds follow from it.

Pairs inside a component are not looked for: every list first links its members to one hub, and only
members of different components are compared after that.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rentgrain.llm.anchors import BASE, POWERS, mixed
from rentgrain.llm.components import components
from rentgrain.llm.frames import documents, map_batches, small, stored

#: ``op2_neardup`` links at a Jaccard similarity of ``PERCENT`` / 100 on shingles of ``WORDS`` words.
PERCENT, WORDS = 85, 5
#: Values in a sketch, chance of missing a link that its bounds may have, and classes in a list from which it is long.
K, MISSED, LONG = 32, 1e-9, 50
#: Parts by hash in which shingles of dense classes are counted, to bound what two of them share.
PARTS = 32
#: Hash buckets whose frequencies order the shingles of dense classes.
BUCKETS = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes hashed at a time.
PIECE = 1 << 20


def _pieces(data: bytes) -> Iterator[np.ndarray]:
    """Parts of at most ``PIECE`` bytes, cut between words; a longer word stays whole."""
    whole, start = np.frombuffer(data, dtype=np.uint8), 0
    while start < len(whole):
        end = start + PIECE
        if end < len(whole):
            before = np.flatnonzero(_SPACE[whole[start:end]])
            after = np.flatnonzero(_SPACE[whole[end:]]) if not len(before) else before
            end = start + int(before[-1]) if len(before) and before[-1] else end + int(after[0]) if len(after) else len(whole)
        yield whole[start:end]
        start = end


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of a text's words, A-Z taken as a-z."""
    found = []
    for piece in _pieces(text.encode("utf-8", "replace")):
        space = _SPACE[piece]
        edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        up, down = POWERS.get(len(piece) + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum((_LOWER[piece].astype(np.uint64) + np.uint64(1)) * up[: len(piece)])])
        found.append(mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)))
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """The set of a text's shingles as sorted 63-bit hashes; fewer words than a shingle are one."""
    words = word_hashes(text) if text else np.zeros(0, dtype=np.uint64)
    if len(words) == 0:
        return np.zeros(0, dtype=np.int64)
    size = min(WORDS, len(words))
    hashes = np.full(len(words) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        hashes = mixed(hashes * BASE + words[k : len(words) - size + 1 + k])
    return np.unique(hashes >> np.uint64(1)).astype(np.int64)


def sketches(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, n, print, sketch) of every row; a text without words has no print."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sets = [shingles(x) for x in part.column(1).to_pylist()]
            prints = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            columns = [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary())]
            kept = pa.array([s[:K] for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*columns, kept], names=["id", "n", "print", "sketch"])

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return map_batches(rows, batches, "id long, n long, print binary, sketch array<long>")


def full_sets(docs: DataFrame, ids: DataFrame, key: str, text: str) -> DataFrame:
    """(id, shingles) of the texts with the given ids; of rows with one id that with the least print counts."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sets = [shingles(x) for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "set"])

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).join(small(ids), "id", "left_semi")
    return map_batches(rows, batches, "id long, set array<long>")


def least_shared(percent: int) -> int:
    """Of the ``K`` values of a union sketch, those that linked sets share but for a chance of ``MISSED``.

    Each is shared with a chance of ``percent`` / 100 or more. Drawn without replacement, fewer are rarer still.
    """
    x, below = percent / 100, 0.0
    for shared in range(K + 1):
        below += comb(K, shared) * x**shared * (1 - x) ** (K - shared)
        if below >= MISSED:
            return shared
    return K


def needed(n: Column, percent: int) -> Column:
    """Retained values that a class of ``n`` shingles shares with each partner.

    A partner has up to n * 100 / ``percent`` shingles; while these fit a sketch, both sketches are whole.
    """
    return F.when(100 * n > percent * K, F.lit(least_shared(percent))).otherwise(F.ceil(n * percent / 100))


def similar(shared: Column, a: Column, b: Column, percent: int) -> Column:
    """Whether sets of ``a`` and ``b`` elements that share ``shared`` are linked."""
    return 100 * shared >= percent * (a + b - shared)


def plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes and union sketches allow a link; both sketches whole, the answer is exact."""
    side = lambda x: classes.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    union = F.slice(F.array_sort(F.array_union("s_a", "s_b")), 1, K)
    common = F.array_intersect("s_a", "s_b")
    met = F.size(F.array_intersect(union, common))
    exact = (F.col("n_a") <= K) & (F.col("n_b") <= K)
    return both.where(
        (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        & F.when(exact, similar(F.size(common), F.col("n_a"), F.col("n_b"), percent)).otherwise(met >= least_shared(percent))
    ).select("a", "b")


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that are links on their full sets."""
    side = lambda x: sets.select(F.col("id").alias(x), F.col("set").alias(f"set_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return both.where(similar(shared, F.size("set_a"), F.size("set_b"), percent)).select("a", "b")


def confirmed(docs: DataFrame, pairs: DataFrame, key: str, text: str, percent: int) -> DataFrame:
    """The pairs that are links, with the full sets of their texts made for it."""
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    return linked(pairs, stored(full_sets(docs, ids, key, text)), percent)


def _ordered(a: str | Column, b: str | Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _to_hubs(members: DataFrame, rank: Column) -> DataFrame:
    """Distinct pairs of each member of a list (value, id) with the list's highest-ranked member."""
    hubs = members.groupBy("value").agg(F.max(F.struct(rank.alias("rank"), -F.col("id"))).alias("hub"))
    hubs = hubs.select("value", (-F.col("hub")["col2"]).alias("hub"))
    return members.join(hubs, "value").where("id <> hub").select(*_ordered("id", "hub")).distinct()


def _frequencies(sets: DataFrame) -> Broadcast:
    """How often shingles of each hash bucket occur in ``sets``; ``BUCKETS`` counts, whatever the input."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, dtype=np.int64)
        for part in parts:
            values = part.column("set").flatten().to_numpy(zero_copy_only=False)
            counts += np.bincount(values & (BUCKETS - 1), minlength=BUCKETS)
        at = np.flatnonzero(counts)
        for k in range(0, len(at), 1 << 16):
            some = at[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["bucket", "n"])

    found = map_batches(sets.select("set"), batches, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(BUCKETS, dtype=np.int64)
    counts[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return sets.sparkSession.sparkContext.broadcast(np.minimum(counts, (1 << 31) - 1).astype(np.int32))


def _dense_lists(sets: DataFrame, percent: int) -> DataFrame:
    """Lists (value, id, n, alone, place, parts) of the rarest shingles of dense classes.

    Shingles are in one order for all classes, by the frequency of their hash bucket and then by hash. Of two
    partners' first 100 - ``percent`` % (and one) in that order one is shared, whatever the order; rare ones
    first makes the lists short. A bucket met once holds a shingle that no other class has: ``alone`` counts
    these, and they are in no list. ``place`` is how many shingles come before; ``parts`` counts the
    shingles that others may have, by hash in ``PARTS`` parts.
    """
    frequencies = _frequencies(sets)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows: list[tuple] = []
            for name, values in zip(part.column("id").to_pylist(), part.column("set"), strict=True):
                shingle = values.values.to_numpy(zero_copy_only=False)
                often = frequencies.value[shingle & (BUCKETS - 1)]
                order, n = np.lexsort((shingle, often)), len(shingle)
                alone = int((often == 1).sum())
                shares = np.bincount(shingle[often > 1] % PARTS, minlength=PARTS).tolist()
                for place in range(alone, n - -(-n * percent // 100) + 1):
                    rows.append((int(shingle[order[place]]), name, n, alone, place, shares))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(),) * 5 + (pa.list_(pa.int64()),)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["value", "id", "n", "alone", "place", "parts"]
            )

    return map_batches(sets, batches, "value long, id long, n long, alone long, place long, parts array<long>")


def _cell(n: Column) -> Column:
    """Number of the cell of sizes that ``n`` lies in, rising with it: single sizes below 128, then 64 cells to a doubling."""
    digits = F.length(F.bin(n))
    wide = F.greatest(digits - 7, F.lit(0))
    return wide * 64 + F.call_function("shiftright", n, wide).cast("int")


def _met(lists: DataFrame, percent: int) -> DataFrame:
    """Members x and y of lists (value, id, root, n, place) that meet by size and place, x as the larger.

    At the first shingle in rising order that partners share, they share no more than what is left of either. So
    a member of n shingles has partners of at most ``most`` shingles there; a smaller one takes part only if its
    own n is within that. Members meet by list, cell of the smaller size and cell of the larger: in a list of many
    members only those whose sizes and places admit each other, not all pairs.
    """
    left = F.col("n") - F.col("place")
    reach = lists.select("value", "id", "root", "n", (F.floor((100 + percent) * left / percent) - F.col("n")).alias("most"))
    least, upto = F.ceil(F.col("n") * percent / 100), F.least("n", "most")
    larger = reach.where(upto >= least).select(
        "value", F.explode(F.sequence(_cell(least), _cell(upto))).alias("small"), _cell(F.col("n")).alias("large"),
        *(F.col(c).alias(f"{c}_x") for c in ("id", "root", "n", "most")),
    )
    smaller = reach.where("most >= n").select(
        "value", _cell(F.col("n")).alias("small"), F.explode(F.sequence(_cell(F.col("n")), _cell(F.col("most")))).alias("large"),
        *(F.col(c).alias(f"{c}_y") for c in ("id", "root", "n", "most")),
    )
    return larger.join(smaller, ["value", "small", "large"])


def _within_reach(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs (id_x, n_x, id_y, n_y) in lists (value, id, root, n, place) that differ in root and may be linked by their places."""
    admitted = _met(lists, percent).where("n_y <= n_x AND n_y <= most_x AND n_x <= most_y AND root_x <> root_y")
    return admitted.select("id_x", "n_x", "id_y", "n_y").distinct()


def links(docs: DataFrame, classes: DataFrame, key: str, text: str, percent: int) -> DataFrame:
    """Components (node, root) of the classes (id, n, sketch) that have a partner."""
    held = classes.select("id", "n", F.explode("sketch").alias("value"))
    lists = held.groupBy("value").agg(F.count("*").alias("size")).where("size > 1")
    members = stored(held.join(lists, "value"))
    known = members.groupBy("id").agg(F.sum("size").alias("known"))
    members = stored(members.join(known, "id"))
    hubs = plausible(_to_hubs(members, F.col("known")), classes, percent)
    near = stored(confirmed(docs, hubs.distinct(), key, text, percent))
    found = components(near).withColumnRenamed("node", "id")
    members = stored(members.join(found, "id", "left").withColumn("root", F.coalesce("root", "id")))
    # Lists that lie inside one component have nothing left to find.
    open_ = members.groupBy("value").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most")
    members = stored(members.join(open_.select("value"), "value", "left_semi").drop("root", "known"))
    standing = stored(
        members.groupBy("id", "n").agg(F.count_if(F.col("size") > LONG).alias("hot"))
        .withColumn("dense", F.col("hot") >= needed(F.col("n"), percent))
    )
    members = stored(members.where(F.col("size") <= LONG).join(standing.drop("n"), "id"))
    dense = stored(full_sets(docs, stored(standing.where("dense").select("id")), key, text))
    rare = stored(_dense_lists(dense, percent))
    rare_hubs = plausible(_to_hubs(rare, -F.col("alone") / F.col("n")), classes, percent)
    first = stored(near.unionByName(confirmed(docs, stored(rare_hubs.distinct()), key, text, percent)))
    roots = components(first)

    def rooted(frame: DataFrame) -> DataFrame:
        found = frame.join(roots.withColumnRenamed("node", "id"), "id", "left")
        return found.withColumn("root", F.coalesce("root", "id"))

    def crossed(frame: DataFrame, *more: str) -> DataFrame:
        """Pairs in a list whose components differ."""
        side = lambda x: frame.select("value", *(F.col(c).alias(f"{c}_{x}") for c in ("id", "root", *more)))
        return side("x").join(side("y"), "value").where("id_x < id_y AND root_x <> root_y")

    short = (
        crossed(rooted(members), "n", "hot")
        .groupBy("id_x", "id_y", "n_x", "n_y", "hot_x", "hot_y").agg(F.count("*").alias("met"))
        .where(F.col("met") + F.least("hot_x", "hot_y") >= needed(F.greatest("n_x", "n_y"), percent))
        .select(F.col("id_x").alias("a"), F.col("id_y").alias("b"))
    )
    mixed = rooted(rare)
    several = mixed.groupBy("value").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most")
    mixed = stored(mixed.join(several.select("value"), "value", "left_semi"))
    # Partners share no more of each part than the smaller count.
    parts = F.aggregate(F.zip_with("parts_x", "parts_y", lambda x, y: F.least(x, y)), F.lit(0).cast("long"), lambda s, x: s + x)
    counted = mixed.select("id", "n", "parts").distinct()
    side = lambda x: counted.select(*(F.col(c).alias(f"{c}_{x}") for c in counted.columns))
    long = _within_reach(mixed, percent).join(side("x"), ["id_x", "n_x"]).join(side("y"), ["id_y", "n_y"])
    long = long.where(similar(parts, F.col("n_x"), F.col("n_y"), percent)).select(*_ordered("id_x", "id_y")).distinct()
    rest = stored(plausible(short.unionByName(long).distinct(), classes, percent))
    second = confirmed(docs, rest, key, text, percent)
    return components(first.unionByName(second))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row of ``docs``, linked at a similarity of ``percent`` / 100.

    Null and empty texts and those without words have no shingles and are linked with nothing. Rows
    with one id and different texts count as linked; rows without an id are linked through copies of
    their text only and kept if no copy has an id. Repeated rows give repeated results.
    """
    rows = stored(sketches(docs, key, text))
    worded = rows.where("print IS NOT NULL")
    grouped = stored(
        worded.groupBy("print").agg(F.min("id").alias("id"), F.max("id").alias("last"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    )
    classes = grouped.where("id IS NOT NULL").drop("print", "last")
    roots = links(docs, classes, key, text, percent)
    moved = grouped.join(roots.withColumnRenamed("node", "id"), "id", "left").select(
        "print", F.coalesce("root", "id").alias("component_id"), "id", "last"
    )
    moved = stored(moved.where("component_id <> id OR id <> last").select("print", "component_id"))
    found = rows.join(small(moved), "print", "left")
    root = F.coalesce("component_id", "id")
    return found.select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), root.alias("component_id"), F.col("id").eqNullSafe(root).alias("kept")
    )


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document and whether it stays."""
    return near_duplicates(documents(spark, sf_dir).select("doc_id", "text"), percent=PERCENT)
