"""How the tokens of two tokenizers lie on each other, with counts from inverted pair bitmaps.

A text is cut where both tokenizers must have a border, in front of a space that follows another character.
Such pieces are encoded once and kept, with their groups and links; a text is the sequence of its pieces.

Documents are dealt into *chunks* as they are read. For every pair of linked ids a chunk holds a posting: a
compressed bitmap of its documents (``plane`` 0), and, where documents hold the pair more than once, planes
with the bits of the further links. A bitmap is a container as in roaring bitmaps, with the chunk as its
key, so containers of one pair are OR-merged by lying under one pair: documents are counted by the bits of
plane 0, links by the bits of all planes with their weights. The counts go back along the postings: each
posting gives its pair's count to the documents in its bitmap.

Chunks are bounded by documents and links, so no task holds a group that grows; a pair has one row per
chunk and plane however often it occurs.
"""

from __future__ import annotations

import gc
import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rentgrain.llm import bpe
from rentgrain.llm.frames import documents, map_batches, stored

#: Documents and links of a chunk; a chunk of one long text may have more links.
CHUNK_DOCS, CHUNK_LINKS = 1 << 16, 4_000_000
#: Pieces from which a worker ends its chunk and starts with none again.
KEPT_PIECES = 500_000
#: Documents from which a container is a bitmap of ``CHUNK_DOCS`` bits instead of a list of 16-bit numbers.
DENSE = 4096
#: Bits of a pair's code that hold the second id.
SECOND = 17
SPACE = "▁"

_CUT, _RUN = re.compile(r"(?<=\S)(?= )"), re.compile(r"\s ")


def aligned(first: list[int], first_sizes: list[int], second: list[int], second_sizes: list[int]) -> tuple[str, int, list[int]]:
    """Groups as text, their number, and the codes of the linked pairs of two tokenizations of the same bytes."""
    links, text, groups = [], [], 0
    left_ids, right_ids, ahead = "", "", 0
    rest_a, rest_b = iter(zip(first, first_sizes, strict=True)), iter(zip(second, second_sizes, strict=True))
    while True:
        # ``ahead`` is how far the first side's tokens reach beyond those of the second.
        if ahead <= 0:
            before = ahead
            a, size = next(rest_a, (None, 0))
            if a is None:
                return ";".join(text), groups, links
            ahead += size
            left_ids = f"{left_ids},{a}" if left_ids else str(a)
            if before:
                links.append(a << SECOND | b)
        if ahead > 0:
            b, size = next(rest_b)
            ahead -= size
            right_ids = f"{right_ids},{b}" if right_ids else str(b)
            links.append(a << SECOND | b)
        if ahead == 0:
            text.append(f"{left_ids}|{right_ids}")
            left_ids = right_ids = ""
            groups += 1


class Pieces:
    """Pieces of texts with their two encodings, numbered as they are met."""

    def __init__(self, first_path: str, second_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on every core
        self.first = Tokenizer.from_file(first_path)
        self.first.encode_special_tokens = True
        self.first.no_truncation()
        self.first.no_padding()
        letters = bpe.byte_letters()
        specials = {x.content for x in self.first.get_added_tokens_decoder().values()}
        spelled = {i: t.encode() if t in specials else bytes(map(letters.__getitem__, t)) for t, i in self.first.get_vocab().items()}
        self.first_bytes = [spelled.get(i, b"") for i in range(max(spelled) + 1)]
        self.other = sentencepiece.SentencePieceProcessor(model_file=second_path)
        names = [self.other.id_to_piece(i) for i in range(self.other.get_piece_size())]
        self.second_bytes = [
            bytes([int(n[3:-1], 16)]) if self.other.is_byte(i) else n.replace(SPACE, " ").encode() for i, n in enumerate(names)
        ]
        # Cutting is safe while no piece runs over the border between another character and a space.
        self.cuts = not any(re.search(f"[^{SPACE}]{SPACE}", n) for n in names)
        self.alone = self.other.piece_to_id(SPACE)
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.groups: list[str] = []
        self.sizes = array("q")  # n_a, n_b, n_groups, n_links of each piece; n_a = -1 where bytes differ
        self.links = array("q")
        self.starts = array("q", [0])

    def split(self, text: str) -> list[str]:
        """Pieces of a space and the text; each begins with a space."""
        if self.cuts and not _RUN.search(text) and text[0] != " ":
            return [" " + word for word in text.split(" ")]
        return _CUT.split(" " + text) if self.cuts else [" " + text]

    def encoded(self, pieces: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """Both encodings of each piece."""
        firsts = self.first.encode_batch_fast(pieces, add_special_tokens=False)
        # The library puts a space in front by itself, but not in front of nothing.
        seconds = self.other.encode([p[1:] for p in pieces], num_threads=1)
        for piece, first, second in zip(pieces, firsts, seconds, strict=True):
            yield first.ids, second if len(piece) > 1 else [self.alone]

    def learn(self, pieces: list[str]) -> None:
        """Number the pieces that are new."""
        new = [p for p in dict.fromkeys(pieces) if p not in self.numbers]
        of_first, of_second = self.first_bytes.__getitem__, self.second_bytes.__getitem__
        for piece, (first, second) in zip(new, self.encoded(new) if new else (), strict=True):
            data = piece.encode("utf-8", "replace")
            left, right = list(map(of_first, first)), list(map(of_second, second))
            if b"".join(left) == data == b"".join(right):
                groups, count, links = aligned(first, list(map(len, left)), second, list(map(len, right)))
                self.groups.append(groups)
                self.sizes.extend((len(first), len(second), count, len(links)))
                self.links.extend(links)
            else:
                self.groups.append("")
                self.sizes.extend((-1, 0, 0, 0))
            self.starts.append(len(self.links))
            self.numbers[piece] = len(self.groups) - 1


_PIECES: dict[tuple[str, str], Pieces] = {}


def pieces_of(first_path: str, second_path: str) -> Pieces:
    """The pieces that this Python process keeps for two tokenizers."""
    key = (first_path, second_path)
    if key not in _PIECES:
        _PIECES[key] = Pieces(*key)
    return _PIECES[key]


def containers(codes: np.ndarray, slots: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, pa.Array]]:
    """(plane, pairs, cardinalities, containers) of links given as pair codes and documents."""
    keys, times = np.unique(codes << 16 | slots, return_counts=True)
    further = times - 1
    for plane in range(1 + int(further.max(initial=0)).bit_length()):
        here = keys if plane == 0 else keys[(further >> (plane - 1)) & 1 == 1]
        if not len(here):
            continue
        pairs, start, counts = np.unique(here >> 16, return_index=True, return_counts=True)
        data = (here & 0xFFFF).astype("<u2")
        if counts.max() > DENSE:
            parts = np.split(data, start[1:])
            bits = [p.tobytes() if len(p) <= DENSE else np.packbits(np.bincount(p, minlength=CHUNK_DOCS) > 0).tobytes() for p in parts]
            yield plane, pairs, counts, pa.array(bits, pa.binary())
        else:
            offsets = np.append(start, len(here)) * 2
            buffers = [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data.tobytes())]
            yield plane, pairs, counts, pa.Array.from_buffers(pa.binary(), len(pairs), buffers)


def members(cardinality: np.ndarray, bits: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Documents in containers, and for each the place of its container."""
    parts = [
        np.frombuffer(b, dtype="<u2") if n <= DENSE else np.flatnonzero(np.unpackbits(np.frombuffer(b, dtype=np.uint8))).astype("<u2")
        for n, b in zip(cardinality.tolist(), bits, strict=True)
    ]
    return np.concatenate(parts), np.repeat(np.arange(len(parts)), cardinality)


_ROWS = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, chunk long, slot int, "
    "pair long, plane int, cardinality long, bits binary"
)


def chunked(docs: DataFrame, first_path: str, second_path: str, key: str, text: str) -> DataFrame:
    """Rows of documents (with their slot) and of postings (with their pair), chunk by chunk."""
    names = [x.split()[0] for x in _ROWS.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]

    def batch(size: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [columns.get(n, pa.nulls(size, t)) for n, t in zip(names, kinds, strict=True)], names=names
        )

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(first_path, second_path)
        gc.disable()  # millions of small objects without a cycle among them
        chunk = TaskContext.get().partitionId() << 32
        held: list[tuple[int, np.ndarray]] = []
        slot = links = 0

        def postings() -> Iterator[pa.RecordBatch]:
            owners = np.repeat(np.array([s for s, _ in held]), [len(n) for _, n in held])
            numbers = np.concatenate([n for _, n in held])
            starts, flat = np.frombuffer(pieces.starts, dtype=np.int64), np.frombuffer(pieces.links, dtype=np.int64)
            sizes = starts[numbers + 1] - starts[numbers]
            at = np.repeat(starts[numbers] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            codes, slots = flat[at], np.repeat(owners, sizes)
            for plane, pairs, counts, bits in containers(codes, slots):
                for a in range(0, len(pairs), 50_000):
                    some = slice(a, a + 50_000)
                    n = len(pairs[some])
                    yield batch(
                        n, chunk=pa.array(np.full(n, chunk)), pair=pa.array(pairs[some]),
                        plane=pa.array(np.full(n, plane, dtype=np.int32)), cardinality=pa.array(counts[some]),
                        bits=bits[a : a + 50_000],
                    )

        for part in parts:
            rows = []
            split = [pieces.split(x) if x else [] for x in part.column(1).to_pylist()]
            pieces.learn(list(chain.from_iterable(split)))
            for name, value in zip(part.column(0).to_pylist(), split, strict=True):
                if slot == CHUNK_DOCS or links >= CHUNK_LINKS:
                    if rows:
                        yield of_documents(rows)
                        rows = []
                    if held:
                        yield from postings()
                    held.clear()
                    slot, links, chunk = 0, 0, chunk + 1
                sizes = np.zeros((0, 4), dtype=np.int64)
                if value:
                    numbers = np.fromiter(map(pieces.numbers.__getitem__, value), dtype=np.int64, count=len(value))
                    sizes = np.frombuffer(pieces.sizes, dtype=np.int64).reshape(-1, 4)[numbers]
                if len(sizes) and sizes[:, 0].min() >= 0:
                    total = sizes.sum(axis=0).tolist()
                    groups = ";".join(map(pieces.groups.__getitem__, numbers.tolist()))
                    rows.append((name, *total, hashlib.sha256(groups.encode()).hexdigest(), chunk, slot))
                    held.append((slot, numbers))
                    links += total[3]
                else:
                    rows.append((name, 0, 0, 0, 0, "", chunk, slot))
                slot += 1
            if rows:
                yield of_documents(rows)
            if len(pieces.groups) > KEPT_PIECES:
                # The chunk ends here: its documents are held by numbers of pieces.
                if held:
                    yield from postings()
                held.clear()
                slot, links, chunk = 0, 0, chunk + 1
                pieces.clear()
        if held:
            yield from postings()
        gc.enable()

    def of_documents(rows: list[tuple]) -> pa.RecordBatch:
        arrays = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)]
        return batch(len(rows), **dict(zip(names, arrays, strict=False)))

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_batches(rows, batches, _ROWS)


def pair_counts(postings: DataFrame) -> DataFrame:
    """(pair, n_docs, n_links) from the containers of each pair: bits of plane 0, and of all planes with their weights."""
    weight = F.when(F.col("plane") == 0, F.lit(1)).otherwise(F.expr("shiftleft(1L, plane - 1)"))
    return postings.groupBy("pair").agg(
        F.sum(F.when(F.col("plane") == 0, F.col("cardinality")).otherwise(0)).alias("n_docs"),
        F.sum(weight * F.col("cardinality")).alias("n_links"),
    )


def alignment(
    docs: DataFrame, first_path: str, second_path: str, key: str = "doc_id", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """What every row's tokens link, and the pairs of ids with their counts.

    The first frame has (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row, the second
    (a, b, n_docs, n_links, best). ``first_path`` is a byte-level vocabulary file, ``second_path`` a piece model with byte
    fallback. A space is put before each text. Null and empty texts, and those whose tokens do not give back their bytes,
    have no tokens: zeros and an empty digest. Strings of special tokens are plain text. Repeated rows and rows with equal or no
    ids each have their own result and count each; very long texts are encoded piece by piece; an empty table gives no
    rows; other columns are ignored. Equally frequent partners of an id are all its best.
    """
    rows = stored(chunked(docs, first_path, second_path, key, text))
    own = rows.where("slot IS NOT NULL").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "chunk", "slot")
    postings = rows.where("pair IS NOT NULL").select("chunk", "pair", "plane", "cardinality", "bits")
    counted = stored(pair_counts(postings))
    second = F.col("pair").bitwiseAND(F.lit((1 << SECOND) - 1))
    counted = counted.withColumn("b", second)
    highest = counted.groupBy("b").agg(F.max("n_links").alias("highest"))
    pairs = stored(counted.join(highest, "b").select("pair", "b", "n_docs", "n_links", (F.col("n_links") == F.col("highest")).alias("best")))

    def given(table: pa.Table) -> pa.Table:
        plane, count = table.column("plane").to_numpy(), table.column("n_links").to_numpy()
        weight = np.where(plane == 0, 1, np.int64(1) << np.maximum(plane - 1, 0).astype(np.int64))
        best = weight * table.column("best").to_numpy().astype(np.int64)
        slots, at = members(table.column("cardinality").to_numpy(), table.column("bits").to_pylist())
        sums, bests = np.zeros(CHUNK_DOCS, dtype=np.int64), np.zeros(CHUNK_DOCS, dtype=np.int64)
        np.add.at(sums, slots, (weight * count)[at])
        np.add.at(bests, slots, best[at])
        found = np.unique(slots).astype(np.int32)
        chunk = pa.array(np.full(len(found), table.column("chunk")[0].as_py()))
        return pa.table({"chunk": chunk, "slot": found, "n_best": bests[found], "count_sum": sums[found]})

    scored = postings.join(pairs.select("pair", "n_links", "best"), "pair")
    sums = scored.groupBy("chunk").applyInArrow(given, "chunk long, slot int, n_best long, count_sum long")
    found = own.join(sums, ["chunk", "slot"], "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256",
    )
    return found, pairs.select(F.shiftright("pair", SECOND).alias("a"), "b", "n_docs", "n_links", "best")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of a byte-level vocabulary and of a piece model lie on each other in every document."""
    import public_tokenizers

    paths = [public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return alignment(documents(spark, sf_dir), *paths)[0]
