"""Token alignment, collocations and exact search against brute force, with odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rentgrain.llm import alignment, collocations, impactsearch
from rentgrain.llm.bpe import byte_letters

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def prose(seed: int, count: int, words: int = 60) -> str:
    r = random.Random(seed)
    return " ".join(f"{r.choice('abcde')}w{r.randrange(words)}{r.choice(['', '', '.', ',', '!'])}" for _ in range(count))


ODD = [
    (0, prose(1, 300), "en", "a", 1), (1, prose(1, 300), "en", "a", 1), (1, prose(1, 300), "en", "a", 1),
    (2, None, "en", None, None), (3, "", "en", "b", 0), (4, " ", None, "b", 1), (None, "a\tb  c \n d", None, "b", 9),
    (5, "x ▁ y", "de", "c", 1), (6, "ÀÉ ž漢字 😀 ſK \x1c\x85\xa0 　<|endoftext|> <s> it's;\r\n ok", "fr", "c", 1),
    (7, "\n\n  lead  and trail  ", "fr", "c", 1), (8, prose(2, 30_000, 900), "de", "c", 1), (9, "z" * 5_000, "de", "c", 1),
    (10, "The Cat. the cat; THE CAT! " * 20 + "the, cat", "en", "c", 1), (11, "a b a b a b a b " * 12, "fr", "c", 1),
    (12, "e\x01f e g " * 40, None, "c", 1), (13, "e e e e e e " * 8, None, "c", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    extra = [F.lit(1).alias("chunk"), F.lit("x").alias("pair"), F.lit(2).alias("n"), F.lit(0).alias("phrase"), F.lit(7).alias("key")]
    return spark.createDataFrame(ODD, SCHEMA).select("*", *extra).cache()


def aligned_by_hand(texts: list[str | None]) -> list[tuple]:
    library, letters = Tokenizer.from_file(A), byte_letters()
    library.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    a_bytes = {i: bytes(letters[c] for c in t) for t, i in library.get_vocab().items() if t != "<|endoftext|>"}
    found, counts = [], Counter()
    for text in texts:
        first = library.encode(" " + text, add_special_tokens=False).ids if text else []
        second = model.encode(text) if text else []
        spell = lambda i: bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
        a_parts, b_parts = [a_bytes[i] for i in first], [spell(i) for i in second]
        if not text or b"".join(a_parts) != (" " + text).encode() or b"".join(b_parts) != (" " + text).encode():
            found.append(None)
            continue
        ends = [np.cumsum([len(p) for p in parts]).tolist() for parts in (a_parts, b_parts)]
        borders, links, groups = sorted(set(ends[0]) & set(ends[1])), [], []
        spans = [[(e - len(p), e, i) for p, e, i in zip(ps, es, ids)] for ps, es, ids in zip((a_parts, b_parts), ends, (first, second))]
        start = 0
        for border in borders:
            in_a, in_b = ([s for s in x if start < s[1] <= border] for x in spans)
            groups.append(",".join(str(s[2]) for s in in_a) + "|" + ",".join(str(s[2]) for s in in_b))
            links += [(x[2], y[2]) for x in in_a for y in in_b if max(x[0], y[0]) < min(x[1], y[1])]
            start = border
        assert start == len((" " + text).encode())
        found.append((len(first), len(second), len(groups), links, ";".join(groups)))
        counts.update(links)
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    rows = []
    for x in found:
        if x is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
        else:
            links = x[3]
            rows.append((*x[:3], len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(x[4].encode()).hexdigest()))
    return rows


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_equals_brute_force(spark, odd, monkeypatch):
    short = odd.where(F.coalesce(F.length("text"), F.lit(0)) < 20_000)
    rows = [r for r in ODD if len(r[1] or "") < 20_000]
    expected = Counter(zip([r[0] for r in rows], aligned_by_hand([r[1] for r in rows])))
    for partitions in (1, 5):
        found, pairs = alignment.alignment(short.repartition(partitions), A, B)
        assert Counter((r["doc_id"], tuple(r[c] for c in COLUMNS)) for r in found.collect()) == expected
    assert pairs.where("n_docs > n_links OR n_docs < 1").count() == 0
    assert pairs.groupBy("b").agg(F.max("best").alias("x")).where("NOT x").count() == 0


def test_alignment_of_very_long_texts_and_empty_tables(spark, odd):
    long = alignment.alignment(odd.where("doc_id = 8"), A, B)[0].collect()[0]
    text = next(r[1] for r in ODD if r[0] == 8)
    library = Tokenizer.from_file(A)
    assert long["n_a"] == len(library.encode(" " + text, add_special_tokens=False).ids)
    assert long["n_links"] == long["n_a"] + long["n_b"] - long["n_groups"] > 30_000
    assert alignment.alignment(odd.limit(0), A, B)[0].count() == 0


def test_alignment_pieces_equal_whole_texts():
    own = alignment.Pieces(A, B)
    model, library = sentencepiece.SentencePieceProcessor(model_file=B), Tokenizer.from_file(A)
    library.encode_special_tokens = True
    r = random.Random(3)
    parts = list("ab é\n\t\x1c 'sT12?<|>😀漢;\r") + ["<|endoftext|>", "'ll", "   ", " ", " the", "aaaa", "<s>", " \n", "\xa0"]
    for _ in range(400):
        text = "".join(r.choice(parts) for _ in range(r.randrange(1, 40)))
        pieces = own.split(text)
        assert "".join(pieces) == " " + text
        first, second = ([i for ids in x for i in ids] for x in zip(*own.encoded(pieces), strict=True))
        assert second == model.encode(text), repr(text)
        assert first == library.encode(" " + text, add_special_tokens=False).ids, repr(text)


def test_containers_hold_every_link():
    r = np.random.default_rng(1)
    slots = np.concatenate([np.arange(9_000), r.integers(0, 65_536, 20_000)])
    codes = np.concatenate([np.full(9_000, 5), r.integers(0, 40, 20_000)])
    expected = Counter(zip(codes.tolist(), slots.tolist()))
    found: Counter = Counter()
    for plane, pairs, counts, bits in alignment.containers(codes, slots):
        docs, at = alignment.members(counts, bits.to_pylist())
        for d, k in zip(docs.tolist(), at.tolist()):
            found[int(pairs[k]), d] += 1 if plane == 0 else 1 << (plane - 1)
    assert found == expected


def phrases_by_hand(rows, least: int, top: int):
    f, total = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for k in range(1, 5):
                f.update((lang or "und", tuple(words[i:i + k])) for i in range(len(words) - k + 1))
    frequent = {p: n for p, n in f.items() if len(p[1]) > 1 and n >= least}
    dropped = set()
    for (lang, p), n in frequent.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                inner = (lang, p[i:i + k])
                if 100 * n >= 80 * frequent[inner]:
                    dropped.add(inner)
    found = defaultdict(list)
    for (lang, p), a in frequent.items():
        if (lang, p) not in dropped:
            cuts = [(2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {
        (lang, rank, p.decode(), -a, left, right, total[lang], -score)
        for lang, x in found.items() for rank, (score, a, p, left, right) in enumerate(sorted(x)[:top], 1)
    }


@pytest.mark.parametrize(("least", "top", "sample"), [(30, 2000, 8), (2, 40, 1), (2, 10**6, 3)])
def test_collocations_equal_brute_force(spark, odd, monkeypatch, least, top, sample):
    monkeypatch.setattr(collocations, "SAMPLE", sample)  # splits that fall among extensions of one phrase
    found = collocations.collocations(odd.drop("n").withColumn("words", F.lit(1)), least=least, top=top).collect()
    assert {tuple(r) for r in found} == phrases_by_hand(ODD, least, top)
    assert len(found) == len(set(found))


def test_collocations_with_a_full_filter_and_without_rows(spark, odd, monkeypatch):
    monkeypatch.setattr(collocations, "MOST_BITS", 1 << 10)
    found = collocations.collocations(odd, least=3, top=100).collect()
    assert {tuple(r) for r in found} == phrases_by_hand(ODD, 3, 100)
    assert collocations.collocations(odd.limit(0)).count() == 0
    assert collocations.collocations(odd.where("text IS NULL")).count() == 0


def best_by_hand(rows, k: int):
    least: dict = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole = tuple(math.floor(256 * x) for x in v)
            least[i] = min(least.get(i, whole), whole)
    whole = sorted(least.items())
    found = set()
    for i, v in whole:
        if i % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in whole if j != i and len(w) == len(v))
            found |= {(i, n, j, -s) for n, (s, j) in enumerate(scores[:k], 1)}
    return found


def vectors(seed: int, count: int, width: int):
    r = np.random.default_rng(seed)
    rows = r.normal(0, 0.15, (count, width))
    rows[count // 2 :: 3] = rows[0]  # a third of the rows share one vector
    rows[5::7] = rows[5] + r.normal(0, 0.01, rows[5::7].shape)
    return [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]


SPECIAL = [
    (100_000, None), (100_050, [1.0, None]), (100_100, [float("nan")] * 8), (100_150, [float("inf")] * 8), (100_200, []),
    (100_250, [1.0, 2.0]), (100_300, [-1.0, 0.5]), (None, [0.1] * 8), (100_350, [0.0] * 8), (0, [0.0] * 8),
]


@pytest.mark.parametrize("block", [1 << 20, 400])
def test_exact_search_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(impactsearch, "BLOCK", block)
    monkeypatch.setattr(impactsearch, "QUERIES", block)
    monkeypatch.setattr(impactsearch, "FEW", 4)
    rows = vectors(1, 700, 8) + SPECIAL
    table = spark.createDataFrame([(*r, 1, 2, 3) for r in rows + rows[:60]], "vec_id long, embedding array<float>, block int, ids int, score int")
    exact = [(i, v and [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    found = impactsearch.nearest(table, F.col("vec_id") % 50 == 0).collect()
    assert sorted(tuple(r) for r in found) == sorted(best_by_hand(exact, 5))
    assert impactsearch.nearest(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_index_proves_before_the_end_and_misses_nothing():
    r = np.random.default_rng(2)
    block = r.integers(-90, 90, (3_000, 64))
    block[17:40] = block[16]
    index = impactsearch.BlockIndex(block)
    for k in range(0, 300, 10):
        left, score = index.members(block[k], 6)
        assert len(left) < 1_500 and (score == block[left] @ block[k]).all()
        exact = block @ block[k]
        assert set(np.flatnonzero(exact >= np.sort(exact)[-6])) <= set(left.tolist())
    huge = impactsearch.BlockIndex(np.array([[1 << 62, 1 << 62], [-(1 << 62), 5], [1, 1]]))
    _, score = huge.members(np.array([1 << 40, 1]), 2)
    assert score.tolist() == [(1 << 63) - 1, -(1 << 63), (1 << 40) + 1]


def test_zero_components_of_a_query_do_not_lower_the_bounds(spark):
    r = np.random.default_rng(3)
    block, queries = -r.integers(0, 90, (2_000, 64)), r.integers(1, 90, (10, 64)) * (r.random((10, 64)) < 0.3)
    index = impactsearch.BlockIndex(block)
    for query in queries:
        left, score = index.members(query, 6)
        exact = block @ query
        assert set(np.flatnonzero(exact >= np.sort(exact)[-6])) <= set(left.tolist()) and (score == exact[left]).all()
    rows = [(i, [float(x) / 256 for x in v]) for i, v in enumerate([*queries.tolist(), *block.tolist()])]
    rows = [(50 * i if i < 10 else 50 * i + 1, v) for i, v in rows]
    found = impactsearch.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0)
    assert sorted(tuple(r) for r in found.collect()) == sorted(best_by_hand(rows, 5))


def test_the_least_number_is_large():
    least = impactsearch.BlockIndex(np.array([[-(1 << 63), 0], [1, 0]]))
    _, score = least.members(np.array([4, 0]), 2)
    assert score.tolist() == [-(1 << 63), 4]
