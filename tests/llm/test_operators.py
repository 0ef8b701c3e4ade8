"""Each operator on odd rows, and against brute force or a round trip."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from rentgrain.llm import backoff, bpe, decontaminate, language, neardup, quality, rules, suffixdedup, unigram, warc
from rentgrain.llm.lyndon import suffix_array
from rentgrain.llm.rules import ablation

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, count: int, words: int = 400) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(words)}{'.' if r.random() < 0.1 else ''}" for _ in range(count))


BASE = prose(1, 300)
NEAR = BASE.replace("w7", "W7").replace(" w1 ", " other ", 1)
ODD = [
    (0, BASE, "en", "a", 1), (1, NEAR, "en", "a", 1), (2, BASE, None, None, None), (2, BASE, None, None, None),
    (3, None, "en", "b", None), (4, "", "en", "b", 0), (5, " \t\n", None, "b", 3), (None, prose(2, 80), "de", "c", 1),
    (6, prose(3, 40_000, 9000), "de", "c", 1), (7, "x" * 30_000, "de", "c", 1), (8, "eins", "de", "c", 1),
    (9, "ÀÉ ž漢字 😀 ſK \x1c\x85 <|endoftext|> it's", "fr", "c", 1), (10, prose(4, 200) + BASE[:900], "fr", "c", 1),
    (11, "THE!! END!! " * 60, "en", "c", 1), (12, "a b c d e f g h i j k l m " * 4, "en", "c", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(frame):
    return [r.asDict() for r in frame.collect()]


def test_bpe_equals_the_library(spark, odd, empty):
    library = Tokenizer.from_file(bpe.default_vocabulary())
    extra = odd.withColumn("token_ids", F.lit("old")).withColumn("more", F.lit(1))
    found = rows_of(bpe.encode_decode(extra, bpe.default_vocabulary()))
    assert len(found) == len(ODD)
    for r in found:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["token_ids"] == ids and r["decoded_text"] == library.decode(ids, skip_special_tokens=False) and r["more"] == 1
    assert bpe.encode_decode(empty, bpe.default_vocabulary()).count() == 0


def test_bpe_random_texts():
    library, own = Tokenizer.from_file(bpe.default_vocabulary()), bpe.encoder(bpe.default_vocabulary())
    r = random.Random(5)
    pieces = list("ab é\n\t\x1c 'sT12?<|>😀漢") + ["<|endoftext|>", "'ll", "   ", "the", "aaaa"]
    for _ in range(500):
        text = "".join(r.choice(pieces) for _ in range(r.randrange(50)))
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids
        assert own.decode(own.encode(text)) == text


def best_split(scores, data):
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(data)
    for end in range(1, len(data) + 1):
        for start in range(max(0, end - 130), end):
            score = scores.get(data[start:end])
            if score is not None and best[start][0] + score > best[end][0] + 1e-12:
                best[end] = (best[start][0] + score, best[start][1] + 1)
    return best[-1]


def test_token_counts(odd, empty):
    path = bpe.default_vocabulary()
    scores = unigram.rank_scores(path)
    for r in rows_of(unigram.count_tokens(odd.where("length(text) < 5000 OR text IS NULL"), path)):
        parts = unigram.Trie(scores).pre_tokens.findall(r["text"] or "")
        assert r["n_pre_tokens"] == len(parts)
        assert r["forward_score"] == pytest.approx(sum(best_split(scores, p.encode())[0] for p in parts))
    shared = unigram.Trie(scores)
    for word in ("there", "thereby", "there"):
        shared.insert(word.encode())
    assert shared.computed == len("thereby")
    assert unigram.count_tokens(odd, path).count() == len(ODD) and unigram.count_tokens(empty, path).count() == 0


def test_rules(odd, empty):
    found = rows_of(rules.ledger(odd.withColumn("n_words", F.lit(-1))))
    assert len(found) == len(ODD)
    for r, (doc, text, *_) in zip(found, ODD, strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        grams = Counter(zip(words, words[1:], words[2:]))
        hit = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert r["doc_id"] == doc and r["n_words"] == len(words) and r["n_repeat_words"] == len(hit)
        assert r["word_chars"] == sum(map(len, words)) and r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text or ""))
    assert rules.ledger(empty).count() == 0
    table = rules.ledger(odd)
    policy = rules.POLICIES["v2"]
    total = rows_of(ablation(table, policy))[0]
    for name, bit in rules.BITS.items():
        assert total[f"{name}_kept_without"] == table.where(rules.passes(policy & ~bit)).count()
    assert rows_of(ablation(empty.select("doc_id", "text").transform(rules.ledger), policy))[0]["n_rows"] == 0


def test_warc_round_trip(spark, tmp_path):
    same = "<p>" + "é" * 80
    pages = [(5, "http://a", same), (3, None, same), (None, "u", same), (9, "b\r\nc", "short"), (10, "b", "short"), (11, "x", None)]
    pages += [(12, "x", ""), (3, None, same), (20, "y", prose(1, 60_000))]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("content", F.lit("clash"))
    archives = warc.write_archives(table)
    found = rows_of(warc.read_archives(archives))
    assert sorted((r["page_id"] is None, r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in found) == sorted(
        [(False, 5, "revisit", 3), (False, 3, "response", None), (False, 3, "response", None), (True, 0, "revisit", 3)]
        + [(False, k, "response", None) for k in (9, 10, 11, 12, 20)],
        key=lambda x: x[:3],
    )
    texts = {p: h or "" for p, _, h in pages}
    for r in found:
        body = texts[r["page_id"]].encode()
        assert r["payload_bytes"] == len(body) and r["payload_digest"] == hashlib.sha256(body).hexdigest()
        assert r["payload"] is None if r["record_type"] == "revisit" else bytes(r["payload"]) == body
    for k, row in enumerate(archives.collect()):
        (tmp_path / f"{k}.warc.zst").write_bytes(row["content"])
    assert warc.read_files(spark, str(tmp_path)).count() == len(pages)
    assert warc.read_archives(warc.write_archives(table.limit(0))).count() == 0


def test_warc_refuses_broken_archives():
    record = warc.page_record(1, "u", b"body" * 50, hashlib.sha256(b"body" * 50).hexdigest(), None, "d")
    whole = warc.make_archive([record, record])
    assert len(list(warc.read_archive(whole))) == 2
    broken = [b"", whole[:6], b"no" + whole, whole[:-3], whole[:-20] + b"\0" * 20]
    broken += [warc.make_archive([record.replace(b"Content-Length: ", b"Content-Length: 1", 1)]), warc.make_archive([b"WARC/0.9\r\n\r\n"])]
    broken += [warc.make_archive([record.replace(b"bodybody", b"badybody", 1)]), warc.make_archive([record.replace(b"WARC-Date: d\r\n", b"")])]
    for archive in broken:
        with pytest.raises(warc.BrokenArchive):
            list(warc.read_archive(archive))


def windows_hit(words, items):
    hit, found = set(), set()
    for name, item in items:
        span = min(10, len(item))
        for i in range(len(item) - span + 1) if span else ():
            for k in range(len(words) - span + 1):
                if words[k : k + span] == item[i : i + span]:
                    hit.update(range(k, k + span))
                    found.add(name)
    return hit, found


def test_decontamination_lowers_only_a_to_z(spark):
    # Lower-casing the whole text depends on what follows a capital sigma, and maps other letters to several.
    docs = spark.createDataFrame([(1, "xx ΟΔΟΣ.Α yy"), (2, "xx İx \u212a yy"), (3, "odos İX k")], "doc_id long, text string")
    items = spark.createDataFrame([("1", "ΟΔΟΣ"), ("2", "ΟΔΟΣ.Α"), ("3", "İX K"), ("4", "οδος"), ("5", "i̇x")], "item_id string, text string")
    found = {r["doc_id"]: (r["hit_items"], r["hit_positions"]) for r in rows_of(decontaminate.occurrences(docs, items))}
    assert found == {1: (["1", "2"], [1, 2]), 2: ([], []), 3: (["3"], [1, 2])}


def test_decontamination(spark, odd, empty):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    middle = " ".join(BASE.split()[40:62]).upper()
    bench = [(1, middle), (2, "eins"), (3, None), (4, "..."), (5, "a b c"), (6, "w3 w3"), (7, " ".join(prose(9, 30).split())), (1, "it's"), (8, "ÀÉ Ž漢字")]
    items = [(str(i), word.findall(lower(t))) for i, t in bench]
    table = spark.createDataFrame(bench, "item_id long, text string")
    docs = odd.withColumn("hit_items", F.lit(0)).withColumn("word", F.lit(1))
    found = rows_of(decontaminate.occurrences(docs, table))
    assert len(found) == len(ODD) and any(r["hit_items"] for r in found)
    for r in found:
        words = word.findall(lower(r["text"]))
        hit, names = windows_hit(words, items)
        assert r["n_words"] == len(words) and set(r["hit_positions"]) == hit and r["hit_items"] == sorted(names)
    assert decontaminate.occurrences(empty, table).count() == 0
    assert all(not r["hit_items"] for r in rows_of(decontaminate.occurrences(odd, table.limit(0))))


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red x blue"), (2, "red x y blue"), (3, "blue red")], "doc_id long, text string")
    items = decontaminate.items_of(spark.createDataFrame([(1, "red blue")], "item_id long, text string"))
    searched = decontaminate.probes(items, decontaminate.document_frequency(docs, items))
    index = decontaminate.postings(docs, searched)
    near = lambda slop: {r["key"] for r in decontaminate.proximity_matches(index, searched, slop).collect()}
    assert near(0) == set() and near(1) == {1} and near(2) == {1, 2, 3}


def shingle_sets(table):
    lower = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    for doc, text, *_ in table:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        yield doc, frozenset([tuple(w)] if 0 < len(w) < 5 else (tuple(w[k : k + 5]) for k in range(len(w) - 4)))


def brute_components(table):
    sets = dict(shingle_sets(table))
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            shared = len(sets[a] & sets[b])
            if a < b and shared and 100 * shared >= 85 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}, {d: len(s) for d, s in sets.items()}


def test_near_duplicates_of_many_kinds(spark, empty, monkeypatch):
    r = random.Random(4)
    table = []
    for group in range(6):
        base = prose(100 + group, r.choice([7, 30, 120])).split()
        for _ in range(r.choice([2, 20, 60])):
            words = list(base)
            for _ in range(r.randrange(6)):
                words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
            table.append((len(table), " ".join(words[: len(words) - r.randrange(4)])))
    passage = prose(77, 60)
    table += [(len(table) + k, prose(1000 + k, 60) + " " + passage) for k in range(40)]
    table += [(9001, "one two"), (9002, "One  two"), (9003, None), (9004, ""), (9005, "  ")]
    roots, sizes = brute_components(table)
    for limit in (50, 5):  # the second makes most lists long
        monkeypatch.setattr(neardup, "LONG", limit)
        found = rows_of(neardup.near_duplicates(spark.createDataFrame(table, "doc_id long, text string")))
        assert {x["doc_id"]: x["component_id"] for x in found} == roots
        assert {x["doc_id"]: x["n_shingles"] for x in found} == sizes
        assert all(x["kept"] == (x["doc_id"] == x["component_id"]) for x in found)
    assert neardup.near_duplicates(empty).count() == 0


def test_near_duplicates_odd_rows(odd):
    found = rows_of(neardup.near_duplicates(odd.withColumn("print", F.lit(1)).withColumn("id", F.lit(2))))
    roots = defaultdict(set)
    for x in found:
        roots[x["doc_id"]].add(x["component_id"])
    assert len(found) == len(ODD) and roots[2] == {0} and roots[1] == {0} and roots[3] == {3} and roots[None] == {None}


def test_suffix_array():
    r = random.Random(2)
    for k in range(2000):
        text = [r.randrange(1, r.randrange(2, 6)) for _ in range(r.randrange(30))]
        text = (text[:4] * 9)[: len(text)] if k % 4 == 0 else text
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


@pytest.mark.parametrize("long", [64, 1])
def test_suffix_dedup(spark, odd, empty, monkeypatch, long):
    monkeypatch.setattr(suffixdedup, "LONG", long)
    passage, r = prose(50, 130), random.Random(8)
    table = [(100 + k, prose(500 + k, 90) + passage[k : 420 + 2 * k] + prose(600 + k, 50)) for k in range(12)]
    table += [(200, "é" * 600), (201, "ab" * 500), (202, passage[:399]), (203, BASE[5:404] + "q"), (204, BASE[:400]), (205, passage + "é" + passage)]
    table += [(300 + k, prose(700, 200)[: r.randrange(380, 460)]) for k in range(6)]
    docs = odd.where("length(text) < 40000 OR text IS NULL").select("doc_id", "text").unionByName(spark.createDataFrame(table, "doc_id long, text string"))
    counts = Counter()
    texts = [(x["text"] or "").encode() for x in docs.collect()]
    for data in texts:
        counts.update(data[k : k + 400] for k in range(len(data) - 399))
    found = rows_of(suffixdedup.without_repeats(docs.withColumn("spans", F.lit(1)).withColumn("n_bytes", F.lit(2))))
    assert len(found) == len(texts) and len({x["spans"] for x in found}) == 1
    for x in found:
        data = (x["text"] or "").encode()
        keep = bytearray(b"\1" * len(data))
        for k in range(len(data) - 399):
            if counts[data[k : k + 400]] > 1:
                keep[k : k + 400] = bytes(400)
        assert bytes(x["kept_bytes"]) == bytes(b for b, k in zip(data, keep, strict=True) if k) and x["n_bytes"] == len(data)
        runs = re.findall(b"\0+", bytes(keep))
        assert [s["stop"] - s["start"] for s in x["removed_spans"]] == [len(x) for x in runs]
    assert suffixdedup.without_repeats(empty).count() == 0


def test_language(spark, odd, empty):
    voices = {"xx": "the of and ing tion", "yy": "der und ich ein sch", "zz": "que los ado ción ñ"}
    r = random.Random(1)
    make = lambda lang, n: " ".join("".join(r.choices(voices[lang].split(), k=2)) for _ in range(n))
    table = [(k, make(x, 30), x) for k, x in enumerate(list(voices) * 60)]
    model = language.learn(spark.createDataFrame(table, "doc_id long, text string, lang string"))
    tests = [(k, make(x, 12), x) for k, x in enumerate(list(voices) * 20)]
    found = rows_of(language.identify(spark.createDataFrame(tests, "doc_id long, text string, lang string"), model))
    assert sum(x["lang_pred"] == x["lang"] for x in found) >= 0.95 * len(found)
    assert all(0 <= x["score"] <= 1 for x in found)
    strange = rows_of(language.identify(odd.withColumn("score", F.lit("x")), model))
    assert len(strange) == len(ODD) and {x["lang_pred"] for x in strange if x["doc_id"] in (3, 4, 5)} == {"und"}
    assert language.identify(empty, model).count() == 0
    none = language.learn(empty)
    assert {x["lang_pred"] for x in rows_of(language.identify(odd, none))} == {"und"}
    many = language.codewords(30)
    assert len({tuple(x) for x in many}) == 30 and set(map(abs, many.ravel())) == {1}


def test_quality(spark, odd, empty):
    good = [(k, prose(k, 80).capitalize() + ".") for k in range(150)]
    junk = [(1000 + k, prose(k, 60).upper().replace(" ", "!! ")) for k in range(25)]
    junk += [(2000 + k, prose(k, 60).replace(" ", "*** ")) for k in range(25)] + [(3000 + k, f"word{k} " * 80) for k in range(25)]
    docs = spark.createDataFrame(good + junk, "doc_id long, text string")
    model = quality.fit(docs)
    found = {x["doc_id"]: x["kept"] for x in rows_of(quality.classify(docs, model))}
    assert sum(found[k] for k, _ in good) >= 148 and sum(found[k] for k, _ in junk) <= 2
    strange = rows_of(quality.classify(odd.withColumn("kept", F.lit("clash")), model))
    assert len(strange) == len(ODD) and not any(x["kept"] for x in strange if x["doc_id"] in (3, 4, 5))
    assert quality.classify(empty, quality.fit(empty)).count() == 0


def plain_backoff(texts, order, least, apart):
    """Scores by the definition, one word at a time."""
    words = [backoff.words_of(t) for t in texts]
    grams = [Counter(tuple(x[i : i + n]) for n in range(1, order + 1) for i in range(len(x) - n + 1)) for x in words]
    every = sum(grams, Counter())
    total = sum(map(len, words))
    found = []
    for x, own in zip(words, grams):
        count = lambda g: every[g] - (own[g] if apart else 0)  # noqa: E731,B023

        def value(g):
            if len(g) == 1:
                return max(count(g), 0.5) / max(1, total - (len(x) if apart else 0))  # noqa: B023
            return count(g) / count(g[:-1]) if count(g) >= least else 0.4 * value(g[1:])  # noqa: B023

        found.append((len(x), sum(math.log(value(tuple(x[max(0, i - order + 1) : i + 1]))) for i in range(len(x)))))
    return found


@pytest.mark.parametrize("pack,width", [(8 << 20, 8 << 20), (300, 50)])
@pytest.mark.parametrize("order,least,apart", [(2, 2, False), (2, 1, False), (3, 1, True), (3, 2, True), (1, 1, True)])
def test_backoff(odd, empty, monkeypatch, pack, width, order, least, apart):
    monkeypatch.setattr(backoff, "PACK", pack)
    monkeypatch.setattr(backoff, "RANGE", width)
    few = odd.where("length(text) < 5000 OR text IS NULL").select("doc_id", "text")
    texts = [r["text"] for r in rows_of(few)]
    found = rows_of(backoff.score(few, least=least, order=order, apart=apart))
    expected = sorted((n, round(s, 4)) for n, s in plain_backoff(texts, order, least, apart))
    assert sorted((x["n_words"], round(x["score"], 4)) for x in found) == expected
    for x in found:
        assert x["mean_score"] == (pytest.approx(x["score"] / x["n_words"]) if x["n_words"] else None)
    assert backoff.score(empty).count() == 0


def test_pipeline_on_odd_rows(spark, odd, tmp_path):
    spark.createDataFrame([(1, " ".join(prose(4, 200).split()[20:40]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = odd.withColumn("kept", F.lit("own")).withColumn("hit_items", F.lit(1))
    for name, stage in corpus_pipeline.STAGES:
        found = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)))
        if name != "bpe_encoding":
            assert found.columns == docs.columns
        docs = found
    ids = {x["doc_id"] for x in docs.collect()}
    assert not ids & {1, 2, 3, 4, 5, 11} and 6 in ids and docs.where("NOT round_trip").count() == 0
    nothing = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        nothing = stage(spark, nothing, str(tmp_path))
    assert nothing.count() == 0


def brute_kept(table, percent):
    """Smallest ids of the groups of (id, text) that brute force links at ``percent`` / 100."""
    sets = dict(shingle_sets(table))
    root = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            shared = len(sets[a] & sets[b])
            if a < b and shared and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared) and root[a] != root[b]:
                x, y = sorted((root[a], root[b]))
                root = {d: x if r == y else r for d, r in root.items()}
    return set(root.values())


def near_pairs():
    """Pairs (id, text) with Jaccard similarities of 0.79, 0.80, 0.83 and 0.85, and what each has."""
    table, has = [], {}
    for k, (words, edits) in enumerate([(48, 1), (49, 1), (58, 1), (66, 1), (94, 2), (85, 2)]):
        first = [f"p{k}x{i}." if i % 9 == 8 else f"p{k}x{i}" for i in range(words)]
        second = list(first)
        for e in range(edits):
            second[20 + 30 * e] = f"edit{k}x{e}"
        sets = dict(shingle_sets([(0, " ".join(first)), (1, " ".join(second))]))
        has[1000 + 2 * k] = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        table += [(1000 + 2 * k, " ".join(first).capitalize()), (1001 + 2 * k, " ".join(second).capitalize())]
    return table, has


@pytest.mark.parametrize("percent,kept", [(85, 12), (80, 10)])
def test_least_shared(percent, kept):
    assert neardup.least_shared(percent) == kept


@pytest.mark.parametrize("limit", [50, 1])
def test_near_duplicates_at_other_thresholds(spark, monkeypatch, limit):
    monkeypatch.setattr(neardup, "LONG", limit)
    table, has = near_pairs()
    r = random.Random(8)
    for group in range(4):
        base = prose(300 + group, r.choice([20, 40, 90])).split()
        for _ in range(12):
            words = list(base)
            for _ in range(r.randrange(4)):
                words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
            table.append((len(table), " ".join(words)))
    assert sorted(round(x, 4) for x in has.values()) == [0.7802, 0.7959, 0.8, 0.8, 0.8305, 0.8507]
    for percent in (80, 60):
        found = rows_of(neardup.near_duplicates(spark.createDataFrame(table, "doc_id long, text string"), percent=percent))
        assert {x["doc_id"] for x in found if x["kept"]} == brute_kept(table, percent)


@pytest.mark.parametrize("percent", [60, 80, 85])
def test_members_of_a_long_list_meet_by_size_and_place(spark, percent):
    draw = random.Random(percent)
    rows = []
    for k in range(600):
        n = draw.choice([1, 2, 7, 40, 127, 128, 146, 150, 300, 5000]) + draw.randrange(4)
        rows.append((k % 3, k, k // 6, n, draw.randrange(n - -(-n * percent // 100) + 1)))
    columns = "value long, id long, root long, n long, place long"
    left = {k: n - place for _, k, _, n, place in rows}
    linkable = {
        (min(x[1], y[1]), max(x[1], y[1]))
        for x in rows for y in rows
        if x[0] == y[0] and x[2] != y[2] and 100 * min(left[x[1]], left[y[1]]) >= percent * (x[3] + y[3] - min(left[x[1]], left[y[1]]))
    }
    found = neardup._within_reach(spark.createDataFrame(rows, columns), percent).collect()
    assert {(min(r.id_x, r.id_y), max(r.id_x, r.id_y)) for r in found} == linkable and linkable
    # Copies with too many shingles of their own: one long list, no meetings, where all pairs would be two million.
    apart = spark.range(2000).selectExpr("1L AS value", "id", "id AS root", "120L AS n", f"{120 - -(-120 * percent // 100)}L AS place")
    assert neardup._met(apart, percent).count() == 0


def test_pipeline_equals_brute_force(spark, tmp_path):
    pairs, has = near_pairs()
    good = [(k, prose(k, 80).capitalize() + ".") for k in range(150)]
    junk = [(2000 + k, prose(k, 60).upper().replace(" ", "!! ")) for k in range(25)]
    junk += [(3000 + k, prose(k, 60).replace(" ", "*** ")) for k in range(25)] + [(4000 + k, f"word{k} " * 80) for k in range(25)]
    passage = " ".join(good[7][1].split()[20:40])
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(d, t, "en", "a", len(t)) for d, t in pairs + good + junk]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    docs = neardup.documents(spark, str(tmp_path))
    accepted = {x["doc_id"] for x in corpus_pipeline.good_quality(spark, docs, str(tmp_path)).collect()}
    assert {d for d, _ in pairs} <= accepted and 7 in accepted
    kept = brute_kept([(d, t) for d, t in pairs + good + junk if d in accepted], 80) - {7}
    assert {d for d, x in has.items() if d + 1 not in kept} == {d for d, x in has.items() if x >= 0.8}
    found = rows_of(corpus_pipeline.run(spark, str(tmp_path)))
    assert sorted(x["doc_id"] for x in found) == sorted(kept) and all(x["round_trip"] for x in found)


def test_pipeline_removes_repeated_runs_of_fifty_words(spark):
    passages = [prose(500 + k, 52).replace(".", "") for k in range(3)]
    texts = [f"{prose(600 + k, 30)} {passages[k % 3]} {prose(700 + k, 25)}" for k in range(12)]
    texts += [prose(800, 200), passages[0], f"é{passages[1]}ü", "", None, prose(801, 60) + " " + " ".join(passages[2].split()[:20])]
    span = corpus_pipeline.REPEATED
    data = [(t or "").encode() for t in texts]
    windows = Counter(d[i : i + span] for d in data for i in range(len(d) - span + 1))
    expected = {}
    for number, d in enumerate(data):
        gone = {i + k for i in range(len(d) - span + 1) if windows[d[i : i + span]] > 1 for k in range(span)}
        left = bytes(b for i, b in enumerate(d) if i not in gone).decode("utf-8", "ignore")
        if not gone:
            expected[number] = texts[number]
        elif left.strip():
            expected[number] = left
    docs = spark.createDataFrame([(k, t, "en", "a", 1) for k, t in enumerate(texts)], SCHEMA)
    found = {x["doc_id"]: x["text"] for x in rows_of(corpus_pipeline.unrepeated(spark, docs, ""))}
    assert found == expected and 13 not in found and 12 in found
    runs = Counter(r for t in found.values() for r in {" ".join((t or "").split()[i : i + 50]) for i in range(max(0, len((t or "").split()) - 49))})
    assert max(runs.values()) == 1


def test_rows_without_an_id(spark, tmp_path):
    passage = " ".join(prose(9, 30).split())
    texts = [(None, f"{prose(21, 30)} {passage}"), (None, passage), (None, prose(22, 60)), (None, None), (5, prose(23, 60)), (5, f"x {passage}"), (None, prose(22, 60)), (None, prose(23, 60)), (None, " ")]
    docs = spark.createDataFrame([(d, t, "en", "a", 1) for d, t in texts], SCHEMA)
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = rows_of(decontaminate.occurrences(docs, spark.read.parquet(str(tmp_path / "benchmark.parquet"))))
    order = lambda x: (str(x[0]), str(x[1]))
    assert sorted(((x["text"], len(x["hit_positions"])) for x in found), key=order) == sorted(
        ((t, 30 if t and passage in t else 0) for _, t in texts), key=order
    )
    clean = [x["text"] for x in rows_of(corpus_pipeline.uncontaminated(spark, docs, str(tmp_path)))]
    assert sorted(map(str, clean)) == sorted(str(t) for _, t in texts if not (t and passage in t))
    once = [(x["doc_id"], x["text"]) for x in rows_of(corpus_pipeline.one_of_each(spark, docs.where("coalesce(text, '') NOT LIKE 'x %'"), ""))]
    assert sorted(once, key=order) == sorted([texts[k] for k in (0, 1, 2, 3, 4, 8)], key=order)


def test_backoff_of_whole_documents(spark, odd, monkeypatch, tmp_path):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    texts = [t for _, t, *_ in ODD]
    expected = sorted((n, round(s, 3)) for n, s in plain_backoff(texts, 3, 1, True))
    found = rows_of(backoff.op8_lm_score(spark, str(tmp_path)))
    assert sorted((x["n_words"], round(x["score"], 3)) for x in found) == expected


def test_backoff_tells_copies_from_single_texts(spark):
    alone = [f"w{k} v{k} u{k} t{k}" for k in range(20)]
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), *enumerate(alone, 3)]
    means = {x["doc_id"]: x["mean_score"] for x in rows_of(backoff.score(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert min(means[1], means[2]) > max(v for k, v in means.items() if k > 2) + 1
