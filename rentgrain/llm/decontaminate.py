"""Benchmark decontamination with a positional inverted index.

The index holds postings (term, document, position) of the training texts. A benchmark window is
searched from its two rarest terms: their postings, moved by the terms' offsets, must meet at one
place of a document. Only such meetings are compared word for word with the item, which gives the
words inside exact occurrences. Leaving out the condition that offsets agree exactly gives proximity
matches.

Postings are kept for the terms the search starts from, not for every word: any window holds two of
them, and other lists would never be opened. All steps are column expressions; the postings of a text
are made inside its row, so that a term in every text burdens no single task. What is broadcast is
measured first: beyond ``frames.BROADCAST_ROWS`` rows a shuffled join takes its place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rentgrain.llm.frames import documents, let, small, stored

WINDOW = 10
#: Fixed value: what separates words once A-Z are in lower case.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Items with all their windows that may be broadcast.
WIDE_ROWS = 2_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words with A-Z in lower case and all other letters as they are; a null text has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAPS), "")


def items_of(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """Items with words and the length of their windows; items without words are left out."""
    return benchmark.select(
        F.col(item).cast("string").alias("item"), words_of(F.col(text)).alias("words")
    ).where(F.size("words") > 0).withColumn("span", F.least(F.lit(WINDOW), F.size("words")))


def document_frequency(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """For each term of the items, the number of texts that have it (0 if none)."""
    wanted = stored(items.select(F.explode("words").alias("term")).distinct())
    seen = docs.select(F.explode(F.array_distinct(words_of(F.col(text)))).alias("term"))
    counted = seen.join(small(wanted), "term").groupBy("term").agg(F.count("*").alias("frequency"))
    return wanted.join(counted, "term", "left").select("term", F.coalesce("frequency", F.lit(0)).alias("frequency"))


def probes(items: DataFrame, frequency: DataFrame) -> DataFrame:
    """Items with their terms' frequencies and, for each window, the offsets of its two rarest terms.

    Of equally rare terms the first counts; a window of one word has it as both.
    """
    placed = items.select("item", "words", "span", F.posexplode("words").alias("at", "term")).join(frequency, "term")
    ranked = (
        placed.groupBy("item", "words", "span")  # words keep items apart whose ids repeat
        .agg(F.sort_array(F.collect_list(F.struct("at", "term", "frequency"))).alias("t"))
    )
    rarest = lambda part: F.sort_array(F.transform(part, lambda x: F.struct(x["frequency"], x["at"], x["term"])))
    windows = F.transform(
        F.sequence(F.lit(0), F.size("t") - F.col("span")),
        lambda s: let(
            rarest(F.slice("t", s + 1, F.col("span"))),
            lambda r: F.struct(
                r[0]["at"].alias("a"), r[0]["term"].alias("a_term"), r[F.least(F.lit(1), F.size(r) - 1)]["at"].alias("b"),
                r[F.least(F.lit(1), F.size(r) - 1)]["term"].alias("b_term"),
            ),
        ),
    )
    return ranked.select("item", "words", "span", F.array_distinct(windows).alias("windows"))


def postings(docs: DataFrame, searched: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored index: term, key and position of every occurrence of the terms searched from."""
    terms = (
        searched.select(F.explode("windows").alias("w")).select(F.explode(F.array("w.a_term", "w.b_term")).alias("term")).distinct()
    )
    places = docs.select(F.col(key).alias("key"), F.posexplode(words_of(F.col(text))).alias("position", "term"))
    return stored(places.join(small(stored(terms)), "term").select("term", "key", "position"))


def meetings(index: DataFrame, searched: DataFrame) -> DataFrame:
    """Places (key, item, start of the item in the text) where both rarest terms of a window are right."""
    offsets = stored(searched.withColumn("id", F.xxhash64("item", "words")))
    by_term = offsets.select("id", F.explode("windows").alias("w")).select(
        "id", F.explode(F.array(F.struct(F.col("w.a").alias("at"), F.col("w.a_term").alias("term")), F.struct(F.col("w.b").alias("at"), F.col("w.b_term").alias("term")))).alias("x")
    ).select("id", "x.at", "x.term").distinct()
    found = (
        index.join(small(stored(by_term)), "term")
        .groupBy("key", "id", (F.col("position") - F.col("at")).alias("start"))
        .agg(F.collect_set("at").alias("met"))
    )
    both = lambda w: F.array_contains("met", w["a"]) & F.array_contains("met", w["b"])
    return found.join(small(offsets, WIDE_ROWS), "id").where(F.exists("windows", both)).select("key", "item", "words", "span", "start")


def proximity_matches(index: DataFrame, searched: DataFrame, slop: int) -> DataFrame:
    """(key, item) pairs whose text has both rarest terms of a window at most ``slop`` words from where they should be.

    The words between may differ. Positions are joined within a text by bands of ``slop`` + 1 words.
    """
    width = slop + 1
    wanted = searched.select("item", F.explode("windows").alias("w")).select(
        "item", "w.a_term", "w.b_term", (F.col("w.b") - F.col("w.a")).alias("apart")
    ).distinct()
    first = index.join(wanted.withColumnRenamed("a_term", "term"), "term").select(
        "key", "item", "b_term", "apart", (F.col("position") + F.col("apart")).alias("due")
    )
    first = first.withColumn("band", F.explode(F.array(*(F.floor(F.col("due") / width) + k for k in (-1, 0, 1)))))
    second = index.select(F.col("term").alias("b_term"), "key", "position", F.floor(F.col("position") / width).alias("band"))
    near = first.join(second, ["key", "b_term", "band"]).where(F.abs(F.col("position") - F.col("due")) <= slop)
    return near.select("key", "item").distinct()


def _verified(words: Column, places: Column) -> Column:
    """Of the places, those with words of the text in exact occurrences of a window, as (item, positions)."""
    at = lambda p: F.filter(
        F.sequence(F.greatest(F.lit(0), -p["start"]), F.size(p["words"]) - p["span"]),
        lambda s: F.slice(words, p["start"] + s + 1, p["span"]) == F.slice(p["words"], s + 1, p["span"]),
    )
    spread = lambda p: F.flatten(
        F.transform(at(p), lambda s: F.sequence(p["start"] + s, p["start"] + s + p["span"] - 1))
    )
    fits = lambda p: F.greatest(F.lit(0), -p["start"]) <= F.size(p["words"]) - p["span"]
    found = F.transform(F.filter(places, fits), lambda p: F.struct(p["item"].alias("item"), spread(p).alias("hit")))
    return F.filter(found, lambda x: F.size(x["hit"]) > 0)


def occurrences(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id"
) -> DataFrame:
    """``docs`` with n_words, hit_positions and hit_items (item ids as sorted strings).

    A null text has no words, an item without words no windows. Rows with equal keys or none each get
    the result of their own text. Columns with the new names are replaced.

    Places belong to a hash of key and text. Texts that share one by chance share places, which are
    compared with each text.
    """
    items = stored(items_of(benchmark, item, text))
    rest = docs.drop("n_words", "hit_positions", "hit_items")
    own = F.xxhash64(F.lit(1), key, text)
    searched = stored(probes(items, document_frequency(rest, items, text)))
    places = meetings(postings(rest.select(own.alias("_key"), F.col(text).alias("_text")), searched, "_key", "_text"), searched)
    by_text = stored(places.groupBy("key").agg(F.collect_set(F.struct("item", "words", "span", "start")).alias("_places")))
    joined = rest.join(by_text.withColumnRenamed("key", "_key"), own == F.col("_key"), "left")
    found = joined.withColumn(
        "_found",
        F.when(
            F.col("_places").isNotNull(), let(words_of(F.col(text)), lambda w: _verified(w, F.col("_places")))
        ),
    )
    none = F.array().cast("array<string>")
    return found.select(
        *rest.columns,
        F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long").alias("n_words"),
        F.coalesce(F.array_distinct(F.flatten("_found.hit")), F.array().cast("array<int>")).alias("hit_positions"),
        F.coalesce(F.array_sort(F.array_distinct("_found.item")), none).alias("hit_items"),
    )


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and contained items of every document."""
    found = occurrences(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("hit_positions").cast("long").alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hit_items"), 256).alias("items_sha256"),
        (F.size("hit_positions") > 0).alias("contaminated"),
    )


OP1_SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item, span, array_to_string(w[i:i + span - 1], ' ') AS g
  FROM (SELECT item, w, least(10, len(w)) AS span, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i
        FROM b WHERE len(w) > 0)
), tw AS (
  SELECT r, i, span, array_to_string(w[i:i + span - 1], ' ') AS g
  FROM (SELECT r, w, span, unnest(generate_series(1, len(w) - span + 1)) AS i
        FROM t, (SELECT DISTINCT span FROM bw) WHERE len(w) >= span)
), hits AS (
  SELECT r, i, tw.span, item FROM tw JOIN bw ON tw.g = bw.g AND tw.span = bw.span
), words AS (
  SELECT r, count(DISTINCT p) AS n_hit
  FROM (SELECT r, unnest(generate_series(i, i + span - 1)) AS p FROM hits) GROUP BY r
), found AS (
  SELECT r, list_sort(list_distinct(list(item))) AS items FROM hits GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM t LEFT JOIN words USING (r) LEFT JOIN found USING (r)
"""
