"""A corpus of documents made ready for training: five stages, each a Spark job over what the last one kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rentgrain.llm import bpe, decontaminate, neardup, quality, suffixdedup
from rentgrain.llm.frames import documents, small, stored

#: No SQL states a trained classifier, sketches or suffix arrays; tests compare with brute force instead.
ORACLE_SQL: str | None = None
#: The near-duplicate stage links at a Jaccard similarity of ``SIMILAR`` / 100; ``op2_neardup`` has its own value.
SIMILAR = 80
#: Bytes of a string that may occur once only. A run of 50 words, spaces between them, holds one unless its
#: words have less than three letters on average; ``op6_suffix_dedup`` has its own value.
REPEATED = 200


def _with_room(docs: DataFrame, names: list[str], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``stage`` applied while columns of ``docs`` that are named like its own results carry other names."""
    aside = {n: f"_own_{n}" for n in names if n in docs.columns}
    found = stage(docs.withColumnsRenamed(aside))
    return found.select(*(F.col(aside.get(c, c)).alias(c) for c in docs.columns))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier accepts; without text there is nothing to accept."""
    model = quality.fit(docs)
    return _with_room(docs, ["posterior", "score", "kept"], lambda d: quality.classify(d, model).where("kept"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near-duplicates, once.

    Rows that share an id are one document. Rows without an id get one from a hash of their text, above
    all ids below 2^62; those without words are copies of nothing and stay.
    """
    worded = F.coalesce("text", F.lit("")).rlike(r"[^\x09-\x0D ]")
    of_text = F.when(worded, F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62)))
    docs_with = docs.withColumn("_name", F.coalesce(F.col("doc_id").cast("long"), of_text))
    found = stored(neardup.near_duplicates(docs_with.select("_name", "text"), key="_name", percent=SIMILAR))
    dropped = stored(found.where(~F.col("kept")).select("_name").distinct())
    repeated = stored(found.where("kept").groupBy("_name").count().where("count > 1 AND _name IS NOT NULL").select("_name"))
    rest = docs_with.join(small(dropped), "_name", "left_anti")
    single = rest.join(small(repeated), "_name", "left_anti")
    folded = rest.join(small(repeated), "_name", "left_semi").dropDuplicates(["_name"])
    return single.unionByName(folded).select(*docs.columns)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings that occur elsewhere; those of which nothing is left go."""
    names = ["n_bytes", "removed_spans", "kept_bytes", "kept_text"]

    def stage(rows: DataFrame) -> DataFrame:
        found = suffixdedup.without_repeats(rows, span=REPEATED, as_text=True)
        cut = F.size("removed_spans") > 0
        found = found.where(~cut | (F.length(F.trim("kept_text")) > 0))
        return found.withColumn("n_chars", F.when(cut, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))).withColumn(
            "text", F.when(cut, F.col("kept_text")).otherwise(F.col("text"))
        )

    return _with_room(docs, names, stage)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any occurrence of a benchmark window."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    names = ["n_words", "hit_positions", "hit_items"]
    return _with_room(
        docs, names, lambda d: decontaminate.occurrences(d, benchmark).where(F.size("hit_positions") == 0)
    )


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with token_ids, n_tokens, and whether decoding gave the text back."""
    coded = bpe.encode_decode(docs, bpe.default_vocabulary())
    return coded.select(
        *(c for c in docs.columns if c not in ("token_ids", "n_tokens", "round_trip")),
        "token_ids",
        F.size("token_ids").cast("long").alias("n_tokens"),
        (F.col("decoded_text") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", good_quality),
    ("minhash_near_dedup", one_of_each),
    ("suffix_array_dedup", unrepeated),
    ("benchmark_decontamination", uncontaminated),
    ("bpe_encoding", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are a table in the shared folder before the next begins."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
