"""Quality rules as a ledger of bits.

Every rule is evaluated once for every text and leaves one bit in the row's mask, next to the
measurements it used. Policies are versioned sets of bits: applying one, or asking what leaving a
rule out would change, reads the ledger and never the texts again.

Only built-in column expressions; nothing is shuffled, since every measurement is taken inside a row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rentgrain.llm.frames import documents, let

#: What separates words, and which characters count as symbols.
SPACES, SYMBOLS = r"[\x20\x09-\x0D]+", "[#*$%&|<>]"

#: Rules in the order of their bits; a rule's condition is true where a text fails it.
RULES: dict[str, Callable[[], Column]] = {
    "few_words": lambda: F.col("n_words") < 50,
    "repeated_words": lambda: 100 * F.col("n_repeat_words") > 50 * F.col("n_words"),
    "symbols": lambda: 2 * F.col("n_symbols") > F.col("n_words"),
    "repeated_lines": lambda: (F.col("n_lines") >= 4) & (2 * F.col("n_dup_lines") > F.col("n_lines")),
    "short_words": lambda: F.col("word_chars") < 2 * F.col("n_words"),
    "long_words": lambda: F.col("word_chars") > 20 * F.col("n_words"),
    "shouting": lambda: 3 * F.col("n_exclamations") > F.col("n_words"),
}
BITS = {name: 1 << k for k, name in enumerate(RULES)}
BASE = BITS["few_words"] | BITS["repeated_words"]

#: Versioned policies: the bits that reject a text.
POLICIES: dict[str, int] = {
    "base": BASE,
    "v1": BASE | BITS["symbols"] | BITS["repeated_lines"] | BITS["short_words"] | BITS["long_words"],
    "v2": sum(BITS.values()),
}
CURRENT = "v2"


def words_of(text: Column) -> Column:
    """The words of a text; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def _repeated(words: Column) -> Column:
    """How many words lie in a three-word window that occurs at least twice.

    Windows are sorted inside the row by a 64-bit hash, so that equal ones become neighbours.
    """
    window = lambda i: F.struct(
        F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")
    )
    ordered = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(words) - 3), window))
    same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
    twice = let(
        ordered,
        lambda s: F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1))),
    )
    covered = F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    return F.when(F.size(words) < 3, 0).otherwise(F.size(F.array_distinct(covered)))


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text, with all measurements and ``failed_rules``, a mask of ``BITS``.

    A null text is measured as an empty one. Columns named like a measurement are replaced; repeated
    rows stay repeated.
    """
    measured = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_exclamations", "failed_rules")
    content = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(content, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    by_words = let(
        words_of(F.col(text)), lambda w: F.struct(F.size(w).alias("n"), _repeated(w).alias("repeated"))
    )
    by_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    rest = [c for c in docs.columns if c != text and c not in measured]
    found = docs.select(
        *rest,
        by_words.alias("_w"),
        by_lines.alias("_l"),
        F.length(F.regexp_replace(content, SPACES, "")).alias("_chars"),
        F.regexp_count(content, F.lit(SYMBOLS)).alias("_symbols"),
        F.regexp_count(content, F.lit("!")).alias("_exclamations"),
    ).select(
        *rest,
        *(
            F.col(at).cast("long").alias(name)
            for at, name in (
                ("_w.n", "n_words"), ("_chars", "word_chars"), ("_symbols", "n_symbols"), ("_l.n", "n_lines"),
                ("_l.dup", "n_dup_lines"), ("_w.repeated", "n_repeat_words"), ("_exclamations", "n_exclamations"),
            )
        ),
    )
    mask = F.lit(0)
    for name, rule in RULES.items():
        mask = mask.bitwiseOR(F.when(rule(), BITS[name]).otherwise(0))
    return found.withColumn("failed_rules", mask)


def passes(policy: int) -> Column:
    """Whether a row of the ledger passes a policy, given as a mask of rules."""
    return F.col("failed_rules").bitwiseAND(F.lit(policy)) == 0


def ablation(entries: DataFrame, policy: int, *groups: str) -> DataFrame:
    """For each rule of ``policy``: rows failing it, rows failing nothing else, and rows kept without it.

    One pass over the ledger with a partial aggregate. Also by ``groups``, with the rules that any and
    that all rows of the group fail, as masks.
    """
    in_force = {n: b for n, b in BITS.items() if b & policy}
    sums = [F.count("*").alias("n_rows"), F.count_if(passes(policy)).alias("n_kept")]
    for name, bit in in_force.items():
        failed = F.col("failed_rules").bitwiseAND(F.lit(policy))
        sums += [
            F.count_if(failed.bitwiseAND(F.lit(bit)) != 0).alias(f"{name}_fails"),
            F.count_if(failed == bit).alias(f"{name}_alone"),
            F.count_if(passes(policy & ~bit)).alias(f"{name}_kept_without"),
        ]
    return entries.groupBy(*groups).agg(
        *sums, F.bit_or("failed_rules").alias("failed_by_any"), F.bit_and("failed_rules").alias("failed_by_all")
    )


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of every document with the base verdict and that of the current policy."""
    entries = ledger(documents(spark, sf_dir).select("doc_id", "text"))
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~passes(BASE)).alias("base_failed"), passes(POLICIES[CURRENT] | BASE).alias("kept"),
        "n_lines", "n_exclamations", "failed_rules",
    )


OP7_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), split AS (
  SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM docs
), windows AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram
  FROM (SELECT r, w, unnest(generate_series(1, len(w) - 2)) AS i FROM split)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS c FROM windows) WHERE c > 1
), repeats AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r
), measured AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(l) AS BIGINT) AS n_lines,
         CAST(length(text) - length(replace(text, '!', '')) AS BIGINT) AS n_exclamations
  FROM docs JOIN split USING (r) LEFT JOIN repeats USING (r)
), masked AS (
  SELECT *, CASE WHEN n_words < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 2 * n_symbols > n_words THEN 4 ELSE 0 END
    + CASE WHEN n_lines >= 4 AND 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END
    + CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END
    + CASE WHEN 3 * n_exclamations > n_words THEN 64 ELSE 0 END AS failed_rules
  FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       failed_rules = 0 AS kept, n_lines, n_exclamations, failed_rules
FROM masked
"""
