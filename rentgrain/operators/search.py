"""Ranked text search over maintenance requests.

A request matches if its title and description contain every query word, in any of its forms. With one
query word the rank grows less with each repetition (1 + 1/4 + 1/9 ...); with several it follows from
the distances between different words: each pair of places d words apart contributes

    w(d) = 0.1 / (1.005 + 0.05 * exp(d / 1.5 - 2))    for d up to 100

and the rank is 1 minus the product of all (1 - w).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paging import limited
from ..functions.text import could_be, hits, may_have, placed, query_terms
from ..functions.stems import stems

LIMIT = 50
# Weight of a word, the sum of 1/k^2 over all k, and the farthest two words may be apart.
WORD_WEIGHT = 0.1
REPEAT_LIMIT = 1.64493406685
FARTHEST = 100

RESULT = ["request_id", "property_id", "unit_id", "title", "priority", "request_status", "created_at", "rank"]


def searched_text() -> Column:
    """The text a request is searched by."""
    return F.concat("title", F.lit(" "), F.coalesce("description", F.lit("")))


def _repeats(count: Column) -> Column:
    """Sum of 1/k^2 for k up to ``count``."""
    steps = F.sequence(F.lit(1), F.greatest(count, F.lit(1)))
    return F.aggregate(steps, F.lit(0.0), lambda acc, k: acc + F.lit(1.0) / (k * k).cast("double"))


# What is left of 1 after every pair of places of different words. A place has at most FARTHEST
# followers that are near enough, so long texts cost in proportion to their hits.
_APART = f"""aggregate(sequence(1, size(hits)), 1D, (left, i) -> left * aggregate(
    filter(slice(hits, i + 1, {FARTHEST}),
           h -> h.term <> hits[i - 1].term AND h.place - hits[i - 1].place <= {FARTHEST}),
    1D, (rest, h) -> rest * (1 - {WORD_WEIGHT}D / (1.005D + 0.05D * exp((h.place - hits[i - 1].place) / 1.5D - 2)))))"""


def rank_of(terms: list[str]) -> Column:
    """The rank of a row from its column ``hits``."""
    if len(terms) == 1:
        value = _repeats(F.size("hits")) * (WORD_WEIGHT / REPEAT_LIMIT)
    else:
        value = F.lit(1.0) - F.expr(_APART)
    return F.round(value, 6).alias("rank")


def _has_all(terms: list[str]) -> Column:
    return F.size(F.array_distinct(F.col("hits")["term"])) == len(terms)


def text_search(requests: DataFrame, units: DataFrame, query: str, limit: int | None = LIMIT) -> DataFrame:
    """Requests that contain all words of the query, best first.

    One pass over the requests without a shuffle of texts: a plain substring test on what
    every form of a word begins with discards most rows before any text is split. A blank
    query, or one of stop words only, gives no rows. Without ``limit`` all matches are given.
    """
    terms = query_terms(requests.sparkSession, query)
    return (
        requests.filter(may_have(searched_text(), terms))
        .withColumn("hits", hits(searched_text(), terms))
        .filter(_has_all(terms) & F.lit(bool(terms)))
        .select(*[c for c in RESULT if c not in ("property_id", "rank")], rank_of(terms))
        .join(units.select("unit_id", "property_id"), "unit_id")
        .orderBy(F.desc("rank"), F.desc("created_at"), "request_id")
        .transform(limited, limit)
        .select(*RESULT)
    )


def indexed_search(requests: DataFrame, units: DataFrame, query: str, limit: int | None = LIMIT) -> DataFrame:
    """:func:`text_search` by exploding words and grouping the hits of a request again.

    The texts do not leave their stage: only words that may match are shuffled.
    """
    terms = query_terms(requests.sparkSession, query)
    words = requests.select("request_id", F.explode(placed(searched_text())).alias("at")).filter(could_be(F.col("at.word"), terms))
    found = words.select("request_id", "at.place", stems(F.array("at.word"))[0].alias("term"))
    matches = (
        found.filter(F.col("term").isin(*terms) if terms else F.lit(False))
        .groupBy("request_id")
        .agg(F.array_sort(F.collect_list(F.struct("place", "term"))).alias("hits"))
        .filter(_has_all(terms))
        .select("request_id", rank_of(terms))
    )
    return (
        matches.join(requests.drop("description"), "request_id")
        .join(units.select("unit_id", "property_id"), "unit_id")
        .orderBy(F.desc("rank"), F.desc("created_at"), "request_id")
        .transform(limited, limit)
        .select(*RESULT)
    )
