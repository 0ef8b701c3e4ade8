"""Words of a text for searching: lower-cased, placed, without stop words, stemmed."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .stems import common_start, stems, stems_of

# Letters and digits make words; everything else separates them.
SEPARATOR = r"[^\p{L}\p{N}]+"

# The English stop word list used by the search.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers "
    "herself it its itself they them their theirs themselves what which who whom this that these those am is are "
    "was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out "
    "on off over under again further then once here there when where why how all any both each few more most "
    "other some such no nor not only own same so than too very s t can will just don should now"
).split()


def query_terms(spark: SparkSession, query: str) -> list[str]:
    """Distinct stems of a search query, in order; stop words are left out."""
    raw = [w for w in re.split(r"[\W_]+", query.lower()) if w and w not in STOP_WORDS]
    return list(dict.fromkeys(stems_of(spark, raw)))


def may_have(text: Column, terms: list[str]) -> Column:
    """Whether the text has the beginning of every term: true for each text that has all terms, cheap to test."""
    lowered = F.lower(text)
    return reduce(lambda a, b: a & b, [lowered.contains(common_start(term)) for term in terms], F.lit(bool(terms)))


def placed(text: Column) -> Column:
    """All words in order as (place, word); places count from 1, stop words included."""
    words = F.array_remove(F.split(F.lower(text), SEPARATOR), "")
    return F.transform(words, lambda w, i: F.struct((i + 1).alias("place"), w.alias("word")))


def could_be(word: Column, terms: list[str]) -> Column:
    """Whether a word may have one of the terms as its stem."""
    start = reduce(lambda a, b: a | b, [word.startswith(common_start(term)) for term in terms], F.lit(False))
    return start & ~word.isin(*STOP_WORDS)


def hits(text: Column, terms: list[str]) -> Column:
    """Where the terms occur, in order, as (place, term).

    Words that cannot have one of the stems are dropped before stemming.
    """
    likely = F.filter(placed(text), lambda p: could_be(p["word"], terms))
    found = F.arrays_zip(likely["place"].alias("place"), stems(likely["word"]).alias("term"))
    return F.filter(found, lambda h: h["term"].isin(*terms) if terms else F.lit(False))
