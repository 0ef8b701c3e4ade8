"""English stems by the published Porter2 rules, as column expressions.

A word is cut by measured regions: R1 begins behind the first consonant that follows a vowel, R2 is the
same again inside R1. A suffix lies in a region if what is left of it already holds as many of these
vowel-consonant pairs. In every step the longest suffix counts, whether or not its region lets it act.
Each step is one ``transform`` over the words, so no expression is written out twice.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Words with stems of their own, words left alone after step 1a, beginnings that R1 follows.
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
FINISHED = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
BEGINNINGS = "gener|commun|arsen"
# What takes the place of each suffix in steps 2 and 3, what goes in step 4.
STEP_2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion",
    "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous",
    "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate",
    "alli": "al", "bli": "ble", "ogi": "og", "li": "",
}
STEP_3 = {
    "ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "",
    "ful": "",
}
STEP_4 = (
    "ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er",
    "ic",
)

_PAIR = "[aeiouy][^aeiouy]"
_R1 = f"^(?:{BEGINNINGS}|.*?{_PAIR})"
_R2 = f"^(?:(?:{BEGINNINGS})|(?!{BEGINNINGS}).*?{_PAIR}).*?{_PAIR}"
_SHORT_SYLLABLE = "(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])"
_SHORT_WORD = "^(?:[^aeiouy]+[aeiouy][^aeiouywxY]|[aeiouy][^aeiouy])$"


def _without(word: Column, suffix: str, put: str = "") -> Column:
    return F.concat(F.left(word, F.length(word) - len(suffix)), F.lit(put))


def _by_suffix(word: Column, suffixes: tuple[str, ...], then: Callable[[str], Column]) -> Column:
    """``then`` of the longest of the suffixes that the word ends in, or the word."""
    longest_first = sorted(suffixes, key=len, reverse=True)
    cases = reduce(lambda c, s: c.when(word.endswith(s), then(s)), longest_first[1:], F.when(word.endswith(longest_first[0]), then(longest_first[0])))
    return cases.otherwise(word)


def _left_of(word: Column, suffix: str) -> Column:
    return F.left(word, F.length(word) - len(suffix))


def _marked(word: Column) -> Column:
    """Consonant y as Y."""
    return F.regexp_replace(F.regexp_replace(word, "^y", "Y"), "([aeiouy])y", "$1Y")


def _step_1a(word: Column) -> Column:
    tied = F.when(F.length(word) > 4, _without(word, "ied", "i")).otherwise(_without(word, "ied", "ie"))
    plural = F.when(word.rlike("[aeiouy].+s$"), _without(word, "s")).otherwise(word)
    cases = {"sses": _without(word, "es"), "ied": tied, "ies": tied, "us": word, "ss": word, "s": plural}
    return _by_suffix(word, tuple(cases), cases.__getitem__)


def _step_1b(word: Column) -> Column:
    def mended(rest: Column) -> Column:
        return (
            F.when(rest.rlike("(?:at|bl|iz)$"), F.concat(rest, F.lit("e")))
            .when(rest.rlike("(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), _without(rest, "x"))
            .when(rest.rlike(_SHORT_WORD), F.concat(rest, F.lit("e")))
            .otherwise(rest)
        )

    def then(suffix: str) -> Column:
        rest = _left_of(word, suffix)
        if suffix.startswith("ee"):
            return F.when(rest.rlike(_R1), F.concat(rest, F.lit("ee"))).otherwise(word)
        return F.when(rest.rlike("[aeiouy]"), mended(rest)).otherwise(word)

    return F.when(word.isin(*FINISHED), word).otherwise(_by_suffix(word, ("eedly", "ingly", "edly", "eed", "ing", "ed"), then))


def _step_1c(word: Column) -> Column:
    return F.when(word.isin(*FINISHED), word).otherwise(F.regexp_replace(word, "^(.+[^aeiouy])[yY]$", "$1i"))


def _step_2(word: Column) -> Column:
    def then(suffix: str) -> Column:
        rest = _left_of(word, suffix)
        fits = rest.rlike(_R1)
        if suffix == "ogi":
            fits &= rest.endswith("l")
        if suffix == "li":
            fits &= rest.rlike("[cdeghkmnrt]$")
        return F.when(fits, F.concat(rest, F.lit(STEP_2[suffix]))).otherwise(word)

    return _by_suffix(word, tuple(STEP_2), then)


def _step_3(word: Column) -> Column:
    def then(suffix: str) -> Column:
        rest = _left_of(word, suffix)
        return F.when(rest.rlike(_R2 if suffix == "ative" else _R1), F.concat(rest, F.lit(STEP_3[suffix]))).otherwise(word)

    return _by_suffix(word, tuple(STEP_3), then)


def _step_4(word: Column) -> Column:
    def then(suffix: str) -> Column:
        rest = _left_of(word, suffix)
        fits = rest.rlike(_R2)
        if suffix == "ion":
            fits &= rest.rlike("[st]$")
        return F.when(fits, rest).otherwise(word)

    return _by_suffix(word, STEP_4, then)


def _step_5(word: Column) -> Column:
    rest = _left_of(word, "x")
    silent = rest.rlike(_R2) | (rest.rlike(_R1) & ~rest.rlike(_SHORT_SYLLABLE + "$"))
    cut = (word.endswith("e") & silent) | (word.endswith("ll") & rest.rlike(_R2))
    return F.when(cut, rest).otherwise(word)


def _then(step: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda p: F.struct(p["word"].alias("word"), step(p["stem"]).alias("stem"))


def stems(words: Column) -> Column:
    """The stems of an array of lower-case words, in place. Words of one or two letters are their own stems."""
    known = F.create_map(*(F.lit(x) for pair in IRREGULAR.items() for x in pair))
    pairs = F.transform(words, lambda w: F.struct(w.alias("word"), _marked(w).alias("stem")))
    for step in (_step_1a, _step_1b, _step_1c, _step_2, _step_3, _step_4, _step_5):
        pairs = F.transform(pairs, _then(step))
    return F.transform(
        pairs,
        lambda p: F.coalesce(
            F.element_at(known, p["word"]), F.when(F.length(p["word"]) < 3, p["word"]).otherwise(F.replace(p["stem"], F.lit("Y"), F.lit("y")))
        ),
    )


def stems_of(spark: SparkSession, words: list[str]) -> list[str]:
    """The stems of a few given words."""
    if not words:
        return []
    return spark.range(1).select(stems(F.array(*map(F.lit, words)))).first()[0]


def common_start(stem: str) -> str:
    """What every word with this stem begins with.

    Suffixes are cut off, and at most the last letter of a stem is not the word's own (policy, hoping,
    sensibility); only three irregular words share less with theirs.
    """
    short = [word for word, own in IRREGULAR.items() if own == stem]
    start = stem if len(stem) < 3 else stem[:-1]
    while not all(word.startswith(start) for word in short):
        start = start[:-1]
    return start
