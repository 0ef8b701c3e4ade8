"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rentgrain.llm import (
    alignment,
    backoff,
    bpe,
    collocations,
    decontaminate,
    impactsearch,
    language,
    neardup,
    quality,
    rules,
    suffixdedup,
    unigram,
    warc,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": decontaminate.op1_decontamination,
        "op2_neardup": neardup.op2_neardup,
        "op3_quality": quality.op3_quality,
        "op4_token_counts": unigram.op4_token_counts,
        "op5_warc": warc.op5_warc,
        "op6_suffix_dedup": suffixdedup.op6_suffix_dedup,
        "op7_rules": rules.op7_rules,
        "op8_lm_score": backoff.op8_lm_score,
        "op9_bpe": bpe.op9_bpe,
        "op10_language": language.op10_language,
        "op11_alignment": alignment.op11_alignment,
        "op12_collocations": collocations.op12_collocations,
        "op13_exact_topk": impactsearch.op13_exact_topk,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": decontaminate.OP1_SQL,
        "op5_warc": warc.OP5_SQL,
        "op7_rules": rules.OP7_SQL,
        "op12_collocations": collocations.OP12_SQL,
        "op13_exact_topk": impactsearch.OP13_SQL,
    }
