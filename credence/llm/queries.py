"""The registered queries of the corpus operators and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from credence.llm import bpe, fill_middle, fingerprints, importance, language, mixing, pii, quality, secrets, simhash_dedup, suffix_dedup, token_counts, toxicity
from credence.llm.common import documents


def over_documents(op: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: op(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secrets": over_documents(secrets.op1),
        "op2_pii": over_documents(pii.op2),
        "op3_toxicity": toxicity.op3,
        "op4_mixing": over_documents(mixing.op4),
        "op5_fingerprints": over_documents(fingerprints.op5),
        "op6_suffix": over_documents(suffix_dedup.op6),
        "op7_simhash": over_documents(simhash_dedup.op7),
        "op8_language": over_documents(language.op8),
        "op9_bpe": over_documents(bpe.digest_documents),
        "op10_quality": over_documents(quality.op10),
        "op11_fill_middle": over_documents(fill_middle.op11),
        "op12_token_counts": over_documents(token_counts.op12),
        "op13_importance": importance.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_mixing": mixing.ORACLE_SQL, "op11_fill_middle": fill_middle.ORACLE_SQL}
