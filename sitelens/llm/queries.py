"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, jaccard, licenses, mixing, ppm, quality, secrets, sharding, suffixes, toxicity
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    def docs(s: SparkSession, d: str) -> DataFrame:
        return table(s, d, "documents")

    return {
        "op1_ppm": lambda s, d: ppm.report(docs(s, d)),
        "op2_toxicity_fm": lambda s, d: toxicity.report(docs(s, d), table(s, d, "labels")),
        "op3_quality_votes": lambda s, d: quality.report(docs(s, d)),
        "op4_mixing_raking": lambda s, d: mixing.report(docs(s, d)),
        "op5_secret_ownership": lambda s, d: secrets.report(docs(s, d)),
        "op6_bounded_ring": lambda s, d: sharding.report(docs(s, d)),
        "op7_license_index": lambda s, d: licenses.scan(docs(s, d)),
        "op8_decontamination": lambda s, d: decontaminate.report(docs(s, d), table(s, d, "benchmark")),
        "op9_suffix_dedup": lambda s, d: suffixes.report(docs(s, d)),
        "op10_ngram_jaccard": lambda s, d: jaccard.report(docs(s, d)),
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_decontamination": decontaminate.ORACLE}
