"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

OPERATORS = {
    "op1_secret_scan": "secrets",
    "op2_pii": "pii",
    "op3_chat_format": "chat",
    "op4_decontaminate": "decontam",
    "op5_license_scan": "licenses",
    "op6_simhash_dedup": "simhash",
    "op7_toxicity": "toxicity",
    "op8_quality": "quality",
    "op9_jpeg_media": "media",
    "op10_sentencepiece": "pieces",
}


def _module(name: str):
    return importlib.import_module(f"{__package__}.{OPERATORS[name]}")


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**{name: getattr(_module(name), name) for name in OPERATORS}, "pipeline": _pipeline}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name in OPERATORS if (sql := getattr(_module(name), "ORACLE_SQL", None))}
