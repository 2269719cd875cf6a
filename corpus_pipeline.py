"""A corpus from documents, in stages: quality, near duplicates, benchmark leaks, secrets, token ids.

Each stage is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from spindrift.checkpoints import shared_folder
from spindrift.llm import decontam, pieces, quality, secrets, simhash
from spindrift.llm.common import read_table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules accept, learned from labels; all columns.

    Null, empty and blank texts are rejected. Null ids, repeated rows and texts of any length are judged like others.
    Without labels of both kinds all texts that aren't blank stay. An empty table stays empty."""
    return quality.keep_quality(docs, read_table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id; all columns.

    Null and wordless texts and rows with a null id are in no group and stay; of rows that repeat an id one stays, that of
    the smallest text. An empty table stays empty."""
    return simhash.drop_near_duplicates(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no item of the benchmark; all columns.

    Null and empty texts hold none and stay, as do null ids and repeated rows without an item. Null and empty items are
    ignored; without items nothing goes. An empty table stays empty."""
    return decontam.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def secrets_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts masked and n_chars counted again; all rows and columns.

    Null and empty texts stay as they are, repeated rows are masked alike. An empty table stays empty."""
    return secrets.redact_secrets(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, exact): the token ids of each document, and whether they decode to its very text.

    A null text has null ids, an empty one an empty list. Repeated rows and null ids stay. An empty table stays empty."""
    return pieces.encode_documents(docs)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("secrets", secrets_masked),
    ("token_ids", token_ids),
]

#: Trained models and hashes decide: SQL can't give these rows; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. The tables between them go to the folder of the checkpoints, which all machines share."""
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
