"""A training-data pipeline over ``documents``: known language, one of each group of near copies, no personal data,
sources in proportion, packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of ``docs``.  ``run`` writes every stage's result to the shared folder and reads it again.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from tessella.llm import langid, mixing, neardup, packing, pii  # noqa: E402
from tessella.llm.common import new_folder, table  # noqa: E402
from tessella.llm.queries import vocabulary  # noqa: E402
from tessella.session import bound_batches, ship_package  # noqa: E402


def _prepare(spark: SparkSession) -> None:
    ship_package(spark)
    bound_batches(spark)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language, which is written into ``lang``; what has no letter or no clear language goes."""
    _prepare(spark)
    return langid.of_known_language(docs, langid.with_bounds(docs, langid.fit(docs)))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more over five-word shingles: the smallest doc_id."""
    _prepare(spark)
    return neardup.without_near_duplicates(docs, words=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data masked."""
    _prepare(spark)
    return pii.without_personal_data(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, at most three times."""
    _prepare(spark)
    return mixing.mixed_documents(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    _prepare(spark)
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("language", language), ("near_copies", near_copies), ("personal_data", personal_data), ("mixture", mixture), ("sequences", sequences)]

#: Bit-exact SQL for trained models, signatures and token ids does not exist; ``tests/llm`` checks the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        folder = new_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
