"""A corpus pipeline of the text operators: each stage works on what the one before it kept.

Defined cases, by what the stages define
- null, empty and wordless texts have the score 0 and go in the first stage, so none reach the others.
- no labels, or labels of one class only: one score for all texts with words, and all of them stay or go.
- repeated rows: one of them stays (near_duplicates). Null doc_ids stay if nothing speaks against their texts.
- null lang, source or n_chars: kept as they are; the mix counts a null source among the rest and a null size as 1.
- no benchmark items: nothing is contaminated. Long texts: whole in every stage.
- empty table: no rows, with the columns of the last stage. Extra columns, whatever their names, go through all stages
  but the last, which names where each document is: doc_id, shard, rows, bytes, tier and version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontamination, mixing, near_duplicates, quality_model
from tidemark.llm.common import written
from tidemark.llm.queries import MIX, MIX_BLOCK, sharded, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality_model.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return near_duplicates.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in files that follow the mix of sources."""
    return mixing.interleaved(docs, MIX, MIX_BLOCK)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents appended and compacted into target-sized shards: where each one is."""
    return sharded(spark, docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicate),
    ("decontamination", decontaminate),
    ("mix", mix),
    ("shards", shards),
]

#: No SQL for the classifier's fit or the near-duplicate sketches.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each one's rows written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
