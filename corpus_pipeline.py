"""The corpus pipeline: documents in, packed sequences out.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and
returns a DataFrame; ``run`` writes each result as Parquet to the shared folder and
reads it again for the next.  All stages but the last return the columns of the
documents, whatever these are.

Every stage takes null, empty and very long texts, null and repeated ids, ties, repeated
rows, empty tables and columns of any name.  A null text counts as empty: it fails the
quality rules, loses no line, is a copy of other texts without words, is clean and packs
as the end id alone.  Rows of one doc_id and text share their fate, and near_dedup keeps
one of them; of ties the smallest doc_id stays, one that is null only if all are.  An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.cluster import written
from tickloom.llm import decontaminate, linededup, nearcopies, packing, quality
from tickloom.llm.common import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the isolation forest reject go."""
    return quality.good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines and of long lines go from the texts; every document stays, if need be empty."""
    return linededup.deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by a similarity of 0.8 in five-word shingles the smallest doc_id stays.

    SimHash fingerprints in BK-trees, and MinHash bands beyond their radius, propose what is compared exactly.
    """
    return nearcopies.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left and their places in sequences."""
    return packing.packed(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Isolation forests, near copies and tokenizers are beyond SQL; tests hold run() against the five stages in plain
#: Python (tests/llm/test_whole_pipeline.py).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
