"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

Counted as part of the subpackage ``tidelake.llm``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelake.llm import byte_bpe, common, decontaminate, line_dedup, near_dedup, quality_rules

#: (name, function of (spark, docs, sf_dir)); all but the last return the columns of documents.
STAGES = [
    ("quality_rules", quality_rules.stage),
    ("line_dedup", line_dedup.stage),
    ("near_dedup", near_dedup.stage),
    ("decontaminate", decontaminate.stage),
    ("byte_bpe", byte_bpe.stage),
]

#: Near-duplicate groups, MinHash candidates and token ids can't be put into SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
