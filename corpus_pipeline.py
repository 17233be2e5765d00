"""A training corpus from documents: quality, exact dedup, near dedup, mix, packing. Part of sigloom.llm.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last give documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sigloom.llm._common import materialize, read_table
from sigloom.llm.exact_dedup import exact_dedup, query_index
from sigloom.llm.mixing import mix_documents
from sigloom.llm.near import near_dedup
from sigloom.llm.packing import pack
from sigloom.llm.quality import quality_filter


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_filter(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    index = query_index(spark, "pipeline")
    kept = exact_dedup(docs, index, batches=2)
    index.drop()
    return kept


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixed), ("packing", packed)]

#: SimHash links, pivotal rounding and best fit cannot be told in SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
