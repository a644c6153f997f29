"""The corpus pipeline: quality, line and near duplicates, mixing, packing; a stage reads what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import line_dedup, mixing, packing, quality, simhash
from tidemark.llm.common import Workspace, table
from tidemark.llm.queries import MIX_WEIGHTS


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.quality_stage(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has go."""
    return line_dedup.line_dedup_stage(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return simhash.simhash_stage(docs)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at the rates that meet the target weights."""
    return mixing.mixing_stage(docs, mixing.domain_of(table(spark, sf_dir, "labels")), MIX_WEIGHTS, "good")


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences."""
    return packing.pack(docs)


STAGES = [("quality", keep_quality), ("line_dedup", drop_lines), ("simhash", one_of_each), ("mixing", mix_domains), ("packing", pack_tokens)]
#: The classifier, the rates and the packing have no SQL form; tests/llm holds the pipeline against its parts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again."""
    work, docs = Workspace(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = work.stage(stage(spark, docs, sf_dir), name)
    return docs
