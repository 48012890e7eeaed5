"""From raw documents to packed sequences: each stage is written as Parquet and read back as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from framequill.llm.exact_dedup import exact_dedup, on_files, without_rows
from framequill.llm.language_id import identified, in_fold, train
from framequill.llm.mixing import mix_documents
from framequill.llm.near_dedup import near_components
from framequill.llm.packing import best_fit
from framequill.session import load, scratch_mark, small_batches, spool, sweep


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents accepted as one of the languages learned from the rows themselves."""
    small_batches(spark)
    return identified(docs, train(docs, "doc_id", "text", "lang", in_fold("doc_id", 4) != 2))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each set of texts that are equal without white space."""
    placed = on_files(docs)
    return without_rows(placed, exact_dedup(placed).where("not kept")).select(docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate component, the one with the smallest identifier; rows without words all stay."""
    placed = on_files(docs)
    return without_rows(placed, near_components(placed).where("not stays")).select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to target weights; a row for each copy."""
    return mix_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with the sequence they are packed into."""
    return best_fit(docs)


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The near-duplicate stage's components, the mix and the packing are no single SQL statement.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order; what a stage wrote on its way goes when its result is there, and so does the result before it."""
    docs = load(spark, sf_dir, "documents")
    mark = scratch_mark()
    for name, stage in STAGES:
        docs = spool(stage(spark, docs, sf_dir), name)
        sweep(spark, mark, keep=1)
    return docs
