"""A corpus from raw documents to packed training bins: five stages over the whole table.

Each stage works on all that the one before kept, and its result is a Parquet table that the next one reads. All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.llm import decontam, ngram_join, packing, quality, suffix_dedup
from quarrykit.llm.graph import with_group
from quarrykit.llm.storage import dropped, written
from quarrykit.shipping import ship


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the production policy keeps."""
    return quality.kept(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (five words, 0.8): the one with the smallest id, nulls last. Every row is a
    member of its own, so that repeated rows, rows without an id and other texts of the same id are compared too."""
    row = "_row"
    while row in docs.columns:
        row += "_"
    keyed = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = ngram_join.link_components(keyed, 5, 4, 5, row).select(F.col("id").alias(row), "component_id")
    ranked = found.join(keyed.select(row, "doc_id"), row).select(row, "component_id", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", row).alias("place"))
    goes = with_group(ranked, ["component_id"], row, first=(F.min, "place")).where(F.col(row) != F.col("first")[row]).select(row)
    return keyed.join(goes, row, "left_anti").select(*docs.columns)


def suffix_array(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 200 bytes that stand elsewhere too."""
    out = suffix_dedup.removed(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bestfit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row a piece of a document, with its bin."""
    return packing.pack(docs)


def _shipped(stage):
    return lambda spark, docs, sf_dir: stage(ship(spark), docs, sf_dir)


STAGES = [
    ("quality rules", _shipped(quality_rules)),
    ("n-gram Jaccard join", _shipped(ngram_jaccard)),
    ("suffix-array dedup", _shipped(suffix_array)),
    ("benchmark decontamination", _shipped(decontamination)),
    ("best-fit packing", _shipped(bestfit_packing)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for k, (name, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage{k}")
        if last is not None:
            dropped(last)
        last = docs
    return docs


#: Signature trees, byte-level suffixes and packing have no SQL; tests/llm compares with brute force.
ORACLE_SQL = None
