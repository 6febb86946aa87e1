"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept, and is written as Parquet and reread. All
but the last return the columns of documents; rows with null or repeated doc_ids pass like any others, and an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontam, lines, packing, rules, shingles
from lodestone.llm.common import documents, materialise, narrow, wide


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return wide(rules.judge(narrow(docs)).where("rules.kept"), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier line equals or nearly equals; n_chars follows the text."""
    found = lines.remove_lines(docs)
    size = F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars")
    return found.select(*(size if c == "n_chars" else F.col(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group that pairs with four fifths of their five-word shingles in common connect."""
    found = shingles.near_duplicates(docs, shingle=5, percent=80)
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_first")).distinct()
    return docs.join(first.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(first["_first"]), "left_semi")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of ten words with a benchmark item."""
    found = decontam.phrase_matches(narrow(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return wide(found.where(F.size("hits") == 0), docs)


def harmonic_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, in sequences of 4096 tokens."""
    return packing.pack(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("packing", harmonic_packing),
]

#: The rules' fit, the shingle hashes and the tokenizer are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
