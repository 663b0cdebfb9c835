"""Pipeline over documents: a list of stages, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm.neardup import near_duplicates
from basketry.llm.pieces import encode
from basketry.llm.quality import good_only
from basketry.llm.surrogates import pseudonymise
from basketry.llm.winnowing import decontaminate
from basketry.session import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return good_only(docs.select(*COLUMNS))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays; of repeated rows with one doc_id, one.

    Rows without a doc_id stay, one of each text. Near are texts whose five-word shingles have a Jaccard similarity of
    0.8 or more; op4_near_duplicates has a threshold of its own.
    """
    docs = docs.select(*COLUMNS)
    kept = near_duplicates(docs, words=5, percent=80).where("kept").select("doc_id").distinct()
    named = docs.join(kept.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.where("doc_id is null").dropDuplicates(["text"]))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a ten-word window of a benchmark item go."""
    docs = docs.select(*COLUMNS)
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated")
    found = stage(found.select(F.col("doc_id").alias("bad_id"), "text_hash").distinct(), "contaminated")
    return docs.join(found, docs.doc_id.eqNullSafe(F.col("bad_id")) & (F.xxhash64("text") == F.col("text_hash")), "left_anti").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to surrogates; n_chars is that of the new text."""
    return pseudonymise(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids and the scores of the best segmentations, per document."""
    return encode(docs, n_best=3)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("piece_encoding", piece_encoding),
]
#: No SQL: a vocabulary, minhashes and n-best search are part of it. tests/llm holds it against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next; the last one's rows are returned."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
