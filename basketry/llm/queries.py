"""Queries over the operators, with production parameters and whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm import oracles
from basketry.llm.hard_negatives import mine, quantised
from basketry.llm.licences import scan
from basketry.llm.neardup import near_duplicates
from basketry.llm.pieces import encode
from basketry.llm.prefix_trie import rebuilt_keys, trie_of_keys
from basketry.llm.quality import quality
from basketry.llm.shards import shard
from basketry.llm.simhash import simhash_duplicates
from basketry.llm.substrings import repeated_spans
from basketry.llm.surrogates import pseudonymise
from basketry.llm.templates import extract
from basketry.llm.transcripts import fit, marked_turns, parse, raw_transcripts
from basketry.llm.winnowing import decontaminate

QUERIES = {}
ORACLES = {"op3_winnowing": oracles.WINNOWING, "op4_near_duplicates": oracles.NEAR_DUPLICATES, "op11_prefix_trie": oracles.PREFIX_TRIE, "op12_cover_negatives": oracles.HARD_NEGATIVES}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=5, percent=85)


@query
def op10_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules over all documents."""
    return quality(table(spark, sf_dir, "documents"))


@query
def op5_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents that stay when repeated 400-byte strings go."""
    return repeated_spans(table(spark, sf_dir, "documents"), length=400).drop("spans")


@query
def op7_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best segmentations of all documents."""
    return encode(table(spark, sf_dir, "documents"), n_best=3)


@query
def op2_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes."""
    return shard(table(spark, sf_dir, "documents"), shards=40)


@query
def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that lie in ten-word windows of the benchmark."""
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


@query
def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with personal data replaced by keyed surrogates."""
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op6_licence_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licences among all whole documents."""
    return scan(table(spark, sf_dir, "documents"))


@query
def op1_template_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract(table(spark, sf_dir, "pages"))


@query
def op9_transcript_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns recovered from all conversations as plain logs, cut into pieces anywhere.

    The labelled sample that the model is fitted on are the turns of the even conversations.
    """
    talks = table(spark, sf_dir, "conversations")
    return parse(raw_transcripts(talks), fit(marked_turns(talks).where(F.pmod("conv_id", F.lit(2)) == 0)))


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prefix of all rebuilt conversations."""
    return trie_of_keys(rebuilt_keys(table(spark, sf_dir, "conversations")))


@query
def op12_cover_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth embedding among all embeddings."""
    return mine(quantised(table(spark, sf_dir, "embeddings")))


@query
def op13_simhash_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash near-duplicate classes of all documents."""
    return simhash_duplicates(table(spark, sf_dir, "documents"), words=4, bits=4)
