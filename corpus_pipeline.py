"""A training-data pipeline over ``documents``: each stage's result is written as Parquet and read by the next.

Cases, as each operator's module says: null and empty texts fail the quality
rules; in the later stages they are empty texts, one of which stays; repeated
rows are copies; null ids come first; an empty table passes through empty;
columns of any further name are carried to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panewise.llm import common, packing, quality_rules, simhash, suffix_dedup, toxicity


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.quality_rules(docs).where("kept").select(*docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.5 by a lexicon learned from the stage's own labelled documents."""
    lexicon = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.apply_lexicon(docs, lexicon, docs.columns).where("score < 0.5").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more)."""
    return simhash.drop_near_copies(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 100-byte strings that also start earlier; n_chars follows the text."""
    cut = suffix_dedup.remove_repeats(docs, with_text=True, carry=docs.columns)
    return cut.withColumns({"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 4096 tokens, mixed by source."""
    return packing.pack(docs)


STAGES = [("quality rules", quality), ("toxicity", toxic), ("SimHash near-dedup", near_dedup), ("suffix-array dedup", substring_dedup), ("packing", pack)]
#: SQL cannot express these stages; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = common.Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
