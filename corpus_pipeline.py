"""The text-preparation stages in a row; each is written as Parquet and reread as the next one's docs.

A stage returns a DataFrame that is not written yet, and leaves the scratch tables that it is read from. So stages may be called
one on the other, and each result be read as often and as late as one likes; run() deletes the tables once a stage is written.
Texts of any length pass whole through every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.llm import jaccard, mixing, packing, pii, quality
from slotwise.llm import common
from slotwise.llm.common import WORD

#: The columns of documents, which all stages but the last return.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null, empty and short texts go; of equal rows all stay or go; an empty table stays empty."""
    return quality.apply_quality(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: texts linked by a Jaccard similarity of 0.8 of their five-word shingles.

    Of a group the smallest doc_id stays (nulls last), of equal ids one row. All texts without words are one group.
    """
    return jaccard.deduplicate(docs.select(*COLUMNS))


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars is the length of the text, 0 for a null one, which stays null."""
    clean = pii.redact_pii(pii.find_pii(docs.select(*COLUMNS)))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.lit(0).cast("long"))).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document.

    The document at a source's cut is shortened to the words taken, joined by one space each. Documents without
    words (null, empty or blank texts) add nothing to a mix and go. Null is a source of its own.
    """
    mixed = mixing.mix_sources(docs, carry=("text", "lang", "n_chars")).where("taken > 0")
    copies = mixed.withColumn("left", F.explode(F.expr("transform(sequence(0L, (taken - 1) div size), i -> least(size, taken - i * size))")))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})")), 1, F.col("left").cast("int")), " ")
    short = F.col("left") < F.col("size")
    whole = copies.withColumn("text", F.when(short, cut).otherwise(F.col("text")))
    return whole.withColumn("n_chars", F.when(short, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 2048 token ids; a null or empty text is its end id alone, each row a document of its own."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), "led", 1)


STAGES = [("quality_rules", quality_rules), ("simhash_near_dedup", near_dedup), ("pii", pii_redaction), ("mixing", source_mix), ("packing", pack)]

#: Shingles' similarity, the scores of contexts and token ids can't be had in SQL; tests/llm/test_pipeline.py compares with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; what a stage wrote on its way, and its input, go once its result is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = common.new_path(spark, f"stage-{name}")
        with common.scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            common.delete(spark, before)
        before = path
    return docs
