"""The opN_ queries: each applies its operator to its whole table and derives the digest columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.llm import ann, chat, clustering, mixing, packing, periodic, pii, quality, secrets, sharding, simhash, substrings, token_store
from slotwise.llm.common import WORD, shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    counts = [F.expr(f"cast(size(filter(secret_spans, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in secrets.KINDS[:3]]
    base = secrets.spans_text(F.filter("secret_spans", lambda s: s["kind"] != "random"))
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), secrets.spans_text("secret_spans").alias("spans"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.apply_quality(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.drop("text")


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    path = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    token_store.write_token_ids(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), "bare", 1)
    return token_store.read_token_ids(spark, path)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), "led", 1)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", secrets.spans_text("pii_spans").alias("spans"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate_perspectives(_table(spark, sf_dir, "conversations"))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.order_by_curve(_table(spark, sf_dir, "documents"), law="rows")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text), where the checksum of one id in ten makes its text repeat itself from some word on."""
    words = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h")).withColumn("w", F.when(F.col("h") % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({WORD})"))))
    numbers = words.withColumn("g", F.expr("h div 10")).withColumn("n", F.size("w")).withColumn("a", F.expr("if(n > 0, cast(g % n as int), 0)")).withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    again = F.expr("array_join(transform(w, (x, i) -> if(i >= a, w[a + (i - a) % p], x)), ' ')")
    return numbers.select("doc_id", F.when(F.col("n") > 0, again).otherwise(F.col("text")).alias("text"))


def op12_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(with_planted_periods(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    named = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("l"), F.sha2(lines, 256).alias("runs_sha256"), "collapsed_sha256")
    columns = [(-F.col("l.start")).alias("start"), F.col("l.length").alias("length"), (-F.col("l.period")).alias("period"), F.expr("1000L * l.length div -l.period").alias("exponent_milli")]
    return named.select("doc_id", "n_runs", *[c.cast("long").alias(n) for c, n in zip(columns, ("start", "length", "period", "exponent_milli"))], "runs_sha256", "collapsed_sha256")


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster_vectors(_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_secrets, op2_quality, op3_substrings, op4_token_ids, op5_packing, op6_mixing, op7_pii, op8_chat, op9_ann, op10_simhash, op11_sharding, op12_periods, op13_clusters)}
