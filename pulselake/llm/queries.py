"""One registered query for each corpus operator, with production parameters over its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulselake.llm.common import shared_path, table


def op1_rlz_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulselake.llm.rlz import duplicate_spans

    found = duplicate_spans(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulselake.llm.toxicity import score, train_from

    docs = table(spark, sf_dir, "documents")
    model = train_from(docs, table(spark, sf_dir, "labels"), ~held_out())
    scored = score(docs, model).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulselake.llm.secrets import scan

    found = scan(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("at").cast("long").alias("word_index"), F.col("place").cast("long").alias("place"), F.length("value").cast("long").alias("n_chars"), F.sha2("value", 256).alias("value_sha256"), F.round("score", 6).alias("score"), "is_secret")


def op4_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulselake.llm.line_runs import dedup_lines

    kept = dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", F.col("n_lines_").alias("n_lines"), F.col("n_dropped_").alias("n_dropped"), F.sha2("kept_", 256).alias("kept_sha256"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulselake.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulselake.llm.warc import page_of, read_warc, write_warc

    path = shared_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    full = read_warc(spark, path).where("record_type = 'response'")
    full = full.select("record_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", "refers_to")
    again = read_warc(spark, path, payload=False).where("record_type = 'revisit'")
    again = again.select("record_id", F.col("payload_length").alias("payload_bytes"), F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), "record_type", "refers_to")
    found = full.unionByName(again)
    return found.select(page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of(F.col("refers_to")).alias("refers_to"))


def op7_balltree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulselake.llm.balltree import top_k

    found = top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulselake.llm.decontaminate import decontaminate, verdict

    judged = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return verdict(judged).withColumnRenamed("id", "doc_id")


def op9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulselake.llm.mixture import mix

    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulselake.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), "word_bpe_49k.json")
