"""Registered queries of the training-data operators: thin digests of the operators' outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coldlake.llm import chat, covertree, ctw, decontaminate, lines, merkle, mixing, negatives, packing, pii, sharding, simhash, toxicity
from coldlake.llm.common import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    counts = [pii.count_of(k).alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.written(pii.base_by_start()), 256).alias("base_sha256"),
                        pii.written(pii.all_spans()).alias("spans"), F.size("terms").cast("long").alias("n_term"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ctw.score(table(spark, sf_dir, "documents"))
    return found.select("doc_id", ctw.held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score",
                        (-F.col("score") / F.log10(F.lit(2.0)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"))


def op4_covertree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = covertree.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", "kept")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    crf = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    found = toxicity.score(docs, crf, ["doc_id"])
    return found.select("row.doc_id", toxicity.is_held_out(F.col("row.doc_id"), 4, 2).alias("held_out"), "score", "predicted",
                        F.transform("spans", lambda x: F.concat_ws(":", x["start"], x["end"])).alias("spans"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.judged(decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), "contaminated")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree, grown = sharding.ShardTree.uniform(16), sharding.ShardTree.uniform(17)
    found = sharding.assign_shards(table(spark, sf_dir, "documents"), tree, grown)
    return found.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    gone = lines.removals(docs).select(F.col("doc_id").alias("id"), F.col("t").alias("key"), "gone")
    count = F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long")
    mine = docs.select("doc_id", lines.text_key(F.col("text")).alias("t"), F.when(F.col("text").isNull(), 0).otherwise(count).cast("long").alias("n_lines"))
    joined = mine.join(gone, mine["doc_id"].eqNullSafe(gone["id"]) & (mine["t"] == gone["key"]), "left")
    return joined.select("doc_id", "n_lines", F.when(F.col("gone").isNull(), F.col("n_lines")).otherwise(F.col("n_lines") - F.size("gone")).alias("n_kept"),
                         F.coalesce(F.array_join(F.col("gone").cast("array<string>"), ","), F.lit("")).alias("removed_lines"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.audit(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2("siblings", 256).alias("proof_sha256"), "folded_root",
                        (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", moved), F.col("id") % 100 == 0)


QUERIES = {f.__name__: f for f in (op1_pii, op2_simhash, op3_ctw, op4_covertree, op5_chat, op6_toxicity, op7_packing, op8_decontaminate, op9_sharding, op10_lines,
                                  op11_merkle, op12_mixing, op13_negatives)}
ORACLE: dict[str, str] = {"op5_chat": chat.ORACLE_SQL, "op11_merkle": merkle.ORACLE_SQL, "op12_mixing": mixing.ORACLE_SQL, "op13_negatives": negatives.ORACLE_SQL}
