"""The registered queries opN_<name>: each applies its operator, with production parameters, to the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import collocations, fingerprint, langid, neardup, packing, ppm, quality, sentencepieces, sharding, tokencounts, topk, toxicity, turns
from .common import documents, scratch_path


def op1_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op2_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.verdicts(docs, labels).select("doc_id", "p_low_quality", "p_toxic", "rejected")


def op3_tiered_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = sharding.shard(documents(spark, sf_dir), scratch_path(spark, "shards"))
    of = F.col("shard")
    return table.located().select("row.doc_id", of["number"].alias("shard"), of["tier"].alias("tier"), of["rows"].alias("shard_rows"), of["version"].alias("version"))


def op4_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.count_tokens(documents(spark, sf_dir))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), carry={"ids_crc32": F.crc32("ids")})


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint.against_edited(documents(spark, sf_dir))
    return found.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def held_out(modulus: int, remainder: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = F.coalesce(held_out(5, 0), F.lit(False))
    model = langid.fit(docs, ~out)
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", out.alias("held_out"), "lang_pred", "score", "spans")


def op8_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir))


def op9_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = held_out(7, 2)
    scored = ppm.score(documents(spark, sf_dir), ~out)
    return scored.select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    both = sentencepieces.decode(sentencepieces.encode(docs))
    return both.select("doc_id", F.size("piece_ids").alias("n_pieces"), F.xxhash64("piece_ids").alias("ids_hash"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return turns.summarize(turns.damage(conversations), conversations)


def op12_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_host_quality": op1_host_quality,
    "op2_toxicity_chain": op2_toxicity_chain,
    "op3_tiered_sharding": op3_tiered_sharding,
    "op4_trie_token_counts": op4_trie_token_counts,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_winnowing": op6_winnowing,
    "op7_language_id": op7_language_id,
    "op8_minmax_near_dedup": op8_minmax_near_dedup,
    "op9_ppm_scores": op9_ppm_scores,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_turn_repair": op11_turn_repair,
    "op12_pivot_top_k": op12_pivot_top_k,
    "op13_collocations": op13_collocations,
}
