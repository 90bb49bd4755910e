"""The opN_ queries over whole tables, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ensure_importable, fresh_path, written
from . import bpe, chat_format, embed_dedup, line_dedup, media, mix, quality, simhash, suffix_dedup, token_counts
from .common import table


def _tokenizer() -> tuple[str, str]:
    import public_tokenizers as p

    return p.path("byte_bpe_50k.tiktoken"), p.PATTERN


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_importable(spark)
    got = line_dedup.delete_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_lines", "n_removed", F.octet_length("text").cast("long").alias("kept_bytes"), F.sha2("text", 256).alias("kept_sha256"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    ok = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", ok), (-1, 1, "assistant", ok)], t.schema)
    return chat_format.read_back(chat_format.format_chats(t.unionByName(own)))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_importable(spark)
    got, _ = written(simhash.fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text")), "simhash")
    unsigned = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return simhash.group(got).select("doc_id", unsigned.alias("fingerprint"), "component_id")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_importable(spark)
    return bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), *_tokenizer())


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_importable(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranker = quality.train(docs, table(spark, sf_dir, "labels"))
    got = quality.score(docs, ranker, keep_text=False)
    return got.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality.CUT).cast("int").alias("predicted"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_importable(spark)
    return embed_dedup.link_vectors(table(spark, sf_dir, "embeddings"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_importable(spark)
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mix.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return got.select("doc_id", "size", "source_size", "target", "taken")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_importable(spark)
    return token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), _tokenizer()[0])


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_importable(spark)
    folder = fresh_path(spark, "media")
    media.write_archives(table(spark, sf_dir, "documents"), folder)
    got = media.describe(media.read_archives(spark, folder, onerror="fail"), fail=True)  # every row is a whole result
    return got.select(F.col("key").cast("long").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_line_dedup, op2_chat_formatting, op3_simhash, op4_byte_bpe, op5_quality, op6_embedding_dedup, op7_suffix_dedup, op8_mix_sources, op9_token_counts, op10_media_columns)}

SQL: dict[str, str] = {"op2_chat_formatting": chat_format.SQL, "op6_embedding_dedup": embed_dedup.SQL, "op7_suffix_dedup": suffix_dedup.SQL, "op8_mix_sources": mix.SQL, "op9_token_counts": token_counts.sql(_tokenizer()[0])}
