"""Corpus pipeline: documents that the quality classifier accepts, without lines that earlier ones have, one of
each near-duplicate group, mixed to source weights, as byte-level BPE ids.

Each stage takes (spark, docs, sf_dir) and all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.llm import bpe, line_dedup, mix, near, quality
from spanveil.llm.common import table
from spanveil.runtime import drop_written, ensure_importable, written


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.3 or more; the classifier learns from the labels that aren't held out.

    Null texts count as empty ones; repeated rows share a fate; an empty table gives an empty table.
    """
    ensure_importable(spark)
    ranker = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, ranker).where(F.col("score") >= quality.CUT).select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Aligned blocks that an earlier document has go, and documents of which nothing but white space is left by that; n_chars follows."""
    ensure_importable(spark)
    got = line_dedup.delete_repeats(docs).where((F.col("n_removed") == 0) | (F.trim(F.translate("text", "\n\t\r\x0b\x0c", "     ")) != ""))
    return got.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more): the one with the least id.

    Fingerprints are searched by the generalised pigeonhole, and a pair that it finds is a link only if the exact Jaccard
    similarity of the two shingle sets is 0.8 or more, so every document that goes has a partner of that similarity.
    Rows are told apart by all their columns: of a group stays the least by id (null last), then by md5 of the
    text (null first), then by a hash of the row; of rows equal in all columns one.
    """
    ensure_importable(spark)
    order = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("id"), F.coalesce(F.md5("text"), F.lit("")).alias("md5"), F.xxhash64(*docs.columns).alias("row"))
    # shingles take twice the room of the texts, so they are made again for the few texts that others are near to
    sets, _ = written(near.sets_of(docs.select(order.alias("o"), "text"), members=False), "fingerprints")
    stay = near.group(sets, "o", near.sets_of(docs.select("text"), bits=False)).where(F.col("o").eqNullSafe(F.col("component_id")))
    stay = stay.select(F.to_json("o").alias("__key")).distinct()
    return docs.withColumn("__key", F.to_json(order)).join(stay, "__key", "left_semi").drop_duplicates(["__key"]).select(*docs.columns)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources to weights 5, 2, 1: a document comes as often as the mix takes it, up to 3 times.

    A null source is the last one; documents without words come with those before them in their queue, once if
    their source has no words at all; repeated rows share a fate; an empty table gives an empty table.
    """
    mixed = mix.mix_sources(docs, carry=tuple(c for c in docs.columns if c != "doc_id"))
    return mixed.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and ids of each text, and decoded_ok: whether the ids decode to it. Null and empty texts have no ids; rows that repeat come out each."""
    import public_tokenizers as p

    ensure_importable(spark)
    return bpe.encode_checked(docs.select("doc_id", "source", "text"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_filter),
    ("line_dedup", line_dedup_stage),
    ("simhash", simhash_stage),
    ("mix", mix_stage),
    ("bpe", bpe_stage),
]

#: Training, alignment and components aren't SQL; tests/llm tests the operators against brute force and the stages on a small table.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each on the written table of the one before; other tables go as soon as a stage is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, path = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop_written(spark, keep=(path,))
    return STAGES[-1][1](spark, docs, sf_dir)
