"""Exact-span scoring of detections, its gate, and checks of annotated corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def matched(truth: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """The keys, kind, start, end, t, f (true or null): spans in truth and among the found; equal spans match one to one."""
    on = [*keys, "kind", "start", "end", "__n"]
    number = lambda d: d.select(*on[:-1]).withColumn("__n", F.row_number().over(Window.partitionBy(*on[:-1]).orderBy(F.lit(0))))
    return number(truth).withColumn("t", F.lit(True)).join(number(found).withColumn("f", F.lit(True)), on, "full_outer").drop("__n")


def score_spans(truth: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 per kind and (kind null) in all; undefined: null."""
    got = matched(truth, found, keys).rollup("kind").agg(F.count_if(F.col("t") & F.col("f")).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("f").isNull()).alias("fn"))
    p, r = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    return got.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def gate(cases: DataFrame, truth: DataFrame, found: DataFrame, mode: str, key: str = "id") -> DataFrame:
    """(key, wrong): the cases gated for ``mode`` (column gate_modes) that have false or missing spans, and how many; none: the gate passes."""
    wrong = matched(truth, found, [key]).where("t is null or f is null").groupBy(key).agg(F.count(F.lit(1)).alias("wrong"))
    return cases.where(F.array_contains("gate_modes", mode)).select(key).join(wrong, key)


def corpus_errors(cases: DataFrame, key: str = "id") -> DataFrame:
    """(key, error) of cases (id, category, text, entities of kind, surface, start_char, end_char): missing metadata, an id twice, a surface that isn't its span."""
    surface = lambda e: F.coalesce(F.substr("text", e["start_char"] + 1, e["end_char"] - e["start_char"]) == e["surface"], F.lit(False)) & (e["start_char"] >= 0) & (e["end_char"] > e["start_char"])
    twice = F.coalesce(F.col("__n") > 1, F.lit(False))
    counts = cases.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    error = (
        F.when(F.coalesce(F.trim(key), F.lit("")) == "", "no_id").when(twice, "id_twice").when((F.coalesce(F.trim("category"), F.lit("")) == "") | F.col("text").isNull(), "no_metadata")
        .when(F.exists("entities", lambda e: F.coalesce(F.trim(e["kind"]), F.lit("")) == ""), "no_kind").when(F.exists("entities", lambda e: ~surface(e)), "surface")
    )
    return cases.join(counts, key, "left").select(key, error.alias("error")).where("error is not null").distinct()
