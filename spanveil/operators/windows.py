"""Overlapping windows of long texts for model stages, and decoding of what models return."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def char_windows(df: DataFrame, *, text: str = "text", size: int = 1024, overlap: int = 128) -> DataFrame:
    """``df`` by windows: window_no (long), cp_start, byte_start, piece. Null and empty texts have none; overlap < size."""
    step = size - min(overlap, size - 1)
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - size) / F.lit(float(step)))).cast("long")
    every = F.when(F.length(text) > 0, F.sequence(F.lit(0).cast("long"), last)).otherwise(F.expr("cast(array() as array<bigint>)"))
    got = df.withColumn("window_no", F.explode(every)).withColumn("cp_start", (F.col("window_no") * step).cast("int"))
    return got.withColumn("byte_start", F.octet_length(F.substr(text, F.lit(1), F.col("cp_start")))).withColumn("piece", F.substr(text, F.col("cp_start") + 1, F.lit(size)))


def _aligned(raw: Column, at: Column) -> Column:
    """The place of the character that byte ``at`` (from 0) lies in."""
    inside = lambda p: F.coalesce(F.hex(F.substr(raw, p + 1, F.lit(1))).rlike("^[89AB]"), F.lit(False))
    return F.when(~inside(at), at).when(~inside(at - 1), at - 1).when(~inside(at - 2), at - 2).otherwise(at - 3)


def byte_windows(df: DataFrame, *, text: str = "text", size: int = 1024, overlap: int = 128) -> DataFrame:
    """``df`` by windows of at most ``size`` bytes: window_no (long), byte_start, byte_end, piece; cuts go back to the start of a character.

    ``size`` is 4 at least, the overlap size - 1 at most. Null and empty texts have none.
    """
    step = size - min(overlap, size - 1)
    n = F.octet_length(text)
    last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(float(step)))).cast("long")
    every = F.when(n > 0, F.sequence(F.lit(0).cast("long"), last)).otherwise(F.expr("cast(array() as array<bigint>)"))
    got = df.withColumn("window_no", F.explode(every)).withColumn("__raw", F.encode(text, "utf-8"))
    got = got.withColumn("byte_start", _aligned(F.col("__raw"), (F.col("window_no") * step).cast("int")))
    got = got.withColumn("byte_end", _aligned(F.col("__raw"), F.least(F.octet_length("__raw"), (F.col("window_no") * step + size).cast("int"))))
    return got.withColumn("piece", F.decode(F.substr("__raw", F.col("byte_start") + 1, F.col("byte_end") - F.col("byte_start")), "utf-8")).drop("__raw")


def token_windows(n: Column, size: int, overlap: int) -> Column:
    """Array of struct(start, end) over n tokens; the overlap is half the size at most; no tokens: none."""
    step = max(1, size - min(overlap, size // 2))
    last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(float(step)))).cast("int")
    one = lambda k: F.struct((k * step).alias("start"), F.least(n.cast("int"), k * step + size).alias("end"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), one)).otherwise(F.expr("cast(array() as array<struct<start:int,end:int>>)"))


def argmax_tags(tokens: Column, labels: tuple[str, ...]) -> Column:
    """bio_decode()'s rows of token rows (start, end, logits): each token's first largest logit and its label; null if any logit isn't finite."""
    names = F.array(*map(F.lit, labels))
    one = lambda t: F.struct(F.element_at(names, F.array_position(t["logits"], F.array_max(t["logits"])).cast("int")).alias("tag"), t["start"].alias("start"), t["end"].alias("end"), F.array_max(t["logits"]).alias("logit"))
    odd = F.exists(tokens, lambda t: (F.size(t["logits"]) != len(labels)) | F.exists(t["logits"], lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return F.when(~odd, F.transform(tokens, one))


def decode_spans(spans: Column, size: Column, threshold: float = 0.5) -> Column:
    """Model spans (label, start, end, score) at or over the threshold that lie in the text; scores clamped to 1; NaN drops out."""
    fine = F.filter(spans, lambda s: ~F.isnan(s["score"]) & (s["score"] >= threshold) & (s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= size))
    return F.transform(fine, lambda s: F.struct(F.replace(F.lower(F.trim(s["label"])), F.lit(" "), F.lit("_")).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.least(s["score"], F.lit(1.0)).alias("confidence")))


def bio_decode(tokens: Column) -> Column:
    """Spans of token rows (tag, start, end, logit): B- opens, I- of the same label goes on, score: the largest sigmoid; (0, 0) offsets are skipped."""
    zero = F.expr("cast(array() as array<struct<kind:string,start:int,end:int,score:double>>)")

    def step(acc: Column, t: Column) -> Column:
        score = 1 / (1 + F.exp(-t["logit"]))
        label, last = F.substr(t["tag"], F.lit(3)), F.try_element_at(acc["out"], F.lit(-1))
        goes_on = acc["open"] & F.startswith(t["tag"], F.lit("I-")) & (last["kind"] == label)
        new = F.struct(label.alias("kind"), t["start"].alias("start"), t["end"].alias("end"), score.alias("score"))
        longer = F.struct(last["kind"].alias("kind"), last["start"].alias("start"), t["end"].alias("end"), F.greatest(last["score"], score).alias("score"))
        return (
            F.when((t["start"] == 0) & (t["end"] == 0), acc)
            .when(t["tag"] == "O", F.struct(F.lit(False).alias("open"), acc["out"].alias("out")))
            .when(F.coalesce(goes_on, F.lit(False)), F.struct(F.lit(True).alias("open"), F.concat(F.slice(acc["out"], 1, F.size(acc["out"]) - 1), F.array(longer)).alias("out")))
            .otherwise(F.struct(F.lit(True).alias("open"), F.concat(acc["out"], F.array(new)).alias("out")))
        )

    return F.aggregate(tokens, F.struct(F.lit(False).alias("open"), zero.alias("out")), step, lambda acc: acc["out"])
