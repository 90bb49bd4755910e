"""Native detection: every pattern over the whole text, checksum gates, overlaps; no shuffle and no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import validators as V
from ..functions.patterns import SPECS, Spec

ENTITY = "array<struct<kind:string,start:int,end:int,value:string,confidence:double,cp_start:int,cp_end:int,ord:int>>"


def _none() -> Column:
    return F.expr(f"cast(array() as {ENTITY})")


def _matches(text: Column, spec: Spec, ord_: int, low: Column, digit: Column, ascii_words: bool) -> Column:
    """The pattern's matches as entities; offsets in bytes, cp_ ones in characters, both half-open."""
    java = spec.java_ascii if ascii_words else spec.java
    found, gaps = F.regexp_extract_all(text, F.lit(java), F.lit(0)), F.split(text, java, -1)
    zero = F.expr(f"named_struct('b', 0, 'c', 0, 'out', cast(array() as {ENTITY}))")

    def step(acc: Column, pair: Column) -> Column:
        b, c = acc["b"] + F.octet_length(pair["0"]), acc["c"] + F.length(pair["0"])
        eb, ec = b + F.octet_length(pair["1"]), c + F.length(pair["1"])
        e = F.struct(F.lit(spec.kind).alias("kind"), b.alias("start"), eb.alias("end"), pair["1"].alias("value"), F.lit(spec.confidence).alias("confidence"), c.alias("cp_start"), ec.alias("cp_end"), F.lit(ord_).alias("ord"))
        return F.struct(eb.alias("b"), ec.alias("c"), F.concat(acc["out"], F.array(e)).alias("out"))

    got = F.aggregate(F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("0"), found.alias("1")), zero, step, lambda acc: acc["out"])
    # most texts have no match: one search says so, where extracting and splitting are two whole passes
    guard = None
    for g in spec.guards:
        guard = F.contains(low, F.lit(g)) if guard is None else guard | F.contains(low, F.lit(g))
    if spec.digit:
        guard = digit if guard is None else digit & guard
    there = text.rlike(java)
    return F.coalesce(F.when(there if guard is None else guard & there, got), _none())


def candidates(text: str | Column, low: Column | None = None, digit: Column | None = None, ascii_words: bool = False) -> Column:
    """All kinds' matches before checksums and overlaps. Null text: empty. low, digit: columns that hold what guards look at.

    Words, digits and white space are Unicode's, as the reference has them, or with ``ascii_words`` those of RE2, as SQL has them.
    """
    text = F.col(text) if isinstance(text, str) else text
    low = F.lower(text) if low is None else low
    digit = text.rlike(r"(?U)\d") if digit is None else digit
    return F.concat(*[_matches(text, s, i, low, digit, ascii_words) for i, s in enumerate(SPECS)])


def checksum_ok(e: Column) -> Column:
    v = e["value"]
    return (
        F.when(e["kind"] == "credit_card", V.luhn_valid(v)).when(e["kind"] == "us_bank_routing", V.aba_valid(v))
        .when(e["kind"] == "ipv4", V.ipv4_valid(v)).when(e["kind"] == "iban", V.iban_valid(v)).when(e["kind"] == "ipv6", V.ipv6_valid(v)).otherwise(F.lit(True))
    )


def _longest_first(entities: Column) -> Column:
    """Longest first, ties as reported (ord, then place); what overlaps a kept one goes; sorted by (start, end)."""
    order = lambda a, b: F.when(a["end"] - a["start"] != b["end"] - b["start"], (b["end"] - b["start"]) - (a["end"] - a["start"])).when(a["ord"] != b["ord"], a["ord"] - b["ord"]).otherwise(a["start"] - b["start"])
    kept = F.aggregate(F.array_sort(entities, order), _none(), lambda acc, e: F.when(F.exists(acc, lambda k: (e["start"] < k["end"]) & (k["start"] < e["end"])), acc).otherwise(F.concat(acc, F.array(e))))
    return F.array_sort(kept, _by_place)


def _by_place(a: Column, b: Column) -> Column:
    return F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["end"] - b["end"])


def resolve_overlaps(entities: Column) -> Column:
    """Longest first, ties as reported (ord, then place); what overlaps a kept one goes; touching is fine; sorted by (start, end).

    Entities are taken by place, and those that hang together are settled among themselves, so that a text with
    many entities apart isn't compared pair by pair.
    """
    settled = lambda group: F.when(F.size(group) <= 1, group).otherwise(_longest_first(group))
    zero = F.struct(_none().alias("out"), _none().alias("group"), F.lit(0).alias("end"))

    def step(acc: Column, e: Column) -> Column:
        more = F.struct(acc["out"].alias("out"), F.concat(acc["group"], F.array(e)).alias("group"), F.greatest(acc["end"], e["end"]).alias("end"))
        new = F.struct(F.concat(acc["out"], settled(acc["group"])).alias("out"), F.array(e).alias("group"), e["end"].alias("end"))
        return F.when(e["start"] < acc["end"], more).otherwise(new)

    return F.aggregate(F.array_sort(entities, _by_place), zero, step, lambda acc: F.concat(acc["out"], settled(acc["group"])))


def hybrid_merge(primary: Column, secondary: Column) -> Column:
    """The primary's entities, and of the secondary those clear of them; a secondary one displaces kept secondaries only if longer than each it overlaps."""
    clash = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])

    def step(acc: Column, e: Column) -> Column:
        mine = F.filter(acc, lambda k: clash(e, k))
        longest = F.aggregate(mine, F.lit(0), lambda m, k: F.greatest(m, k["end"] - k["start"]))
        return F.when(F.exists(primary, lambda p: clash(e, p)) | (e["end"] - e["start"] <= longest), acc).otherwise(F.concat(F.filter(acc, lambda k: ~clash(e, k)), F.array(e)))

    return F.concat(primary, F.aggregate(secondary, _none(), step))


def detect(df: DataFrame, text: str = "text", out: str = "entities", ascii_words: bool = False) -> DataFrame:
    """``df`` with an array of entities: matches that pass their checksum, without overlaps. Null text: none."""
    # a column of its own for the candidates, so that they are found once
    got = df.withColumns({"__low": F.lower(text), "__digit": F.col(text).rlike(r"(?U)\d")}).withColumn("__candidates", candidates(text, F.col("__low"), F.col("__digit"), ascii_words))
    got = got.withColumn(out, resolve_overlaps(F.filter("__candidates", checksum_ok)))
    return got.drop("__candidates", "__low", "__digit")


def inspect(df: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), ascii_words: bool = False) -> DataFrame:
    """One row per entity: the keys, kind, start, end, confidence; never the value."""
    return detect(df.select(*keys, text), text, ascii_words=ascii_words).select(*keys, F.explode("entities").alias("e")).select(*keys, "e.kind", "e.start", "e.end", F.round("e.confidence", 2).alias("confidence"))
