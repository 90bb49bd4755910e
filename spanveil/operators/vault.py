"""Scoped reversible mappings as two tables: mappings (scope, kind, original, token, counter, created_at) and counters (scope, kind, value).

Tokens end in a keyed HMAC, so that a retried task mints the same one; counters run from 1 within (scope, kind) in
order of first appearance.  Counters outlive the mappings that expire, so a number isn't used again before its
scope is forgotten.
"""

from __future__ import annotations

import hmac

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.validators import PLACEHOLDER, PREFIX, is_minted
from ..runtime import written

KEYS = ["scope", "kind", "original"]


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Hex HMAC-SHA256 of a string column, Arrow batch by batch; the key travels with the function, so that no plan or event log shows it."""

    @F.pandas_udf("string")
    def tag(v: pd.Series) -> pd.Series:
        return v.map(lambda m: None if m is None else hmac.new(key, m.encode(), "sha256").hexdigest())

    return tag(message)


def token(key: bytes, scope: Column, kind: Column, original: Column, counter: Column) -> Column:
    mark = F.upper(F.substring(hmac_sha256(key, F.concat_ws("\x1f", scope, kind, original)), 1, 16))
    return F.concat(F.lit(PREFIX), F.upper(kind), F.lit("_"), counter.cast("string"), F.lit("_"), mark, F.lit("__"))


def numbered(new: DataFrame) -> DataFrame:
    """``new`` (scope, kind, original, first) with n: 1, 2 and so on within (scope, kind) by first, original.

    In two levels: rows within a range of that order, and totals of the ranges, so that a hot scope isn't one task's.
    """
    ranged, _ = written(new.repartitionByRange("scope", "kind", "first", "original").withColumn("__part", F.spark_partition_id()), "new-mappings")
    own = Window.partitionBy("scope", "kind", "__part").orderBy("first", "original")
    sizes = ranged.groupBy("scope", "kind", "__part").agg(F.count(F.lit(1)).alias("__size"))
    before = F.coalesce(F.sum("__size").over(Window.partitionBy("scope", "kind").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    got = ranged.withColumn("__row", F.row_number().over(own)).join(sizes.withColumn("__before", before), ["scope", "kind", "__part"])
    return got.withColumn("n", (F.col("__row") + F.col("__before")).cast("long")).drop("__row", "__before", "__part", "__size")


def mint(wanted: DataFrame, mappings: DataFrame | None, counters: DataFrame | None, key: bytes, now: int = 0) -> tuple[DataFrame, DataFrame]:
    """(mappings, counters) with a mapping for every (scope, kind, original) of ``wanted`` (and its ordering column ``first``).

    Mappings that have a minted token stay; a token of another form never resolves, so its mapping is replaced if it is
    wanted.  A counter beyond a long is an overflow error.
    """
    new = wanted.groupBy(*KEYS).agg(F.min("first").alias("first"))
    if mappings is not None:
        new = new.join(mappings.where(is_minted(F.col("token"))), KEYS, "left_anti")
    new = numbered(new)
    top = None if mappings is None else mappings.groupBy("scope", "kind").agg(F.max("counter").alias("value"))
    if counters is not None:
        top = counters.select("scope", "kind", "value") if top is None else top.unionByName(counters.select("scope", "kind", "value")).groupBy("scope", "kind").agg(F.max("value").alias("value"))
    if top is None:
        new = new.withColumn("counter", F.col("n"))
    else:
        new = new.join(top, ["scope", "kind"], "left").withColumn("counter", F.col("n") + F.coalesce("value", F.lit(0)))
    new = new.select(*KEYS, token(key, F.col("scope"), F.col("kind"), F.col("original"), F.col("counter")).alias("token"), "counter", F.lit(now).cast("long").alias("created_at"))
    new, _ = written(new, "minted")
    used = new.groupBy("scope", "kind").agg(F.max("counter").alias("value"))
    counters = (used if top is None else top.unionByName(used)).groupBy("scope", "kind").agg(F.max("value").alias("value"))
    return (new if mappings is None else mappings.join(new, KEYS, "left_anti").select(*new.columns).unionByName(new)), counters


def get_or_insert(wanted: DataFrame, mappings: DataFrame | None, key: bytes, now: int = 0) -> DataFrame:
    """mint() where no counters are kept: they go on from the largest of the mappings."""
    return mint(wanted, mappings, None, key, now)[0]


def live(mappings: DataFrame, now: int, ttl: int | None) -> DataFrame:
    """Mappings younger than ``ttl`` seconds; undated ones count from now; no ttl: all. Counters don't expire."""
    return mappings if ttl is None else mappings.withColumn("created_at", F.coalesce("created_at", F.lit(now))).where(F.lit(now) - F.col("created_at") < ttl)


def forget(table: DataFrame, scope: str | DataFrame) -> DataFrame:
    """Mappings, or counters, without those of a scope, or of the scopes of a table (scope)."""
    return table.where(F.col("scope") != scope) if isinstance(scope, str) else table.join(scope.select("scope"), "scope", "left_anti").select(*table.columns)


def resolve(tokens: DataFrame, mappings: DataFrame) -> DataFrame:
    """``tokens`` (scope, token and others) with kind and original, where the token is minted and of that scope."""
    return tokens.join(mappings.where(is_minted(F.col("token"))).select("scope", "token", "kind", "original"), ["scope", "token"])


def restore(df: DataFrame, vault: DataFrame, *, key: str, text: str, scope: str, minted: bool = True) -> DataFrame:
    """(key, text, resolved): tokens of the row's own scope replaced by their originals in one pass, others untouched; of ``minted`` form only, unless a process minted them."""
    found = F.regexp_extract_all(F.col(text), F.lit(PLACEHOLDER), F.lit(0))
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(scope).alias("scope"), F.split(F.col(text), PLACEHOLDER, -1).alias("gaps"), found.alias("found"))
    tokens = rows.select("k", "scope", F.explode(F.array_distinct("found")).alias("token")).join(vault.where(is_minted(F.col("token")) | F.lit(not minted)).select("scope", "token", "original"), ["scope", "token"])
    maps = tokens.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("token", "original"))).alias("m"))
    got = rows.join(maps, "k", "left").withColumn("m", F.coalesce("m", F.expr("cast(map() as map<string,string>)")))
    out = F.array_join(F.zip_with(F.col("gaps"), F.col("found"), lambda g, f: F.concat(g, F.when(f.isNull(), "").otherwise(F.coalesce(F.try_element_at("m", f), f)))), "")
    return got.select(F.col("k").alias(key), out.alias("text"), F.size(F.filter("found", lambda f: F.map_contains_key("m", f))).alias("resolved"))
