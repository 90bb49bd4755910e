"""The whole pipeline, one row a call: detect, check, judge, plan, check, transform, check; fail closed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.validators import placeholder_kind_valid
from ..runtime import written
from . import detect, judge, policy, transform, validate, vault

Contexts = policy.Context | dict[str, Column]


def columns_of(context: Contexts | None) -> dict[str, Column]:
    """A context for all rows, or the row's own columns by name."""
    return context if isinstance(context, dict) else (context or policy.Context()).columns()


def decide(entity: Column, ctx: dict[str, Column], matrix: policy.Matrix | None, label: Column, confidence: Column) -> Column:
    d = policy.matrix_policy(entity["kind"], ctx, matrix, label, confidence) if matrix else policy.default_policy(entity["kind"], ctx, label, confidence)
    return F.struct(*[entity[c].alias(c) for c in ("kind", "start", "end", "value", "confidence", "cp_start", "cp_end")], label.alias("label"), *[d[c].alias(c) for c in ("action", "reason", "matched_rule", "used_default")])


def plan(df: DataFrame, *, text: str = "text", context: Contexts | None = None, judged: bool = False, matrix: policy.Matrix | None = None, ascii_words: bool = False) -> DataFrame:
    """``df`` with plan: array of entities with label, action, reason, matched_rule, used_default. ascii_words: as in detect.candidates()."""
    ctx = columns_of(context)
    label = lambda e: judge.label(e["kind"], e["value"]) if judged else F.lit(None).cast("string")
    one = lambda e: decide(e, ctx, matrix, label(e), F.lit(judge.CONFIDENCE))
    return detect.detect(df, text, ascii_words=ascii_words).withColumn("plan", F.transform("entities", one)).drop("entities")


def blocked(plan: str = "plan") -> Column:
    return F.exists(plan, lambda e: e["action"] == "block")


def explain(df: DataFrame, *, text: str = "text", keys: tuple[str, ...] = ("doc_id",), strict: bool = True, **options) -> DataFrame:
    """One row per call: the keys, status, error, blocked and reasons (kind, start, end, action, reason, matched_rule, used_default); no vault, no values.

    ``strict``: a call whose text, in any case, or one of whose values holds a kind that was found, or a kind that no
    placeholder can hold, is refused (error ``kind_not_value_free``).
    """
    got = plan(df.select(*dict.fromkeys([*keys, text, *(c for c in df.columns if c not in keys)])), text=text, **options)
    names = lambda e: F.contains(F.lower(text), F.lower(e["kind"])) | F.contains(F.lower(e["value"]), F.lower(e["kind"])) | ~placeholder_kind_valid(e["kind"])
    refused = F.exists("plan", names) if strict else F.lit(False)
    error = F.when(F.col(text).isNull(), "no_text").when(refused, "kind_not_value_free")
    reasons = F.transform("plan", lambda e: F.struct(*[e[c].alias(c) for c in ("kind", "start", "end", "action", "reason", "matched_rule", "used_default")]))
    out = got.select(*keys, error.alias("error"), blocked().alias("blocked"), reasons.alias("reasons"))
    fine = F.col("error").isNull()
    return out.select(*keys, F.when(fine, "ok").otherwise("error").alias("status"), "error", F.when(fine, F.col("blocked")).alias("blocked"), F.when(fine, F.col("reasons")).alias("reasons"))


def finish(df: DataFrame, text: str, out: Column, error: Column | None = None) -> DataFrame:
    """``df`` (with plan) with status, error and clean_text, which is null unless the status is ok."""
    stop = blocked()
    early = F.when(F.col(text).isNull(), "no_text") if error is None else F.when(F.col(text).isNull(), "no_text").otherwise(error)
    got = df.withColumn("__early", early).withColumn("__out", F.when(F.col("__early").isNull() & ~F.coalesce(stop, F.lit(False)), out))
    late = F.when(F.col("__out").isNull(), "not_transformed").when(F.coalesce(validate.leaks(F.col("__out"), F.col("plan")), F.lit(False)), "value_left")
    got = got.withColumn("error", F.coalesce("__early", F.when(~F.coalesce(stop, F.lit(False)), late)))
    got = got.withColumn("status", F.when(F.col("error").isNotNull(), "error").when(stop, "blocked").otherwise("ok"))
    return got.withColumn("clean_text", F.when(F.col("status") == "ok", F.col("__out"))).drop("__out", "__early")


def sanitize(df: DataFrame, *, text: str = "text", transformer: str = "mask", **options) -> DataFrame:
    """``df`` with plan, status (ok, blocked, error), error and clean_text (null unless ok), for mask and generalize. Null text: error."""
    got = plan(df, text=text, **options)
    return finish(got, text, transform.rebuild(F.col(text), F.col("plan"), lambda e: transform.replacement(e, transformer)))


def wanted_mappings(planned: DataFrame, *, doc_id: str, scope: str) -> DataFrame:
    """(scope, kind, original, first, d) of what is to be pseudonymized in rows that aren't blocked."""
    rows = planned.where(~blocked()).select(F.col(scope).alias("scope"), F.col(doc_id).alias("d"), F.explode("plan").alias("e")).where("e.action = 'pseudonymize'")
    return rows.select("scope", F.col("e.kind").alias("kind"), F.col("e.value").alias("original"), F.struct("d", "e.start").alias("first"), "d")


def with_tokens(planned: DataFrame, mappings: DataFrame, *, doc_id: str, scope: str, text: str, error: Column | None = None) -> DataFrame:
    """finish() of planned rows whose pseudonymized entities stand as their mappings' tokens."""
    wanted = wanted_mappings(planned, doc_id=doc_id, scope=scope)
    maps = wanted.select("d", "scope", "kind", "original").distinct().join(mappings.select("scope", "kind", "original", "token"), ["scope", "kind", "original"])
    maps = maps.groupBy("d").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\x1f", "kind", "original").alias("k"), "token"))).alias("__tokens"))
    got = planned.join(maps.withColumnRenamed("d", doc_id), doc_id, "left")
    tok = lambda e: F.try_element_at("__tokens", F.concat_ws("\x1f", e["kind"], e["value"]))
    out = transform.rebuild(F.col(text), F.col("plan"), lambda e: transform.replacement(e, "pseudonymize", tok(e)))
    return finish(got, text, out, error).drop("__tokens")


def pseudonymize_all(df: DataFrame, *, key: bytes, doc_id: str = "doc_id", text: str = "text", scope: str = "source", mappings: DataFrame | None = None, counters: DataFrame | None = None, now: int = 0, planned: bool = False, error: Column | None = None, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows as sanitize() gives them, mappings, counters). Blocked rows mint nothing; ids are unique; the plan is made once."""
    got = df if planned else written(plan(df, text=text, **options), "plans")[0]
    usable = got if error is None else got.where(error.isNull())
    full, top = vault.mint(wanted_mappings(usable, doc_id=doc_id, scope=scope), mappings, counters, key, now)
    return with_tokens(got, full, doc_id=doc_id, scope=scope, text=text, error=error), full, top


def pseudonymize(df: DataFrame, *, key: bytes, stored: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """pseudonymize_all() without the counters."""
    rows, full, _ = pseudonymize_all(df, key=key, mappings=stored, **options)
    return rows, full
