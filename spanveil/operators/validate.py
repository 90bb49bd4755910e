"""Checks of what stages hand on; each gives an error code, null if fine. Codes name no value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.validators import is_secret_kind

# Fixed values.
ACTIONS = ("keep", "pseudonymize", "redact", "block")
LABELS = ("personal", "business", "test", "secret")


def span_error(e: Column, text: Column) -> Column:
    """The first reason why an entity can't stand in its text."""
    raw = F.encode(text, "utf-8")
    bad_cut = lambda at: F.coalesce(F.hex(F.substr(raw, at + 1, F.lit(1))).rlike("^[89AB]"), F.lit(False))
    return (
        F.when(e["start"].isNull() | e["end"].isNull() | e["value"].isNull() | e["kind"].isNull(), "span_missing")
        .when(bad_cut(e["start"]) | bad_cut(e["end"]), "span_boundary").when((e["end"] > F.octet_length(text)) | (e["start"] < 0), "span_bounds").when(e["start"] >= e["end"], "span_empty")
        .when(F.decode(F.substr(raw, e["start"] + 1, e["end"] - e["start"]), "utf-8") != e["value"], "span_value").when(F.trim(e["kind"]) == "", "span_kind")
        .when(F.contains(e["kind"], e["value"]), "span_kind_has_value").when(~F.coalesce(e["confidence"].between(0, 1), F.lit(False)) | F.isnan(e["confidence"]), "span_confidence")
    )


def spans_error(entities: Column, text: Column) -> Column:
    """The first entity's error; null entities: spans_missing."""
    found = F.filter(F.transform(entities, lambda e: span_error(e, text)), lambda c: c.isNotNull())
    return F.when(entities.isNull(), "spans_missing").otherwise(F.try_element_at(found, F.lit(1)))


def plan_error(plan: Column, entities: Column) -> Column:
    """A plan has the entities in their order, known actions, and secrets are redacted or blocked."""
    same = lambda p, e: p["kind"].eqNullSafe(e["kind"]) & p["start"].eqNullSafe(e["start"]) & p["end"].eqNullSafe(e["end"]) & p["value"].eqNullSafe(e["value"])
    return (
        F.when(plan.isNull() | (F.size(plan) != F.size(entities)), "plan_length")
        .when(F.exists(F.zip_with(plan, entities, lambda p, e: ~same(p, e)), lambda x: x), "plan_entity")
        .when(F.exists(plan, lambda p: ~F.coalesce(p["action"].isin(*ACTIONS), F.lit(False))), "plan_action")
        .when(F.exists(plan, lambda p: is_secret_kind(p["kind"]) & ~p["action"].isin("redact", "block")), "plan_secret")
    )


def judgments_error(judgments: Column, n: Column) -> Column:
    """Judgments (index, label, confidence; a null label abstains) name each of n entities at most once, by known labels."""
    index = F.transform(judgments, lambda j: j["index"])
    return (
        F.when(judgments.isNull(), "judgments_missing")
        .when(F.exists(judgments, lambda j: j["index"].isNull() | (j["index"] < 0) | (j["index"] >= n)), "judgment_index")
        .when(F.size(F.array_distinct(index)) != F.size(index), "judgment_duplicate")
        .when(F.exists(judgments, lambda j: j["label"].isNotNull() & ~j["label"].isin(*LABELS)), "judgment_label")
        .when(F.exists(judgments, lambda j: j["label"].isNotNull() & ~(F.coalesce(j["confidence"].between(0, 1), F.lit(False)) & ~F.isnan(j["confidence"]))), "judgment_confidence")
    )


def leaks(out: Column, plan: Column) -> Column:
    """Whether the new text still holds a value that was to go."""
    return F.exists(plan, lambda e: (e["action"] != "keep") & F.contains(out, e["value"]))


def scrubbed(message: Column, plan: Column) -> Column:
    """An error message with every value of the plan's entities replaced."""
    return F.aggregate(F.array_sort(plan, lambda a, b: F.length(b["value"]) - F.length(a["value"])), message, lambda m, e: F.when(e["value"] != "", F.replace(m, e["value"], F.lit("\x00"))).otherwise(m), lambda m: F.replace(m, F.lit("\x00"), F.lit("[redacted]")))
