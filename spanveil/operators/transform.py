"""Transformers: texts rebuilt around their planned entities, and the check after that."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.validators import PREFIX, REDACTED, placeholder_kind_valid


def masked(v: Column) -> Column:
    n = F.length(v)
    return F.when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.repeat(F.lit("*"), n - 4), F.right(v, F.lit(4))))


def generalized(kind: Column) -> Column:
    """A placeholder of the kind; null for a kind that no placeholder can hold, which makes the row an error."""
    return F.when(placeholder_kind_valid(kind), F.concat(F.lit(PREFIX), F.upper(kind), F.lit("__")))


def replacement(e: Column, how: str, token: Column | None = None) -> Column:
    pseudonym = {"mask": lambda: masked(e["value"]), "generalize": lambda: generalized(e["kind"]), "pseudonymize": lambda: token}[how]()
    return F.when(e["action"] == "keep", e["value"]).when(e["action"] == "redact", F.lit(REDACTED)).otherwise(pseudonym)


def rebuild(text: Column, plan: Column, replace) -> Column:
    """``text`` with the spans of ``plan`` (sorted, apart) replaced by replace(entity)."""
    step = lambda acc, e: F.struct(e["cp_end"].alias("at"), F.concat(acc["out"], F.substr(text, acc["at"] + 1, e["cp_start"] - acc["at"]), replace(e)).alias("out"))
    return F.aggregate(plan, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))
