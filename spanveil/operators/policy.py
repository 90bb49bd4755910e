"""Default and matrix policies as one CASE each: struct(action, reason, matched_rule, used_default)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.validators import is_secret_kind, jurisdiction_valid

KEEP_AT = 0.90


@dataclass(frozen=True)
class Context:
    recipient: str = "external"
    data_category: str = "personal"
    purpose: str | None = None
    jurisdiction: str | None = None

    def columns(self) -> dict[str, Column]:
        return {k: F.lit(v).cast("string") for k, v in vars(self).items()}


@dataclass(frozen=True)
class Rule:
    purpose: str
    action: str
    recipients: tuple[str, ...] = ()
    data_category: str | None = None


@dataclass(frozen=True)
class Matrix:
    origin: str | None = None
    adequate: tuple[str, ...] = ()
    enforce: bool = True
    rules: tuple[Rule, ...] = ()


def _decision(action: str, reason: str, rule: int | None = None) -> Column:
    return F.struct(F.lit(action).alias("action"), F.lit(reason).alias("reason"), F.lit(rule).cast("int").alias("matched_rule"), F.lit(rule is None).alias("used_default"))


def _first(*cases: tuple[Column, Column], otherwise: Column) -> Column:
    out = None
    for when, then in cases:
        out = F.when(F.coalesce(when, F.lit(False)), then) if out is None else out.when(F.coalesce(when, F.lit(False)), then)
    return out.otherwise(otherwise)


def default_policy(kind: Column, ctx: dict[str, Column], judged: Column | None = None, confidence: Column | float = 0.95) -> Column:
    judged = F.lit(None).cast("string") if judged is None else judged
    confidence = F.lit(confidence) if isinstance(confidence, float) else confidence
    to, what = ctx["recipient"], ctx["data_category"]
    return _first(
        (is_secret_kind(kind), _decision("redact", "secret_kind")),
        (judged == "secret", _decision("redact", "judge_secret")),
        ((what == "special_category") & to.isin("external", "unknown"), _decision("block", "special_category_blocked")),
        ((what == "special_category") & (to == "trusted") & ~jurisdiction_valid(ctx["jurisdiction"]), _decision("block", "jurisdiction_required_blocked")),
        ((to == "unknown") & (what != "non_personal"), _decision("block", "unknown_recipient_blocked")),
        (judged.isin("test", "business") & (confidence >= KEEP_AT), _decision("keep", "judge_keep")),
        (to == "local", _decision("keep", "local_recipient_keep")),
        otherwise=_decision("pseudonymize", "default_pseudonymize"),
    )


def matrix_policy(kind: Column, ctx: dict[str, Column], matrix: Matrix, judged: Column | None = None, confidence: Column | float = 0.95) -> Column:
    judged = F.lit(None).cast("string") if judged is None else judged
    confidence = F.lit(confidence) if isinstance(confidence, float) else confidence
    to, what, at = ctx["recipient"], ctx["data_category"], ctx["jurisdiction"]
    home = (matrix.origin or "").upper()
    adequate = F.lit(True) if not matrix.enforce else (F.lit(bool(home)) & jurisdiction_valid(at) & F.upper(at).isin(home, *[a.upper() for a in matrix.adequate]))
    rules = []
    for i, r in enumerate(matrix.rules):
        when = F.coalesce(ctx["purpose"] == r.purpose, F.lit(False))
        when = when & (what == r.data_category) if r.data_category else when
        when = when & to.isin(*r.recipients) if r.recipients else when
        rules.append((when, _decision(r.action, "purpose_rule_match", i)))
    return _first(
        (is_secret_kind(kind), _decision("redact", "secret_kind")),
        (judged == "secret", _decision("redact", "judge_secret")),
        ((to == "unknown") & (what != "non_personal"), _decision("block", "unknown_recipient_blocked")),
        ((what == "special_category") & to.isin("external", "unknown"), _decision("block", "special_category_blocked")),
        ((what == "special_category") & (to == "trusted") & ~F.coalesce(adequate, F.lit(False)), _decision("block", "jurisdiction_adequacy_blocked")),
        *rules,
        (judged.isin("test", "business") & (confidence >= KEEP_AT), _decision("keep", "judge_keep")),
        (to == "local", _decision("keep", "local_recipient_keep")),
        otherwise=_decision("pseudonymize", "default_pseudonymize"),
    )
