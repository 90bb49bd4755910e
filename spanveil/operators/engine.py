"""Stages by name, and the pipeline that settings describe: one call a row, every stage's answer checked, audit before text."""

from __future__ import annotations

import shlex
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.validators import PLACEHOLDER
from ..runtime import written
from ..sources.config import Settings
from . import audit, detect, judge, model, plugins, policy, sanitize, transform, validate, vault
from .store import VaultStore, read_key


class UnknownStage(ValueError):
    """A stage's name that isn't registered."""


@dataclass
class Pipeline:
    """What the stages of one pipeline share."""

    spark: SparkSession
    settings: Settings
    key: bytes
    matrix: policy.Matrix | None = None
    scorer: Callable | None = None
    sink: audit.AuditSink | None = None
    store: VaultStore | None = None
    extra: dict = field(default_factory=dict)

    def program(self, stage: str) -> list[str]:
        found = getattr(self.settings, f"{stage}_program")
        if not found:
            raise UnknownStage(f"{stage}: process needs a program")
        return shlex.split(found)

    def process_vault(self) -> plugins.ProcessVault:
        return plugins.ProcessVault(self.program("vault"), self.timeout)

    @property
    def timeout(self) -> float:
        return self.settings.process_timeout_ms / 1000

    def context(self) -> dict[str, Column]:
        s = self.settings
        return policy.Context(s.recipient, s.data_category, s.purpose, s.jurisdiction).columns()


Stage = Callable[[Pipeline, DataFrame, str], DataFrame]


def _no_error(df: DataFrame) -> DataFrame:
    return df if "plugin_error" in df.columns else df.withColumn("plugin_error", F.lit(None).cast("string"))


def _regex(p: Pipeline, df: DataFrame, text: str) -> DataFrame:
    return _no_error(detect.detect(df, text))


def _model(p: Pipeline, df: DataFrame, text: str) -> DataFrame:
    return model.detect_with_model(df, p.scorer, text=text, max_tokens=p.settings.model_max_tokens, threshold=p.settings.model_threshold)


def _hybrid(p: Pipeline, df: DataFrame, text: str) -> DataFrame:
    got = _model(p, df, text).withColumnRenamed("entities", "__secondary")
    got = detect.detect(got, text)
    merged = F.when(F.col("__secondary").isNotNull(), detect.hybrid_merge(F.col("entities"), F.col("__secondary")))
    return got.withColumn("entities", merged).drop("__secondary")


def _process_detect(p: Pipeline, df: DataFrame, text: str) -> DataFrame:
    return plugins.detect_with(df, p.program("detector"), text=text, timeout=p.timeout)


def _no_judge(p: Pipeline, df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("judgments", F.expr(f"cast(array() as {plugins.JUDGMENTS})"))


def _heuristics(p: Pipeline, df: DataFrame, text: str) -> DataFrame:
    one = lambda e, i: F.struct(i.alias("index"), judge.label(e["kind"], e["value"]).alias("label"), F.lit(judge.CONFIDENCE).alias("confidence"))
    return df.withColumn("judgments", F.filter(F.transform("entities", one), lambda j: j["label"].isNotNull()))


def _process_judge(p: Pipeline, df: DataFrame, text: str) -> DataFrame:
    return plugins.judge_with(df, p.program("judge"), text=text, timeout=p.timeout)


def _judgment(i: Column) -> Column:
    return F.try_element_at(F.filter("judgments", lambda j: (j["index"] == i) & j["label"].isNotNull()), F.lit(1))


def _native_policy(matrix: bool) -> Stage:
    def run(p: Pipeline, df: DataFrame, text: str) -> DataFrame:
        ctx = {k: F.col(f"__{k}") for k in ("recipient", "data_category", "purpose", "jurisdiction")}
        of = (p.matrix or policy.Matrix()) if matrix else None
        return df.withColumn("plan", F.transform("entities", lambda e, i: sanitize.decide(e, ctx, of, _judgment(i)["label"], F.coalesce(_judgment(i)["confidence"], F.lit(0.0)))))

    return run


def _process_policy(p: Pipeline, df: DataFrame, text: str) -> DataFrame:
    names = {k: f"__{k}" for k in ("recipient", "data_category", "purpose", "jurisdiction")}
    got = plugins.plan_with(df, p.program("policy"), context=names, timeout=p.timeout)
    action = lambda i: F.try_element_at(F.filter("decisions", lambda d: d["index"] == i), F.lit(1))["action"]
    one = lambda e, i: F.struct(*[e[c].alias(c) for c in ("kind", "start", "end", "value", "confidence", "cp_start", "cp_end")], _judgment(i)["label"].alias("label"), action(i).alias("action"), F.lit("custom_policy_plan").alias("reason"), F.lit(None).cast("int").alias("matched_rule"), F.lit(True).alias("used_default"))
    return got.withColumn("plan", F.transform("entities", one)).drop("decisions")


DETECTORS: dict[str, Stage] = {"regex": _regex, "model": _model, "hybrid": _hybrid, "process": _process_detect}
JUDGES: dict[str, Stage] = {"none": _no_judge, "heuristics": _heuristics, "process": _process_judge}
POLICIES: dict[str, Stage] = {"default": _native_policy(False), "matrix": _native_policy(True), "process": _process_policy}
TRANSFORMERS = ("pseudonymize", "generalize", "mask", "process")


def stage(registry: dict[str, Stage], name: str) -> Stage:
    if name not in registry:
        raise UnknownStage(f"unknown stage {name!r}; known: {', '.join(registry)}")
    return registry[name]


def build(spark: SparkSession, settings: Settings, *, key: bytes | None = None, matrix: policy.Matrix | None = None, scorer: Callable | None = None) -> Pipeline:
    """A pipeline of known stages, its vault and its audit log, which has to verify as a whole first."""
    s = settings
    for registry, name in ((DETECTORS, s.detector), (JUDGES, s.judge), (POLICIES, s.policy)):
        stage(registry, name)
    if s.transformer not in TRANSFORMERS:
        raise UnknownStage(f"unknown stage {s.transformer!r}; known: {', '.join(TRANSFORMERS)}")
    audit.check_paths(vault=s.vault_path, audit=s.audit_path, vault_key_file=s.vault_key_file, canary_key_file=s.canary_key_file)
    if key is None and s.vault_key_file:
        key = read_key(s.vault_key_file)
    if s.transformer == "pseudonymize" and s.vault != "process" and not key:
        raise ValueError("pseudonymize needs a key")
    found = Pipeline(spark, s, key or b"", matrix, scorer)
    if s.vault_path:
        found.store = VaultStore(spark, s.vault_path, read_key(s.vault_key_file) if s.vault_key_file else None)
    if s.audit_path:
        found.sink = audit.AuditSink(spark, s.audit_path, s.audit_max_records, s.audit_max_bytes)
        if found.sink.batches() and not found.sink.verify().where("failure is not null").isEmpty():
            raise ValueError("the audit log doesn't verify")
    return found


def planned(p: Pipeline, df: DataFrame, *, text: str = "text", context: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with entities, judgments, plan and stage_error, the first code of detection, spans, judgments or plan that is wrong."""
    rows = df.withColumns({f"__{k}": v for k, v in (p.context() | (context or {})).items()})
    got = stage(DETECTORS, p.settings.detector)(p, rows, text)
    got = got.withColumn("plugin_error", F.coalesce("plugin_error", validate.spans_error(F.col("entities"), F.coalesce(F.col(text), F.lit("")))))
    got = got.withColumn("entities", F.when(F.col("plugin_error").isNull(), detect.resolve_overlaps(F.col("entities"))))
    got = stage(JUDGES, p.settings.judge)(p, got, text)
    got = got.withColumn("plugin_error", F.coalesce("plugin_error", validate.judgments_error(F.col("judgments"), F.size("entities"))))
    got = stage(POLICIES, p.settings.policy)(p, got, text)
    got = got.withColumn("stage_error", F.coalesce("plugin_error", validate.plan_error(F.col("plan"), F.col("entities"))))
    return got.drop("plugin_error")


def run(p: Pipeline, df: DataFrame, *, doc_id: str = "doc_id", scope: str = "scope", text: str = "text", now: int = 0, context: dict[str, Column] | None = None, batch: int | None = None) -> DataFrame:
    """``df`` with plan, status, error and clean_text by the settings' stages.

    The plan is written once.  Blocked rows and rows with an error mint nothing; the vault is written before and the
    audit record of every row after the transform, and no text comes out where either fails (the job fails).
    """
    got, _ = written(planned(p, df, text=text, context=context), "plans")
    error, how = F.col("stage_error"), p.settings.transformer
    if how == "pseudonymize":
        if p.store is not None:
            with p.store.lock():
                mappings, counters = p.store.read_both()
                mappings = None if mappings is None else vault.live(mappings, now, p.settings.vault_ttl_seconds)
                _, full, top = sanitize.pseudonymize_all(got, key=p.key, doc_id=doc_id, scope=scope, text=text, mappings=mappings, counters=counters, now=now, planned=True, error=error)
                p.store.write(full, top)
            full = p.store.read()
            out = sanitize.with_tokens(got, full, doc_id=doc_id, scope=scope, text=text, error=error)
        elif p.settings.vault == "process":
            wanted = sanitize.wanted_mappings(got.where(error.isNull()), doc_id=doc_id, scope=scope)
            minted, _ = written(p.process_vault().mint(wanted), "minted")
            refused = wanted.join(minted.where("plugin_error is not null"), vault.KEYS).groupBy("d").agg(F.min("plugin_error").alias("__refused"))
            got, error = got.join(refused.withColumnRenamed("d", doc_id), doc_id, "left"), F.coalesce(error, F.col("__refused"))
            out = sanitize.with_tokens(got, minted.where("token is not null"), doc_id=doc_id, scope=scope, text=text, error=error)
        else:
            out, _, _ = sanitize.pseudonymize_all(got, key=p.key, doc_id=doc_id, scope=scope, text=text, now=now, planned=True, error=error)
    elif how == "process":
        done, _ = written(plugins.transform_with(got.withColumn("plugin_error", error), p.program("transformer"), text=text, scope=scope, timeout=p.timeout), "transformed")
        out = sanitize.finish(done, text, F.col("new_text"), F.col("plugin_error"))
        if p.store is not None:
            _keep(p, out, scope, now)
        out = out.drop("new_text", "mappings", "plugin_error")
    else:
        out = sanitize.finish(got, text, transform.rebuild(F.col(text), F.col("plan"), lambda e: transform.replacement(e, how)), error)
    ctx = {k: F.col(f"__{k}") for k in ("recipient", "data_category", "jurisdiction")}
    if p.sink is not None:
        out, _ = written(out, "sanitized")
        ev = audit.event("sanitize", outcome=F.col("status"), session=F.col(scope).cast("string"), now=F.lit(now), actions=audit.counted(F.coalesce(F.col("plan"), F.array().cast(got.schema["plan"].dataType))), context=ctx)
        p.sink.append(out.select(F.col(doc_id).alias("o"), ev.alias("event")), batch=batch)
    return out.drop(*[c for c in out.columns if c.startswith("__")], "entities", "judgments", "stage_error")


def _keep(p: Pipeline, out: DataFrame, scope: str, now: int) -> None:
    """A process transformer's mappings go into the vault, so that its tokens can be restored."""
    new = out.where("status = 'ok'").select(F.col(scope).alias("scope"), F.explode("mappings").alias("m")).select("scope", "m.kind", "m.original", "m.token").drop_duplicates(["scope", "kind", "original"])
    new = new.withColumn("counter", F.coalesce(F.regexp_extract("token", r"_([0-9]+)_[0-9A-Fa-f]{16}__\z", 1).try_cast("long"), F.lit(0))).withColumn("created_at", F.lit(now).cast("long"))
    new, _ = written(new, "plugin-mappings")
    with p.store.lock():
        mappings, _ = p.store.read_both()
        p.store.write(new if mappings is None else mappings.join(new, vault.KEYS, "left_anti").select(*new.columns).unionByName(new))


def restore(p: Pipeline, df: DataFrame, *, doc_id: str = "doc_id", scope: str = "scope", text: str = "text", now: int = 0, batch: int | None = None) -> DataFrame:
    """(doc_id, text, resolved) from the pipeline's store; its audit records are written first."""
    mappings = p.store.read() if p.store is not None else None
    if p.settings.vault == "process":
        tokens = df.select(F.col(scope).alias("scope"), F.explode(F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0))).alias("token")).distinct()
        mappings, _ = written(p.process_vault().resolve(tokens).where("original is not null").select("scope", "original", "token", F.lit(None).cast("long").alias("created_at")), "resolved")
        out = vault.restore(df, mappings, key=doc_id, text=text, scope=scope, minted=False)
    if mappings is None:
        mappings = p.spark.createDataFrame([], "scope string, kind string, original string, token string, counter long, created_at long")
    if p.settings.vault != "process":
        out = vault.restore(df, vault.live(mappings, now, p.settings.vault_ttl_seconds), key=doc_id, text=text, scope=scope)
    if p.sink is not None:
        out, _ = written(out, "restored")
        rows = out.join(df.select(doc_id, F.col(scope).cast("string").alias("__scope")), doc_id)
        ev = audit.event("restore", outcome=F.lit("ok"), session=F.col("__scope"), now=F.lit(now), resolved=F.col("resolved"))
        p.sink.append(rows.select(F.col(doc_id).alias("o"), ev.alias("event")), batch=batch)
    return out


def forget(p: Pipeline, scopes: DataFrame, *, now: int = 0, batch: int | None = None) -> None:
    """Mappings and counters of the scopes (scope) go; then each has its audit record."""
    if p.store is not None:
        with p.store.lock():
            mappings, counters = p.store.read_both()
            if mappings is not None:
                p.store.write(vault.forget(mappings, scopes), vault.forget(counters, scopes))
    if p.settings.vault == "process":
        for r in scopes.select("scope").distinct().toLocalIterator():  # a call of the child each
            p.process_vault().forget(r["scope"])
    if p.sink is not None:
        ev = audit.event("forget", outcome=F.lit("ok"), session=F.col("scope").cast("string"), now=F.lit(now))
        p.sink.append(scopes.select(F.col("scope").alias("o"), ev.alias("event")), batch=batch)


def doctor(spark: SparkSession, settings: Settings, scorer: Callable | None = None) -> list[tuple[str, str]]:
    """(check, code) in a fixed order; codes are ok, unset, or what is wrong, never a path or a value."""
    s = settings

    def attempt(f: Callable, wrong: str) -> str:
        try:
            return "ok" if f() else wrong
        except Exception:
            return wrong

    return [
        ("detector", "ok" if s.detector in DETECTORS else "unknown"),
        ("judge", "ok" if s.judge in JUDGES else "unknown"),
        ("policy", "ok" if s.policy in POLICIES else "unknown"),
        ("transformer", "ok" if s.transformer in TRANSFORMERS else "unknown"),
        ("model", model.probe(scorer, s.model_max_tokens) if s.detector in ("model", "hybrid") else "unset"),
        ("programs", "ok" if all(getattr(s, f"{n}_program") for n in ("detector", "judge", "policy", "transformer", "vault") if getattr(s, n) == "process") else "program_missing"),
        ("vault_key", attempt(lambda: read_key(s.vault_key_file), "unreadable") if s.vault_key_file else "unset"),
        ("canary_key", attempt(lambda: read_key(s.canary_key_file), "unreadable") if s.canary_key_file else "unset"),
        ("paths", attempt(lambda: audit.check_paths(vault=s.vault_path, audit=s.audit_path, vault_key_file=s.vault_key_file, canary_key_file=s.canary_key_file) or True, "shared")),
        ("audit", attempt(lambda: audit.AuditSink(spark, s.audit_path).verify().where("failure is not null").isEmpty(), "not_verified") if s.audit_path and audit.AuditSink(spark, s.audit_path).batches() else "unset"),
    ]
