"""Process plugins: a stage answered by a child process, one JSON line in, one out; every answer is checked, every failure a code."""

from __future__ import annotations

import contextlib
import json
import os
import re
import signal
import subprocess
import threading
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.validators import PLACEHOLDER
from ..runtime import ensure_importable
from .validate import ACTIONS, LABELS

# The protocol's limits.
MAX_RESPONSE, TIMEOUT_S = 8 << 20, 30.0

JUDGMENTS = "array<struct<index:int,label:string,confidence:double>>"
DECISIONS = "array<struct<index:int,action:string>>"
MAPPINGS = "array<struct<kind:string,original:string,token:string>>"


class PluginError(ValueError):
    """Says what was wrong by code only; values never enter messages."""


def call(program: list[str], request: dict, timeout: float = TIMEOUT_S) -> dict:
    """The child's answer. It has ``timeout`` seconds, its output is read up to MAX_RESPONSE bytes, and its whole process group ends with the call."""
    try:
        child = subprocess.Popen(program, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, start_new_session=True)
    except OSError:
        raise PluginError("not_started") from None
    late = threading.Event()

    def end() -> None:
        with contextlib.suppress(ProcessLookupError, PermissionError):
            os.killpg(child.pid, signal.SIGKILL)

    def expire() -> None:
        late.set()
        end()

    def write() -> None:
        with contextlib.suppress(OSError, ValueError):
            child.stdin.write(json.dumps(request).encode() + b"\n")
            child.stdin.close()

    timer, writer = threading.Timer(timeout, expire), threading.Thread(target=write, daemon=True)
    timer.start()
    writer.start()
    out = bytearray()
    try:
        while len(out) <= MAX_RESPONSE and (more := child.stdout.read1(1 << 16)):
            out += more
        if len(out) > MAX_RESPONSE:
            raise PluginError("oversized")
        code = child.wait()
    finally:
        timer.cancel()
        end()
        child.wait()
        writer.join(1)
        child.stdout.close()
    if late.is_set():
        raise PluginError("timeout")
    if code:
        raise PluginError("exit_code")
    try:
        lines = out.decode().splitlines()
        got = json.loads(lines[0]) if len(lines) == 1 else None
    except ValueError:
        raise PluginError("not_json") from None
    if not isinstance(got, dict):
        raise PluginError("not_one_object")
    return got


def check_entities(text: str, got: dict) -> list[dict]:
    """The response's entities, each in the text, apart from the others' checks; an empty list needs an explicit text."""
    found = got.get("entities")
    if not isinstance(found, list) or (not found and "text" not in got):
        raise PluginError("entities")
    raw, out = text.encode(), []
    for e in found:
        try:
            kind, a, b, c = str(e["kind"]).strip().lower().replace(" ", "_"), int(e["start"]), int(e["end"]), float(e.get("confidence", 1.0))
            value = raw[a:b].decode()
            before = len(raw[:a].decode())
        except (KeyError, TypeError, ValueError, AttributeError):
            raise PluginError("span") from None
        if not kind or not 0 <= a < b <= len(raw) or not 0 <= c <= 1 or e.get("value", value) != value or value in kind:
            raise PluginError("span")
        out.append({"kind": kind, "start": a, "end": b, "value": value, "confidence": c, "cp_start": before, "cp_end": before + len(value), "ord": len(out)})
    return out


def _indexed(got: dict, name: str, n: int) -> list[dict]:
    rows = got.get(name)
    if not isinstance(rows, list) or any(not isinstance(r, dict) or type(r.get("index")) is not int or not 0 <= r["index"] < n for r in rows):
        raise PluginError(f"{name}_index")
    if len({r["index"] for r in rows}) != len(rows):
        raise PluginError(f"{name}_duplicate")
    return rows


def check_judgments(n: int, got: dict) -> list[dict]:
    """Labels by entity; a null or missing label abstains."""
    out = []
    for j in _indexed(got, "judgments", n):
        label, confidence = j.get("label"), j.get("confidence")
        if label is None:
            out.append({"index": j["index"], "label": None, "confidence": None})
            continue
        if label not in LABELS:
            raise PluginError("judgments_label")
        if not isinstance(confidence, (int, float)) or not 0 <= confidence <= 1:
            raise PluginError("judgments_confidence")
        out.append({"index": j["index"], "label": label, "confidence": float(confidence)})
    return out


def check_plan(n: int, got: dict) -> list[dict]:
    """One known action for every entity."""
    rows = _indexed(got, "plan", n)
    if len(rows) != n:
        raise PluginError("plan_coverage")
    if any(r.get("action") not in ACTIONS for r in rows):
        raise PluginError("plan_action")
    return [{"index": r["index"], "action": r["action"]} for r in rows]


def check_transform(plan: list[dict], got: dict) -> dict:
    """The new text and its mappings: tokens are placeholders, once each, planned, in the text and for every pseudonymized value; kept values stay, redacted ones go."""
    text, rows = got.get("text"), got.get("mappings", [])
    if not isinstance(text, str) or not isinstance(rows, list):
        raise PluginError("transform_form")
    wanted = {(p["kind"], p["value"]) for p in plan if p["action"] == "pseudonymize"}
    try:
        seen = [(m["kind"], m["original"], m["token"]) for m in rows]
    except (KeyError, TypeError):
        raise PluginError("transform_form") from None
    if len({t for _, _, t in seen}) != len(seen):
        raise PluginError("transform_token_twice")
    if any(not isinstance(t, str) or not re.fullmatch(PLACEHOLDER, t) for _, _, t in seen):
        raise PluginError("transform_token_form")
    if any((k, o) not in wanted for k, o, _ in seen):
        raise PluginError("transform_unplanned")
    if any(t not in text for _, _, t in seen):
        raise PluginError("transform_token_missing")
    if {(k, o) for k, o, _ in seen} != wanted:
        raise PluginError("transform_uncovered")
    kept = {p["value"] for p in plan if p["action"] == "keep"}
    if any(v not in text for v in kept):
        raise PluginError("transform_kept_missing")
    if any(p["value"] in text for p in plan if p["action"] != "keep" and p["value"] not in kept):
        raise PluginError("transform_leak")
    return {"text": text, "mappings": [{"kind": k, "original": o, "token": t} for k, o, t in seen]}


def _stage(df: DataFrame, read: list[str], new: dict[str, str], one: Callable[[dict], dict]) -> DataFrame:
    """``df`` with the columns ``new`` from one(row's columns ``read``), or nulls and plugin_error, which keeps an earlier error."""
    ensure_importable(df.sparkSession)
    names = [f for f in df.schema.fields if f.name not in (*new, "plugin_error")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in names] + [f"`{k}` {v}" for k, v in new.items()] + ["plugin_error string"])
    had = "plugin_error" in df.columns

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        arrow = _arrow()
        for batch in batches:
            rows = batch.select([c for c in {*read, *(["plugin_error"] if had else [])}]).to_pylist()
            out, errors = {k: [] for k in new}, []
            for r in rows:
                got, error = {}, r.pop("plugin_error", None)
                if error is None:
                    try:
                        got = one(r)
                    except PluginError as e:
                        error = str(e)
                errors.append(error)
                for k in new:
                    out[k].append(got.get(k))
            kept = [batch.column(f.name) for f in names]
            yield pa.RecordBatch.from_arrays(kept + [pa.array(out[k], arrow[new[k]]) for k in new] + [pa.array(errors, pa.string())], names=[f.name for f in names] + [*new, "plugin_error"])

    return df.mapInArrow(run, schema)


def _arrow() -> dict:
    import pyarrow as pa

    from .detect import ENTITY

    entity = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("confidence", pa.float64()), ("cp_start", pa.int32()), ("cp_end", pa.int32()), ("ord", pa.int32())])
    return {
        ENTITY: pa.list_(entity), JUDGMENTS: pa.list_(pa.struct([("index", pa.int32()), ("label", pa.string()), ("confidence", pa.float64())])),
        DECISIONS: pa.list_(pa.struct([("index", pa.int32()), ("action", pa.string())])), MAPPINGS: pa.list_(pa.struct([("kind", pa.string()), ("original", pa.string()), ("token", pa.string())])), "string": pa.string(),
    }


def _wire(entities: list[dict] | None) -> list[dict]:
    return [{k: e[k] for k in ("kind", "start", "end", "value", "confidence")} for e in entities or []]


def detect_with(df: DataFrame, program: list[str], *, text: str = "text", timeout: float = TIMEOUT_S) -> DataFrame:
    """``df`` with entities (null on failure) and plugin_error (a code, null if fine), a child a row; null texts count as empty."""
    from .detect import ENTITY

    def one(r: dict) -> dict:
        t = r[text] or ""
        return {"entities": check_entities(t, call(program, {"method": "detect", "input": t}, timeout))}

    return _stage(df, [text], {"entities": ENTITY}, one)


def judge_with(df: DataFrame, program: list[str], *, text: str = "text", timeout: float = TIMEOUT_S) -> DataFrame:
    """``df`` (with entities) with judgments; rows without entities aren't asked about."""

    def one(r: dict) -> dict:
        e = _wire(r["entities"])
        return {"judgments": check_judgments(len(e), call(program, {"method": "judge", "input": r[text] or "", "entities": e}, timeout)) if e else []}

    return _stage(df, [text, "entities"], {"judgments": JUDGMENTS}, one)


def plan_with(df: DataFrame, program: list[str], *, context: dict[str, str], timeout: float = TIMEOUT_S) -> DataFrame:
    """``df`` (with entities and judgments) with decisions (index, action); context: names of the columns of recipient, data_category, purpose, jurisdiction."""

    def one(r: dict) -> dict:
        e = _wire(r["entities"])
        request = {"method": "plan", **{k: r[c] for k, c in context.items() if r[c] is not None}, "entities": e, "judgments": [j for j in r["judgments"] or [] if j["label"] is not None]}
        return {"decisions": check_plan(len(e), call(program, request, timeout)) if e else []}

    return _stage(df, ["entities", "judgments", *context.values()], {"decisions": DECISIONS}, one)


def transform_with(df: DataFrame, program: list[str], *, text: str = "text", scope: str = "scope", timeout: float = TIMEOUT_S) -> DataFrame:
    """``df`` (with plan) with new_text and mappings; blocked rows aren't asked about."""

    def one(r: dict) -> dict:
        plan = [{"index": i, **{k: p[k] for k in ("kind", "start", "end", "value", "action")}} for i, p in enumerate(r["plan"] or [])]
        if any(p["action"] == "block" for p in plan):
            return {}
        got = check_transform(plan, call(program, {"method": "transform", "scope": r[scope], "input": r[text] or "", "plan": plan}, timeout))
        return {"new_text": got["text"], "mappings": got["mappings"]}

    return _stage(df, [text, scope, "plan"], {"new_text": "string", "mappings": MAPPINGS}, one)


class ProcessVault:
    """A vault that a child process keeps: tokens must have a placeholder's form and resolve to what they stand for, a deletion must be confirmed."""

    def __init__(self, program: list[str], timeout: float = TIMEOUT_S):
        self.program, self.timeout = program, timeout

    def mint(self, wanted: DataFrame) -> DataFrame:
        """Distinct (scope, kind, original) with token and plugin_error."""
        program, timeout = self.program, self.timeout

        def one(r: dict) -> dict:
            token = call(program, {"method": "vault_get_or_insert", **r}, timeout).get("token")
            if not isinstance(token, str) or not re.fullmatch(PLACEHOLDER, token):
                raise PluginError("vault_token_form")
            back = call(program, {"method": "vault_resolve", "scope": r["scope"], "token": token}, timeout).get("mapping")
            if back != {"kind": r["kind"], "original": r["original"], "token": token}:
                raise PluginError("vault_round_trip")
            return {"token": token}

        return _stage(wanted.select("scope", "kind", "original").distinct(), ["scope", "kind", "original"], {"token": "string"}, one)

    def resolve(self, tokens: DataFrame) -> DataFrame:
        """``tokens`` (scope, token) with original (null if unknown) and plugin_error."""
        program, timeout = self.program, self.timeout

        def one(r: dict) -> dict:
            found = call(program, {"method": "vault_resolve", "scope": r["scope"], "token": r["token"]}, timeout).get("mapping")
            if found is not None and (not isinstance(found, dict) or found.get("token") != r["token"]):
                raise PluginError("vault_other_token")
            return {"original": found and found.get("original")}

        return _stage(tokens, ["scope", "token"], {"original": "string"}, one)

    def forget(self, scope: str) -> None:
        if call(self.program, {"method": "vault_delete_scope", "scope": scope}, self.timeout).get("deleted") is not True:
            raise PluginError("vault_not_deleted")


def failed(df: DataFrame) -> DataFrame:
    """Rows by plugin_error, and how many."""
    return df.where("plugin_error is not null").groupBy("plugin_error").agg(F.count(F.lit(1)).alias("n"))
