"""Settings in layers: arguments over environment over a TOML file over defaults; unknown names are errors."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, fields

from ..operators.policy import Matrix, Rule


@dataclass
class Settings:
    detector: str = "regex"
    judge: str = "none"
    policy: str = "default"
    transformer: str = "pseudonymize"
    recipient: str = "external"
    data_category: str = "personal"
    purpose: str | None = None
    jurisdiction: str | None = None
    vault: str = "memory"
    vault_path: str | None = None
    vault_key_file: str | None = None
    vault_ttl_seconds: int | None = None
    audit_path: str | None = None
    audit_max_records: int = 0
    audit_max_bytes: int = 0
    canary_key_file: str | None = None
    tools: str = "sanitize,inspect"
    model_max_tokens: int = 512
    model_threads: int = 1
    model_threshold: float = 0.5
    process_timeout_ms: int = 30_000
    detector_program: str | None = None
    judge_program: str | None = None
    policy_program: str | None = None
    transformer_program: str | None = None
    vault_program: str | None = None


# What settings may be.
CHOICES = {
    "detector": ("regex", "model", "hybrid", "process"), "judge": ("none", "heuristics", "process"), "policy": ("default", "matrix", "process"),
    "transformer": ("pseudonymize", "generalize", "mask", "process"), "recipient": ("local", "trusted", "external", "unknown"),
    "data_category": ("non_personal", "personal", "special_category"), "vault": ("memory", "store", "process"),
}
LEAST = {"vault_ttl_seconds": 1, "audit_max_records": 0, "audit_max_bytes": 0, "model_max_tokens": 16, "model_threads": 1, "process_timeout_ms": 1}
CONTEXT = ("recipient", "data_category", "purpose", "jurisdiction")
TOOLS = ("sanitize", "inspect", "restore", "forget")
#: What a report says by value; of the rest it says only whether they are set.
SHOWN = ("detector", "judge", "policy", "transformer", "recipient", "data_category", "vault", "vault_ttl_seconds", "audit_max_records", "audit_max_bytes", "tools", "model_max_tokens", "model_threads", "model_threshold", "process_timeout_ms")


def checked(layer: str, name: str, value):
    """``value`` in its setting's type, or ValueError; messages name the setting, not the value."""
    kind = str({f.name: f for f in fields(Settings)}[name].type)
    try:
        if "int" in kind:
            value = int(value) if not isinstance(value, bool) else None
        elif "float" in kind:
            value = float(value)
        elif not isinstance(value, str):
            value = None
    except (TypeError, ValueError):
        value = None
    if value is None or (name in CHOICES and value not in CHOICES[name]) or (name in LEAST and value < LEAST[name]):
        raise ValueError(f"{layer}: bad value for {name}")
    if name == "model_threshold" and not 0 <= value <= 1:
        raise ValueError(f"{layer}: bad value for {name}")
    if name == "jurisdiction" and not (len(value) == 2 and value.isascii() and value.isalpha()):
        raise ValueError(f"{layer}: bad value for {name}")
    if name == "tools" and value != "all" and not set(value.split(",")) <= set(TOOLS):
        raise ValueError(f"{layer}: bad value for {name}")
    return value


def resolve(path: str | None = None, env: dict[str, str] | None = None, *, trusted: bool = True, **arguments) -> tuple[Settings, dict[str, str]]:
    """The settings and, by name, the layer that each comes from. A file that isn't ``trusted`` may not set the context."""
    known = {f.name for f in fields(Settings)}
    layers: list[tuple[str, dict]] = []
    if path:
        with open(path, "rb") as f:
            layers.append(("file", {k: v for k, v in tomllib.load(f).items() if k != "policy_matrix"}))
    env = os.environ if env is None else env
    layers.append(("environment", {k: env[f"SPANVEIL_{k.upper()}"] for k in known if f"SPANVEIL_{k.upper()}" in env}))
    layers.append(("argument", {k: v for k, v in arguments.items() if v is not None}))
    out, origin = Settings(), dict.fromkeys(known, "default")
    for layer, values in layers:
        for k, v in values.items():
            if k not in known:
                raise ValueError(f"{layer}: unknown setting {k}")
            if layer == "file" and not trusted and k in CONTEXT:
                raise ValueError(f"{layer}: {k} isn't taken from a file that isn't trusted")
            setattr(out, k, checked(layer, k, v))
            origin[k] = layer
    if out.vault_path and origin["vault"] == "default":
        out.vault = "store"  # a path implies it
    if (out.vault == "store") != bool(out.vault_path) or (out.vault == "process" and not out.vault_program):
        raise ValueError(f"vault: {out.vault} needs its path or program, and no other")
    if out.vault_ttl_seconds is not None and out.transformer not in ("pseudonymize", "process"):
        raise ValueError("vault_ttl_seconds needs a transformer with a vault")
    return out, origin


def matrix(path: str) -> Matrix:
    """The table [policy_matrix] of a file: origin, adequate, enforce and rules; codes in upper case, unknown names are errors."""
    with open(path, "rb") as f:
        table = tomllib.load(f).get("policy_matrix", {})
    if extra := set(table) - {"origin", "adequate", "enforce", "rules"}:
        raise ValueError(f"policy_matrix: unknown setting {min(extra)}")
    code = lambda c: c.upper() if isinstance(c, str) and len(c) == 2 and c.isascii() and c.isalpha() else None
    origin, adequate = table.get("origin"), table.get("adequate", [])
    if (origin is not None and code(origin) is None) or not isinstance(adequate, list) or None in map(code, adequate) or not isinstance(table.get("enforce", True), bool):
        raise ValueError("policy_matrix: bad value")
    rules = []
    for r in table.get("rules", []):
        if set(r) - {"purpose", "action", "recipients", "data_category"} or "purpose" not in r or r.get("action") not in ("keep", "pseudonymize", "redact", "block"):
            raise ValueError("policy_matrix: bad rule")
        if not set(r.get("recipients", [])) <= set(CHOICES["recipient"]) or r.get("data_category", "personal") not in CHOICES["data_category"]:
            raise ValueError("policy_matrix: bad rule")
        rules.append(Rule(r["purpose"], r["action"], tuple(r.get("recipients", ())), r.get("data_category")))
    return Matrix(code(origin) if origin else None, tuple(map(code, adequate)), table.get("enforce", True), tuple(rules))


def report(settings: Settings, origin: dict[str, str]) -> list[tuple[str, str, str]]:
    """(name, value, layer) in the settings' order; paths, programs, purposes and the like show only as set or unset."""
    rows = []
    for f in fields(Settings):
        v = getattr(settings, f.name)
        rows.append((f.name, ("unset" if v is None else str(v)) if f.name in SHOWN else ("unset" if v is None else "set"), origin[f.name]))
    return rows


def tool_names(settings: Settings) -> tuple[str, ...]:
    """The methods that a request stream answers."""
    return tuple(f"context.{t}" for t in (TOOLS if settings.tools == "all" else settings.tools.split(",")))
