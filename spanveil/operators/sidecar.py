"""A judge as a child process: ``python -m spanveil.operators.sidecar`` answers one request line of the plugin protocol by rules that stand in for a model."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable

# How sure the stand-in is, and how much text it looks at.
CONFIDENCE, MOST = 0.97, 100_000
RESERVED = ("example.com", "example.org", "example.net", ".test", ".invalid", ".example")


def choose(kind: str, value: str) -> str | None:
    """test for anything at a reserved domain, wherever that stands; personal for other addresses and numbers; None abstains."""
    if any(part in kind for part in ("key", "secret", "token", "password", "credential")):
        return None
    if "@" in value:
        return "test" if any(d in value.rsplit("@", 1)[1].lower() for d in RESERVED) else "personal"
    return "personal" if kind in ("phone", "iban") else None


def answer(request: dict, choice: Callable[[str, str], str | None] = choose) -> dict:
    """Judgments of a request's entities; a text that is too long for the model abstains for all."""
    if request.get("method") != "judge" or not isinstance(request.get("entities"), list):
        raise ValueError("not a judge request")
    out = []
    for i, e in enumerate(request["entities"]):
        label = choice(e["kind"], e["value"]) if len(request.get("input", "")) <= MOST else None
        out.append({"index": i, "label": label, "confidence": CONFIDENCE if label else None})
    return {"judgments": out}


if __name__ == "__main__":
    try:
        print(json.dumps(answer(json.loads(sys.stdin.readline()))))
    except (ValueError, KeyError, TypeError):
        sys.exit(2)
