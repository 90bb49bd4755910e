"""Detection by a model: a scorer that the caller injects, over overlapping windows; fails closed without one."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame

from .detect import ENTITY
from .plugins import PluginError, _stage

# The least token budget, bytes of a window by token and at least, and the share of a window that overlaps.
LEAST_TOKENS, BYTES_PER_TOKEN, LEAST_BYTES, OVERLAPS = 16, 8, 1024, 8

#: Scores a piece of text: dicts of label, start, end (bytes of the piece, half-open) and score.
Scorer = Callable[[str], Iterable[dict]]


def windows(raw: bytes, size: int, overlap: int) -> list[tuple[int, int]]:
    """The cuts of windows.byte_windows()."""
    step = size - min(overlap, size - 1)

    def aligned(at: int) -> int:
        while 0 < at < len(raw) and raw[at] & 0xC0 == 0x80:
            at -= 1
        return at

    last = max(0, math.ceil((len(raw) - size) / step))
    return [(aligned(k * step), aligned(min(len(raw), k * step + size))) for k in range(last + 1)] if raw else []


def spans_of(piece: bytes, found: Iterable[dict], threshold: float) -> list[tuple[str, int, int, float]]:
    """Spans at or over the threshold on character cuts of the piece; scores clamped to 1; NaN drops out."""
    cut = lambda at: at == len(piece) or piece[at] & 0xC0 != 0x80
    out = []
    for f in found:
        try:
            label, a, b, score = str(f["label"]), int(f["start"]), int(f["end"]), float(f["score"])
        except (KeyError, TypeError, ValueError):
            raise PluginError("model_span") from None
        if score >= threshold and 0 <= a < b <= len(piece) and cut(a) and cut(b):
            out.append((label.strip().lower().replace(" ", "_"), a, b, min(score, 1.0)))
    return out


def detect_with_model(df: DataFrame, scorer: Scorer | None, *, text: str = "text", max_tokens: int = 512, threshold: float = 0.5) -> DataFrame:
    """``df`` with entities (null on failure) and plugin_error: model_missing, model_failed or model_span. A span that several windows find comes once, with its largest score."""
    size = max(max_tokens * BYTES_PER_TOKEN, LEAST_BYTES)

    def one(r: dict) -> dict:
        if scorer is None:
            raise PluginError("model_missing")
        raw, best = (r[text] or "").encode(), {}
        for a, b in windows(raw, size, size // OVERLAPS):
            try:
                found = list(scorer(raw[a:b].decode()))
            except Exception:
                raise PluginError("model_failed") from None
            for kind, s, e, score in spans_of(raw[a:b], found, threshold):
                best[kind, a + s, a + e] = max(score, best.get((kind, a + s, a + e), 0.0))
        out = []
        for n, ((kind, a, b), score) in enumerate(sorted(best.items(), key=lambda x: (x[0][1], x[0][2], x[0][0]))):
            cp, value = len(raw[:a].decode()), raw[a:b].decode()
            out.append({"kind": kind, "start": a, "end": b, "value": value, "confidence": score, "cp_start": cp, "cp_end": cp + len(value), "ord": n})
        return {"entities": out}

    return _stage(df, [text], {"entities": ENTITY}, one)


def probe(scorer: Scorer | None, max_tokens: int) -> str:
    """ok, model_missing, token_budget or model_failed."""
    if scorer is None:
        return "model_missing"
    if max_tokens < LEAST_TOKENS:
        return "token_budget"
    try:
        spans_of(b"probe", scorer("probe"), 0.5)
    except Exception:
        return "model_failed"
    return "ok"
