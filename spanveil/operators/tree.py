"""Outbound context trees: every string of a JSON document sanitized once a session, and put back where it stood; fail closed."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ensure_importable, written

# Budgets of a tree, and the parts that have names of their own.
MAX_BYTES, MAX_STRINGS, MAX_DEPTH = 1 << 20, 512, 64
SHAPES = {"system": "parts", "messages": "messages"}


class TreeError(ValueError):
    """A code."""


def walk(value, visit: Callable[[str, bool], str], shape: str = "root", depth: int = 0, fixed: bool = False):
    """``value`` with every string s, keys included, as visit(s, fixed); fixed strings are those that give the tree its structure."""
    if depth > MAX_DEPTH:
        raise TreeError("tree_depth")
    if isinstance(value, str):
        return visit(value, fixed)
    if isinstance(value, list):
        item = {"messages": "message", "parts": "part"}.get(shape, "plain")
        return [walk(v, visit, item, depth + 1) for v in value]
    if not isinstance(value, dict):
        return value
    kind, out = value.get("type"), {}
    for k, v in value.items():
        if shape == "root":  # the names of a context's own parts
            out[k] = walk(v, visit, SHAPES.get(k, "plain"), depth + 1)
            continue
        own = (shape == "message" and k == "role") or (shape in ("part", "result") and k == "type") or (shape == "part" and kind in ("tool-call", "tool-result") and k in ("id", "name"))
        below = "plain"
        if (shape, k) == ("message", "content") or ((shape, k) == ("result", "value") and kind == "content"):
            below = "parts"
        elif (shape, k) == ("part", "result") and kind == "tool-result":
            below = "result"
        out[visit(k, True)] = walk(v, visit, below, depth + 1, own)
    return out


def _strings(raw: str | None) -> tuple[list[tuple[str, bool]], str | None]:
    """A tree's distinct strings and whether they are fixed anywhere, or an error's code."""
    found: dict[str, bool] = {}

    def visit(s: str, fixed: bool) -> str:
        found[s] = found.get(s, False) or fixed
        if len(found) > MAX_STRINGS:
            raise TreeError("tree_strings")
        return s

    try:
        if raw is None or len(raw.encode()) > MAX_BYTES:
            raise TreeError("tree_bytes" if raw else "tree_form")
        tree = json.loads(raw)
        if not isinstance(tree, dict):
            raise TreeError("tree_form")
        walk(tree, visit)
    except TreeError as e:
        return [], str(e)
    except (ValueError, RecursionError):
        return [], "tree_form"
    return list(found.items()), None


def sanitize_trees(df: DataFrame, sanitize: Callable[[DataFrame], DataFrame], *, key: str = "tree_id", tree: str = "tree", session: str = "session") -> DataFrame:
    """(key, status, error, tree): trees with all strings sanitized; null unless ok.

    ``sanitize`` gets distinct rows (doc_id long, text, scope) and adds status and clean_text.  A tree over a budget, a
    string that doesn't come out ok, or a structural string or object key that would change makes an error.
    """
    ensure_importable(df.sparkSession)

    def leaves(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("s", pa.string()), ("fixed", pa.bool_())]))
        for batch in batches:
            got = [_strings(v.as_py()) for v in batch.column(1)]
            rows = pa.array([[{"s": s, "fixed": f} for s, f in x] for x, _ in got], kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), rows, pa.array([e for _, e in got], pa.string())], names=["k", "t", "scope", "strings", "error"])

    rows = df.select(F.col(key).cast("string").alias("k"), F.col(tree).alias("t"), F.coalesce(F.col(session).cast("string"), F.lit("")).alias("scope"))
    rows, _ = written(rows.mapInArrow(leaves, "k string, t string, scope string, strings array<struct<s:string,fixed:boolean>>, error string"), "trees")
    each = rows.where("error is null").select("k", "scope", F.explode("strings").alias("x")).select("k", "scope", F.col("x.s").alias("text"), "x.fixed")
    distinct = each.select("scope", "text").distinct().withColumn("doc_id", F.xxhash64("scope", "text"))
    clean = sanitize(distinct).select("scope", "text", F.col("status").alias("how"), F.col("clean_text").alias("new"))
    back = each.join(clean, ["scope", "text"])
    bad = F.when(F.col("how") != "ok", "string_not_ok").when(F.col("fixed") & (F.col("new") != F.col("text")), "structure_changed")
    back = back.groupBy("k", "scope").agg(F.min(bad).alias("bad"), F.map_from_entries(F.collect_list(F.struct("text", F.coalesce("new", F.lit(""))))).alias("new"))  # MAX_STRINGS at most
    rows = rows.join(back, ["k", "scope"], "left").withColumn("error", F.coalesce("error", "bad"))

    def rebuilt(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for t, e, new in zip(batch.column("t").to_pylist(), batch.column("error").to_pylist(), batch.column("new").to_pylist(), strict=True):
                names = dict(new or [])
                out.append(None if e is not None else json.dumps(walk(json.loads(t), lambda s, _, names=names: names[s]), ensure_ascii=False, separators=(",", ":")))
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array([("ok" if e is None else "error") for e in batch.column("error").to_pylist()], pa.string()), batch.column("error"), pa.array(out, pa.string())], names=["k", "status", "error", "tree"])

    got = rows.select("k", "t", "error", "new").mapInArrow(rebuilt, "k string, status string, error string, tree string")
    return got.select(F.col("k").cast(df.schema[key].dataType).alias(key), "status", "error", F.col("tree").alias(tree))
