"""JSON-RPC request lines as a stream: validated, dispatched by method, answered a micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from ..functions.validators import jurisdiction_valid
from ..operators import audit, policy, sanitize, vault
from ..operators.store import VaultStore
from ..runtime import written

# Limits, codes, methods and arguments of the protocol.
MAX_FRAME = 4 << 20
TOOLS = ("context.sanitize", "context.inspect", "context.restore", "context.forget")
DEFAULT_TOOLS = TOOLS[:2]
CONTEXT = ("recipient", "data_category", "purpose", "jurisdiction")
ARGUMENTS = {"context.sanitize": ("text", "session", *CONTEXT), "context.inspect": ("text",), "context.restore": ("text", "session"), "context.forget": ("session",)}
NAMES = ("text", "session", *CONTEXT)


def parse(lines: DataFrame, line: str = "value", tools: tuple[str, ...] = DEFAULT_TOOLS, context: policy.Context | None = None, order: Column | None = None) -> DataFrame:
    """Rows row, id, tool, text, session, recipient, data_category, purpose, jurisdiction, code, problem.

    ``row`` tells calls apart and orders them, whatever ids their clients gave.  code is the JSON-RPC error, null if
    the call can run; problem is a tool's own error (a wrong type, an unknown recipient or category, a jurisdiction
    that isn't two letters).  Null and absent context arguments take those of ``context``.  Blank lines and
    notifications (no id) are dropped.  A file stream has no session to end, so an oversized or broken line costs only itself.
    """
    raw, base = F.col(line), context or policy.Context()
    got = lines.withColumn("row", F.monotonically_increasing_id() if order is None else order).where(F.coalesce(F.trim(raw), F.lit("")) != "")
    small = F.octet_length(raw) <= MAX_FRAME
    got = got.withColumn("v", F.when(small & F.is_valid_utf8(raw), F.try_parse_json(raw)))
    got = got.withColumn("is_json", F.when(small, F.col("v").isNotNull() & F.is_valid_utf8(raw)))
    at = lambda path: F.try_variant_get("v", path, "string")
    kind = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get("v", path, "variant")), F.lit("VOID"))
    obj = lambda path: F.startswith(kind(path), F.lit("OBJECT"))
    keys = lambda path: F.coalesce(F.json_object_keys(F.to_json(F.try_variant_get("v", path, "variant"))), F.array().cast("array<string>"))
    types = {n: kind(f"$.params.arguments.{n}") for n in NAMES}
    got = got.withColumns({
        "is_object": F.coalesce(obj("$"), F.lit(False)), "id_kind": kind("$.id"), "has_id": F.array_contains(keys("$"), "id"), "version": at("$.jsonrpc"), "method": at("$.method"), "params_ok": obj("$.params"),
        "params_keys": keys("$.params"), "tool": at("$.params.name"), "args_kind": kind("$.params.arguments"), "args_keys": keys("$.params.arguments"), **{f"t_{n}": t for n, t in types.items()}, **{f"a_{n}": at(f"$.params.arguments.{n}") for n in NAMES}, "id": at("$.id"),
    }).drop("v", line).withColumn("small", F.col("is_json").isNotNull())
    got, _ = written(got, "requests")  # what follows is a plan of its own, which one generated method can hold
    allowed = F.lit(False)
    for name, args in ARGUMENTS.items():
        allowed = allowed | ((F.col("tool") == name) & (F.size(F.array_except("args_keys", F.array(*map(F.lit, args)))) == 0))
    has = lambda n: F.coalesce(F.col(f"t_{n}") == "STRING", F.lit(False))
    odd = lambda n: ~F.col(f"t_{n}").isin("STRING", "VOID")
    code = (
        F.when(~F.col("small"), -32600).when(~F.col("is_json"), -32700).when(~F.col("is_object"), -32600).when(~F.coalesce(F.col("version") == "2.0", F.lit(False)), -32600)
        .when(F.col("has_id") & ~F.col("id_kind").isin("STRING", "BIGINT"), -32600).when(F.col("method").isNull(), -32600).when(F.col("method") != "tools/call", -32601)
        .when(~F.coalesce("params_ok", F.lit(False)) | (F.size(F.array_except("params_keys", F.array(*map(F.lit, ("name", "arguments", "_meta"))))) > 0), -32602)
        .when(~F.coalesce(F.col("tool").isin(*tools), F.lit(False)), -32602).when(~(F.startswith("args_kind", F.lit("OBJECT")) | (F.col("args_kind") == "VOID")) | ~F.coalesce(allowed, F.lit(False)), -32602)
        .when((F.col("tool") != "context.forget") & ~has("text"), -32602).when(F.col("tool").isin("context.restore", "context.forget") & ~has("session"), -32602).when(odd("session"), -32602)
    )
    own = {"recipient": ("local", "trusted", "external", "unknown"), "data_category": ("non_personal", "personal", "special_category")}
    merged = {n: F.coalesce(F.col(f"a_{n}"), F.lit(getattr(base, n)).cast("string")) for n in CONTEXT}
    problem = F.when(odd("recipient") | (has("recipient") & ~F.col("a_recipient").isin(*own["recipient"])), "recipient").when(odd("data_category") | (has("data_category") & ~F.col("a_data_category").isin(*own["data_category"])), "data_category")
    problem = problem.when(odd("jurisdiction") | (merged["jurisdiction"].isNotNull() & ~jurisdiction_valid(merged["jurisdiction"])), "jurisdiction").when(odd("purpose"), "purpose")
    got = got.withColumn("code", code).where(F.col("has_id") | F.col("code").isin(-32700, -32600))
    problem = F.when(F.col("code").isNull() & (F.col("tool") == "context.sanitize"), problem)
    return got.select("row", "id", "tool", F.col("a_text").alias("text"), F.coalesce("a_session", F.lit("default")).alias("session"), *[merged[n].alias(n) for n in CONTEXT], "code", problem.alias("problem"))


def _epochs(calls: DataFrame) -> DataFrame:
    """``calls`` with scope: the session, and after each of its forgets in the batch another one that has its own mappings."""
    w = Window.partitionBy("session").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marks = F.sum(F.when(F.col("tool") == "context.forget", 1).otherwise(0)).over(w)
    return calls.withColumn("epoch", marks).withColumn("scope", F.when(F.col("epoch") == 0, F.col("session")).otherwise(F.concat_ws("\x1e", "session", F.col("epoch").cast("string"))))


def answer(calls: DataFrame, store: VaultStore, key: bytes, *, now: int, ttl: int | None = None, sink: audit.AuditSink | None = None, batch: int | None = None) -> DataFrame:
    """Rows row, id, tool, status, text for a batch of parsed calls, in the calls' order a session.

    The vault is written before, and the audit record of every sanitize, restore and forget call before any text is
    returned; where either fails, so does the batch.  Calls after a forget of their session see none of its mappings.
    """
    calls, _ = written(calls, "calls")
    good, _ = written(_epochs(calls.where("code is null and problem is null")), "good-calls")
    todo = good.where("tool = 'context.sanitize'")
    ctx = {n: F.col(n) for n in CONTEXT}
    planned, _ = written(sanitize.plan(todo, context=ctx), "plans")
    with store.lock():
        mappings, counters = store.read_both()
        before = None if mappings is None else vault.live(mappings, now, ttl)
        rows, full, top = sanitize.pseudonymize_all(planned, key=key, doc_id="row", scope="scope", mappings=before, counters=counters, now=now, planned=True)
        rows, _ = written(rows, "sanitized")
        full, _ = written(full, "mappings")
        last = good.groupBy("session").agg(F.max_by("scope", "epoch").alias("scope"), F.max("epoch").alias("epoch")).where("epoch > 0")
        gone = last.select("session").join(good.select("session", "scope").distinct(), "session").select("scope").union(last.select("session")).distinct()
        names = last.select("scope", F.col("session").alias("__to"))

        def kept(table: DataFrame) -> DataFrame:
            """The table without what was forgotten; the last epoch goes on under its session's name."""
            stays = table.join(gone, "scope", "left_anti").select(*table.columns)
            return stays.unionByName(table.join(names, "scope").withColumn("scope", F.col("__to")).select(*table.columns))

        store.write(kept(full), kept(top))
    restored = vault.restore(good.where("tool = 'context.restore'"), full, key="row", text="text", scope="scope")
    restored, _ = written(restored, "restored")
    seen = sanitize.plan(good.where("tool = 'context.inspect'"))
    seen = seen.select("row", F.lit("ok").alias("status"), F.to_json(F.transform("plan", lambda e: F.struct(*[e[c].alias(c) for c in ("kind", "start", "end", "confidence")]))).alias("text"))
    if sink is not None:
        name, when = F.col("session"), F.lit(now)
        ev = rows.select("row", audit.event("sanitize", outcome=F.col("status"), session=name, now=when, actions=audit.counted(F.col("plan")), context=ctx).alias("event"))
        ev = ev.union(good.join(restored.select("row", "resolved"), "row").select("row", audit.event("restore", outcome=F.lit("ok"), session=name, now=when, resolved=F.col("resolved"))))
        ev = ev.union(good.where("tool = 'context.forget'").select("row", audit.event("forget", outcome=F.lit("ok"), session=name, now=when)))
        sink.append(ev.withColumnRenamed("row", "o"), batch=batch)
    done = rows.select("row", "status", F.col("clean_text").alias("text")).unionByName(restored.select("row", F.lit("ok").alias("status"), "text")).unionByName(seen)
    done = done.unionByName(good.where("tool = 'context.forget'").select("row", F.lit("ok").alias("status"), F.lit(None).cast("string").alias("text")))
    wrong = calls.where("code is not null or problem is not null").select("row", F.coalesce(F.concat(F.lit("error "), F.col("code").cast("string")), F.concat(F.lit("tool error "), F.col("problem"))).alias("status"), F.lit(None).cast("string").alias("text"))
    return calls.select("row", "id", "tool").join(done.unionByName(wrong), "row")


def serve(spark: SparkSession, folder: str, out: str, store: VaultStore, key: bytes, checkpoint: str, tools: tuple[str, ...] = TOOLS, *, context: policy.Context | None = None, ttl: int | None = None, sink: audit.AuditSink | None = None) -> StreamingQuery:
    """Answers request files that arrive in ``folder`` into ``out``; a repeated batch overwrites its own answers and adds no audit records."""
    lines = spark.readStream.text(folder)

    def each(batch: DataFrame, n: int) -> None:
        import time

        got = answer(parse(batch, tools=tools, context=context), store, key, now=int(time.time()), ttl=ttl, sink=sink, batch=n)
        got.write.mode("overwrite").parquet(f"{out}/batch={n}")

    return lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
