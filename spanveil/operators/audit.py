"""Hash-chained audit records, a sink that rotates chains, verification of tables and of line files, and boundary markers.

A chain is serial by nature: one task folds its new records, a batch of rows at a time, from the tail that the sink
holds.  Verification isn't: each record meets the one before it in an equi-join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ensure_importable, paths_below
from .vault import hmac_sha256

# The envelope's form.
GENESIS, VERSION = "0" * 64, 2
EVENT = "struct<actions:array<struct<action:string,count:bigint,kind:string>>,context:struct<data_category:string,jurisdiction:string,recipient:string>,operation:string,outcome:string,resolved:bigint,session:string,time_unix:bigint>"
ENVELOPE_KEYS = ("event", "previous_hash", "record_hash", "sequence", "v")


def action_counts(planned: DataFrame, *keys: str) -> DataFrame:
    """Counts by (kind, action) of exploded plans."""
    return planned.groupBy(*keys, "kind", "action").agg(F.count(F.lit(1)).alias("n"))


def counted(plan: Column) -> Column:
    """An event's actions of one plan: struct(action, count, kind) by kind and lower-case action; actions by their capital names."""
    pair = F.transform(plan, lambda e: F.struct(e["kind"].alias("kind"), e["action"].alias("action")))
    each = F.array_sort(F.array_distinct(pair))
    return F.transform(each, lambda x: F.struct(F.initcap(x["action"]).alias("action"), F.size(F.filter(pair, lambda p: p == x)).cast("long").alias("count"), x["kind"].alias("kind")))


def event(operation: str, *, outcome: Column, session: Column, now: Column, actions: Column | None = None, context: dict[str, Column] | None = None, resolved: Column | None = None) -> Column:
    """An event as compact JSON, keys sorted, nulls kept; a context has no purpose."""
    nothing = lambda t: F.lit(None).cast(t)
    ctx = F.struct(*[context[k].alias(k) for k in ("data_category", "jurisdiction", "recipient")]) if context else nothing("struct<data_category:string,jurisdiction:string,recipient:string>")
    every = {
        "actions": F.expr("cast(array() as array<struct<action:string,count:bigint,kind:string>>)") if actions is None else actions, "context": ctx, "operation": F.lit(operation), "outcome": outcome,
        "resolved": nothing("long") if resolved is None else resolved.cast("long"), "session": session, "time_unix": now.cast("long"),
    }
    return F.to_json(F.struct(*[v.alias(k) for k, v in every.items()]), {"ignoreNullFields": "false"})


def record_hash(previous: Column, sequence: Column, event: Column) -> Column:
    """sha256 of the previous hex digest, the sequence as 8 big-endian bytes, and the event's JSON."""
    return F.sha2(F.concat(F.encode(previous, "utf-8"), F.unhex(F.lpad(F.hex(sequence), 16, "0")), F.encode(event, "utf-8")), 256)


def line(record: dict[str, Column] | None = None) -> Column:
    """A record as a line of a log file."""
    c = record or {k: F.col(k) for k in ("sequence", "previous_hash", "record_hash", "event")}
    return F.concat(F.lit(f'{{"v":{VERSION},"sequence":'), c["sequence"].cast("string"), F.lit(',"previous_hash":"'), c["previous_hash"], F.lit('","record_hash":"'), c["record_hash"], F.lit('","event":'), c["event"], F.lit("}"))


def _fold(batches: Iterator, max_records: int, max_bytes: int) -> Iterator:
    """Records of rows (chain, event, tail, sequence, hash, bytes) in their order; the last three are of the chain's tail, generation counts its rotations."""
    import pyarrow as pa

    chain, gen, n, last, size = object(), 0, 0, GENESIS, 0
    for batch in batches:
        out = []
        for c, e, g, n0, h0, s0 in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if c != chain:
                chain, gen, n, last, size = c, g or 0, n0 or 0, h0 or GENESIS, s0 or 0
            more = len(e.encode()) + 200  # the envelope around an event
            if n and ((max_records and n + 1 > max_records) or (max_bytes and size + more > max_bytes)):
                gen, n, last, size = gen + 1, 0, GENESIS, 0
            h = hashlib.sha256(last.encode() + (n + 1).to_bytes(8, "big") + e.encode()).hexdigest()
            n, size = n + 1, size + more
            out.append((c, gen, n, last, h, e, size))
            last = h
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["chain", "generation", "sequence", "previous_hash", "record_hash", "event", "bytes"])


def chain(events: DataFrame, *, by: str, order: str, event: str, tails: DataFrame | None = None, max_records: int = 0, max_bytes: int = 0) -> DataFrame:
    """(by, generation, sequence, previous_hash, record_hash, event, bytes): each chain folded in its order by one task that holds a batch.

    ``tails`` (by, generation, sequence, record_hash, bytes) are where chains go on.  A limit over 0 starts a fresh
    chain, of the next generation, when a record would go beyond it.
    """
    ensure_importable(events.sparkSession)
    rows = events.select(F.col(by).cast("string").alias("chain"), F.col(event).alias("event"), F.col(order).alias("o"))
    if tails is None:
        rows = rows.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("generation", "long"), ("sequence", "long"), ("hash", "string"), ("bytes", "long"))])
    else:
        rows = rows.join(tails.select(F.col(by).cast("string").alias("chain"), "generation", "sequence", F.col("record_hash").alias("hash"), "bytes"), "chain", "left")
    dealt = rows.repartition("chain").sortWithinPartitions("chain", "o", "event").select("chain", "event", "generation", "sequence", "hash", "bytes")
    got = dealt.mapInArrow(lambda it: _fold(it, max_records, max_bytes), "chain string, generation long, sequence long, previous_hash string, record_hash string, event string, bytes long")
    return got.withColumnRenamed("chain", by)


def verify(log: DataFrame, *, by: str) -> DataFrame:
    """(by, records, failure, at): the first of sequence, linkage, hash that fails, and its sequence; nulls if the chain holds."""
    before = log.select(F.col(by).alias("__by"), (F.col("sequence") + 1).alias("__next"), F.col("record_hash").alias("__before"))
    got = log.join(before, (F.col(by) == F.col("__by")) & (F.col("sequence") == F.col("__next")), "left")
    want = F.when(F.col("sequence") == 1, F.lit(GENESIS)).otherwise(F.col("__before"))
    bad = F.when(want.isNull(), "sequence").when(F.col("previous_hash") != want, "linkage").when(F.col("record_hash") != record_hash(F.col("previous_hash"), F.col("sequence"), F.col("event")), "hash")
    got = got.withColumn("__bad", bad).groupBy(by).agg(F.count(F.lit(1)).alias("records"), F.max("sequence").alias("last"), F.min(F.when(F.col("__bad").isNotNull(), F.struct(F.col("sequence").alias("n"), F.col("__bad").alias("why")))).alias("x"))
    short = F.col("x").isNull() & (F.col("records") != F.col("last"))  # a record stands twice
    return got.select(by, "records", F.when(short, "sequence").otherwise(F.col("x.why")).alias("failure"), F.when(short, F.col("last")).otherwise(F.col("x.n")).cast("long").alias("at"))


def verify_files(files: DataFrame, *, by: str, contents: str) -> DataFrame:
    """(by, report, records, failure, at) of whole log files: report is empty, legacy, verified, unsupported_version or failure.

    A file's first line says whether it is chained or legacy (bare events).  The first line that fails decides:
    truncated (no final newline: at 0; an empty line), not_envelope, malformed, unsupported_version, sequence_gap,
    previous_hash_mismatch, record_hash_mismatch.  Retention bounds a file.
    """
    text = F.coalesce(F.col(contents), F.lit(""))
    rows = files.select(F.col(by).alias("k"), text.alias("t")).withColumn("cut", F.col("t").endswith("\n"))
    lines = rows.where("cut").select("k", F.posexplode(F.split(F.expr("left(t, length(t) - 1)"), "\n", -1)).alias("p", "line")).withColumn("at", F.col("p").cast("long") + 1)
    chained = F.startswith("line", F.lit('{"v":'))
    env = F.from_json("line", f"v long, sequence long, previous_hash string, record_hash string, event {EVENT}")
    raw_event = F.to_json(F.col("env.event"), {"ignoreNullFields": "false"})
    keys = F.array_sort(F.coalesce(F.json_object_keys("line"), F.array().cast("array<string>")))
    fine = (keys == F.array(*map(F.lit, ENVELOPE_KEYS))) & F.forall(F.array("env.sequence", "env.v"), lambda x: x.isNotNull()) & F.col("env.previous_hash").isNotNull() & F.col("env.record_hash").isNotNull() & F.col("env.event.operation").isNotNull()
    bare = F.from_json("line", EVENT)
    lines = lines.withColumns({"chained": chained, "env": env, "keys": keys, "bare": bare["operation"].isNotNull() & bare["session"].isNotNull() & bare["time_unix"].isNotNull()})
    mode = lines.where("at = 1").select("k", F.col("chained").alias("chain"))
    before = lines.select("k", (F.col("at") + 1).alias("at"), F.col("env.record_hash").alias("before"))
    got = lines.join(mode, "k").join(before, ["k", "at"], "left")
    odd = F.when(F.startswith("line", F.lit("{")), "not_envelope").otherwise("malformed")
    bad = (
        F.when(F.col("line") == "", "truncated").when(F.col("chain") & ~F.col("chained"), odd).when(~F.col("chain") & F.col("chained"), "not_envelope").when(~F.col("chain"), F.when(~F.coalesce("bare", F.lit(False)), odd))
        .when(F.coalesce(F.col("env.v") != VERSION, F.lit(True)), "unsupported_version").when(~F.coalesce(fine, F.lit(False)), "not_envelope").when(F.col("env.sequence") != F.col("at"), "sequence_gap")
        .when(F.col("env.previous_hash") != F.coalesce("before", F.lit(GENESIS)), "previous_hash_mismatch")
        .when(F.col("env.record_hash") != record_hash(F.col("env.previous_hash"), F.col("env.sequence"), raw_event), "record_hash_mismatch")
    )
    got = got.withColumn("bad", bad).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("chain").alias("chain"), F.min(F.when(F.col("bad").isNotNull(), F.struct("at", "bad"))).alias("x"))
    out = rows.select("k", "t", "cut").join(got, "k", "left")
    why = F.when(F.col("t") == "", F.lit(None)).when(~F.col("cut"), "truncated").otherwise(F.col("x.bad"))
    report = F.when(F.col("t") == "", "empty").when(why == "unsupported_version", "unsupported_version").when(why.isNotNull(), "failure").when(F.col("chain"), "verified").otherwise("legacy")
    return out.select(F.col("k").alias(by), report.alias("report"), F.when(why.isNull(), F.coalesce("n", F.lit(0))).cast("long").alias("records"), why.alias("failure"), F.when(why.isNotNull(), F.when(F.col("cut"), F.col("x.at")).otherwise(F.lit(0))).cast("long").alias("at"))


class AuditSink:
    """Records of one chain under ``path`` (a folder URI), a Parquet folder a batch; one writer at a time.

    ``max_records`` and ``max_bytes`` (0: unset) start fresh chains.  append() reads the last batch only, and fails
    if its last record doesn't hash to itself.  A batch number that is there already isn't written again.
    """

    def __init__(self, spark: SparkSession, path: str, max_records: int = 0, max_bytes: int = 0):
        if max_records < 0 or max_bytes < 0:
            raise ValueError("limits are 0 or more")
        self.spark, self.path, self.max_records, self.max_bytes = spark, path.rstrip("/"), max_records, max_bytes

    def batches(self) -> list[int]:
        names = [p.rsplit("/", 1)[1] for p in paths_below(self.spark, self.path)]
        return sorted(int(n[6:]) for n in names if n.startswith("batch=") and any(x.endswith("/_SUCCESS") for x in paths_below(self.spark, f"{self.path}/{n}")))

    def append(self, events: DataFrame, *, order: str = "o", event: str = "event", batch: int | None = None) -> None:
        known = self.batches()
        batch = (known[-1] + 1 if known else 0) if batch is None else batch
        if batch in known:
            return
        tails = None
        for n in reversed(known):
            last = self.spark.read.parquet(f"{self.path}/batch={n}").orderBy(F.desc("generation"), F.desc("sequence")).limit(1)
            if row := last.withColumn("ok", F.col("record_hash") == record_hash(F.col("previous_hash"), F.col("sequence"), F.col("event"))).first():
                if not row["ok"]:
                    raise ValueError("the audit log's tail doesn't verify")
                tails = last.select("sink", "generation", "sequence", "record_hash", "bytes")
                break
        one = events.withColumn("sink", F.lit("0"))
        chain(one, by="sink", order=order, event=event, tails=tails, max_records=self.max_records, max_bytes=self.max_bytes).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def read(self) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/batch={n}" for n in self.batches()])

    def verify(self) -> DataFrame:
        """(generation, records, failure, at)."""
        return verify(self.read(), by="generation")


def check_paths(**paths: str | None) -> None:
    """ValueError if two of the named paths are one, or one lies in another."""
    import posixpath

    named = [(k, posixpath.normpath(v.removeprefix("file:").rstrip("/"))) for k, v in paths.items() if v]
    for i, (a, x) in enumerate(named):
        for b, y in named[:i]:
            x, y = x.lstrip("/"), y.lstrip("/")
            if x == y or x.startswith(y + "/") or y.startswith(x + "/"):
                raise ValueError(f"{b} and {a} share a path")


# The marker around a token.
BEFORE, AFTER = "<!-- canary:", " -->"


def canary(key: bytes, scope: Column, label: str = "canary") -> Column:
    """Hex HMAC of the scope under a key of 32 bytes or more."""
    if len(key) < 32:
        raise ValueError("the key is under 32 bytes")
    return hmac_sha256(key, F.concat(F.lit(label), F.lit("\x00"), scope))


def marker(token: Column) -> Column:
    return F.concat(F.lit(BEFORE), token, F.lit(AFTER))


def verify_canary(text: Column, key: bytes, scope: Column) -> Column:
    """Whether the first marker of ``text`` holds 64 hex digits that are the scope's token; a first marker of another form decides too."""
    rest = F.when(F.instr(text, F.lit(BEFORE)) > 0, F.substr(text, F.instr(text, F.lit(BEFORE)) + len(BEFORE)))
    found = F.when(F.instr(rest, F.lit(AFTER)) > 0, F.substr(rest, F.lit(1), F.instr(rest, F.lit(AFTER)) - 1))
    return F.coalesce(found.rlike(r"^[0-9A-Fa-f]{64}\z") & (F.lower(found) == canary(key, scope)), F.lit(False))
