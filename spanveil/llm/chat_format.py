"""Chat formatting with budgeted windows, in DataFrame operations only.

Prefix sums of turn tokens choose the windows: the line of a conversation's tokens is cut every ``stride`` =
budget - system - history tokens (history: half of what the system turn leaves, at most), and a turn belongs to the window in whose stretch it ends.  A window starts with
the conversation's leading system turn, repeats the turns that lie within the last ``history`` tokens before its
stretch (masked), and ends with its own turns, whose assistant texts are the targets.  A turn that crosses a cut
and is longer than ``history`` gets a window of its own.  So no window is above the budget unless one turn and
the system turn together are.  Prefix sums are taken in two levels (blocks of turn numbers within a
conversation), windows have a bounded number of turns, and no step of format_chats() holds a whole conversation; read_back()
gathers each, since its digests are of whole ones.

Control strings inside texts are escaped reversibly: ``~`` becomes ``~0``, and the first character of a control
string ``~1`` for ``[`` and ``~2`` for ``<`` (line feeds of roles: ``~3``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import word_count

#: The template's own marks, and strings that other templates use as controls.
OPEN, CLOSE = "<s>", "</s>"
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
#: Tokens that a turn's marks count.
OVERHEAD = 4
BLOCK = 64


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("~"), F.lit("~0"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(("~1" if c[0] == "[" else "~2") + c[1:]))
    return out


def unescape(text: Column) -> Column:
    for mark, char in (("~1", "["), ("~2", "<"), ("~3", "\n"), ("~0", "~")):
        text = F.replace(text, F.lit(mark), F.lit(char))
    return text


def format_chats(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", budget: int = 512, history: int = 128) -> DataFrame:
    """One row per window: conv_id, window_no, formatted, n_system, n_repeated, n_new, tokens, over_budget, loss_spans.

    loss_spans: array of (start, end) in characters of ``formatted``, over the new assistant turns' texts as
    escaped.  Turns order by turn (null last), role, text; null roles and texts are empty; equal rows stay, each a
    turn; turns with a null conv_id make one conversation; other columns are ignored, whatever their names; an
    empty table gives an empty table.
    """
    rows = turns.select(
        F.coalesce(F.concat(F.lit("1"), F.col(conv_id).cast("string")), F.lit("0")).alias("ck"), F.col(conv_id).alias("conv"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).withColumn("tokens", word_count("text") + OVERHEAD).withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit((1 << 62))).cast("long"))
    order = [F.col("turn").asc_nulls_last(), F.col("role"), F.col("text")]
    within = Window.partitionBy("ck", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("local", F.sum("tokens").over(within)).withColumn("rn", F.count(F.lit(1)).over(within))
    blocks = rows.groupBy("ck", "block").agg(F.sum("tokens").alias("sum"), F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("rn") == 1, F.struct("role", "text", "tokens"))).alias("first"))
    before = Window.partitionBy("ck").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy("ck").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "ck", "block", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("tokens_before"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
        F.when(F.sum("n").over(all_) > 1, F.first("first").over(all_)).alias("lead"),
    ).withColumn("system", F.when(F.col("lead.role") == "system", F.col("lead"))).drop("lead")
    rows = rows.join(blocks, ["ck", "block"])
    sys_tokens = F.coalesce(F.col("system.tokens"), F.lit(0))
    rows = rows.withColumn("pos", F.col("rows_before") + F.col("rn")).where(F.col("system").isNull() | (F.col("pos") > 1))
    rows = rows.withColumn("end", F.col("tokens_before") + F.col("local") - sys_tokens).withColumn("start", F.col("end") - F.col("tokens"))
    rows = rows.withColumn("past", F.greatest(F.lit(0), F.least(F.lit(history), F.floor((F.lit(budget) - sys_tokens) / 2))))
    stride = F.greatest(F.lit(1), F.lit(budget) - sys_tokens - F.col("past"))
    cell = F.floor((F.col("end") - 1) / F.col("stride"))
    own = (F.floor(F.col("start") / F.col("stride")) < F.col("cell")) & (F.col("tokens") > F.col("past"))
    rows = rows.withColumn("stride", stride).withColumn("cell", cell).withColumn("own", own)
    here = F.struct((F.col("cell") * 2 + F.when(F.col("own"), 0).otherwise(1)).alias("window_no"), F.lit(False).alias("repeated"))
    again = F.struct((F.col("cell") * 2 + 3).alias("window_no"), F.lit(True).alias("repeated"))
    repeats = ~F.col("own") & (F.col("start") >= (F.col("cell") + 1) * F.col("stride") - F.col("past"))
    rows = rows.select("ck", "conv", "system", "pos", "role", "text", "tokens", F.inline(F.when(repeats, F.array(here, again)).otherwise(F.array(here))))
    got = rows.groupBy("ck", "window_no").agg(
        F.first("conv").alias("conv"), F.first("system").alias("system"), F.array_sort(F.collect_list(F.struct("pos", "repeated", "role", "text", "tokens"))).alias("t"),
    )
    new, old = F.filter("t", lambda x: ~x["repeated"]), F.filter("t", lambda x: x["repeated"])
    got = got.withColumn("new", new).withColumn("old", old).where(F.size("new") > 0)
    # history counts only where nothing lies between it and the window's first own turn
    got = got.withColumn("old", F.when((F.size("old") > 0) & F.coalesce(F.expr("try_element_at(old, -1).pos + 1 = try_element_at(new, 1).pos"), F.lit(False)), F.col("old")).otherwise(F.slice("old", 1, 0)))
    head = F.when(F.col("system").isNotNull(), F.array(F.struct(F.lit(0).cast("long").alias("pos"), F.lit(True).alias("repeated"), F.col("system.role").alias("role"), F.col("system.text").alias("text"), F.col("system.tokens").alias("tokens")))).otherwise(F.slice("new", 1, 0))
    got = got.withColumn("n_system", F.size(head)).withColumn("all", F.concat(head, "old", "new"))
    got = got.withColumn("parts", F.transform("all", lambda x: F.struct(
        F.concat(F.lit(OPEN), F.replace(escape(x["role"]), F.lit("\n"), F.lit("~3")), F.lit("\n")).alias("mark"), escape(x["text"]).alias("body"), (~x["repeated"] & (x["role"] == "assistant")).alias("target"),
    )))
    size = lambda p: F.length(p["mark"]) + F.length(p["body"]) + len(CLOSE)
    spans = F.transform("parts", lambda p, i: F.struct(p["target"].alias("target"), (F.aggregate(F.slice(F.col("parts"), 1, i), F.lit(0), lambda a, q: a + size(q)) + F.length(p["mark"])).alias("start"), F.length(p["body"]).alias("n")))
    tokens = F.aggregate("all", F.lit(0).cast("long"), lambda a, x: a + x["tokens"])
    return got.select(
        F.col("conv").alias(conv_id), "window_no", F.array_join(F.transform("parts", lambda p: F.concat(p["mark"], p["body"], F.lit(CLOSE))), "").alias("formatted"),
        "n_system", F.size("old").alias("n_repeated"), F.size("new").alias("n_new"), tokens.alias("tokens"), (tokens > budget).alias("over_budget"),
        F.transform(F.filter(spans, lambda s: s["target"]), lambda s: F.struct(s["start"].alias("start"), (s["start"] + s["n"]).alias("end"))).alias("loss_spans"),
    )


def read_back(windows: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """A row per conversation from format_chats()'s output alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    cut = F.split("formatted", CLOSE)
    turn = lambda p: F.concat(unescape(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), "\n", 1)), F.lit("\n"), unescape(F.substr(p, F.position(F.lit("\n"), p) + 1)), F.lit("\n"))
    each = windows.select(
        F.col(conv_id).alias("conv"), "window_no", F.length("formatted").cast("long").alias("chars"), "n_new", "n_system",
        F.array_join(F.transform(F.slice(cut, 1, F.col("n_system")), turn), "").alias("head"),
        F.array_join(F.transform(F.slice(cut, F.col("n_system") + F.col("n_repeated") + 1, F.col("n_new")), turn), "").alias("body"),
        F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))), "").alias("loss"),
    )
    got = each.groupBy("conv").agg(F.sum("chars").alias("formatted_chars"), (F.sum("n_new") + F.max("n_system")).alias("n_turns"), F.max("head").alias("head"), F.array_sort(F.collect_list(F.struct("window_no", "body", "loss"))).alias("w"))
    loss = F.array_join(F.transform("w", lambda x: x["loss"]), "")
    return got.select(
        F.col("conv").alias(conv_id), F.col("n_turns").cast("long").alias("n_turns"), F.sha2(F.concat("head", F.array_join(F.transform("w", lambda x: x["body"]), "")), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


def _sql_escape(x: str) -> str:
    x = f"replace({x}, '~', '~0')"
    for c in CONTROLS:
        x = f"replace({x}, '{c}', '{('~1' if c[0] == '[' else '~2') + c[1:]}')"
    return x


#: DuckDB for read_back(format_chats(conversations and conversation -1)), budget 512, history 128.
SQL = f"""
WITH r0 AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
r1 AS (SELECT *, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) + 4 AS tokens, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
    length(replace({_sql_escape('role')}, chr(10), '~3')) + length({_sql_escape('text')}) + 8 AS chars FROM r0 WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text)),
r2 AS (SELECT *, coalesce(max(tokens) FILTER (pos = 1 AND role = 'system' AND n > 1) OVER (PARTITION BY conv_id), 0) AS st, coalesce(max(chars) FILTER (pos = 1 AND role = 'system' AND n > 1) OVER (PARTITION BY conv_id), 0) AS sc,
    sum(tokens) OVER (PARTITION BY conv_id ORDER BY pos) AS p FROM r1),
r3 AS (SELECT *, p - st AS e, p - st - tokens AS s, greatest(0, least(128, CAST(floor((512 - st) / 2) AS BIGINT))) AS past, greatest(1, 512 - st - past) AS stride FROM r2 WHERE st = 0 OR pos > 1),
r4 AS (SELECT *, CAST(floor((e - 1) / stride) AS BIGINT) AS cell, CAST(floor(s / stride) AS BIGINT) < CAST(floor((e - 1) / stride) AS BIGINT) AND tokens > past AS own FROM r3),
w AS (SELECT conv_id, cell * 2 + CASE WHEN own THEN 0 ELSE 1 END AS wno, min(pos) AS first_pos, sum(chars) AS chars, any_value(sc) AS sc FROM r4 GROUP BY ALL),
h AS (SELECT conv_id, cell * 2 + 3 AS wno, max(pos) AS last_pos, sum(chars) AS chars FROM r4 WHERE NOT own AND s >= (cell + 1) * stride - past GROUP BY ALL),
f AS (SELECT w.conv_id, sum(w.chars + w.sc + CASE WHEN h.last_pos + 1 = w.first_pos THEN h.chars ELSE 0 END) AS formatted_chars
    FROM w LEFT JOIN h ON w.conv_id IS NOT DISTINCT FROM h.conv_id AND w.wno = h.wno GROUP BY w.conv_id),
d AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256 FROM r1 GROUP BY conv_id)
SELECT d.conv_id, CAST(n_turns AS BIGINT) AS n_turns, turns_sha256, CAST(loss_chars AS BIGINT) AS loss_chars, loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM d JOIN f ON d.conv_id IS NOT DISTINCT FROM f.conv_id
"""
