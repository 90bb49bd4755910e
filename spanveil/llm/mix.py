"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Each source queues its shuffled documents, again and again up to ``max_repeats`` times; a queued document's
virtual finish time is its source's tokens up to and with it, divided by the source's target.  The queue of all
sources is cut where its running total reaches the budget.  Sources get hot, so every running total is taken in
two levels: buckets of the shuffle key within a source, and 4,096 bands of virtual time over all; the band in which
the budget ends is cut into bands again until it is small enough to be sorted row by row.  What that gives is, for each
source and turn, the last document taken, so the decision about a document needs no shuffle of its text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import written
from .common import word_count

#: Bands of virtual time, and items of a band that are sorted at most; any numbers give the same mix.
BANDS, EDGE = 4096, 65_536
#: Documents to a bucket of the shuffle key, about; any number gives the same mix.
BUCKET_ROWS = 512


def targets(sizes: DataFrame, weights: tuple[float, ...], max_repeats: int, share: float) -> DataFrame:
    """(skey, source_size, target) of (skey, size): sources by skey weigh ``weights``, repeating; none is above max_repeats times its size."""
    per = sizes.groupBy("skey").agg(F.sum("size").alias("source_size"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(Window.orderBy("skey")) - 1).cast("int") % len(weights) + 1)
    cap = F.col("source_size") * F.lit(float(max_repeats))
    order = Window.orderBy(cap / F.col("w"), "skey")
    per = per.withColumn("w", w)
    level = (F.floor(F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))) - F.coalesce(F.sum(cap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", level).withColumn("level", F.when(cap / F.col("w") >= F.col("level"), F.col("level")))
    # levels fall short of the caps from the first source on that isn't capped; null: all are
    per = per.withColumn("level", F.first("level", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return per.select("skey", "source_size", F.least(cap, F.coalesce(F.col("level") * F.col("w"), cap)).alias("target"))


def mix_sources(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (5, 2, 1), max_repeats: int = 3, share: float = 1.0, seed: str = "mix", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: its id, size, source_size, target, copies, taken (= copies x size), and the columns in ``carry``.

    Size is the number of words (null text: 0).  The budget is ``share`` of all sizes.  Sources rank by code
    point, null last.  A source's documents are taken whole, in the order of md5(seed, id); copies says how often.
    Documents of a source without words come once, as they use no budget.  Equal rows count each and share a
    fate; documents with a null id queue like others; an empty table gives an empty table; columns of the result
    win over carried columns of the same name.
    """
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))
    buckets = max(64, min(1 << 24, docs.count() // BUCKET_ROWS))
    full = docs.select(
        F.col(doc_id).alias("id"), word_count(text).alias("size"), F.substring(key, 1, 16).alias("h"),
        F.coalesce(F.concat(F.lit("0"), F.col(source).cast("string")), F.lit("1")).alias("skey"),
        F.struct(*[F.col(c) for c in carry]).alias("carried") if carry else F.lit(None).cast("string").alias("carried"),
    )
    # texts are read once for the sizes, and once more only if they are to come along; they are never shuffled
    base, _ = written(full.withColumn("carried", F.lit(None).cast("string")), "sizes")
    bucket = F.floor(F.conv(F.substring("h", 1, 6), 16, 10).cast("long") * buckets / F.lit(float(1 << 24))).cast("int")
    groups = base.groupBy("skey", bucket.alias("bucket"), "h", "id", "size").agg(F.count(F.lit(1)).alias("n")).withColumn("all", F.col("n") * F.col("size"))
    groups, _ = written(groups, "groups")  # rows that repeat an id are one
    per_bucket = groups.groupBy("skey", "bucket").agg(F.sum("all").alias("size"))
    before = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0))).drop("size")
    # a row a source: Spark broadcasts it where it is small
    goals, _ = written(targets(per_bucket, weights, max_repeats, share), "targets")
    within = Window.partitionBy("skey", "bucket").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    queued = groups.withColumn("cum", F.sum("all").over(within)).join(offsets, ["skey", "bucket"]).withColumn("cum", F.col("cum") + F.col("offset"))
    queued, _ = written(queued.join(goals.where("target > 0"), "skey").drop("bucket", "offset", "n"), "queue")
    finish = (F.col("cum") + F.col("epoch") * F.col("source_size")) / F.col("target")
    items = queued.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1)))).withColumn("vft", finish)
    budget = per_bucket.agg(F.floor(F.sum("size") * F.lit(float(share))).cast("long").alias("b")).first()["b"] or 0
    last = _cut(items, budget)
    row = F.struct("h", "id", "size")
    ends = queued.select("skey").distinct() if last is False else items.where(last).groupBy("skey").agg(*[F.max(F.when(F.col("epoch") == e, row)).alias(f"end{e}") for e in range(max_repeats)])
    # of each source's queue, the last document taken at each turn
    goals, _ = written(goals.join(ends, "skey", "left"), "ends")  # a table of known size, so that documents don't move for it
    turns = F.lit(0) if last is False else sum((F.when(F.coalesce(row <= F.col(f"end{e}"), F.lit(False)), 1).otherwise(0) for e in range(max_repeats)), F.lit(0))
    copies = F.when(F.col("target") > 0, turns).otherwise(1)
    new = {doc_id, "size", "source_size", "target", "copies", "taken"}
    got = (full if carry else base).join(goals, "skey").withColumn("copies", copies)
    return got.select(F.col("id").alias(doc_id), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"), *[F.col("carried").getField(c).alias(c) for c in carry if c not in new])


def _cut(items: DataFrame, budget: int) -> Column | bool:
    """Which of the queued items (vft, skey, h, id, size, all) the budget takes, in the order of virtual finish times; False: none.

    The band of virtual time in which the budget ends is cut into BANDS finer ones until it has EDGE items or fewer;
    only those are sorted one by one.  Items without words don't use the budget, and go with those before them.
    """
    top = items.agg(F.max("vft").alias("m")).first()["m"]
    if top is None:
        return False
    low, high, before, here, taken, rows = 0.0, max(1.0, math.nextafter(top, math.inf)), 0, F.lit(True), F.lit(False), None
    while True:
        band = F.least(F.floor((F.col("vft") - low) / (high - low) * BANDS), F.lit(BANDS - 1)).cast("int")
        bands = items.where(here).groupBy(band.alias("band")).agg(F.sum("all").alias("all"), F.count(F.lit(1)).alias("n"), F.min("vft").alias("lo"), F.max("vft").alias("hi"))
        hit = bands.withColumn("upto", F.sum("all").over(Window.orderBy("band")) + before).where(F.col("upto") > budget).orderBy("band").first()
        if hit is None:
            return taken | here  # all
        before = hit["upto"] - hit["all"]
        taken = taken | (here & (band < hit["band"]))
        here = here & (band == hit["band"])
        if hit["n"] <= EDGE or hit["lo"] == hit["hi"] or hit["n"] == rows:
            break
        low, high, rows = hit["lo"], math.nextafter(hit["hi"], math.inf), hit["n"]
    order = ["vft", "skey", "h", "id", "size"]
    edge = items.where(here & (F.col("all") > 0)).withColumn("upto", F.sum("all").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) + before)
    last = edge.where(F.col("upto") <= budget).orderBy(*[F.col(c).desc() for c in order]).select(*order).first()
    if last is None:
        return taken
    kind = dict(items.dtypes)
    return taken | (here & (F.struct(*[F.col(c) for c in order]) <= F.struct(*[F.lit(last[c]).cast(kind[c]) for c in order])))


#: DuckDB for the same mix of ``documents`` with the default parameters.
SQL = """
WITH base AS (SELECT doc_id, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
    substr(md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16) AS h, coalesce('0' || source, '1') AS skey FROM documents),
per AS (SELECT skey, CAST(sum(size) AS BIGINT) AS source_size, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY skey) - 1) % 3 + 1 AS INT)]::DOUBLE AS w FROM base GROUP BY skey),
lev AS (SELECT *, source_size * 3.0::DOUBLE AS cap, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(source_size * 3.0::DOUBLE) OVER (ORDER BY source_size * 3.0::DOUBLE / w, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY source_size * 3.0::DOUBLE / w, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM per),
cut AS (SELECT min_by(level, cap / w) AS level FROM lev WHERE cap / w >= level),
tgt AS (SELECT skey, source_size, least(cap, coalesce(cut.level * w, cap)) AS target FROM lev, cut),
q AS (SELECT b.*, t.source_size, t.target, CAST(sum(size) OVER (PARTITION BY skey ORDER BY h, doc_id, size) AS BIGINT) AS cum FROM base b JOIN tgt t USING (skey)),
items AS (SELECT q.*, e, (cum + e * source_size)::DOUBLE / target AS vft FROM q, (SELECT unnest([0, 1, 2]) AS e) WHERE target > 0),
g AS (SELECT *, sum(size) OVER (ORDER BY vft, skey, h, doc_id, size) AS upto FROM items),
n AS (SELECT doc_id, h, skey, size, count(*) AS c FROM g WHERE upto <= (SELECT sum(size) FROM base) GROUP BY ALL)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(coalesce(n.c, 0) * q.size AS BIGINT) AS taken
FROM q LEFT JOIN n ON q.h = n.h AND q.skey = n.skey AND q.size = n.size AND q.doc_id IS NOT DISTINCT FROM n.doc_id
"""
