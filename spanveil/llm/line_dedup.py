"""Line dedup by pairwise alignment.

Lines are hashed; a run of adjacent lines that together have ``min_words`` words links each document that has it
to the first one that does.  Linked pairs are aligned with patience diff on line hashes, and aligned common blocks
are deleted from the later document.  Where a line of such a run stays, the document is aligned with ever more of
the run's other earlier holders, until it goes or all are tried: what is deleted is what alignment of all pairs
deletes, however many documents share it, and a run that goes at once costs a pair a document.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import written
from .common import release, word_count

SPANS = "spans array<struct<start:int,end:int>>"
#: Of the hashes of runs; runs of equal hashes by chance cost an alignment, no more.
PRIME, BASE = (1 << 61) - 1, 0x9E3779B97F4A7C15 % ((1 << 61) - 1)
#: Further holders of a run that a document meets in the second round, about, and the growth of that from round to round; any number deletes the same lines.
EACH = 16


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matched positions of a and b, ascending in both: common heads and tails, and in between the longest
    ascending run of lines that are unique on both sides, again and again. Where none is, nothing more matches."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, k, j, m = todo.pop()
        while i < k and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < k and j < m and a[k - 1] == b[m - 1]:
            k, m = k - 1, m - 1
            out.append((k, m))
        if i == k or j == m:
            continue
        where: dict[int, list[int]] = {}
        for n in range(i, k):
            where.setdefault(a[n], [0, 0, n, 0])[0] += 1
        for n in range(j, m):
            if (w := where.get(b[n])) is not None:
                w[1] += 1
                w[3] = n
        both = [(w[2], w[3]) for w in where.values() if w[0] == w[1] == 1]  # in a's order
        chain = _rising(both)
        edges = [(i - 1, j - 1), *chain, (k, m)]
        out += chain
        if chain:
            todo += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(edges, edges[1:], strict=False) if p + 1 < r and q + 1 < s]
    return sorted(out)


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs whose second numbers rise, by patience sorting."""
    from bisect import bisect_left

    tops: list[int] = []
    last: list[int] = []
    back: list[int] = []
    for n, (_, q) in enumerate(pairs):
        pile = bisect_left(tops, q)
        back.append(last[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(q)
            last.append(n)
        else:
            tops[pile], last[pile] = q, n
    out, n = [], last[-1] if last else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def blocks(a: list[int], words: list[int], b: list[int], min_words: int) -> list[tuple[int, int]]:
    """Spans of a's lines that stand in b as one aligned block with ``min_words`` words or more."""
    out, run = [], []
    for pair in [*patience(a, b), (-2, -2)]:
        if run and pair != (run[-1][0] + 1, run[-1][1] + 1):
            if sum(words[i] for i, _ in run) >= min_words:
                out.append((run[0][0], run[-1][0] + 1))
            run = []
        run.append(pair)
    return out


def find_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_words: int = 10) -> DataFrame:
    """(key, spans): for documents with anything to delete, key = row_key() and the spans (start, end) of lines.

    The earlier of two documents has the smaller id (null last), then the smaller md5 of its text.  Rows of equal
    id and text are one document.  Of documents of equal text the first stays, and the others' lines are one
    block.  White space around lines doesn't count; blank lines align but bring no words; null and empty texts
    have nothing to delete; other columns aren't read.
    """
    line = lambda x: F.trim(F.translate(x, "\t\r\x0b\x0c", "    "))
    own = docs.select(F.struct(F.col(doc_id).isNull().alias("z"), F.col(doc_id).alias("id"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("md5")).alias("o"), F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), line).alias("lines"))
    own = own.select("o", F.transform("lines", lambda x: F.when(x == "", F.lit(0)).otherwise(F.xxhash64(x)).cast("long")).alias("h"), F.transform("lines", lambda x: word_count(x).cast("int")).alias("w"))
    own, _ = written(own, "lines")
    own = own.withColumn("key", _key("o")).drop_duplicates(["key"])
    # documents of equal text: all but the first lose their lines, if those are worth a block
    first, _ = written(own.groupBy(F.col("o.md5").alias("md5")).agg(F.min("o").alias("first")), "firsts")
    marked = own.join(first, F.col("o.md5") == first["md5"]).select("key", "o", "h", "w", (F.col("o") == F.col("first")).alias("is_first"))
    marked, _ = written(marked, "texts")
    whole = marked.where(~F.col("is_first") & (F.aggregate("w", F.lit(0), lambda a, x: a + x) >= min_words))
    whole = whole.select("key", F.array(F.struct(F.lit(0).alias("start"), F.size("h").alias("end"))).alias("spans"))
    kept = marked.where("is_first")
    linked = kept.mapInArrow(lambda it: _links(it, min_words), f"o {marked.schema['o'].dataType.simpleString()}, run long")
    holders = linked.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.min("o").alias("holder")).where("n > 1")
    holders, _ = written(holders, "holders")  # a table, so that the join can split a run that many have
    shared, _ = written(linked.join(holders, "run"), "shared")
    later = shared.where(F.col("o") != F.col("holder"))

    def aligned(pairs: DataFrame) -> DataFrame:
        sides = pairs.join(kept.select("key", "h", "w"), "key").join(kept.select(F.col("key").alias("to"), F.col("h").alias("g")), "to").select("key", "h", "w", "g")
        return written(sides.mapInArrow(lambda it: _align(it, min_words), f"key string, {SPANS}"), "aligned")[0]

    found = aligned(later.select(_key("o").alias("key"), _key("holder").alias("to")).distinct())
    todo, low, high = later.where("n > 2"), 0, EACH
    while True:
        wanted = todo.groupBy(_key("o").alias("key")).agg(F.collect_list(F.struct("run", "n", "holder")).alias("links"))
        spans = found.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"))
        docs_of = wanted.join(kept.select("key", "o", "h", "w"), "key").join(spans, "key", "left")
        todo, _ = written(docs_of.mapInArrow(lambda it: _still_there(it, min_words), later.schema).where(F.col("n") > low), "open")
        if todo.isEmpty():
            break
        others = shared.select("run", F.col("o").alias("e"))
        turn = F.pmod(F.xxhash64("e.md5", "run"), F.col("n"))
        pairs = todo.join(others, "run").where((F.col("e") < F.col("o")) & (F.col("e") != F.col("holder")) & (turn >= low) & (turn < high))
        found = found.union(aligned(pairs.select(_key("o").alias("key"), _key("e").alias("to")).distinct()))
        low, high = high, high * EACH
    return found.groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans")).union(whole)


def runs(h: list[int], words: list[int], min_words: int) -> Iterator[tuple[int, int, int]]:
    """(link, start, end): from each line on, and back from each line, the shortest run of lines with ``min_words`` words.

    Each line of an aligned block of ``min_words`` words is in such a run that lies in the block, so both documents have its link.
    """
    sums = [0]  # of a polynomial in the lines' hashes
    for x in h:
        sums.append((sums[-1] * BASE + x) % PRIME)
    power = [1]
    spans, n = set(), 0
    j = 0
    for i in range(len(h)):  # from i on
        while j < len(h) and n < min_words:
            n += words[j]
            j += 1
        if n < min_words:
            break
        spans.add((i, j))
        n -= words[i]
    i = len(h)
    n = 0
    for j in range(len(h), 0, -1):  # back from j
        while i and n < min_words:
            i -= 1
            n += words[i]
        if n < min_words:
            break
        spans.add((i, j))
        n -= words[j - 1]
    for i, j in spans:
        while len(power) <= j - i:
            power.append(power[-1] * BASE % PRIME)
        yield (sums[j] - sums[i] * power[j - i]) % PRIME, i, j


def _links(batches: Iterator, min_words: int) -> Iterator:
    """Each link of a document once."""
    import pyarrow as pa

    for batch in batches:
        rows, links = [], []
        for n, (h, w) in enumerate(zip(batch.column("h"), batch.column("w"), strict=True)):
            own = {x for x, _, _ in runs(h.as_py(), w.as_py(), min_words)}
            rows += [n] * len(own)
            links += own
        o = batch.column("o").take(pa.array(rows, pa.int64()))
        yield pa.RecordBatch.from_arrays([o, pa.array(links, pa.int64())], names=["o", "run"])


def _align(batches: Iterator, min_words: int) -> Iterator:
    import pyarrow as pa

    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        keys, spans = [], []
        for k, h, w, g in zip(*(batch.column(c) for c in ("key", "h", "w", "g")), strict=True):
            if got := blocks(h.as_py(), w.as_py(), g.as_py(), min_words):
                keys.append(k.as_py())
                spans.append([{"start": a, "end": b} for a, b in got])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(spans, kind)], names=["key", "spans"])
    release()


def _still_there(batches: Iterator, min_words: int) -> Iterator:
    """Those of a document's links that stand somewhere in it with a line that no span deletes."""
    import pyarrow as pa

    for batch in batches:
        rows, out = [], []
        for n, (h, w, links, spans) in enumerate(zip(*(batch.column(c) for c in ("h", "w", "links", "spans")), strict=True)):
            gone = [0] * (len(h) + 1)
            for s in spans.as_py() or []:
                gone[s["start"]] += 1
                gone[s["end"]] -= 1
            stay, deep = [0], 0  # undeleted lines before each
            for d in gone[:-1]:
                deep += d
                stay.append(stay[-1] + (not deep))
            left = {x for x, i, j in runs(h.as_py(), w.as_py(), min_words) if stay[j] > stay[i]}
            mine = [x for x in links.as_py() if x["run"] in left]
            rows += [n] * len(mine)
            out += mine
        o, got = batch.column("o").take(pa.array(rows, pa.int64())), pa.array(out, batch.schema.field("links").type.value_type)
        yield pa.RecordBatch.from_arrays([got.field("run"), o, got.field("n"), got.field("holder")], names=["run", "o", "n", "holder"])


def _key(order: str) -> Column:
    o = F.col(order)
    return F.concat(F.coalesce(o["id"].cast("string"), F.lit("~")), F.lit(":"), o["md5"])


def delete_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """``docs`` with aligned repeats deleted from ``text``, and n_lines, n_removed (long). Cases as in find_repeats(); null texts stay null."""
    ensure = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("~")), F.lit(":"), F.md5(F.coalesce(F.col(text), F.lit(""))))
    spans = find_repeats(docs, doc_id=doc_id, text=text, **options).withColumnsRenamed({"key": "__key", "spans": "__spans"})
    got = docs.withColumn("__key", ensure).join(spans, "__key", "left").withColumn("__lines", F.split(text, "\n"))
    keep = F.filter("__lines", lambda x, i: ~F.exists("__spans", lambda s: (s["start"] <= i) & (i < s["end"])))
    got = got.withColumn("__kept", F.when(F.col("__spans").isNull(), F.col("__lines")).otherwise(keep))
    n, m = F.coalesce(F.size("__lines"), F.lit(0)), F.coalesce(F.size("__kept"), F.lit(0))
    n, m = F.greatest(n, F.lit(0)), F.greatest(m, F.lit(0))
    new = {text: F.when(F.col("__spans").isNull(), F.col(text)).otherwise(F.array_join("__kept", "\n")), "n_lines": n.cast("long"), "n_removed": (n - m).cast("long")}
    return got.select(*[c for c in docs.columns if c not in new], *[v.alias(k) for k, v in new.items()])
