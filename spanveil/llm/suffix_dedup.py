"""Removal of long repeats by a distributed merge sort of suffixes that never compares a known prefix again.

A window of ``length`` bytes is a repeat if it also starts anywhere else.  Every window has an anchor: the place
of its least ``GRAM``-byte hash, which depends on the window alone, so equal windows have anchors in the same place
of them.  Only suffixes that begin at an anchor are sorted, and of those only such whose gram hash occurs at two
places; a suffix's item is the text from its anchor on as far as its windows reach, with the text before the
anchor that they reach back to.  Tasks sort items into runs and exchange them front-coded (length of the prefix
shared with the item before, and the rest) by range; a loser tree merges the runs of a range, comparing shared
prefix lengths first and bytes only beyond them.  In the merged order equal grams lie together, and the shared
prefixes to the right and, likewise sorted, to the left of the anchors tell which windows are equal.

Texts that occur several times are worked on once, and so are equal items.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import written

#: Bytes of an anchor's hash.
GRAM = 64
#: Windows that are looked at together, and bytes of items in a sorted run: only memory depends on them.
CHUNK, RUN_BYTES = 1 << 20, 48 << 20


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    n, base = CHUNK + 4096, 0x9E3779B97F4A7C15
    up = np.full(n, base, np.uint64)
    down = np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def anchors(raw: bytes, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(hash of the gram, its place, first and last start of the windows whose anchor it is), in chunks."""
    up, down = _powers()
    for at in range(0, max(0, len(raw) - length + 1), CHUNK):
        x = np.frombuffer(raw, np.uint8, min(len(raw) - at, CHUNK + length - 1), at).astype(np.uint64) + np.uint64(1)
        total = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x * up[: len(x)], out=total[1:])
        h = (total[GRAM:] - total[:-GRAM]) * down[: len(x) - GRAM + 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        w = length - GRAM + 1
        v = np.full(-(-len(h) // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
        v[: len(h)] = h & np.uint64(0xFFFFFFFF00000000) | np.arange(len(h), dtype=np.uint64)
        v = v.reshape(-1, w)
        fore = np.minimum.accumulate(v, axis=1).ravel()
        back = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(h) - w + 1
        place = (np.minimum(back[:n], fore[w - 1 : w - 1 + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        turn = np.flatnonzero(np.diff(place)) + 1
        lo, hi = np.append(0, turn), np.append(turn, n) - 1
        a = place[lo]
        yield h[a].view(np.int64), a + at, lo + at, hi + at


def shared(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes need no look."""
    n = min(len(a), len(b))
    d = int.from_bytes(a[known:n]) ^ int.from_bytes(b[known:n])
    return n - (d.bit_length() + 7) // 8


class LoserTree:
    """Merges sorted runs of (shared prefix with the item before, text, rest) into one such sequence."""

    def __init__(self, runs: list[Iterator[tuple[int, bytes, object]]]):
        self.runs, self.k = runs, len(runs)
        self.head: list = [next(r, None) for r in runs]
        self.known = [0] * self.k  # prefix that the head shares with what came out last
        self.loser = [-1] * self.k

    def _beats(self, i: int, j: int) -> bool:
        """Whether head i comes before head j; the loser's known prefix becomes that shared with the winner."""
        a, b = self.head[i], self.head[j]
        if a is None or b is None:
            return b is None
        known = self.known
        if known[i] != known[j]:
            return known[i] > known[j]
        x, y = a[1], b[1]
        n = shared(x, y, known[i])
        if n == len(x) or (n < len(y) and x[n] < y[n]):
            known[j] = n
            return True
        known[i] = n
        return False

    def _play(self, i: int) -> int:
        at = (i + self.k) // 2
        while at:
            j = self.loser[at]
            if j < 0:
                self.loser[at] = i
                return -1
            if self._beats(j, i):
                self.loser[at], i = i, j
            at //= 2
        return i

    def __iter__(self) -> Iterator[tuple[int, bytes, object]]:
        best = -1
        for i in range(self.k):
            if (w := self._play(i)) >= 0:
                best = w
        if self.k == 1:
            best = 0
        while best >= 0 and (out := self.head[best]) is not None:
            yield self.known[best], out[1], out[2]
            new = self.head[best] = next(self.runs[best], None)
            self.known[best] = new[0] if new else 0
            best = self._play(best) if self.k > 1 else 0


def front_code(items: list[tuple[bytes, bytes, bytes]]) -> bytes:
    """Sorted (text, left, digest) as one run."""
    out, last = [], b""
    for text, left, digest in items:
        n = shared(last, text)
        out += [struct.pack("<HHH", n, len(text) - n, len(left)), digest, text[n:], left]
        last = text
    return b"".join(out)


def unfold(run: bytes) -> Iterator[tuple[int, bytes, tuple[bytes, bytes]]]:
    at, last = 0, b""
    while at < len(run):
        n, rest, left = struct.unpack_from("<HHH", run, at)
        digest, at = run[at + 6 : at + 22], at + 22
        last = last[:n] + run[at : at + rest]
        yield n, last, (run[at + rest : at + rest + left], digest)
        at += rest + left


def equal_windows(right: list[int], lefts: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """For distinct items in right order, the ranges (first, last) of bytes before the anchor at which windows that start there occur in another item.

    right[i]: prefix that item i shares with item i - 1 to the right of the anchor.
    """
    n = len(lefts)
    turned = [x[::-1] for x in lefts]
    order = sorted(range(n), key=turned.__getitem__)
    left = np.array([0] + [shared(turned[order[i - 1]], turned[order[i]]) for i in range(1, n)])
    right_ = np.array(right)
    right_[0] = 0
    most = max(map(len, lefts))
    # between these, which items are alike on either side doesn't change
    cuts = np.unique(np.concatenate([[0, most + 1], left[1:] + 1, length - right_[1:]]))
    cuts = cuts[(cuts >= 0) & (cuts <= most + 1)]
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    by = np.empty(n, np.int64)
    for first, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if not ((left[1:] >= first).any() and (right_[1:] >= length - first).any()):
            continue
        by[order] = np.cumsum(left < first) if first else 0
        both = np.cumsum(right_ < length - first) * (n + 1) + by
        _, back, count = np.unique(both, return_inverse=True, return_counts=True)
        for i in np.flatnonzero(count[back] > 1).tolist():
            if out[i] and out[i][-1][1] == first - 1:
                out[i][-1] = out[i][-1][0], end - 1
            else:
                out[i].append((first, end - 1))
    return out


def merge_range(runs: list[bytes], length: int) -> Iterator[tuple[bytes, int, int]]:
    """(digest, first, last) of equal_windows() over all groups of equal grams in the runs of one range."""
    right: list[int] = []
    lefts: list[bytes] = []
    digests: list[bytes] = []

    def close():
        if len(digests) > 1:
            for d, ranges in zip(digests, equal_windows(right, lefts, length), strict=True):
                for a, b in ranges:
                    yield d, a, b

    seen: set[bytes] = set()
    least = 1 << 30
    for known, _, (left, digest) in LoserTree([unfold(r) for r in runs]):
        least = min(least, known)
        if known < GRAM:
            yield from close()
            right, lefts, digests, seen = [], [], [], set()
        if digest not in seen:  # an equal item, of another run
            seen.add(digest)
            right.append(least)
            lefts.append(left)
            digests.append(digest)
            least = 1 << 30
    yield from close()


def find_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = 400) -> DataFrame:
    """(md5, spans, copies): for texts with anything to remove, md5 of the text and the spans (start, end) of its bytes, ascending and apart; copies: rows of that text.

    A null text is empty.  Rows of equal text repeat each other, whatever their ids.  Texts under ``length`` bytes
    have no spans; an empty table gives an empty table; other columns aren't read.
    """
    spark = docs.sparkSession
    whole = F.coalesce(F.col(text), F.lit(""))
    own = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("~")).alias("id"), whole.alias("text"), F.md5(whole).alias("md5"))

    def find(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen: set[str] = set()  # a text that a task meets again has the same places
        for batch in batches:
            for md5, t in zip(batch.column("md5"), batch.column("text"), strict=True):
                if md5.as_py() in seen:
                    continue
                seen.add(md5.as_py())
                raw = t.as_py().encode()
                for h, a, lo, hi in anchors(raw, length):
                    by = np.argsort(h, kind="stable")  # a row for all places of a gram: repetitive texts have one at every byte
                    h, a, lo, hi = h[by], a[by], lo[by], hi[by]
                    new = np.append(0, np.flatnonzero(np.diff(h)) + 1)
                    first = pa.array([int.from_bytes(raw[p : p + 8]) >> 1 for p in a.tolist()], pa.int64())
                    at = pa.StructArray.from_arrays([pa.array(a), pa.array(lo), pa.array(hi), first], ["a", "lo", "hi", "first"])
                    at = pa.ListArray.from_arrays(pa.array(np.append(new, len(h)), pa.int32()), at)
                    yield pa.RecordBatch.from_arrays([pa.array([md5.as_py()] * len(new), pa.string()), pa.array(h[new]), at], names=["md5", "gram", "at"])

    places, _ = written(own.where(F.octet_length("text") >= length).select("md5", "text").mapInArrow(_whole_batches(find), "md5 string, gram long, at array<struct<a:long,lo:long,hi:long,first:long>>"), "anchors")
    least, most = F.struct("md5", F.array_min("at.a").alias("a")), F.struct("md5", F.array_max("at.a").alias("a"))
    twice = places.groupBy("gram").agg(F.min(least).alias("x"), F.max(most).alias("y")).where("x != y").select("gram")
    twice, _ = written(twice, "twice")  # a table, so that the join can split a gram that many texts have
    chosen = places.join(twice, "gram", "left_semi")
    chosen = chosen.groupBy("md5").agg(F.flatten(F.collect_set("at")).alias("at"))
    texts = own.where(F.octet_length("text") >= length).groupBy("md5").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    texts, _ = written(texts.join(chosen, "md5", "left"), "texts")
    n = texts.agg(F.sum(F.size(F.array_distinct("at.first")))).first()[0] or 0
    ranges = max(1, min(20_000, max(n // 8192, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    marks = texts.where("at is not null").select(F.explode(F.array_distinct("at.first")).alias("f")).agg(F.percentile_approx("f", [i / ranges for i in range(1, ranges)] or [0.5], 20 * ranges)).first()[0] or []
    marks = sorted(set(marks)) if ranges > 1 else []
    # by text and id, so that the copies of a text don't meet in a task
    work = own.select("id", "md5", "text").join(texts.where("at is not null").select("md5", "id", "at"), ["md5", "id"]).select("md5", "text", "at")

    def sort(batches: Iterator) -> Iterator:
        import pyarrow as pa

        split, held, size = np.array(marks, np.int64), {}, 0
        names = ["range", "run", "item", "md5", "at"]
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.list_(pa.struct([(c, pa.int64()) for c in ("a", "lo", "hi")]))]

        def flush():
            by: dict[int, list] = {}
            for digest, (r, right, left) in held.items():
                by.setdefault(r, []).append((right, left, digest))
            for r, items in by.items():
                items.sort()
                run = front_code(items)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(([r], [run], *[[None]] * 3), kinds, strict=True)], names=names)
            held.clear()

        for batch in batches:
            for md5, t, at in zip(*(batch.column(c) for c in ("md5", "text", "at")), strict=True):
                raw, refs = t.as_py().encode(), {}
                for s in at.as_py():
                    a, lo, hi = s["a"], s["lo"], s["hi"]
                    left, right = raw[lo:a], raw[a : hi + length]
                    digest = hashlib.md5(struct.pack("<H", len(left)) + left + right).digest()
                    refs.setdefault(digest, []).append({"a": a, "lo": lo, "hi": hi})
                    if digest not in held:
                        held[digest] = int(np.searchsorted(split, s["first"], "right")), right, left
                        size += len(left) + len(right) + 200
                none = [None] * len(refs)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((none, none, list(refs), [md5.as_py()] * len(refs), list(refs.values())), kinds, strict=True)], names=names)
            if size > RUN_BYTES:
                yield from flush()
                size = 0
        yield from flush()

    sorted_, _ = written(work.mapInArrow(sort, "range int, run binary, item binary, md5 string, at array<struct<a:long,lo:long,hi:long>>"), "runs")

    def merge(table):
        import pyarrow as pa

        got = list(merge_range(table.column("run").to_pylist(), length))
        d, a, b = zip(*got, strict=True) if got else ((), (), ())
        return pa.table([pa.array(d, pa.binary()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["item", "first", "last"])

    merged = sorted_.where("run is not null").select("range", "run").groupBy("range").applyInArrow(merge, "item binary, first long, last long")
    # a text's places may come in another order from rows that repeat an id
    refs = sorted_.where("item is not null").select("item", "md5", F.array_sort("at").alias("at")).distinct()
    again = refs.groupBy("item").agg(F.sum(F.size("at")).alias("n")).where("n > 1").select("item", F.lit(0).cast("long").alias("first"), F.lit(1 << 40).alias("last"))
    hits, _ = written(merged.union(again).groupBy("item").agg(F.collect_list(F.struct("first", "last")).alias("r")), "repeats")
    spans = refs.join(hits, "item").select("md5", "at", "r").mapInArrow(_reach(length), "md5 string, spans array<struct<start:long,end:long>>")
    spans = spans.groupBy("md5").agg(F.flatten(F.collect_list("spans")).alias("spans")).mapInArrow(_union, "md5 string, spans array<struct<start:long,end:long>>")
    return texts.select("md5", "copies").join(spans, "md5", "left").where("copies > 1 or spans is not null")


def _whole_batches(f):
    """Yields of ``f`` joined to larger batches."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        part, n = [], 0
        for b in f(batches):
            part.append(b)
            n += len(b)
            if n >= 8192:
                yield from pa.Table.from_batches(part).combine_chunks().to_batches()
                part, n = [], 0
        if part:
            yield from pa.Table.from_batches(part).combine_chunks().to_batches()

    return run


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans as ascending runs; those that touch are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _spans_batch(md5: list[str], spans: list[list[tuple[int, int]]]):
    import pyarrow as pa

    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.RecordBatch.from_arrays([pa.array(md5, pa.string()), pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], kind)], names=["md5", "spans"])


def _reach(length: int):
    """Bytes that the equal windows around an item's places cover, for rows (md5, at, r)."""

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            out = []
            for at, r in zip(batch.column("at").to_pylist(), batch.column("r").to_pylist(), strict=True):
                got = ((max(p["lo"], p["a"] - x["last"]), min(p["hi"], p["a"] - x["first"]) + length) for p in at for x in r)
                out.append(joined([(a, b) for a, b in got if b - a >= length]))
            some = [i for i, x in enumerate(out) if x]
            md5 = batch.column("md5").to_pylist()
            yield _spans_batch([md5[i] for i in some], [out[i] for i in some])

    return run


def _union(batches: Iterator) -> Iterator:
    for batch in batches:
        yield _spans_batch(batch.column("md5").to_pylist(), [joined([(s["start"], s["end"]) for s in x]) for x in batch.column("spans").to_pylist()])


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = 400, keep_bytes: bool = False) -> DataFrame:
    """``docs`` without its text, with n_bytes, n_removed, n_spans (long), kept_sha256, kept_bytes (long) and, if asked for, kept (binary).

    kept: the bytes that no repeat covers, concatenated (it can split a character).  Texts that occur in several
    rows go wholly if they have ``length`` bytes.  Cases as in find_repeats(); columns of those names are replaced.
    """
    found = find_repeats(docs, doc_id=doc_id, text=text, length=length).withColumnsRenamed({"md5": "__md5", "spans": "__spans", "copies": "__copies"})
    found, _ = written(found, "found")  # a table, so that the join can split a text that many rows have
    got = docs.withColumn("__md5", F.md5(F.coalesce(F.col(text), F.lit("")))).join(found, "__md5", "left").drop("__md5")
    new = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string", "kept_bytes": "long"} | ({"kept": "binary"} if keep_bytes else {})

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from .common import put

        for batch in batches:
            rows = []
            for t, spans, copies in zip(*(batch.column(c) for c in (text, "__spans", "__copies")), strict=True):
                raw, spans = (t.as_py() or "").encode(), [(s["start"], s["end"]) for s in spans.as_py() or ()]
                if (copies.as_py() or 1) > 1 and len(raw) >= length:
                    spans = [(0, len(raw))]
                kept, at = [], 0
                for a, b in spans:
                    kept.append(raw[at:a])
                    at = b
                kept = b"".join([*kept, raw[at:]])
                rows.append((len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), len(kept), kept)[: len(new)])
            cols = list(zip(*rows, strict=True)) or [()] * len(new)
            kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
            rest = batch.select([n for n in batch.schema.names if n not in (text, "__spans", "__copies")])
            yield put(rest, {k: pa.array(c, kinds[t]) for (k, t), c in zip(new.items(), cols, strict=True)})

    from .common import out_schema

    return got.mapInArrow(run, out_schema(got.drop(text, "__spans", "__copies"), new))


#: DuckDB for remove_repeats() of ``documents`` with the default length: every 400-byte string by its MD5.
SQL = """
WITH b AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
w AS MATERIALIZED (SELECT r, i, md5_number(substr(h, 2 * i + 1, 800)) AS m FROM (SELECT r, h, unnest(range(0, n - 399)) AS i FROM b WHERE n >= 400)),
hit AS (SELECT r, i, i - lag(i) OVER (PARTITION BY r ORDER BY i) AS step FROM w SEMI JOIN (SELECT m FROM w GROUP BY m HAVING count(*) > 1) d USING (m)),
run AS (SELECT r, i, count(*) FILTER (step IS NULL OR step > 400) OVER (PARTITION BY r ORDER BY i) AS k FROM hit),
span AS (SELECT r, min(i) AS s, max(i) + 400 AS e FROM run GROUP BY r, k),
kept AS (SELECT r, s, e, lag(e, 1, 0) OVER (PARTITION BY r ORDER BY s) AS before FROM span),
built AS (SELECT b.r, CAST(sum(e - s) AS BIGINT) AS gone, count(*) AS spans, string_agg(substr(h, 2 * before + 1, 2 * (s - before)), '' ORDER BY s) || substr(any_value(h), 2 * max(e) + 1) AS h FROM kept JOIN b ON b.r = kept.r GROUP BY b.r)
SELECT doc_id, n AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(built.h, b.h))) AS kept_sha256, n - coalesce(gone, 0) AS kept_bytes FROM b LEFT JOIN built ON built.r = b.r
"""
