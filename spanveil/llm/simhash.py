"""SimHash near-duplicates by the generalised pigeonhole principle.

64-bit fingerprints are cut into parts of correlated bits.  If part thresholds t_i sum to max_bits - parts + 1, two
fingerprints within ``max_bits`` differ in at most t_i bits of some part i (t_i = -1 skips a part).  Each
fingerprint allocates its own thresholds by dynamic programming over estimated candidate counts (histograms of all
fingerprints, taken as independent between halves of a part), probes the part values within them, and verifies
what it meets.

Two rounds keep dense groups linear.  First each row of a part value meets the few first ones and the least one
of that value, which joins most of a dense group at a link a member; then all pairs whose ends aren't joined yet.
A crowded part value's rows are dealt out as a grid of blocks in which those of its largest set never meet each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import written
from .common import out_schema, put
from .components import components

#: Fingerprints with one part value that a block holds at most, about, and how many of them the others meet in the first round; any numbers find the same links.
BLOCK, FIRST = 4096, 16
#: Probes a fingerprint and word for which parts are chosen, at most: each is a row of the shuffle, so that more of them would let the disk grow faster than the table; any number of parts finds the same links.
PROBES = 64


def hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 with seed 42 of every shingle, repeats included: A-Z lower-cased, words at ASCII white space; a text of fewer words is one shingle."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    norm = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    ends = (ends - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(norm[s:e], 42) for s, e in zip(starts, ends[min(shingle, len(words)) - 1 :], strict=False)], dtype=np.uint64)


def bits_of(h: np.ndarray, words: int = 1) -> list[int]:
    """``words`` fingerprints of 64 bits: a bit is 1 if over half of the hashes have it; each word takes the hashes of the one before, mixed. No hash: 0."""
    out = []
    for i in range(words):
        h = _mixed(h) if i else h
        ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0]))
    return out


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Unsigned SimHash of the whole text. No word: 0."""
    return bits_of(hashes(text, shingle))[0]


def _mixed(h: np.ndarray) -> np.ndarray:
    """Another 64 bits of each hash (the SplitMix64 step)."""
    h = h + np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprints(df: DataFrame, text: str = "text", shingle: int = 4) -> DataFrame:
    """``df`` without its text, with fp (long, the 64 bits as signed). Null texts have no words; a column of this name is replaced."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            got = np.array([fingerprint(v.as_py(), shingle) for v in batch.column(text)], np.uint64).view(np.int64)
            yield put(batch.select([n for n in batch.schema.names if n != text]), {"fp": pa.array(got, pa.int64())})

    return df.mapInArrow(run, out_schema(df.drop(text), {"fp": "long"}))


class Plan:
    """Parts of correlated bits and the estimates of the candidates within each threshold of a part's value."""

    def __init__(self, max_bits: int, n: int, parts: list[list[int]]):
        self.max_bits, self.n, self.parts = max_bits, n, parts
        self.total = max_bits - len(parts) + 1
        self.top = min(max(self.total, -1) + len(parts) - 1, max_bits)  # the largest threshold: the other parts are skipped
        self.halves = [[p[: len(p) // 2], p[len(p) // 2 :]] for p in parts]
        self.near: list[list[np.ndarray]] = []

    def learn(self, counts: dict[tuple[int, int], np.ndarray]) -> None:
        """counts: (part, half) -> histogram of that half's values over all fingerprints."""
        self.near = []
        for i, halves in enumerate(self.halves):
            self.near.append([])
            for j, bits in enumerate(halves):
                hist, idx, by = counts[i, j] / max(1, self.n), np.arange(1 << len(bits)), []
                for d in range(self.top + 1):
                    by.append(sum((hist[idx ^ sum(1 << b for b in c)] for c in combinations(range(len(bits)), d)), np.zeros(len(idx))))
                self.near[i].append(np.array(by))

    def allocate(self, fps: np.ndarray) -> np.ndarray:
        """Thresholds of each fingerprint's parts, by dynamic programming on estimated candidates and probes."""
        top, m = self.top, len(self.parts)
        best = np.full((len(fps), self.total + m + 1), np.inf)
        best[:, 0] = 0  # over the parts so far, by thresholds' sum plus their number
        picks = []
        for i in range(m):
            a, b = (self.near[i][j][:, take(fps, self.halves[i][j])] for j in (0, 1))
            cost = [np.zeros(len(fps))]
            seen = probes = 0.0
            for t in range(top + 1):
                within = sum((a[d] * b[t - d] for d in range(t + 1) if d < len(a) and t - d < len(b)), np.zeros(len(fps)))
                seen, probes = seen + within * self.n, probes + math.comb(len(self.parts[i]), t)
                cost.append(seen + probes)
            nxt, pick = np.full_like(best, np.inf), np.zeros(best.shape, np.int8)
            for t, c in enumerate(cost):
                for s in range(best.shape[1] - t):
                    v = best[:, s] + c
                    better = v < nxt[:, s + t]
                    nxt[better, s + t], pick[better, s + t] = v[better], t
            best = nxt
            picks.append(pick)
        out, at, rows = np.zeros((len(fps), m), np.int8), np.full(len(fps), self.total + m), np.arange(len(fps))
        for i in reversed(range(m)):
            t = picks[i][rows, at]
            out[:, i], at = t - 1, at - t
        return out


def take(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    """The values of some bits, packed in their order."""
    out = np.zeros(len(fps), np.int64)
    for k, b in enumerate(bits):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
    return out


def group_bits(corr: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` parts of like size, each grown from its strongest correlation by the bit most correlated with it."""
    left, out = set(range(64)), []
    for k in range(parts):
        size = math.ceil(len(left) / (parts - k))
        ls = sorted(left)
        sub = np.abs(corr[np.ix_(ls, ls)])
        np.fill_diagonal(sub, -1)
        own = [ls[i] for i in np.unravel_index(np.argmax(sub), sub.shape)] if len(ls) > 1 else ls
        while len(own) < size:
            rest = [b for b in ls if b not in own]
            own.append(rest[int(np.argmax(np.abs(corr[np.ix_(own, rest)]).sum(0)))])
        out.append(sorted(own[:size]))
        left -= set(out[-1])
    return out


def cheapest_parts(n: int, max_bits: int) -> int:
    """The number of parts for n fingerprints: few and wide ones cost probes (which are shuffled, so no more than PROBES if possible), many and narrow ones candidates."""

    def cost(m: int) -> tuple[bool, float]:
        total = max_bits - m + 1
        probes = candidates = 0.0
        for i in range(m):
            w, t = 64 // m, total // m + (i < total % m)
            near = sum(math.comb(w, d) for d in range(t + 1))
            probes, candidates = probes + near, candidates + n * near / 2**w
        return probes > PROBES, 100 * probes + candidates  # a probe is a row of the shuffle, a candidate one comparison of many at once

    return min(range(2, max(2, max_bits + 1) + 1), key=cost) if max_bits else 2


def make_plans(fps: DataFrame, max_bits: int, parts: int | None = None) -> list[Plan]:
    """A plan for each column of ``fps``, from all rows. What reaches the driver is 64 x 64 sums and two histograms of at most 2^16 counts a part, for each."""
    n, words = fps.count(), len(fps.columns)
    m = parts or cheapest_parts(n, max_bits)

    def sums(batches: Iterator) -> Iterator:
        import pyarrow as pa

        out = np.zeros((words, 64, 64))
        for batch in batches:
            for w in range(words):
                bits = np.unpackbits(batch.column(w).to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                out[w] += bits.T @ bits
        k = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(out.ravel()[k].astype(np.int64))], names=["k", "n"])

    every = np.zeros(words * 64 * 64)
    for r in fps.mapInArrow(sums, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        every[r["k"]] = r["n"]
    plans = []
    for both in every.reshape(words, 64, 64) / max(1, n):
        p = np.diag(both)
        sd = np.sqrt(p * (1 - p)) + 1e-9
        plans.append(Plan(max_bits, n, group_bits((both - np.outer(p, p)) / np.outer(sd, sd), m)))
    halves = [(w, i, j, bits) for w, plan in enumerate(plans) for i, h in enumerate(plan.halves) for j, bits in enumerate(h)]

    def values(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x = [c.to_numpy().view(np.uint64) for c in batch.columns]
            for k, (w, _, _, bits) in enumerate(halves):
                v, c = np.unique(take(x[w], bits), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), k, np.int32)), pa.array(v), pa.array(c)], names=["k", "v", "n"])

    counts = [{(i, j): np.zeros(1 << len(bits)) for u, i, j, bits in halves if u == w} for w in range(words)]
    for r in fps.mapInArrow(values, "k int, v long, n long").groupBy("k", "v").agg(F.sum("n").alias("n")).toLocalIterator():
        w, i, j, _ = halves[r["k"]]
        counts[w][i, j][r["v"]] = r["n"]
    for plan, own in zip(plans, counts, strict=True):
        plan.learn(own)
    return plans


class Sets:
    """Union-find over what a task has seen."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        r = up.setdefault(x, x)
        while up[r] != r:
            up[r] = up[up[r]]
            r = up[r]
        return r

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def _keyed(nodes: DataFrame, plans: list[Plan], probe: bool) -> DataFrame:
    """``nodes`` (longs; the first columns are the plans' words) by part value: key, the words from the one it is of on (fp, x1 and so on), and the other columns; with ``probe`` by all values within the row's thresholds."""
    count = len(plans)
    names = ["key", *_words(count), *nodes.columns[count:]]
    masks = [[[np.array([sum(1 << b for b in c) for c in combinations(range(len(p)), d)], np.int64) for d in range(plan.top + 1)] for p in plan.parts] for plan in plans]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for big in batches:
            for at in range(0, len(big), 1024):
                whole = np.stack([c.slice(at, 1024).to_numpy() for c in big.columns])
                for w, plan in enumerate(plans):
                    own = whole[[*((w + k) % count for k in range(count)), *range(count, len(whole))]]
                    x = own[0].view(np.uint64)
                    got = plan.allocate(x) if probe else None
                    for i, bits in enumerate(plan.parts):
                        v = take(x, bits)
                        for d in range(plan.top + 1 if probe else 1):
                            on = np.flatnonzero(got[:, i] >= d) if probe else np.arange(len(x))
                            if len(on):
                                keys = (v[on][:, None] ^ masks[w][i][d][None, :] if probe else v[:, None]).ravel()
                                key = (keys * len(plan.parts) + i) * count + w
                                each = np.repeat(own[:, on], len(key) // len(on), axis=1)
                                yield pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(c) for c in each)], names=names)

    return nodes.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _words(count: int) -> list[str]:
    return ["fp", *(f"x{k}" for k in range(1, count))]


def _apart(x: np.ndarray, y: np.ndarray, max_bits: int, all_bits: int) -> np.ndarray:
    """Differing bits of words (a row each) that broadcast, 999 where the first ones' or all are too many."""
    first = np.bitwise_count(x[0] ^ y[0]).astype(np.int16)
    total = first.copy()
    for u, v in zip(x[1:], y[1:], strict=True):
        total += np.bitwise_count(u ^ v)
    return np.where((first <= max_bits) & (total <= all_bits), total, 999)


def _first(dealt: DataFrame, words: int, max_bits: int, all_bits: int) -> DataFrame:
    """(a, b): for each row of key, d, words, node, with the key's least one's words and node, that and the nearest of the FIRST ones before it, if they are near enough."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if not len(batch):
                continue
            key, d, *cols = (c.to_numpy() for c in batch.columns)
            own, node = np.stack(cols[:words]).view(np.uint64), cols[words]
            least, least_node = np.stack(cols[words + 1 : -1]).view(np.uint64), cols[-1]
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (d[1:] != d[:-1])) + 1  # a run that the batches cut has more first ones, which does no harm
            begin, end = np.append(0, cuts), np.append(cuts, len(key))
            near = _apart(own, least, max_bits, all_bits) < 999
            a, b = [node[near]], [least_node[near]]
            more = end - begin > 1
            for s, e in zip(begin[more].tolist(), end[more].tolist(), strict=True):
                x = own[:, s:e]
                far = _apart(x[:, :, None], x[:, None, :FIRST], max_bits, all_bits)
                far[np.arange(e - s)[:, None] <= np.arange(far.shape[1])[None, :]] = 999
                j = far.argmin(1)
                on = np.flatnonzero(far[np.arange(e - s), j] < 999)
                a.append(node[s:e][on])
                b.append(node[s:e][j[on]])
            a, b = np.concatenate(a), np.concatenate(b)
            on = a != b
            yield pa.RecordBatch.from_arrays([pa.array(a[on], pa.int64()), pa.array(b[on], pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def _meet(dealt: DataFrame, words: int, max_bits: int, all_bits: int) -> DataFrame:
    """(a, b): roots of rows that are near enough, of rows (key, d, p, kind, words, root) with kind 0 and 1 and equal key, d, p, in that order; a pair only where a task's earlier pairs don't connect it."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sets, at, held = Sets(), None, []
        for batch in batches:
            if not len(batch):
                continue
            key, d, p, kind, *own_cols = (c.to_numpy() for c in batch.columns)
            whole = np.stack(own_cols)
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (d[1:] != d[:-1]) | (p[1:] != p[:-1])) + 1
            begin, end = np.append(0, cuts), np.append(cuts, len(key))
            worth = (np.minimum.reduceat(kind, begin) == 0) & (np.minimum.reduceat(whole[-1], begin) != np.maximum.reduceat(whole[-1], begin))
            worth[[0, -1]] = True  # a run may go on in the next batch
            found: list[tuple[int, int]] = []
            for a, b in zip(begin[worth].tolist(), end[worth].tolist(), strict=True):
                if at != (here := (key[a], d[a], p[a])):
                    at, held = here, []
                k = a + int(np.searchsorted(kind[a:b], 1))
                if k > a:
                    held.append(whole[:, a:k])
                if k == b or not held:
                    continue
                held = [np.concatenate(held, axis=1)]
                own = held[0]
                for s in range(k, b, 256):
                    q = whole[:, s : min(s + 256, b)]
                    i, j = np.nonzero((np.bitwise_count((q[0][:, None] ^ own[0][None, :]).view(np.uint64)) <= max_bits) & (q[-1][:, None] != own[-1][None, :]))
                    if words > 1 and len(i):
                        on = np.flatnonzero(_apart(q[:words, i].view(np.uint64), own[:words, j].view(np.uint64), max_bits, all_bits) < 999)
                        i, j = i[on], j[on]
                    x, y = q[-1][i], own[-1][j]
                    if len(x) > 4096:  # a dense group: most of these are joined already
                        seen, back = np.unique(np.concatenate([x, y]), return_inverse=True)
                        root = np.array([sets.root(v) for v in seen.tolist()])[back]
                        new = np.flatnonzero(root[: len(x)] != root[len(x) :])
                        x, y = x[new], y[new]
                    found += [(u, v) for u, v in zip(x.tolist(), y.tolist(), strict=True) if sets.join(u, v)]
            if found:
                x, y = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def links(nodes: DataFrame, max_bits: int = 4, words: tuple[str, ...] = ("fp",), all_bits: int | None = None) -> DataFrame:
    """(a, b): links between nodes (column node and the words: longs, no repeated node) that connect whatever all links connect.

    A link is a pair within ``max_bits`` in one of the words and, if given, within ``all_bits`` in all of them together.
    """
    count, all_bits = len(words), 64 * len(words) if all_bits is None else all_bits
    nodes = nodes.select(*words, "node")
    plans = make_plans(nodes.select(*words), max_bits)
    own = _words(count)
    data = _keyed(nodes, plans, False)
    size = F.ceil(F.col("n") / BLOCK).cast("int")
    least = data.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("node", *own)).alias("least")).where("n > 1")
    least, _ = written(least.select("key", size.alias("k"), *[F.col(f"least.{c}").alias(f"least_{c}") for c in (*own, "node")]), "part-values")
    dealt = data.join(least, "key").select("key", F.pmod(F.xxhash64("node"), "k").cast("int").alias("d"), *own, "node", *[f"least_{c}" for c in (*own, "node")])
    first = _first(dealt.repartition("key", "d").sortWithinPartitions("key", "d", "node"), count, max_bits, all_bits).distinct()
    first, _ = written(first, "first-links")
    rooted = nodes.join(components(first), "node", "left").select(*words, "node", F.coalesce("root", "node").alias("root"))
    rooted, _ = written(rooted, "rooted")

    data, probes = _keyed(rooted, plans, False), _keyed(rooted, plans, True)
    crowded = data.join(least.where("k > 1").select("key"), "key").groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    crowded = crowded.groupBy("key").agg(F.max(F.struct("n", "root")).alias("lead"), F.sum("n").alias("n"))
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / BLOCK)).cast("int")
    crowded, _ = written(crowded.select("key", F.col("lead.root").alias("lead"), blocks(F.col("lead.n")).alias("own"), blocks(F.col("n") - F.col("lead.n")).alias("rest")), "crowded")
    # blocks of the rows that aren't of the key's largest set, then blocks of that set; elsewhere one block
    leads, mine, rest = F.coalesce(F.col("root") == F.col("lead"), F.lit(False)), F.coalesce("own", F.lit(0)), F.coalesce("rest", F.lit(1))
    block = F.when(leads, rest + F.pmod(F.xxhash64("node"), mine)).otherwise(F.pmod(F.xxhash64("node"), rest)).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.when(leads, rest).otherwise(rest + mine) - 1))
    to = lambda rows, d, p, kind: rows.join(crowded, "key", "left").select("key", d.alias("d"), p.alias("p"), F.lit(kind).alias("kind"), *own, "root")
    dealt = to(data, block, others, 0).union(to(probes, others, block, 1)).repartition("key", "d", "p").sortWithinPartitions("key", "d", "p", "kind")
    return first.union(_meet(dealt, count, max_bits, all_bits))


def group(df: DataFrame, *, doc_id: str = "doc_id", max_bits: int = 4) -> DataFrame:
    """``df`` (with fp) and component_id: the smallest doc_id reachable by fingerprints within ``max_bits``, the row's own included.

    Rows with a null id take part but name no component (null where a component has no other); repeated rows come
    out each; an empty table gives an empty table.
    """
    nodes, _ = written(df.groupBy("fp").agg(F.min(doc_id).alias("__least")), "fingerprints")
    roots = components(links(nodes.withColumn("node", F.col("fp")), max_bits))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least, _ = written(named.groupBy("root").agg(F.min("__least").alias("component_id")), "roots")  # a table, so that the join can split a large group
    named = named.join(least, "root").select("fp", "component_id")
    return df.drop("component_id").join(named, "fp")
