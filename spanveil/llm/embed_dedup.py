"""Embedding near-duplicates by dual traversal of cover trees.

Distinct vectors go to the nearest of a bounded number of pivots and there to blocks of bounded size.  Each block
builds one cover tree over its unit vectors: nested levels with halving radii, every node with the largest
distance to what lies below it.  Pairs of blocks, and then pairs of nodes, are left out where the triangle
inequality rules out a pair within the threshold's chord.  Where a level has about as many pairs of children as of vectors
(random vectors: every one is a child of the root) it rules nothing out that a plain comparison doesn't, and all vectors below are
compared, first by some coordinates and the lengths of the rest, a bound of the cosine from above in single precision.
What remains is compared in double precision.  Trees are
files in the shared folder, which tasks read by path, so vectors are shuffled once.  A task returns, for each vector, how
many it links to and a spanning forest of the links, never the pairs.
"""

from __future__ import annotations

import math
import struct
import uuid
from collections.abc import Iterator
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import fresh_path, written
from .components import components

#: Vectors to a block, about, pivots at most, and bytes of pivots at most; any numbers give the same links.
BLOCK, PIVOTS, PIVOT_BYTES = 4096, 16_384, 32 << 20
#: Numbers gathered at once where node pairs are expanded, and child pairs from which a product of matrices does it; only speed and memory depend on them.
EXPAND, WIDE = 1 << 21, 1 << 12
#: Pairs of vectors to a pair of children up to which all vectors below are compared; only speed depends on it.
FLAT = 8
#: What rounding may add to a distance, and to a cosine in single precision.
SLACK, SINGLE = 1e-6, 1e-5


class CoverTree:
    """Nested cover tree over unit vectors ``x``; node arrays only, so that it goes over the wire as bytes."""

    def __init__(self, x: np.ndarray, leaf: float = 0.02):
        self.x, self._low = x, None
        center, rho, kids, members = [], [], [], []

        def node(c: int, of: np.ndarray, d: np.ndarray) -> int:
            center.append(c)
            rho.append(float(d.max(initial=0)))
            kids.append(np.empty(0, np.int32))
            members.append(of)
            return len(center) - 1

        def far(own: np.ndarray, c: int) -> np.ndarray:
            return np.sqrt(np.maximum(0, 2 - 2 * (own @ x[c])))

        every = np.arange(len(x), dtype=np.int32)
        first = far(x, 0) if len(x) else np.empty(0)
        todo = [(node(0, every, first), first, 1.0)] if len(x) else []
        while todo:
            at, d, r = todo.pop()
            of = members[at]
            while r > leaf and len(of) > 1 and (d <= r).all():  # a level with the centre alone
                r /= 2
            if len(of) == 1 or r <= leaf:
                continue
            own, rest, xs, c, dc = [], of, x[of], center[at], d
            while len(rest):
                near = dc <= r
                near[rest == c] = True
                child = node(c, rest[near], dc[near])
                own.append(child)
                if (n := near.sum()) > 1:
                    todo.append((child, dc[near], r / 2))
                after = slice(1, None) if n == 1 and near[0] else ~near  # the first one alone: no copy
                rest, xs = rest[after], xs[after]
                if len(rest):
                    c = int(rest[0])
                    dc = far(xs, c)
            kids[at], members[at] = np.array(own, np.int32), np.empty(0, np.int32)
        self.center, self.rho, self.kids, self.members = np.array(center, np.int32), np.array(rho), kids, members

        self.fan = len(kids[0]) if kids else 0  # the root's children
        self.size = np.array([len(m) for m in members], np.int64)
        for n in range(len(kids) - 1, -1, -1):  # children come after their node
            if len(self.kids[n]):
                self.size[n] = self.size[self.kids[n]].sum()

    def under(self, node: int) -> np.ndarray:
        """The vectors below a node."""
        if len(self.x) == self.size[node]:
            return np.arange(len(self.x), dtype=np.int32)
        out, todo = [], [node]
        while todo:
            n = todo.pop()
            out.append(self.members[n])
            todo += self.kids[n].tolist()
        return np.concatenate(out)

    def low(self, k: int) -> np.ndarray:
        """The vectors' first ``k`` coordinates and the length of the rest: their product is no less than the cosine."""
        if self._low is None or self._low.shape[1] != k + 1:
            own = self.x[:, :k]
            self._low = np.column_stack([own, np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", own, own)))]).astype(np.float32)
        return self._low

    def dump(self) -> bytes:
        parts = [np.array(self.x.shape, np.int64).tobytes(), self.x.tobytes(), self.center.tobytes(), self.rho.tobytes(), self.size.tobytes()]
        for group in (self.kids, self.members):
            parts += [np.array([len(g) for g in group], np.int32).tobytes(), np.concatenate([*group, np.empty(0, np.int32)]).astype(np.int32).tobytes()]
        return b"".join(struct.pack("<q", len(p)) + p for p in parts)

    @classmethod
    def load(cls, raw: bytes) -> CoverTree:
        parts, at = [], 0
        while at < len(raw):
            (n,) = struct.unpack_from("<q", raw, at)
            parts.append(raw[at + 8 : at + 8 + n])
            at += 8 + n
        t = cls.__new__(cls)
        t.x = np.frombuffer(parts[1]).reshape(np.frombuffer(parts[0], np.int64))
        t._low = None
        t.center, t.rho, t.size = np.frombuffer(parts[2], np.int32), np.frombuffer(parts[3]), np.frombuffer(parts[4], np.int64)
        t._lists = parts[5:7], parts[7:9]
        t.fan = np.frombuffer(parts[5], np.int32)[0] if len(parts[5]) else 0
        return t

    # the lists of a tree from bytes are cut when they are first looked at, which many pairs of blocks never do
    @cached_property
    def kids(self) -> list[np.ndarray]:
        return self._cut(*self._lists[0])

    @cached_property
    def members(self) -> list[np.ndarray]:
        return self._cut(*self._lists[1])

    @staticmethod
    def _cut(many: bytes, flat: bytes) -> list[np.ndarray]:
        return np.split(np.frombuffer(flat, np.int32), np.cumsum(np.frombuffer(many, np.int32))[:-1])


def _below(t: CoverTree) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each node: where its children start in the list of all, how many, that list (a node without children is its own), and whether it has none, or none and one member."""
    leaf = np.array([not len(k) for k in t.kids])
    flat = [k if len(k) else np.array([n], np.int32) for n, k in enumerate(t.kids)]
    many = np.array([len(k) for k in flat], np.int64)
    return np.cumsum(many) - many, many, np.concatenate(flat), leaf, leaf & np.array([len(m) == 1 for m in t.members])


def close_pairs(a: CoverTree, b: CoverTree, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index arrays (i in a, j in b) of pairs with at least that cosine; within one tree (a is b) each pair once.

    Node pairs are expanded many at a time: wide ones by a product of matrices, the others together, row by row.
    """
    eps, same = math.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK, a is b
    if not len(a.center) or not len(b.center):
        return

    def exact(i: np.ndarray, j: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        edge = np.flatnonzero(np.abs(c - cosine) < 1e-9)
        for k in edge:
            c[k] = math.fsum((a.x[i[k]] * b.x[j[k]]).tolist())
        ok = c >= cosine
        return i[ok], j[ok]

    dim = a.x.shape[1]
    some = min(dim, next(k for k in range(8, 8 * dim + 65, 8) if k - 5 * math.sqrt(k) >= (1 - cosine) * dim))  # so many that vectors at random have a bound under the threshold
    least = cosine - max(SINGLE, 1.2e-7 * (some + 1))

    def flat(i: np.ndarray, j: np.ndarray, once: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs of some vectors; each pair once if both sides are the same."""
        right = np.ascontiguousarray(b.low(some)[j].T)
        for s in range(0, len(i), 512):
            from_ = s if once else 0
            c = a.low(some)[i[s : s + 512]] @ right[:, from_:]
            if not c.size or c.max() < least:
                continue
            m, n = np.divmod(np.flatnonzero(c.ravel() >= least), c.shape[1])
            if len(m) > c.size // 32:
                whole = a.x[i[s : s + 512]] @ b.x[j[from_:]].T
                m, n = np.nonzero(whole >= cosine - 1e-9)
            if once:
                m, n = m[m < n], n[m < n]
            for t in range(0, len(m), most):
                u, v = i[s + m[t : t + most]], j[from_ + n[t : t + most]]
                found = exact(u, v, np.einsum("ij,ij->i", a.x[u], b.x[v]))
                if len(found[0]):
                    yield found

    most = max(1, EXPAND // dim)
    if a.size[0] * b.size[0] <= FLAT * max(1, int(a.fan)) * max(1, int(b.fan)):
        yield from flat(a.under(0), b.under(0), same)
        return
    at_a, n_a, kids_a, leaf_a, one_a = _below(a)
    at_b, n_b, kids_b, leaf_b, one_b = _below(b)
    todo = [(np.zeros(1, np.int64), np.zeros(1, np.int64))]

    def sift(i: np.ndarray, j: np.ndarray, c: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of single vectors are compared, the other node pairs within reach go on."""
        both = one_a[i] & one_b[j]
        x, y, v = a.center[i[both]], b.center[j[both]], c[both]
        if same:
            x, y, v = x[x != y], y[x != y], v[x != y]
        if len(x):
            yield exact(x, y, v)
        if not both.all():
            todo.append((i[~both], j[~both]))

    while todo:
        ps, qs = todo.pop()
        ends = leaf_a[ps] & leaf_b[qs]
        for p, q in zip(ps[ends].tolist(), qs[ends].tolist(), strict=True):
            i, j = a.members[p], b.members[q]
            c = a.x[i] @ b.x[j].T
            m, n = np.nonzero(c >= cosine - 1e-9)
            if same and p == q:
                m, n = m[m < n], n[m < n]
            if len(m):
                yield exact(i[m], j[n], c[m, n])
        ps, qs = ps[~ends], qs[~ends]
        wide = n_a[ps] * n_b[qs] > WIDE
        for p, q in zip(ps[wide].tolist(), qs[wide].tolist(), strict=True):
            if a.size[p] * b.size[q] <= FLAT * n_a[p] * n_b[q]:
                yield from flat(a.under(p), b.under(q), same and p == q)
                continue
            rows_all, cols = kids_a[at_a[p] : at_a[p] + n_a[p]], kids_b[at_b[q] : at_b[q] + n_b[q]]
            xq, rq = b.x[b.center[cols]].T, b.rho[cols]
            for s in range(0, len(rows_all), 512):
                rows = rows_all[s : s + 512]
                c = a.x[a.center[rows]] @ xq
                reach = np.minimum(eps + a.rho[rows][:, None] + rq[None, :], 2)
                m, n = np.nonzero(c >= 1 - reach**2 / 2 - 1e-12)
                if same and p == q:
                    m, n = m[m + s <= n], n[m + s <= n]
                yield from sift(rows[m], cols[n], c[m, n])
        ps, qs = ps[~wide], qs[~wide]
        if not len(ps):
            continue
        pairs = n_a[ps] * n_b[qs]
        cut = max(1, int(np.searchsorted(np.cumsum(pairs), most, "right")))
        if cut < len(ps):
            todo.append((ps[cut:], qs[cut:]))
            ps, qs, pairs = ps[:cut], qs[:cut], pairs[:cut]
        of = np.repeat(np.arange(len(ps)), pairs)
        m, n = np.divmod(np.arange(len(of)) - np.repeat(np.cumsum(pairs) - pairs, pairs), n_b[qs][of])
        if same:
            once = (ps[of] != qs[of]) | (m <= n)
            of, m, n = of[once], m[once], n[once]
        i, j = kids_a[at_a[ps][of] + m], kids_b[at_b[qs][of] + n]
        c = np.einsum("ij,ij->i", a.x[a.center[i]], b.x[b.center[j]])
        near = c >= 1 - np.minimum(eps + a.rho[i] + b.rho[j], 2) ** 2 / 2 - 1e-12
        yield from sift(i[near], j[near], c[near])


class _Forest:
    """Degrees and a spanning forest over the vectors of one or two blocks."""

    def __init__(self, keys: np.ndarray, many: np.ndarray):
        self.keys, self.many = keys, many
        self.degree, self.label, self.edges = np.zeros(len(keys), np.int64), np.arange(len(keys)), []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        np.add.at(self.degree, i, self.many[j])
        np.add.at(self.degree, j, self.many[i])
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        for at, js in zip(i[np.flatnonzero(np.diff(i, prepend=-1))].tolist(), np.split(j, np.flatnonzero(np.diff(i)) + 1), strict=True) if len(i) else ():
            labels, k = np.unique(self.label[js], return_index=True)
            for lab, n in zip(labels.tolist(), k.tolist(), strict=True):
                if lab != (own := self.label[at]):
                    self.label[self.label == lab] = own
                    self.edges.append((int(self.keys[at]), int(self.keys[js[n]])))


def link_vectors(df: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", cosine: float = 0.95, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row per row of ``df``.

    Vectors that are null, empty, all zeros or have null or non-finite components link with nothing; vectors of
    different lengths never link; equal vectors always do.  component_id is the least id reachable (null ids name
    none, and such rows aren't kept); repeated rows count each; an empty table gives an empty table; other
    columns aren't read.
    """
    v = F.col(vector).cast("array<double>")
    fine = F.coalesce(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = df.select(F.col(vec_id).alias("id"), F.when(fine, v).alias("v")).withColumn("k", F.when(F.col("v").isNotNull(), F.xxhash64("v")))
    nodes, _ = written(rows.where(F.col("v").isNotNull()).groupBy("k").agg(F.first("v").alias("v"), F.min("id").alias("least"), F.count(F.lit(1)).alias("many")), "vectors")
    n, widest = nodes.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    pivots = nodes.orderBy(F.xxhash64("k", F.lit(1)), "k").limit(min(PIVOTS, math.ceil(n / block), max(1, PIVOT_BYTES // (8 * (widest or 1))))).select("v").collect()
    by_size: dict[int, list] = {}
    for r in pivots:
        by_size.setdefault(len(r["v"]), []).append(np.array(r["v"]) / np.linalg.norm(r["v"]))
    by_size = {k: np.array(x) for k, x in by_size.items()}

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for big in batches:
            for at in range(0, len(big), 512):
                batch = big.slice(at, 512)
                v = batch.column("v")
                size = np.diff(v.offsets.to_numpy())
                cell = np.full(len(batch), -1, np.int32)
                for k in np.unique(size).tolist():
                    if k in by_size:
                        on = np.flatnonzero(size == k)
                        x = v.take(pa.array(on)).flatten().to_numpy().reshape(len(on), k)
                        cell[on] = np.argmax((x / np.abs(x).max(1, keepdims=True)) @ by_size[k].T, axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("k"), v, batch.column("many"), pa.array(size.astype(np.int32)), pa.array(cell)], names=["k", "v", "many", "size", "cell"])

    placed = nodes.select("k", "v", "many").mapInArrow(place, "k long, v array<double>, many long, size int, cell int")
    parts = placed.groupBy("size", "cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    dealt = placed.join(parts, ["size", "cell"]).withColumn("part", F.pmod(F.xxhash64("k", F.lit(2)), F.col("parts")).cast("int"))

    folder = fresh_path(df.sparkSession, "cover-trees")

    def build(table):
        import pyarrow as pa
        from pyarrow import fs

        x = table.column("v").combine_chunks().flatten().to_numpy().reshape(len(table), -1)
        x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        name = ":".join(str(table.column(c)[0].as_py()) for c in ("size", "cell", "part"))
        tree = CoverTree(x)
        keys, many = (table.column(c).to_numpy().astype(np.int64).tobytes() for c in ("k", "many"))
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        path = f"{root}/{uuid.uuid4().hex}"  # a task that runs again writes another file
        with system.open_output_stream(path) as out:
            out.write(struct.pack("<q", len(table)) + keys + many + tree.dump())
        row = {"block": name, "size": x.shape[1], "center": x[0].tolist(), "rho": float(tree.rho[0]), "path": path}
        return pa.Table.from_pylist([row], schema=pa.schema([("block", pa.string()), ("size", pa.int32()), ("center", pa.list_(pa.float64())), ("rho", pa.float64()), ("path", pa.string())]))

    blocks, _ = written(dealt.groupBy("size", "cell", "part").applyInArrow(build, "block string, size int, center array<double>, rho double, path string"), "blocks")
    side = lambda s: blocks.select("size", *[F.col(c).alias(f"{c}_{s}") for c in ("block", "center", "rho", "path")])
    apart = F.sqrt(F.aggregate(F.zip_with("center_a", "center_b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    near = apart <= F.col("rho_a") + F.col("rho_b") + math.sqrt(max(0.0, 2 - 2 * cosine)) + 2 * SLACK
    pairs, _ = written(side("a").join(side("b"), "size").where((F.col("block_a") <= F.col("block_b")) & near).select("path_a", "path_b"), "blockpairs")
    # a task reads a block once and some others: about eight pairs of blocks, or fewer
    many = blocks.count()
    group = F.pmod(F.xxhash64("path_b"), F.lit(max(1, math.ceil(many / 8))))
    tasks = pairs.repartition(max(1, min(20_000, pairs.count(), 2 * many * math.ceil(many / 8))), "path_a", group).sortWithinPartitions("path_a", "path_b")

    def load(path: str) -> tuple[np.ndarray, np.ndarray, CoverTree]:
        from pyarrow import fs

        with fs.FileSystem.from_uri(folder)[0].open_input_file(path) as f:
            raw = f.read()
        (n,) = struct.unpack_from("<q", raw)
        return np.frombuffer(raw, np.int64, n, 8), np.frombuffer(raw, np.int64, n, 8 + 8 * n), CoverTree.load(raw[8 + 16 * n :])

    def meet(batches: Iterator) -> Iterator:
        import pyarrow as pa

        at = None
        for batch in batches:
            for path, other in zip(batch.column("path_a").to_pylist(), batch.column("path_b").to_pylist(), strict=True):
                if path != at:
                    at, (ka, ma, ta) = path, load(path)
                if other == path:
                    forest, shift, tb = _Forest(ka, ma), 0, ta
                else:
                    kb, mb, tb = load(other)
                    forest, shift = _Forest(np.append(ka, kb), np.append(ma, mb)), len(ka)
                for i, j in close_pairs(ta, tb, cosine):
                    forest.add(i.astype(np.int64), j.astype(np.int64) + shift)
                on = np.flatnonzero(forest.degree)
                k = forest.keys[on].tolist() + [x for x, _ in forest.edges]
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(forest.degree[on].tolist() + [0] * len(forest.edges), pa.int64()), pa.array([None] * len(on) + [y for _, y in forest.edges], pa.int64())], names=["k", "n", "to"])

    met, _ = written(tasks.mapInArrow(meet, "k long, n long, to long"), "links")
    degree = met.groupBy("k").agg(F.sum("n").alias("n"))
    roots = components(met.where(F.col("to").isNotNull()), "k", "to").withColumnRenamed("node", "k")
    named = nodes.select("k", "least", "many").join(roots, "k", "left").withColumn("root", F.coalesce("root", "k"))
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    named = named.join(least, "root").join(degree, "k", "left").select("k", "component", (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n"))
    got = rows.select("id", "k").join(named, "k", "left")
    component = F.when(F.col("k").isNull(), F.col("id")).otherwise(F.col("component"))
    return got.select(F.col("id").alias(vec_id), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


#: DuckDB for link_vectors() of ``embeddings`` (ids without nulls or repeats) with the default cosine: all pairs, and labels that go along the links.
SQL = """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
u AS MATERIALIZED (SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS len FROM v WHERE len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
e AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_dot_product(a.x, b.x) >= 0.95 * a.len * b.len),
reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b),
comp AS (SELECT a, min(b) AS least FROM reach GROUP BY a), many AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT v.vec_id, coalesce(many.n, 0) AS n_links, least(v.vec_id, coalesce(comp.least, v.vec_id)) AS component_id, v.vec_id <= coalesce(comp.least, v.vec_id) AS kept
FROM v LEFT JOIN comp ON comp.a = v.vec_id LEFT JOIN many ON many.a = v.vec_id
"""
