"""Near-duplicates by SimHash, each link checked on the shingles themselves.

The generalised pigeonhole of ``simhash`` connects shingle sets whose fingerprints differ in few bits, in each of two
words of 64 bits by itself, to clusters.  Within a cluster every pair of sets is compared, and a pair is a link only if its exact
Jaccard similarity is 0.8 or more.  A set travels once to its cluster's task; a cluster that is too large for one is
cut into blocks, and every two blocks meet.  Bits connect nearly all such pairs, not all: at a similarity of exactly 0.8 a
bit differs with a chance of 0.151, so that a word is within MAX_BITS for 84 of 100 pairs and one of two words for 97; at 0.9
for 99.9, and others of a cluster connect a pair too.  Shingles stand for their 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import written
from . import simhash
from .common import out_schema, put, release
from .components import components

#: The least similarity, as a fraction of whole numbers.
TIMES, OF = 4, 5
#: Words of 64 bits, the most bits that differ in one of them, and in both: for pairs of similarity 0.8 the mean of 128 bits is 19.3, the standard deviation 4.1.
WORDS, MAX_BITS, ALL_BITS = 2, 12, 36
#: Sets and their shingles that a block holds, about; any numbers find the same links.
BLOCK, BLOCK_SHINGLES = 512, 1 << 21
#: Shingles that are looked at together where sets are compared; only memory depends on it.
COLUMNS = 4096


def shingles(text: str | None, shingle: int = 5) -> np.ndarray:
    """Ascending distinct hashes of the shingles: A-Z lower-cased, words at ASCII white space; a text of fewer words is one shingle."""
    return np.unique(simhash.hashes(text, shingle))


def sets_of(df: DataFrame, text: str = "text", shingle: int = 5, *, members: bool = True, bits: bool = True) -> DataFrame:
    """``df`` without its text, with members (binary, the shingles), node (long, a hash of them: equal sets are one node), n (their number) and w0, w1 and so on (their fingerprints); columns of these names are replaced.

    Without ``members`` or ``bits``: without the shingles, which take more room than the text, or the fingerprints.
    """
    new = {"members": "binary", "node": "long", "n": "long"} | {f"w{i}": "long" for i in range(WORDS)}
    new = {k: v for k, v in new.items() if (members or k != "members") and (bits or k[0] != "w")}

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        for batch in batches:
            got = [shingles(v.as_py(), shingle) for v in batch.column(text)]
            words = np.array([simhash.bits_of(h, WORDS) for h in got if bits], np.uint64).reshape(-1, WORDS).view(np.int64)
            raw = [h.tobytes() for h in got]
            node = np.array([xxhash.xxh64_intdigest(b, 7) for b in raw], np.uint64).view(np.int64)
            cols = {"members": pa.array(raw if members else [], pa.binary()), "node": pa.array(node, pa.int64()), "n": pa.array([len(h) for h in got], pa.int64())} | {f"w{i}": pa.array(words[:, i], pa.int64()) for i in range(WORDS)}
            yield put(batch.select([c for c in batch.schema.names if c != text]), {k: cols[k] for k in new})
        release()

    return df.mapInArrow(run, out_schema(df.drop(text), new))


def similar(members: list[np.ndarray]) -> np.ndarray:
    """Which pairs of the sets are similar, as a symmetric matrix; a set is similar to itself."""
    m = len(members)
    n = np.array([len(x) for x in members])
    both = np.zeros((m, m), np.float32)
    if m == 2:
        both[0, 1] = both[1, 0] = len(np.intersect1d(*members, assume_unique=True))
    else:
        owner = np.repeat(np.arange(m), n)
        _, which, count = np.unique(np.concatenate(members), return_inverse=True, return_counts=True)
        on = count[which] > 1
        rank = np.cumsum(count > 1) - 1
        which, owner = rank[which[on]], owner[on]
        order = np.argsort(which, kind="stable")
        which, owner = which[order], owner[order]
        for at in range(0, int(which[-1]) + 1 if len(which) else 0, COLUMNS):
            s, e = np.searchsorted(which, [at, at + COLUMNS])
            part = np.zeros((m, COLUMNS), np.float32)
            part[owner[s:e], which[s:e] - at] = 1
            both += part @ part.T
    np.fill_diagonal(both, n)
    return (TIMES + OF) * both >= TIMES * (n[:, None] + n[None, :])


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """(member, first member) of the connected parts of a matrix of links."""
    left, out = np.ones(len(near), bool), []
    for i in range(len(near)):
        if left[i]:
            part, new = near[i] & left, near[i] & left
            while new.any():
                left &= ~new
                new = near[new].any(0) & left
                part = part | new
            out += [(j, i) for j in np.flatnonzero(part).tolist() if j != i]
    return out


def links(sets: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(a, b): similar pairs of nodes that connect whatever the similar pairs connect within the clusters that bits make. members: (node, members) where ``sets`` hasn't them."""
    words = [f"w{i}" for i in range(WORDS)]
    nodes, _ = written(sets.drop("members").groupBy("node").agg(*(F.first(c).alias(c) for c in ("n", *words))), "nodes")
    clusters = components(simhash.links(nodes, MAX_BITS, tuple(words), ALL_BITS))
    clusters, _ = written(clusters.join(nodes.select("node", "n"), "node"), "clusters")
    cut = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    cuts, _ = written(clusters.groupBy("root").agg(cut.alias("k")), "cuts")
    own = clusters.join(cuts, "root").withColumn("x", F.pmod(F.xxhash64("node"), "k").cast("int"))
    # a block meets every other one, and with that itself
    other = F.explode(F.when(F.col("k") == 1, F.array("x")).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("k") - 1), F.col("x"))))
    dealt = own.withColumn("y", other).select("root", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "node")
    met, _ = written((sets if members is None else members).select("node", "members").join(clusters.select("node"), "node", "left_semi").drop_duplicates(["node"]), "met")
    rows = dealt.join(met, "node").select("root", "i", "j", "node", "members").repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        at, ids, members = None, [], []

        def close() -> Iterator:
            if len(ids) > 1:
                pairs = _forest(similar(members))
                if pairs:
                    a, b = zip(*pairs, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in a], pa.int64()), pa.array([ids[k] for k in b], pa.int64())], names=["a", "b"])

        for batch in batches:
            for root, i, j, node, v in zip(*(batch.column(c).to_pylist() for c in range(4)), batch.column(4), strict=True):
                if (root, i, j) != at:
                    yield from close()
                    at, ids, members = (root, i, j), [], []
                ids.append(node)
                members.append(np.frombuffer(v.as_py(), np.uint64))
        yield from close()
        members.clear()
        release()

    return written(rows.mapInArrow(run, "a long, b long"), "similar")[0]


def group(sets: DataFrame, own: str = "doc_id", members: DataFrame | None = None) -> DataFrame:
    """``sets`` (with members, or these by node beside them) without members, with component_id: the least ``own`` that is reachable by links, the row's own included.

    Equal sets are linked, the empty ones too. Rows with a null ``own`` take part but name no component (null where
    a component has no other); repeated rows come out each; an empty table gives an empty table.
    """
    roots = components(links(sets, members))
    rest = ["members", "component_id", "n", *(f"w{i}" for i in range(WORDS))]
    named = sets.drop(*rest).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named, _ = written(named, "roots")
    least, _ = written(named.groupBy("root").agg(F.min(own).alias("component_id")), "least")  # a table, so that the join can split a large group
    return named.join(least, "root").drop("root", "node")
