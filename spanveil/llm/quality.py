"""Quality classifier: Bradley-Terry pairwise ranking.

Documents get scores whose differences explain preferences: for a preferred and a rejected labelled document
the logistic loss of w . (features(preferred) - features(rejected)) is minimised by Newton's method.  The cut
is the quantile of the labelled scores that leaves the labels' share of rejected documents below it, and maps
to the score ``CUT``; the steepness of the map is fitted to the labels.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import out_schema, put, release

#: Labelled rows that training uses at most (chosen by hash of the id), and preference pairs drawn from them.
TRAIN_ROWS = 6000
PAIRS = 60_000
CUT = 0.3

_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Classes of bytes whose pairs are counted: controls, line ends, blanks, digits, capitals, small letters, each mark, and bytes of other characters by their two highest bits.
_CLASS = np.zeros(256, np.uint8)
for _b in range(256):
    _c = bytes([_b])
    _CLASS[_b] = 1 if _c in b"\n\r" else 2 if _c in b" \t" else 3 if _c.isdigit() else 4 if _c.isupper() else 5 if _c.islower() else 8 + _MARKS.index(_c) if _c in _MARKS else 6 if _b >= 0xC0 else 7 if _b >= 0x80 else 0
_CLASSES = 8 + len(_MARKS)
N_PLAIN = 12 + len(_MARKS)
N_FEATURES = N_PLAIN + 64 + 2 * len(_MARKS)


def features(text: str | None) -> list[float]:
    """Language-neutral numbers of the whole text: sizes, shares, repeats, marks and pairs of neighbouring bytes; null counts as empty."""
    text = text or ""
    raw = text.encode()
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    n, b = max(1, len(words)), max(1, len(raw))
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    top = Counter(words)
    line_top = Counter(lines)
    upper, lower = int(count[65:91].sum()), int(count[97:123].sum())
    most = max(top.values(), default=0)
    repeats = sum(map(str.__eq__, words, words[1:]))
    out = [
        np.log1p(len(words)), np.log1p(len(raw)), np.log1p(len(words)) ** 2 / 10, np.log1p(b / n), upper / max(1, upper + lower), int(count[48:58].sum()) / b, int(count[128:].sum()) / b,
        len(top) / n, most / n, np.sqrt(repeats / n), len(line_top) / max(1, len(lines)), np.log1p(n / max(1, len(lines))),
    ]
    # pairs of neighbouring bytes by class: between the general classes, of a mark with itself, and of a mark with anything
    kinds = _CLASS[np.frombuffer(raw, np.uint8)].astype(np.int32)
    pairs = np.bincount(kinds[:-1] * _CLASSES + kinds[1:], minlength=_CLASSES * _CLASSES).reshape(_CLASSES, _CLASSES) if len(raw) > 1 else np.zeros((_CLASSES, _CLASSES))
    pairs = np.sqrt(np.concatenate([pairs[:8, :8].ravel(), np.diag(pairs)[8:], pairs[8:].sum(1)]) / n)
    return [float(x) for x in out] + [float(np.sqrt(count[c] / n)) for c in _MARKS] + pairs.tolist()


@dataclass(frozen=True)
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    steep: float

    def score(self, x: np.ndarray) -> np.ndarray:
        s = np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights
        return 1 / (1 + np.exp(-np.clip(self.steep * (s - self.cut) + np.log(CUT / (1 - CUT)), -500, 500)))


def fit(x: np.ndarray, good: np.ndarray, seed: int = 7, ridge: float = 1e-3) -> Ranker:
    """A ranker from feature rows and labels (1 preferred, 0 rejected). Without both labels every score is the same."""
    x = np.asarray(x, float).reshape(-1, N_FEATURES)
    mean, scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
    z = np.clip((x - mean) / scale, -6, 6)
    w = np.zeros(N_FEATURES)
    up, down = np.flatnonzero(good == 1), np.flatnonzero(good == 0)
    if not len(up) or not len(down):
        return Ranker(mean, scale, w, 0.0 if len(down) == 0 else 1.0, 1.0 if len(x) else 0.0)
    rng = np.random.default_rng(seed)
    d = z[rng.choice(up, PAIRS)] - z[rng.choice(down, PAIRS)]
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))  # what is left of each preference to explain
        grad = d.T @ p / len(d) - ridge * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(N_FEATURES)
        move = np.linalg.solve(hess, grad)
        w += move
        if np.abs(move).max() < 1e-6:
            break
    s = z @ w
    cut = float(np.quantile(s, len(down) / len(x)))
    steep = 1.0
    for a in np.geomspace(0.05, 20, 60):  # by the likelihood of the labels
        like = lambda k: -np.logaddexp(0, np.where(good == 1, -1, 1) * (k * (s - cut) + np.log(CUT / (1 - CUT)))).sum()
        steep = a if like(a) > like(steep) else steep
    return Ranker(mean, scale, w, cut, float(steep))


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = TRAIN_ROWS) -> Ranker:
    """Fits on at most ``rows`` labelled rows whose crc32(id as text) mod 5 isn't 0, chosen by hash of the id.

    Labels other than 0 and 1 and null ids are left out; an id with several labels counts with the smallest,
    one with several texts with the one of the least hash.  Without labels of both kinds every score is the same.
    """
    marked = labels.select(F.col(doc_id).alias("i"), F.col(label).alias("y")).where(F.col("i").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("i")))
    marked = marked.groupBy("i").agg(F.min("y").cast("int").alias("y")).orderBy(F.xxhash64("i"), "i").limit(rows)
    texts = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).join(F.broadcast(marked), "i")  # ``rows`` rows at most

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            got = [features(v.as_py()) for v in batch.column("t")]
            yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("y"), pa.array(got, pa.list_(pa.float64())), batch.column("h")], names=["i", "y", "x", "h"])

    kind = marked.schema["i"].dataType.simpleString()
    got = texts.select("i", "y", "t", F.xxhash64("i", "t").alias("h")).mapInArrow(run, f"i {kind}, y int, x array<double>, h long")
    got = [r["r"] for r in got.groupBy("i").agg(F.min(F.struct("h", "y", "x")).alias("r")).collect()]  # ``rows`` at most
    got.sort(key=lambda r: (r["h"], r["y"]))
    return fit(np.array([r["x"] for r in got], float), np.array([r["y"] for r in got], int))


def held_out(doc_id) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def score(df: DataFrame, ranker: Ranker, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``df`` with score (double, 0 to 1); an equal column name is replaced, nulls count as empty texts, repeats score alike."""
    new = {"score": "double"}

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x = np.array([features(v.as_py()) for v in batch.column(text)]).reshape(-1, N_FEATURES)
            rest = batch if keep_text else batch.select([n for n in batch.schema.names if n != text])
            yield put(rest, {"score": pa.array(ranker.score(x), pa.float64())})
        release()

    return df.mapInArrow(run, out_schema(df if keep_text else df.drop(text), new))
