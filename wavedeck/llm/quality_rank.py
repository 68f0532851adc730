"""Document quality by Bradley-Terry pairwise ranking.

Learning: documents with label 1 are preferred to documents with label 0. Pairs of the two give
P(i before j) = 1 / (1 + exp(-w (x_i - x_j))), fitted by Newton steps on the logistic loss of the feature
differences. The threshold is a quantile of the learned scores: the share of label 0 among the labelled rows.
Scores are mapped to 0..1 by a slope fitted to the labels so that the threshold comes to lie at `cut`.

Features are measures of the whole text alone (kinds of bytes, repetition, word and line shapes). Null texts
are empty ones. Rows may repeat, ids may be null; rows with a null label or id teach nothing. Without both
labels nothing speaks against a document: every score is `cut`.

Learning takes at most about MAX_LABELLED labelled rows, chosen by a hash of their id: this is the only bound.
Scoring is a map over all documents without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import release

#: Expected number of labelled rows that the weights are learned from, at most.
MAX_LABELLED = 20_000
#: Pairs that each labelled row of the rarer label takes part in, at most.
PAIRS_EACH = 16

_MARKS = b"#$%&*@^~=+_"
_KINDS = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "other": range(128, 256), "line": (10,), "stop": (46,),
    "comma": (44, 59, 58), "shout": (33, 63), "pipe": (124,), "mark": _MARKS, "bracket": b"<>{}[]()/\\", "control": [*range(9), *range(11, 32), 127],
}
_KIND = np.zeros((256, len(_KINDS)), dtype=np.float64)
for _k, _bytes in enumerate(_KINDS.values()):
    _KIND[list(_bytes), _k] = 1


def features(text: str) -> list[float]:
    """Measures of the whole text, each between 0 and about 10."""
    data = text.encode()
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    n = max(len(data), 1)
    kinds = (counts @ _KIND / n).tolist()
    words = data.split()
    m = max(len(words), 1)
    lines = [x for x in data.split(b"\n") if x.strip()]
    k = max(len(lines), 1)
    distinct = len(set(words))
    again = sum(map(bytes.__eq__, words[1:], words)) / m
    share = counts[counts > 0] / n
    entropy = float(-(share * np.log2(share)).sum()) if len(data) else 0.0
    ends = sum(not (c in b".,;:" or c >= 128 or 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122) for c in [w[-1] for w in words]) / m
    sentences = text.count(". ") + text.count(".\n") + 1
    return [
        *(x**0.5 for x in kinds),
        *kinds,
        float(np.log1p(len(words))) / 3, (len(data) - len(words)) / m / 5, distinct / m, distinct / m**0.5 / 10, again**0.5, again, entropy,
        ends, ends**0.5, len(set(lines)) / k, float(np.log1p(len(data) / k)) / 3, float(np.log1p(m / sentences)), float(max(map(len, words), default=0) ** 0.5) / 10,
        kinds[0] / (kinds[0] + kinds[1] + 1e-3), float(not words),
    ]


@dataclass
class Ranking:
    """Learned weights; scores(x): 0 to 1, `cut` at the threshold."""

    cut: float
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    threshold: float = 0.0
    slope: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(x), self.cut)
        z = self.slope * (self.raw(x) - self.threshold) + np.log(self.cut / (1 - self.cut))
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit(x: np.ndarray, y: np.ndarray, cut: float = 0.7, penalty: float = 1.0, seed: int = 7) -> Ranking:
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Ranking(cut)
    model = Ranking(cut, x.mean(axis=0), np.maximum(x.std(axis=0), 1e-4))
    z = np.clip((x - model.mean) / model.scale, -6, 6)
    rng = np.random.default_rng(seed)
    few, many = sorted((good, bad), key=len)
    each = max(PAIRS_EACH, -(-len(many) // len(few)))
    rows, others = np.repeat(few, each), rng.permutation(np.resize(many, len(few) * each))
    d = z[rows] - z[others] if few is good else z[others] - z[rows]
    w = np.zeros(z.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(d @ w, -60, 60)))  # of the wrong order
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + penalty * np.eye(len(w)), d.T @ p - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    model.weights = w
    s = z @ w
    model.threshold = float(np.quantile(s, len(bad) / (len(good) + len(bad))))
    a = b = 0.0
    for _ in range(25):  # slope of the label by score
        p = 1 / (1 + np.exp(-np.clip(a * s + b, -60, 60)))
        q = np.stack([s, np.ones_like(s)])
        step = np.linalg.solve((q * (p * (1 - p))) @ q.T + 1e-3 * np.eye(2), q @ (y - p) - 1e-3 * np.array([a, b]))
        a, b = a + step[0], b + step[1]
    model.slope = max(float(a), 1e-3)
    return model


def learn(docs: DataFrame, labels: DataFrame, teaches: Column, cut: float = 0.7, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MAX_LABELLED) -> Ranking:
    """Weights from the labelled rows for which `teaches`, a condition on the id, holds."""
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & teaches).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    n = rows.count()
    if n > most:
        rows = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.lit((1 << 20) * most // n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["y", "x"])
        release()

    # at most about `most` small rows: bounded at every input size, also where ids repeat
    rows = rows.groupBy("id", "y").agg(F.count("*").alias("times")).select("id", "y")
    taught = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(rows), "id").select("id", "y", "text")
    met = taught.count()
    if met > 2 * most:
        taught = taught.where(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 20)) < F.lit((1 << 20) * most // met))
    got = taught.select("y", "text").mapInArrow(run, "y int, x array<double>").toPandas().sort_values(["y", "x"], key=lambda c: c.map(str), kind="stable")
    if not len(got):
        return Ranking(cut)
    return fit(np.array(got["x"].tolist()), got["y"].to_numpy(), cut)


def score(docs: DataFrame, model: Ranking, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, the columns in keep, score: one row per row of docs."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    names = [id_col, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py() or "") for t in batch.column(0)]).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(model.scores(x) if len(x) else np.zeros(0))], [*names, "score"])
        release()

    return docs.select(F.col(text_col).alias("_text"), *names).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "score double"]))
