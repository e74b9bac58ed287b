"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad. Its features (length, letter case, marks, repeated words) and those of the lines before
and after it feed the field; forward-backward marginals, weighted by line length, average into one value of the
document, which a two-parameter scaling turns into a probability. Labels are of documents, so the field is fitted
twice: first every line takes its document's label, then lines of bad documents that look good become good.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out_fold, whole_row, with_own

#: Labelled documents that the field is fitted on at most, chosen by a hash of their ids.
SAMPLE_DOCUMENTS = 4000
#: A score from here on counts as good.
THRESHOLD = 0.3
FEATURES = 10
_CLASS = np.zeros(128, np.uint8)  # 1 upper case, 2 lower case, 3 digit, 4 space, 5 pipe, 6 quiet mark, 7 other mark
for _c in range(128):
    _s = chr(_c)
    _CLASS[_c] = 1 if _s.isupper() else 2 if _s.islower() else 3 if _s.isdigit() else 4 if _s.isspace() else 5 if _s == "|" else 6 if _s in ".,;:'\"()-?" else 7


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of every line of a text, and the lengths of its lines. An empty text is one empty line."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kind = np.where(code < 128, _CLASS[np.minimum(code, 127)], 2)
    ends = np.append(np.flatnonzero(code == 10), len(code))
    starts = np.append(0, ends[:-1] + 1)
    lengths = ends - starts
    shares = []
    for k in (1, 3, 5, 7):
        total = np.append(0, np.cumsum(kind == k))
        shares.append((total[ends] - total[starts]) / np.maximum(1, lengths))
    lines = text.split("\n")
    repeated, distinct, n_words = np.zeros(len(lines)), np.ones(len(lines)), np.zeros(len(lines))
    for i, line in enumerate(lines):
        words = line.split()
        n = len(words)
        n_words[i] = n
        if n > 1:
            repeated[i] = sum(map(operator.eq, words, words[1:])) / (n - 1)
            distinct[i] = len(set(words)) / n
    upper, digit, pipe, mark = shares
    spread = np.minimum(1, n_words / 20)
    return np.stack([np.ones(len(lines)), np.log1p(lengths) / 8, upper, np.minimum(1, 4 * digit), np.minimum(1, 8 * pipe), np.minimum(1, 6 * mark), repeated, (1 - distinct) * spread, np.minimum(1, np.maximum(0, upper - 0.4) * 4), (lengths == 0) * 1.0], axis=1), np.maximum(1, lengths)


def with_neighbours(x: np.ndarray) -> np.ndarray:
    """Each line's features with those of the lines before and after it; there are none beyond the ends."""
    none = np.zeros((1, x.shape[1]))
    return np.hstack([x, np.vstack([none, x[:-1]]), np.vstack([x[1:], none])])


def forward_backward(emission: np.ndarray, lengths: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of state 1, expected transition counts and the log partition of sequences side by side.

    `emission` holds, line after line, the score of state 1 against state 0; sequences take `lengths` lines each.
    All sequences advance together, the longest first, so a step handles a prefix of them.
    """
    order = np.argsort(-lengths, kind="stable")
    start = (np.cumsum(lengths) - lengths)[order]
    size = lengths[order]
    steps = int(size[0]) if len(size) else 0
    active = [int(np.searchsorted(-size, -t, "left")) for t in range(steps)]  # sequences longer than t
    weight = np.exp(transition)
    alpha, scale = np.zeros((len(emission), 2)), np.zeros(len(emission))
    for t in range(steps):
        at = start[: active[t]] + t
        now = np.ones((active[t], 2)) if t == 0 else alpha[at - 1] @ weight
        e = emission[at]
        top = np.maximum(e, 0)
        now = now * np.stack([np.exp(-top), np.exp(e - top)], 1)
        total = now.sum(1)
        alpha[at], scale[at] = now / total[:, None], np.log(total) + top
    beta, counts = np.ones((len(emission), 2)), np.zeros((2, 2))
    for t in range(steps - 2, -1, -1):
        n = active[t + 1]
        at = start[:n] + t
        e = emission[at + 1]
        top = np.maximum(e, 0)
        ahead = beta[at + 1] * np.stack([np.exp(-top), np.exp(e - top)], 1)
        pair = alpha[at][:, :, None] * weight[None] * ahead[:, None, :]
        counts += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
        back = ahead @ weight.T
        beta[at] = back / back.sum(1, keepdims=True)
    both = alpha * beta
    return both[:, 1] / both.sum(1), counts, float(scale.sum())


@dataclass
class Field:
    """A fitted field, and the scaling of a document's mean marginal."""

    weights: np.ndarray
    transition: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def means(self, features: list[np.ndarray], sizes: list[np.ndarray]) -> np.ndarray:
        """The length-weighted mean marginal of the good state of each document."""
        lengths = np.array([len(f) for f in features])
        emission = np.vstack([with_neighbours(f) for f in features]) @ self.weights
        good, _, _ = forward_backward(emission, lengths, self.transition)
        weights = np.concatenate(sizes).astype(float)
        at = np.cumsum(lengths) - lengths
        return np.add.reduceat(good * weights, at) / np.add.reduceat(weights, at)

    def scores(self, features: list[np.ndarray], sizes: list[np.ndarray]) -> np.ndarray:
        mean = np.clip(self.means(features, sizes), 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-(self.slope * np.log(mean / (1 - mean)) + self.offset)))


def _ascend(gradient, start: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """Adam on a concave objective."""
    x, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, steps + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return x


def fit(features: list[np.ndarray], sizes: list[np.ndarray], labels: np.ndarray, chunk: int = 64, steps: int = 120) -> Field:
    """Fit the field on documents with labels 0 and 1; long documents are fitted in chunks of lines.

    Without documents of both labels the field is flat and every score is the share of label 1 (a half, if none).
    """
    if len(set(labels.tolist())) < 2:
        share = np.clip(labels.mean() if len(labels) else 0.5, 0.01, 0.99)
        return Field(np.zeros(3 * FEATURES), np.zeros((2, 2)), 0.0, float(np.log(share / (1 - share))))
    x = np.vstack([with_neighbours(f) for f in features])
    lines = np.array([len(f) for f in features])
    lengths = np.concatenate([np.minimum(chunk, n - np.arange(0, n, chunk)) for n in lines])
    weight = np.concatenate([np.minimum(1.0, s / 40.0) for s in sizes])
    y = np.repeat(labels, lines).astype(float)
    inner = np.ones(len(y), bool)
    inner[np.cumsum(lengths) - 1] = False
    pairs = np.flatnonzero(inner)

    def learn(y: np.ndarray, start: np.ndarray) -> np.ndarray:
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[pairs].astype(int), y[pairs + 1].astype(int)), 1)

        def gradient(p: np.ndarray) -> np.ndarray:
            good, counts, _ = forward_backward(x @ p[:-4], lengths, p[-4:].reshape(2, 2))
            return np.append(x.T @ ((y - good) * weight), (seen - counts).ravel()) / len(y) - 1e-4 * p

        return _ascend(gradient, start, steps, 0.15)

    p = learn(y, np.zeros(x.shape[1] + 4))
    lone = 1 / (1 + np.exp(-(x @ p[:-4])))
    second = y.copy()
    at = np.cumsum(lines) - lines
    for a, n, label in zip(at, lines, labels):
        if label == 0:
            own = lone[a : a + n]
            second[a : a + n] = (own > 0.5) & (own > own.min())
    p = learn(second, p)
    field = Field(p[:-4], p[-4:].reshape(2, 2))
    mean = np.clip(field.means(features, sizes), 1e-6, 1 - 1e-6)
    z = np.log(mean / (1 - mean))

    def slope(q: np.ndarray) -> np.ndarray:
        error = labels - 1 / (1 + np.exp(-(q[0] * z + q[1])))
        return np.array([(error * z).mean(), error.mean()]) - 1e-3 * q

    field.slope, field.offset = map(float, _ascend(slope, np.array([1.0, 0.0]), 400, 0.05))
    return field


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, limit: int) -> DataFrame:
    """doc_id, text, label of at most `limit` labelled documents outside the held-out fold, chosen by hashed id."""
    usable = labels.filter(F.col(column).isin(0, 1) & (held_out_fold(F.col("doc_id")) != 0))
    chosen = usable.groupBy("doc_id").agg(F.min(column).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_DOCUMENTS) -> Field:
    """Fit on at most `limit` labelled documents, with all their lines.

    Executors turn texts into line features, of which the driver gets some fifty bytes a line, and fits them.
    """

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [line_features(t.as_py() or "") for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int32()), pa.array([f.astype("<f4").tobytes() for f, _ in made], pa.binary()), pa.array([s.astype("<i4").tobytes() for _, s in made], pa.binary())], ["doc_id", "label", "x", "size"])

    rows = labelled_sample(docs, labels, "quality", limit).select("doc_id", "label", "text").mapInArrow(features, "doc_id long, label int, x binary, size binary").collect()
    rows.sort(key=lambda r: r.doc_id)
    x = [np.frombuffer(r.x, "<f4").reshape(-1, FEATURES).astype(float) for r in rows]
    return fit(x, [np.frombuffer(r["size"], "<i4").astype(float) for r in rows], np.array([r.label for r in rows], float))


def score(docs: DataFrame, field: Field, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, all columns, with _score and _predicted from their whole texts.

    Null text counts as empty and is scored like one empty line. Equal texts have equal scores; repeated rows stay, an
    empty table gives an empty result. Input columns with one of the two names are replaced; others pass through.
    """
    return with_own(scored(docs, field, threshold), docs.columns, ["_score", "_predicted"])


def scored(docs: DataFrame, field: Field, threshold: float = THRESHOLD) -> DataFrame:
    """_all (the row), _score, _predicted of every row of `docs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.zeros(batch.num_rows)
            begin, chars, texts = 0, 0, []
            column = batch.column(0).field("text")
            for i in range(batch.num_rows):
                texts.append(column[i].as_py() or "")
                chars += len(texts[-1])
                if chars > 1 << 22 or i + 1 == batch.num_rows:
                    x, sizes = zip(*map(line_features, texts))
                    values[begin : i + 1] = field.scores(list(x), list(sizes))
                    begin, chars, texts = i + 1, 0, []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values), pa.array((values >= threshold).astype(np.int32))], ["_all", "_score", "_predicted"])

    from pyspark.sql.types import DoubleType, IntegerType, StructType

    packed = docs.select(whole_row(docs))
    return packed.mapInArrow(run, StructType([*packed.schema.fields]).add("_score", DoubleType()).add("_predicted", IntegerType()))
