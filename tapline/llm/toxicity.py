"""Toxicity by a classifier chain.

Terms (whole words and word beginnings) that mark toxic documents are found in a bounded labelled sample. Terms
that occur together fall into families, which are the chain's categories: a labelled document has a category if it
is toxic and holds one of the family's terms. Linear models predict the categories one after another, and last
whether the document is toxic at all; each model also sees the probabilities of the categories before it. Those
that it is trained with are out of fold, so that it learns from them as they will be at prediction.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import labelled_sample

#: Labelled documents, terms and categories at most; folds of the out-of-fold predictions.
SAMPLE_DOCUMENTS, TERMS, FAMILIES, FOLDS = 20_000, 400, 4, 5
#: Terms of toxic documents at most, the most frequent, of which TERMS are chosen.
CANDIDATE_TERMS = 100_000
#: Letters of the word beginnings that count as terms, next to whole words.
PREFIXES = (4, 5, 6, 7)
_WORDS = re.compile(r"[^\W\d_]+")


def terms(text: str) -> set[str]:
    """A text's words in lower case, and their beginnings, which end in '*'."""
    words = set(_WORDS.findall(text.lower()))
    return words | {w[:n] + "*" for w in words for n in PREFIXES if len(w) >= n}


def _count_terms(rows: DataFrame, wanted=None) -> DataFrame:
    """term, n: in how many documents each term (of `wanted`, if given) occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        keep = None if wanted is None else wanted.value
        for batch in batches:
            for text in batch.column(0):
                found = terms(text.as_py() or "")
                seen.update(found if keep is None else found & keep)
                if len(seen) > 300_000:
                    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(seen.values(), pa.int64())], ["term", "n"])
                    seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(seen.values(), pa.int64())], ["term", "n"])

    return rows.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def families(present: np.ndarray, support: np.ndarray, limit: int = FAMILIES) -> np.ndarray:
    """A family for each term (-1: none): a term joins the family it shares most documents with, relative to both.

    Terms come by falling support; the strongest that fits no family founds one while there are fewer than `limit`.
    """
    family = np.full(len(support), -1)
    cover = np.zeros((limit, present.shape[0]), bool)
    made = 0
    for t in range(len(support)):
        own = present[:, t]
        shared = [(own & cover[f]).sum() / max(1, own.sum()) for f in range(made)]
        if made and max(shared) >= 0.15:
            family[t] = int(np.argmax(shared))
        elif made < limit:
            family[t], made = made, made + 1
        elif made:
            family[t] = int(np.argmin(cover[:made].sum(1)))
        if family[t] >= 0:
            cover[family[t]] |= own
    return family


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 2e-4, steps: int = 300, rate: float = 0.1) -> np.ndarray:
    """Weights and, last, the bias of a ridge logistic regression."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w, m, v = (np.zeros(x.shape[1]) for _ in range(3))
    mask = np.append(np.ones(x.shape[1] - 1), 0)
    for t in range(1, steps + 1):
        g = x.T @ (y - 1 / (1 + np.exp(-(x @ w)))) / len(y) - penalty * mask * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def _probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))


@dataclass
class Chain:
    """The terms of the linear models and their weights: terms first, then earlier probabilities, then the bias."""

    index: dict[str, int] = field(default_factory=dict)
    models: list[np.ndarray] = field(default_factory=list)
    share: float = 0.0
    threshold: float = 0.5

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of every category and, last, of toxicity, for rows of term presence."""
        for model in self.models:
            x = np.hstack([x, _probability(x, model)[:, None]])
        return x[:, len(self.index) :] if self.models else np.full((len(x), 1), self.share)

    def presence(self, texts: list[str]) -> np.ndarray:
        x = np.zeros((len(texts), len(self.index)))
        known = self.index.keys()
        for i, text in enumerate(texts):
            x[i, [self.index[t] for t in terms(text) & known]] = 1
        return x


def fit(x: np.ndarray, targets: list[np.ndarray], index: dict[str, int], folds: int = FOLDS) -> Chain:
    """The chain over `targets`, in order, the last of them toxicity; document i is in fold i modulo `folds`."""
    models, fold = [], np.arange(len(x)) % folds
    for y in targets:
        models.append(logistic(x, y))
        ahead = np.zeros(len(x))
        for k in range(folds):
            rest = fold != k
            ahead[~rest] = _probability(x[~rest], logistic(x[rest], y[rest], steps=200)) if rest.any() and (~rest).any() else _probability(x[~rest], models[-1])
        x = np.hstack([x, ahead[:, None]])
    return Chain(index, models, float(targets[-1].mean()), best_threshold(ahead, targets[-1]))


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability from which calling documents toxic gives the best F1 out of fold: halfway to the next lower one."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    at = int(np.argmax(2 * hits / (np.arange(1, len(y) + 1) + y.sum())))
    below = p[order][p[order] < p[order][at]]
    return float((p[order][at] + (below[0] if len(below) else 0.0)) / 2)


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_DOCUMENTS) -> Chain:
    """Find terms and families and fit the chain on at most `limit` labelled documents outside the held-out fold."""
    from .common import cut

    sample = cut(labelled_sample(docs, labels, "toxic", limit))
    sizes = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Chain(share=float(bool(toxic)))
    marked = _count_terms(sample.filter("label = 1")).filter(F.col("n") >= 3).orderBy(F.desc("n"), "term").limit(CANDIDATE_TERMS).collect()
    in_toxic = {r.term: r.n for r in marked}
    in_clean = {r.term: r.n for r in _count_terms(sample.filter("label = 0"), docs.sparkSession.sparkContext.broadcast(frozenset(in_toxic))).collect()}
    odds = {t: np.log((n + 0.5) / (toxic + 1)) - np.log((in_clean.get(t, 0) + 0.5) / (clean + 1)) for t, n in in_toxic.items()}
    chosen = sorted((t for t in odds if odds[t] > 2), key=lambda t: (-odds[t] * in_toxic[t] ** 0.5, t))[:TERMS]
    index = {t: i for i, t in enumerate(chosen)}
    if not chosen:
        return Chain(share=toxic / (toxic + clean))

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(index[t] for t in terms(text.as_py() or "") & index.keys()) for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int32()), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "label", "found"])

    rows = sorted(sample.select("doc_id", "label", "text").mapInArrow(presence, "doc_id long, label int, found array<int>").collect(), key=lambda r: r.doc_id)
    x, y = np.zeros((len(rows), len(chosen))), np.array([r.label for r in rows], float)
    for i, r in enumerate(rows):
        x[i, r.found] = 1
    strong = np.array([odds[t] > 3.5 for t in chosen])
    by_support = np.argsort(-x[y == 1].sum(0) * strong, kind="stable")
    family = np.full(len(chosen), -1)
    family[by_support] = families(x[y == 1][:, by_support] > 0, x[y == 1].sum(0)[by_support])
    family[~strong] = -1
    targets = [y * (x[:, family == f].any(1) if (family == f).any() else 0) for f in range(FAMILIES)]
    return fit(x, [*targets, y], index)


def score(docs: DataFrame, chain: Chain, threshold: float | None = None) -> DataFrame:
    """One row per row of `docs`: doc_id, category_1 to category_4, toxicity (probabilities), toxic (0 or 1).

    Whole texts are read; null counts as empty. A category that the labels don't show has probability 0. Equal texts
    have equal results; repeated rows stay, an empty table gives an empty result, other columns are ignored.
    """
    threshold = chain.threshold if threshold is None else threshold
    names = ["doc_id", *(f"category_{i + 1}" for i in range(FAMILIES)), "toxicity", "toxic"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = chain.predict(chain.presence([t.as_py() or "" for t in batch.column(1)]))
            p = np.hstack([np.zeros((len(p), FAMILIES + 1 - p.shape[1])), p])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, j]) for j in range(FAMILIES + 1)), pa.array((p[:, -1] >= threshold).astype(np.int32))], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{n} double" for n in names[1:-1]) + ", toxic int")
