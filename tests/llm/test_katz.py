"""Katz scores against a recursive evaluation over plain dictionaries, exact normalisation, and awkward rows."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tapline.llm import katz


def tokens_of(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", text), None]


def remains(counts):
    """What is left of counts by Good and Turing's estimate, from the definition."""
    having = Counter(counts.values())

    def left(n):
        if n <= katz.SMALL and having[n]:
            guess = (n + 1) * having[n + 1] / having[n]
            if 0 < guess < n:
                return guess
        return n - katz.LESS

    return left


class Plain:
    """The model as dictionaries."""

    def __init__(self, texts):
        self.one, self.two = Counter(), defaultdict(Counter)
        for text in texts:
            before = "<start>"
            for t in tokens_of(text):
                self.one[t] += 1
                self.two[before][t] += 1
                before = t
        self.n = sum(self.one.values())
        self.left1 = remains(self.one)
        self.left2 = remains({(v, w): n for v, c in self.two.items() for w, n in c.items()})
        self.weights = {}

    def p(self, word, context=()):
        if not context:
            if not self.n:
                return 1.0
            return self.left1(self.one[word]) / self.n if self.one[word] else 1 - sum(map(self.left1, self.one.values())) / self.n
        if context[0] not in self.two:
            return self.p(word)
        after = self.two[context[0]]
        if after[word]:
            return self.left2(after[word]) / sum(after.values())
        return self.weight(context[0]) * self.p(word)

    def weight(self, v):
        if v not in self.weights:
            after = {w: n for w, n in self.two[v].items() if n}
            self.weights[v] = (1 - sum(map(self.left2, after.values())) / sum(after.values())) / (1 - sum(self.p(w) for w in after))
        return self.weights[v]


def rows(docs):
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in docs]
    model = Plain([t for (_, t), h in zip(docs, held) if not h])
    out = []
    for (i, text), h in zip(docs, held):
        before, score, base, known, tokens = "<start>", 0.0, 0.0, 0, tokens_of(text)
        for t in tokens:
            score += math.log10(model.p(t, (before,)))
            base += math.log10((model.one[t] + 1) / (model.n + len(model.one) + 1))
            known += model.one[t] > 0
            before = t
        out.append((-1 if i is None else i, h, len(tokens), known, model.n, round(base, 6), round(score, 6)))
    return sorted(out)


def got(frame):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in frame.collect())


def same(a, b):
    assert [x[:5] for x in a] == [x[:5] for x in b]
    for x, y in zip(a, b):
        assert x[5:] == pytest.approx(y[5:], abs=1e-5)


@pytest.fixture(scope="module")
def docs(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(90).collect()]
    return docs + [(None, "a b a b A B"), (None, None), (7, ""), (7, ""), (7, "a b"), (11, " \t\n"), (12, "Ünicode ÜNICODE it's   x")]


def test_against_dictionaries(spark, docs, monkeypatch):
    frame = spark.createDataFrame([(i, t, "w", 0) for i, t in docs], "doc_id long, text string, word string, key int").repartition(3)
    want = rows(docs)
    same(got(katz.score_documents(frame)), want)
    build = katz.build
    monkeypatch.setattr(katz, "build", lambda docs, learns: build(docs, learns, 500, 300))
    same(got(katz.score_documents(frame)), want)


def test_normalised(spark, docs):
    from pyspark.sql import functions as F

    model = katz.build(spark.createDataFrame(docs, "doc_id long, text string"), F.lit(True), 1000, 2000)
    words = {r.word: float(model.level.probability(katz.np.array([r.n]))[0]) for r in model.words.collect()}
    assert sum(words.values()) + model.level.unseen == pytest.approx(1, abs=1e-12)
    after = defaultdict(list)
    for r in model.grams.collect():
        after[r.context].append((r.word, r.n, r.lower))
        assert r.lower == words[r.word]
    contexts = {r.context: r for r in model.contexts.collect()}
    assert set(after) == set(contexts) and len(after) > 300
    for v, found in after.items():
        c = contexts[v]
        seen = sum(float(model.second.kept(katz.np.array([n]))[0]) for _, n, _ in found) / c.n
        unseen = 1 - sum(words[w] for w, _, _ in found)
        assert seen + c.left / c.n / (1 - c.lower) * unseen == pytest.approx(1, abs=1e-9)
        assert c.left > 0


def test_awkward(spark):
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert katz.score_documents(frame([])).count() == 0
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2]
    only = [(i, "no one taught this") for i in held]
    assert {(r.base_score, r.score, r.n_known) for r in katz.score_documents(frame(only)).collect()} == {(0.0, 0.0, 0)}
    mixed = [(i, "same words again " * 9) for i in range(40)] + [(None, "w" * 200_000)]
    same(got(katz.score_documents(frame(mixed))), rows(mixed))


def test_a_bucket_is_scored_in_little_memory(spark):
    """A bucket's work takes a bounded number of bytes an occurrence, and goes back in small batches."""
    import random
    import tracemalloc

    pa, r = katz.pa, random.Random(3)
    texts = [" ".join(str(min(int(r.expovariate(0.002)), int(r.expovariate(0.0005)))) for _ in range(300)) for _ in range(700)]
    rows = pa.RecordBatch.from_arrays([pa.array(range(700)), pa.array([i % 7 > 0 for i in range(700)]), pa.array(texts)], names=["key", "learns", "text"])
    cells = list(katz._cells(100_000, 1, katz.np.zeros(0, katz.np.uint64))(iter([rows])))
    work = katz._bucket(katz.Words(180_000, 4000, katz.Discounts((0.5, 1.5, 2.5, 3.5, 4.5)), 1e-6), {})
    tracemalloc.start()
    try:
        sizes = [b.num_rows for b in work(iter(cells))]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    tokens = 700 * 301
    assert sum(sizes) > tokens // 2 and max(sizes) <= 1 << 16
    assert peak < 75 * tokens


def test_scores_need_no_bigrams_written(spark):
    """A bucket writes a row for each of its contexts, with what the discounts need, and not one for each bigram."""
    pa, np = katz.pa, katz.np
    texts = [" ".join("abcdefgh"[(i * k) % 8] for k in range(60)) for i in range(40)] + ["a b"] * 9 + [None]
    rows = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array([True] * 49 + [False]), pa.array(texts)], names=["key", "learns", "text"])
    cells = list(katz._cells(200, 1, np.zeros(0, np.uint64))(iter([rows])))
    level = katz.Words(2500, 9, katz.Discounts((0.5, 1.5, 2.5, 3.5, 4.5)), 1e-6)
    made = lambda *args: [r for b in katz._bucket(level, {}, *args)(iter(cells)) for r in b.to_pylist()]
    want = Plain(texts[:-1]).two
    full, short = made(), made(False)
    assert [r for r in full if r["kind"] != katz.GRAM] == short
    grams = [r for r in full if r["kind"] == katz.GRAM]
    assert len(grams) == sum(map(len, want.values())) > 3 * len(want)
    contexts = [r for r in short if r["kind"] == katz.CONTEXT]
    assert len(contexts) == len(want)
    for c in contexts:
        own = [g for g in grams if g["a"] == c["a"]]
        assert (c["n"], c["known"]) == (sum(g["n"] for g in own), len(own))
        assert c["x"] == pytest.approx(sum(g["x"] for g in own))
        assert c["small"] == [sum(g["n"] == r for g in own) for r in range(1, katz.SMALL + 2)]
