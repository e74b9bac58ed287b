"""The name model: features against plain Python, Newton's method against NumPy, and bundles that must not be used."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapline.operators import lexical, observe


def plain_table(labels):
    counts = np.ones((40, 40))
    place = lambda c: lexical.SYMBOLS.find(c) if c in lexical.SYMBOLS[:37] + "^$" else 39
    for label in labels:
        seq = [37, *(place(c) if c not in "^$" else 39 for c in label), 38]
        for a, b in zip(seq, seq[1:]):
            counts[a, b] += 1
    return np.log(counts / counts.sum(1, keepdims=True))


def plain_vector(name, label, suffix_labels, depth, table):
    n, symbols = len(label), [c if c in lexical.SYMBOLS[:37] else "?" for c in label]
    framed = ["^", *symbols, "$"]
    pairs = list(zip(framed, framed[1:]))
    shares = Counter()
    for a, b in pairs:
        h = 0x811C9DC5
        for byte in (a + b).encode():
            h = (h ^ byte) * 0x01000193 & 0xFFFFFFFF
        shares[h % 32] += 1 / len(pairs)
    run = lambda some: max((len(x) for x in "".join(c if c in some else " " for c in label).split()), default=0)
    share = lambda some: sum(c in some for c in label) / n
    consonants, digits = "bcdfghjklmnpqrstvwxyz", "0123456789"
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(label).values())
    log = sum(table[lexical.SYMBOLS.index(a), lexical.SYMBOLS.index(b)] for a, b in pairs) / len(pairs)
    return [min(n, 63), entropy, share(digits), share("aeiou"), share(consonants), min(run(consonants), 63), min(run(digits), 63), min(label.count("-"), 10), len(set(label)) / n, share("0123456789abcdef"), len(name), min(depth, 10), suffix_labels, log, *(shares[i] for i in range(32))]


NAMES = [("www.example-shop.co.uk", "example-shop", 2, 1), ("a.b.c.xk7q9zt2vw.com", "xk7q9zt2vw", 1, 3), ("MixedCASE.Org.", "mixedcase", 1, 0), ("under_score.net", "under_score", 1, 0), ("x1-----------2.info", "x1-----------2", 1, 0), ("z" * 63 + ".org", "z" * 63, 1, 0)]
LABELS = ["example", "shop", "under_score", "a--b", "straße", "weather", "abc"]


def test_features(spark):
    table = lexical.transition_table(spark.createDataFrame([(x,) for x in LABELS] + [(None,)], "label string"))
    assert np.allclose(np.array(table).reshape(40, 40), plain_table(LABELS), atol=1e-12)
    rows = spark.createDataFrame([(i, q[0]) for i, q in enumerate(NAMES)] + [(90, "short.com"), (91, "printer.local"), (92, None)], "i int, q string")
    got = {r.i: r.x for r in rows.select("i", lexical.vector(F.col("q"), table).alias("x")).collect()}
    assert got[90] is got[91] is got[92] is None and len(lexical.NAMES) == 46
    for i, (name, label, suffix, depth) in enumerate(NAMES):
        want = plain_vector(name.lower().rstrip("."), label, suffix, depth, plain_table(LABELS))
        assert got[i] == pytest.approx(want, abs=1e-9), lexical.NAMES[int(np.argmax(np.abs(np.array(got[i]) - want)))]


def test_newton(spark):
    r = np.random.default_rng(7)
    x = np.hstack([r.normal(3, 2, (300, 4)), np.full((300, 1), 2.5)])
    y = (x[:, 0] - 0.5 * x[:, 1] + r.normal(0, 1, 300) > 1.5).astype(float)
    rows = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y)] + [(None, 1.0)], "x array<double>, y double").repartition(5)
    model = lexical.fit(rows, [], 0.7)
    means, scales = x.mean(0), x.std(0)
    scales[scales < 1e-9] = 1
    a, w = np.hstack([(x - means) / scales, np.ones((300, 1))]), np.zeros(6)
    ridge = np.array([0.7] * 5 + [0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ w))
        w -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge + 1e-9), a.T @ (p - y) + ridge * w)
    assert np.allclose([*model.weights, model.intercept], w, atol=1e-8) and np.allclose(model.means, means)
    p = {r.i: r.p for r in spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:20])], "i int, x array<double>").select("i", model.probability(F.col("x")).alias("p")).collect()}
    assert np.allclose([p[i] for i in range(20)], (1 / (1 + np.exp(-a @ w)))[:20], atol=1e-8)


def test_threshold(spark):
    scores = spark.createDataFrame([(i / 1000,) for i in range(200, 900)], "p double")
    ordered = [i / 1000 for i in range(200, 900)]
    assert lexical.threshold(scores) == ordered[math.ceil(0.99 * 700) - 1]
    assert lexical.threshold(scores.filter("p < 0.3")) == 0.5 and lexical.threshold(scores.limit(0)) == 0.5


@pytest.fixture(scope="module")
def model(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice(("ba", "na", "ter", "sol", "win", "der", "for", "est")) for _ in range(r.randint(3, 5)))
    noise = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(r.randint(10, 16)))
    good, bad = [word() for _ in range(150)], [noise() for _ in range(150)]
    table = lexical.transition_table(spark.createDataFrame([(x,) for x in good], "label string"))
    rows = spark.createDataFrame([(x + ".com", 0.0) for x in good] + [(x + ".com", 1.0) for x in bad], "q string, y double").withColumn("x", lexical.vector(F.col("q"), table))
    return lexical.fit(rows, table, 1.0)


def test_bundle(spark, model, tmp_path):
    folder = str(tmp_path)
    digests = lexical.save(spark, model, ["www.weather-report.com", "xk7q9zt2vw.com"], folder)
    loaded, why = lexical.load(spark, folder, digests)
    assert loaded == model and why == "active"
    assert lexical.load(spark, folder, digests | {"model": "0" * 64}) == (None, "checksum of model")
    assert lexical.load(spark, f"{folder}/none", digests)[1].startswith("unreadable")
    import dataclasses

    other = dataclasses.replace(model, intercept=model.intercept + 1)
    tampered = digests | {"model": lexical._write(spark, folder, "model", dataclasses.asdict(other))}
    assert lexical.load(spark, folder, digests) == (None, "checksum of model")
    assert lexical.load(spark, folder, tampered)[1].startswith("golden score")
    skewed = dataclasses.replace(model, table=[x - 0.5 for x in model.table])
    tampered = digests | {"model": lexical._write(spark, folder, "model", dataclasses.asdict(skewed))}
    assert lexical.load(spark, folder, tampered)[1].startswith("golden features")
    tampered = digests | {"contract": lexical._write(spark, folder, "contract", {"version": "2", "features": lexical.NAMES})}
    lexical._write(spark, folder, "model", dataclasses.asdict(model))
    assert lexical.load(spark, folder, tampered) == (None, "feature contract")


def test_errors_disable_a_partition(spark, model):
    fine, broken = [0.5] * 46, [float("nan")] * 46
    rows = [fine, None, *[broken] * 19, fine, *[[1.0]] * 20, fine, fine]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x array<double>").coalesce(1).sortWithinPartitions("i")
    got = [(r.p is not None, r.reason) for r in sorted(lexical.guarded(frame, model).collect(), key=lambda r: r.i)]
    assert got == [(True, None), (False, "not_eligible"), *[(False, "model_error")] * 19, (True, None), *[(False, "model_error")] * 20, (False, "model_disabled"), (False, "model_disabled")]
    assert {r.reason for r in lexical.guarded(frame, None).collect()} == {"model_unavailable"}


def test_named_with_a_model(spark, model):
    import dataclasses

    strict = dataclasses.replace(model, threshold=0.999999999)
    cases = ["www.banasolwinder.com", "q8x2kz7vw3pj.com", "abc.com", "x.internal", None]
    frame = spark.createDataFrame([(i, q) for i, q in enumerate(cases)], "i int, query string")
    got = {r.i: r for r in observe.named(frame, [], model).collect()}
    assert not got[0].looks_generated and got[1].looks_generated and got[1].generated and len(got[1].top) == 5
    assert [got[i].reason for i in range(5)] == [None, None, "label_too_short", "not_registrable", "query_unavailable"]
    sizes = [abs(t.adds) for t in got[1].top]
    assert sizes == sorted(sizes, reverse=True) and {t.feature for t in got[1].top} <= set(lexical.NAMES)
    stricter = {r.i: r for r in observe.named(frame, [], strict).collect()}
    assert stricter[1].looks_generated and stricter[1].generated == (stricter[1].p >= strict.threshold)


def test_generated_domains(spark):
    from tapline.operators import detectors

    rows = [("h", "bad.com", 1000, 0.97, True, False), ("h", "bad.com", 2000, 0.98, True, True), ("h", "bad.com", 3000, 0.99, True, True), ("h", "bad.com", 61_000, 0.96, True, False), ("h", "good.com", 1000, 0.6, False, True), ("h", None, 1000, 0.99, True, True)]
    frame = spark.createDataFrame(rows, "src string, registrable string, obs_ms long, p double, generated boolean, nx boolean")
    got = sorted((r.obs_ms, r.registrable, r.subtype, r.severity, r.score) for r in detectors.generated_domains(frame).collect())
    assert got == [(1000, "bad.com", "dga_domain", "low", 0.97), (2000, "bad.com", "dga_domain", "medium", 0.98), (61_000, "bad.com", "dga_domain", "low", 0.96)]


def test_scores_of_pages(spark, tmp_path):
    """Every page's names are scored, in time that is a matter of passes and not of expressions written out again."""
    import time

    from tapline.plans.registry import QUERIES

    r = random.Random(4)
    hosts = ["".join(r.choice(("ba", "na", "ter", "sol", "win", "der", "for", "est")) for _ in range(4)) + r.choice((".com", ".co.uk", ".example.org")) for _ in range(400)]
    spark.createDataFrame([(i, f"https://www.{h}/{i}") for i, h in enumerate(hosts)], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    began = time.time()
    got = QUERIES["q_lexical_scores"](spark, str(tmp_path)).collect()
    assert time.time() - began < 60
    assert sorted((x.page_id, x.generated) for x in got) == [(i, k) for i in range(400) for k in (0, 1)]
    assert all((x.p > 0.5) == (x.generated == 1) for x in got if x.reason is None) and sum(x.reason is None for x in got) > 700
