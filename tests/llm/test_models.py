"""Fingerprints from their strings, pattern scores against plain loops, and the toxicity chain step by step."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_likeness_follows_from_the_strings(spark):
    from tapline.llm import fingerprint

    rows = fingerprint.fingerprints(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).orderBy("doc_id").collect()
    prints, edited = [x.fingerprint for x in rows], [x.edited_fingerprint for x in rows]
    assert fingerprint.likeness(prints, edited) == pytest.approx([x.near_edited for x in rows])
    assert fingerprint.likeness(prints, [*prints[1:], prints[0]]) == pytest.approx([x.near_next for x in rows])
    read = fingerprint.Prints.read(prints)
    keys, owners = read.digests()  # every published sketch gives up all that it holds
    assert np.bincount(owners, minlength=len(rows)).tolist() == read.sizes.tolist() and len(keys) == read.sizes.sum()


def test_pattern_scores(spark):
    from tapline.llm.pii import score_patterns

    r = random.Random(12)
    edges = {(r.choice(("", "", "email", "phone")) if i % 3 else "", f"i{i % 60}", f"p{r.randint(0, 25) if r.random() < 0.6 else i % 5}") for i in range(500)}
    kinds, members = defaultdict(set), defaultdict(dict)
    for kind, instance, pattern in edges:
        kinds[instance] |= {kind} - {""}
        members[pattern][instance] = max(kind, members[pattern].get(instance, ""))
    belief = {(k, i): 1.0 for i, ks in kinds.items() for k in ks}
    for _ in range(3):
        scores = {(k, p): sum(belief.get((k, i), 0.0) for i in own) / (len(own) + 1) for p, own in members.items() if len(own) >= 3 for k in ("email", "phone")}
        good = {x: c for x, c in scores.items() if c >= 0.4}
        belief = {(k, i): 1.0 for i, ks in kinds.items() for k in ks}
        new = defaultdict(float)
        for (k, p), c in good.items():
            for i, kind in members[p].items():
                if kind == "":
                    new[k, i] = max(new[k, i], c)
        for x, c in new.items():
            belief[x] = belief.get(x, 0.0) + c  # a seed elsewhere can also be found as an unknown mention
    found = score_patterns(spark.createDataFrame(sorted(edges), "kind string, instance string, pattern string"), confident=0.4)
    assert good and {(x.kind, x.pattern): pytest.approx(x.confidence) for x in found.collect()} == good


def test_codes_need_their_context(spark):
    from tapline.llm import pii

    code = lambda i: f"{i:02d}ab" * 10
    docs = [(i, f'words api_key = "{code(i)}" more') for i in range(12)] + [(20, 'words api_key = "a1b2c3d4e5f6" more'), (21, "seen commit 0a0b" * 1 + "0a0b" * 10 + " there"), (22, 'words api_key = "none" more 1234')]
    found = {x.doc_id: x for x in pii.extract(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(found[i].spans == f"secret:17:{17 + 40}" and found[i].n_spans == 1 for i in range(12))
    assert found[20].spans == "secret:17:29" and found[21].spans == "" and found[22].spans == ""


def test_chain_step_by_step():
    from tapline.llm.toxicity import Chain, fit, logistic

    rng = np.random.default_rng(5)
    x = (rng.random((120, 6)) < 0.4).astype(float)
    first = (x[:, 0] + x[:, 1] > 0).astype(float)
    last = np.where(first > 0, (x[:, 2] > 0), 0.0).astype(float)
    chain = fit(x, [first, last], {str(i): i for i in range(6)}, folds=4)
    value = lambda rows, w: np.array([1 / (1 + np.exp(-(sum(a * b for a, b in zip(row, w)) + w[-1]))) for row in rows])
    fold, ahead = np.arange(120) % 4, np.zeros(120)
    for k in range(4):  # each row's earlier probability comes from a model that hasn't seen the row
        ahead[fold == k] = value(x[fold == k], logistic(x[fold != k], first[fold != k], steps=200))
    assert np.allclose(chain.models[0], logistic(x, first)) and np.allclose(chain.models[1], logistic(np.column_stack([x, ahead]), last))
    one = value(x, chain.models[0])
    assert np.allclose(chain.predict(x), np.column_stack([one, value(np.column_stack([x, one]), chain.models[1])]))
    assert Chain(share=0.25).predict(np.zeros((3, 0))).tolist() == [[0.25]] * 3


def test_toxicity_on_held_out_rows(spark):
    from tapline.llm import toxicity
    from tapline.llm.common import held_out_fold

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    scored = toxicity.score(docs, toxicity.train(docs, labels)).join(labels.select("doc_id", F.col("toxic").alias("label")), "doc_id")
    held = scored.filter(held_out_fold(F.col("doc_id")) == 0).select("toxic", "label").collect()
    assert len(held) > 50 and sum(x.toxic == x.label for x in held) >= 0.95 * len(held)
