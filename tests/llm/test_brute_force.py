"""Operators against plain versions of what they compute, on small inputs."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def tables(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def varied(r, text, letters):
    out = list(text)
    kind, at = r.randint(0, 2), r.randint(0, max(0, len(out) - 1))
    if kind == 0 or not out:
        out.insert(at, r.choice(letters))
    elif kind == 1:
        del out[at]
    else:
        out[at] = r.choice(letters)
    return "".join(out)


@pytest.mark.parametrize("k", [1, 2, 3])
def test_banded_edits(spark, k):
    from tapline.llm.linededup import banded_edits

    r, rows = random.Random(k), []
    for _ in range(200):
        a = b = "".join(r.choice("abc") for _ in range(r.randint(0, 11)))
        for _ in range(r.randint(0, 5)):
            b = varied(r, b, "abc")
        rows.append((a, b))
    found = spark.createDataFrame(rows, "a string, b string").select("a", "b", banded_edits(F.col("a"), F.col("b"), k).alias("d")).collect()
    assert all(x.d == min(k + 1, distance(x.a, x.b)) for x in found)


def test_line_dedup(spark):
    from tapline.llm.linededup import MIN_CHARS, dedup_lines

    r = random.Random(4)
    base = ["".join(r.choice("abcdef ") for _ in range(r.randint(18, 60))) for _ in range(40)]
    docs = [(i, "\n".join(varied(r, r.choice(base), "xyz") if r.random() < 0.6 else r.choice(base) for _ in range(r.randint(1, 6)))) for i in range(100)]
    form = lambda s: s.strip(" ").lower().translate(str.maketrans("123456789", "0" * 9))
    spots = [(i, p, form(s)) for i, t in docs for p, s in enumerate(t.split("\n")) if len(form(s)) >= MIN_CHARS]
    root = {f: f for *_, f in spots}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    forms = sorted(root)
    for i, a in enumerate(forms):
        for b in forms[:i]:
            if abs(len(a) - len(b)) <= 1 and distance(a, b) <= 1:
                root[find(a)] = find(b)
    first = {}
    for i, p, f in spots:
        first[find(f)] = min(first.get(find(f), (i, p)), (i, p))
    gone = {(i, p) for i, p, f in spots if first[find(f)] != (i, p)}
    expected = {i: "\n".join(s for p, s in enumerate(t.split("\n")) if (i, p) not in gone) for i, t in docs}
    found = {x.doc_id: x._kept_text for x in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found == expected and gone


def shingles(text, n):
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
    n = min(n, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else frozenset()


def near_copies(seed, groups, most):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeioutrsn") for _ in range(r.randint(1, 6)))
    shared, texts = [word() for _ in range(12)], []
    for _ in range(groups):
        base = [word() for _ in range(r.randint(1, 80))]
        family = [base]
        for _ in range(r.randint(0, most)):
            copy = list(r.choice(family))
            for _ in range(r.randint(0, 4)):
                copy[r.randrange(len(copy))] = word()
            family.append(copy[: r.randint(max(1, len(copy) - 6), len(copy))])
        texts += [" ".join(w + shared if r.random() < 0.3 else w) for w in family]
    r.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed,groups,most", [(1, 40, 4), (2, 2, 90)])
def test_near_duplicates(spark, seed, groups, most):
    from tapline.llm.neardup import near_duplicates

    docs = near_copies(seed, groups, most)
    sets = {i: shingles(t, 4) for i, t in docs}
    root = {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    found = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), n=4).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in found} == {i: (len(sets[i]), find(i), find(i) == i) for i, _ in docs}


def test_components(spark):
    from tapline.llm.components import connected_components

    r = random.Random(9)
    edges = [(i, i + 1) for i in range(40)] + [(r.randint(100, 160), r.randint(100, 160)) for _ in range(50)] + [(5, None)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    found = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((x.node, x.component) for x in found) == sorted((n, find(n)) for n in root)


def test_topk(spark):
    from tapline.llm.topk import branch_and_bound, exact_topk

    rng = np.random.default_rng(3)
    vectors = np.round(rng.normal(size=(400, 40)), 2).astype(np.float32)
    vectors[50:90] = vectors[0]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(1000, None), (1050, [float("nan")] * 40), (1100, [1.0, None]), (1150, [1.0, 2.0])]
    whole = np.floor(256 * vectors.astype(np.float64)).astype(np.int64)
    expected = []
    for q in range(0, 400, 50):
        scores = sorted((-int(s), i) for i, s in enumerate(whole @ whole[q]) if i != q)[:5]
        expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    found = exact_topk(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted(map(tuple, found)) == expected
    q, v, s = branch_and_bound(whole[:1], np.array([0]), whole, np.arange(400), 5)
    assert list(zip(q, v, s)) == [(a, c, d) for a, _, c, d in expected[:5]]


def test_mixing(spark):
    from tapline.llm.mixing import fit_lengths, mix

    r = random.Random(2)
    docs = [(i, r.choice(["b", "b", "b", "a", "c", None]), " ".join("w" * r.randint(1, 3) for _ in range(r.randint(0, 40)))) for i in range(400)] + [(900, "tiny", "one two")]
    frame = spark.createDataFrame(docs, "doc_id long, source string, text string")
    rows = mix(frame).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mix(frame.repartition(7)).collect()))
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, _, t in docs}
    totals = Counter()
    for i, s, _ in docs:
        totals[s] += size[i]
    names = sorted((s for s in totals if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(totals.values()))
    while True:
        share = left / sum(weight[s] for s in free)
        over = {s for s in free if share * weight[s] > 3 * totals[s]}
        if not over:
            break
        for s in over:
            target[s] = 3.0 * totals[s]
            left -= target[s]
        free -= over
    target |= {s: share * weight[s] for s in free}
    taken = Counter()
    for x in rows:
        assert x._size == size[x.doc_id] and x._source_size == totals[x.source] and abs(x._target - target[x.source]) < 1e-6 and 0 <= x._copies <= 3
        taken[x.source] += x._size * x._copies
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    for _ in range(30):
        counts = {r.randint(1, 30): r.randint(1, 5) for _ in range(r.randint(1, 6))}
        budget = r.randint(0, sum(k * n for k, n in counts.items()))
        reach = {0}
        for k, n in counts.items():
            reach = {x + k * m for x in reach for m in range(n + 1)}
        take = fit_lengths(dict(counts), budget)
        proportional = {k: n * budget // max(1, sum(a * b for a, b in counts.items())) for k, n in counts.items()}
        assert all(proportional[k] <= m <= counts[k] for k, m in take.items())
        assert sum(k * m for k, m in take.items()) <= budget and (budget not in reach or budget - sum(k * m for k, m in take.items()) < 30)


def test_fingerprints(spark):
    from tapline.llm.fingerprint import digests, differences, fingerprints

    docs = sorted((x.doc_id, x.text or "") for x in tables(spark, "documents").collect())
    found = {x.doc_id: x for x in fingerprints(tables(spark, "documents")).collect()}
    assert len(found) == len(docs)
    prints = defaultdict(set)
    for k, (i, text) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        x = found[i]
        assert (x.n_chars, x.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        prints[text].add(x.fingerprint)
        for value, other in ((x.near_edited, edited), (x.near_next, after)):
            a, b = set(digests(text).tolist()), set(digests(other).tolist())
            assert value == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
    assert all(len(p) == 1 for p in prints.values())
    rng = np.random.default_rng(1)
    pools = [(np.unique(rng.integers(0, 2**63, rng.integers(0, 300)).astype(np.uint64)),) * 2 for _ in range(20)]
    left, right = [a[rng.random(len(a)) < 0.8] for a, _ in pools], [a[rng.random(len(a)) < 0.8] for a, _ in pools]
    assert differences(left, right).tolist() == [len(set(a.tolist()) ^ set(b.tolist())) for a, b in zip(left, right)]


def test_bpe(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from tapline.llm.bpe import Encoder, Lexicon, Vocabulary, compile_lexicon, encode_documents, write_lexicon

    path = public_tokenizers.path("byte_bpe_50k.json")
    theirs = Tokenizer.from_file(path)
    docs = {x.doc_id: x.text or "" for x in tables(spark, "documents").collect()}
    for x in encode_documents(tables(spark, "documents"), path, with_ids=True, with_text=True).collect():
        ids = theirs.encode(docs[x.doc_id], add_special_tokens=False).ids
        assert x.ids == ids and x.n_tokens == len(ids) and x.decoded == docs[x.doc_id]
        assert x.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert x.decoded_sha256 == hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    vocabulary = Vocabulary(path)
    encoder, r = Encoder(vocabulary), random.Random(6)
    parts = ["a", "Be", " ", "  ", "\n", "\n\n", "\t", "\xa0", "\x1c", "\x85", "　", "1", "²", "é", "日本", "😀", "!", "'s", "<|endoftext|>", "\r\n", "x" * 90]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 12)))
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == ids
    words = {w.encode(): [k, k + 1] for k, w in enumerate(sorted({"".join(r.choice("abc") for _ in range(r.randint(1, 7))) for _ in range(300)}))}
    import tempfile

    with tempfile.NamedTemporaryFile() as f:
        write_lexicon(compile_lexicon(words), f.name)
        lexicon = Lexicon(f.name)
        assert all(np.frombuffer(lexicon.find(w), "<u4").tolist() == ids for w, ids in words.items())
        assert lexicon.find(b"abcabcabcabc") is None and lexicon.find(b"") is None


def test_pii_base():
    from tapline.llm.pii import base_spans

    def plain(text):
        out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
            digits = [int(c) for c in m.group() if c.isdigit()]
            doubled = [d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits))]
            if 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0:
                out.append(("card", *m.span()))
        out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
        return out

    r = random.Random(8)
    parts = ["a", "b.c", "@", "x@y", "x@y.z", ".", "..", "1", "255", "256", "007", "1.2.3.4", "4111 1111 1111 1111", "4111-1111", "+1 (999) 555-1234", "+", "(", ")", " ", "-", "é", "%", "12.12.12.12.12", "@@", "٣"]
    for _ in range(20000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 9)))
        assert base_spans(text) == plain(text), text


def test_pii_bootstrapping(spark, monkeypatch):
    from tapline.llm import pii

    known = [(i, f"reach me, my phone: +1 (20{i % 10}) 555-12{i:02d} today") for i in range(40)]
    known += [(50 + i, f"write to me{i}@mail.example.com soon") for i in range(30)]
    unseen = [(100, "reach me, my phone: 1 (999) 555-9999 today"), (101, "write to them [at] mail [dot] org soon"), (102, "the year 20231111 was fine")]
    frame = spark.createDataFrame(known + unseen, "doc_id long, text string")
    found = {x.doc_id: x for x in pii.extract(frame).collect()}
    assert all(found[i].n_phone == 1 for i in range(40)) and found[102].spans == ""
    assert (found[100].n_phone, found[100].spans, found[101].spans) == (0, "phone:20:36", "email:9:33")
    monkeypatch.setattr(pii, "BROADCAST_PATTERNS", 0)  # the way for more patterns than can be sent
    assert {x.doc_id: x for x in pii.extract(frame).collect()} == found


def test_quality_learns(spark):
    from tapline.llm import quality

    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    field = quality.train(docs, labels)
    rows = quality.score(docs.select("doc_id", "text"), field).join(labels, "doc_id").select("doc_id", "_score", "_predicted", "quality", (quality.held_out_fold(F.col("doc_id")) == 0).alias("held")).collect()
    held = [x for x in rows if x.held]
    assert sum(x._predicted == x.quality for x in held) / len(held) > 0.95
    good, bad = [x._score for x in held if x.quality], [x._score for x in held if not x.quality]
    assert np.mean([a > b for a in good for b in bad]) > 0.97


def test_forward_backward():
    from itertools import product

    from tapline.llm.quality import forward_backward

    rng = np.random.default_rng(2)
    lengths, transition = np.array([3, 1, 5]), rng.normal(size=(2, 2))
    emission = rng.normal(size=9)
    good, _, total = forward_backward(emission, lengths, transition)
    at, logs = 0, 0.0
    for n in lengths:
        e = emission[at : at + n]
        paths = {p: np.exp(sum(e[i] * p[i] for i in range(n)) + sum(transition[p[i], p[i + 1]] for i in range(n - 1))) for p in product((0, 1), repeat=int(n))}
        z = sum(paths.values())
        logs += np.log(z)
        for i in range(n):
            assert good[at + i] == pytest.approx(sum(v for p, v in paths.items() if p[i]) / z)
        at += n
    assert total == pytest.approx(logs)


def test_toxicity_learns(spark):
    from tapline.llm import toxicity

    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = toxicity.score(docs, toxicity.train(docs, labels)).withColumnRenamed("toxic", "called").join(labels, "doc_id").collect()
    toxic, clean = [x for x in rows if x.toxic], [x for x in rows if not x.toxic]
    assert np.mean([x.called for x in toxic]) > 0.7 and np.mean([x.called for x in clean]) < 0.03


def test_html_on_pages_and_layouts(spark):
    import html

    from tapline.llm.html import Layouts, Page, decode, extract, labelled_nodes, model, node_features, text_of

    for x in extract(tables(spark, "pages")).join(tables(spark, "pages").select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)(</article>|$)", x.html, re.S)[1]
        plain = re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", article))
        assert x.text == " ".join(html.unescape(plain).split()) and x.n_chars == len(x.text)
    trees, made, wrong = model(), Layouts(77), 0
    for _ in range(150):
        page = Page(made.page())
        kept = decode(page, trees.probability(node_features(page)))
        assert all(kept[page.parent[i]] for i in range(1, len(kept)) if kept[i])
        wrong += text_of(page, kept) != text_of(page, labelled_nodes(page) > 0)
    assert wrong <= 15
