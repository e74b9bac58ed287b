"""Spelling variants against all pairs, on small vocabularies and in each kind of part."""

import random
import re
import zlib
from collections import Counter

import pytest

from tapline.llm import variants


def apart(x, y):
    """Whether x and y differ by exactly one inserted, deleted or replaced code point."""
    if abs(len(x) - len(y)) > 1 or x == y:
        return False
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    x, y = sorted((x, y), key=len)
    return any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def brute(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {w: [v for v in words if apart(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w] or "", root, n, len(near[w]), words[form[w]] if form[w] else -1))
    return sorted(out)


def rows_of(frame):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in frame.collect())


def spelled(r, alphabet, words, lengths):
    """A vocabulary with many near words: bases and up to two edits of each."""
    out = set()
    while len(out) < words:
        w = [r.choice(alphabet) for _ in range(r.choice(lengths))]
        out.add("".join(w))
        for _ in range(3):
            v = list(w)
            for _ in range(r.randint(1, 2)):
                at, kind = r.randrange(len(v)), r.randrange(3)
                v[at : at + (kind != 0)] = [] if kind == 1 else [r.choice(alphabet)]
            out.add("".join(v))
    return sorted(w for w in out if len(w) >= 7)


@pytest.mark.parametrize("alphabet, lengths", [("ab", (7, 8, 9)), ("abcdé", (7, 8, 10)), ("ab", (63, 64, 65, 66))])
@pytest.mark.parametrize("part_words", [3, 20_000])
def test_near_words(spark, alphabet, lengths, part_words):
    r = random.Random(len(alphabet) + lengths[0])
    words = spelled(r, alphabet, 150, lengths)
    counts = {w: r.randint(2, 9) for w in words}
    got = {x.word: (x.n_near, x.form_n, x.form) for x in variants.near_words(spark.createDataFrame(list(counts.items()), "word string, n long"), part_words).collect()}
    want = {}
    for w in words:
        near = [v for v in words if apart(w, v)]
        if near:
            best = min(near, key=lambda v: (-counts[v], v))
            want[w] = (len(near), counts[best], best)
    assert got == want


def test_acceptor_is_minimal():
    words = sorted(["walking", "talking", "walked", "talked", "stalked"])
    machine = variants.Acceptor(words, 0)
    languages = []
    for final, arcs, n in machine.states:
        own = {""} if final else set()
        for c, to, _ in arcs:
            own |= {c + rest for rest in languages[to]}
        assert own not in languages and len(own) == n
        languages.append(own)
    assert languages[machine.start] == set(words)


def test_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(40).collect()]
    docs += [(None, "Spelling Spelling"), (9001, None), (9002, ""), (9003, "spelling " * 30 + "spellinng spellinng spe11ing"), (9003, "spelling " * 30)]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, word string, n int")
    assert rows_of(variants.group_variants(frame, part_words=50)) == brute(docs)
    assert variants.group_variants(frame.limit(0)).count() == 0


def test_roots(spark):
    chain = [("aaaaaaa", "aaaaaab", 2), ("aaaaaab", "aaaaabb", 20), ("aaaaabb", "aaaabbb", 200), ("zzzzzzz", "aaaaaab", 2)]
    got = {r.word: r.root for r in variants.roots(spark.createDataFrame(chain, "word string, form string, n long")).collect()}
    assert set(got.values()) == {"aaaabbb"} and len(got) == 4


def test_long_runs(spark):
    """A run of very many letters is a word like any other."""
    base = "ab" * 4000
    words = [base, base[:-1], base[:5000] + base[5001:], "x" + base]
    want = {w: sum(apart(w, v) for v in words) for w in words}
    frame = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    assert {r.word: r.n_near for r in variants.near_words(frame).collect()} == {w: n for w, n in want.items() if n}
