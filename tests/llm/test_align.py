"""Alignment of tokens against plain loops, the monoid's laws, and long documents over several tasks."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tapline.llm import align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["Hello world, isn't it?", "", None, "  two  spaces\n\nand\tlines ", "naïve 漢字漢 \U0001f600 é <|endoftext|> </s> x", "Hello world, isn't it?", "12345678901234567890 $%^", "▁odd▁piece", "a" * 500]


def brute(texts):
    """The contract read plainly, with the tokenizers library and no code of the operator."""
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    back = {c: i for i, c in enumerate(bytes_to_chars())}
    size_a = lambda i: bytes(back[c] for c in a.id_to_token(i))
    size_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    done, counts = [], Counter()
    for text in texts:
        if not text:
            done.append(None)
            continue
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        if b"".join(map(size_a, x)) != (" " + text).encode() or b"".join(map(size_b, y)) != (" " + text).encode():
            done.append(None)
            continue
        groups, own, i, j, at_a, at_b, first, second = [], [], 0, 0, 0, 0, [], []
        while i < len(x) or j < len(y):
            if j == len(y) or i < len(x) and at_a <= at_b:
                at_a += len(size_a(x[i]))
                first.append(x[i])
                i += 1
            else:
                at_b += len(size_b(y[j]))
                second.append(y[j])
                j += 1
            if at_a == at_b:
                groups.append(",".join(map(str, first)) + "|" + ",".join(map(str, second)))
                own.append((first[-1], second[-1]))
                first, second = [], []
        counts.update(own)
        done.append((len(x), len(y), groups, own))
    top = Counter()
    for (_, t), n in counts.items():
        top[t] = max(top[t], n)
    return [(0, 0, 0, 0, 0, 0, "") if d is None else (d[0], d[1], len(d[2]), len(d[3]), sum(counts[p] == top[p[1]] for p in d[3]), sum(counts[p] for p in d[3]), hashlib.sha256(";".join(d[2]).encode()).hexdigest()) for d in done]


def bytes_to_chars():
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b) if b in plain else chr(extra))
        extra += b not in plain
    return out


def rows_of(frame):
    return sorted(((r.doc_id is not None, r.doc_id or 0, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in frame.collect()))


def test_against_loops(spark):
    texts = [*TEXTS, *(r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").orderBy("doc_id").limit(60).collect())]
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, links string").repartition(5)
    want = sorted((True, i, *row) for i, row in enumerate(brute(texts)))
    assert rows_of(align.align_documents(frame, A, B)) == want
    assert rows_of(align.align_documents(frame, A, B, piece=200, size=37)) == want


def test_awkward_rows(spark):
    text = "one two three four " * 40
    frame = spark.createDataFrame([(None, text), (None, text), (3, text), (None, None)], "doc_id long, text string")
    for piece in (64, 1 << 20):
        got = rows_of(align.align_documents(frame, A, B, piece=piece, size=50))
        want = brute([text, text, text, None])
        assert [g[2:] for g in got] == [want[3], want[0], want[1], want[2]] and [g[0] for g in got] == [False, False, False, True]
    assert align.align_documents(frame.limit(0), A, B).count() == 0


def test_monoid():
    tok, r = align.tokens_of(A, B), random.Random(5)
    for text in ("the associative law holds for unhesitatingly long words 漢字 too", "a" * 90 + " z"):
        a, b = tok.encode([text])[0]
        end_a, end_b = np.cumsum(tok.size_a[a]), np.cumsum(tok.size_b[b])
        want = align.digest(align.fragment(a, end_a, b, end_b))
        for _ in range(60):
            edges = [0, *sorted(r.sample(range(1, int(end_a[-1])), r.randint(0, 9))), int(end_a[-1])]
            parts = []
            for low, high in zip(edges, edges[1:]):
                i, j, k, m = (int(np.searchsorted(e, x, "right")) for e in (end_a, end_b) for x in (low, high))
                parts.append(align.fragment(a[i:j], end_a[i:j], b[k:m], end_b[k:m]))
            while len(parts) > 1:
                k = r.randrange(len(parts) - 1)
                parts[k : k + 2] = [align.compose(parts[k], parts[k + 1])]
            assert align.digest(parts[0]) == want and not parts[0].suffix_a
            assert align.compose(parts[0], align.Fragment()) == parts[0] == align.compose(align.Fragment(), parts[0])


@pytest.mark.parametrize("text", ["ab cd ef gh", "no-cut", "It's a test; isn't it? Yes it is"])
def test_pieces(text):
    tok = align.tokens_of(A, B)
    whole = tok.encode([text])[0]
    parts = [tok.encode([p])[0] for p in align.pieces(text, 2)]
    assert "".join(" " + p for p in align.pieces(text, 2)) == " " + text
    assert ([i for p in parts for i in p[0]], [i for p in parts for i in p[1]]) == whole


def test_bound():
    tok = align.tokens_of(A, B)
    assert 100_000 < tok.most_links() < 2_000_000
