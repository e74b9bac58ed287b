"""Language-model scoring: Katz backoff from bigrams to words, with Good-Turing discounts.

Counts live in tables: words with n, bigrams with n (in buckets of the second word), contexts with the mass that their
discounts leave and the share of words that follow them. A token is scored from the bigram table if its bigram is
there, and else by its context's weight times the word's own probability; words that no training text has share what
the words' discounts leave. Weights are exact: the probabilities of all words after any context sum to one.

Bigrams are counted and looked up in one exchange. Tasks cut their texts into chunks, and send each bucket of words
the chunk's occurrences as packed arrays; a bucket's task sorts them, sums for each context how many of its bigrams
occur how often, and for each document what the bucket knows of it. What it can't know, the weights of contexts, is
joined to the tokens that back off. The bigram table itself is made from the same buckets when it is read: scores need
no more than those sums, which take less room. Words so frequent that one bucket couldn't hold them are spread by context; there are at most HOT a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, mix64, release, word_hashes

#: Counts up to this are discounted by Good and Turing's estimate, larger ones by a part of one occurrence.
SMALL, LESS = 5, 0.5
#: Tokens that a task packs at a time, tokens of a bucket, and hot words a bucket at most. A bucket gets on average
#: CHUNK_TOKENS * BUCKET_TOKENS / N tokens of a chunk: for very large N, both should grow with its root.
CHUNK_TOKENS, BUCKET_TOKENS, HOT = 1_750_000, 4_000_000, 4
#: Bytes of text that are hashed together, rows of text that are taken from Arrow at a time, and rows and bytes of a
#: batch that a task hands back: Python and the JVM hold a few batches at once.
HASHED_BYTES, TAKEN, BATCH_ROWS, BATCH_BYTES = 1 << 19, 512, 1 << 16, 4 << 20
#: What stands before and after every text.
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)


@dataclass(frozen=True)
class Discounts:
    """What remains of a count: `small[r - 1]` of r up to SMALL, r - LESS of larger ones."""

    small: tuple[float, ...]

    @classmethod
    def of(cls, having: list[int]) -> Discounts:
        """From how many different n-grams occur 1, 2, ... SMALL + 1 times. An estimate that isn't below r is replaced."""
        guess = [(r + 1) * having[r] / having[r - 1] if having[r - 1] else 0.0 for r in range(1, SMALL + 1)]
        return cls(tuple(g if 0 < g < r else r - LESS for r, g in enumerate(guess, 1)))

    def left(self, n: Column) -> Column:
        """The remaining count as a Column."""
        small = F.element_at(F.array(*map(F.lit, self.small)), F.least(n, F.lit(SMALL)).cast("int"))
        return F.when(n <= SMALL, small).otherwise(n - LESS)

    def kept(self, n: np.ndarray) -> np.ndarray:
        """The remaining counts; 0 of 0."""
        return np.where(n <= SMALL, np.array((0.0, *self.small))[np.minimum(n, SMALL)], n - LESS)


@dataclass(frozen=True)
class Words:
    """The word level: tokens N, different words V, its discounts, and the probability of a word that wasn't seen."""

    tokens: int
    words: int
    discounts: Discounts
    unseen: float

    def probability(self, n: np.ndarray) -> np.ndarray:
        return np.where(n > 0, self.discounts.kept(n) / max(self.tokens, 1), self.unseen)


@dataclass(frozen=True)
class Katz:
    """The model's tables, and what its evaluation gives for each text (by key)."""

    level: Words
    second: Discounts
    texts: int
    words: DataFrame
    grams: DataFrame
    contexts: DataFrame
    scores: DataFrame


def _hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, words and ends, A-Z in lower case, and how many tokens each text has."""
    parts, counts, begin, held = [], [], 0, 0
    for k, text in enumerate([*texts, None]):
        if text is None or held and held + len(text) > HASHED_BYTES:
            words, n = word_hashes([t.lower() for t in texts[begin:k]])
            out = np.full(len(words) + len(n), END, np.uint64)
            keep = np.ones(len(out), bool)
            keep[np.cumsum(n + 1) - 1] = False
            out[keep] = words
            parts.append(out)
            counts.append(n + 1)
            begin, held = k, 0
        held += len(text or b"")
    return np.concatenate(parts), np.concatenate(counts)


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Token hashes, token counts, keys and learns flags of rows (key, learns, text), about `size` tokens at a time."""
    keys, learns, texts, held = [], [], [], 0
    for part in (batch.slice(at, TAKEN) for batch in batches for at in range(0, batch.num_rows, TAKEN)):
        for key, flag, text in zip(*(c.to_pylist() for c in part.columns)):
            keys.append(key)
            learns.append(flag)
            texts.append(b"" if text is None else text.encode("utf-8", "surrogatepass"))
            held += len(texts[-1]) // 6 + 1
            if held >= size:
                yield *_hashed(texts), np.array(keys, np.int64), np.array(learns, bool)
                keys, learns, texts, held = [], [], [], 0
    if keys:
        yield *_hashed(texts), np.array(keys, np.int64), np.array(learns, bool)


def _word_counts(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, counts, _, learns in _chunks(batches, size):
            words, n = np.unique(tokens[np.repeat(learns, counts)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], names=["word", "n"])

    return run


CELL = "bucket long, word binary, word_n binary, context binary, context_at binary, text binary, text_at binary, learns binary"
CELL_NAMES = [c.split(" ")[0] for c in CELL.split(", ")]


def _cells(size: int, buckets: int, hot: np.ndarray):
    """What each chunk sends to each bucket: its occurrences in order of word and context, in arrays of small numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, counts, keys, learns in _chunks(batches, size):
            names, word = np.unique(tokens, return_inverse=True)
            del tokens
            names, word = np.append(names, START), word.astype(np.int32)
            context = np.concatenate((word[-1:], word[:-1]))
            context[np.cumsum(counts) - counts] = len(names) - 1
            text = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
            place = mix64(names)
            bucket = (place % np.uint64(buckets)).astype(np.int32)[word]
            spread = np.flatnonzero(np.isin(names, hot)[word])
            bucket[spread] = mix64(place[word[spread]] * np.uint64(3) + names[context[spread]]) % np.uint64(buckets)
            order = np.lexsort((word.astype(np.int64) << 32 | context, bucket)).astype(np.int32)
            edges = np.cumsum(np.concatenate(([0], np.bincount(bucket, minlength=buckets))))
            del bucket, spread
            rows, held = [], 0
            for b in np.flatnonzero(np.diff(edges)):
                own = order[edges[b] : edges[b + 1]]
                first = np.flatnonzero(np.diff(word[own], prepend=np.int32(-1)))
                contexts, context_at = np.unique(context[own], return_inverse=True)
                texts, text_at = np.unique(text[own], return_inverse=True)
                times = np.diff(first, append=len(own)).astype(np.uint32)
                rows.append((int(b), _steps(names[word[own][first]]), _packed(times), _steps(names[contexts]), _places(context_at), _packed(keys[texts]), _places(text_at), _packed(learns[texts])))
                held += sum(map(len, rows[-1][1:]))
                if held >= BATCH_BYTES or len(rows) >= 256:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=CELL_NAMES)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=CELL_NAMES)

    return run


def _packed(a: np.ndarray) -> bytes:
    """An array's bytes, all first ones, all second ones and so on, compressed."""
    return zstandard.compress(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes(), 1)


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(size, -1).T.tobytes(), kind)


def _steps(hashes: np.ndarray) -> bytes:
    """Hashes as differences, which wrap; of ascending ones the leading bytes are nearly all zero."""
    return _packed(np.diff(hashes, prepend=np.uint64(0)))


def _stepped(data: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(data, np.uint64), dtype=np.uint64)


def _places(at: np.ndarray) -> bytes:
    """Positions as differences, which wrap: of 16 bits if they fit (a leading 2), else of 32 (a leading 4)."""
    kind = np.uint16 if not len(at) or at.max() < 1 << 16 else np.uint32
    return bytes([np.dtype(kind).itemsize]) + _packed(np.diff(at.astype(kind), prepend=kind(0)))


def _placed(data: bytes) -> np.ndarray:
    kind = np.uint16 if data[0] == 2 else np.uint32
    return np.cumsum(_unpacked(data[1:], kind), dtype=kind)


#: What a bucket's task writes: bigrams (context, word, n, the word's own probability) if they are asked for, sums for
#: texts, tokens that back off (text, context), and sums for contexts: occurrences, different words after it, their own
#: probabilities, and how many of the bigrams occur 1, 2, ... SMALL + 1 times.
GRAM, TEXT, BACK, CONTEXT = 0, 1, 2, 3
MADE = pa.schema([("kind", pa.int8()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("known", pa.int64()), ("x", pa.float64()), ("y", pa.float64()), ("small", pa.list_(pa.int64()))])
MADE_SQL = "kind byte, a long, b long, n long, known long, x double, y double, small array<long>"


def _made(kind: int, size: int, **columns) -> pa.RecordBatch:
    arrays = [columns.get(f.name, pa.nulls(size, f.type)) for f in MADE]
    return pa.record_batch([pa.array(np.full(size, kind, np.int8)), *(a if isinstance(a, pa.Array) else pa.array(a, f.type) for a, f in zip(arrays[1:], list(MADE)[1:]))], schema=MADE)


def _pieces(at: np.ndarray) -> Iterator[np.ndarray]:
    """Positions, BATCH_ROWS at a time."""
    return (at[i : i + BATCH_ROWS] for i in range(0, len(at), BATCH_ROWS))


def _occurrences(cells: Iterator[pa.RecordBatch]):
    """A bucket's words and contexts, keys and learns flags of its texts, then of its occurrences in order of word and
    context the pair (numbers of word and context, 32 bits each) and the text's number."""
    names, times, contexts, context, keys, learns, text = ([] for _ in range(7))
    n_contexts = n_texts = 0
    for batch in cells:
        for _, word, word_n, seen, seen_at, own, own_at, flags in zip(*(c.to_pylist() for c in batch.columns)):
            names.append(_stepped(word))
            times.append(_unpacked(word_n, np.uint32))
            contexts.append(_stepped(seen))
            context.append(_placed(seen_at).astype(np.int32) + np.int32(n_contexts))
            keys.append(_unpacked(own, np.int64))
            learns.append(_unpacked(flags, bool))
            text.append(_placed(own_at).astype(np.int32) + np.int32(n_texts))
            n_contexts, n_texts = n_contexts + len(contexts[-1]), n_texts + len(keys[-1])
    words, at = np.unique(np.concatenate(names), return_inverse=True)
    pair = np.repeat(at << 32, np.concatenate(times))
    contexts, at = np.unique(np.concatenate(contexts), return_inverse=True)
    pair |= at[np.concatenate(context)]
    del names, times, context, at
    order = np.argsort(pair)
    pair = pair[order]
    text = np.concatenate(text)[order]
    return words, contexts, np.concatenate(keys), np.concatenate(learns), pair, text


def _lists(counts: np.ndarray) -> pa.ListArray:
    """The rows of an array as lists."""
    rows, width = counts.shape
    return pa.ListArray.from_arrays(np.arange(0, rows * width + 1, width, dtype=np.int32), pa.array(counts.ravel()))


def _bucket(level: Words, hot: dict[int, int], grams: bool = True):
    """Sums of a bucket, and with `grams` its bigrams. What holds for an occurrence holds for all of its bigram, and is spread to texts
    one measure after another: texts have a row for each chunk that they are in."""
    hot_words = np.array(sorted(hot), np.uint64)
    hot_n = np.array([hot[w] for w in sorted(hot)], np.int64)

    def run(cells: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, contexts, keys, learns, pair, text = _occurrences(cells)
        new = np.ones(len(pair), bool)
        new[1:] = pair[1:] != pair[:-1]
        first = np.flatnonzero(new)
        word, context = (pair[first] >> 32).astype(np.int32), pair[first].astype(np.int32)
        del pair, new
        size, n_gram = np.diff(first, append=len(text)), np.add.reduceat(learns[text], first, dtype=np.int64)
        of_word = np.bincount(word, n_gram, len(words)).astype(np.int64)
        is_hot = np.isin(words, hot_words)
        of_word[is_hot] = hot_n[np.searchsorted(hot_words, words[is_hot])]
        own = level.probability(of_word)
        for at in _pieces(np.flatnonzero(n_gram > 0) if grams else first[:0]):
            yield _made(GRAM, len(at), a=contexts[context[at]].view(np.int64), b=words[word[at]].view(np.int64), n=n_gram[at], x=own[word[at]])
        spread = lambda each: np.repeat(each, size)
        times = lambda of: np.bincount(context[of], minlength=len(contexts))
        n, follow = np.bincount(context, n_gram, len(contexts)).astype(np.int64), times(n_gram > 0)
        lower = np.bincount(context, np.where(n_gram > 0, own[word], 0.0), len(contexts))
        having = np.stack([times(n_gram == r) for r in range(1, SMALL + 2)], 1)
        for at in _pieces(np.flatnonzero(follow)):
            yield _made(CONTEXT, len(at), a=contexts[at].view(np.int64), n=n[at], known=follow[at], x=lower[at], small=_lists(having[at]))
        del n, follow, lower, having
        back = n_gram == 0
        of_back = np.repeat(context[back], size[back])
        for at, of in zip(_pieces(np.flatnonzero(spread(back))), _pieces(of_back)):
            yield _made(BACK, len(at), a=keys[text[at]], b=contexts[of].view(np.int64))
        del of_back
        rest = np.where(back, np.log10(own)[word], np.where(n_gram > SMALL, np.log10(np.maximum(n_gram - LESS, LESS)), 0.0))
        rest -= np.where((words != END) & (of_word > 0), np.log10(np.maximum(of_word, 1)), 0.0)[word]
        total = lambda each: np.bincount(text, spread(each), len(keys))
        n, known = np.bincount(text, minlength=len(keys)), total((of_word > 0)[word]).astype(np.int64)
        x, y = total(np.log10(of_word + 1.0)[word]), total(rest)
        small = np.stack([np.bincount(text[spread(n_gram == r)], minlength=len(keys)) for r in range(1, SMALL + 1)], 1)
        for at in _pieces(np.arange(len(keys))):
            yield _made(TEXT, len(at), a=keys[at], n=n[at], known=known[at], x=x[at], y=y[at], small=_lists(small[at]))

    return run


def _having(counts: DataFrame) -> list[int]:
    return list(counts.agg(*(F.count_if(F.col("n") == r) for r in range(1, SMALL + 2))).first())


def build(docs: DataFrame, learns: Column, chunk_tokens: int = CHUNK_TOKENS, bucket_tokens: int = BUCKET_TOKENS) -> Katz:
    """Count the texts of `docs` (doc_id, text) for which `learns` is true, and evaluate all of them.

    Words and contexts are written tables; grams is made from the texts when it is read.
    scores has, for each different key (a hash of doc_id and text): copies, n_tokens, n_known, base (the sum of
    log10(n + 1) of its words) and score. Several copies of a row count as often as they stand.
    """
    rows = docs.select(F.xxhash64("doc_id", "text").alias("key"), F.coalesce(learns, F.lit(False)).alias("learns"), F.col("text"))
    words = cut(rows.filter("learns").mapInArrow(_word_counts(chunk_tokens), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), keep=True)
    release(docs.sparkSession)
    tokens, different = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    first = Discounts.of(_having(words))
    kept = words.agg(F.sum(first.left(F.col("n")))).first()[0] or 0.0
    level = Words(tokens, different, first, 1 - kept / tokens if tokens else 1.0)
    buckets = max(1, tokens * 7 // (6 * bucket_tokens)) + 7
    hot = {r.word % (1 << 64): r.n for r in words.filter(F.col("n") > max(tokens // (HOT * buckets), 1)).collect()}
    cells = rows.mapInArrow(_cells(chunk_tokens, buckets, np.array(sorted(hot), np.uint64)), CELL)
    made = cut(cells.groupBy("bucket").applyInArrow(_bucket(level, hot, grams=False), MADE_SQL), keep=True)
    release(docs.sparkSession)
    grams = cells.groupBy("bucket").applyInArrow(_bucket(level, hot), MADE_SQL).filter(F.col("kind") == GRAM).select(F.col("a").alias("context"), F.col("b").alias("word"), "n", F.col("x").alias("lower"))
    sums = made.filter(F.col("kind") == CONTEXT)
    second = Discounts.of(list(sums.agg(*(F.coalesce(F.sum(F.col("small")[r]), F.lit(0)) for r in range(SMALL + 1))).first()))
    # what discounts take: of each bigram up to SMALL times its part, of each other one LESS
    each = [F.col("small")[r] for r in range(SMALL)]
    left = sum((c * F.lit(r - x) for r, (c, x) in enumerate(zip(each, second.small), 1)), (F.col("known") - sum(each, F.lit(0))) * F.lit(LESS))
    contexts = cut(sums.groupBy(F.col("a").alias("context")).agg(F.sum("n").alias("n"), F.sum(left).alias("left"), F.sum("x").alias("lower")), keep=True)
    release(docs.sparkSession)
    weight = F.log10(F.col("left") / F.greatest(1 - F.col("lower"), F.lit(level.unseen)))
    backed = made.filter(F.col("kind") == BACK).select(F.col("a").alias("key"), F.col("b").alias("context")).join(contexts.select("context", weight.alias("w")), "context", "left")
    backed = backed.groupBy("key").agg(F.sum(F.coalesce("w", F.lit(0.0))).alias("score"))
    seen = sum((F.col("small")[r] * float(np.log10(x)) for r, x in enumerate(second.small)), F.col("y"))
    sums = made.filter(F.col("kind") == TEXT).groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("n_tokens"), F.sum("known").alias("n_known"), F.sum("x").alias("base"), F.sum(seen).alias("score"))
    nothing = F.lit(0).cast("long")
    both = sums.unionByName(backed.select("key", nothing.alias("n_tokens"), nothing.alias("n_known"), F.lit(0.0).alias("base"), "score"))
    both = both.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")))
    copies = rows.groupBy("key").agg(F.count("*").alias("copies"), F.count_if("learns").alias("learning"))
    texts = rows.filter("learns").count()
    each = lambda c: (F.col(c) / F.col("copies")).alias(c)
    begins = float(np.log10(texts)) if texts else 0.0
    scores = copies.join(both, "key").select("key", "copies", each("n_tokens"), each("n_known"), each("base"), (F.col("score") / F.col("copies") - begins).alias("score"))
    return Katz(level, second, texts, words, grams, contexts, scores)


def score_documents(docs: DataFrame, parts: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of `docs` (doc_id, text).

    Rows whose crc32 of doc_id (null: empty text) modulo `parts` is `held` teach nothing. Null and empty texts are an
    end alone; repeated rows count and are returned as often as they stand; an empty table gives an empty result, and
    without training rows every token has probability one; other columns are ignored.
    """
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % parts == held
    model = build(docs, ~held_out)
    n, level = F.round("n_tokens").cast("long"), model.level
    base = F.col("base") - n * F.lit(float(np.log10(level.tokens + level.words + 1)))
    rows = docs.select(F.col("doc_id"), held_out.alias("held_out"), F.xxhash64("doc_id", "text").alias("key")).join(model.scores, "key")
    return rows.select("doc_id", "held_out", n.alias("n_tokens"), F.round("n_known").cast("long").alias("n_known"), F.lit(level.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
