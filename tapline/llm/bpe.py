"""BPE encoding and decoding with a minimal acyclic transducer lexicon.

Spark counts the white-space chunks of all documents. The most frequent pre-tokens are encoded once and
compiled into a minimal (shared-suffix) acyclic automaton whose arcs carry numeric outputs: the sum of the
outputs on a word's path is the word's row in a table of id sequences. The automaton is one flat file that
Spark ships to the executors, where workers memory-map it. Words that it lacks are merged exactly, by rank.

Ids, and the text decoded from them, equal those of the tokenizers library for a byte-level BPE file
without normaliser and with special tokens recognised in the text.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import tempfile
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

#: The pre-tokenisation pattern of byte-level BPE: a fixed value of the public vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words that the lexicon holds at most; the rest is merged when met.
LEXICON_WORDS = 50_000
#: Occurrences from which a chunk can count as frequent.
FEWEST = 4
#: Entries of a worker's memo before it is emptied.
MEMO_WORDS = 250_000
#: Bytes from which on a word is merged by itself, with a heap; words that are merged side by side.
LONG_WORD, SIDE_BY_SIDE = 96, 16_384
#: The table of pairs has 2 to this many slots.
SLOT_BITS = 18
#: Characters of texts that are encoded together.
BATCH_CHARS = 1 << 22


def byte_of_char() -> dict[str, int]:
    """The byte that each printable stand-in character of byte-level BPE means."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocabulary:
    """Merges, token bytes and special tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["normalizer"] or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("only byte-level BPE without normaliser and prefix space is supported")
        back = byte_of_char()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token_bytes = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.token_size = np.fromiter(map(len, self.token_bytes), np.int64, size)
        self.token_start = np.cumsum(self.token_size) - self.token_size
        self.token_data = np.frombuffer(b"".join(self.token_bytes), np.uint8)
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, (a, b) in enumerate(pairs):
            self.ranks[vocab[a] << 32 | vocab[b]] = rank
            self.merged.append(vocab[a + b])
        self.merged_ids = np.array(self.merged, np.int32)
        self.slot_key, self.slot_rank = np.full(1 << SLOT_BITS, -(2**63), np.int64), np.zeros(1 << SLOT_BITS, np.int32)
        if 2 * len(self.ranks) > len(self.slot_key):
            raise ValueError("too many merges for the table of pairs")
        pairs = np.fromiter(self.ranks, np.int64, len(self.ranks))
        for slot, pair, rank in zip(self._slots(pairs).tolist(), self.ranks, self.ranks.values()):
            while self.slot_key[slot] >= 0:
                slot = (slot + 1) % len(self.slot_key)
            self.slot_key[slot], self.slot_rank[slot] = pair, rank
        self.byte_id = [0] * 256
        for c, b in back.items():
            self.byte_id[b] = vocab[c]
        self.words = regex.compile(PATTERN)
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")

    def merge(self, word: bytes) -> list[int]:
        """The ids of one pre-token: always the adjacent pair of lowest rank, leftmost first, is merged."""
        return np.frombuffer(self.merge_many([word])[0], "<u4").tolist()

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """The ids of many pre-tokens, as little-endian integers: words of like length are merged side by side."""
        out: list[bytes] = [b""] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        at = 0
        while at < len(order):
            width = len(words[order[at]])
            if width > LONG_WORD:
                out[order[at]] = np.array(self._merge_long([self.byte_id[b] for b in words[order[at]]]), "<u4").tobytes()
                at += 1
                continue
            end = at
            while end < len(order) and end - at < SIDE_BY_SIDE and len(words[order[end]]) <= width + width // 4:
                end += 1
            self._merge_block(words, order[at:end], out)
            at = end
        return out

    def _ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, by open addressing; without one: the number of merges. Negative ids have none."""
        key = a.astype(np.int64) << 32 | b.astype(np.int64) & 0xFFFFFFFF
        slot = self._slots(key)
        found = self.slot_key[slot]
        rank = self.slot_rank[slot]
        other = np.flatnonzero((found != key) & (found >= 0))
        rank[found != key] = len(self.merged)
        while len(other):
            slot[other] = (slot[other] + 1) % len(self.slot_key)
            found = self.slot_key[slot[other]]
            hit = found == key[other]
            rank[other[hit]] = self.slot_rank[slot[other[hit]]]
            other = other[~hit & (found >= 0)]
        return rank

    def _slots(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def _merge_block(self, words: list[bytes], rows: list[int], out: list[bytes]) -> None:
        """One row a word: each round merges every row's best pair; rows without one are done."""
        none = len(self.merged)
        size = np.fromiter((len(words[i]) for i in rows), np.int64, len(rows))
        width = int(size.max(initial=0))
        inside = np.arange(width) < size[:, None]
        ids = np.full((len(rows), width), -1, np.int32)
        ids[inside] = np.array(self.byte_id, np.int32)[np.frombuffer(b"".join(words[i] for i in rows), np.uint8)]
        rank = np.full((len(rows), max(1, width)), none, np.int32)  # of the pair that begins here
        if width > 1:
            rank[:, : width - 1] = self._ranks_of(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(rows), width - 1)
        where = np.array(rows)
        while len(where):
            best = rank.argmin(1)
            line = np.arange(len(where))
            low = rank[line, best]
            over = low == none
            if over.any():
                done, n = ids[over], size[over]
                flat = done[np.arange(done.shape[1]) < n[:, None]].astype("<u4").tobytes()
                ends = np.append(0, np.cumsum(4 * n)).tolist()
                for i, a, b in zip(where[over].tolist(), ends, ends[1:]):
                    out[i] = flat[a:b]
                left = ~over
                ids, rank, size, where, best, low = ids[left], rank[left], size[left], where[left], best[left], low[left]
                line = line[: len(where)]
                if not len(where):
                    break
            after = np.arange(ids.shape[1] - 1) > best[:, None]
            np.copyto(ids[:, :-1], ids[:, 1:].copy(), where=after)
            np.copyto(rank[:, :-1], rank[:, 1:].copy(), where=after)
            size -= 1
            ids[line, size] = -1
            rank[line, size] = none
            new = self.merged_ids[low]
            ids[line, best] = new
            following = np.where(best + 1 < size, ids[line, np.minimum(best + 1, ids.shape[1] - 1)], -1)
            rank[line, best] = self._ranks_of(new, following)
            earlier = np.flatnonzero(best > 0)
            rank[earlier, best[earlier] - 1] = self._ranks_of(ids[earlier, best[earlier] - 1], new[earlier])

    def _merge_long(self, ids: list[int]) -> list[int]:
        from heapq import heapify, heappop, heappush

        n = len(ids)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := self.ranks.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapify(heap)
        while heap:
            rank, i, a, b = heappop(heap)
            j = right[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = self.merged[rank], -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for p, q in ((left[i], i), (i, right[i])):
                if p >= 0 and q >= 0 and (m := self.ranks.get(ids[p] << 32 | ids[q])) is not None:
                    heappush(heap, (m, p, ids[p], ids[q]))
        return [x for x in ids if x >= 0]


def compile_lexicon(entries: dict[bytes, list[int]]) -> dict[str, np.ndarray]:
    """A minimal acyclic transducer of `entries`, built from sorted words, as flat arrays.

    States that accept the same suffixes with the same arcs are one state. An arc's output is how many words
    sort before those that go through it, counted from its state, so outputs along a path add up to the word's
    rank, and the rank addresses its ids.
    """
    words = sorted(entries)
    register: dict[tuple, int] = {}
    arcs: list[tuple] = []
    counts: list[int] = []
    finals: list[bool] = []

    def settle(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(arcs)
            arcs.append(key[1])
            finals.append(node[0])
            counts.append(int(node[0]) + sum(counts[t] for _, t in key[1]))
        return register[key]

    path: list[list] = [[False, []]]  # the open states of the last word: final, settled arcs
    last = b""
    for word in words:
        common = len(os.path.commonprefix([last, word]))
        while len(path) > common + 1:
            node = path.pop()
            path[-1][1].append((last[len(path) - 1], settle(node)))
        path += [[False, []] for _ in word[common:]]
        path[-1][0] = True
        last = word
    while len(path) > 1:
        node = path.pop()
        path[-1][1].append((last[len(path) - 1], settle(node)))
    root = settle(path[0])
    if len(arcs) >> 24:
        raise ValueError("a lexicon has fewer than 2^24 states")
    outputs = []
    for state, own in enumerate(arcs):
        before = int(finals[state])
        for _, target in own:
            outputs.append(before)
            before += counts[target]
    ids = [entries[w] for w in words]
    return {
        "root": np.array([root], "<u4"),
        "arc": np.array([state << 8 | a for state, own in enumerate(arcs) for a, _ in own], "<u4"),
        "target": np.array([t for own in arcs for _, t in own], "<u4"),
        "output": np.array(outputs, "<u4"),
        "final": np.array(finals, "<u4"),
        "offset": np.cumsum([0, *map(len, ids)]).astype("<u4"),
        "ids": np.array([i for own in ids for i in own], "<u4"),
    }


_PARTS = ("root", "arc", "target", "output", "final", "offset", "ids")


def write_lexicon(parts: dict[str, np.ndarray], path: str) -> None:
    """One flat file of unsigned 32-bit integers: the lengths of the parts, then the parts."""
    np.concatenate([np.array([len(parts[k]) for k in _PARTS], "<u4"), *(parts[k] for k in _PARTS)]).tofile(path)


class Lexicon:
    """A memory-mapped transducer."""

    def __init__(self, path: str):
        whole = np.memmap(path, "<u4", "r")
        ends = len(_PARTS) + np.cumsum([0, *whole[: len(_PARTS)]])
        view = {k: np.asarray(whole[int(a) : int(b)]) for k, a, b in zip(_PARTS, ends, ends[1:])}
        self.root, self.view = int(view["root"][0]), view

    def find(self, word: bytes) -> bytes | None:
        """The word's ids as little-endian integers, or None if the lexicon lacks it."""
        return self.find_many([word])[0]

    def find_many(self, words: list[bytes]) -> list[bytes | None]:
        """The same of many words, which walk through the automaton side by side, the longest first."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-size, kind="stable")
        text, size = np.frombuffer(b"".join(words), np.uint8), size[order]
        start = (np.cumsum(size[np.argsort(order)]) - size[np.argsort(order)])[order]
        arc, target, output = self.view["arc"], self.view["target"], self.view["output"]
        state, rank, alive = np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64), np.arange(len(words))
        ended = []
        depth = 0
        while len(alive):
            more = int(np.searchsorted(-size[alive], -depth, "left"))  # those after it end here
            ended.append(alive[more:])
            alive = alive[:more]
            if not len(arc):
                break
            key = (state[alive] << 8 | text[start[alive] + depth]).astype(np.uint32)
            at = np.minimum(np.searchsorted(arc, key), len(arc) - 1)
            there = arc[at] == key
            alive, at = alive[there], at[there]
            rank[alive] += output[at]
            state[alive] = target[at]
            depth += 1
        found: list[bytes | None] = [None] * len(words)
        ended = np.concatenate(ended) if ended else np.zeros(0, np.int64)
        ended = ended[self.view["final"][state[ended]] > 0]
        offset, ids = self.view["offset"], self.view["ids"].data.cast("B")
        for i, a, b in zip(order[ended].tolist(), offset[rank[ended]].tolist(), offset[rank[ended] + 1].tolist()):
            found[i] = bytes(ids[4 * a : 4 * b])
        return found


#: A key without other white space in it.
_CLEAN = re.compile(r"[\n ]\S+").fullmatch


class Encoder:
    """Texts to ids, a batch at a time: what the memo lacks is looked up and merged side by side.

    A key is what a text has from one single space or line break to the next, with that character; pre-tokens never
    reach across it. Texts in which other white space or more of it touches take the pattern as a whole.
    """

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None = None):
        self.v, self.lexicon = vocabulary, lexicon
        self.pieces: dict[str, bytes] = {}
        self.keys: dict[str, bytes | None] = {}
        self.line_break = len(self.vocabulary_ids("\n"))

    def vocabulary_ids(self, piece: str) -> bytes:
        self._learn_pieces([piece])
        return self.pieces[piece]

    def _learn_pieces(self, pieces) -> None:
        new = list(set(pieces).difference(self.pieces))
        raw = [p.encode("utf-8", "surrogatepass") for p in new]
        found = self.lexicon.find_many(raw) if self.lexicon else [None] * len(new)
        rest = [i for i, f in enumerate(found) if f is None]
        for i, ids in zip(rest, self.v.merge_many([raw[i] for i in rest])):
            found[i] = ids
        self.pieces.update(zip(new, found))

    def _learn_keys(self, keys: set[str]) -> None:
        """Memo entries of keys; None where other white space touches."""
        new = list(keys.difference(self.keys))
        clean = list(filter(_CLEAN, new))
        self.keys.update(dict.fromkeys(set(new).difference(clean)) if len(clean) < len(new) else {})
        pieces = self.v.words.findall("".join(clean))
        self._learn_pieces(pieces)
        ids, starts = list(map(self.pieces.__getitem__, pieces)), [i for i, p in enumerate(pieces) if p[0] == " " or p == "\n"]
        self.keys.update(zip(clean, [ids[a] if b - a == 1 else b"".join(ids[a:b]) for a, b in zip(starts, [*starts[1:], len(ids)])]))

    @staticmethod
    def _keys_of(text: str) -> list[str]:
        """The text's keys; the first has a line break that isn't in the text."""
        return ("\n" + text).replace("\n", "\0\n").replace(" ", "\0 ").split("\0")[1:] if "\0" not in text else [" "]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        if len(self.keys) + len(self.pieces) > MEMO_WORDS:
            self.keys.clear()
            self.pieces.clear()
        plain: list[str] = []
        parts: list[list[int | bytes]] = []
        special = self.v.special
        for text in texts:
            row: list[int | bytes] = []
            for part in self.v.splitter.split(text) if any(s in text for s in special) else [text]:
                if part in special:
                    row.append(np.array([special[part]], "<u4").tobytes())
                elif part:
                    row.append(len(plain))
                    plain.append(part)
            parts.append(row)
        split = list(map(self._keys_of, plain))
        self._learn_keys(set().union(*split))
        made: list[bytes] = []
        for text, keys in zip(plain, split):
            try:
                made.append(b"".join(map(self.keys.__getitem__, keys))[self.line_break :])
            except TypeError:
                pieces = self.v.words.findall(text)
                self._learn_pieces(pieces)
                made.append(b"".join(map(self.pieces.__getitem__, pieces)))
        return [b"".join(x if isinstance(x, bytes) else made[x] for x in row) for row in parts]

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def decode_many(self, ids: list[bytes]) -> list[str]:
        """The texts of many id sequences: their tokens' bytes are gathered together."""
        tokens = np.frombuffer(b"".join(ids), "<u4").astype(np.int64)
        size = self.v.token_size[tokens]
        ends = np.append(0, np.cumsum(size))
        data = self.v.token_data[np.arange(ends[-1]) + np.repeat(self.v.token_start[tokens] - ends[:-1], size)].tobytes()
        cuts = ends[np.cumsum([0, *(len(i) // 4 for i in ids)])].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])]

    def decode(self, ids: bytes) -> str:
        return self.decode_many([ids])[0]


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def worker_encoder(vocabulary_path: str, lexicon_name: str) -> Encoder:
    """The worker's encoder: tasks that follow each other in one worker share it and its memo."""
    key = (vocabulary_path, lexicon_name)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(Vocabulary(vocabulary_path), Lexicon(SparkFiles.get(lexicon_name)))
    return _ENCODERS[key]


def frequent_chunks(docs: DataFrame, limit: int = LEXICON_WORDS) -> list[str]:
    """The most frequent white-space chunks of all documents, `limit` at most; equally frequent ones go together."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def emit() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(seen.values(), pa.int64())], ["chunk", "n"])
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                seen.update(x for x in (text.as_py() or "").split() if len(x) <= 64)
                if len(seen) > 200_000:
                    yield emit()
        yield emit()

    counted = docs.select("text").mapInArrow(count, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"))
    repeated = cut(counted.filter(F.col("n") >= FEWEST))
    held, floor = 0, None  # chunks are taken by whole classes of equal counts, so no more than `limit` reach the driver
    for n, chunks in sorted(((r.n, r.chunks) for r in repeated.groupBy("n").agg(F.count("*").alias("chunks")).collect()), reverse=True):
        if held + chunks > limit:
            break
        held, floor = held + chunks, n
    return sorted(r.chunk for r in repeated.filter(F.col("n") >= floor).select("chunk").collect()) if held else []


def build_lexicon(docs: DataFrame, vocabulary_path: str, limit: int = LEXICON_WORDS) -> str:
    """Compile the corpus' frequent words and ship the file to the executors; returns its SparkFiles name."""
    vocabulary = Vocabulary(vocabulary_path)
    words = {p for c in frequent_chunks(docs, limit) for p in vocabulary.words.findall(" " + c)}
    raw = sorted(w.encode("utf-8", "surrogatepass") for w in words | {"\n"})
    entries = {w: np.frombuffer(ids, "<u4").tolist() for w, ids in zip(raw, vocabulary.merge_many(raw))}
    folder = tempfile.mkdtemp(prefix="tapline-lexicon-")
    path = os.path.join(folder, f"{os.path.basename(folder)}.bin")
    write_lexicon(compile_lexicon(entries), path)
    docs.sparkSession.sparkContext.addFile(path)
    return os.path.basename(path)


def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], list[str]]]:
    """Ids and texts (null as empty) of about BATCH_CHARS characters at a time."""
    for batch in batches:
        ids, texts, chars = [], [], 0
        for doc_id, text in zip(batch.column(0), batch.column(1)):
            ids.append(doc_id.as_py())
            texts.append(text.as_py() or "")
            chars += len(texts[-1])
            if chars >= BATCH_CHARS:
                yield ids, texts
                ids, texts, chars = [], [], 0
        if ids:
            yield ids, texts


def encode_documents(docs: DataFrame, vocabulary_path: str, limit: int = LEXICON_WORDS, with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """One row per row of `docs`: doc_id, n_tokens, ids_sha256, decoded_sha256, and on request ids and decoded.

    Null text counts as empty: no tokens, and the digests of nothing. Repeated rows give repeated results; other
    columns of `docs` are ignored, an empty table gives an empty result. A text of any length is encoded whole.
    """
    name = build_lexicon(docs, vocabulary_path, limit)
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    fields += [("ids", pa.list_(pa.int32()))] * with_ids + [("decoded", pa.string())] * with_text
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(vocabulary_path, name)
        for doc_ids, texts in parts_of(batches):
            rows = []
            encoded = encoder.encode_many(texts)
            for doc_id, ids, decoded in zip(doc_ids, encoded, encoder.decode_many(encoded)):
                row = (doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
                row += (np.frombuffer(ids, "<u4").astype(np.int32),) * with_ids + (decoded,) * with_text
                rows.append(row)
            columns = list(zip(*rows)) if rows else [()] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], schema=schema)

    kinds = {pa.int64(): "long", pa.string(): "string", pa.list_(pa.int32()): "array<int>"}
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ", ".join(f"{n} {kinds[t]}" for n, t in fields))
