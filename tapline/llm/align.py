"""Alignment of two tokenizers' tokens over the same bytes, by a monoid of fragments.

A byte range of a document gives a fragment: the tokens of both that end in it, as an open prefix (up to the first
offset where a token of each ends), closed groups, and an open suffix. Fragments compose: what one leaves open joins
what the next one has before its first common end. Composition is associative and the empty fragment is its unit, so a
very long document is cut into pieces, encoded by as many tasks, and its fragments meet in a tree of groupings.
Documents of usual size are one fragment each and never leave their task.

A link is a token of each that end together, so the shorter one's bytes end the longer one's. There are therefore no
more different links than the suffixes of all tokens, whatever the corpus: `Tokens.most_links` counts them, and the
table of corpus-wide counts that is broadcast never has more rows than that.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PATTERN, Vocabulary
from .common import cut

#: Bytes of text from which on a document is cut into pieces; bytes of one range of tokens; fragments composed at once.
PIECE_BYTES, RANGE_BYTES, FAN = 1 << 20, 1 << 17, 16
#: Characters of texts that are aligned together.
BATCH_CHARS = 1 << 21
#: A space between letters: neither tokenizer joins what stands on its two sides.
SAFE = regex.compile(r"(?<=[A-Za-zÀ-ÖØ-öø-ÿ]) (?=[A-Za-zÀ-ÖØ-öø-ÿ])")


class Tokens:
    """Both tokenizers: byte-level BPE (A) and a piece model (B), with the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        vocabulary = Vocabulary(path_a)
        special = set(vocabulary.special.values())
        ranks = {t: i for i, t in enumerate(vocabulary.token_bytes) if i not in special and t}
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_a = vocabulary.token_bytes
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.fromiter(map(len, t), np.int64, len(t)) for t in (self.bytes_a, self.bytes_b))
        #: No piece reaches over a space into the word before it, so a text may be cut before a space.
        self.divisible = not any("▁" in p.lstrip("▁") for p in pieces)
        names_a, names_b = ([b"%d" % i for i in range(len(t))] for t in (self.bytes_a, self.bytes_b))
        self.shown = [n + b"," for n in names_a] + [n + b"|" for n in names_a] + [n + b"," for n in names_b] + [n + b";" for n in names_b]

    def most_links(self) -> int:
        """Pairs of which one token's bytes end with the other's: no corpus has more different links."""
        of_a, of_b = defaultdict(int), defaultdict(int)
        for t in self.bytes_a:
            of_a[t] += 1
        for t in self.bytes_b:
            of_b[t] += 1
        return sum(of_b[t[k:]] for t in self.bytes_a for k in range(len(t)) if t[k:] in of_b) + sum(of_a[t[k:]] for t in self.bytes_b for k in range(1, len(t)) if t[k:] in of_a)

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]] | None]:
        """Ids of both for a space and each text; None where the bytes of either aren't those of the text."""
        out = []
        for text, b in zip(texts, self.b.encode(texts, num_threads=1), strict=True):
            text = " " + text
            a, data = self.a.encode_ordinary(text), text.encode("utf-8", "surrogatepass")
            same = b"".join(map(self.bytes_a.__getitem__, a)) == data == b"".join(map(self.bytes_b.__getitem__, b))
            out.append((a, b) if same else None)
        return out


@lru_cache(2)
def tokens_of(path_a: str, path_b: str) -> Tokens:
    """The tokenizers of two files, read once in a process."""
    return Tokens(path_a, path_b)


class Aligned(NamedTuple):
    """Groups of a run of texts, which end together: ids in the order of the digest, links, and counts for each text."""

    shown: np.ndarray
    links: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray


def align(tok: Tokens, ids: list[tuple[list[int], list[int]]]) -> Aligned:
    """Cut the tokens of all texts into groups at the offsets where both have an end; one pass over the batch."""
    n_a, n_b = (np.fromiter((len(x[k]) for x in ids), np.int64, len(ids)) for k in (0, 1))
    a, b = (np.fromiter((i for x in ids for i in x[k]), np.int64, n.sum()) for k, n in ((0, n_a), (1, n_b)))
    end_a, end_b = np.cumsum(tok.size_a[a]), np.cumsum(tok.size_b[b])
    both = np.intersect1d(end_a, end_b, assume_unique=True)
    group_a, group_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)
    last_a, last_b = np.searchsorted(end_a, both), np.searchsorted(end_b, both)
    show_a, show_b = a.copy(), b + 2 * len(tok.size_a)
    show_a[last_a] += len(tok.size_a)
    show_b[last_b] += len(tok.size_b)
    order = np.argsort(np.concatenate((2 * group_a, 2 * group_b + 1)), kind="stable")
    closed = np.searchsorted(last_a, np.cumsum(n_a))
    return Aligned(np.concatenate((show_a, show_b))[order], a[last_a] * len(tok.size_b) + b[last_b], n_a, n_b, np.diff(closed, prepend=0))


class Fragment(NamedTuple):
    """A byte range: ids of the open prefix and suffix of both, whether anything closes, and texts of closed groups.

    Without a common end all tokens are in the prefix. Closed texts are compressed, each group with its final ';'.
    """

    prefix_a: tuple = ()
    prefix_b: tuple = ()
    cut: bool = False
    closed: tuple = ()
    suffix_a: tuple = ()
    suffix_b: tuple = ()


def group_text(a, b) -> bytes:
    return b",".join(b"%d" % i for i in a) + b"|" + b",".join(b"%d" % i for i in b) + b";"


def compose(x: Fragment, y: Fragment) -> Fragment:
    """The fragment of both ranges, one after the other."""
    if not y.cut:
        if x.cut:
            return x._replace(suffix_a=x.suffix_a + y.prefix_a, suffix_b=x.suffix_b + y.prefix_b)
        return x._replace(prefix_a=x.prefix_a + y.prefix_a, prefix_b=x.prefix_b + y.prefix_b)
    if not x.cut:
        return y._replace(prefix_a=x.prefix_a + y.prefix_a, prefix_b=x.prefix_b + y.prefix_b)
    joint = zlib.compress(group_text(x.suffix_a + y.prefix_a, x.suffix_b + y.prefix_b), 1)
    return Fragment(x.prefix_a, x.prefix_b, True, x.closed + (joint,) + y.closed, y.suffix_a, y.suffix_b)


def fragment(a: list[int], end_a: np.ndarray, b: list[int], end_b: np.ndarray) -> Fragment:
    """The fragment of tokens with their ends, those of one byte range."""
    both = np.intersect1d(end_a, end_b, assume_unique=True)
    if not len(both):
        return Fragment(tuple(a), tuple(b))
    at_a, at_b = (np.searchsorted(e, both) + 1 for e in (end_a, end_b))
    texts = [group_text(a[i:j], b[k:m]) for i, j, k, m in zip(at_a, at_a[1:], at_b, at_b[1:])]
    closed = (zlib.compress(b"".join(texts), 1),) if texts else ()
    return Fragment(tuple(a[: at_a[0]]), tuple(b[: at_b[0]]), True, closed, tuple(a[at_a[-1] :]), tuple(b[at_b[-1] :]))


def digest(whole: Fragment) -> str:
    """The digest of a whole document's groups: its prefix closes as a group, and nothing is left open."""
    sha, held = hashlib.sha256(), group_text(whole.prefix_a, whole.prefix_b)
    for part in whole.closed:
        sha.update(held)
        held = zlib.decompress(part)
    sha.update(held[:-1])
    return sha.hexdigest()


def pieces(text: str, size: int, divisible: bool = True) -> Iterator[str]:
    """Texts x, such that a space and each of them in a row are a space and `text`, cut where no token reaches over."""
    begin = 0
    while divisible and (found := SAFE.search(text, begin + size)):
        yield text[begin : found.start()]
        begin = found.start() + 1
    yield text[begin:]


def _ranges(tok: Tokens, start: int, a: list[int], b: list[int], size: int) -> Iterator[tuple[int, Fragment]]:
    """Fragments of the byte ranges of a piece that begins at offset `start`, each with the offset at which it begins."""
    end_a, end_b = start + np.cumsum(tok.size_a[a]), start + np.cumsum(tok.size_b[b])
    edges = [start, *range((start // size + 1) * size, int(end_a[-1]), size), int(end_a[-1])]
    for low, high in zip(edges, edges[1:]):
        i, j, k, m = (int(np.searchsorted(e, x, "right")) for e in (end_a, end_b) for x in (low, high))
        yield low, fragment(a[i:j], end_a[i:j], b[k:m], end_b[k:m])


def _counted(links: np.ndarray, n: np.ndarray) -> list[tuple[bytes, bytes]]:
    """The different links of each text and how often it has them, as packed integers."""
    owner = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((links, owner))
    links, owner = links[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], (np.diff(links) != 0) | (np.diff(owner) != 0)))) if len(links) else np.zeros(0, np.int64)
    times, bounds = np.diff(np.append(first, len(links))), np.searchsorted(owner[first], np.arange(len(n) + 1))
    links, times = links[first].astype(np.uint32), times.astype(np.uint32)
    return [(links[i:j].tobytes(), times[i:j].tobytes()) for i, j in zip(bounds, bounds[1:])]


WHOLE = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary, times binary"
PART = "key long, doc_id long, copies long, start long, n_a long, n_b long, n_groups long, whole boolean, prefix_a array<int>, prefix_b array<int>, cut boolean, closed array<binary>, suffix_a array<int>, suffix_b array<int>, links binary, times binary"


def _arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


WHOLE_ARROW = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string()), ("links", pa.binary()), ("times", pa.binary())])


def _usual(paths: tuple[str, str]):
    """Texts of usual size, each aligned in one go with others of its batch."""

    def rows(tok: Tokens, ids: list, texts: list) -> pa.RecordBatch:
        encoded = tok.encode([t or "" for t in texts])
        good = [i for i, (t, x) in enumerate(zip(texts, encoded)) if t and x]
        out = [(i, 0, 0, 0, "", b"", b"") for i in ids]
        if good:
            made = align(tok, [encoded[i] for i in good])
            counted, at = _counted(made.links, made.n_groups), 0
            for i, n_a, n_b, n, (links, times) in zip(good, made.n_a.tolist(), made.n_b.tolist(), made.n_groups.tolist(), counted):
                shown = b"".join(map(tok.shown.__getitem__, made.shown[at : at + n_a + n_b].tolist()))
                at += n_a + n_b
                out[i] = (ids[i], n_a, n_b, n, hashlib.sha256(shown[:-1]).hexdigest(), links, times)
        return _arrow(out, WHOLE_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, ids, texts, held = tokens_of(*paths), [], [], 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(i)
                texts.append(text)
                held += len(text or "")
                if held >= BATCH_CHARS:
                    yield rows(tok, ids, texts)
                    ids, texts, held = [], [], 0
        if ids:
            yield rows(tok, ids, texts)

    return run


def _cut_up(paths: tuple[str, str], size: int):
    """Pieces of long texts with the byte offset at which each begins; offset 0 is the space before the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        divisible = tokens_of(*paths).divisible
        for batch in batches:
            for key, doc_id, copies, text in zip(*(c.to_pylist() for c in batch.columns)):
                start = 0
                for piece in pieces(text, size, divisible):
                    yield pa.RecordBatch.from_pydict({"key": pa.array([key], pa.int64()), "doc_id": pa.array([doc_id], pa.int64()), "copies": pa.array([copies], pa.int64()), "start": pa.array([start], pa.int64()), "piece": [piece]})
                    start += 1 + len(piece.encode("utf-8", "surrogatepass"))

    return run


def _encoded(paths: tuple[str, str], size: int):
    """The fragments of pieces. Links are counted here, with the token pair that ends each group."""
    import pandas as pd

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = tokens_of(*paths)
        for frame in frames:
            for key, doc_id, copies, start, piece in frame.itertuples(index=False, name=None):
                ids, out = tok.encode([piece])[0], []
                if ids is None:
                    out.append((key, doc_id, copies, start, 0, 0, 0, False, *Fragment(), b"", b""))
                else:
                    made = align(tok, [ids])
                    links, times = _counted(made.links, made.n_groups)[0]
                    for k, (low, part) in enumerate(_ranges(tok, start, *ids, size)):
                        n = (len(ids[0]), len(ids[1]), int(made.n_groups[0])) if k == 0 else (0, 0, 0)
                        out.append((key, doc_id, copies, low, *n, True, *part, links if k == 0 else b"", times if k == 0 else b""))
                yield _frame(out)

    return run


def _frame(rows: list[tuple]):
    import pandas as pd

    out = pd.DataFrame(rows, columns=[c.split(" ")[0] for c in PART.split(", ")])
    return out.astype({"doc_id": "Int64"})


def merged(links: list[bytes], times: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Different links of several packed lists, in order, and their sums."""
    found, where = np.unique(np.frombuffer(b"".join(links), np.uint32), return_inverse=True)
    return found, np.bincount(where, np.frombuffer(b"".join(times), np.uint32), len(found)).astype(np.int64)


def _composed(rows):
    """One fragment of those in a branch of a document's tree."""
    rows, whole = rows.sort_values("start"), Fragment()
    for x in rows[list(Fragment._fields)].itertuples(index=False, name=None):
        whole = compose(whole, Fragment(tuple(x[0]), tuple(x[1]), bool(x[2]), tuple(x[3]), tuple(x[4]), tuple(x[5])))
    links, times = merged(list(rows["links"]), list(rows["times"]))
    first, doc_id = rows.iloc[0], rows["doc_id"].iloc[0]
    return _frame([(first["key"], None if doc_id != doc_id or doc_id is None else doc_id, first["copies"], first["start"], rows["n_a"].sum(), rows["n_b"].sum(), rows["n_groups"].sum(), rows["whole"].all(), *whole, links.tobytes(), times.astype(np.uint32).tobytes())])


def _long(docs: DataFrame, paths: tuple[str, str], piece: int, size: int) -> DataFrame:
    """Documents beyond a piece: their pieces are dealt over tasks, and fragments composed by a tree of groupings."""
    key = F.xxhash64("doc_id", "text")
    once = docs.groupBy(key.alias("key"), "doc_id", "text").agg(F.count("*").alias("copies")).select("key", "doc_id", "copies", "text")
    parts = once.mapInArrow(_cut_up(paths, piece), "key long, doc_id long, copies long, start long, piece string").repartition("key", "start")
    parts = parts.mapInPandas(_encoded(paths, size), PART)
    longest = docs.agg(F.max(F.octet_length("text"))).first()[0] or 0
    width = size
    while width <= 2 * longest:
        width *= FAN
        parts = parts.groupBy("key", F.expr(f"start div {width}").alias("branch")).applyInPandas(_composed, PART)

    def done(frames):
        import pandas as pd

        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                ended = r.whole and not len(r.suffix_a) and not len(r.suffix_b)
                whole = Fragment(tuple(r.prefix_a), tuple(r.prefix_b), True, tuple(r.closed))
                row = (r.n_a, r.n_b, r.n_groups, digest(whole), r.links, r.times) if ended else (0, 0, 0, "", b"", b"")
                out += [(r.doc_id, *row)] * int(r.copies)
            yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in WHOLE.split(", ")]).astype({"doc_id": "Int64"})

    return parts.mapInPandas(done, WHOLE)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Different links of a task's documents with their counts: no more rows than there can be links."""
    links, times = np.zeros(0, np.uint32), np.zeros(0, np.int64)
    for batch in batches:
        new, n = merged(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        links, where = np.unique(np.concatenate((links, new)), return_inverse=True)
        times = np.bincount(where, np.concatenate((times, n)), len(links)).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(links.astype(np.int64)), pa.array(times)], names=["link", "n"])


def align_documents(docs: DataFrame, path_a: str, path_b: str, piece: int = PIECE_BYTES, size: int = RANGE_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of `docs` (doc_id, text).

    Null and empty texts, and those whose bytes a tokenizer doesn't give back, have zeros and an empty digest; repeated
    rows count and are returned as often as they stand; an empty table gives an empty result; other columns are ignored.
    Text is encoded once: each document's different links are written beside its digest, and read again with the counts.
    A document beyond `piece` bytes is encoded by several tasks, but the text of its groups (compressed) must fit a row.
    """
    tok, paths, spark = tokens_of(path_a, path_b), (path_a, path_b), docs.sparkSession
    if len(tok.size_a) * len(tok.size_b) > 1 << 32:
        raise ValueError("a pair of ids must fit 32 bits")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    big = F.coalesce(F.octet_length("text") > piece, F.lit(False))
    usual = rows.filter(~big).mapInArrow(_usual(paths), WHOLE)
    table = cut(usual.unionByName(_long(rows.filter(big), paths, piece, size)), keep=True)
    counts = table.select("links", "times").mapInArrow(_pairs, "link long, n long").groupBy("link").agg(F.sum("n").alias("n")).toPandas().sort_values("link")
    if len(counts) > tok.most_links():
        raise AssertionError("more links than suffixes")
    link, n = counts["link"].to_numpy(np.uint32), counts["n"].to_numpy(np.int64)
    top = np.zeros(len(tok.size_b), np.int64)
    np.maximum.at(top, link % len(top), n)
    shared = spark.sparkContext.broadcast((link, n, n == top[link % len(top)]))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        link, n, best = shared.value
        for batch in batches:
            own, sums, bests = batch.select(["doc_id", "n_a", "n_b", "n_groups", "groups_sha256"]), [], []
            for x, t in zip(batch.column("links").to_pylist(), batch.column("times").to_pylist()):
                at, t = np.searchsorted(link, np.frombuffer(x, np.uint32)), np.frombuffer(t, np.uint32).astype(np.int64)
                sums.append(int(t @ n[at]))
                bests.append(int(t @ best[at]))
            columns = [own.column("doc_id"), own.column("n_a"), own.column("n_b"), own.column("n_groups"), own.column("n_groups"), pa.array(bests, pa.int64()), pa.array(sums, pa.int64()), own.column("groups_sha256")]
            yield pa.RecordBatch.from_arrays(columns, names=OUT)

    return table.mapInArrow(judged, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


OUT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
