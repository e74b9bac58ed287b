"""Document fingerprints by invertible Bloom lookup sketches.

A text's paragraphs (lines, cut further at ends of sentences and after a few words) have 64-bit digests. Each
digest goes to three cells of a sketch; a cell holds a count, the sum of its digests and the sum of their check
values. Sketches of two versions subtract cell by cell: what both share cancels. Peeling cells that hold a single
digest recovers the digests that differ; where that fails more cells are tried.

A fingerprint is such a sketch with the number of its digests. It has a power of two of cells for each of the three
places, so that a large one folds to the size of a small one, and enough of them to give up all of its own digests:
one that doesn't is made anew with twice the cells. Two fingerprints are compared at the size of the smaller one, and
where their difference doesn't peel there, each is peeled by itself at its own size. So their likeness, what both have
over what either has, always follows from the two strings alone, exactly.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64

#: Words of a passage at most; cells for each digest that a sketch begins with.
PASSAGE_WORDS, START = 24, 1.3
_HASHES = 3
_PLACES = [np.uint64(x) for x in (0x1F123BB51F123BB5, 0x5851F42D4C957F2D, 0x14057B7EF767814F)]


def passages(text: str) -> list[str]:
    """Lines of a text, cut after the ends of sentences and, in long sentences, after every PASSAGE_WORDS words."""
    out = []
    for line in text.split("\n"):
        for sentence in line.split(". "):
            if sentence.count(" ") < PASSAGE_WORDS:
                if sentence:
                    out.append(sentence)
            else:
                words = sentence.split(" ")
                out += [" ".join(words[i : i + PASSAGE_WORDS]) for i in range(0, len(words), PASSAGE_WORDS)]
    return out


def digests(text: str) -> np.ndarray:
    """Sorted distinct digests of a text's passages."""
    found = set(map(xxhash.xxh3_64_intdigest, passages(text)))
    return np.sort(np.fromiter(found, np.uint64, len(found)))


def _check(keys: np.ndarray) -> np.ndarray:
    return mix64(keys ^ np.uint64(0xA24BAED4963EE407)) & np.uint64(0xFFFFFFFF)


class Cells:
    """Sketches side by side: counts modulo 2^8, digest sums modulo 2^64, check sums modulo 2^32, in thirds.

    `thirds` has the cells of each third of each sketch, powers of two.
    """

    def __init__(self, thirds: np.ndarray):
        self.thirds = thirds.astype(np.int64)
        ends = np.append(0, np.cumsum(_HASHES * self.thirds))
        self.base, n = ends[:-1], int(ends[-1])
        self.owner = np.repeat(np.arange(len(thirds)), _HASHES * self.thirds)
        self.count, self.total, self.check = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)

    def add(self, keys: np.ndarray, owner: np.ndarray, signs: np.ndarray) -> None:
        """Put each key with its sign (1 or -1) in one cell of each third of its owner's sketch."""
        unit, third, base = signs.astype(np.int64).view(np.uint64), self.thirds[owner], self.base[owner]
        values, marks = keys * unit, _check(keys) * unit
        for h, place in enumerate(_PLACES):
            at = base + h * third + (mix64(keys + place) & (third - 1).astype(np.uint64)).astype(np.int64)
            np.add.at(self.count, at, signs)
            np.add.at(self.total, at, values)
            np.add.at(self.check, at, marks)

    def folded(self, which: np.ndarray, thirds: np.ndarray, sign: int, into: Cells) -> None:
        """Add, or with sign -1 subtract, some of these sketches, folded to `thirds`, to the sketches of `into`."""
        size = _HASHES * self.thirds[which]
        source = np.repeat(self.base[which], size) + _ranges(size)
        third, narrow = np.repeat(self.thirds[which], size), np.repeat(thirds, size)
        within = _ranges(size)
        at = np.repeat(into.base, size) + within // third * narrow + within % third % narrow
        unit = np.uint64(sign % 2**64)
        np.add.at(into.count, at, sign * self.count[source])
        np.add.at(into.total, at, self.total[source] * unit)
        np.add.at(into.check, at, self.check[source] * unit)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The keys that the sketches give up, their owners, and which sketches keep something that doesn't peel."""
        keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        low = np.uint64(0xFFFFFFFF)
        while True:
            seen = self.count & 255
            single = np.flatnonzero((seen == 1) | (seen == 255))
            sign = np.where(seen[single] == 1, 1, -1)
            unit = sign.view(np.uint64)
            value = self.total[single] * unit
            pure = (self.check[single] * unit) & low == _check(value)
            single, sign, value = single[pure], sign[pure], value[pure]
            if not len(single):
                break
            whose = self.owner[single]
            _, once = np.unique(value ^ mix64(whose.astype(np.uint64)), return_index=True)
            keys.append(value[once])
            owners.append(whose[once])
            self.add(value[once], whose[once], -sign[once])
        stuck = np.zeros(len(self.thirds), bool)
        stuck[self.owner[(self.count & 255 != 0) | (self.total != 0) | (self.check & low != 0)]] = True
        return np.concatenate(keys), np.concatenate(owners), stuck


def _ranges(sizes: np.ndarray) -> np.ndarray:
    """0 to size - 1 for each size, one after another."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


class Prints:
    """The fingerprints of many texts: numbers of digests, and cells."""

    def __init__(self, sizes: np.ndarray, cells: Cells):
        self.sizes, self.cells = sizes, cells

    @classmethod
    def of(cls, keys: list[np.ndarray]) -> Prints:
        """Sketches of sets of digests, each with cells enough to give up all of them."""
        sizes = np.fromiter(map(len, keys), np.int64, len(keys))
        thirds = 2 ** np.ceil(np.log2(np.maximum(1, sizes * START / _HASHES))).astype(np.int64)
        pending = np.arange(len(keys))
        while len(pending):
            trial = _filled([keys[i] for i in pending], thirds[pending])
            _, _, stuck = trial.peel()
            pending = pending[stuck]
            thirds[pending] *= 2
        return cls(sizes, _filled(keys, thirds))

    def texts(self) -> list[str]:
        """Number of digests and of cells in a third, then counts, digest sums and check sums, in base 64."""
        c, out = self.cells, []
        count, total, check = c.count.astype("u1").tobytes(), c.total.astype("<u8").tobytes(), c.check.astype("<u4").tobytes()
        for n, third, a in zip(self.sizes.tolist(), c.thirds.tolist(), c.base.tolist()):
            b = a + _HASHES * third
            out.append(base64.b64encode(np.array([n, third], "<u4").tobytes() + count[a:b] + total[8 * a : 8 * b] + check[4 * a : 4 * b]).decode())
        return out

    @classmethod
    def read(cls, texts: list[str]) -> Prints:
        raw = [base64.b64decode(t) for t in texts]
        head = np.array([np.frombuffer(r[:8], "<u4") for r in raw], np.int64).reshape(-1, 2)
        cells = Cells(head[:, 1])
        for r, third, a in zip(raw, head[:, 1].tolist(), cells.base.tolist()):
            n = _HASHES * third
            cells.count[a : a + n] = np.frombuffer(r[8 : 8 + n], "u1")
            cells.total[a : a + n] = np.frombuffer(r[8 + n : 8 + 9 * n], "<u8")
            cells.check[a : a + n] = np.frombuffer(r[8 + 9 * n :], "<u4")
        return cls(head[:, 0], cells)

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """All digests that the sketches hold, and whose they are."""
        c = self.cells
        whole = Cells(c.thirds)
        whole.count, whole.total, whole.check = c.count.copy(), c.total.copy(), c.check.copy()
        keys, owners, _ = whole.peel()
        return keys, owners

    def differences(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For pairs of these fingerprints, how many digests differ: recovered from their difference, or each by itself."""
        thirds = np.minimum(self.cells.thirds[a], self.cells.thirds[b])
        both = Cells(thirds)
        self.cells.folded(a, thirds, 1, both)
        self.cells.folded(b, thirds, -1, both)
        _, owners, stuck = both.peel()
        out = np.bincount(owners, minlength=len(a))
        if stuck.any():
            keys, owners = self.digests()
            order = np.lexsort((keys, owners))
            keys, ends = keys[order], np.searchsorted(owners[order], np.arange(len(self.sizes) + 1))
            for i in np.flatnonzero(stuck).tolist():
                left, right = (keys[ends[x] : ends[x + 1]] for x in (a[i], b[i]))
                out[i] = len(left) + len(right) - 2 * len(np.intersect1d(left, right, assume_unique=True))
        return out

    def likeness(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Shared digests over all digests of each pair; two texts without any are alike."""
        n = self.sizes[a] + self.sizes[b]
        differ = self.differences(a, b)
        shared = (n - differ) / 2
        return np.where(n > 0, shared / np.maximum(1, shared + differ), 1.0)


def _filled(keys: list[np.ndarray], thirds: np.ndarray) -> Cells:
    cells, sizes = Cells(thirds), np.fromiter(map(len, keys), np.int64, len(keys))
    if sizes.sum():
        cells.add(np.concatenate(keys), np.repeat(np.arange(len(keys)), sizes), np.ones(sizes.sum(), np.int64))
    return cells


def differences(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """For each pair of digest sets, how many digests differ, by their fingerprints."""
    at = np.arange(len(left))
    return Prints.of([*left, *right]).differences(at, at + len(left))


def likeness(left: list[str], right: list[str]) -> np.ndarray:
    """The likeness of pairs of fingerprints, from the strings alone."""
    at = np.arange(len(left))
    return Prints.read([*left, *right]).likeness(at, at + len(left))


_FIELDS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
#: Texts and characters that one batch of sketches covers.
_BATCH_ROWS, _BATCH_CHARS = 512, 1 << 21


def _rows(batch: list[tuple[int, str, str]]) -> pa.RecordBatch:
    keys, index = [], {}

    def place(text: str) -> int:
        if text not in index:
            index[text] = len(keys)
            keys.append(digests(text))
        return index[text]

    at, hashes = [], []
    for _, text, after in batch:
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        at.append([place(text), place(changed), place(after)])
        hashes.append(hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest())
    prints = Prints.of(keys)
    own, edited, following = np.array(at).T
    shown = prints.texts()
    columns = [[r[0] for r in batch], [len(r[1]) for r in batch], hashes, [shown[i] for i in own], [shown[i] for i in edited], prints.likeness(own, edited), prints.likeness(own, following)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS)], schema=pa.schema(_FIELDS))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by (part, last, doc_id, text): each meets the one after it in its part. `peek` rows only follow."""
    held, waiting, chars = None, [], 0
    for record in batches:
        for part, peek, doc_id, text in zip(record.column(0).to_pylist(), record.column(1).to_pylist(), record.column(2).to_pylist(), record.column(3)):
            text = text.as_py() or ""
            if held is not None and held[0] == part:
                waiting.append((held[1], held[2], text))
                chars += len(held[2]) + len(text)
                if len(waiting) >= _BATCH_ROWS or chars >= _BATCH_CHARS:
                    yield _rows(waiting)
                    waiting, chars = [], 0
            held = None if peek else (part, doc_id, text)
    if waiting:
        yield _rows(waiting)


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Documents follow each other by doc_id, null first, equal ids by text; the first follows the last, and an only
    document follows itself. Null text counts as empty. Texts cross the network once: ranges of ids, of about equal
    row counts, become parts, and the first document of each part is also sent to the part before it. Repeated rows
    follow each other, an empty table gives an empty result, other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = rows.select(F.percentile_approx("id", [i / parts for i in range(1, parts)], 20 * parts)).first()[0]
    bounds = sorted(set(bounds or []))
    # the part of an id: how many bounds are not above it
    steps = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<long>")
    part = F.size(F.filter(steps, lambda b: b <= F.col("id")))
    placed = rows.withColumn("part", part)
    firsts = {r.part: (r.f.id, r.f.digest) for r in placed.groupBy("part").agg(F.min(F.struct("id", F.sha2("text", 256).alias("digest"))).alias("f")).collect()}
    used = sorted(firsts)
    before = {p: used[i - 1] for i, p in enumerate(used)}  # the first part's first document goes to the last part
    sent = F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("peek")))
    if used:
        first_ids = F.array(*[F.lit(firsts[p][0]).cast("long") for p in used])
        is_first = F.array_contains(first_ids, F.col("id"))
        keys = F.create_map(*[x for p in used for x in (F.lit(p), F.lit(f"{firsts[p][0]}:{firsts[p][1]}"))])
        targets = F.create_map(*[x for p in used for x in (F.lit(p), F.lit(before[p]))])
        match = is_first & (F.concat_ws(":", F.col("id").cast("string"), F.sha2("text", 256)) == F.element_at(keys, F.col("part")))
        peek = F.array(F.struct(F.element_at(targets, F.col("part")).alias("part"), F.lit(True).alias("peek")))
        sent = F.when(match, F.concat(sent, peek)).otherwise(sent)
    spread = placed.withColumn("to", F.explode(sent)).select("to.part", "to.peek", "id", "text")
    dealt = spread.repartition("part").sortWithinPartitions("part", "peek", "id", F.sha2("text", 256))
    kinds = {pa.int64(): "long", pa.string(): "string", pa.float64(): "double"}
    out = dealt.mapInArrow(_walk, ", ".join(f"{n} {kinds[t]}" for n, t in _FIELDS))
    return out.withColumn("doc_id", F.when(F.col("doc_id") > -(2**63), F.col("doc_id")))
