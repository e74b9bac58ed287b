"""Spelling variants by composing finite-state machines: vocabulary, one edit, vocabulary.

Spark counts the words. Those that share an initial state come together: the state that the first characters lead to,
or, for edits among these, the state that the last characters lead to when words are read backwards. In each such
part the words make a minimal acyclic acceptor whose arcs know how many words lie before them, so that a path is a
word's number. Its composition with a transducer of exactly one edit, and with itself again, is walked lazily: both
sides read the same characters up to the first place where they differ, take one edit there, and then must agree to
the end. Parts are read one by one from sorted partitions; a part with many words is split by finer states.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Runs of letters; one in so many is spelled with a character left out, by the contract of the query.
LETTERS, DROPPED = "A-Za-zÀ-ÿ", 31
#: Shortest words, their fewest occurrences, and how many times more frequent a form is than its variant.
SHORTEST, FEWEST, TIMES = 7, 2, 10
#: Characters of initial states read forwards and backwards; an edit before the first leaves the second alone.
FRONT, BACK = 3, 4
#: Words beyond so many characters have states of half their length.
LONG = 64
#: Words of a part from which on it is split.
PART_WORDS = 20_000


def word_counts(docs: DataFrame, shortest: int = SHORTEST, fewest: int = FEWEST) -> DataFrame:
    """word, n of every run of letters in `docs` (doc_id, text), A-Z in lower case, with the contract's misspellings."""
    run = F.explode(F.regexp_extract_all("text", F.lit(f"([{LETTERS}]{{{shortest},}})"), F.lit(1)))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), run.alias("run"))
    rows = rows.select("id", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("run"))
    rows = rows.withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    spelled = F.when(F.col("h") % DROPPED == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    return rows.select(spelled.alias("word")).filter(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= fewest)


class Acceptor:
    """The minimal acyclic acceptor of sorted different words, from character `skip` on; state 0 has no way on.

    A state is (final, arcs, words); an arc is (character, state, words before it).
    """

    def __init__(self, words: list[str], skip: int):
        self.states: list[tuple] = []
        self._known: dict[tuple, int] = {}
        path: list[tuple[bool, list]] = [(False, [])]
        last = ""
        for word in words:
            rest, same = word[skip:], 0
            while same < min(len(rest), len(last)) and rest[same] == last[same]:
                same += 1
            self._close(path, last, same)
            path += [(False, []) for _ in rest[same:]]
            path[-1] = (True, path[-1][1])
            last = rest
        self._close(path, last, 0)
        self.start = self._state(path[0])

    def _close(self, path: list, last: str, depth: int) -> None:
        while len(path) > depth + 1:
            state = self._state(path.pop())
            path[-1][1].append((last[len(path) - 1], state))

    def _state(self, made: tuple[bool, list]) -> int:
        final, arcs = made
        key = (final, tuple(arcs))
        if key not in self._known:
            self._known[key] = len(self.states)
            before, placed = int(final), []
            for c, to in arcs:
                placed.append((c, to, before))
                before += self.states[to][2]
            self.states.append((final, tuple(placed), before))
        return self._known[key]


def near_pairs(words: list[str], skip: int, longest: int | None = None) -> Iterator[tuple[int, int]]:
    """Numbers of sorted words that are one edit apart, the edit after `skip` common characters, each pair once.

    With `longest`, at most so many characters may follow the edit.
    """
    machine = Acceptor(words, skip)
    states, dead = machine.states, set()

    def agree(p: int, before_p: int, q: int, before_q: int, but: str | None) -> Iterator[tuple[int, int]]:
        """Words that both states accept, as numbers of both sides; they don't begin with `but`."""
        if p == q and but is None and longest is None:
            yield from ((before_p + i, before_q + i) for i in range(states[p][2]))
            return
        todo, seen, found = [(p, before_p, q, before_q, 0)], [], False
        while todo:
            p, before_p, q, before_q, depth = todo.pop()
            if longest is None and but is None:
                if (p, q) in dead:
                    continue
                seen.append((p, q))
            (final_p, arcs_p, _), (final_q, arcs_q, _) = states[p], states[q]
            if final_p and final_q:
                found = True
                yield before_p, before_q
            if depth == longest:
                continue
            if len(arcs_p) == 1 and len(arcs_q) == 1:
                (c, to_p, own_p), (d, to_q, own_q) = arcs_p[0], arcs_q[0]
                if c == d and (depth or c != but):
                    todo.append((to_p, before_p + own_p, to_q, before_q + own_q, depth + 1))
                continue
            other = {c: (to, own) for c, to, own in arcs_q}
            for c, to_p, own_p in arcs_p:
                if c in other and (depth or c != but):
                    todo.append((to_p, before_p + own_p, other[c][0], before_q + other[c][1], depth + 1))
        if not found:
            dead.update(seen)

    paths = [(machine.start, 0)]
    while paths:
        at, before = paths.pop()
        final, arcs, _ = states[at]
        for k, (c, to, own) in enumerate(arcs):
            for _, other, there in arcs[k + 1 :]:
                yield from agree(to, before + own, other, before + there, None)
            if final or len(arcs) > 1:
                yield from agree(to, before + own, at, before, c)
            if states[to][2] > 1:
                paths.append((to, before + own))


#: What a part is: how many common characters its words have, whether they are read backwards, what may follow an edit.
VIEWS = {"front": (FRONT, False, None), "back": (BACK, True, FRONT - 1), "first half": (LONG // 2, False, None), "last half": (LONG // 2, True, None)}


def judged(view: str, key: str, words: list[str], counts: list[int]) -> tuple[list[str], list[int], list[int], list[str]]:
    """Words of a part that have near ones there: how many, the largest count of these, and the first word that has it."""
    skip, backwards, longest = VIEWS[view]
    order = sorted(range(len(words)), key=lambda i: words[i][::-1] if backwards else words[i])
    keyed = [words[i][::-1] if backwards else words[i] for i in order]
    pairs = [(order[x], order[y]) for x, y in near_pairs(keyed, skip, longest)]
    if view == "back":  # a character more in a run can be taken for its first or its last
        pairs = [(x, y) for x, y in pairs if words[x][:FRONT] != words[y][:FRONT]]
    elif view.endswith("half"):
        pairs = [(x, y) for x, y in pairs if _of_half(view, int(key.split("/")[0]), words[x], words[y])]
    near, best = {}, {}
    for x, y in (*pairs, *((y, x) for x, y in pairs)):
        near[x] = near.get(x, 0) + 1
        found = (-counts[y], words[y])
        if x not in best or found < best[x]:
            best[x] = found
    return [words[x] for x in near], list(near.values()), [-best[x][0] for x in near], [best[x][1] for x in near]


def _of_half(view: str, size: int, x: str, y: str) -> bool:
    """Whether a pair of long words is this view's and length's: each is found once, and pairs of shorter words elsewhere."""
    half, same = size // 2, 0
    while same < half and x[same] == y[same]:
        same += 1
    return min(len(x), len(y)) == size and max(len(x), len(y)) > LONG and (same == half) == (view == "first half")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows of one part, in sorted partitions, composed one after the other."""
    names = ["word", "n_near", "form_n", "form"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string()]
    part, words, counts, out, held = None, [], [], [[], [], [], []], 0

    def close() -> None:
        if len(words) > 1:
            for column, more in zip(out, judged(*part, words, counts)):
                column += more

    for batch in batches:
        for view, key, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            if (view, key) != part:
                close()
                part, words, counts = (view, key), [], []
                if len(out[0]) >= 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)
                    out = [[], [], [], []]
            words.append(word)
            counts.append(n)
    close()
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)


def _states(words: DataFrame, part_words: int) -> DataFrame:
    """view, key, word, n: the parts in which each word meets all near ones, every pair in exactly one part.

    A pair agrees in its first FRONT characters, or differs there and agrees in its last BACK. A part of many words is
    keyed anew by what is left of a word without one character: near words share exactly one such key, and it has no
    more words than characters in all their places. Words over LONG characters are keyed by halves of the shorter
    one's length, which either one of a pair can be.
    """
    word, size = F.col("word"), F.length("word")
    state = lambda view, key: F.struct(F.lit(view).alias("view"), key.alias("key"))
    short = words.filter(size <= LONG).select("word", "n", F.explode(F.array(state("front", F.substring(word, 1, FRONT)), state("back", F.right(word, F.lit(BACK))))).alias("s")).select("s.*", "word", "n")
    many = short.groupBy("view", "key").agg(F.count("*").alias("_n")).filter(F.col("_n") > part_words).select("view", "key", F.lit(True).alias("_many"))
    without = lambda first, last: F.transform(F.sequence(first, last), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, size)))
    finer = F.when(F.col("view") == "front", without(F.lit(FRONT + 1), size)).otherwise(without(F.lit(1), F.lit(FRONT)))
    finer = F.array_distinct(F.concat(F.array(word), finer))
    keys = F.when(F.col("_many"), F.transform(finer, lambda k: F.concat("key", F.lit("/"), k))).otherwise(F.array("key"))
    short = short.join(many, ["view", "key"], "left").select("view", F.explode(keys).alias("key"), "word", "n")
    both = words.filter(size >= LONG).withColumn("s", F.explode(F.array(size, size - 1))).filter(F.col("s") >= LONG)
    half = F.expr("s div 2")
    halves = F.array(state("first half", F.substring(word, F.lit(1), half)), state("last half", F.right(word, F.col("s") - half)))
    long = both.select("word", "n", "s", F.explode(halves).alias("h")).select("h.view", F.concat_ws("/", F.col("s").cast("string"), "h.key").alias("key"), "word", "n")
    return short.unionByName(long)


def near_words(words: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """word, n_near, form_n, form of words that have near ones: their number, the largest n of theirs, and whose it is."""
    parts = _states(words, part_words).repartition("view", "key").sortWithinPartitions("view", "key")
    found = parts.mapInArrow(_parts, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("m"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.m")).alias("form_n"), "best.form")


def roots(forms: DataFrame, hops: int = 4) -> DataFrame:
    """word, root of every word that has a form: the last one that forms lead to, by doubling steps.

    A form is TIMES as frequent as its word, so 2^4 steps suffice for counts up to 2 * 10^16.
    """
    now = forms.select("word", F.col("form").alias("root"))
    for _ in range(hops):
        next_ = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        now = now.join(next_, "root", "left").select("word", F.coalesce("_next", "root").alias("root"))
    return now


def group_variants(docs: DataFrame, times: int = TIMES, part_words: int = PART_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of `docs` (doc_id, text).

    Null and empty texts have no words, a null doc_id counts as an empty one, repeated rows count as often as they
    stand, and an empty table gives an empty result. Other columns are ignored. A word's form is its near word of
    largest n, the first in code-point order of several, if it is `times` as frequent; root follows forms to the end.
    """
    words = cut(word_counts(docs), keep=True)
    found = words.join(near_words(words, part_words), "word", "left")
    is_form: Column = F.col("form_n") >= times * F.col("n")
    linked = cut(found.select("word", F.when(is_form, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("form_n")).alias("form_n")), keep=True)
    ends = cut(roots(linked.filter("form IS NOT NULL")), keep=True)
    return linked.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
