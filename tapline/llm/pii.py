"""Personal data: exact base patterns, and bootstrapped contextual extraction of identifiers that they miss.

The base finds e-mail addresses, IPv4 addresses, card numbers and phone numbers. They are seeds, and so, for a further
kind, are long codes of letters and digits, which may be secrets or mere digests. The words on either side of a mention
form lexical patterns, without the mention's own shape. Patterns and the instances they extract make a bipartite graph
that Spark scores in a few rounds: a pattern is as good as the instances it extracts, of which unknown ones and those of
other kinds count against it; an instance is as good as the patterns that extract it. Candidates that no base rule took,
extracted by confident patterns of a kind that they can be of, become further spans; codes need such a pattern, too.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, workspace

KINDS = ("email", "ip", "card", "phone")
#: The kind of secrets comes after those of the base.
SECRET = "secret"
ORDER = {k: i for i, k in enumerate((*KINDS, SECRET))}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_RUN = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_DOUBLED = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Every address has one @, so scan those: the local part is the run before it, back to the last match."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            floor = m.end()
        else:
            floor = max(floor, at + 1)
        at = text.find("@", max(floor, at + 1))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    if text.count(".") < 3:
        return
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            yield m.span()


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(_DOUBLED[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGIT.findall(m.group())) <= 15:
                yield m.span()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by kind as listed in KINDS, then by start; offsets are code points, ends exclusive."""
    if not _DIGIT.search(text) and "@" not in text:
        return []
    finders = zip(KINDS, (_emails, _ips, _cards, _phones))
    return [(kind, a, b) for kind, find in finders for a, b in find(text)]


#: A token with a digit or @; one attempt a token.
_MARKED = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*")
_AT = re.compile(r" ?[\[(]at[\])] ?", re.I)
_SPELLED_DOMAIN = re.compile(r"[\w-]+(?: ?(?:[\[(]dot[\])]|\.) ?[\w-]+)+", re.I)
_NUMBER = re.compile(r"[0-9(][0-9().-]*")
_CODE = re.compile(r"[A-Za-z0-9+/_-]+=*")
_TRIM = "\"'[]{}<>,;:!?*#%$&|="
_WORD = re.compile(r"\S+")
#: Digits of a number that any kind can have at most; characters of a code that is a seed; of one that can be a secret.
MOST_DIGITS, SEED_CODE, LEAST_CODE = 19, 32, 12


def _is_code(value: str, least: int) -> bool:
    return len(value) >= least and _CODE.fullmatch(value) is not None and any(c.isdigit() for c in value) and any(c.isalpha() for c in value)


def _spelled(text: str) -> Iterator[tuple[int, int]]:
    """Addresses whose at, and maybe dots, are spelled out in brackets."""
    floor = 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > floor and (text[start - 1].isalnum() or text[start - 1] in "_.+-"):
            start -= 1
        domain = _SPELLED_DOMAIN.match(text, m.end()) if start < m.start() else None
        if domain:
            yield start, domain.end()
            floor = domain.end()


def _candidates(text: str) -> Iterator[tuple[int, int, str]]:
    """Start, end and sort (at, number or code) of tokens with a digit or @, less the marks around them.

    Numbers that single spaces part are one, as long as they have no more digits together than any kind can have.
    """
    run: list[tuple[int, int]] = []

    def numbers() -> Iterator[tuple[int, int, str]]:
        if run:
            whole = text[run[0][0] : run[-1][1]]
            parts = [(run[0][0], run[-1][1])] if sum(map(str.isdigit, whole)) <= MOST_DIGITS else run
            yield from ((a, b, "number") for a, b in parts)
            run.clear()

    for m in _MARKED.finditer(text):
        raw = m.group()
        a, b = m.start() + len(raw) - len(raw.lstrip(_TRIM)), m.end() - len(raw) + len(raw.rstrip(_TRIM + "."))
        number = b > a and _NUMBER.fullmatch(text, a, b)
        if not number or not run or text[run[-1][1] : a] != " ":
            yield from numbers()
        if number:
            run.append((a, b))
        elif b > a:
            yield a, b, "at" if "@" in raw else "code"
    yield from numbers()


def _words_before(text: str, start: int, n: int = 2) -> list[str]:
    """The `n` words that end before a place; what touches the place without white space between isn't one."""
    out: list[str] = []
    at = start
    while at > 0 and not text[at - 1].isspace():
        at -= 1
    while len(out) < n and at > 0:
        while at > 0 and text[at - 1].isspace():
            at -= 1
        end = at
        while at > 0 and not text[at - 1].isspace():
            at -= 1
        if end > at:
            out.append(text[at:end])
    return out[::-1]


def _context(text: str, start: int, end: int) -> tuple[str, str]:
    """The two words before and the word after a span, lower case, digits as 9, without odd marks."""
    clean = lambda w: re.sub(r"[0-9]+", "9", w.strip("\"'.,;*#%$&!").lower())
    rest = end
    while rest < len(text) and not text[rest].isspace():
        rest += 1
    after = _WORD.search(text, rest)
    return " ".join(map(clean, _words_before(text, start))), clean(after.group()) if after else ""


def mentions(text: str) -> list[tuple[str, int, int, str, str, str, str]]:
    """Identifier-like spans: kind of a seed ('' for others), start, end, text, left, right, sort.

    Base spans come with their kind, long codes as seeds of secrets. Candidates are addresses with the at spelled out,
    and tokens and runs of numbers with a digit or @ that no base span touches.
    """
    spelled = list(_spelled(text))
    if not spelled and "@" not in text and not _DIGIT.search(text):
        return []
    base = base_spans(text)
    out = [(k, a, b, text[a:b], *_context(text, a, b), "at" if k == "email" else "number") for k, a, b in base]
    out += [("", a, b, text[a:b], *_context(text, a, b), "at") for a, b in spelled]
    taken, i = sorted([*((a, b) for _, a, b in base), *spelled]), 0
    for a, b, sort in _candidates(text):
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if i == len(taken) or taken[i][0] >= b:
            value = text[a:b]
            out.append((SECRET if sort == "code" and _is_code(value, SEED_CODE) else "", a, b, value, *_context(text, a, b), sort))
    return out


def kinds_of(value: str, sort: str) -> list[str]:
    """The kinds that a candidate can be of; the base misses no IPv4 address."""
    if sort == "at":
        return ["email"]
    if sort == "code":
        return [SECRET] if _is_code(value, LEAST_CODE) else []
    digits = sum(map(str.isdigit, value))
    return ["card"] * (13 <= digits <= MOST_DIGITS) + ["phone"] * (7 <= digits <= 15)


#: Rounds of scoring, the confidence that keeps a pattern or instance, and the fewest instances of a pattern.
ROUNDS, CONFIDENT, SUPPORT = 3, 0.6, 3


def score_patterns(found: DataFrame, rounds: int = ROUNDS, confident: float = CONFIDENT, support: int = SUPPORT) -> DataFrame:
    """Confident (kind, pattern) pairs of the pattern-instance graph.

    `found` has kind, instance, pattern: an edge for each mention and each pattern it matches. Seeds are instances
    that a base rule took, with confidence 1 for its kind. Each round sets a pattern's confidence for a kind to the
    share of its distinct instances' confidence, and an instance's to that of its best pattern.
    """
    spark = found.sparkSession
    with workspace(spark):
        edges = cut(found.select("kind", "instance", "pattern").distinct())
        seeds = cut(edges.filter("kind != ''").select("kind", "instance").distinct().withColumn("c", F.lit(1.0)))
        pairs = cut(edges.groupBy("pattern", "instance").agg(F.max("kind").alias("seed_kind")))
        sizes = cut(pairs.groupBy("pattern").agg(F.count("*").alias("size")).filter(F.col("size") >= support))
        belief, patterns = seeds, None
        for _ in range(rounds):
            weights = pairs.join(belief, "instance").groupBy("kind", "pattern").agg(F.sum("c").alias("mass"))
            share = F.col("mass") / (F.col("size") + 1.0)
            patterns = cut(weights.join(sizes, "pattern").select("kind", "pattern", share.alias("confidence")).filter(F.col("confidence") >= confident))
            new = pairs.filter("seed_kind = ''").join(patterns, "pattern").groupBy("kind", "instance").agg(F.max("confidence").alias("c"))
            belief = cut(seeds.unionByName(new))
        return cut(patterns, keep=True)


def _patterns_of(left: str, right: str, sort: str) -> list[str]:
    """Lexical patterns of a mention: its sort after its left words, and between its neighbours; long ones by digest.

    Where there are no such words there is no pattern.
    """
    last = left.rsplit(" ", 1)[-1]
    made = [f"L|{left}|{sort}"] * (left.strip() != "") + [f"N|{last}|{right}|{sort}"] * (last != "" and right != "")
    return [p if len(p) <= 96 else hashlib.blake2b(p.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest() for p in made]


def mention_edges(docs: DataFrame) -> DataFrame:
    """kind, instance, pattern of every mention in every whole text; instances and patterns are hashed to long."""
    schema = pa.schema([("kind", pa.string()), ("instance", pa.string()), ("pattern", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, instance, pattern = [], [], []
            for text in batch.column(0):
                for k, _, _, value, left, right, sort in mentions(text.as_py() or ""):
                    digest = hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()
                    for p in _patterns_of(left, right, sort):
                        kind.append(k)
                        instance.append(digest)
                        pattern.append(p)
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(instance, pa.string()), pa.array(pattern, pa.string())], schema=schema)

    return docs.select("text").mapInArrow(run, "kind string, instance string, pattern string")


#: Patterns that a worker gets at most. Beyond it spans and patterns are joined instead.
BROADCAST_PATTERNS = 50_000


def extract(docs: DataFrame, rounds: int = ROUNDS, confident: float = CONFIDENT, support: int = SUPPORT) -> DataFrame:
    """One row per row of `docs`: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans.

    Counts and base_sha256 are of the base spans alone; spans has those and what confident patterns add, the n_added,
    also of kind secret. An added span never overlaps a base span; of the kinds that it can be of, its kind is that of its
    most confident pattern, ties to the first by name.
    Null or empty text has no spans and the digest of nothing. Repeated rows give repeated results, an empty table an
    empty result, and other columns are ignored.
    """
    patterns = score_patterns(mention_edges(docs), rounds, confident, support)
    best = patterns.groupBy("pattern").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "kind")).alias("b")).select("pattern", "b.kind", (-F.col("b.c")).alias("confidence"))
    few = {r.pattern: (-r.confidence, r.kind) for r in best.limit(BROADCAST_PATTERNS + 1).collect()}
    if len(few) > BROADCAST_PATTERNS:
        return _extract_joined(docs, best)
    known = docs.sparkSession.sparkContext.broadcast(few)

    def added(text: str) -> list[tuple[str, int, int]]:
        out = []
        for k, a, b, value, left, right, sort in mentions(text):
            found = [known.value[p] for p in _patterns_of(left, right, sort) if p in known.value] if k not in KINDS else []
            hits = [x for x in found if x[1] in kinds_of(value, sort)] if found else []
            if hits:
                out.append((min(hits)[1], a, b))
        return out

    return _spans(docs, added)


_FIELDS = [("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64()), ("n_spans", pa.int64())]


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _spans(docs: DataFrame, added) -> DataFrame:
    schema = pa.schema(_FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = value.as_py() or ""
                base = base_spans(text)
                more = added(text) if text else []
                every = sorted({*base, *more}, key=lambda s: (ORDER[s[0]], s[1], s[2]))
                counts = [sum(s[0] == k for s in base) for k in KINDS]
                rows.append((doc_id, *counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every), len(more), len(every)))
            columns = list(zip(*rows)) if rows else [()] * len(_FIELDS)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS)], schema=schema)

    kinds = ", ".join(f"{n} {'long' if t == pa.int64() else 'string'}" for n, t in _FIELDS)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, kinds)


def _extract_joined(docs: DataFrame, best: DataFrame) -> DataFrame:
    """The same where the patterns are too many to send: candidates meet their patterns in a join.

    Candidates go by the digest of their text and whole mention list, so equal texts share one row.
    """
    schema = pa.schema([("digest", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("pattern", pa.string()), ("fits", pa.string())])

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(0):
                text = value.as_py() or ""
                digest = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
                rows += [(digest, a, b, p, ",".join(kinds_of(value, sort))) for k, a, b, value, left, right, sort in mentions(text) if k not in KINDS for p in _patterns_of(left, right, sort)]
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    found = docs.select("text").mapInArrow(candidates, "digest string, a long, b long, pattern string, fits string").distinct().join(best, "pattern").filter("array_contains(split(fits, ','), kind)")
    chosen = found.groupBy("digest", "a", "b").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "kind")).alias("m"))
    listed = chosen.groupBy("digest").agg(F.to_json(F.collect_list(F.struct(F.col("m.kind").alias("k"), "a", "b"))).alias("more"))
    base = _spans_with_digest(docs)
    return base.join(listed, "digest", "left").mapInArrow(_merge_added, ", ".join(f"{n} {'long' if t == pa.int64() else 'string'}" for n, t in _FIELDS))


def _spans_with_digest(docs: DataFrame) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.string()), ("base", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(v.as_py() or "") for v in batch.column(1)]
            digests = [hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.string()), pa.array([_joined(base_spans(t)) for t in texts], pa.string())], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, digest string, base string")


def _merge_added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import json

    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            base = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r["base"].split(",") if s)]
            more = [(x["k"], x["a"], x["b"]) for x in json.loads(r["more"] or "[]")]
            every = sorted({*base, *more}, key=lambda s: (ORDER[s[0]], s[1], s[2]))
            rows.append((r["doc_id"], *(sum(s[0] == k for s in base) for k in KINDS), hashlib.sha256(r["base"].encode()).hexdigest(), _joined(every), len(more), len(every)))
        columns = list(zip(*rows)) if rows else [()] * len(_FIELDS)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS)], schema=pa.schema(_FIELDS))
