"""Line dedup by a segment-partition edit join, in DataFrame functions only.

Lines are compared in a normal form (lower case, digits as 0, outer white space off). Lines of equal form are one
class. Longer ones may be k edits apart, k by the length of the shorter line (EDITS, STEPS). For that, lengths fall
into buckets; in its bucket a line has k + 1 segments of one length, some counted from its start and the rest from
its end. Of two lines k edits apart, one has a whole segment of the other there, shifted by no more than the segments
before it (or behind it, from the end): of l segments from the start, hit by fewer than l edits, one is whole and has
no more edits before it than segments. So each line is indexed, and probes, with the substrings at those places of
its bucket, and a line within k of the next lower bucket's end probes that one as well: l * l + r * r keys of 64 bits.

Lines that share a key are paired where lengths and letter counts allow it; in long groups all lines meet a few leaders
first, and only those outside the main leader's component meet the rest. A banded bit-parallel edit distance verifies what the
two lines have between their common beginning and end. Connected components make classes; of each the first line stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, cut_plain, maybe_in, workspace, whole_row, with_own
from .components import connected_components, star_links

#: Edits that lines of MIN_CHARS characters or more may be apart; shorter ones are only compared for equality.
EDITS, MIN_CHARS = 1, 24
#: From how many characters of the shorter line on how many edits are allowed; the longest group paired without a leader.
STEPS, LONG_GROUP = ((64, 2), (128, 3)), 8
#: Leaders of a longer group.
LEADERS = 4
#: By how much a bucket's lengths differ at most.
GROWTH = 1.25
#: Characters whose counts, with that of all others together, rule pairs out: an edit changes them by two in all.
#: The frequent ones come first, so that little text is left to count the others in.
LETTERS = " etaoinsrhldcumfpgwybvkxjqz"
#: Counts are of the first FRONT characters and of the rest: an edit in front also moves a character across.
FRONT = 128
#: Counts that one number of 64 bits holds, four bits each.
PACKED = 14
#: Lengths of common beginnings and ends that are taken off, one after another, before verification.
TRIMS = tuple(1 << n for n in range(16, 2, -1))
_ROW, _POSITION = 2**62, 2**31


def banded_edits(a: Column, b: Column, k: int) -> Column:
    """The edit distance of two strings, if it is at most k; else k + 1.

    One machine word holds the band of 2k + 1 vertical differences around the diagonal. It moves down by one row a
    column: first along the lowest diagonal of the band, then along the last row.
    """
    width = 2 * k + 1
    mask, top = F.lit((1 << width) - 1).cast("long"), F.lit(1 << 2 * k).cast("long")
    pad = F.lit("\u0001" * (k + 2))
    a, b = F.concat(pad, a), F.concat(pad, b)
    rows, columns = F.length(a), F.length(b)

    def step(state: Column, i: Column) -> Column:
        letter = F.substring(b, i + 1, F.lit(1))
        match = F.lit(0).cast("long")
        for j in range(width):
            at = i + (j - k + 1)
            match = match + F.when((at >= 1) & (at <= rows) & (F.substring(a, F.greatest(at, F.lit(1)), F.lit(1)) == letter), F.lit(1 << j).cast("long")).otherwise(F.lit(0).cast("long"))
        vp, vn = state["vp"], state["vn"]
        packed = F.transform(F.array(match), lambda m: F.struct(m.alias("m"), (((m.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(m).bitwiseOR(vn)).bitwiseAND(mask).alias("d0")))

        def rest(x: Column) -> Column:
            d0 = x["d0"]
            hp = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp))).bitwiseAND(mask)
            hn = d0.bitwiseAND(vp)
            down = F.shiftright(d0, 1)
            diagonal = i < rows - k
            bit = F.shiftright(top, 1)
            # after the diagonal phase the last row lies one bit lower with every column
            for s in range(1, width):
                bit = F.when(i - (rows - k) == s, F.lit((1 << 2 * k) >> (s + 1)).cast("long")).otherwise(bit)
            moved = F.when(hp.bitwiseAND(bit) != 0, 1).otherwise(0) - F.when(hn.bitwiseAND(bit) != 0, 1).otherwise(0)
            cost = F.when(diagonal, F.when(d0.bitwiseAND(top) == 0, 1).otherwise(0)).otherwise(moved)
            return F.struct(
                hn.bitwiseOR(F.bitwise_not(down.bitwiseOR(hp))).bitwiseAND(mask).alias("vp"),
                down.bitwiseAND(hp).alias("vn"),
                (state["d"] + cost).cast("int").alias("d"),
            )

        # on the lowest diagonal distances never fall, and on the last row, 2k columns at most, they fall by one a column
        return F.when((state["d"] > 3 * k) & (i < rows - k), state).otherwise(F.element_at(F.transform(packed, rest), 1))

    start = F.struct(F.lit(((1 << width) - 1) & ~((1 << k) - 1)).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.lit(k).alias("d"))
    found = F.aggregate(F.sequence(F.lit(0), columns - 1), start, step)["d"]
    return F.when(F.abs(rows - columns) > k, k + 1).otherwise(F.least(found, F.lit(k + 1)))


def normal_form(line: Column) -> Column:
    plain, digits = F.lower(F.trim(line)), F.lit(False)
    for c in "123456789":  # most lines have none, which takes less to see than to replace
        digits = digits | F.contains(line, F.lit(c))
    return F.when(digits, F.regexp_replace(plain, "[1-9]", "0")).otherwise(plain)


def _in(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """The `rows` that may have one of the values of `column` in `wanted`."""
    return maybe_in(rows, F.col(column), wanted, F.col(column)).filter("_maybe").drop("_maybe")


def _bottoms() -> list[tuple[int, int]]:
    """(least length, edits) at which the number of edits changes, from MIN_CHARS on."""
    return [(MIN_CHARS, EDITS), *STEPS]


def allowed(length: Column) -> Column:
    """Edits that a line of this length may be from a line as long or longer."""
    out = F.lit(0)
    for least, k in _bottoms():
        out = F.when(length >= least, k).otherwise(out)
    return out


def _bucket(length: Column) -> Column:
    """The least length of the bucket that a length falls into; buckets of other numbers of edits begin anew."""
    out = F.lit(0)
    for least, _ in _bottoms():
        step = F.floor(F.log(length / float(least)) / F.log(F.lit(GROWTH)))
        out = F.when(length >= least, F.ceil(least * F.pow(F.lit(GROWTH), step)).cast("int")).otherwise(out)
    return out


def places(k: int) -> list[tuple[int, int, int]]:
    """(1 from the start or -1 from the end, segment, shift) of the substrings that a line is indexed by for k edits."""
    left = (k + 2) // 2
    return [(way, j, s) for way, n in ((1, left), (-1, k + 1 - left)) for j in range(n) for s in range(-j, j + 1)]


def _visits(length: Column, own: Column, next_lower: Column) -> Column:
    """The buckets that a line is indexed in, as structs of k, b (least length) and size of a segment: its `own` and, if
    it is near that one's lower end, the `next_lower` one. Lines too short for edits have k = 0."""
    entry = lambda k, b: F.struct(k.alias("k"), b.alias("b"), F.floor(b / (k + 1)).cast("int").alias("size"))
    first = entry(allowed(length), own)
    return F.when((next_lower != own) & (next_lower > 0), F.array(first, entry(allowed(next_lower), next_lower))).otherwise(F.array(first))


def segment_keys(form: Column, length: Column, k: Column, b: Column, size: Column) -> Column:
    """The keys of a line in a bucket: an array with nulls where k has fewer places than others.

    Where all characters are of one byte, segments are cut by bytes, which takes no walk along the line.
    """
    made, data, narrow = [], form.cast("binary"), F.octet_length(form) == length
    for way, j, s in places(max(n for _, n in _bottoms())):
        start = size * j + s if way > 0 else length - size * (j + 1) + s
        least = 2 * j if way > 0 else 2 * j + 1  # the fewest edits that need the segment
        segment = F.when(narrow, F.substring(data, start + 1, size)).otherwise(F.substring(form, start + 1, size).cast("binary"))
        made.append(F.when(k >= max(1, least), F.xxhash64(b, F.lit(way * (j + 1)), segment)))
    return F.array(*made)


def _documents(docs: DataFrame) -> DataFrame:
    """row_id, mark, text of the documents with text."""
    return _placed(docs.select("doc_id", "text")).select("row_id", "mark", "text").filter("text IS NOT NULL")


def _keyed(documents: DataFrame, short: bool) -> DataFrame:
    """row_id, mark, position, h, g, length, keys, again of the lines; blank ones, and without `short` short ones, go.

    A line near the lower end of its bucket has a second row, with `again`, for the next lower one.
    """
    lines = documents.select("row_id", "mark", F.posexplode(F.split("text", "\n")).alias("position", "line"))
    # generators keep the optimiser from making forms and buckets anew for each use
    formed = lines.select("row_id", "mark", "position", F.explode(F.array(normal_form(F.col("line")))).alias("form"))
    length = F.length("form")
    used = formed.filter((length >= MIN_CHARS) | F.lit(short) & F.col("form").rlike(r"\S")).withColumn("length", length)
    length = F.col("length")
    used = used.withColumns({"own": _bucket(length), "next_lower": _bucket(length - allowed(length - 1))})
    placed = used.select("*", F.posexplode(_visits(length, F.col("own"), F.col("next_lower"))).alias("visit", "in"))
    keys = segment_keys(F.col("form"), F.col("length"), F.col("in.k"), F.col("in.b"), F.col("in.size"))
    return placed.select("row_id", "mark", "position", F.xxhash64("form").alias("h"), F.xxhash64(F.lit(7), "form").alias("g"), "length", keys.alias("keys"), (F.col("visit") > 0).alias("again"))


def _node(row_id: str = "row_id", mark: str = "mark", position: str = "position") -> Column:
    """One number that orders lines by document and place."""
    part = lambda name, unit: F.col(name).cast("decimal(20,0)") * F.lit(unit).cast("decimal(19,0)")
    return (part(row_id, _ROW) + part(position, _POSITION) + F.col(mark).cast("decimal(20,0)")).cast("decimal(38,0)")


def _first_lines(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """h, g, node, row_id, mark, position of the first line of each class in `wanted` (h, g)."""
    found = _in(keyed.filter("NOT again").select("row_id", "mark", "position", "h", "g"), "h", wanted)
    first = found.groupBy("h", "g").agg(F.min(F.struct("row_id", "position", "mark")).alias("at")).join(wanted.select("h", "g"), ["h", "g"])
    return first.select("h", "g", "at.*").withColumn("node", _node())


def _forms(documents: DataFrame, lines: DataFrame) -> DataFrame:
    """h, g, node, form of some lines (h, g, node, row_id, mark, position)."""
    place = F.struct("row_id", "mark")
    wanted = cut(lines.groupBy("row_id", "mark").agg(F.collect_list(F.struct("position", "h", "g", "node")).alias("wanted")))
    held = maybe_in(documents, place, wanted, place).filter("_maybe").join(wanted, ["row_id", "mark"])
    split = held.select("wanted", F.explode(F.array(F.split("text", "\n"))).alias("split"))
    each = split.select(F.explode(F.transform("wanted", lambda w: F.struct(w["h"].alias("h"), w["g"].alias("g"), w["node"].alias("node"), F.element_at("split", w["position"] + 1).alias("line")))).alias("x"))
    return each.groupBy("x.h", "x.g").agg(F.min("x.node").alias("node"), F.min(normal_form(F.col("x.line"))).alias("form"))


def _untrimmed(a: Column, b: Column) -> Column:
    """What two strings have between their common beginning and end, nearly: a struct of a and b."""

    def less(state: Column, n: Column, same, rest) -> Column:
        return F.when((F.length(state["a"]) >= n) & (F.length(state["b"]) >= n) & (same(state["a"], n) == same(state["b"], n)), F.struct(rest(state["a"], n).alias("a"), rest(state["b"], n).alias("b"))).otherwise(state)

    sizes = F.array(*map(F.lit, TRIMS))
    start = lambda x, n: F.substring(x, F.lit(1), n)
    after = lambda x, n: F.substring(x, n + 1, F.length(x))
    end = lambda x, n: F.substring(x, F.length(x) - n + 1, n)
    before = lambda x, n: F.substring(x, F.lit(1), F.length(x) - n)
    state = F.aggregate(sizes, F.struct(a.alias("a"), b.alias("b")), lambda x, n: less(x, n, start, after))
    return F.aggregate(sizes, state, lambda x, n: less(x, n, end, before))


def _confirmed(pairs: DataFrame, forms: DataFrame) -> DataFrame:
    """The pairs (a, b, k) at most k edits apart."""
    side = lambda n: forms.select(F.col("id").alias(n), F.col("form").alias(f"form_{n}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("x", F.explode(F.array(_untrimmed(F.col("form_a"), F.col("form_b")))))
    close = F.lit(False)
    for k in sorted({k for _, k in _bottoms()}):
        close = F.when(F.col("k") == k, banded_edits(F.col("x.a"), F.col("x.b"), k) <= k).otherwise(close)
    return both.filter(close).select("a", "b")


def _joining(pairs: DataFrame, forms: DataFrame, known: DataFrame | None) -> DataFrame:
    """node, component of what confirmed `pairs` and the links that are `known` join.

    At first each line meets one partner. Pairs that are then in one component say nothing new, and aren't compared.
    """
    first = cut(pairs.groupBy("b").agg(F.min(F.struct("a", "k")).alias("x")).select("x.a", "b", "x.k"))
    links = _confirmed(first, forms)
    found = connected_components(links if known is None else known.unionByName(links))
    side = lambda name: found.select(F.col("node").alias(name), F.col("component").alias(f"in_{name}"))
    apart = pairs.join(first, ["a", "b"], "left_anti").join(side("a"), "a", "left").join(side("b"), "b", "left")
    rest = cut(apart.filter(F.coalesce("in_a", "a") != F.coalesce("in_b", "b")).select("a", "b", "k"))
    return found if rest.isEmpty() else connected_components(star_links(found).unionByName(_confirmed(rest, forms)))


def rest_lengths(text: Column) -> Column:
    """How long a text is, and how long without the first, the first two, ... and all of LETTERS: an array."""
    left = lambda state: F.array_append(state["lengths"], F.length(state["rest"]))
    start = F.struct(text.alias("rest"), F.array().cast("array<int>").alias("lengths"))
    less = lambda state, c: F.struct(F.replace(state["rest"], c, F.lit("")).alias("rest"), left(state).alias("lengths"))
    return F.aggregate(F.array(*map(F.lit, LETTERS)), start, less, left)


def letter_counts(lengths: Column) -> list[Column]:
    """How often each of LETTERS, and then any other character, is in a text of such rest_lengths."""
    return [*(lengths[i] - lengths[i + 1] for i in range(len(LETTERS))), lengths[len(LETTERS)]]


def letter_codes(counts: list[Column]) -> list[Column]:
    """Counts modulo 8 in codes of four bits (0000, 0001, 0011, ... 1111, 1110, ... 1000), PACKED in a number.

    In such numbers as many bits differ as counts are apart around the circle of 8, which is never more than they are
    apart: so it rules out no pair that the counts themselves wouldn't, and up to 4 it is the same.
    """
    code = lambda n: F.shiftright(F.call_function("shiftleft", F.lit(15), n.bitwiseAND(F.lit(7))), 4).bitwiseAND(F.lit(15)).cast("long")
    out = []
    for at in range(0, len(counts), PACKED):
        number = F.lit(0).cast("long")
        for i, n in enumerate(counts[at : at + PACKED]):
            number = number.bitwiseOR(F.shiftleft(code(n), 4 * i))
        out.append(number)
    return out


def edit_links(documents: DataFrame, keyed: DataFrame) -> DataFrame | None:
    """h, g, node, first (the first line of its component) of the lines that share keys; None if none do."""
    spread = keyed.select("h", "g", "length", F.explode("keys").alias("key")).filter("key IS NOT NULL")
    lines = spread.groupBy("key").agg(F.min("h").alias("_low"), F.max("h").alias("_high"))
    shared = cut(lines.filter("_low != _high").select("key"))
    if shared.isEmpty():
        return None
    met = cut(_in(spread, "key", shared).groupBy("key", "h", "g").agg(F.max("length").alias("length")).join(shared, "key"))
    weights = met.groupBy("h", "g").agg(F.count("*").alias("keys"), F.collect_set("key").alias("of"))
    part = lambda name, n: [f"{name}{i}" for i in range(-(-n // PACKED))]
    every = len(LETTERS) + 1
    fronts, rears, counts = (part(name, every) for name in ("f", "r", "c"))
    forms = _forms(documents, cut(_first_lines(keyed, weights))).withColumns({"front": F.substring("form", 1, FRONT), "rear": F.substring("form", FRONT + 1, 2**31 - 1)})
    # generators keep the optimiser from counting anew for each use
    forms = forms.select("*", F.explode(F.array(F.struct(rest_lengths(F.col("front")).alias("f"), F.when(F.col("rear") != "", rest_lengths(F.col("rear"))).otherwise(F.array_repeat(F.lit(0), every)).alias("r")))).alias("n"))
    in_front, in_rear = letter_counts(F.col("n.f")), letter_counts(F.col("n.r"))
    coded = [c.alias(n) for names, of in ((fronts, in_front), (rears, in_rear), (counts, [x + y for x, y in zip(in_front, in_rear)])) for n, c in zip(names, letter_codes(of))]
    forms = cut(forms.select("h", "g", "node", "form", *coded).join(weights, ["h", "g"]).withColumn("id", F.monotonically_increasing_id()))  # written once, so ids stay
    rows = met.join(forms.select("h", "g", "id", "keys", "of", *fronts, *rears, *counts), ["h", "g"]).select("key", "id", "length", "keys", "of", *fronts, *rears, *counts)
    sizes = cut(rows.groupBy("key").agg(F.count("*").alias("n")))
    rows = cut(rows.join(sizes, "key"))
    short, long = rows.filter(F.col("n") <= LONG_GROUP), rows.filter(F.col("n") > LONG_GROUP)
    side = lambda df, name: df.select("key", *(F.col(c).alias(f"{c}_{name}") for c in ("id", "length", "of", *fronts, *rears, *counts, *(["component"] if "component" in df.columns else []))))
    total = lambda names: sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in names), F.lit(0))
    k = allowed(F.least("length_a", "length_b"))
    likely = (F.abs(F.col("length_a") - F.col("length_b")) <= k) & (total(counts) <= 2 * k) & (total([*fronts, *rears]) <= 3 * k)
    paired = lambda left, right, only, last=F.lit(True): side(left, "a").join(side(right, "b"), "key").filter(only & likely & last).select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), k.alias("k")).distinct()
    # a group's leaders are, of its lines by hash, those that share most keys
    best = long.groupBy("key", F.pmod(F.xxhash64("id"), F.lit(LEADERS)).alias("part")).agg(F.max(F.struct("keys", "id")).alias("best"))
    leaders = cut(best.select("key", F.col("best.id").alias("id"), "best.keys"))
    led = long.join(leaders.select("key", "id"), ["key", "id"])
    pairs = paired(led, long, F.col("id_a") != F.col("id_b")).unionByName(paired(short, short, F.col("id_a") < F.col("id_b"))).distinct()
    found = _joining(cut(pairs), forms, None)
    inside = cut(long.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id")))
    main = leaders.groupBy("key").agg(F.max(F.struct("keys", "id")).alias("best")).select("key", F.col("best.id").alias("id"))
    main = cut(main.join(inside.select("key", "id", F.col("component").alias("main")), ["key", "id"]).select("key", "main"))
    left = cut(inside.join(main, "key").filter("component != main").drop("main"))
    if not left.isEmpty():
        # a pair with several keys in common comes of the smallest; where that is a short group's, it has been compared
        once = F.col("key") == F.array_min(F.array_intersect("of_a", "of_b"))
        more = cut(paired(left, inside, F.col("component_a") != F.col("component_b"), once))
        found = _joining(more, forms, star_links(found))
    firsts = forms.select("h", "g", "node", "id").join(found.withColumnRenamed("node", "id"), "id")
    return cut(firsts.join(firsts.groupBy("component").agg(F.min("node").alias("first")), "component").select("h", "g", "node", "first"))


def _placed(docs: DataFrame) -> DataFrame:
    """`docs` with row_id and mark, which tell its documents apart; a missing id counts as the largest."""
    return docs.withColumns({"row_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)), "mark": F.coalesce(F.xxhash64("text"), F.lit(0)).bitwiseAND(F.lit(_POSITION - 1))})


def duplicate_lines(docs: DataFrame, short: bool = False) -> DataFrame:
    """row_id, mark, removed: the positions of the lines that go, for each document that loses some.

    A line goes if its class, its form or one linked to it, has an earlier line: in a smaller doc_id, or further up.
    Lines under MIN_CHARS characters are in no class, or with `short`, if they aren't blank, in that of equal forms.
    """
    documents = _documents(docs)
    with workspace(docs.sparkSession):
        keyed = cut_plain(_keyed(documents, short))
        linked = edit_links(documents, keyed)
        lines = keyed.filter("NOT again").select("row_id", "mark", "position", "h", "g")
        repeated = lines.groupBy("h", "g").agg(F.count("*").alias("n")).filter("n > 1").select("h", "g")
        if linked is not None:
            repeated = repeated.unionByName(linked.filter("node != first").select("h", "g")).distinct()
        repeated = cut(repeated)
        occurrences = cut_plain(_in(lines, "h", repeated).join(repeated, ["h", "g"]).withColumn("node", _node()))
        firsts = occurrences.groupBy("h", "g").agg(F.min("node").alias("first"))
        if linked is not None:
            firsts = firsts.join(linked.select("h", "g", F.col("first").alias("of_all")), ["h", "g"], "left").select("h", "g", F.coalesce("of_all", "first").alias("first"))
        firsts = cut(firsts)
        gone = occurrences.join(firsts, ["h", "g"]).filter("node != first")
        return cut(gone.groupBy("row_id", "mark").agg(F.collect_set("position").alias("removed")), keep=True)


OWN = ["_kept_text", "_lines", "_removed"]


def dedup_lines(docs: DataFrame, short: bool = False) -> DataFrame:
    """The rows of `docs`, all columns, with _kept_text, _lines and _removed (numbers of lines, and of those gone).

    Null text stays null, without lines. Of repeated rows (equal doc_id and text) each keeps the lines that one
    keeps. An empty table gives an empty result. With `short`, repeats of lines under MIN_CHARS go too. Input columns
    with one of the three names are replaced; others pass through, whatever their names.
    """
    return with_own(_deduped(docs, short), docs.columns, OWN)


def _deduped(docs: DataFrame, short: bool) -> DataFrame:
    gone = duplicate_lines(docs, short).select(F.col("row_id").alias("_row"), F.col("mark").alias("_mark"), F.col("removed").alias("_gone"))
    rows = _placed(docs.select(whole_row(docs), "doc_id", "text")).select("_all", F.col("row_id").alias("_row"), F.col("mark").alias("_mark"))
    key = F.struct(F.col("_row"), F.col("_mark"))
    rows = maybe_in(rows, key, gone, key)
    # only documents that may lose lines move
    still = rows.filter("NOT _maybe").select("_all", F.lit(None).cast("array<int>").alias("_gone"))
    held = still.unionByName(rows.filter("_maybe").join(gone, ["_row", "_mark"], "left").select("_all", "_gone"))
    text = F.col("_all").getField("text")
    # a generator keeps the optimiser from splitting the text anew for every line
    held = held.select("_all", "_gone", F.explode(F.array(F.split(text, "\n"))).alias("_split"))
    places = F.array_except(F.sequence(F.lit(0), F.size("_split") - 1), F.col("_gone"))
    rebuilt = F.array_join(F.transform(places, lambda p: F.element_at("_split", p + 1)), "\n")
    kept = F.when(F.col("_gone").isNull(), text).otherwise(rebuilt)
    lines = F.when(F.col("_split").isNull(), 0).otherwise(F.size("_split"))
    return held.select("_all", kept.alias("_kept_text"), lines.cast("long").alias("_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("_removed"))


def deduped_documents(docs: DataFrame) -> DataFrame:
    """`docs` with their kept text, short lines included; documents that had text and lose every line go.

    Null text stays; n_chars, where there is such a column, becomes the kept text's; all other columns stay as they are.
    """
    done = _deduped(docs, short=True).filter("_removed < _lines OR _removed = 0")
    new = {"text": F.col("_kept_text"), "n_chars": F.length("_kept_text").cast("long")}
    return done.select(*((new[n] if n in new else F.col("_all").getField(n)).alias(n) for n in docs.columns))
