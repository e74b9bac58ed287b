"""Line dedup beyond one edit, and of short lines."""

import random

from test_brute_force import distance, varied


def test_longer_lines_may_be_more_edits_apart(spark):
    from tapline.llm.linededup import dedup_lines

    r = random.Random(5)
    line = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n)).replace(" ", "_")
    lines = []
    for n in (62, 63, 64, 66, 90, 126, 127, 128, 130, 200, 300):
        for _ in range(3):
            lines.append(line(n))
            for edits in range(1, 6):
                copy = lines[-1] if r.random() < 0.3 else r.choice(lines[-edits:])
                for _ in range(edits):
                    copy = varied(r, copy, "xyz")
                lines.append(copy)
    lines += [varied(r, lines[-9], "xyz") for _ in range(40)]  # more than one group pairs
    r.shuffle(lines)
    root = list(range(len(lines)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    most = lambda n: 3 if n >= 128 else 2 if n >= 64 else 1
    for i, a in enumerate(lines):
        for j, b in enumerate(lines[:i]):
            k = most(min(len(a), len(b)))
            if abs(len(a) - len(b)) <= k and distance(a, b) <= k:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    found = {x.doc_id: x._removed for x in dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()}
    assert found == {i: int(find(i) != i) for i in range(len(lines))} and 0 < sum(found.values()) < len(lines)


def test_short_lines_repeat(spark):
    from tapline.llm.linededup import dedup_lines

    docs = [(1, "All rights reserved.\n\n \t\nHome"), (2, "home\n\n \t\nall rights reserved.\nAll rights reserve."), (3, "Home")]
    found = {x.doc_id: (x._kept_text, x._removed) for x in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), short=True).collect()}
    assert found == {1: (docs[0][1], 0), 2: ("\n \t\nAll rights reserve.", 2), 3: ("", 1)}


def test_codes_never_rule_out_more_than_counts(spark):
    from pyspark.sql import functions as F

    from tapline.llm.linededup import PACKED, letter_codes

    frame = spark.range(40).select(F.col("id").cast("int").alias("n"))
    codes = {r.n: r for r in frame.select("n", *(c.alias(f"c{i}") for i, c in enumerate(letter_codes([F.col("n") + i for i in range(PACKED + 1)])))).collect()}
    for a, x in codes.items():
        for b, y in codes.items():
            apart = min((a - b) % 8, (b - a) % 8)
            assert [(p ^ q).bit_count() for p, q in zip(x[1:], y[1:])] == [PACKED * apart, apart]


def test_lines_that_meet_are_narrow(spark, monkeypatch):
    from tapline.llm import linededup

    r, cut, widths = random.Random(8), linededup.cut, []
    monkeypatch.setattr(linededup, "cut", lambda df, keep=False: widths.append(len(df.columns)) or cut(df, keep))
    line = "a line that is quite long, and is here with other edits " * 3
    docs = [(i, varied(r, line, "xyz")) for i in range(12)]
    assert sum(x._removed for x in linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()) == 11
    assert max(widths) <= 16
