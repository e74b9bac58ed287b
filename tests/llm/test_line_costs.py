"""What line dedup's steps give and take: keys by bytes or characters, counts of letters, and what moves."""

import io
import re
from contextlib import redirect_stdout

from pyspark.sql import functions as F


def test_keys_are_the_same_by_bytes_and_characters(spark):
    from tapline.llm import linededup

    plain = "some words of a line that has only narrow letters, and enough of them for three edits, " * 2
    lines = [plain, plain[:-1] + "é", "é" + plain[1:], "€" * 200, plain[:70], plain[:69] + "𝔸"]
    frame = spark.createDataFrame([(i, x, 3) for i, x in enumerate(lines)], "id int, form string, k int")
    args = (F.col("k"), F.lit(128), F.lit(17))
    keys = {r.id: r.keys for r in frame.select("id", linededup.segment_keys(F.col("form"), F.length("form"), *args).alias("keys")).collect()}
    for i, line in enumerate(lines):
        want = []
        for way, j, s in linededup.places(3):
            at = max(0, 17 * j + s if way > 0 else len(line) - 17 * (j + 1) + s)
            want.append((way * (j + 1), line[at : at + 17]))
        made = spark.createDataFrame(want, "place int, part string").select("place", "part", F.xxhash64(F.lit(128), "place", "part").alias("key")).collect()
        assert keys[i] == [{(r.place, r.part): r.key for r in made}[w] for w in want]
    assert len(set(keys[0]) & set(keys[1])) == 7 and not set(keys[0]) & set(keys[3])


def test_letters_are_counted(spark):
    from tapline.llm import linededup

    texts = ["", "a", "zebra  crossing 0é𝔸", linededup.LETTERS * 3 + "--"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", linededup.rest_lengths(F.col("t")).alias("n"))
    for r in frame.select("t", F.array(*linededup.letter_counts(F.col("n"))).alias("n")).collect():
        each = [r.t.count(c) for c in linededup.LETTERS]
        assert r.n == [*each, len(r.t) - sum(each)]


def test_normal_forms(spark):
    from tapline.llm.linededup import normal_form

    lines = [" Page 1 of 907 ", "No digits HERE", "0", "", "9", "Ünter 12é"]
    frame = spark.createDataFrame([(x,) for x in lines], "x string")
    assert [r.f for r in frame.select(normal_form(F.col("x")).alias("f")).collect()] == [re.sub("[1-9]", "0", x.strip(" ").lower()) for x in lines]


def test_texts_move_once(spark):
    """A document that may lose lines is sent as its row alone, not with its text beside."""
    from tapline.llm.linededup import dedup_lines

    docs = spark.createDataFrame([(i, f"a line that all of them have\nand one of {'abcdefgh'[i] * 30}") for i in range(8)], "doc_id long, text string")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with redirect_stdout(out := io.StringIO()):
            dedup_lines(docs).explain("formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    sent = [re.sub(r"#\d+L?", "", x) for x in re.findall(r"\) Exchange\s*\nInput \[\d+\]: \[(.*?)\]\n", out.getvalue())]
    assert any("_all" in x for x in sent), sent
    assert not any("_all" in x and "text" in x for x in sent)
