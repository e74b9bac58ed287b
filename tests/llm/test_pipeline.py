"""The corpus pipeline, stage by stage, each against plain versions of its decision on the stage's own input."""

import re
from collections import Counter

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    import corpus_pipeline

    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        out[name] = docs = spark.read.parquet(f"{folder}/{name}")
    return out


def test_columns(tables):
    names = tables["documents"].columns
    assert all(tables[n].columns == names for n in ("quality", "line_dedup", "near_dedup", "mixing"))
    assert {"doc_id", "n_tokens", "ids_sha256", "ids"} <= set(tables["encoding"].columns)


def test_quality_keeps_good_documents(spark, tables):
    labels = {x.doc_id: x.quality for x in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {x.doc_id for x in tables["quality"].collect()}
    good, bad = [i for i, q in labels.items() if q], [i for i, q in labels.items() if not q]
    assert sum(i in kept for i in good) >= 0.95 * len(good) and sum(i in kept for i in bad) <= 0.4 * len(bad)


def test_lines_occur_once(tables):
    from tapline.llm.linededup import MIN_CHARS

    form = lambda s: s.strip(" ").lower().translate(str.maketrans("123456789", "0" * 9))
    seen = Counter(f for x in tables["line_dedup"].collect() for f in map(form, x.text.split("\n")) if len(f) >= MIN_CHARS)
    before = {f for x in tables["quality"].collect() for f in map(form, x.text.split("\n")) if len(f) >= MIN_CHARS}
    assert max(seen.values()) == 1 and set(seen) <= before
    assert all(x.n_chars == len(x.text) for x in tables["line_dedup"].collect())


def test_no_near_duplicates_are_left(tables):
    def shingles(text):
        words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
        n = min(5, len(words))
        return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else frozenset()

    before = {x.doc_id: shingles(x.text) for x in tables["line_dedup"].collect()}
    kept = {x.doc_id for x in tables["near_dedup"].collect()}
    alike = lambda a, b: a and 5 * len(a & b) >= 4 * len(a | b)
    ids = sorted(before)
    assert not any(alike(before[i], before[j]) for i in kept for j in kept if i < j)
    for i in set(ids) - kept:
        assert any(alike(before[i], before[j]) for j in ids if j != i)


def test_mix_and_tokens(tables):
    import public_tokenizers
    from tokenizers import Tokenizer

    before = {x.doc_id: x for x in tables["near_dedup"].collect()}
    copies = Counter(x.doc_id for x in tables["mixing"].collect())
    assert set(copies) <= set(before) and max(copies.values()) <= 3
    words = Counter()
    for i, n in copies.items():
        words[before[i].source] += n * len(before[i].text.split())
    ranked = sorted({x.source for x in before.values()})
    whole = sum(len(re.findall(r"[^\x20\x09-\x0D]+", x.text)) for x in before.values())
    assert abs(sum(words.values()) - whole) <= 0.02 * whole and words[ranked[0]] > words[ranked[2]]
    theirs = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = tables["encoding"].collect()
    assert Counter(x.doc_id for x in rows) == copies
    assert all(x.ids == theirs.encode(before[x.doc_id].text, add_special_tokens=False).ids for x in rows)


def test_run(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SF)
    assert rows.count() > 0 and corpus_pipeline.ORACLE_SQL is None


def test_columns_without_order(spark):
    """Columns that can't be compared pass through every stage."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, text, "a"), (1, text, "a"), (2, text, "b"), (3, "other words entirely", None)], "doc_id long, text string, source string")
    docs = docs.withColumn("extra", F.create_map(F.lit("k"), F.col("source"))).withColumn("mixed", F.try_parse_json(F.lit('{"a": 1}')))
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, SF)
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == [1, 3] and kept.columns == docs.columns
