"""Near-duplicates by row: null and repeated ids."""


def test_near_duplicate_stage_decides_by_row(spark):
    import corpus_pipeline

    own = lambda k: " ".join(f"{k}w{i}" for i in range(30))
    docs = [(None, own("a")), (None, own("b")), (5, own("b")), (6, own("c")), (6, own("c")), (7, own("d")), (7, own("e")), (None, own("f")), (None, own("f")), (8, own("e") + " more"), (9, ""), (10, None)]
    frame = spark.createDataFrame([(i, t, len(t or "")) for i, t in docs], "doc_id long, text string, n_chars long")
    got = corpus_pipeline.near_duplicate_stage(spark, frame, "")
    assert got.columns == frame.columns
    expected = [(None, own("a")), (5, own("b")), (6, own("c")), (7, own("d")), (7, own("e")), (None, own("f")), (9, ""), (10, None)]
    assert sorted(map(str, ((x.doc_id, x.text) for x in got.collect()))) == sorted(map(str, expected))


def test_a_repeated_id_is_confirmed_by_each_text(spark):
    from tapline.llm.neardup import confirmed

    own = lambda k: " ".join(f"{k}w{i}" for i in range(30))
    for order in ("xy", "yx"):
        texts = spark.createDataFrame([(1, own(order[0])), (1, own(order[1])), (2, own("y"))], "gid long, text string").coalesce(1)
        assert {tuple(x) for x in confirmed(spark.createDataFrame([(1, 2)], "a long, b long"), texts, 5, 80).collect()} == {(1, 2)}
