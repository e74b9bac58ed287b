"""The name classifier over all pages."""


def test_every_page_is_classified(spark, tmp_path):
    from tapline.plans.ladders import q_name_classifier

    pages = [(i - 20 if i < 60 else None, f"https://{'abcdefgh'[i % 8]}{'lmnopqr'[i % 7]}ing{i}.example.org/x") for i in range(70)]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = q_name_classifier(spark, str(tmp_path)).collect()
    key = lambda i: (i is None, i or 0)
    assert sorted((x.page_id for x in got), key=key) == sorted((i for i, _ in pages for _ in range(2)), key=key)
