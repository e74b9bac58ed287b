"""Text in elements that aren't articles' usual ones."""


def test_elements_with_text_are_kept(spark):
    from tapline.llm.html import extract

    words = "the river rose slowly through the night and the town watched it from the bridge above the mill "
    block = f"<p>{words * 3}</p>"
    inside = f"<p>{words} where <math><mi>xvar</mi><mo>=</mo><mn>42</mn></math> holds</p><object><p>objecttext {words}</p></object><noscript><p>noscripttext {words}</p></noscript>"
    page = f"<html><body><nav><a href='/'>Home</a></nav><article>{block}{inside}<svg viewBox='0'/><video src='x'>{block}<p>lastwords {words}</p></article><footer>Imprint</footer></body></html>"
    text = extract(spark.createDataFrame([(1, "u", page, "x")], "page_id long, url string, html string, text string")).first().text
    assert all(w in text for w in ("xvar=42", "objecttext", "noscripttext", "lastwords"))


WORDS = "the river rose slowly through the night and the town watched it from the bridge above the mill "


def texts_of(spark, pages):
    from tapline.llm.html import extract

    rows = extract(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").selectExpr("page_id", "'u' AS url", "html")).collect()
    return [r.text for r in sorted(rows, key=lambda r: r.page_id)]


def test_tags_that_may_be_left_out(spark):
    article = f"<article><h1>Title here</h1><p>{WORDS * 3}</p><p>lastwords {WORDS}</p></article>"
    whole, *others = texts_of(
        spark,
        [
            f"<html><head><title>x</title></head><body>{article}</body></html>",
            f"<html><head><title>x</title>{article}</html>",
            f"<title>x</title><meta charset=utf-8>{article}",
            f"<html><head><title>x</title><!-->{article}<!--- end --->",
            f"<html><head><!-- a > b --><style>p > a {{}}</style><body>{article}<!--->",
            f"<html><body><![CDATA[ x > {article}",
            f"<html><body>{article}<template><p>never closed",
            f"<html><body><!-- one --!>{article}",
        ],
    )
    assert "lastwords" in whole and whole.startswith("Title here")
    for text in others:
        assert whole in text and len(text) < len(whole) + 20


def test_text_ends_the_head(spark):
    (text,) = texts_of(spark, [f"<head><title>x</title>{WORDS * 4}<p>lastwords {WORDS}</p>"])
    assert "lastwords" in text


def test_best_choice_of_all():
    """The tree programme against all consistent choices of small trees."""
    import itertools
    import random

    import numpy as np

    from tapline.llm.html import Page, decode

    r = random.Random(3)
    for _ in range(60):
        page = Page("")
        n = r.randint(2, 9)
        page.parent = [-1, *(r.randrange(i) for i in range(1, n))]
        p = np.array([r.uniform(0.01, 0.99) for _ in range(n)])
        score = lambda kept: sum(np.log(p[i] if kept[i] else 1 - p[i]) for i in range(1, n))  # noqa: B023, E731
        choices = [(True, *c) for c in itertools.product((False, True), repeat=n - 1)]
        consistent = [c for c in choices if all(c[page.parent[i]] or not c[i] for i in range(1, n))]
        assert abs(score(decode(page, p)) - max(map(score, consistent))) < 1e-9
        assert tuple(decode(page, p)) in consistent
