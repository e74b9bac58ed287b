"""Connected components take no round over links that are stars already."""

import pytest


@pytest.mark.parametrize("edges, rounds", [([], 0), ([(1, 2), (3, 1), (1, 1), (2, 1), (None, 4), (5, None), (6, 7)], 0), ([(2, 3), (3, 1)], 1), ([(1, 2), (2, 3), (3, 1)], 1)])
def test_rounds(spark, monkeypatch, edges, rounds):
    from tapline.llm import components

    taken, star = [], components._star
    monkeypatch.setattr(components, "_star", lambda links, large: taken.append(large) or star(links, large))
    found = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    root = {n: n for e in edges if None not in e and e[0] != e[1] for n in e}
    for _ in edges:
        for a, b in (e for e in edges if None not in e and e[0] != e[1]):
            root[a] = root[b] = min(root[a], root[b])
    assert sorted((x.node, x.component) for x in found) == sorted(root.items()) and len(taken) == 2 * rounds


def test_star_links_join_what_was_joined(spark):
    from tapline.llm.components import connected_components, star_links

    found = connected_components(spark.createDataFrame([(i, i + 1) for i in range(9)] + [(20, 30)], "a long, b long"))
    assert sorted(map(tuple, star_links(found).collect())) == [(0, i) for i in range(1, 10)] + [(20, 30)]
    assert sorted(connected_components(star_links(found)).collect()) == sorted(found.collect())
