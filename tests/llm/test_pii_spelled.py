"""Spelled-out addresses in capitals."""


def test_spelled_out_addresses_in_capitals(spark):
    from tapline.llm import pii

    assert [m[1:3] for m in pii.mentions("WRITE TO JOHN [AT] EXAMPLE [DOT] ORG SOON") if m[-1] == "at"]
    assert [m[3] for m in pii.mentions("or john(At)example.org now") if m[-1] == "at"] == ["john(At)example.org"]
