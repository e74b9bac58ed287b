"""The archive's life cycle: what may be dropped, torn exports, changed days, restoring."""

import os
from datetime import date

import pytest

from tapline.sources import storage

DAYS = [date(2026, 1, d) for d in (1, 2, 3, 4)]


@pytest.fixture
def archive(spark, tmp_path):
    rows = [(i, f"row {i}", None if i % 3 else i / 7, DAYS[i % 4]) for i in range(40)]
    storage.write_partitioned(spark.createDataFrame(rows, "id long, text string, x double, ingest_day date"), f"{tmp_path}/hot")
    return storage.Archive(spark, f"{tmp_path}/hot", f"{tmp_path}/cold", f"{tmp_path}/manifest")


def status(archive):
    return {d: s.status for d, s in archive.states().items()}


def test_cycle(archive):
    assert archive.states() == {}
    assert archive.cycle(DAYS[3], DAYS[1]) == {"exported": 3, "verified": 3, "dropped": 1, "unverified": 0}
    assert status(archive) == {DAYS[0]: "deleted_hot", DAYS[1]: "verified", DAYS[2]: "verified"}
    assert archive.days() == DAYS[1:]
    assert archive.cycle(DAYS[3], DAYS[1]) == {"exported": 0, "verified": 0, "dropped": 0, "unverified": 0}
    before = sorted(archive.hot(DAYS[1]).collect())
    assert archive.drop(DAYS[1]) and archive.restore(DAYS[1]) == 10
    assert sorted(archive.hot(DAYS[1]).collect()) == before and archive.restore(DAYS[0]) == 10


def test_torn_export(archive):
    archive.export(DAYS[0])
    folder = archive.states()[DAYS[0]].path
    for name in os.listdir(folder):
        if name.startswith("part"):
            os.truncate(f"{folder}/{name}", 0)
    assert not archive.verify(DAYS[0])
    assert archive.cycle(DAYS[1], DAYS[3])["unverified"] == 1 and archive.days() == DAYS
    assert status(archive) == {DAYS[0]: "exported"}
    with pytest.raises(ValueError):
        archive.restore(DAYS[0])


def test_changed_day(archive, spark):
    more = spark.createDataFrame([(99, "late", 1.0, DAYS[0])], "id long, text string, x double, ingest_day date")
    archive.export(DAYS[0])
    storage.write_partitioned(more, archive.table)
    assert not archive.verify(DAYS[0]) and status(archive) == {DAYS[0]: "stale"}
    assert archive.cycle(DAYS[1], DAYS[0]) == {"exported": 1, "verified": 1, "dropped": 0, "unverified": 0}
    storage.write_partitioned(more, archive.table)
    assert not archive.drop(DAYS[0]) and status(archive) == {DAYS[0]: "stale"} and archive.days() == DAYS
    with pytest.raises(ValueError):
        archive.restore(DAYS[3])
