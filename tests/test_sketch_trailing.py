"""q_sketch_trailing against its SQL where a destination has more sources than a sketch keeps."""

import duckdb

from tapline.plans import registry


def test_more_sources_than_a_sketch_keeps(spark, tmp_path):
    rows = [(i, f"2024-01-01 {i % 9:02d}:00:00", i % 700, '{"k": 7}') for i in range(4000)] + [(5000 + i, f"2024-01-0{1 + i % 3} 12:30:00", i % 300, f'{{"k": {i % 2}}}') for i in range(900)]
    odd = [(9000, "2024-01-05 01:00:00", None, '{"k": 7}'), (9001, "2024-01-05 02:00:00", 3, "{}"), (9002, "2024-01-01 09:10:00", None, '{"k": 7}'), (9003, None, 4, '{"k": 7}')]
    frame = spark.createDataFrame(rows + odd, "event_id long, at string, user_id long, props string")
    frame.selectExpr("event_id", "CAST(at AS TIMESTAMP_NTZ) AS ts", "user_id", "'view' AS event_type", "1.0D AS value", "props").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    theirs = duck.sql(registry.ORACLE_SQL["q_sketch_trailing"]).fetchall()
    ours = [tuple(r) for r in registry.QUERIES["q_sketch_trailing"](spark, str(tmp_path)).select("k", "hour", "srcs5").collect()]
    assert sorted(ours, key=str) == sorted(theirs, key=str)
    assert max(r[2] for r in theirs) > 256 and (7, None, 0) in theirs
