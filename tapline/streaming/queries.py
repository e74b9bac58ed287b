"""Structured Streaming twins of batch operators: event-time windows, deduplication and stateful incidents."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tapline.functions.columns import micros
from tapline.operators import incidents
from tapline.sources.shared import remove_folder, shared_folder
from tapline.streaming.stateful import rocks

#: How late a row may come before it is dropped.
LATENESS = "10 minutes"


def event_stream(spark: SparkSession, sf_dir: str, lateness: str = LATENESS) -> DataFrame:
    """The events table as a stream with event time `ts`, late by `lateness` at most."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.timestamp_micros(micros("ts"))).withWatermark("ts", lateness)


def drain(stream: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Run a stream over all that is there, each batch into a folder of its own, and read back the results.

    A batch that is repeated after a failure overwrites its folder, so results count once. With keys, the last batch
    that reported a key wins.
    """
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    with rocks(spark):
        query = stream.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    remove_folder(spark, f"{folder}/state")
    rows = spark.read.parquet(f"{folder}/out")
    if keys:
        rest = [c for c in stream.columns if c not in keys]
        rows = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")
        return rows
    return rows.drop("batch")


def split_late(stream: DataFrame, at: str, delay_ms: int) -> tuple[DataFrame, DataFrame]:
    """Drain a stream into two outputs: the rows in time, and those that stateful operators would drop unseen.

    `at` is event time in ms. A row is late if it isn't past the watermark of the batches before its own: their newest
    time less `delay_ms`. The watermark that a batch is judged by is written before its rows, so a batch that is repeated
    after a failure is split as before; each row is in exactly one output. Rows without a time are in time.
    """
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    marks = "batch long, newest long"

    def newest(before: int) -> int | None:
        try:
            return spark.read.schema(marks).parquet(f"{folder}/marks").filter(F.col("batch") < before).agg(F.max("newest")).first()[0]
        except AnalysisException:  # no batch has ended yet
            return None

    def save(batch: DataFrame, number: int) -> None:
        last = newest(number)
        late = F.lit(False) if last is None else F.coalesce(F.col(at) <= last - delay_ms, F.lit(False))
        batch.withColumn("late", late).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
        top = batch.agg(F.max(at)).first()[0]
        if top is not None:
            spark.createDataFrame([(number, top)], marks).coalesce(1).write.mode("overwrite").parquet(f"{folder}/marks/of={number}")

    query = stream.writeStream.foreachBatch(save).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    remove_folder(spark, f"{folder}/state")
    rows = spark.read.parquet(f"{folder}/out").drop("batch")
    return rows.filter("NOT late").drop("late"), rows.filter("late").drop("late")


def tumbling_counts(events: DataFrame, width: str = "1 day") -> DataFrame:
    counts = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.max("value").alias("largest"))
    return counts.select(F.expr("unix_micros(w.start) div 1000000").alias("start_s"), "event_type", "n", "largest")


def deduplicated(events: DataFrame) -> DataFrame:
    """Events once each, however often they are replayed within the lateness."""
    return events.dropDuplicatesWithinWatermark(["event_id"])


def session_counts(events: DataFrame, gap: str = "12 hours") -> DataFrame:
    counts = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return counts.select("user_id", F.expr("unix_micros(w.start)").alias("start_us"), "n")


class IncidentProcessor(StatefulProcessor):
    """One incident's state per class and entity; a timer at its idle end resolves it."""

    def __init__(self, idle: int, cooldown: int):
        self.idle, self.cooldown = idle, cooldown

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("incident", incidents.STATE)

    def _rows(self, key, reports) -> pd.DataFrame:
        names = [c.split(" ")[0] for c in incidents.UPDATES.split(", ")]
        return pd.DataFrame([(*key, *r) for r in reports], columns=names)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        del timerValues
        idle = incidents.idle_of(key[0], self.idle)
        state = tuple(self.state.get()) if self.state.exists() else None
        for piece in rows:
            reports = []
            for r in piece.sort_values(["obs_ms", "window_start_ms", "rank", "subtype", "evidence"]).itertuples(index=False):
                state, more = incidents.advance(state, (int(r.window_start_ms), int(r.obs_ms), int(r.rank), r.subtype, int(r.evidence)), idle, self.cooldown)
                reports += more
            yield self._rows(key, reports)
        self.state.update(state)
        self.handle.registerTimer(state[4] + idle)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        del timerValues
        state = tuple(self.state.get()) if self.state.exists() else None
        if state is not None and state[4] + incidents.idle_of(key[0], self.idle) <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
            yield self._rows(key, [incidents.closing(state)])
        else:
            yield self._rows(key, [])

    def close(self) -> None:
        pass


def incident_updates(findings: DataFrame, idle: int = incidents.IDLE_MS, cooldown: int = incidents.COOLDOWN_MS) -> DataFrame:
    """Updates of incidents, each piece of a key's findings in time order, from a stream of findings with event time `ts`. The state store must be RocksDB (`rocks`)."""
    keyed = incidents.typed(findings).groupBy(*incidents.KEYS)
    made = keyed.transformWithStateInPandas(IncidentProcessor(idle, cooldown), incidents.UPDATES, "append", "eventTime")
    return incidents.identified(made)
