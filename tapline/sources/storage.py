"""Stored history: partitioned tables, notifications without repeats, and a verified archive."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapline.operators.tables import latest_by_key
from tapline.sources.shared import remove_folder


def write_partitioned(df: DataFrame, path: str, day: str = "ingest_day") -> None:
    """Append rows under their day; dynamic pruning by day then reaches the files."""
    df.write.mode("append").partitionBy(day).parquet(path)


def to_notify(updates: DataFrame, sent: DataFrame, least_rank: int = 3) -> DataFrame:
    """New or escalated updates of at least a rank that were not sent before; repeated ids count once."""
    due = updates.filter(F.col("status").isin("new", "escalated") & (F.col("rank") >= least_rank)).dropDuplicates(["update_id"])
    return due.join(sent.select("update_id"), "update_id", "left_anti")


def export_partition(df: DataFrame, path: str) -> tuple[int, int]:
    """Write compressed JSON lines and return row count and an order-free checksum of what was written."""
    df.write.mode("overwrite").option("compression", "gzip").json(path)
    return fingerprint(df)


def fingerprint(df: DataFrame) -> tuple[int, int]:
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(F.to_json(F.struct(*sorted(df.columns)))).cast("decimal(38,0)")).alias("s")).first()
    return row.n, int(row.s or 0)


def verify_archive(spark: SparkSession, path: str, schema, expected: tuple[int, int]) -> bool:
    """Whether the archive, read back, has the rows that were exported."""
    return fingerprint(spark.read.schema(schema).json(path)) == expected


#: The manifest's log: each row is a step of a day, the largest step its state. Rows and digest are those exported.
MANIFEST = "day date, step long, status string, path string, n long, digest decimal(38,0)"
EXPORTED, VERIFIED, STALE, DROPPED = "exported", "verified", "stale", "deleted_hot"


class Archive:
    """A table partitioned by day, the archive of its closed days, and the manifest that says how far each has come.

    A closed day is exported, then verified by reading the archive back, then, once it is old enough, dropped from the
    table: never before what was read back agreed with the manifest, and the table still had the rows that were
    exported. A day that changed since is stale and exported anew. Every step is a row that is appended, so a cycle that
    stops anywhere goes on where it was.
    """

    def __init__(self, spark: SparkSession, table: str, archive: str, manifest: str, day: str = "ingest_day"):
        self.spark, self.table, self.archive, self.manifest, self.day = spark, table, archive, manifest, day

    def states(self) -> dict[date, object]:
        """The last manifest row of each day; there are as many as days."""
        try:
            rows = self.spark.read.schema(MANIFEST).parquet(self.manifest)
            return {r.day: r for r in latest_by_key(rows, ["day"], ["step"]).collect()}
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return {}
            raise

    def days(self) -> list[date]:
        return sorted(r[0] for r in self.spark.read.parquet(self.table).select(F.col(self.day).cast("date")).distinct().collect())

    def hot(self, day: date) -> DataFrame:
        return self.spark.read.parquet(self.table).filter(F.col(self.day) == F.lit(day)).drop(self.day)

    def _step(self, day: date, status: str, path: str, made: tuple[int, int]) -> None:
        last = self.states().get(day)
        row = (day, last.step + 1 if last else 0, status, path, made[0], made[1])
        self.spark.createDataFrame([(*row[:5], str(row[5]))], MANIFEST.replace("decimal(38,0)", "string")).withColumn("digest", F.col("digest").cast("decimal(38,0)")).write.mode("append").parquet(self.manifest)

    def export(self, day: date) -> None:
        """Write the day's rows to a new folder, so that an earlier export stays whole until the manifest moves on."""
        path = f"{self.archive}/day={day}/{uuid.uuid4().hex}"
        self._step(day, EXPORTED, path, export_partition(self.hot(day), path))

    def intact(self, state) -> bool:
        """Whether the archive, read back, has the manifest's rows and digest."""
        schema = self.spark.read.parquet(self.table).drop(self.day).schema
        return verify_archive(self.spark, state.path, schema, (state.n, int(state.digest)))

    def verify(self, day: date) -> bool:
        """Move an exported day on: to verified, or to stale if the table has other rows by now; else it stays exported."""
        state = self.states()[day]
        made = (state.n, int(state.digest))
        if not self.intact(state):
            return False
        same = fingerprint(self.hot(day)) == made
        self._step(day, VERIFIED if same else STALE, state.path, made)
        return same

    def drop(self, day: date) -> bool:
        """Remove a verified day from the table, if it still has the rows that were exported; else it is stale."""
        state = self.states()[day]
        made = (state.n, int(state.digest))
        if state.status != VERIFIED or fingerprint(self.hot(day)) != made:
            if state.status == VERIFIED:
                self._step(day, STALE, state.path, made)
            return False
        remove_folder(self.spark, f"{self.table}/{self.day}={day}")
        self._step(day, DROPPED, state.path, made)
        return True

    def cycle(self, closed_before: date, drop_before: date) -> dict[str, int]:
        """Take every closed day as far as it goes; how many were exported, verified, dropped, and are unverified."""
        done = dict.fromkeys(("exported", "verified", "dropped", "unverified"), 0)
        for day in (d for d in self.days() if d < closed_before):
            state = self.states().get(day)
            if state is None or state.status in (STALE, DROPPED):  # rows that came after the drop are a new day's work
                self.export(day)
                done["exported"] += 1
            if self.states()[day].status == EXPORTED:
                done["verified"] += self.verify(day)
            if self.states()[day].status != VERIFIED:
                done["unverified"] += 1
            elif day < drop_before:
                done["dropped"] += self.drop(day)
        return done

    def restore(self, day: date) -> int:
        """Put a dropped day's rows back into the table; an archive that isn't intact is refused. Returns the rows."""
        state = self.states().get(day)
        if state is None or not self.intact(state):
            raise ValueError(f"no intact archive of {day}")
        rows = self.spark.read.schema(self.hot(day).schema).json(state.path)
        rows.withColumn(self.day, F.lit(day)).write.mode("append").partitionBy(self.day).parquet(self.table)
        self._step(day, EXPORTED, state.path, (state.n, int(state.digest)))
        return state.n
