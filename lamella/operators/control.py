"""Control tables: what was last seen of each source, run for each model, and found by each test.

Tasks that run at the same time record into them without waiting for each other: a record is only ever added, as
a folder of its own that appears by one rename, and says which columns it means to set. The state is worked
out when it is read: of each key, and of each column, the newest record that set it. Compaction is a step of its own. It
keeps the records that still decide some column, as they are, so records added meanwhile lose nothing.

"Newest" is the clock of the program that records; records of the same microsecond are told apart by their ids.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.operators.roles import ident
from lamella.session import folders, remove, rename

# Columns of the control tables and what they are partitioned by.
SCHEMAS = {
    "model_dates": (
        "model_id string, event_date date, etl_timestamp timestamp_ntz, optimize_timestamp timestamp_ntz, "
        "vacuum_timestamp timestamp_ntz, run_dates array<date>, run_message string, run_rows bigint, "
        "run_seconds double, run_status string"
    ),
    "sources": "source_id string, properties string, etl_active boolean",
    "source_dates": (
        "source_id string, event_date date, event_count bigint, partition_dates array<date>, "
        "etl_timestamp timestamp_ntz"
    ),
    "test_dates": (
        "test_id string, model_id string, event_date date, etl_timestamp timestamp_ntz, "
        "test_dates array<date>, test_message string, test_rows bigint, test_seconds double, "
        "test_status string"
    ),
}
PARTITIONED_BY = {
    "model_dates": "model_id",
    "sources": "etl_active",
    "source_dates": "source_id",
    "test_dates": "model_id",
}
KEYS = {
    "model_dates": ["model_id", "event_date"],
    "sources": ["source_id"],
    "source_dates": ["source_id", "event_date"],
    "test_dates": ["test_id", "model_id", "event_date"],
}


#: What a record says about itself: when and by which record it was made, and the columns it sets.
RECORD = "recorded_at timestamp_ntz, record_id string, sets array<string>"


class ControlTables:
    """The control tables of one project, stored under ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def schema(self, name: str) -> T.StructType:
        return T.StructType.fromDDL(SCHEMAS[name])

    def _folders(self, name: str) -> list[str]:
        """The folders of records that are complete."""
        return [f for f in folders(self.spark, f"{self.root}/{name}") if f.rsplit("/", 1)[-1].startswith("record=")]

    def _records(self, name: str, among: Sequence[str] | None = None) -> DataFrame:
        whole = T.StructType([*self.schema(name), *T.StructType.fromDDL(RECORD)])
        found = self._folders(name) if among is None else among
        if not found:
            return self.spark.createDataFrame([], whole)
        return self.spark.read.schema(whole).option("basePath", f"{self.root}/{name}").parquet(*found).select(*whole.names)

    def read(self, name: str) -> DataFrame:
        """The state: one row for each key."""
        keys, records = KEYS[name], self._records(name)
        values = [f.name for f in self.schema(name) if f.name not in keys]
        newest = [F.max_by(F.col(ident(c)), _rank(c)).alias(c) for c in values]
        state = records.groupBy(*keys).agg(*newest)
        return state.select(*[ident(f.name) for f in self.schema(name)])

    def _record(self, name: str, rows: DataFrame, sets: Sequence[str]) -> None:
        """Add a record; of a key that is known it sets the given columns, of a new one all."""
        schema, own = self.schema(name), uuid.uuid4().hex
        whole = rows.select(
            *[
                (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                for f in schema
            ],
            F.lit(dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)).cast("timestamp_ntz").alias("recorded_at"),
            F.lit(own).alias("record_id"),
            F.array(*[F.lit(c) for c in sets]).alias("sets"),
        )
        hidden = f"{self.root}/{name}/_record={own}"
        self._write(name, whole, hidden)
        twice = self._records(name, [hidden]).groupBy(*KEYS[name]).count().where("count > 1")
        if not twice.isEmpty():
            remove(self.spark, hidden)
            raise ValueError(f"rows to record repeat their key {KEYS[name]}")
        rename(self.spark, hidden, f"{self.root}/{name}/record={own}")

    def _write(self, name: str, rows: DataFrame, path: str) -> None:
        # A record is small; one file for each partition it holds.
        rows.hint("rebalance", PARTITIONED_BY[name]).write.partitionBy(PARTITIONED_BY[name]).parquet(path)

    def compact(self, name: str, forget: bool = True) -> list[str]:
        """Keep only the records that decide a column of some key, in one folder; returns the folders it replaces.

        Records added meanwhile are not touched, and none that is kept changes, so the state stays what it is at every
        moment. With ``forget=False`` the replaced folders are left for readers that have listed them before;
        ``forget`` removes them.
        """
        old = self._folders(name)
        if len(old) < 2:
            return []
        keys, records = KEYS[name], self._records(name, old)
        values = [f.name for f in self.schema(name) if f.name not in keys]
        deciding = records.groupBy(*keys).agg(
            F.array_distinct(F.array(*[F.max_by("record_id", _rank(c)) for c in values])).alias("deciding")
        )
        same = F.lit(True)
        for k in keys:
            same = same & F.col(ident("r", k)).eqNullSafe(F.col(ident("d", k)))
        joined = records.alias("r").join(deciding.alias("d"), same)
        kept = joined.where(F.array_contains("deciding", F.col("record_id"))).select("r.*")
        own = uuid.uuid4().hex
        self._write(name, kept, f"{self.root}/{name}/_record={own}")
        rename(self.spark, f"{self.root}/{name}/_record={own}", f"{self.root}/{name}/record={own}")
        if forget:
            self.forget(old)
        return old

    def forget(self, replaced: Sequence[str]) -> None:
        """Remove folders that a compaction has replaced."""
        for folder in replaced:
            remove(self.spark, folder)

    def register_sources(self, rows: DataFrame, keep_active: bool = True) -> None:
        """Add sources or renew their properties; a known source keeps its active flag by default."""
        if "etl_active" not in rows.columns:
            rows = rows.withColumn("etl_active", F.lit(False))
        self._record("sources", rows, ["properties"] if keep_active else ["properties", "etl_active"])

    def record_source_dates(self, rows: DataFrame) -> None:
        """Remember what was seen on each event date of a source."""
        self._record("source_dates", rows, ["event_count", "partition_dates", "etl_timestamp"])

    def record_model_dates(self, rows: DataFrame) -> None:
        """Remember the outcome of model runs; compaction times of earlier runs stay."""
        names = ["etl_timestamp", "run_dates", "run_message", "run_rows", "run_seconds", "run_status"]
        self._record("model_dates", rows, names)

    def record_test_dates(self, rows: DataFrame) -> None:
        """Remember the outcome of tests."""
        names = ["etl_timestamp", "test_dates", "test_message", "test_rows", "test_seconds", "test_status"]
        self._record("test_dates", rows, names)

    def record_compaction(self, rows: DataFrame) -> None:
        """Set the compaction time of (model_id, event_date, optimize_timestamp) rows."""
        self._record("model_dates", rows, ["optimize_timestamp"])


def _rank(column: str) -> Column:
    """Which record decides a column of a key: the newest that sets it, else the first of all, which added the key."""
    sets = F.array_contains("sets", F.lit(column))
    micros = F.unix_micros(F.col("recorded_at").cast("timestamp"))
    return F.struct(sets.alias("sets"), F.when(sets, micros).otherwise(-micros).alias("at"), F.col("record_id").alias("by"))
