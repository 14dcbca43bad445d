"""Tables written batch by batch, safe to replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from logquarry.operators.changes import last_per_key
from logquarry.plans.skew import checked_broadcast

# Batches between two folds of a table.
FOLD_EVERY = 20


class BatchTable:
    """One folder per micro-batch; a replayed batch overwrites its own folder."""

    def __init__(
        self, spark: SparkSession, path: str, schema: StructType | str, first: DataFrame | None = None, fold_every: int = FOLD_EVERY
    ):
        self.spark, self.path, self.fold_every = spark, path.rstrip("/"), fold_every
        if isinstance(schema, str):
            schema = spark.createDataFrame([], schema).schema
        self.schema = schema
        self._full = StructType([*schema.fields, StructField("batch_id", LongType())])
        # A first folder makes the table readable; a table reopened keeps its own.
        begun = spark.createDataFrame([], schema) if first is None else first
        begun.select(*schema.names).write.mode("ignore").parquet(f"{self.path}/batch_id=-1")

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """Write one batch."""
        rows.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}/batch_id={batch_id}")

    def read(self, before: int | None = None) -> DataFrame:
        """All batches, or those before the given one."""
        rows = self.spark.read.schema(self._full).option("basePath", self.path).parquet(self.path)
        return rows if before is None else rows.where(F.col("batch_id") < before)

    def latest(self, keys: list[str]) -> DataFrame:
        """The row of the newest batch for each key."""
        return last_per_key(self.read(), keys, "batch_id").drop("batch_id")

    def state(self, keys: list[str], before: int) -> DataFrame:
        """The newest row of each key before a batch, from the last fold and the few batches behind it.

        A handler that calls :meth:`fold` in every batch reads a bounded number of folders, however many batches
        there were.  Deltas are small beside the base, which is scanned and not shuffled.
        """
        # The last fold that a batch before this one has made.
        base_id = (before - 1) // self.fold_every * self.fold_every - 1
        base = self._base(base_id)
        deltas = self.read().where((F.col("batch_id") > base_id) & (F.col("batch_id") < before))
        newest = last_per_key(deltas, keys, "batch_id").drop("batch_id")
        small = checked_broadcast(newest.select(*keys))
        kept = base.join(newest.select(*keys) if small is None else small, keys, "left_anti")
        return kept.unionByName(newest)

    def fold(self, keys: list[str], batch_id: int) -> None:
        """At every ``fold_every``-th batch, write the state before it as a new base.

        Batches before this one are complete, so a replayed batch writes the same base again.
        """
        if batch_id > 0 and batch_id % self.fold_every == 0:
            # The base before this one: what the batch before began from, and its own rows.
            older = self._base(batch_id - self.fold_every - 1)
            deltas = self.read().where((F.col("batch_id") >= max(0, batch_id - self.fold_every)) & (F.col("batch_id") < batch_id))
            newest = last_per_key(deltas, keys, "batch_id").drop("batch_id")
            folded = older.join(newest.select(*keys), keys, "left_anti").unionByName(newest)
            rows = folded.where(~F.col("gone")) if "gone" in self.schema.names else folded
            rows.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}_base/upto={batch_id - 1}")

    def _base(self, upto: int) -> DataFrame:
        """The rows folded up to a batch; up to none, what the table began with."""
        folder = f"{self.path}/batch_id=-1" if upto < 0 else f"{self.path}_base/upto={upto}"
        return self.spark.read.schema(self.schema).parquet(folder)

    def previous(self, batch_id: int) -> DataFrame:
        """Rows written by the batch just before this one.

        Batch numbers follow each other; batch -1 is what the table began with.
        """
        return self.read().where(F.col("batch_id") == batch_id - 1).drop("batch_id")
