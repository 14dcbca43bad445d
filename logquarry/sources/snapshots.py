"""Versioned tables: build beside the live one, then switch.

A version is a folder; the commit log is a small append-only table naming
versions that are complete.  Readers look at the log once per query, so a build
that fails or is interrupted is simply never seen, and recovery is reading the
last entry.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LOG_SCHEMA = "version bigint, n_rows bigint, note string"


class Snapshots:
    """One versioned table below ``path`` with a fixed schema."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, partition_by: Sequence[str] = ()):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.partition_by = list(partition_by)
        # An empty first entry makes the log readable; it is written only once.
        spark.createDataFrame([], LOG_SCHEMA).write.mode("ignore").parquet(f"{self.path}/commits/n=-1")

    def log(self) -> DataFrame:
        """All completed versions."""
        return self.spark.read.schema(f"{LOG_SCHEMA}, n bigint").parquet(f"{self.path}/commits").drop("n")

    def version(self) -> int | None:
        """The live version, None before the first."""
        return self.log().agg(F.max("version")).first()[0]

    def _folder(self, version: int) -> str:
        return f"{self.path}/v={version}"

    def read(self, version: int | None = None) -> DataFrame:
        """The live rows, or those of an older version."""
        live = self.version() if version is None else version
        if live is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self._folder(live))

    def build(self, rows: DataFrame, version: int | None = None) -> int:
        """Write a new version beside the live one without switching to it."""
        live = self.version()
        target = version if version is not None else (-1 if live is None else live) + 1
        writer = rows.select(*self.schema.names).write.mode("overwrite")
        (writer.partitionBy(*self.partition_by) if self.partition_by else writer).parquet(self._folder(target))
        return target

    def switch(self, version: int, note: str = "") -> None:
        """Make a built version the live one; a second call changes nothing."""
        count = self.read(version).count()
        entry = self.spark.createDataFrame([(version, count, note)], LOG_SCHEMA)
        entry.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/n={version}")

    def replace(self, rows: DataFrame, note: str = "", version: int | None = None) -> int:
        """Build and switch; readers see the old rows until the very end."""
        built = self.build(rows, version)
        self.switch(built, note)
        return built

    def replace_where(self, gone: Column, rows: DataFrame, note: str = "") -> int:
        """A new version with ``rows`` in the place of those that ``gone`` holds for; there may be none."""
        kept = self.read().where(~F.coalesce(gone, F.lit(False)))
        return self.replace(kept.unionByName(rows.select(*self.schema.names)), note)

    def clear(self) -> int:
        """Switch to an empty version."""
        return self.replace(self.spark.createDataFrame([], self.schema), "cleared")


def usable(catalog: DataFrame, derived: DataFrame, complete: bool) -> DataFrame:
    """One row: do derived columns match the catalog, or is a full set marked complete?"""
    sides = catalog.select(F.lit(1).alias("c"), F.lit(0).alias("d")).unionByName(
        derived.select(F.lit(0).alias("c"), F.lit(1).alias("d"))
    )
    counts = sides.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n_catalog"), F.coalesce(F.sum("d"), F.lit(0)).alias("n_derived")
    )
    same = F.col("n_catalog") == F.col("n_derived")
    return counts.withColumn("usable", same | (F.lit(complete) & (F.col("n_derived") > 0)))
