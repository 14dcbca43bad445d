"""Stored posting lists of a catalog: search without a scan of the catalog.

For every name token the index holds the catalog rows with it, and for every three-character window of
name and path the paths with it.  Lists are clustered by key: in folders by a hash of the key, in files
sorted by key, so a query reads the files of its keys alone.  A table of list sizes tells the rarest key of
a query; only its list is read, and the other keys are checked on the rows themselves.

A later version of the catalog adds a delta: lists of the rows that came, and the paths whose older rows
count no more.  ``build`` folds everything into a new base.  What is not committed is never seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from logquarry.functions.text import name_tokens, query_terms, query_tokens, trigrams
from logquarry.operators.search import has_substrings, has_tokens, query_trigrams, type_filter, uses_path_search
from logquarry.plans.skew import checked_broadcast
from logquarry.session import materialize

BUCKETS = 256
COMMITS = "version bigint, base bigint"


def bucket_of(key: Column) -> Column:
    """The folder of a key; of a literal, a constant that prunes."""
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


class Postings:
    """The posting lists below ``path`` of catalogs with this schema."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType):
        self.spark, self.path, self.columns = spark, path.rstrip("/"), schema
        self._row = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        # An empty first entry makes the log readable; it is written only once.
        spark.createDataFrame([], COMMITS).write.mode("ignore").parquet(f"{self.path}/commits/n=-1")

    # --- writing ---

    def build(self, catalog: DataFrame, version: int) -> None:
        """Write the lists of a whole catalog as a new base."""
        self._write(catalog, catalog.select("path").limit(0), version)
        self._commit(version, version)

    def add(self, rows: DataFrame, gone: DataFrame, version: int) -> None:
        """Write a delta: ``rows`` that are new or changed, and ``gone``, the paths of rows that were removed."""
        base = self.state()[0]
        if base is None:
            raise ValueError("there is no base to add to")
        self._write(rows, gone.select("path").unionByName(rows.select("path")).distinct(), version)
        self._commit(version, base)

    def _write(self, rows: DataFrame, replaced: DataFrame, version: int) -> None:
        rows = rows.select(*self.columns.names)
        tokens = rows.select(F.explode(name_tokens(F.col("name"))).alias("key"), *self.columns.names)
        grams = rows.select(F.explode(F.array_distinct(trigrams(F.lower(F.concat_ws(" ", "name", "path"))))).alias("key"), "path")
        for name, lists in (("tokens", tokens), ("grams", grams)):
            placed = lists.withColumn("bucket", bucket_of(F.col("key")))
            # By range, so that a key of very many rows fills files of its own.
            ordered = placed.repartitionByRange("bucket", "key", "path").sortWithinPartitions("bucket", "key", "path")
            ordered.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}/version={version}")
            sizes = placed.groupBy("bucket", "key").agg(F.count(F.lit(1)).alias("n"))
            sizes.repartition("bucket").sortWithinPartitions("key").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}_sizes/version={version}")
        replaced.write.mode("overwrite").parquet(f"{self.path}/gone/version={version}")

    def _commit(self, version: int, base: int) -> None:
        entry = self.spark.createDataFrame([(version, base)], COMMITS)
        entry.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/n={version}")

    # --- reading ---

    def state(self) -> tuple[int | None, int | None]:
        """The newest base and the newest version, None before the first."""
        log = self.spark.read.schema(f"{COMMITS}, n bigint").parquet(f"{self.path}/commits")
        row = log.agg(F.max("version").alias("version"), F.max_by("base", "version").alias("base")).first()
        return row.base, row.version

    def _read(self, name: str, schema: str, base: int, version: int) -> DataFrame:
        rows = self.spark.read.schema(f"{schema}, version bigint").option("basePath", f"{self.path}/{name}")
        return rows.parquet(f"{self.path}/{name}").where(F.col("version").between(base, version))

    def _rarest(self, name: str, keys: list[str], base: int, version: int) -> str | None:
        """The key with the shortest list, None if one of them has none."""
        sizes = self._read(f"{name}_sizes", "key string, n bigint, bucket int", base, version)
        wanted = [bucket_of(F.lit(key)) for key in keys]
        held = sizes.where(F.col("bucket").isin(wanted) & F.col("key").isin(keys)).groupBy("key").agg(F.sum("n").alias("n"))
        found = {r.key: r.n for r in held.collect()}  # one row for each word of the query
        return min(keys, key=lambda key: (found[key], key)) if set(found) == set(keys) else None

    def _list(self, name: str, schema: str, key: str, base: int, version: int) -> DataFrame:
        """The rows of a key that count in this version."""
        lists = self._read(name, f"key string, {schema}, bucket int", base, version)
        rows = lists.where((F.col("bucket") == bucket_of(F.lit(key))) & (F.col("key") == key)).drop("bucket", "key")
        if base == version:
            return rows.drop("version")
        gone = self._read("gone", "path string", base, version).groupBy("path").agg(F.max("version").alias("_since"))
        small = checked_broadcast(gone)
        met = rows.join(gone if small is None else small, "path", "left")
        return met.where(F.col("_since").isNull() | (F.col("version") >= F.col("_since"))).drop("_since", "version")

    def matching(self, query: str, filter_name: str | None = None, catalog: DataFrame | None = None) -> DataFrame | None:
        """The catalog rows that a query finds, unordered; None where the lists cannot tell.

        They cannot before the first build, and for a path query without three characters in a row.
        Path queries take their rows from ``catalog``.
        """
        base, version = self.state()
        terms = query_terms(query)
        if base is None or not terms:
            return None
        if uses_path_search(terms):
            grams = query_trigrams(terms)
            if not grams or catalog is None:
                return None
            rarest = self._rarest("grams", grams, base, version)
            if rarest is None:
                return catalog.limit(0)
            paths = materialize(self._list("grams", "path string", rarest, base, version).distinct(), "candidates")
            small = checked_broadcast(paths)
            rows = catalog.join(paths if small is None else small, "path", "left_semi")
            return rows.where(type_filter(filter_name) & has_substrings(terms))
        tokens = query_tokens(query)
        rarest = self._rarest("tokens", tokens, base, version) if tokens else None
        if rarest is None:
            return self.spark.createDataFrame([], self.columns)
        rows = self._list("tokens", self._row, rarest, base, version).select(*self.columns.names)
        return rows.where(type_filter(filter_name) & has_tokens(tokens))
