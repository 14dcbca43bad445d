"""Session helpers: the shared working folder and materialised tables."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession


# A shuffle into more tasks costs more than it spreads; beyond them tasks get larger.
MAX_TASKS = 20_000
# Applications that hold this package already.
_SHIPPED: set[str] = set()
# The folders of local sessions without a setting, by application.
_OWN_FOLDERS: dict[str, str] = {}


def local_session(cores: int | str = "*", app: str = "logquarry") -> SparkSession:
    """A session for tests and single-machine runs; clusters bring their own."""
    parts = "8" if cores == "*" else str(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", parts)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python tasks, once per application."""
    context = spark.sparkContext
    root = Path(__file__).resolve().parent
    archive = f"{root.name}.zip"
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    target = Path(tempfile.mkdtemp(prefix="spark-")) / archive
    with zipfile.ZipFile(target, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(str(target))


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _OWN_FOLDERS:
        _OWN_FOLDERS[app] = tempfile.mkdtemp(prefix="spark-")
    return _OWN_FOLDERS[app]


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one written table inside the shared folder."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/logquarry/{app}/{uuid.uuid4().hex}/{name}"


def materialize(df: DataFrame, name: str, **options: int) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage, computes the input once, and survives the loss of executors
    because the rows live in the shared folder rather than on one machine.
    ``options`` are those of the writer.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.mode("overwrite").options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_counting(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """``materialize`` and, from the same job, some aggregates over its rows."""
    seen = Observation()
    written = materialize(df.observe(seen, *[expr.alias(key) for key, expr in counts.items()]), name)
    return written, seen.get


def spread(scan: DataFrame, key: str) -> DataFrame:
    """Give costly work on a plain scan at least one partition per core.

    A large input has more partitions than cores already and is not shuffled.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores, key)


def spread_rows(table: DataFrame, per_task: int, *keys: str) -> DataFrame:
    """Deal rows of a stored table that are costly work, each, to tasks of about ``per_task``, at least one a core.

    The number is set by a count, because rows that only name their work are small: by
    their bytes a scan or adaptive execution would give millions of them to a few tasks.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    tasks = min(max(cores, -(-table.count() // per_task)), MAX_TASKS)
    return table.repartition(tasks, *keys).sortWithinPartitions(*keys)


def spread_places(table: DataFrame, per_task: int, *keys: str) -> DataFrame:
    """:func:`spread_rows` by ranges of the keys, of which the first is a ``place``.

    What lies together in a stored file goes to one task, which reads it from end to end; dealt by
    hash every task would open every file and read a little of each of its parts.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    tasks = min(max(cores, -(-table.count() // per_task)), MAX_TASKS)
    return table.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)
