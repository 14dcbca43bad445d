"""When is an arriving file complete?  Size stability over samples.

A file is complete when its size was the same three times in a row, or after
twenty samples, whichever comes first.  At most 21 samples of a wait matter, so
they are cut to that number before anything is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logquarry.constants import STABLE_REPEATS, STABLE_SAMPLES
from logquarry.plans.blocked import id_block, with_running
from logquarry.session import materialize


def _complete(samples: Column) -> Column:
    """Fold samples ``(seq, size)`` in order to the completing ``seq`` and size."""
    none = F.lit(None).cast("bigint")
    start = F.struct(
        none.alias("size"), F.lit(-1).alias("n"), F.lit(0).alias("stable"), none.alias("done"), none.alias("final")
    )

    def step(acc: Column, sample: Column) -> Column:
        same = F.coalesce(acc["size"] == sample["size"], F.lit(False))
        n = acc["n"] + 1
        stable = F.when(same, acc["stable"] + 1).otherwise(F.lit(0))
        ended = (stable >= STABLE_REPEATS) | (n >= STABLE_SAMPLES)
        open_ = acc["done"].isNull()
        return F.struct(
            sample["size"].alias("size"),
            n.alias("n"),
            stable.alias("stable"),
            F.when(open_ & ended, sample["seq"]).otherwise(acc["done"]).alias("done"),
            F.when(open_ & ended, sample["size"]).otherwise(acc["final"]).alias("final"),
        )

    return F.aggregate(samples, start, step)


def _fold(first: DataFrame, keys: list[str]) -> DataFrame:
    """Completion of each wait from its first samples; unfinished ones stay null."""
    gathered = first.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("seq", "size"))).alias("_samples")
    )
    folded = gathered.withColumn("_f", _complete(F.col("_samples")))
    return folded.select(*keys, F.col("_f.done").alias("seq"), F.col("_f.final").alias("size"))


def stable_sizes(samples: DataFrame) -> DataFrame:
    """``path, seq, size`` at which each file was complete, from ``seq, path, size``."""
    order = Window.partitionBy("path").orderBy("seq")
    first = samples.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= STABLE_SAMPLES + 1)
    return _fold(first.drop("_n"), ["path"]).where(F.col("seq").isNotNull())


def with_generation(events: DataFrame) -> DataFrame:
    """Add ``generation``: how many schedules and cancels a path has seen so far."""
    control = F.col("op").isin("schedule", "cancel").cast("bigint")
    before = with_running(events, ["path"], "seq", id_block("seq"), sums={"_before": control})
    return before.withColumn("generation", F.col("_before") + control).drop("_before")


def arrivals(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Completed arrivals and the waits still open.

    ``events`` holds ``seq, path, op, size`` with op schedule, cancel or sample.
    A schedule starts a wait, a newer schedule or a cancel ends it, samples
    outside a wait are ignored, and each wait is announced at most once.  The
    second table holds the events needed to go on later, at most 22 per path.
    """
    keys = ["path", "generation"]
    numbered = with_generation(events).where(F.col("generation") > 0)
    order = Window.partitionBy(*keys).orderBy("seq")
    first = numbered.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= STABLE_SAMPLES + 2)
    gathered = first.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("seq", "op", "size"))).alias("_events")
    )
    samples = F.transform(
        F.filter("_events", lambda e: e["op"] == "sample"), lambda e: F.struct(e["seq"].alias("seq"), e["size"].alias("size"))
    )
    waits = materialize(gathered.withColumn("_f", _complete(samples)), "arrival_waits")
    folded = waits.where(F.element_at("_events", 1)["op"] == "schedule")
    done = folded.where(F.col("_f.done").isNotNull()).select(
        "path", F.col("_f.done").alias("seq"), F.col("_f.final").alias("size")
    )
    newest = waits.groupBy("path").agg(F.max("generation").alias("generation"))
    waiting = folded.where(F.col("_f.done").isNull()).join(newest, keys, "left_semi")
    still = waiting.select("path", F.inline("_events")).select("seq", "path", "op", "size")
    return done, still
