"""Ordered series: ranks, active segments, direction, equal bins; for rows and for arrays.

A series may be as long as the table. `ranked` numbers its rows by range partitions whose counts are added up, so no task
holds more than its part of the order; segments and bins follow from the ranks.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let


def kept(df: DataFrame) -> DataFrame:
    """df computed once, and kept in the folder that the cluster names in spark.checkpoint.dir (a local one only in local sessions without it)."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="screenlens-"))
    return df.checkpoint()


def ranked(df: DataFrame, by: list[str], order: list[str], name: str = "pos") -> DataFrame:
    """df with each row's place in its group, from 0, and the group's `_total`.

    Rows are dealt by ranges of (by, order), so a large group is dealt over many tasks. Their numbers in a range are kept
    with them, as ranges drawn anew could differ; a group's rows of earlier ranges, one count a range, are added.
    """
    keys, low = [*by, *order], (1 << 33) - 1
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = kept(df.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id()))
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit(low))
    sizes = rows.groupBy(*by, part.alias("_p")).agg(F.count("*").alias("_n"), F.min(place).alias("_low"))
    group = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_n").over(group.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = sizes.select(*(F.col(c).alias(f"_{c}") for c in by), "_p", (before - F.col("_low")).alias("_first"), F.sum("_n").over(group).alias("_total"))
    same = part == F.col("_p")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(first, same).withColumn(name, F.col("_first") + place).drop("_id", "_p", "_first", *(f"_{c}" for c in by))


def active_segments(df: DataFrame, by: list[str], pos: str, value: str, threshold: int, min_width: int) -> DataFrame:
    """Maximal runs of rows whose integer part is over the threshold: by, start, end (inclusive places).

    `pos` counts each group's rows from 0 without gaps. Active rows keep pos minus their rank along a
    run, so a run is one aggregation key.
    """
    active = ranked(df.where(F.col(value).cast("long") > threshold).select(*by, pos), by, [pos], "_k").drop("_total")
    run = active.groupBy(*by, (F.col(pos) - F.col("_k")).alias("_run")).agg(F.min(pos).alias("start"), F.max(pos).alias("end"), F.count("*").alias("_n"))
    return run.where(F.col("_n") >= min_width).select(*by, "start", "end")


def segments_of(values: Column, threshold: Column, min_width: Column) -> Column:
    """The same for an array: array<struct<start,end>>."""
    kind = "array<struct<start:int,end:int>>"

    def step(acc: Column, v: Column) -> Column:
        active = F.coalesce(v["v"].cast("long") > threshold, F.lit(False))
        ended = (acc["start"] >= 0) & ~active
        wide = ended & (v["i"] - acc["start"] >= min_width)
        return F.struct(
            F.when(active & (acc["start"] < 0), v["i"]).when(ended, -1).otherwise(acc["start"]).alias("start"),
            F.when(wide, F.concat(acc["found"], F.array(F.struct(acc["start"].alias("start"), (v["i"] - 1).alias("end"))))).otherwise(acc["found"]).alias("found"),
        )

    # One inactive value more ends the last run.
    items = F.concat(F.transform(values, lambda v, i: F.struct(v.cast("double").alias("v"), i.alias("i"))), F.array(F.struct(F.lit(None).cast("double").alias("v"), F.size(values).alias("i"))))
    return F.aggregate(items, F.struct(F.lit(-1).alias("start"), F.array().cast(kind).alias("found")), step)["found"]


def _direction(first: Column, last: Column, up: Column, down: Column, n: Column, threshold) -> Column:
    """In image coordinates, where smaller is higher."""
    delta = last - first
    return F.when((n < 2) | (F.abs(delta) < threshold), "").when((delta < 0) & (down >= up), "upward").when((delta > 0) & (up >= down), "downward").otherwise("")


def direction(df: DataFrame, by: list[str], pos: str, value: str, threshold: float) -> DataFrame:
    """by, trend of each group's values in order of pos; nulls are skipped. Negate measures that grow upwards."""
    rows = df.where(F.col(value).isNotNull())
    step = F.col(value).cast("double") - F.lag(F.col(value).cast("double")).over(Window.partitionBy(*by).orderBy(pos))
    agg = rows.withColumn("_d", step).groupBy(*by).agg(
        F.min_by(F.col(value).cast("double"), pos).alias("_a"), F.max_by(F.col(value).cast("double"), pos).alias("_b"), F.count_if(F.col("_d") > 0).alias("_u"), F.count_if(F.col("_d") < 0).alias("_w"), F.count("*").alias("_n")
    )
    return agg.select(*by, _direction(F.col("_a"), F.col("_b"), F.col("_u"), F.col("_w"), F.col("_n"), threshold).alias("trend"))


def direction_of(values: Column, threshold) -> Column:
    """The trend of an array."""

    def of(a: Column) -> Column:
        steps = lambda sign: F.size(F.filter(a, lambda v, i: (i > 0) & ((v - F.get(a, i - 1)) * sign > 0)))
        return F.when(F.size(a) < 2, "").otherwise(_direction(F.get(a, F.lit(0)), F.element_at(a, -1), steps(1), steps(-1), F.size(a), threshold))

    return let(F.filter(F.transform(values, lambda v: v.cast("double")), lambda v: v.isNotNull()), of)


def equal_bins(df: DataFrame, by: list[str], order: list[str], bins: int = 8) -> DataFrame:
    """df with `bin`: 1 to `bins` along the order, as even as possible, larger ones first."""
    large, small = F.pmod(F.col("_total"), F.lit(bins)), F.floor(F.col("_total") / bins)
    edge = large * (small + 1)
    k = F.when(F.col("_k") < edge, F.floor(F.col("_k") / (small + 1))).otherwise(large + F.floor((F.col("_k") - edge) / F.greatest(small, F.lit(1))))
    return ranked(df, by, order, "_k").withColumn("bin", (k + 1).cast("int")).drop("_k", "_total")
