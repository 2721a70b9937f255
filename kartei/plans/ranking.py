"""Ranks inside groups without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kartei.plans.lineage import materialise


def ranked(rows: DataFrame, keys: list[str], order: list[str | Column], out: str = "pos") -> DataFrame:
    """rows with their place (from 0) in the order of each group.

    Rows are range-partitioned by keys and order, so a group that holds a large share of all rows is spread
    over many tasks; a small table of counts by task and group gives the places where tasks begin.
    """
    by = [F.col(k) for k in keys] + [F.col(o) if isinstance(o, str) else o for o in order]
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_task", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    table = materialise(placed)  # the split of a range partitioning is sampled: it must not be drawn twice
    here = table.groupBy("_task", *keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = here.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select(F.col("_task").alias("_t"), "_first", "_before", *(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)))
    match = F.col("_task") == F.col("_t")
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    return table.join(starts, match).select(*rows.columns, (F.col("_row") - F.col("_first") + F.col("_before")).cast("long").alias(out))


def evenly_kept(place: Column, count: Column, limit: int) -> Column:
    """Whether a place (from 0) is among the ``limit`` places int(k * count / limit), k = 0, 1, ..."""
    if limit <= 0:
        return F.lit(False)
    step = count / F.lit(float(limit))
    near = F.ceil(place / step)
    hit = F.lit(False)
    for k in (near - 1, near, near + 1):
        hit = hit | ((k >= 0) & (k < limit) & (F.floor(k * step) == place))
    return (count <= limit) | hit


def evenly_sampled(rows: DataFrame, keys: list[str], order: list[str | Column], limit: int, place: str = "pos") -> DataFrame:
    """At most ``limit`` rows of each group, evenly spaced in its order, with their new place and how many were left out."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_count"))
    old = ranked(rows, keys, order, "_place").join(counts, keys)
    kept = old.where(evenly_kept(F.col("_place"), F.col("_count"), limit))
    step = F.col("_count") / F.lit(float(max(limit, 1)))
    # The new place is the k of int(k * step); groups within the limit keep their places.
    near = F.ceil(F.col("_place") / step)
    new = F.when(F.col("_count") <= limit, F.col("_place")).when(F.floor((near - 1) * step) == F.col("_place"), near - 1).when(F.floor(near * step) == F.col("_place"), near).otherwise(near + 1)
    return kept.select(*rows.columns, new.cast("long").alias(place), F.greatest(F.lit(0), F.col("_count") - limit).cast("int").alias("truncated"))
