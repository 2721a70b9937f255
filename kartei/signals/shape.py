"""The signal of folder size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kartei.functions.scoring import ramp
from kartei.signals import Frames, finding, signal


def crowding(folders: DataFrame, limit: int = 40) -> DataFrame:
    """(folder, count, severity) of folders with more than ``limit`` files, those left out by sampling included."""
    rows = folders.select("folder", (F.col("n_files") + F.coalesce("truncated", F.lit(0))).cast("long").alias("count"))
    return rows.where(F.col("count") > limit).withColumn("severity", ramp(F.col("count"), limit, 6 * limit)).where("severity > 0")


@signal
def overcrowded(f: Frames) -> DataFrame:
    """Too many files in one flat folder; only when asked for."""
    limit = f.settings.crowded_from
    rows = crowding(f.folders, limit)
    if not f.settings.report_crowding:
        rows = rows.where(F.lit(False))
    headline = F.concat(F.col("count").cast("string"), F.lit(" files on one level."))
    return finding(rows, "overcrowded", F.col("severity"), headline, F.lit(f"A level is counted as crowded from {limit + 1} files on."), F.array().cast("array<string>"), F.struct("count", F.lit(limit).alias("soft_limit")))
