"""The folder tree as tables: ancestors by exploded prefixes, never by prefix comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def ancestry(folders: DataFrame, folder: str = "folder") -> DataFrame:
    """(ancestor, descendant, distance) of all listed folders that lie in one another; distance 0 is the folder itself.

    Null folders are left out; repeated ones count once. Every folder gives one row per level, and an equi-join
    keeps the prefixes that are folders themselves.
    """
    names = folders.where(F.col(folder).isNotNull()).select(F.col(folder).alias("descendant")).distinct()
    parts = F.split("descendant", "/")
    prefixes = names.select("descendant", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("level", "ancestor"), F.size(parts).alias("levels"))
    up = prefixes.select(F.when(F.col("ancestor") == "", "/").otherwise(F.col("ancestor")).alias("ancestor"), "descendant", (F.col("levels") - 1 - F.col("level")).cast("int").alias("distance")).where((F.col("ancestor") != "/") | (F.col("descendant") == "/") | (F.col("distance") > 0))
    return up.join(names.select(F.col("descendant").alias("ancestor")), "ancestor", "left_semi").distinct()


def rollup(tree: DataFrame, values: DataFrame, aggregates: list, folder: str = "folder") -> DataFrame:
    """Aggregates over each folder's whole subtree. Values are summed by folder first, so only one row
    per folder and ancestor is shuffled."""
    return tree.join(values.withColumnRenamed(folder, "descendant"), "descendant").groupBy("ancestor").agg(*aggregates).withColumnRenamed("ancestor", folder)


def outermost(roots: DataFrame, root: str = "root") -> DataFrame:
    """Roots that lie in no other listed root."""
    tree = ancestry(roots, root).where("distance > 0")
    return roots.where(F.col(root).isNotNull()).select(root).distinct().join(tree.select(F.col("descendant").alias(root)).distinct(), root, "left_anti")


def first_report(rows: DataFrame, folder: str, root_rank: str) -> DataFrame:
    """A folder that several roots reach, once: by the first root."""
    first = rows.groupBy(folder).agg(F.min(root_rank).alias(root_rank))
    return rows.join(first, [folder, root_rank], "left_semi")
