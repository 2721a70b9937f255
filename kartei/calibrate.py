"""Choosing thresholds: how well clusters of labelled vectors are held together and kept apart."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kartei.operators.clustering import _matrix, average_linkage

GRID = tuple(round(0.10 + 0.01 * k, 2) for k in range(41))


def sweep(vectors: DataFrame, labels: DataFrame, grid: tuple[float, ...] = GRID, least: int = 3) -> DataFrame:
    """(threshold, pairs_together, held, pairs_apart, separated): over all folders, how many pairs of files of one label share
    a cluster at a threshold, and how many pairs of different labels don't. Counted from table sizes, not pair by pair."""

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        x, label = _matrix(table.column("vec")), np.asarray(table.column("cluster").combine_chunks())
        out = []
        pairs = lambda counts: int((counts * (counts - 1) // 2).sum())
        same = pairs(np.unique(label, return_counts=True)[1])
        every = len(x) * (len(x) - 1) // 2
        for threshold in grid:
            found = average_linkage(x, threshold)
            both = pairs(np.unique(np.stack([found, label], 1), axis=0, return_counts=True)[1])
            out.append((threshold, same, both, every - same, every - same - pairs(np.unique(found, return_counts=True)[1]) + both))
        return pa.table({n: pa.array([o[i] for o in out]) for i, n in enumerate(("threshold", "together", "held", "apart", "separated"))})

    rows = vectors.join(labels.where("cluster >= 0").select("folder", "pos", "cluster"), ["folder", "pos"])
    folders = rows.groupBy("folder").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("folder")
    each = rows.join(folders, "folder", "left_semi").select("folder", "pos", "vec", "cluster").groupBy("folder").applyInArrow(work, "threshold double, together long, held long, apart long, separated long")
    return each.groupBy("threshold").agg(F.sum("together").alias("pairs_together"), F.sum("held").alias("held"), F.sum("apart").alias("pairs_apart"), F.sum("separated").alias("separated"))


def plateau(points: list[tuple[float, float, int]]) -> tuple[float, float, float]:
    """(best, low, high): of (value, rate, cases), the best value and the range of values within one standard error of it."""
    best = max(points, key=lambda p: (p[1], -p[0]))
    error = (best[1] * (1 - best[1]) / max(best[2], 1)) ** 0.5
    near = [v for v, rate, _ in points if rate >= best[1] - error]
    return best[0], min(near), max(near)


RATIOS = tuple(round(0.2 + 0.05 * k, 2) for k in range(17))
MARGINS = tuple(round(0.05 * k, 2) for k in range(17))


def unrelated_sweep(main: DataFrame, alike: DataFrame, named: DataFrame, scale: float, grid: tuple[float, ...] = RATIOS, least: float = 0.10) -> DataFrame:
    """(ratio, folders, firing, topics): in how many folders with two meaningful clusters or more the signal of unrelated
    topics fires when ``unrelated`` is ratio * scale, and how many topics it reports.

    main: (folder, cluster, size); alike: (folder, a, b, similarity), a < b; named: (folder, a, b) of clusters that share names.
    """
    pairs = alike.join(named.select("folder", "a", "b", F.lit(True).alias("thread")), ["folder", "a", "b"], "left")
    links = pairs.groupBy("folder").agg(F.collect_list(F.struct("a", "b", "similarity", F.coalesce("thread", F.lit(False)).alias("thread"))).alias("links"))
    order = main.groupBy("folder").agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("small"), "cluster"))).alias("order")).where(F.size("order") >= 2)

    def work(batches):
        for batch in batches:
            out = []
            for clusters, found in zip(batch.column("order").to_pylist(), batch.column("links").to_pylist()):
                near = {(x["a"], x["b"]): x for x in found or ()}
                for ratio in grid:
                    taken: list[int] = []
                    for item in clusters:
                        c = item["cluster"]
                        known = [near.get((min(c, t), max(c, t))) for t in taken]
                        if all(x is None or x["similarity"] < ratio * scale and not x["thread"] for x in known):
                            taken.append(c)
                    sims = [near[a, b]["similarity"] for a in taken for b in taken if (a, b) in near]
                    fires = len(taken) > 1 and bool(sims) and 1 - max(0.0, float(np.mean(sims))) / max(1e-6, ratio * scale) >= least
                    out.append((ratio, int(fires), len(taken) * int(fires)))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate((pa.float64(), pa.int64(), pa.int64()))], names=["ratio", "firing", "topics"])

    each = order.join(links, "folder", "left").mapInArrow(work, "ratio double, firing long, topics long")
    return each.groupBy("ratio").agg(F.count(F.lit(1)).alias("folders"), F.sum("firing").alias("firing"), F.sum("topics").alias("topics"))


def misfiled_sweep(best: DataFrame, cluster: float, scale: float, grid: tuple[float, ...] = MARGINS, least: int = 2) -> DataFrame:
    """(ratio, folders, files): what the signal of misfiled files finds when its margin is ratio * scale.

    best: (folder, descendant, similarity) of files that don't fit their own folder."""
    ratios = best.sparkSession.createDataFrame([(r, cluster - r * scale) for r in grid], "ratio double, floor double")
    hits = best.join(F.broadcast(ratios), F.col("similarity") >= F.col("floor")).groupBy("ratio", "folder", "descendant").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    found = hits.groupBy("ratio").agg(F.count_distinct("folder").alias("folders"), F.sum("n").alias("files"))
    return ratios.select("ratio").join(found, "ratio", "left").select("ratio", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("folders", "files")))


def census(findings: DataFrame) -> DataFrame:
    """(code, folders, mean_severity): how often each finding comes out over a collection."""
    return findings.groupBy("code").agg(F.count_distinct("folder").alias("folders"), F.avg("severity").alias("mean_severity"))
