"""Problem 1: clusters of mutually similar vectors, with sizes and most typical members.

Method: grid density clustering. A feature of a vector is the nearest of 2m signed axes of a random frame; a grid's cell is the
tuple of q such features, so cells are cones of directions, about one for every ``1 / CELL`` vectors. Cells are counted in SQL; those
with two vectors or more are looked into. A cell is dense if all its vectors have a mean similarity of ``similar`` or more to the others in
it, which follows from their sum alone; what lies off the rest is left out of a cell until it is dense or empty. Dense cells of
different grids are adjacent where they share a vector, and adjacent ones are joined by propagating minimum labels
to convergence. The groups found so are points themselves in further rounds, with their mean vectors and fresh, coarser grids. So a group reaches through its mean what its members missed.

Last, an exact check from vector sums: where a group has members whose mean similarity to the others is too low, a few of them are
left out; if they are many, the group was bridged and is parted between two of its members that are far apart. That goes on until every
group holds.

m and q follow from the number of rows, and the number of grids from the chance that similar vectors meet in a cell, which
falls slowly as cells get finer. No pairs of vectors are formed. Cells of more than ``CROWDED`` vectors are taken in parts;
parts meet again in other grids and, by their means, in the next round, so no task holds a hot cell.

Equal vectors are folded to one with a weight and count fully in all sums.

Defined results: null, short, long, zero and non-finite vectors are left out; repeated rows count
once; with no cluster the result is empty; of several vectors of an id one is used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from kartei.plans.lineage import discard, materialise

from .components import components
from .vectors import fold_copies, matrix, rows_of, sum_by_label, usable

#: Vectors of a cell on average, rows of a cell in one part, and axes of a frame at most.
CELL, CROWDED = 0.5, 4000
#: Members whose mean similarity to the others of their cluster is less are left out.
MEMBER = 0.66
#: In a group with a larger share of members that don't hold, two clusters were bridged.
BRIDGED = 0.2


def grid_shape(rows: int, dimensions: int) -> tuple[int, int]:
    """(features of a cell, axes of a feature) for cells of about CELL rows."""
    cells = max(2.0, rows / CELL)
    q = max(1, int(np.ceil(np.log(cells) / np.log(2 * dimensions))))
    return q, min(dimensions, max(1, int(round(cells ** (1 / q) / 2))))


def grid_count(rows: int, base: int) -> int:
    """Grids of a round: a pair at similarity 0.7 meets in a cell with a chance of about the number of cells to the power -0.176."""
    return int(np.ceil(base * (max(2.0, rows / CELL) / 1e4) ** 0.176))


def frames(seed: int, grids: int, q: int, m: int, dimensions: int) -> np.ndarray:
    """Random orthonormal axes, (dimensions, grids * q * m)."""
    rng = np.random.default_rng(seed)
    blocks = []
    need = grids * q * m
    while need > 0:
        basis, _ = np.linalg.qr(rng.standard_normal((dimensions, dimensions)))
        blocks.append(basis[:, :need])
        need -= dimensions
    return np.concatenate(blocks, 1).astype(np.float32)


def quantise(points: DataFrame, seed: int, grids: int, q: int, m: int, dimensions: int) -> DataFrame:
    """(id, n, norm, small, cells) from (id, n, vec): the vector as int8 steps and the hash of its cell in every grid."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes = frames(seed, grids, q, m, dimensions)
        rows = max(64, min(4000, 16_000_000 // axes.shape[1]))
        for batch in batches:
            for part in (batch.slice(i, rows) for i in range(0, batch.num_rows, rows)):
                x = matrix(part.column("vec"), dimensions)
                norm = np.sqrt((x.astype(np.float64) ** 2).sum(1))
                projected = (x @ axes).reshape(len(x), grids * q, m)
                axis = np.abs(projected).argmax(2)
                side = np.take_along_axis(projected, axis[:, :, None], 2)[:, :, 0] > 0
                feature = (2 * axis + side).reshape(len(x), grids, q).astype(np.int64)
                cell = np.tile(np.arange(grids), (len(x), 1))
                for f in range(q):
                    cell = cell * (2 * m) + feature[:, :, f]
                largest = np.maximum(np.abs(x).max(1, keepdims=True), 1e-30)
                small = np.rint(x / largest * 127).astype(np.int8)
                offsets = pa.array((np.arange(len(x) + 1) * grids).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("n"), pa.array(norm), rows_of(small), pa.ListArray.from_arrays(offsets, pa.array(cell.ravel()))], names=["id", "n", "norm", "small", "cells"])

    return points.select("id", "n", "vec").mapInArrow(work, "id long, n long, norm double, small binary, cells array<long>")


def hold_together(cell: np.ndarray, n: np.ndarray, x: np.ndarray, similar: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of the rows that make up the dense part of their cell; rows are sorted by cell.

    x holds mean vectors, n how many vectors each stands for. In each step the sums of all cells are taken; rows that fall short in
    a cell leave it if they are below the average of its rows, the worst one in any case."""
    row = np.arange(len(cell))
    done_rows, done_cells = [], []
    weight = n.astype(np.float64)
    while len(row):
        first = np.concatenate([[0], np.nonzero(np.diff(cell[row]))[0] + 1])
        size = np.diff([*first, len(row)])
        alive = np.repeat(size > 1, size)
        if not alive.all():
            row = row[alive]
            continue
        w = weight[row]
        own = x[row]
        total = np.repeat(np.add.reduceat(own * w[:, None], first), size, axis=0)
        sum_w = np.repeat(np.add.reduceat(w, first), size)
        # Mean similarity of a row's vectors to the others in the cell.
        fit = (np.einsum("ij,ij->i", own, total) - np.einsum("ij,ij->i", own, own) * w) / np.maximum(sum_w - w, 1e-9)
        short = fit < similar
        bad = np.maximum.reduceat(short, first)
        bad_rows = np.repeat(bad, size)
        done_rows.append(row[~bad_rows])
        done_cells.append(cell[row[~bad_rows]])
        average = np.repeat(np.add.reduceat(fit, first) / size, size)
        lowest = np.repeat(np.minimum.reduceat(fit, first), size)
        # Of equal ones all but the first of the cell go.
        worst = fit == lowest
        place = np.arange(len(row)) - np.repeat(first, size)
        keep = bad_rows & ~(short & ((fit < average) | (worst & (place > 0))))
        stuck = bad & ~np.maximum.reduceat(bad_rows & ~keep, first)
        keep &= ~(np.repeat(stuck, size) & worst)
        row = row[keep]
    return (np.concatenate(done_rows), np.concatenate(done_cells)) if done_rows else (np.zeros(0, int), np.zeros(0, np.int64))


def dense_cells(points: DataFrame, seed: int, base: int, similar: float, dimensions: int) -> tuple[DataFrame, DataFrame]:
    """((id, root, size), the table behind): for every grid, the dense cell that a point belongs to; root is its smallest id. points: (id, n, vec)."""
    rows = points.count()
    q, m = grid_shape(rows, dimensions)
    cells = materialise(quantise(points, seed, grid_count(rows, base), q, m, dimensions))
    exploded = cells.select("id", F.explode("cells").alias("cell"))
    counts = exploded.groupBy("cell").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    # A merge join brings a cell's rows together in order, so vectors are shuffled once; a hot cell is split by AQE or below.
    inside = cells.select("id", "n", "norm", "small", F.explode("cells").alias("cell")).join(counts.hint("merge"), "cell").select("cell", "id", "n", "norm", "small").sortWithinPartitions("cell")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: pa.Table | None = None

        def part(table: pa.Table) -> Iterator[pa.RecordBatch]:
            if not table.num_rows:
                return
            ids, n = (np.asarray(table.column(c).combine_chunks()) for c in ("id", "n"))
            key = np.concatenate([[0], np.cumsum(_changes(table))])
            x = matrix(table.column("small"), dimensions, np.int8).astype(np.float32)
            x *= (np.asarray(table.column("norm").combine_chunks()) / np.maximum(np.sqrt((x * x).sum(1)), 1e-30))[:, None].astype(np.float32)
            row, cell = hold_together(key, n, x, similar)
            if len(row):
                order = np.lexsort((row, cell))
                row, cell = row[order], cell[order]
                first = np.concatenate([[0], np.nonzero(np.diff(cell))[0] + 1])
                size = np.diff([*first, len(row)])
                root = np.repeat(np.minimum.reduceat(ids[row], first), size)
                held = np.repeat(np.add.reduceat(n[row], first), size)
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(root), pa.array(held)], names=["id", "root", "size"])

        for batch in batches:
            for piece in (batch.slice(i, CROWDED) for i in range(0, batch.num_rows, CROWDED)):
                table = pa.Table.from_batches([piece])
                if carry is not None and carry.num_rows:
                    table = pa.concat_tables([carry, table])
                new = np.nonzero(_changes(table))[0]
                # The last cell may go on; one of more than CROWDED rows is taken in parts.
                last = int(new[-1]) + 1 if len(new) else 0
                if table.num_rows - last > CROWDED:
                    last = table.num_rows
                yield from part(table.slice(0, last))
                carry = table.slice(last)
        if carry is not None:
            yield from part(carry)

    return inside.mapInArrow(work, "id long, root long, size long"), cells


def _changes(table: pa.Table) -> np.ndarray:
    cell = np.asarray(table.column("cell").combine_chunks())
    return cell[1:] != cell[:-1]


def join_cells(dense: DataFrame) -> DataFrame:
    """(id, label): minimum labels of points connected through shared dense cells.

    A point ties the smallest root of its cells to the others; labels are propagated among roots only."""
    least = materialise(dense.groupBy("id").agg(F.min("root").alias("low"), F.collect_set("root").alias("roots")))
    ties = least.select(F.col("low").alias("a"), F.explode("roots").alias("b")).where("a != b").distinct()
    joined = components(ties).select(F.col("vertex").alias("low"), "label")
    return least.select("id", "low").join(joined, "low", "left").select("id", F.coalesce("label", "low").alias("label"))


def sums(points: DataFrame, labels: DataFrame, dimensions: int) -> DataFrame:
    """(label, n, total): weights and weighted vector sums of the labelled points."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.asarray(batch.column("n"))
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("n"), rows_of(matrix(batch.column("vec"), dimensions) * n[:, None].astype(np.float32))], names=["label", "n", "total"])

    joined = points.join(labels, "id").select("label", "n", "vec")
    return sum_by_label(joined.mapInArrow(weigh, "label long, n long, total binary"), dimensions)


def means(totals: DataFrame, dimensions: int) -> DataFrame:
    """(id, n, vec): mean vectors of groups, which are shorter the less alike their members are."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.asarray(batch.column("n"))
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("n"), rows_of(matrix(batch.column("total"), dimensions) / n[:, None].astype(np.float32))], names=["id", "n", "vec"])

    return totals.mapInArrow(work, "id long, n long, vec binary")


def dots(rows: DataFrame, columns: list[str], out: str, dimensions: int, other: str = "total") -> DataFrame:
    """columns with the product of the vectors ``vec`` and ``other``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dot = np.einsum("ij,ij->i", matrix(batch.column("vec"), dimensions).astype(np.float64), matrix(batch.column(other), dimensions).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(dot)], names=[*columns, out])

    kinds = dict(rows.dtypes)
    return rows.select(*columns, "vec", other).mapInArrow(work, ", ".join([*(f"{c} {kinds[c]}" for c in columns), f"{out} double"]))


def fits(points: DataFrame, labels: DataFrame, dimensions: int) -> DataFrame:
    """(id, label, n, all, mean_similarity) to the other members, for labelled points of groups of two vectors or more."""
    totals = sums(points, labels, dimensions).where("n > 1").select("label", F.col("n").alias("all"), "total")
    rows = dots(points.join(labels, "id").join(totals, "label"), ["id", "label", "n", "all"], "dot", dimensions)
    return rows.select("id", "label", "n", "all", ((F.col("dot") - 1) / (F.col("all") - 1)).alias("mean_similarity"))


def parted(points: DataFrame, fit: DataFrame, dimensions: int) -> DataFrame:
    """(id, label): groups of fit taken apart between two of their members: the one that fits worst, and the one least like it."""
    one = fit.groupBy("label").agg(F.min_by("id", F.struct("mean_similarity", "id")).alias("pole"))
    pole = one.join(points.select(F.col("id").alias("pole"), F.col("vec").alias("total")), "pole")
    rows = fit.select("id", "label").join(points.select("id", "vec"), "id")
    near = materialise(dots(rows.join(pole.select("label", "total"), "label"), ["id", "label"], "to_one", dimensions))
    two = near.groupBy("label").agg(F.min_by("id", F.struct("to_one", "id")).alias("other"))
    far = two.join(points.select(F.col("id").alias("other"), F.col("vec").alias("total")), "other")
    both = dots(rows.join(far.select("label", "total"), "label"), ["id", "label"], "to_other", dimensions).join(near.select("id", "to_one"), "id")
    sides = both.withColumn("side", F.col("to_other") > F.col("to_one"))
    heads = sides.groupBy("label", "side").agg(F.min("id").alias("head"))
    return sides.join(heads, ["label", "side"]).select("id", F.col("head").alias("label"))


def settled(points: DataFrame, labels: DataFrame, member: float, dimensions: int) -> DataFrame:
    """fits of groups in which every member holds. Every step leaves out members or parts a group, so steps end."""
    done: DataFrame | None = None
    while True:
        fit = materialise(fits(points, labels, dimensions))
        short = (F.col("mean_similarity") < member).cast("int")
        state = materialise(fit.groupBy("label").agg(F.sum(short * F.col("n")).alias("short"), F.max("all").alias("size")).where("short > 0"))
        good = fit.join(state, "label", "left_anti")  # what is read later stays
        done = good if done is None else done.unionByName(good)
        if not state.limit(1).count():
            return done
        few = state.where(F.col("short") <= BRIDGED * F.col("size"))
        kept = fit.join(few.select("label"), "label", "left_semi").where(F.col("mean_similarity") >= member).select("id", "label")
        halves = parted(points, fit.join(state.join(few.select("label"), "label", "left_anti").select("label"), "label", "left_semi"), dimensions)
        labels = materialise(kept.unionByName(halves))


def cluster_vectors(rows: DataFrame, row_id: str, vector: str, least_size: int = 3, member: float = MEMBER, grids: tuple[int, ...] = (8, 12, 20, 30), dimensions: int = 128) -> tuple[DataFrame, DataFrame]:
    """(members, density): members (id, cluster_id, size, mean_similarity) of all clusters of at least
    ``least_size`` ids; density (id, density): the summed sizes of the dense cells a distinct vector is in.

    grids: how many grids the rounds use for 5,000 points; more points get more (grid_count)."""
    units, copies = fold_copies(usable(rows, row_id, vector, dimensions=dimensions))
    points = units.select("id", F.col("copies").alias("n"), "vec")
    first = labels = None
    current = points
    for k, base in enumerate(grids):
        dense, cells = dense_cells(current, 1 + k, base, member, dimensions)
        dense = materialise(dense)
        discard(cells)
        joined = materialise(current.select("id").join(join_cells(dense), "id", "left").select("id", F.coalesce("label", "id").alias("label")))
        beyond = joined.select(F.col("id").alias("label"), F.col("label").alias("beyond"))
        before, held = current, labels
        labels = joined if labels is None else materialise(labels.join(beyond, "label").select("id", F.col("beyond").alias("label")))
        current = materialise(means(sums(current, joined, dimensions), dimensions))
        if k:
            discard(before, held, joined, dense)
        else:
            first = materialise(dense.groupBy("id").agg(F.sum("size").alias("density")))
            discard(dense)
    several = materialise(labels.join(current.where("n > 1").select(F.col("id").alias("label")), "label", "left_semi").select("id", "label"))
    fit = materialise(settled(points, several, member, dimensions))
    final = copies.select("id", "head").join(fit.select(F.col("id").alias("head"), "label", "mean_similarity"), "head")
    size = final.groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("cluster_id")).where(F.col("size") >= least_size)
    members = final.join(size, "label").select("id", "cluster_id", "size", "mean_similarity", "head")
    return members, first


def describe(members: DataFrame, density: DataFrame, top: int = 3) -> DataFrame:
    """(cluster_id, size, mean_similarity, typical): typical are the ``top`` ids in the densest cells,
    ties by mean similarity, then the smallest id.

    Each of ``top`` turns takes the best member of every cluster by a maximum, so no cluster is sorted in one task."""
    rank = F.struct("density", "mean_similarity", (-F.col("id")).alias("earlier"))
    left = materialise(members.join(density.withColumnRenamed("id", "head"), "head", "left").select("cluster_id", "size", "id", "mean_similarity", F.coalesce("density", F.lit(0)).alias("density")))
    found = None
    bound = None
    for turn in range(top):
        rest = left if bound is None else left.join(bound, "cluster_id").where(rank < F.col("bound")).drop("bound")
        best = materialise(rest.groupBy("cluster_id").agg(F.max(rank).alias("bound")))
        part = best.select("cluster_id", F.lit(turn).alias("turn"), (-F.col("bound.earlier")).alias("id"))
        found = part if found is None else found.unionByName(part)
        bound = best
    typical = found.groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("turn", "id"))).alias("t")).select("cluster_id", F.col("t.id").alias("typical"))
    return left.groupBy("cluster_id", "size").agg(F.avg("mean_similarity").alias("mean_similarity")).join(typical, "cluster_id")
