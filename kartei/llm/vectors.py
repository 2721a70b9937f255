"""Vectors as unit float32 bytes, copies folded; sums by key without one task per key."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from kartei.plans.lineage import discard, materialise

DIMENSIONS = 128


def _usable(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("vec")
        right = pc.equal(pc.list_value_length(lists), dimensions).fill_null(False)
        part = pa.Table.from_batches([batch]).filter(right).combine_chunks()
        if not part.num_rows:
            continue
        column = part.column("vec").chunk(0)
        flat = column.flatten().cast(pa.float64())
        x = np.asarray(flat.fill_null(float("nan"))).reshape(-1, dimensions)
        with np.errstate(all="ignore"):
            good = np.isfinite(x).all(1) & (x != 0).any(1)
            x = x[good]
            largest = np.abs(x).max(1, keepdims=True) if len(x) else x[:, :1]
            x = x / largest  # so that squares neither overflow nor vanish
            x = (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32)
        raw = [r.tobytes() for r in x]
        digests = [hashlib.blake2b(r, digest_size=16).digest() for r in raw]
        keep = part.filter(pa.array(good))
        yield pa.RecordBatch.from_arrays([keep.column("id").combine_chunks(), keep.column("grp").combine_chunks(), pa.array(digests, pa.binary()), pa.array(raw, pa.binary())], names=["id", "grp", "digest", "vec"])


def usable(rows: DataFrame, row_id: str, vector: str, group: str | None = None, dimensions: int = DIMENSIONS) -> DataFrame:
    """(id, grp, digest, vec): rows with an id and a finite, non-zero vector of the right length.

    vec holds unit float32 bytes. Repeated rows count once; of several vectors of one id the one
    with the smallest digest stays. A null group is the group "".
    """
    kind = F.coalesce(F.col(group).cast("string"), F.lit("")) if group else F.lit("")
    plain = rows.where(F.col(row_id).isNotNull() & F.col(vector).isNotNull()).select(F.col(row_id).cast("long").alias("id"), kind.alias("grp"), F.col(vector).alias("vec"))
    units = plain.mapInArrow(lambda batches: _usable(batches, dimensions), "id long, grp string, digest binary, vec binary")
    return units.groupBy("grp", "id").agg(F.min(F.struct("digest", "vec")).alias("v")).select("id", "grp", "v.digest", "v.vec")


def fold_copies(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(heads, members): heads (id, grp, copies, vec) of distinct vectors by smallest id; members (id, grp, head)."""
    units = materialise(units)
    heads = units.groupBy("grp", "digest").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("copies"))
    members = materialise(units.select("id", "grp", "digest").join(heads, ["grp", "digest"]).select("id", "grp", "head", "copies"))
    first = members.where("id = head").select("id", "grp", "copies")
    distinct = materialise(units.select("id", "grp", "vec").join(first, ["grp", "id"]).select("id", "grp", "copies", "vec"))
    discard(units)
    return distinct, members


def matrix(column: pa.Array, dimensions: int = DIMENSIONS, kind: type = np.float32) -> np.ndarray:
    """Fixed-size binary values as rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, dimensions), kind)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind).reshape(len(column), dimensions)


def rows_of(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    x = np.ascontiguousarray(x)
    width = x.shape[1] * x.itemsize
    offsets = pa.array((np.arange(len(x) + 1) * width).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(x), [None, offsets.buffers()[1], pa.py_buffer(x.tobytes())])


def sum_by_label(rows: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """From (label, n, total): one row per label with the sums; total holds float32 bytes.

    Batches are summed before the shuffle, so a label that holds a large share of all rows
    reaches its task as one row per batch.
    """

    def summed(labels: np.ndarray, n: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(labels, kind="stable")
        first = np.concatenate([[0], np.nonzero(np.diff(labels[order]))[0] + 1])
        return labels[order][first], np.add.reduceat(n[order], first), np.add.reduceat(total[order].astype(np.float64), first)

    def pack(labels: np.ndarray, n: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(labels), pa.array(n), rows_of(total.astype(np.float32))], names=["label", "n", "total"])

    def read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.asarray(batch.column("label")), np.asarray(batch.column("n")), matrix(batch.column("total"), dimensions)

    def partly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pack(*summed(*read(batch)))

    def finally_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for batch in batches:
            if not batch.num_rows:
                continue
            labels, n, total = read(batch)
            if carry is not None:
                labels, n, total = (np.concatenate([c, x]) for c, x in zip(carry, (labels, n, total)))
            labels, n, total = summed(labels, n, total)
            if len(labels) > 1:
                yield pack(labels[:-1], n[:-1], total[:-1])
            carry = labels[-1:], n[-1:], total[-1:]
        if carry is not None:
            yield pack(*carry)

    kind = "label long, n long, total binary"
    return rows.select("label", "n", "total").mapInArrow(partly, kind).repartition("label").sortWithinPartitions("label").mapInArrow(finally_, kind)
