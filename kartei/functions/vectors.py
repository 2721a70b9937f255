"""Vector arithmetic on arrays as Columns, in double precision."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once.

    Inside a lambda of a higher-order function the optimizer would put the whole expression in place of a reference, and
    it would be computed again for every element.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def scaled(v: Column, by: Column) -> Column:
    return let(by, lambda b: F.transform(v, lambda x: x.cast("double") * b))


def normalised(v: Column, floor: float = 0.0) -> Column:
    """Unit length; a vector no longer than ``floor`` becomes (or stays) zero."""
    return let(v, lambda w: let(norm(w), lambda n: F.transform(w, lambda x: F.when(n > floor, x.cast("double") / n).otherwise(0.0))))


def finite(v: Column) -> Column:
    """NaN, infinite and null entries as 0."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.transform(v, lambda x: F.when(good(x), x.cast("double")).otherwise(0.0))


def is_usable(v: Column, dimensions: int) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.coalesce((F.size(v) == dimensions) & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0), F.lit(False))


def _summed(keys: list[pa.Array], n: np.ndarray, x: np.ndarray) -> tuple[list[pa.Array], np.ndarray, np.ndarray]:
    """Sums of rows with equal keys, in the order of their first rows."""
    code = np.zeros(len(n), np.int64)
    for key in keys:
        part = key.dictionary_encode(null_encoding="encode")
        code = np.unique(code * (len(part.dictionary) + 1) + np.asarray(part.indices), return_inverse=True)[1]
    _, first, code = np.unique(code, return_index=True, return_inverse=True)
    rank = np.argsort(np.argsort(first))
    code, first = rank[code], np.sort(first)
    order = np.argsort(code, kind="stable")
    starts = np.searchsorted(code[order], np.arange(len(first)))
    return [key.take(pa.array(first)) for key in keys], np.add.reduceat(n[order], starts), np.add.reduceat(x[order], starts, axis=0)


def mean_by(rows: DataFrame, keys: list[str], vector: str, out: str = "profile") -> DataFrame:
    """Mean vector of each group; null vectors don't count, all others must have one length.

    Batches are summed before the shuffle and rows of a group come to its task in order, so no group is gathered."""
    kinds = dict(rows.dtypes)
    shape = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "n long, total array<double>"])

    def pack(found: tuple) -> pa.RecordBatch:
        values, n, x = found
        lists = pa.ListArray.from_arrays(pa.array((np.arange(len(n) + 1) * x.shape[1]).astype(np.int32)), pa.array(x.ravel()))
        return pa.RecordBatch.from_arrays([*values, pa.array(n), lists], names=[*keys, "n", "total"])

    def matrix(lists: pa.Array) -> np.ndarray:
        flat = np.asarray(lists.flatten().cast(pa.float64()))
        return flat.reshape(len(lists), -1)

    def partly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = [batch.column(i) for i in range(len(keys))]
                yield pack(_summed(values, np.ones(batch.num_rows, np.int64), matrix(batch.column(len(keys)))))

    def wholly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if carry is None else [carry, batch]).combine_chunks()
            columns = [table.column(i).chunk(0) for i in range(len(keys) + 2)]
            done = pack(_summed(columns[: len(keys)], np.asarray(columns[-2]), matrix(columns[-1])))
            yield done.slice(0, done.num_rows - 1)
            carry = done.slice(done.num_rows - 1)
        if carry is not None:
            yield carry

    plain = rows.where(F.col(vector).isNotNull()).select(*keys, F.col(vector).cast("array<double>").alias("_x"))
    sums = plain.mapInArrow(partly, shape).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(wholly, shape)
    return sums.select(*keys, let(F.col("n"), lambda n: F.transform("total", lambda x: x / n)).alias(out))
