"""Problem 6: evaluation passages inside training documents.

Method: greedy string tiling. Seeds are windows of ``seed`` words that a document shares with an item, by their
Karp-Rabin values; they are joined. For each (document, item) with a common seed, the longest matching runs that don't overlap
are marked again and again, longest first, until none of ``seed`` words is left. The tiles' total over the item's words is its
coverage, so reordered passages count.

Items may be a table of any size. The documents are read once: a bit table of the items' seeds (``FILTER_BITS`` at most, so of
bounded size) tells which windows may be seeds; what passes goes on with its values to the join, which is exact. So only
documents that may share something are ever shuffled, and only once for all items.

Defined results: null, blank and wordless texts and null ids leak nothing; items shorter than
``seed`` words can't be found; exact repeated rows count once; a document or item id with several
texts is judged by each text and reported once per pair of ids with its best values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kartei.plans.lineage import materialise

from .words import hashed, owners, rolling, scramble, window_mask, words_of

#: Bits of the table of seeds: about 256 for each window of the items, at most so many (64 MB). A seed has two of them.
FILTER_BITS = 1 << 29
SCHEMA = "doc_id long, item_id long, item_words int, tiles int, matched int, longest int, coverage double"


def windows(texts: list[str], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, value) of all windows of ``seed`` words."""
    flat, ends = hashed(map(words_of, texts))
    inside = np.nonzero(window_mask(ends, seed))[0]
    return owners(ends)[inside], rolling(flat, seed)[inside]


def has(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the table has the bits at these places."""
    return table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 > 0


def seed_rows(texts: DataFrame, seed: int, bits: np.ndarray | None = None) -> DataFrame:
    """(id, text, seeds): texts with their distinct windows, those of which the bit table has; none without any."""
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        if table is not None:
            mask, shift = np.uint64(8 * len(table) - 1), np.uint64(65 - (8 * len(table)).bit_length())
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                own, value = windows(part.column(1).to_pylist(), seed)
                if table is not None:
                    held = has(table, value & mask)
                    own, value = own[held], value[held]
                    held = has(table, value >> shift)
                    own, value = own[held], value[held]
                if not len(own):
                    continue
                order = np.lexsort((value, own))
                own, value = own[order], value[order]
                new = np.concatenate([[True], (own[1:] != own[:-1]) | (value[1:] != value[:-1])])
                own, value = own[new], value[new].view(np.int64)
                rows, first = np.unique(own, return_index=True)
                seeds = pa.ListArray.from_arrays(pa.array([*first, len(own)], pa.int32()), pa.array(value))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), part.column(1).take(pa.array(rows)), seeds], names=["id", "text", "seeds"])

    return texts.mapInArrow(work, "id long, text string, seeds array<long>")


def bit_table(items: DataFrame) -> np.ndarray:
    """Bits of the seeds of (seeds), or'ed together from a table of each task's bytes that hold any."""
    n = items.agg(F.sum(F.size("seeds"))).first()[0] or 0
    power = max(10, min(FILTER_BITS, 256 * n).bit_length() - 1)
    size = 1 << power
    # A row for each byte that has a bit: no more rows than bytes of the table.
    seeds = items.select(F.explode("seeds").alias("h"))
    places = seeds.select(F.explode(F.array(F.col("h").bitwiseAND(F.lit(size - 1)), F.shiftrightunsigned("h", 64 - power))).alias("place"))
    bytes_ = places.select(F.shiftright("place", 3).alias("at"), F.expr("shiftleft(1, cast(place & 7 as int))").alias("bit"))
    rows = bytes_.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(size >> 3, np.uint8)
    table[np.asarray(rows.column("at"))] = np.asarray(rows.column("bits")).astype(np.uint8)
    return table


def tile(a: np.ndarray, b: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two id arrays: (start in a, start in b, length), longest first.

    Ties go to the smaller start in a, then in b. Each word is used once on either side. The longest length at which free
    windows agree is found by bisection over Karp-Rabin values; then all runs of that length are marked. A level takes time in
    proportion to the texts, however often they repeat themselves.
    """
    free_a, free_b = a >= 0, b >= 0
    tiles: list[tuple[int, int, int]] = []
    of_a, of_b = _any_length(a), _any_length(b)

    def free_windows(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        wa, wb = _free_windows(free_a, n), _free_windows(free_b, n)
        return wa, wb, of_a(wa, n), of_b(wb, n)

    def agree(n: int) -> bool:
        _, _, ha, hb = free_windows(n)
        return len(ha) > 0 and len(hb) > 0 and bool(np.isin(ha, hb).any())

    longest = min(len(a), len(b))
    while longest >= least and agree(least):
        low, high = least, longest
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if agree(middle) else (low, middle - 1)
        longest = low
        wa, wb, ha, hb = free_windows(longest)
        order = np.argsort(hb, kind="stable")
        starts_b, sorted_b = wb[order], hb[order]
        first, behind = np.searchsorted(sorted_b, ha), np.searchsorted(sorted_b, ha, side="right")
        turn: dict[int, int] = {}
        for i, lo, hi in zip(wa[behind > first].tolist(), first[behind > first].tolist(), behind[behind > first].tolist()):
            if not free_a[i : i + longest].all():
                continue
            at = turn.get(lo, lo)
            while at < hi and not (free_b[starts_b[at] : starts_b[at] + longest].all() and np.array_equal(a[i : i + longest], b[starts_b[at] : starts_b[at] + longest])):
                at += 1  # what is marked stays marked
            turn[lo] = at
            if at < hi:
                j = int(starts_b[at])
                free_a[i : i + longest] = free_b[j : j + longest] = False
                tiles.append((i, j, longest))
        longest -= 1
    return tiles


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _any_length(ids: np.ndarray) -> Callable[[np.ndarray, int], np.ndarray]:
    """A function from starts and a length to Karp-Rabin values modulo 2**64: differences of one running sum, shifted to the same power."""
    powers = lambda base: np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(0, len(ids) - 1), base, np.uint64), dtype=np.uint64)])[: len(ids)]
    run = np.concatenate([[np.uint64(0)], np.cumsum(scramble(ids) * powers(_BASE), dtype=np.uint64)])
    back = powers(_INVERSE)
    return lambda starts, n: (run[starts + n] - run[starts]) * back[starts]


def _free_windows(free: np.ndarray, length: int) -> np.ndarray:
    run = np.concatenate([[0], np.cumsum(free)])
    return np.nonzero(run[length:] - run[:-length] == length)[0] if len(free) >= length else np.zeros(0, np.int64)


def tiled(pairs: DataFrame, seed: int) -> DataFrame:
    """From (doc_id, item_id, doc_text, item_text): one row per pair that has tiles."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            known: dict[str, np.ndarray] = {}  # texts come again within a batch

            def words(text: str, known=known) -> np.ndarray:
                if text not in known:
                    # Values below 2**63, so that no word counts as marked.
                    known[text] = (hashed([words_of(text)])[0] >> np.uint64(1)).astype(np.int64)
                return known[text]

            for doc, item, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                x, y = words(a), words(b)
                if found := tile(x, y, seed):
                    matched = sum(n for _, _, n in found)
                    out.append((doc, item, len(y), len(found), matched, found[0][2], matched / len(y)))
            columns = list(zip(*out)) or [[]] * 7
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return pairs.select("doc_id", "item_id", "doc_text", "item_text").mapInArrow(work, SCHEMA)


def leaked_passages(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", seed: int = 8) -> DataFrame:
    """One row per document and item that share at least one tile of ``seed`` words."""
    plain = lambda df, key, text: df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    of_items = materialise(seed_rows(plain(items, item_id, item_text).distinct(), seed).withColumn("item", F.monotonically_increasing_id()))
    found = seed_rows(plain(documents, doc_id, doc_text), seed, bit_table(of_items))
    of_docs = materialise(found.withColumn("doc", F.monotonically_increasing_id()))
    seeds = lambda df, key: df.select(key, F.explode("seeds").alias("h"))
    pairs = seeds(of_docs, "doc").join(seeds(of_items, "item"), "h").select("doc", "item").distinct()
    texts = pairs.join(of_docs.select("doc", F.col("id").alias("doc_id"), F.col("text").alias("doc_text")), "doc").join(of_items.select("item", F.col("id").alias("item_id"), F.col("text").alias("item_text")), "item")
    best = [F.max("item_words").alias("item_words"), *(F.max(c).alias(c) for c in ("tiles", "matched", "longest", "coverage"))]
    return tiled(texts, seed).groupBy("doc_id", "item_id").agg(*best)


def leaks(tiles: DataFrame, least_run: int = 12, least_coverage: float = 0.5) -> DataFrame:
    """Of leaked_passages: runs of at least ``least_run`` words, or items covered by at least ``least_coverage``."""
    return tiles.where((F.col("longest") >= least_run) | (F.col("coverage") >= least_coverage))
