"""Bounded samples of distinct texts for fitting models."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

_PARTS = 1 << 30


def sample_texts(texts: DataFrame, most: int, text: str = "text") -> list[str]:
    """At most ``most`` distinct texts, chosen by hash: the same at every run, whatever the order and the number of copies.

    A sketch of the number of distinct texts gives the share of hashes to keep, so executors send about as many texts as
    are wanted, and not as many each.
    """
    hashed = texts.select(F.col(text).alias("t"), F.xxhash64(text).alias("h"))
    about = hashed.agg(F.approx_count_distinct("h", 0.02)).first()[0]
    share = min(1.0, 1.2 * most / max(1, about))
    chosen = hashed.where(F.pmod("h", F.lit(_PARTS)) < int(share * _PARTS) + 1).groupBy("h").agg(F.min("t").alias("t"))
    rows = chosen.collect()
    return [r.t for r in sorted(rows, key=lambda r: (r.h % _PARTS, r.t))[:most]]
