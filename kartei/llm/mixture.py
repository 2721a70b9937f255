"""Problem 7: mixing sources to target weights.

Method: Pfair scheduling. Every source's stream of texts is cut into blocks of equal token
counts. Block k of a source with weight w may begin at slot floor(k/w) and must begin before slot
ceil((k+1)/w); slots go to the released block with the earliest deadline. At every prefix of the
schedule each source is then less than one block away from its target.

A block has ``BLOCK_TOKENS`` tokens, or less where the total would give fewer than ``SLOTS`` blocks; so
interleaving doesn't get coarser with the collection. The driver schedules one period of at most ``PERIOD`` slots. More blocks go
through the same period again and again: of a source with B blocks and P periods, blocks ceil(pB/P) to ceil((p+1)B/P) go to
period p, one more or less than in another, so nothing drifts over periods and a slot that stays empty is just a gap in the
numbering. Texts are whole and belong to the block where they start, so a source is less than a block and a text away (two
blocks and a text with several periods). Texts find their block by distributed prefix sums.

Without ``total_tokens`` the total is the largest at which every source that has texts can reach its
weight within its repeats. Weights of sources without texts can't be reached; they are shared out
in proportion and reported with share 0. With ``total_tokens`` sources that can't reach their part
give all they have and the others take over the rest in proportion.

Defined results: sources are compared lower-cased, trimmed, with blanks and hyphens as
underscores; null texts, texts without tokens and untargeted or null sources are not used; a text that
occurs under several ids or sources counts as one text of the source of its smallest id; targets
with null or non-positive weight are left out, null repeats mean 1; no documents or no targets give
an empty mixture.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from kartei.plans.lineage import materialise

from .tokens import TOKENIZER, token_counts

BLOCK_TOKENS, SLOTS, PERIOD = 16_384, 4000, 65_536
#: Texts of one source in one window task.
BUCKET_TEXTS = 50_000


def source_key(source: str) -> F.Column:
    return F.regexp_replace(F.lower(F.trim(F.col(source))), r"[\s\-]+", "_")


def pfair(counts: list[int]) -> np.ndarray:
    """For each of sum(counts) slots, the number of the source that has it; source s has counts[s] of them."""
    slots = sum(counts)
    out = np.empty(slots, np.int32)
    released: list[tuple[int, int, int]] = []  # deadline, source, block
    # Block k of a source with n of the slots: released at floor(k slots / n), due at ceil((k + 1) slots / n).
    waiting = [(0, s, 0) for s, n in enumerate(counts) if n > 0]
    heapq.heapify(waiting)
    for slot in range(slots):
        while waiting and waiting[0][0] <= slot:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(released, (-(-(k + 1) * slots // counts[s]), s, k))
        _, s, k = heapq.heappop(released)
        out[slot] = s
        if k + 1 < counts[s]:
            heapq.heappush(waiting, (max(slot + 1, (k + 1) * slots // counts[s]), s, k + 1))
    return out


def quotas(weights: np.ndarray, capacity: np.ndarray, total: float | None) -> np.ndarray:
    """Tokens that each source is to give; see the module's description."""
    usable = (capacity > 0) & (weights > 0)
    if not usable.any():
        return np.zeros(len(weights))
    w = np.where(usable, weights, 0) / weights[usable].sum()
    if total is None:
        return w * (capacity[usable] / w[usable]).min()
    given = np.zeros(len(weights))
    open_ = usable.copy()
    left = min(float(total), capacity[usable].sum())
    while left > 1e-9 and open_.any():
        part = np.where(open_, w, 0) / w[open_].sum() * left
        full = open_ & (given + part >= capacity)
        if not full.any():
            return given + part
        left -= (capacity - given)[full].sum()
        given[full] = capacity[full]
        open_ &= ~full
    return given


def distinct_texts(documents: DataFrame, targets: DataFrame, doc_id: str, text: str, source: str, tokenizer: str) -> DataFrame:
    """(source, doc_id, tokens): every text of a targeted source once."""
    known = targets.select("source").distinct()
    rows = documents.withColumn("mix_source", source_key(source)).where(F.col("mix_source").isNotNull()).join(known.withColumnRenamed("source", "mix_source"), "mix_source", "left_semi")
    counted = token_counts(rows, doc_id, text, ["mix_source"], tokenizer).where(F.col("tokens") > 0)
    return counted.groupBy("digest").agg(F.min(F.struct("doc_id", "mix_source", "tokens")).alias("t")).select(F.col("t.mix_source").alias("source"), "t.doc_id", "t.tokens")


def clean_targets(targets: DataFrame, source: str = "source", weight: str = "weight", repeats: str = "max_repeats") -> DataFrame:
    return (
        targets.where((F.col(weight) > 0) & F.col(source).isNotNull())
        .select(source_key(source).alias("source"), F.col(weight).cast("double").alias("weight"), F.greatest(F.coalesce(F.col(repeats), F.lit(1)), F.lit(0)).alias("max_repeats"))
        .distinct()
        .groupBy("source")
        .agg(F.sum("weight").alias("weight"), F.min("max_repeats").alias("max_repeats"))
    )


def mixture(documents: DataFrame, targets: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", total_tokens: float | None = None, slots: int = SLOTS, period: int = PERIOD, block_tokens: int = BLOCK_TOKENS, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(the mixture, the report by source).

    Mixture: (slot, source, doc_id, repeat, tokens, start), to be read in the order of slot, source,
    start. Report: (source, weight, max_repeats, available_tokens, used_tokens, share, most_repeats, deviation, reachable,
    deviation_reachable): reachable is the weight among the sources that have texts, as far as they last.
    """
    spark = documents.sparkSession
    goals = clean_targets(targets)
    texts = materialise(distinct_texts(documents, goals, doc_id, text, source, tokenizer))
    sums = texts.groupBy("source").agg(F.sum("tokens").alias("available"), F.count(F.lit(1)).alias("texts"))
    # One row per target: as small as the list of targets itself.
    table = goals.join(sums, "source", "left").orderBy("source").toPandas()
    names = table["source"].tolist()
    weights = table["weight"].to_numpy(float)
    available = table["available"].fillna(0).to_numpy(float)
    quota = quotas(weights, available * table["max_repeats"].to_numpy(float), total_tokens)
    block = max(1.0, min(block_tokens, quota.sum() / slots))
    blocks = np.ceil(quota / block).astype(np.int64)
    periods = max(1, -(-int(blocks.sum()) // period))
    order = pfair((-(-blocks // periods)).tolist())
    schedule = [(names[s], k, slot) for s in range(len(names)) for k, slot in enumerate(np.flatnonzero(order == s).tolist())]
    plan = [(n, float(q), int(-(-q // a)), int(b), float(a)) for n, q, b, a in zip(names, quota, blocks, available) if q > 0]
    plan_df = spark.createDataFrame(pd.DataFrame(plan, columns=["source", "quota", "passes", "blocks", "available"]) if plan else [], "source string, quota double, passes int, blocks long, available double")
    schedule_df = spark.createDataFrame(pd.DataFrame(schedule, columns=["source", "place", "in_period"]) if schedule else [], "source string, place long, in_period long")

    # Prefix sums of each source's texts, in the order of a hash: sums of buckets first, then inside a bucket.
    buckets = max(1, -(-int(table["texts"].fillna(0).max() if len(table) else 0) // BUCKET_TEXTS))
    placed = texts.withColumn("h", F.xxhash64("doc_id")).withColumn("bucket", F.shiftrightunsigned("h", 1) % buckets)
    per_bucket = placed.groupBy("source", "bucket").agg(F.sum("tokens").alias("in_bucket"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select("source", "bucket", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("base"))
    start = F.col("base") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))
    streamed = placed.join(F.broadcast(offsets) if buckets * len(names) <= 100_000 else offsets, ["source", "bucket"]).withColumn("once", start)
    passes = streamed.join(F.broadcast(plan_df), "source").withColumn("repeat", F.explode(F.sequence(F.lit(1), F.col("passes"))))
    starts = passes.withColumn("start", (F.col("once") + (F.col("repeat") - 1) * F.col("available")).cast("long"))
    used = starts.where(F.col("start") + F.col("tokens") / 2 < F.col("quota")).withColumn("block", F.least(F.floor(F.col("start") / block), F.col("blocks") - 1))
    # Whole numbers throughout: a block at the border of two periods must fall into exactly one.
    turned = used.withColumn("turn", F.expr(f"(block * {periods}L) div blocks"))
    placed_blocks = turned.withColumn("place", F.expr(f"block - ((turn * blocks + {periods - 1}L) div {periods}L)"))
    mixed = placed_blocks.join(F.broadcast(schedule_df), ["source", "place"]).select((F.col("turn") * len(order) + F.col("in_period")).cast("long").alias("slot"), "source", "doc_id", F.col("repeat").cast("int").alias("repeat"), "tokens", "start")

    given = mixed.groupBy("source").agg(F.sum("tokens").alias("used_tokens"), F.max("repeat").alias("most_repeats"))
    whole = given.agg(F.sum("used_tokens").alias("whole"))
    part = pd.DataFrame({"source": names, "reachable": quota / max(quota.sum(), 1e-9)})
    reachable = spark.createDataFrame(part if names else [], "source string, reachable double")
    share = F.coalesce(F.col("used_tokens") / F.col("whole"), F.lit(0.0))
    report = (
        goals.join(sums, "source", "left")
        .join(given, "source", "left")
        .join(F.broadcast(whole), how="cross")  # one row
        .join(F.broadcast(reachable), "source")
        .select("source", "weight", "max_repeats", F.coalesce("available", F.lit(0)).alias("available_tokens"), F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"), share.alias("share"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), (share - F.col("weight")).alias("deviation"), "reachable", (share - F.col("reachable")).alias("deviation_reachable"))
    )
    return mixed, report
