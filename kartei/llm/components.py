"""Connected components by minimum labels, in rounds of joins; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kartei.plans.lineage import discard, materialise


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(vertex, label) of every vertex of the edges; label is the smallest vertex of the component.

    A round takes the smallest label of all neighbours and then the label of that label (pointer
    jumping), so chains shorten by half a round. Rounds end when no label changes.
    """
    both = materialise(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v"))).where("u != v").distinct())
    labels = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("vertex"), F.least("u", "m").alias("label")))
    held = None
    for _ in range(max_rounds):
        heard = both.join(labels.withColumnRenamed("vertex", "v"), "v").groupBy("u").agg(F.min("label").alias("heard"))
        low = labels.join(heard.withColumnRenamed("u", "vertex"), "vertex").select("vertex", "label", F.least("label", "heard").alias("low"))
        jump = labels.select(F.col("vertex").alias("low"), F.col("label").alias("beyond"))
        after = materialise(low.join(jump, "low").select("vertex", F.least("low", "beyond").alias("label"), (F.col("label") != F.least("low", "beyond")).alias("moved")))
        discard(labels if held is None else held)
        labels, held = after.select("vertex", "label"), after
        if not after.where("moved").limit(1).count():
            discard(both)
            return labels
    raise RuntimeError(f"labels still move after {max_rounds} rounds")
