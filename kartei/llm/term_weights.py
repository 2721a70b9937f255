"""Problem 3: how distinctive a term is of one record, against all records.

Method: term frequency times smoothed logarithmic inverse document frequency. Document
frequencies are distributed counts of distinct (term, record) pairs, joined back to the pairs;
frequencies are normalised by the length of the record. Everything stays in the JVM.

score = (n / total) * ln((1 + N) / (1 + df)) + (n / total), that is tf * (smoothed idf + 1).

Defined results: exact repeated input rows count once; rows with a null record id, a null term,
a null, zero or negative n don't count; a term that is empty after trimming doesn't count either;
spellings that differ in case or surrounding blanks are one term and their counts are added; an
empty table gives an empty result; columns other than the three named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Share of all (record, term) rows from which on a term is joined by broadcast; at most 1/share terms can reach it.
HOT_SHARE = 1 / 1000


def trimmed(term: str) -> F.Column:
    """Lower-cased, without surrounding white space of any kind."""
    return F.regexp_replace(F.lower(F.col(term)), r"(?U)^\s+|\s+$", "")


def record_terms(terms: DataFrame, record: str = "file_id", term: str = "term", n: str = "n") -> DataFrame:
    """One row per record and normalised term, with the term's count."""
    # Repeats are told by the three columns as they stand, before the spelling is unified.
    return (
        terms.where(F.col(record).isNotNull() & F.col(term).isNotNull() & (F.col(n) > 0))
        .select(F.col(record).alias("record"), F.col(term).alias("term"), F.col(n).cast("long").alias("n"))
        .distinct()
        .withColumn("term", trimmed("term"))
        .where(F.col("term") != "")
        .groupBy("record", "term")
        .agg(F.sum("n").alias("n"))
    )


def term_weights(terms: DataFrame, record: str = "file_id", term: str = "term", n: str = "n") -> DataFrame:
    """(record, term, n, total, df, records, score) for every record and term.

    ``df`` is the number of records with the term, ``records`` the number of records with any
    term, ``total`` the sum of n of the record.
    """
    from kartei.plans.lineage import materialise

    pairs = materialise(record_terms(terms, record, term, n))
    totals = pairs.groupBy("record").agg(F.sum("n").alias("total"))
    counts = pairs.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    size = pairs.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("record").alias("records")).first()
    # A term held by a large share of the records would fill one join task: those few terms (no
    # more than 1/HOT_SHARE of them can exist) go by broadcast, all others by their key.
    least = max(1000, int(size.rows * HOT_SHARE))
    counts = materialise(counts)
    hot = F.broadcast(counts.where(F.col("df") >= least))
    rare = counts.where(F.col("df") < least)
    by_term = pairs.join(hot, "term").unionByName(pairs.join(F.broadcast(hot.select("term")), "term", "left_anti").join(rare, "term"))
    tf = F.col("n") / F.col("total")
    return by_term.join(totals, "record").select(
        "record", "term", "n", "total", "df", F.lit(size.records).cast("long").alias("records"), (tf * F.log((F.lit(1.0) + size.records) / (F.lit(1.0) + F.col("df"))) + tf).alias("score")
    )


def label_weights(weights: DataFrame, labels: DataFrame, clusters: DataFrame) -> DataFrame:
    """Mean score of each label's words over the cluster's files: judges existing cluster wording.

    labels: (folder, cluster, labels array); clusters: (folder, file_id, cluster). A label without
    scored words gets a null score and 0 files. Repeated rows, null labels and cluster -1 are left out.
    """
    wording = (
        labels.where((F.col("cluster") >= 0) & F.col("folder").isNotNull())
        .select("folder", "cluster", F.explode("labels").alias("label"))
        .where(F.col("label").isNotNull())
        .distinct()
        .withColumn("term", trimmed("label"))
    )
    members = clusters.where((F.col("cluster") >= 0) & F.col("file_id").isNotNull()).select("folder", "cluster", "file_id").distinct()
    scored = (
        wording.join(members, ["folder", "cluster"])
        .join(weights.select(F.col("record").alias("file_id"), "term", "score"), ["file_id", "term"])
        .groupBy("folder", "cluster", "label")
        .agg(F.avg("score").alias("mean_score"), F.count(F.lit(1)).alias("files"))
    )
    return wording.join(scored, ["folder", "cluster", "label"], "left").select("folder", "cluster", "label", "mean_score", F.coalesce("files", F.lit(0)).alias("files"))


def characteristic(weights: DataFrame, least_n: int = 3, least_share: int = 20, least_df: int = 3, most_df: int = 20) -> DataFrame:
    """Terms said often in their record and found in few, but several, records."""
    return weights.where((F.col("n") >= least_n) & (F.lit(least_share) * F.col("n") >= F.col("total")) & F.col("df").between(least_df, most_df))
