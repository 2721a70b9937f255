"""Average-linkage clusters inside folders, and similarities of files and clusters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from kartei.functions import vectors as V
from kartei.plans.lineage import materialise

#: Rows of a folder that are compared at once.
BLOCK = 2000


def average_linkage(x: np.ndarray, threshold: float) -> np.ndarray:
    """Labels of unit rows: clusters are merged while the mean similarity of the closest two reaches the threshold.

    Zero rows get -1. Rows are taken in descending order of their values, so the result doesn't depend on the
    order they come in; ties go to the earlier row, and labels are numbered by their earliest row.
    Two clusters can only merge if some pair of theirs reaches the threshold, so rows are first divided into the parts
    that such pairs connect, and every part is merged on its own.
    """
    labels = np.full(len(x), -1, np.int32)
    valid = np.flatnonzero((x != 0).any(1))
    if not len(valid):
        return labels
    order = valid[np.lexsort(tuple(-x[valid][:, k] for k in range(x.shape[1] - 1, -1, -1)))]
    rows = x[order].astype(np.float64)
    similar = np.clip(rows @ rows.T, -1.0, 1.0)
    near = similar >= threshold
    np.fill_diagonal(near, True)
    part = np.arange(len(order))
    while True:
        low = np.where(near, part[None, :], len(order)).min(1)
        low = np.minimum(low, low[low])
        if (low == part).all():
            break
        part = low
    found = np.arange(len(order))
    for root in np.unique(part):
        members = np.flatnonzero(part == root)
        if len(members) > 1:
            found[members] = members[_merge(similar[np.ix_(members, members)], threshold)]
    _, first, numbers = np.unique(found, return_index=True, return_inverse=True)
    rank = np.empty(len(first), np.int32)
    rank[np.argsort(first)] = np.arange(len(first))
    labels[order] = rank[numbers]
    return labels


def _merge(similar: np.ndarray, threshold: float) -> np.ndarray:
    """For each row of one part, the first row of its cluster. Row maxima are kept up to date between merges."""
    n = len(similar)
    s = similar.copy()
    np.fill_diagonal(s, -np.inf)
    size, head = np.ones(n), np.arange(n)
    best = s.argmax(1)
    value = s[np.arange(n), best]
    while True:
        i = int(value.argmax())
        if value[i] < threshold:
            return head
        i, j = sorted((i, int(best[i])))
        merged = (size[i] * s[i] + size[j] * s[j]) / (size[i] + size[j])
        size[i] += size[j]
        merged[[i, j]] = -np.inf
        merged[np.isneginf(s[i]) | np.isneginf(s[j])] = -np.inf
        s[i], s[:, i] = merged, merged
        s[j], s[:, j] = -np.inf, -np.inf
        head[head == j] = i
        value[j] = -np.inf
        stale = np.flatnonzero(((best == i) | (best == j)) & ~np.isneginf(value))
        for k in {i, *stale.tolist()}:
            best[k] = s[k].argmax()
            value[k] = s[k, best[k]]
        better = (merged > value) | ((merged == value) & (best > i))
        better[i] = False
        best[better], value[better] = i, merged[better]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return np.asarray(flat.flatten()).astype(np.float64).reshape(len(flat), -1)


def clusters(vectors: DataFrame, threshold: float) -> DataFrame:
    """(folder, pos, cluster, closest) of vectors (folder, pos, vec); folders are sampled to a bounded size before.

    closest is the greatest similarity to another file of the folder, 0 for a file that is alone.
    """

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        x = _matrix(table.column("vec"))
        labels = average_linkage(x, threshold)
        closest = np.zeros(len(x))
        if len(x) > 1:
            s = np.clip(x @ x.T, -1.0, 1.0)
            np.fill_diagonal(s, -np.inf)
            closest = s.max(1)
        return pa.table({"folder": table.column("folder"), "pos": table.column("pos"), "cluster": labels, "closest": closest})

    return vectors.select("folder", "pos", "vec").groupBy("folder").applyInArrow(work, "folder string, pos long, cluster int, closest double")


def block_pairs(vectors: DataFrame, key: str) -> DataFrame:
    """vectors with own, low, high: every two rows of a folder meet in one (low, high), where each block holds about BLOCK rows.

    A folder of n blocks sends each row to the n tasks of its block with each block."""
    blocks = vectors.groupBy("folder").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_blocks"))
    own = vectors.select("folder", key, "vec").join(blocks, "folder").withColumn("own", F.pmod(F.xxhash64(key), F.col("_blocks")).cast("int"))
    met = own.withColumn("_partner", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return met.select("folder", key, "vec", "own", F.least("own", "_partner").alias("low"), F.greatest("own", "_partner").alias("high"))


def _sides(table: pa.Table, key: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids and rows of the low block, ids and rows of the high block), in the order of ids."""
    table = table.sort_by(key)
    x, ids, own = _matrix(table.column("vec")), np.asarray(table.column(key).combine_chunks()), np.asarray(table.column("own").combine_chunks())
    low, high = (own == table.column(c)[0].as_py() for c in ("low", "high"))
    return ids[low], x[low], ids[high], x[high]


def similar_pairs(vectors: DataFrame, least: float, key: str = "pos") -> DataFrame:
    """(folder, a, b, similarity) of files of a folder with at least ``least``, a < b; only such pairs leave the task."""

    def work(table: pa.Table) -> pa.Table:
        left, x, right, y = _sides(table, key)
        s = x @ y.T
        near = s >= least
        if table.column("low")[0] == table.column("high")[0]:
            near = np.triu(near, 1)
        a, b = np.nonzero(near)
        return pa.table({"folder": pa.array([table.column("folder")[0].as_py()] * len(a), pa.string()), "a": np.minimum(left[a], right[b]), "b": np.maximum(left[a], right[b]), "similarity": s[a, b]})

    return block_pairs(vectors, key).groupBy("folder", "low", "high").applyInArrow(work, "folder string, a long, b long, similarity double")


def closest(vectors: DataFrame) -> DataFrame:
    """(folder, pos, closest): the greatest similarity to another file of the folder, 0 for a file that is alone."""

    def work(table: pa.Table) -> pa.Table:
        left, x, right, y = _sides(table, "pos")
        s = np.clip(x @ y.T, -1.0, 1.0)
        ids, best = [left], [s.max(1, initial=-np.inf)]
        if table.column("low")[0] == table.column("high")[0]:
            np.fill_diagonal(s, -np.inf)
            best = [s.max(1, initial=-np.inf)]
        else:
            ids.append(right)
            best.append(s.max(0, initial=-np.inf))
        ids, best = np.concatenate(ids), np.concatenate(best)
        return pa.table({"folder": pa.array([table.column("folder")[0].as_py()] * len(ids), pa.string()), "pos": ids, "closest": best})

    found = block_pairs(vectors, "pos").groupBy("folder", "low", "high").applyInArrow(work, "folder string, pos long, closest double")
    best = F.max("closest")
    return found.groupBy("folder", "pos").agg(F.when(best > float("-inf"), best).otherwise(0.0).alias("closest"))


def cluster_sizes(members: DataFrame) -> DataFrame:
    return members.where("cluster >= 0").groupBy("folder", "cluster").agg(F.count(F.lit(1)).alias("size"))


def meaningful(members: DataFrame, files_per_folder: DataFrame, least: int = 3, share: float = 0.10) -> DataFrame:
    """(folder, cluster, size) of clusters with at least max(least, int(share * n_files)) files."""
    floor = F.greatest(F.lit(least), F.floor(F.lit(share) * F.col("n_files")))
    return cluster_sizes(members).join(files_per_folder.select("folder", "n_files"), "folder").where(F.col("size") >= floor).select("folder", "cluster", "size")


def cluster_means(vectors: DataFrame, members: DataFrame) -> DataFrame:
    """(folder, cluster, mean): mean vectors, not of unit length."""
    return V.mean_by(vectors.join(members.where("cluster >= 0").select("folder", "pos", "cluster"), ["folder", "pos"]), ["folder", "cluster"], "vec", "mean")


def group_similarity(means: DataFrame) -> DataFrame:
    """(folder, a, b, similarity), a <= b: mean similarity of all pairs of two clusters, own pairs on the diagonal."""
    left = means.select("folder", F.col("cluster").alias("a"), F.col("mean").alias("_x"))
    right = means.select("folder", F.col("cluster").alias("b"), F.col("mean").alias("_y"))
    return left.join(right, "folder").where("a <= b").select("folder", "a", "b", V.dot(F.col("_x"), F.col("_y")).alias("similarity"))


def dominant_cluster(main: DataFrame) -> DataFrame:
    """(folder, cluster): the largest meaningful cluster, the first on a tie."""
    order = Window.partitionBy("folder").orderBy(F.desc("size"), "cluster")
    return main.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("folder", "cluster")


def dominant_subject(vectors: DataFrame, members: DataFrame, main: DataFrame) -> DataFrame:
    """(folder, subject): unit mean of the dominant cluster."""
    means = cluster_means(vectors, members).join(dominant_cluster(main), ["folder", "cluster"], "left_semi")
    return means.select("folder", V.normalised(F.col("mean"), 1e-8).alias("subject"))


def profiles(vectors: DataFrame, least: int = 3) -> DataFrame:
    """(folder, profile, n): mean vectors of folders with at least ``least`` files."""
    counts = vectors.groupBy("folder").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return V.mean_by(vectors.join(counts.select("folder"), "folder", "left_semi"), ["folder"], "vec").join(counts, "folder")


def file_terms(files: DataFrame, limit: int = 200) -> DataFrame:
    """(folder, pos, term, n): words of the name count twice, the first ``limit`` words of the text once."""
    from kartei.functions.tokens import content_tokens, name_tokens

    names = files.select("folder", "pos", F.explode(name_tokens(F.col("stem"))).alias("term"), F.lit(2).alias("n"))
    words = files.select("folder", "pos", F.explode(content_tokens(F.col("text"), limit)).alias("term"), F.lit(1).alias("n"))
    return names.unionByName(words).groupBy("folder", "pos", "term").agg(F.sum("n").alias("n"))


def cluster_labels(terms: DataFrame, members: DataFrame, top: int = 3, support: float = 0.30, least: float = 0.0015) -> DataFrame:
    """(folder, cluster, labels): the terms most distinctive of each cluster inside its folder, best first."""
    held = members.where("cluster >= 0").select("folder", "pos", "cluster")
    sizes = held.groupBy("folder", "cluster").agg(F.count(F.lit(1)).alias("docs"))
    count = sizes.groupBy("folder").agg(F.count(F.lit(1)).alias("clusters"))
    # Read three times below: the words are split once.
    grouped = materialise(terms.join(held, ["folder", "pos"]).groupBy("folder", "cluster", "term").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("with")))
    totals = grouped.groupBy("folder", "cluster").agg(F.sum("n").alias("total"))
    spread = grouped.groupBy("folder", "term").agg(F.count(F.lit(1)).alias("spread"))
    joined = grouped.join(totals, ["folder", "cluster"]).join(spread, ["folder", "term"]).join(sizes, ["folder", "cluster"]).join(count, "folder")
    score = F.col("n") / F.col("total") * (F.log(F.col("clusters") / F.col("spread")) + 1.0) * F.sqrt(F.length("term"))
    scored = joined.where(F.col("with") / F.col("docs") >= support).withColumn("score", score).where(F.col("score") >= least)
    # Scores are compared to nine digits, so that equal ones are ties and go by term.
    order = Window.partitionBy("folder", "cluster").orderBy(F.desc(F.round("score", 9)), "term")
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    labels = best.groupBy("folder", "cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"]).alias("labels"))
    return sizes.select("folder", "cluster").join(labels, ["folder", "cluster"], "left").withColumn("labels", F.coalesce("labels", F.array(F.lit("no shared wording"))))
