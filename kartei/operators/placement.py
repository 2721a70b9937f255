"""Folders that look out of place among their surroundings.

Every subtree is described by a few subjects. A folder is held against what lies around it (its parent's subtree
without its own); what is usual there comes from its siblings. Elsewhere in the tree a related place is looked for.

All files are numbered once in the order of a walk, so a subtree is a range of numbers, its surroundings are two, and any
even sample of them is a list of at most ``SAMPLES`` numbers to look up: work grows with the number of folders, not with that of
folders times the files below. Votes are medians taken from the middle ranks of siblings, so no parent's children are gathered.
Only the branches of one parent pass one task, as a stream that keeps one vector for each branch unlike those before.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from kartei.functions import vectors as V
from kartei.functions.tokens import name_tokens
from kartei.operators.embedding import Embedder, encode_distinct
from kartei.plans.lineage import materialise
from kartei.plans.ranking import ranked
from kartei.signals import FINDING, Frames

# Size of a sample, subjects of a profile, files for a profile, how much better another place must fit, how far a
# folder must lie below its expectation, the share of it that must agree, the share of the name in the evidence, the
# similarity of branches that vote together, and what each doubling of their number takes off.
SAMPLES, TOPICS, LEAST_FILES, ADVANTAGE, GAP, SUPPORT, NAME_SHARE, ALIKE, PER_GROUP = 96, 6, 3, 0.08, 0.40, 0.60, 0.35, 0.75, 0.08
#: Folders that one pass over all places looks related ones up for.
BLOCK = 200
EMPTY = "folder string, code string, severity double, headline string, detail string, examples array<string>, data string"


def evidence(f: Frames, embedder: Embedder) -> DataFrame:
    """(folder, pos, path, both, content) of topical, non-zero files: content and name together, and content alone."""
    words = F.array_join(name_tokens(F.col("stem"), drop_noise=False), " ")
    names = encode_distinct(f.files.select("folder", "pos", "path", words.alias("words")), {"words": "name_vec"}, embedder)
    rows = f.vectors.where("topical").where(F.exists("vec", lambda x: x != 0)).join(names, ["folder", "pos"])
    both = V.normalised(F.concat(V.scaled(F.col("vec"), F.lit(math.sqrt(1 - NAME_SHARE))), V.scaled(F.col("name_vec"), F.lit(math.sqrt(NAME_SHARE)))), 1e-8)
    return rows.select("folder", "pos", "path", both.alias("both"), F.col("vec").alias("content"))


# --- profiles ---


def packed(x: np.ndarray) -> bytes:
    return np.concatenate([[len(x)], x.ravel()]).astype(np.float64).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    x = np.frombuffer(raw, np.float64)
    return x[1:].reshape(int(x[0]), -1)


def topics_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit topic vectors, shares, rows of the most typical files) of unit vectors.

    Seeds lie far apart: the next one is the row that is covered worst. ``cover`` holds each row's similarity to its seed, and
    ``topic`` which one that is, so the rows are dealt when the last seed is chosen."""
    cover, topic = np.full(len(x), -np.inf), np.zeros(len(x), int)
    free = np.ones(len(x), bool)
    seed = int((x @ x.sum(0)).argmax())
    for turn in range(min(TOPICS, max(1, len(x) // LEAST_FILES))):
        if turn:
            seed = int(np.where(free, cover, np.inf).argmin())
        free[seed] = False
        to_seed = x @ x[seed]
        topic[to_seed > cover] = turn
        cover = np.maximum(cover, to_seed)
    _, topic, sizes = np.unique(topic, return_inverse=True, return_counts=True)
    sums = np.zeros((len(sizes), x.shape[1]))
    np.add.at(sums, topic, x)
    length = np.linalg.norm(sums, axis=1, keepdims=True)
    units = np.divide(sums, length, out=np.zeros_like(sums), where=length > 1e-8)
    closeness = np.einsum("ij,ij->i", x, units[topic])
    order = np.lexsort((-closeness, topic))
    return units, sizes / len(x), order[np.searchsorted(topic[order], np.arange(len(sizes)))]


def togetherness(x: np.ndarray) -> float:
    """How much a folder's own files have in common: between the mean similarity of all pairs and that of nearest ones."""
    n, total = len(x), x.sum(0)
    if n < LEAST_FILES:
        return 0.0
    near = x @ x.T - 3 * np.eye(n)
    return max(0.0, (float(total @ total - np.einsum("ij,ij->", x, x)) / (n * (n - 1)) + float(near.max(1).mean())) / 2)


def sample_places(start: Column, n: Column) -> Column:
    """The numbers of an even sample of n files from ``start`` on, as an array of (place in the sample, number)."""
    step = F.greatest(F.lit(1.0), n / F.lit(float(SAMPLES)))
    return F.transform(F.sequence(F.lit(0), F.least(n, F.lit(SAMPLES)).cast("int") - 1), lambda k: F.struct(k.alias("k"), (start + F.floor(k * step)).cast("long").alias("at")))


def profiles(proof: DataFrame, tree: DataFrame, parents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(profiles, spans). profiles: (owner, what, files, topics, plain, shares, examples, coherence), what is "whole" (a subtree),
    "direct" (the folder alone) or "around" (the parent's subtree without the folder's); plain holds topics of contents alone.
    spans: (folder, own, files), the files in a folder and below it."""
    # With / below all other characters a folder's subtree is a range of this order.
    numbered = materialise(ranked(proof.withColumn("_walk", F.translate("folder", "/", "\x01")), [], ["_walk", "pos"], "at").drop("_walk"))
    own = materialise(numbered.groupBy("folder").agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("n")))
    whole = materialise(tree.join(own.withColumnRenamed("folder", "descendant"), "descendant").groupBy("ancestor").agg(F.min("start").alias("start"), F.sum("n").alias("n")).withColumnRenamed("ancestor", "owner"))
    beside = parents.join(whole.select(F.col("owner").alias("folder"), "start", "n"), "folder").join(whole.select(F.col("owner").alias("parent"), F.col("start").alias("above"), F.col("n").alias("all")), "parent")
    gap = F.when(F.col("at.at") < F.col("start"), F.col("at.at")).otherwise(F.col("at.at") + F.col("n"))
    enough = F.col("n") >= LEAST_FILES
    wanted = whole.where(enough).select("owner", F.lit("whole").alias("what"), F.col("n").alias("files"), F.explode(sample_places(F.col("start"), F.col("n"))).alias("at")).select("owner", "what", "files", "at.k", "at.at")
    direct = own.select(F.col("folder").alias("owner"), F.lit("direct").alias("what"), F.col("n").alias("files"), F.explode(sample_places(F.col("start"), F.col("n"))).alias("at")).select("owner", "what", "files", "at.k", "at.at")
    rest = beside.withColumn("left", F.col("all") - F.col("n")).where(enough & (F.col("left") >= LEAST_FILES))
    around = rest.select(F.col("folder").alias("owner"), F.lit("around").alias("what"), F.col("left").alias("files"), "start", "n", F.explode(sample_places(F.col("above"), F.col("left"))).alias("at")).select("owner", "what", "files", "at.k", gap.alias("at"))
    samples = wanted.unionByName(direct).unionByName(around).join(numbered.select("at", "path", "both", F.col("content")), "at")

    def describe(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("k")
        what, both = group["what"].iloc[0], np.stack(group["both"].to_numpy())
        topics, shares, typical = topics_of(both)
        plain, plain_shares, _ = topics_of(np.stack(group["content"].to_numpy())) if what == "whole" else (np.zeros((0, 0)), np.zeros(0), None)
        row = (group["owner"].iloc[0], what, int(group["files"].iloc[0]), packed(topics), shares.tolist(), packed(plain), plain_shares.tolist(), group["path"].iloc[typical].tolist(), togetherness(both) if what == "direct" else 0.0)
        return pd.DataFrame([row], columns=[c.split()[0] for c in schema.split(", ")])

    schema = "owner string, what string, files long, topics binary, shares array<double>, plain binary, plain_shares array<double>, examples array<string>, coherence double"
    found = materialise(samples.groupBy("owner", "what").applyInPandas(describe, schema))
    return found, whole.join(own.select(F.col("folder").alias("owner"), F.col("n").alias("own")), "owner", "left").select(F.col("owner").alias("folder"), F.coalesce("own", F.lit(0)).alias("own"), F.col("n").alias("files"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def fit(query: pd.Series, reference: pd.Series) -> pd.Series:
    """For each topic of one profile, the similarity of the closest topic of the other; sizes give no bonus."""
    return pd.Series([(unpacked(q) @ unpacked(r).T).max(1).tolist() if q is not None and r is not None else None for q, r in zip(query, reference)])


def weighed(shares: Column, fits: Column) -> Column:
    return V.dot(shares, fits)


def share_where(shares: Column, values: Column, test) -> Column:
    """The sum of the shares of topics whose value passes."""
    return F.aggregate(F.zip_with(shares, values, lambda s, v: F.when(test(v), s).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)


# --- votes ---


def branches(children: DataFrame) -> DataFrame:
    """(folder, branch): children (parent, folder, mean) of a parent in the order of their names; each goes to the closest branch
    begun before it from ALIKE on, or begins one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent, leaders = None, np.zeros((0, 0))
        for batch in batches:
            names = batch.column("parent").to_pylist()
            cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)] if names else [0]
            out = np.zeros(len(names), np.int32)
            for a, b in zip(cuts[:-1], cuts[1:]):
                x = np.stack([np.frombuffer(v, np.float64) for v in batch.column("mean").slice(a, b - a).to_pylist()])
                if names[a] != parent:
                    parent, leaders = names[a], np.zeros((0, x.shape[1]))
                near = x @ leaders.T if len(leaders) else np.full((len(x), 1), -np.inf)
                best, own = near.max(1), near.argmax(1)
                begun = []
                while len(open_ := np.flatnonzero(best < ALIKE)):
                    first = int(open_[0])
                    own[first], best[first] = len(leaders) + len(begun), np.inf
                    begun.append(x[first])
                    to_new = x[first + 1 :] @ x[first]
                    later = slice(first + 1, None)
                    own[later] = np.where(to_new > best[later], own[first], own[later])
                    best[later] = np.maximum(best[later], to_new)
                out[a:b] = own
                leaders = np.concatenate([leaders, *(v[None] for v in begun)])
            yield pa.RecordBatch.from_arrays([batch.column("folder"), pa.array(out)], names=["folder", "branch"])

    placed = children.select("parent", "folder", "mean").repartition("parent").sortWithinPartitions("parent", "folder")
    return placed.mapInArrow(work, "folder string, branch int")


def with_middle(rows: DataFrame, keys: list[str], value: str, place: str, count: str, middle: str) -> DataFrame:
    """rows with their place in the order of a group's values, the group's count, and its middle values (at most five, by place)."""
    order = Window.partitionBy(*keys).orderBy(value, *[c for c in rows.columns if c not in (*keys, value) and dict(rows.dtypes)[c] in ("string", "int")])
    sized = rows.join(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(count)), keys).withColumn(place, F.row_number().over(order) - 1)
    central = sized.where(F.col(place).between(F.floor((F.col(count) - 1) / 2) - 1, F.floor(F.col(count) / 2) + 1))
    held = central.groupBy(*keys).agg(F.collect_list(F.struct(F.col(place).alias("at"), F.col(value).alias("value"))).alias(middle))
    return sized.join(held, keys)


def at_place(middle: str, place: Column) -> Column:
    return F.get(F.filter(middle, lambda s: s["at"] == place), F.lit(0))["value"]


def middle_without(middle: str, count: Column, own: Column) -> Column:
    """The median of a group's values without the one at place ``own``."""
    at = lambda p: at_place(middle, F.when(p < own, p).otherwise(p + 1))
    return (at(F.floor((count - 2) / 2)) + at(F.floor((count - 1) / 2))) / 2


def middle_replaced(middle: str, count: Column, own: Column, value: Column) -> Column:
    """The median of a group's values with ``value`` instead of the one at place ``own``."""
    at = lambda p: at_place(middle, F.when(p < own, p).otherwise(p + 1))
    placed = lambda p: F.greatest(at(p - 1), F.least(value, at(p)))  # noqa: E731 - nulls beyond the ends are passed over
    return (placed(F.floor((count - 1) / 2)) + placed(F.floor(count / 2))) / 2


def expectations(children: DataFrame) -> DataFrame:
    """(folder, votes, usual, branches): the median over the branches of a parent of the median fit in each, without the folder's
    own; children: (parent, folder, mean, current), current null where a child has no vote."""
    grouped = materialise(children.join(branches(children), "folder").select("parent", "folder", "branch", "current"))
    number = grouped.groupBy("parent").agg(F.count_distinct("branch").alias("branches"))
    inside = with_middle(grouped.where(F.col("current").isNotNull()), ["parent", "branch"], "current", "_place", "_count", "_middle")
    whole = (at_place("_middle", F.floor((F.col("_count") - 1) / 2)) + at_place("_middle", F.floor(F.col("_count") / 2))) / 2
    inside = materialise(inside.withColumns({"_whole": whole, "_without": F.when(F.col("_count") > 1, middle_without("_middle", F.col("_count"), F.col("_place")))}).select("parent", "branch", "folder", "_whole", "_without"))
    across = with_middle(inside.select("parent", "branch", "_whole").distinct(), ["parent"], "_whole", "_turn", "_groups", "_medians").select("parent", "branch", "_turn", "_groups", "_medians")
    rows = inside.join(across, ["parent", "branch"]).join(number, "parent")
    alone = F.col("_without").isNull()
    usual = F.when(~alone, middle_replaced("_medians", F.col("_groups"), F.col("_turn"), F.col("_without"))).when(F.col("_groups") > 1, middle_without("_medians", F.col("_groups"), F.col("_turn")))
    return rows.select("folder", F.when(alone, F.col("_groups") - 1).otherwise(F.col("_groups")).alias("votes"), usual.alias("usual"), "branches")


# --- related places ---


def related_places(query: DataFrame, places: DataFrame, cluster: float) -> DataFrame:
    """(folder, place, fit): places whose contents a folder's go with better than with its surroundings.

    The folders are a query set; BLOCK of them at a time are sent to all places, which stay where they are."""
    blocks = max(1, -(-query.count() // BLOCK))
    out = query.sparkSession.createDataFrame([], "folder string, place string, fit double")
    for turn in range(blocks):
        rows = query.where(F.pmod(F.xxhash64("folder"), F.lit(blocks)) == turn).select("folder", "topics", "shares", "plain", "plain_shares", "fits", "current").collect()
        if not rows:
            continue

        def stacked(vectors: str, shares: str, rows=rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            parts = [unpacked(r[vectors]) for r in rows]
            return np.concatenate(parts), np.concatenate([r[shares] for r in rows]), np.cumsum([0, *map(len, parts)])[:-1]

        names, current, local = [r.folder for r in rows], np.array([r.current for r in rows]), np.concatenate([r.fits for r in rows])
        shared = query.sparkSession.sparkContext.broadcast((names, current, local, stacked("topics", "shares"), stacked("plain", "plain_shares")))

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, current, local, (q, share, starts), (c, c_share, c_starts) = shared.value
            for batch in batches:
                found = []
                for place, topics, shares, plain in zip(*(batch.column(k).to_pylist() for k in ("owner", "topics", "shares", "plain"))):
                    near = q @ unpacked(topics).T
                    best = near.max(1)
                    mean = np.add.reduceat(best * share, starts)
                    better = np.add.reduceat(share * (best - local >= ADVANTAGE), starts)
                    in_content = np.add.reduceat((c @ unpacked(plain).T).max(1) * c_share, c_starts)
                    covered = (np.maximum.reduceat(near, starts, axis=0) >= cluster) @ np.asarray(shares)
                    good = (mean >= cluster) & (mean - current >= ADVANTAGE) & (better >= SUPPORT) & (in_content >= cluster) & (covered >= SUPPORT)
                    found += [(names[i], place, float(mean[i])) for i in np.flatnonzero(good)]
                columns = list(zip(*found)) or [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.float64())], names=["folder", "place", "fit"])

        out = out.unionByName(materialise(places.select("owner", "topics", "shares", "plain").mapInArrow(work, "folder string, place string, fit double")))
        shared.unpersist()
    return out


def misplaced_folders(f: Frames, embedder: Embedder) -> DataFrame:
    """Findings (folder, code, severity, ...) with code folder_placement; none with fewer than three folders."""
    spark, cluster, tree = f.files.sparkSession, f.thresholds.cluster, f.tree
    if f.folders.limit(3).count() < 3:
        return spark.createDataFrame([], EMPTY)
    parents = materialise(tree.where("distance = 1").select(F.col("descendant").alias("folder"), F.col("ancestor").alias("parent")))
    described, spans = profiles(evidence(f, embedder), tree, parents)
    whole = described.where("what = 'whole'").select(F.col("owner").alias("folder"), "files", "topics", "shares", "plain", "plain_shares", "examples")
    direct = described.where("what = 'direct'").select(F.col("owner").alias("parent"), F.col("files").alias("own_files"), F.col("topics").alias("own_topics"), "coherence")
    near = described.where("what = 'around'").select(F.col("owner").alias("folder"), F.col("files").alias("near_files"), F.col("topics").alias("near_topics"))

    held = whole.join(parents, "folder").join(near, "folder", "left").withColumn("fits", fit("topics", "near_topics"))
    held = materialise(held.withColumn("current", F.when(F.col("near_files") >= F.col("files") / 2, weighed(F.col("shares"), F.col("fits")))).drop("near_topics"))

    @F.pandas_udf(T.BinaryType())
    def mean_topic(topics: pd.Series, shares: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(topics, shares):
            mean = np.asarray(s) @ unpacked(t)
            out.append((mean / max(float(np.linalg.norm(mean)), 1e-12)).tobytes())
        return pd.Series(out)

    votes = expectations(held.select("parent", "folder", mean_topic("topics", "shares").alias("mean"), "current"))
    judged = held.where(F.col("current").isNotNull()).join(votes, "folder").join(direct, "parent", "left")
    # Two unlike branches alone don't tell which of them is out of place.
    judged = judged.where(F.col("own_files").isNotNull() | (F.col("votes") >= 2))
    expected = F.coalesce("usual", "coherence", F.lit(0.0)) - PER_GROUP * F.log2(F.col("branches").cast("double"))
    judged = judged.withColumn("expected", expected).withColumn("supported", share_where(F.col("shares"), F.col("fits"), lambda v: v <= F.col("expected") - GAP / 2))
    suspects = materialise(judged.where((F.col("expected") - F.col("current") >= GAP) & (F.col("supported") >= SUPPORT)))

    # A subject that comes back under parallel parents is a layout, not a mistake.
    role = max(0.60, cluster + 0.25)
    typed = direct.where(F.col("own_files") >= LEAST_FILES).select("parent", "own_topics")
    tops = parents.select(F.col("folder").alias("parent"), F.col("parent").alias("grand"))
    mine = suspects.select("folder", "parent", "topics", "shares").join(tops, "parent").join(typed.select("parent"), "parent", "left_semi")
    theirs = parents.join(tops, "parent").join(mine.select("grand").distinct(), "grand", "left_semi").join(typed, "parent").join(whole.select("folder", F.col("topics").alias("t_topics"), F.col("shares").alias("t_shares")), "folder")
    theirs = theirs.select("grand", F.col("parent").alias("t_parent"), "t_topics", "t_shares", weighed(F.col("t_shares"), fit("t_topics", "own_topics")).alias("t_home")).where(F.col("t_home") < role)
    pairs = mine.join(theirs, "grand").where("parent != t_parent").withColumns({"there": weighed(F.col("shares"), fit("topics", "t_topics")), "back": weighed(F.col("t_shares"), fit("t_topics", "topics"))})
    layouts = pairs.where((F.col("there") >= role) & (F.col("back") >= role)).select("folder").distinct()
    fired = materialise(suspects.join(layouts, "folder", "left_anti"))

    line = tree.select(F.col("ancestor").alias("folder"), F.col("descendant").alias("place")).unionByName(tree.select(F.col("descendant").alias("folder"), F.col("ancestor").alias("place")))
    related = related_places(fired, described.where("what = 'whole'"), cluster).join(line, ["folder", "place"], "left_anti")
    best = related.groupBy("folder").agg(F.max(F.struct("fit", "place")).alias("b")).select("folder", F.col("b.place").alias("related"), F.col("b.fit").alias("related_fit"))
    rows = fired.select("folder", "files", "current", "expected", "supported", "examples").join(best, "folder", "left").withColumn("gap", F.col("expected") - F.col("current"))
    elsewhere = F.when(F.col("related").isNotNull(), F.concat(F.lit(" Closer in subject: "), F.col("related"), F.lit("."))).otherwise("")
    detail = F.concat(F.lit("What it holds fits its neighbours less than they fit one another."), elsewhere)
    data = F.to_json(F.struct(F.col("related").alias("related_folder"), F.col("files").alias("subtree_files"), *(F.round(a, 3).alias(b) for a, b in (("current", "current_fit"), ("expected", "expected_fit"), ("gap", "local_gap"), ("supported", "supported_fraction"), ("related_fit", "related_fit")))), {"ignoreNullFields": "false"})
    severity = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("gap") / max(0.30, cluster)))
    return rows.select("folder", F.lit("folder_placement").alias("code"), severity.alias("severity"), F.lit("The place of this folder doesn't match its contents.").alias("headline"), detail.alias("detail"), F.slice("examples", 1, 3).alias("examples"), data.alias("data")).select(*FINDING)
