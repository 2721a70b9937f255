import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from kartei.operators.ancestry import ancestry, outermost
from kartei.operators.clustering import average_linkage, clusters
from kartei.operators.embedding import HashedEmbedder, MarkerEmbedder, encode_distinct
from kartei.operators.score import scores, visible
from kartei.plans.ranking import evenly_sampled, ranked
from kartei.sources.ignore import compile_rule, without_ignored


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def slow_linkage(x, threshold):
    """Merges the closest two groups, one pair at a time."""
    groups = [[i] for i in range(len(x)) if x[i].any()]
    while len(groups) > 1:
        best = max(((np.mean([x[a] @ x[b] for a in g for b in h]), -i, -j) for i, g in enumerate(groups) for j, h in enumerate(groups) if i < j))
        if best[0] < threshold:
            break
        i, j = -best[1], -best[2]
        groups[i] += groups.pop(j)
    return {frozenset(g) for g in groups}


def as_sets(labels):
    return {frozenset(np.flatnonzero(labels == k).tolist()) for k in set(labels.tolist()) - {-1}}


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 14), st.integers(0, 10**6), st.sampled_from([0.2, 0.5, 0.8]))
def test_average_linkage_equals_brute_force(n, seed, threshold):
    rng = np.random.default_rng(seed)
    x = unit(rng.standard_normal((n, 3)))
    assert as_sets(average_linkage(x, threshold)) == slow_linkage(x, threshold)


def test_linkage_ignores_the_order_of_rows_and_zero_rows():
    rng = np.random.default_rng(3)
    x = unit(rng.standard_normal((40, 4)))
    x[5] = 0
    labels = average_linkage(x, 0.6)
    order = rng.permutation(40)
    assert labels[5] == -1 and (average_linkage(x[order], 0.6) == labels[order]).all()
    assert average_linkage(np.zeros((3, 4)), 0.5).tolist() == [-1] * 3 and average_linkage(x[:1], 0.5).tolist() == [0]


def test_linkage_of_a_full_folder_ends():
    x = unit(np.random.default_rng(20).standard_normal((2000, 16)))
    assert average_linkage(x, 0.8).max() > 0


def test_clusters_of_folders(spark):
    rows = [("f", k, [1.0, 0.01 * k]) for k in range(3)] + [("f", 9, [0.0, 1.0]), ("g", 0, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "folder string, pos long, vec array<double>")
    out = {(r.folder, r.pos): (r.cluster, r.closest) for r in clusters(df, 0.7).collect()}
    assert out["f", 0][0] == out["f", 2][0] != out["f", 9][0] and out["g", 0] == (0, 0.0)


@pytest.mark.parametrize("limit", [1, 3, 7, 100])
def test_even_sample(spark, limit):
    rows = [(f, f"{k:03d}") for f, n in (("a", 50), ("b", 3), ("c", 8)) for k in range(n)]
    out = evenly_sampled(spark.createDataFrame(rows, "folder string, name string"), ["folder"], ["name"], limit).collect()
    for folder, n in (("a", 50), ("b", 3), ("c", 8)):
        wanted = list(range(n)) if n <= limit else [int(k * (n / limit)) for k in range(limit)]
        assert [int(r.name) for r in sorted(out, key=lambda r: r.pos) if r.folder == folder] == wanted
        assert sorted(r.pos for r in out if r.folder == folder) == list(range(len(wanted)))


def test_ranks_span_tasks(spark):
    df = spark.range(1000).withColumn("k", F.lit("x")).repartition(7)
    out = ranked(df, ["k"], ["id"]).collect()
    assert all(r.pos == r.id for r in out) and len(out) == 1000


def test_ancestry(spark):
    df = spark.createDataFrame([("/a",), ("/a/b",), ("/a/b/c",), ("/ab",), (None,), ("/a",)], "folder string")
    assert {tuple(r) for r in ancestry(df).collect()} == {("/a", "/a", 0), ("/a/b", "/a/b", 0), ("/a/b/c", "/a/b/c", 0), ("/ab", "/ab", 0), ("/a", "/a/b", 1), ("/a", "/a/b/c", 2), ("/a/b", "/a/b/c", 1)}
    assert {r.folder for r in outermost(df, "folder").collect()} == {"/a", "/ab"}


@pytest.mark.parametrize(
    "line, gone",
    [
        ("*.tmp", {"/r/a.tmp", "/r/d/b.tmp"}),
        ("d/", {"/r/d/b.tmp", "/r/d/x.txt", "/r/d/e/y.txt"}),
        ("/a.tmp", {"/r/a.tmp"}),
        ("d/*", {"/r/d/b.tmp", "/r/d/x.txt", "/r/d/e/y.txt"}),
        ("d/**/y.txt", {"/r/d/e/y.txt"}),
        ("**/x.txt", {"/r/d/x.txt"}),
        ("x.txt/", set()),
        ("# all", set()),
        ("[ab].tmp", {"/r/a.tmp", "/r/d/b.tmp"}),
        ("D", set()),
    ],
)
def test_rules(spark, line, gone):
    paths = {"/r/a.tmp", "/r/d/b.tmp", "/r/d/x.txt", "/r/d/e/y.txt", "/other/a.tmp"}
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    rule = compile_rule("/r", line)
    assert {r.path for r in without_ignored(df, [rule] if rule else []).collect()} == paths - gone


def test_encoding_of_distinct_texts(spark):
    df = spark.createDataFrame([(1, "Report near"), (2, "Report near"), (3, " "), (4, None), (5, "none")], "id int, text string")
    out = {r.id: list(r.v) for r in encode_distinct(df, {"text": "v"}, MarkerEmbedder(("report", "near"))).collect()}
    assert out[1] == out[2] == pytest.approx([0.5**0.5] * 2) and out[3] == out[4] == out[5] == [0.0, 0.0]
    known = spark.createDataFrame([("none", [1.0, 0.0])], "text string, vec array<double>")
    assert {r.id: list(r.v) for r in encode_distinct(df, {"text": "v"}, MarkerEmbedder(("report", "near")), known).collect()}[5] == [1.0, 0.0]


def test_hashed_vectors():
    x = HashedEmbedder(64).vectors(["harbour tide mooring ferry", "ferry mooring tide quay", "oven flour butter yeast", ""])
    assert x[0] @ x[1] > 0.5 > abs(x[0] @ x[2]) and not x[3].any()


def test_scores_count_a_family_once(spark):
    df = spark.createDataFrame([("f", "strays", 1.0), ("f", "unrelated_topics", 0.5), ("f", "debris", 1.0), ("g", "other", 2.0)], "folder string, code string, severity double")
    out = {r.folder: r.raw for r in scores(df).collect()}
    assert out["f"] == pytest.approx(100 * (1 - 0.15 * 0.65)) and out["g"] == pytest.approx(30)


def test_visibility(spark):
    df = spark.createDataFrame([("a", True, 0), ("b", True, 1), ("c", True, 3), ("d", False, 0)], "folder string, judged boolean, verdict int")
    names = lambda **x: "".join(sorted(r.folder for r in visible(df, **x).collect()))
    assert names() == "bc" and names(min_verdict=2) == "c" and names(show_tidy=True) == "abc" and names(show_skipped=True) == "bcd" and names(show_all=True) == "abcd" and names(min_verdict=3, fail_over=1) == "bc"
