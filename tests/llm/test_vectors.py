import numpy as np
import pytest
from pyspark.sql import functions as F

from kartei.llm.clusters import cluster_vectors, describe
from kartei.llm.components import components
from kartei.llm.neighbours import footrule_closeness, most_similar, similar_pairs
from kartei.llm.vectors import fold_copies, usable

SCHEMA = "file_id long, vec array<float>, grp string, vec_id long"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], g, i) for i, v, g in rows], SCHEMA)


def cluster(rng, n, similar):
    c = rng.standard_normal(128)
    c /= np.linalg.norm(c)
    x = np.sqrt(similar) * c + np.sqrt((1 - similar) / 128) * rng.standard_normal((n, 128))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def dirty():
    good = np.eye(128)[0]
    return [(9001, None, "m"), (9002, [1.0] * 64, "m"), (9003, [0.0] * 128, "m"), (9004, [float("nan")] + [1.0] * 127, "m"), (9005, [float("inf")] + [1.0] * 127, "m"), (9006, [None] + [1.0] * 127, "m"), (None, good, "m")]


def test_usable_and_copies(spark):
    v = np.arange(1.0, 129)
    df = table(spark, [(5, v, "m"), (3, v, "m"), (3, v, "m"), (8, 2 * v, "m"), (4, -v, None), *dirty()])
    heads, members = fold_copies(usable(df, "file_id", "vec", "grp"))
    assert {(r.id, r.grp, r.copies) for r in heads.collect()} == {(3, "m", 3), (4, "", 1)}
    assert {(r.id, r["head"]) for r in members.collect()} == {(3, 3), (5, 3), (8, 3), (4, 4)}
    tiny, huge = table(spark, [(1, [1e-38] * 128, "m"), (2, [3e38] * 128, "m")]), None
    assert usable(tiny, "file_id", "vec").count() == 2 and huge is None


def test_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    parts = [cluster(rng, n, s) for n, s in ((40, 0.9), (3, 0.75), (5, 0.85), (2, 0.9), (700, 0.85))]
    x = np.concatenate([*parts, cluster(rng, 1, 0.5), *[cluster(rng, 1, 0.5) for _ in range(60)]])
    ids = rng.permutation(len(x)) + 10
    rows = [(int(i), v, "m") for i, v in zip(ids, x)]
    members, density = cluster_vectors(table(spark, rows + rows[:50] + dirty()), "file_id", "vec")
    found = {r.id: r.cluster_id for r in members.collect()}
    want, at = {}, 0
    for n in (40, 3, 5, 2, 700):
        own = ids[at : at + n].tolist()
        at += n
        if n >= 3:
            want |= dict.fromkeys(own, min(own))
    assert found == want
    rows = {r.cluster_id: r for r in describe(members, density).collect()}
    assert sorted(r["size"] for r in rows.values()) == [3, 5, 40, 700] and all(set(r.typical) <= {i for i, c in want.items() if c == k} for k, r in rows.items())


def test_copies_make_a_cluster(spark):
    v = np.ones(128)
    members, _ = cluster_vectors(table(spark, [(k, v, "m") for k in (7, 4, 9)]), "file_id", "vec")
    assert {(r.id, r.cluster_id, r["size"]) for r in members.collect()} == {(4, 4, 3), (7, 4, 3), (9, 4, 3)}


def test_nothing_to_cluster(spark):
    assert cluster_vectors(table(spark, dirty()), "file_id", "vec")[0].count() == 0
    assert most_similar(table(spark, dirty()), "file_id", "vec", "grp").count() == 0


def brute(x, ids, k):
    s = x @ x.T
    np.fill_diagonal(s, -2)
    return {int(ids[i]): [int(ids[j]) for j in sorted(range(len(x)), key=lambda j: (-round(s[i, j], 9), ids[j])) if j != i][:k] for i in range(len(x))}


@pytest.mark.parametrize("groups", [1, 2])
def test_neighbours_against_brute_force(spark, groups):
    rng = np.random.default_rng(6)
    hits = total = 0
    rows, sets = [], []
    for g in range(groups):
        x = np.concatenate([cluster(rng, 30, 0.85) for _ in range(20)] + [cluster(rng, 1, 0.5) for _ in range(200)])
        ids = np.arange(len(x)) + 10_000 * g
        sets.append((x, ids))
        rows += [(int(i), v, f"m{g}") for i, v in zip(ids, x)]
    out = most_similar(table(spark, rows + rows[:20] + dirty()), "file_id", "vec", "grp")
    near = {}
    for r in out.collect():
        near.setdefault(r.id, []).append((r.rank, r.neighbour))
    for x, ids in sets:
        for i, want in brute(x.astype(np.float32).astype(float), ids, 5).items():
            if i % 10_000 < 600:  # members of clusters; what lies far away has no meaningful neighbours
                total += 5
                hits += len(set(want) & {n for _, n in near[i]})
    assert hits / total >= 0.95 and all(len(n) == 5 for n in near.values())
    pairs = similar_pairs(out).collect()
    assert all(p.id_a < p.id_b and p.id_a // 10_000 == p.id_b // 10_000 for p in pairs)


def test_neighbours_of_far_vectors(spark, monkeypatch):
    from kartei.llm import neighbours as N

    monkeypatch.setattr(N, "ROUND", 500, raising=False)  # more than one round
    rng = np.random.default_rng(8)
    x = np.concatenate([cluster(rng, 30, 0.85) for _ in range(30)] + [rng.standard_normal((900, 128))])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32).astype(float)
    near = {}
    for r in N.most_similar(table(spark, [(i, v, "m") for i, v in enumerate(x)]), "file_id", "vec", "grp").collect():
        near.setdefault(r.id, set()).add(r.neighbour)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    held = [len(near[i] & set(np.argsort(-s[i])[:5].tolist())) / 5 for i in range(len(x))]
    assert np.mean(held[900:]) >= 0.99 and np.mean(held) >= 0.9


def test_neighbours_of_copies(spark):
    a, b = np.eye(128)[0], np.eye(128)[0] + 0.1 * np.eye(128)[1]
    rows = [(k, a, "m") for k in range(10)] + [(50, b, "m"), (60, b, "other")]
    near = {}
    for r in most_similar(table(spark, rows), "file_id", "vec", "grp", k=3).orderBy("rank").collect():
        near.setdefault(r.id, []).append(r.neighbour)
    assert near[0] == [1, 2, 3] and near[9] == [0, 1, 2] and near[50] == [0, 1, 2] and 60 not in near


def test_long_lists_are_not_cut(spark, monkeypatch):
    from kartei.llm import neighbours as N

    monkeypatch.setattr(N, "CROWDED", 40)
    rng = np.random.default_rng(1)
    x = cluster(rng, 300, 0.9)
    out = N.most_similar(table(spark, [(k, v, "m") for k, v in enumerate(x)]), "file_id", "vec", "grp")
    want = brute(x.astype(np.float32).astype(float), np.arange(300), 5)
    got = {}
    for r in out.collect():
        got.setdefault(r.id, set()).add(r.neighbour)
    assert np.mean([len(got[i] & set(w)) / 5 for i, w in want.items()]) >= 0.75  # one dense cloud is the hardest case; what counts is that no list is dropped


@pytest.mark.parametrize("whole", [100, 65_536])
def test_many_pivots_miss_no_pair(spark, monkeypatch, whole):
    """The more pivots, the fewer do two similar vectors share: half of all vectors are pivots here."""
    from kartei.llm import neighbours as N

    monkeypatch.setattr(N, "LIST", 2)
    monkeypatch.setattr(N, "WHOLE", whole, raising=False)  # with and without the index
    rng = np.random.default_rng(3)
    x = np.concatenate([cluster(rng, 12, 0.72) for _ in range(60)] + [cluster(rng, 150, 0.9)] + [cluster(rng, 1, 0.5) for _ in range(1500)])
    x = x.astype(np.float32).astype(float)
    out = N.most_similar(table(spark, [(k, v, "m") for k, v in enumerate(x)]), "file_id", "vec", "grp", far=False)
    got = {(p.id_a, p.id_b) for p in similar_pairs(out).collect()}
    s = x @ x.T
    want = {(min(a, b), max(a, b)) for a, near in brute(x, np.arange(len(x)), 5).items() for b in near if s[a, b] >= 0.6}
    # What is linked in numbers over WHOLE (the cluster of 150, of 100) is compared in closer parts.
    large = {p for p in want ^ got if whole < 150 and 720 <= p[0] < 870}
    assert (want ^ got) - large == set() and len(large) <= 0.1 * sum(720 <= p[0] < 870 for p in want)


def test_footrule():
    prefix = np.array([[1, 2, 3], [1, 2, 3], [3, 2, 1], [7, 8, 9]])

    def distance(a, b):
        place = lambda p, v: p.index(v) if v in p else 3
        return sum(abs(place(a, v) - place(b, v)) for v in set(a) | set(b))

    close = footrule_closeness(prefix, slice(0, 4))
    for i in range(4):
        for j in range(4):
            assert 12 - 2 * close[i, j] == distance(prefix[i].tolist(), prefix[j].tolist())


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 60)] + [(100, 200), (200, 300), (5, 5)]
    out = {r.vertex: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {v: l for v, l in out.items() if v <= 60} == dict.fromkeys(range(1, 61), 1) and out[300] == 100
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_clashing_columns(spark):
    df = table(spark, [(k, v, "m") for k, v in enumerate(cluster(np.random.default_rng(0), 6, 0.9))])
    for name in ("label", "id", "copies", "cell", "n", "head", "similarity", "pivot"):
        df = df.withColumn(name, F.lit("clash"))
    assert cluster_vectors(df, "file_id", "vec")[0].count() == 6 and most_similar(df, "file_id", "vec", "grp").count() == 30


def test_bridged_clusters_are_parted(spark):
    """Two clusters 0.5 apart and a vector at more than 0.66 to both: neither may vanish."""
    rng = np.random.default_rng(12)
    basis, _ = np.linalg.qr(rng.standard_normal((128, 128)))
    a, b = basis[0], 0.62 * basis[0] + np.sqrt(1 - 0.62**2) * basis[1]
    spread = lambda c, k: [unit_(0.9 * c + np.sqrt(1 - 0.81) * basis[3 + k]) for k in range(k, k + 10)]
    rows = spread(a, 0) + spread(b, 20) + [unit_(a + b)]
    members, _ = cluster_vectors(table(spark, [(k, v, "m") for k, v in enumerate(rows)]), "file_id", "vec")
    got = {r.id: r.cluster_id for r in members.collect()}
    assert {got.get(k) for k in range(10)} == {0} and {got.get(k) for k in range(10, 20)} == {10}


def unit_(v):
    return v / np.linalg.norm(v)


def test_hot_cells_are_dealt_and_joined(spark, monkeypatch):
    from kartei.llm import clusters as C

    monkeypatch.setattr(C, "CROWDED", 20)
    rng = np.random.default_rng(2)
    x = np.concatenate([cluster(rng, 600, 0.93), cluster(rng, 5, 0.9), rng.standard_normal((300, 128))])
    members, density = C.cluster_vectors(table(spark, [(k, v, "m") for k, v in enumerate(x)]), "file_id", "vec")
    got = {r.id: (r.cluster_id, r["size"]) for r in members.collect()}
    assert got == {**{k: (0, 600) for k in range(600)}, **{k: (600, 5) for k in range(600, 605)}}
    out = {r.cluster_id: r for r in C.describe(members, density).collect()}
    assert set(out) == {0, 600} and len(out[0].typical) == 3 and set(out[600].typical) <= set(range(600, 605))


def test_dense_part_of_a_cell():
    from kartei.llm.clusters import hold_together

    rng = np.random.default_rng(4)
    good, lone = cluster(rng, 4, 0.9), np.eye(128)[:3]
    x = np.concatenate([good, lone, good[:1], lone[:2]]).astype(np.float32)
    cell = np.array([0] * 7 + [1] + [2] * 2)
    row, where = hold_together(cell, np.ones(10, np.int64), x, 0.66)
    assert sorted(zip(where.tolist(), row.tolist())) == [(0, 0), (0, 1), (0, 2), (0, 3)]
