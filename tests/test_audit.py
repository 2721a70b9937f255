import json

import pytest
from pyspark.sql import functions as F

from kartei.operators.embedding import MarkerEmbedder
from kartei.plans.audit import audit, frames
from kartei.settings import Settings
from kartei.signals.leftovers import near_pairs, overlap_bound

MARKS = ("alpha", "beta", "gamma", "delta")
DAY = 86400.0
SCHEMA = "folder string, path string, name string, stem string, ext string, size long, mtime double, kind string, textual boolean, text string, digest string"


def body(mark, k=0):
    return f"{mark} " + "words that say a little more about it " * 4 + f"number {k}"


def file(folder, name, text="", size=10, mtime=1e9, kind="text", digest=None):
    stem, _, ext = name.rpartition(".") if "." in name else (name, "", "")
    return (folder, f"{folder}/{name}", name, stem, ext, size, mtime, kind, kind == "text", text, digest or f"{folder}/{name}")


def subject(folder, mark, n, start=0, **facts):
    return [file(folder, f"{mark}{k + start}x{k}.txt", body(mark, k), **facts) for k in range(n)]


def codes(row):
    return [f.code for f in row.findings or ()]


def found(row, code):
    return row.findings[codes(row).index(code)]


MIXED = [r for m in MARKS for r in subject("/mixed", m, 2)]
COPIES = [file("/copies", f"copy{k}a.txt", body("alpha", 7), digest="same") for k in range(3)] + subject("/copies", "alpha", 6)
ROWS = [
    *subject("/three", "alpha", 3), *subject("/three", "beta", 3), *subject("/three", "gamma", 3),
    *subject("/single", "alpha", 9),
    *subject("/side", "alpha", 20), *subject("/side", "beta", 1),
    *MIXED,
    *subject("/debris", "alpha", 6), file("/debris", ".DS_Store", kind="junk"), file("/debris", "a.tmp", kind="junk"), file("/debris", "untitled.txt", size=3), file("/debris", "empty.txt", size=0),
    *[file("/piles", n, body("alpha")) for n in ("plan.txt", "plan_final.txt", "plan v2.txt", "plan (1).txt")], *subject("/piles", "alpha", 6),
    *[file("/pages", f"page{k}.txt", body("alpha", k)) for k in range(10)],
    *COPIES, *[(("/pair",) + r[1:]) for r in COPIES[1:]],
    *subject("/crowd", "alpha", 120),
    *subject("/eras", "alpha", 4, mtime=1e9), *subject("/eras", "beta", 4, mtime=1e9 + 1500 * DAY),
    *[file("/archive", f"alpha{k}x.txt", body("alpha", k), mtime=1e9 + 400 * k * DAY) for k in range(9)],
    *subject("/loose", "beta", 6), *subject("/loose", "alpha", 3), *subject("/loose/child", "alpha", 5),
    *subject("/few", "alpha", 4),
    ("/few", "/few/odd", "odd", "odd", "", None, None, "unknown", False, None, None),
    (None, "/nowhere", "x", "x", "", 1, 1.0, "text", True, "", ""),
]


@pytest.fixture(scope="module")
def audited(spark):
    out = audit(spark.createDataFrame(ROWS, SCHEMA), MarkerEmbedder(MARKS), Settings(report_crowding=True), check=True)
    assert out.failed_signals == []
    return {r.folder: r for r in out.analyses.collect()}


def test_subjects(audited):
    row = audited["/three"]
    assert "unrelated_topics" in codes(row) and row.verdict >= 2 and row.clusters == row.meaningful_clusters == 3
    data = json.loads(found(row, "unrelated_topics").data)
    assert [g["count"] for g in data["groups"]] == [3, 3, 3] and data["coverage"] == 1.0
    assert audited["/single"].verdict == 0 and not {"unrelated_topics", "strays"} & set(codes(audited["/single"]))
    assert "unrelated_topics" not in codes(audited["/side"])


def test_strays(audited):
    assert codes(audited["/mixed"]) == ["no_common_thread"] and json.loads(found(audited["/mixed"], "no_common_thread").data)["readable"] == 8


def test_debris_and_piles(audited):
    item = found(audited["/debris"], "debris")
    assert json.loads(item.data)["count"] == 4 and item.detail == "empty, leftover, never named"
    assert "version_pileups" not in codes(audited["/pages"])
    assert json.loads(found(audited["/piles"], "version_pileups").data)["families"] == {"plan": ["plan (1).txt", "plan v2.txt", "plan.txt", "plan_final.txt"]}


def test_copies(audited):
    assert "2 byte for byte" in found(audited["/copies"], "duplicates").detail and "duplicates" not in codes(audited["/pair"])


def test_crowding(audited):
    assert json.loads(found(audited["/crowd"], "overcrowded").data) == {"count": 120, "soft_limit": 40} and "overcrowded" not in codes(audited["/side"])


def test_eras(audited):
    assert "4 files" in found(audited["/eras"], "time_strata").detail and "time_strata" not in codes(audited["/archive"])


def test_misfiled(audited):
    item = found(audited["/loose"], "misfiled_neighbours")
    assert json.loads(item.data)["count"] == 3 and item.detail == "3 belong with what lies in child/."


def test_few_files_are_not_judged(audited):
    row = audited["/few"]
    assert not row.judged and row.skip_reason == "too_few_files" and row.score == 0 and not row.findings and row.n_files == 5


def test_bands(audited):
    assert all(0 <= r.score <= 100 and r.verdict == sum(r.score >= x for x in (25, 50, 75)) for r in audited.values())


def test_near_copies(spark):
    long = "alpha beta " + "a sentence that goes on for a while and then some more " * 12
    rows = [file("/f", "one.txt", long), file("/f", "two.txt", long + "!"), file("/f", "three.txt", long[:300]), *subject("/f", "gamma", 5)]
    f = frames(spark.createDataFrame(rows, SCHEMA), MarkerEmbedder(MARKS))
    pairs = near_pairs(f.__class__(**{**f.__dict__, "thresholds": f.thresholds.__class__(0.5, 0.4, 0.1, 0.6)})).collect()
    names = {r.pos: r.name for r in f.files.collect()}
    assert {frozenset((names[p.a], names[p.b])) for p in pairs} >= {frozenset(("one.txt", "two.txt"))}
    assert not any("three.txt" in (names[p.a], names[p.b]) for p in pairs)


def test_overlap_bound(spark):
    df = spark.createDataFrame([("aab", "abb"), ("", "x"), ("abc", "cba")], "a string, b string")
    assert [round(r[0], 6) for r in df.select(overlap_bound(F.col("a"), F.col("b"))).collect()] == [round(4 / 6, 6), 0.0, 1.0]


def test_out_of_place(spark):
    rows = []
    for name in ("one", "two", "three"):
        rows += subject(f"/r/greek/{name}", "alpha", 6)
    rows += subject("/r/greek/odd", "beta", 6) + subject("/r/greek", "alpha", 3)
    for name in ("four", "five"):
        rows += subject(f"/r/latin/{name}", "beta", 6)
    folders = spark.createDataFrame([("/r",), ("/r/greek",), ("/r/latin",)], "folder string")
    out = audit(spark.createDataFrame(rows, SCHEMA), MarkerEmbedder(MARKS), Settings(report_placement=True), folders)
    found = {r.folder: json.loads(r.data) for r in out.findings.where("code = 'folder_placement'").collect()}
    assert "/r/greek/odd" in found and found["/r/greek/odd"]["related_folder"].startswith("/r/latin")
    assert not {"/r/greek/one", "/r/latin/four"} & set(found)


def test_order_of_rows_and_depth(spark):
    rows = [r for r in ROWS if r[0] and r[0].startswith(("/loose", "/three", "/few"))]
    first, again = ({r.folder: (r.score, codes(r)) for r in audit(spark.createDataFrame(x, SCHEMA), MarkerEmbedder(MARKS), Settings(max_depth=d)).analyses.collect()} for x, d in ((rows, None), (rows[::-1], 0)))
    assert set(first) - set(again) == {"/loose/child"} and all(first[k] == v for k, v in again.items()) and "misfiled_neighbours" in again["/loose"][1]


def test_nothing_to_audit(spark):
    assert audit(spark.createDataFrame([], SCHEMA), MarkerEmbedder(MARKS)).analyses.count() == 0
