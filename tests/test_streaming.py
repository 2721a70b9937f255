from pyspark.sql import functions as F

from kartei.operators.embedding import MarkerEmbedder
from kartei.streaming.incremental import era_windows, follow

SCHEMA = "folder string, path string, name string, stem string, ext string, size long, mtime double, kind string, textual boolean, text string, digest string"


def rows(folder, start, n):
    return [(folder, f"{folder}/n{k}.txt", f"n{k}.txt", f"n{k}", "txt", 5, 1e9, "text", True, "alpha " + "some words " * 20, f"{folder}{k}") for k in range(start, start + n)]


def test_eras_join_at_the_gap(spark):
    df = spark.createDataFrame([("f", 0), ("f", 365), ("f", 731)], "folder string, day int").select("folder", F.timestamp_seconds(F.col("day") * 86400).alias("mtime"))
    assert sorted(r.files for r in era_windows(df).collect()) == [1, 2]


def test_follow(spark, tmp_path):
    source, seen = str(tmp_path / "in"), []
    spark.createDataFrame(rows("/a", 0, 4), SCHEMA).write.mode("append").parquet(source)

    def sink(analyses, number):
        seen.append({r.folder: r.n_files for r in analyses.collect()})

    for extra in (rows("/a", 4, 3) + rows("/b", 0, 1), None):
        query = follow(spark.readStream.schema(SCHEMA).parquet(source), str(tmp_path / "store"), MarkerEmbedder(("alpha",)), sink, checkpoint=str(tmp_path / "check"))
        query.awaitTermination()
        if extra:
            spark.createDataFrame(extra, SCHEMA).write.mode("append").parquet(source)
    assert seen == [{"/a": 4}, {"/a": 7, "/b": 1}]
