"""The driver's tables as the frames of an audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kartei.functions.kinds import with_kind


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest_files(files: DataFrame) -> DataFrame:
    """One row per file_id: of its scans the latest, by scanned_at, ingested_at, then the greater values."""
    order = F.struct("scanned_at", "ingested_at", F.coalesce("size", F.lit(-1)).alias("s"), F.coalesce(F.unix_micros(F.col("mtime").cast("timestamp")), F.lit(0)).alias("m"), F.coalesce("ext", F.lit("")).alias("e"), F.coalesce("kind", F.lit("")).alias("k"))
    kept = ("folder", "path", "name", "stem", "ext", "size", "mtime")
    last = files.where("file_id is not null").groupBy("file_id").agg(F.max(F.struct(order.alias("o"), F.struct(*kept).alias("v"))).alias("x"))
    return last.select("file_id", *(F.col(f"x.v.{c}").alias(c) for c in kept)).withColumn("ext", F.lower(F.coalesce("ext", F.lit(""))))


def files_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest files with kind, domain and textual."""
    return with_kind(latest_files(table(spark, sf_dir, "files")))


def excerpts(extracted: DataFrame) -> DataFrame:
    """(file_id, text): one text per file, of several the greatest."""
    return extracted.where("file_id is not null and text is not null").groupBy("file_id").agg(F.max("text").alias("text"))
