"""The cache of texts and vectors as tables: lookups, misses, and eviction of what was used least recently."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kartei.plans.ranking import ranked

TEXTS, VECTORS = 100_000, 250_000


def hex_float(seconds: Column) -> Column:
    """Epoch seconds as the hexadecimal float that the cache uses as a key, e.g. 0x1.69473c791ba5ep+30."""
    java = F.call_function("reflect", F.lit("java.lang.Double"), F.lit("toHexString"), F.coalesce(seconds.cast("double"), F.lit(0.0)))
    fraction = F.rpad(F.regexp_replace(F.regexp_extract(java, r"\.([0-9a-f]+)p", 1), "^0$", ""), 13, "0")
    exponent = F.regexp_extract(java, r"p(-?\d+)$", 1)
    sign = F.when(exponent.startswith("-"), "").otherwise("+")
    plain = F.concat(F.regexp_extract(java, r"^(-?0x[01])\.", 1), F.lit("."), fraction, F.lit("p"), sign, exponent)
    return F.when(seconds == 0, "0x0.0p+0").when(seconds.isNotNull(), plain)


def hex_seconds(micros: Column) -> Column:
    return hex_float(micros / F.lit(1e6))


def seconds_of(files: DataFrame) -> Column:
    """mtime as epoch seconds, whatever its type."""
    kind = dict(files.dtypes)["mtime"]
    if kind == "double":
        return F.col("mtime")
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', mtime)") if kind == "timestamp_ntz" else F.unix_micros("mtime")
    return micros / F.lit(1e6)


def looked_up(files: DataFrame, cache: DataFrame, settings: str) -> DataFrame:
    """files (path, size, mtime) with the cached text of the same path, size, time and settings; null where it is missing.

    Repeated cache rows count once: the latest used, of several the greatest text.
    """
    held = cache.where(F.col("settings") == settings).groupBy("path", "size", "mtime").agg(F.max(F.struct("accessed", "text")).alias("t"))
    keyed = held.select(F.col("path").alias("_p"), F.col("size").alias("_s"), F.col("mtime").alias("_m"), F.col("t.text").alias("text"))
    rows = files.drop("text").withColumn("_key", hex_float(seconds_of(files)))
    return rows.join(keyed, (F.col("path") == F.col("_p")) & (F.col("size") == F.col("_s")) & (F.col("_key") == F.col("_m")), "left").drop("_p", "_s", "_m", "_key")


def missing(files: DataFrame, cache: DataFrame, settings: str) -> DataFrame:
    """Files whose text has to be extracted."""
    return looked_up(files, cache, settings).where("text is null").drop("text")


def updated(cache: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """The cache with fresh rows in place of old ones of the same key."""
    return cache.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh)


def _latest(rows: DataFrame, keys: list[str], rest: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max(F.struct("accessed", *rest)).alias("x")).select(*keys, "x.accessed", *(F.col(f"x.{c}") for c in rest))


def _first(rows: DataFrame, keys: list[str], capacity: int) -> DataFrame:
    """The ``capacity`` rows used last, ties by key, by distributed ranks."""
    return ranked(rows, [], [F.desc("accessed"), *keys], "_place").where(F.col("_place") < capacity).drop("_place")


def evicted_texts(cache: DataFrame, capacity: int = TEXTS) -> DataFrame:
    """The ``capacity`` texts used last; ties by key."""
    rows = _latest(cache.where("path is not null"), ["path", "size", "mtime", "settings"], ["text"])
    return _first(rows, ["path", "size", "mtime", "settings"], capacity)


def evicted_vectors(cache: DataFrame, capacity: int = VECTORS) -> DataFrame:
    rows = _latest(cache.where("digest is not null"), ["model", "digest"], ["dimensions", "vector"])
    return _first(rows, ["model", "digest"], capacity)


class StoredCache:
    """The tables of a cache in a folder that all executors share. Every write makes a new version; the one before goes."""

    TEXTS = "path string, size long, mtime string, settings string, text string, accessed long"
    VECTORS = "model string, digest string, text string, vec array<double>, accessed long"

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _versions(self, name: str) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        system = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        done = lambda p: system.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
        return sorted(s.getPath().toString() for s in system.listStatus(path) if done(s.getPath())) if system.exists(path) else []

    def read(self, name: str, schema: str) -> DataFrame:
        found = self._versions(name)
        return self.spark.read.schema(schema).parquet(found[-1]) if found else self.spark.createDataFrame([], schema)

    def write(self, name: str, rows: DataFrame) -> None:
        old = self._versions(name)
        rows.write.parquet(f"{self.folder}/{name}/{time.time_ns():020d}")
        for version in old:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(version)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def texts(self) -> DataFrame:
        return self.read("texts", self.TEXTS)

    def vectors(self, model: str) -> DataFrame:
        return self.read("vectors", self.VECTORS).where(F.col("model") == model).select("text", "vec")

    def keep_texts(self, files: DataFrame, settings: str) -> None:
        """files: (path, size, mtime, text), as they were read or looked up now."""
        now = files.select("path", F.coalesce("size", F.lit(0)).cast("long").alias("size"), hex_float(seconds_of(files)).alias("mtime"), F.lit(settings).alias("settings"), "text", F.lit(int(time.time())).cast("long").alias("accessed"))
        self.write("texts", evicted_texts(updated(self.texts(), now.where("mtime is not null"), ["path", "size", "mtime", "settings"])))

    def keep_vectors(self, dictionary: DataFrame, model: str) -> None:
        now = dictionary.select(F.lit(model).alias("model"), F.sha2("text", 256).alias("digest"), "text", "vec", F.lit(int(time.time())).cast("long").alias("accessed"))
        rows = _latest(updated(self.read("vectors", self.VECTORS), now, ["model", "digest"]), ["model", "digest"], ["text", "vec"])
        self.write("vectors", _first(rows, ["model", "digest"], VECTORS).select("model", "digest", "text", "vec", "accessed"))
