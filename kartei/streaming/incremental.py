"""An audit that follows a stream of new files, folder by folder. An extension: batch audits need none of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from kartei.operators.embedding import Embedder
from kartei.plans.audit import audit
from kartei.plans.lineage import passing
from kartei.settings import Settings


def era_windows(files: DataFrame, gap: str = "365 days", delay: str = "1 day", time: str = "mtime") -> DataFrame:
    """(folder, begin, end, files): sessions of a stream (or table) of files that are closed by a gap.

    Rows later than ``delay`` behind the stream are dropped by the watermark; a row exactly one gap later still joins.
    """
    seen = files.withWatermark(time, delay) if files.isStreaming else files
    return seen.groupBy("folder", F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("files")).select("folder", F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "files")


def follow(stream: DataFrame, store: str, embedder: Embedder, sink: Callable[[DataFrame, int], None], settings: Settings = Settings(), checkpoint: str | None = None, **trigger) -> StreamingQuery:
    """Adds each micro-batch of files to ``store`` (Parquet by batch) and audits again the folders it touched.

    The sink has to consume what it is given; the tables behind it go with the batch. A batch that is run again after a failure overwrites its own part of the store, so every file counts once.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{store}/batch={number}")
        touched = batch.select("folder").distinct()
        known = spark.read.option("basePath", store).parquet(store).drop("batch")
        # Of several versions of a file the latest counts.
        last = known.groupBy("path").agg(F.max(F.struct("mtime", *[c for c in known.columns if c not in ("path", "mtime")])).alias("x"))
        files = last.select("path", "x.*").join(touched, "folder", "left_semi")
        with passing():
            sink(audit(files.select(*known.columns), embedder, settings).analyses, number)

    writer = stream.writeStream.foreachBatch(step)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
