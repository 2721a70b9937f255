"""Signals: functions from the frames of an audit to a table of findings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from kartei.settings import Settings, Thresholds

FINDING = ("folder", "code", "severity", "headline", "detail", "examples", "data")


@dataclass
class Frames:
    """What signals may read. All tables share the key folder; files of a folder have places pos from 0.

    files: folder, pos, name, stem, ext, size, mtime (seconds, double), kind, text, digest (of the content, nullable)
    vectors: folder, pos, vec array<double>, topical
    members: folder, pos, cluster, closest
    labels: folder, cluster, labels array<string>
    folders: folder, n_files, truncated
    tree: ancestor, descendant, distance
    dictionary: text, vec of all texts that were embedded or known, where a dictionary was given
    """

    files: DataFrame
    vectors: DataFrame
    members: DataFrame
    labels: DataFrame
    folders: DataFrame
    tree: DataFrame
    settings: Settings
    thresholds: Thresholds
    dictionary: DataFrame | None = None


Signal = Callable[[Frames], DataFrame]
REGISTRY: list[tuple[str, Signal]] = []


def signal(fn: Signal) -> Signal:
    """Add a signal; findings of equal severity keep the order in which signals were added."""
    REGISTRY.append((fn.__name__, fn))
    return fn


def ordered(sort: Column | str, *columns: Column | str, descending: bool = False) -> Column:
    """collect_list in the order of ``sort``: an array of the columns (of the single column itself)."""
    named = [F.col(c) if isinstance(c, str) else c for c in columns]
    key = F.col(sort) if isinstance(sort, str) else sort
    fields = F.collect_list(F.struct(key.alias("_k"), *(c.alias(f"_v{i}") for i, c in enumerate(named))))
    items = F.sort_array(fields, asc=not descending)
    return F.transform(items, lambda s: s["_v0"]) if len(named) == 1 else items


def finding(rows: DataFrame, code: str | Column, severity: Column, headline: Column, detail: Column, examples: Column, data: Column) -> DataFrame:
    """Rows of the findings schema; severity is clamped to [0, 1], data becomes JSON."""
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), severity))
    return rows.select("folder", (F.lit(code) if isinstance(code, str) else code).alias("code"), clamped.alias("severity"), headline.alias("headline"), detail.alias("detail"), examples.cast("array<string>").alias("examples"), F.to_json(data).alias("data"))


def run_all(frames: Frames, registry: list[tuple[str, Signal]] | None = None, check: bool = False) -> tuple[DataFrame, list[str]]:
    """(findings of all signals with their ordinal, names of signals that failed).

    Plans are lazy, so only failures while a plan is built are caught; with ``check`` each signal is
    run on its own first and failures at run time are caught, too.
    """
    found, failed = None, []
    for ordinal, (name, fn) in enumerate(REGISTRY if registry is None else registry):
        try:
            part = fn(frames).select(*FINDING).withColumn("ordinal", F.lit(ordinal))
            if check:
                part.write.format("noop").mode("overwrite").save()
        except Exception:  # noqa: BLE001 - one signal must not end the audit
            failed.append(name)
            continue
        found = part if found is None else found.unionByName(part)
    if found is None:
        spark = frames.files.sparkSession
        found = spark.createDataFrame([], "folder string, code string, severity double, headline string, detail string, examples array<string>, data string, ordinal int")
    return found, failed


def label_text(labels: Column) -> Column:
    return F.coalesce(F.array_join(labels, " · "), F.lit("no shared wording"))


from kartei.signals import leftovers, shape, time, topics  # noqa: E402, F401 - the order is that of the registry
