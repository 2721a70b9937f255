"""Scanning a file tree level by level, each level a Spark job over the folders found above."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from kartei.functions.kinds import with_kind
from kartei.plans.lineage import materialise
from kartei.plans.ranking import evenly_kept, ranked
from kartei.settings import Settings
from kartei.sources.cache import looked_up
from kartei.sources.ignore import NOTABLE_HIDDEN, Rule, read_rules
from kartei.sources.readers import with_digests, with_text

RULE_FILE = ".auditignore"
ENTRY = "folder string, path string, name string, size long, mtime double, is_folder boolean, depth int, rules string, error string"
_NOTABLE = re.compile(NOTABLE_HIDDEN)


def _ignored(rules: list[list], path: str, is_folder: bool) -> bool:
    for base, pattern, folders_only in rules:
        below = path[len(base.rstrip("/")) + 1 :]
        if (is_folder or not folders_only) and re.match(pattern, below):
            return True
    return False


def list_folder(folder: str, depth: int, rules: list[list], settings: Settings) -> Iterator[tuple]:
    """Entries of one folder that a scan keeps. Errors of single entries are passed over; an unreadable folder is empty."""
    try:
        entries = sorted(os.scandir(folder), key=lambda e: e.name)
    except OSError:
        return
    try:
        with open(os.path.join(folder, RULE_FILE), "rb") as source:
            rules = rules + [[r.base, r.pattern, r.folders_only] for r in read_rules(folder, source.read())]
    except FileNotFoundError:
        pass
    except (OSError, UnicodeError) as x:
        yield folder, os.path.join(folder, RULE_FILE), RULE_FILE, None, None, False, depth, "", f"{type(x).__name__}: the rule file must be readable UTF-8 text"
    packed = json.dumps(rules)
    for entry in entries:
        try:
            if entry.name == RULE_FILE or entry.is_symlink() and not settings.follow_symlinks:
                continue
            is_folder = entry.is_dir()
            shown = settings.include_hidden or not entry.name.startswith(".") or not is_folder and _NOTABLE.match(entry.name)
            if not shown or is_folder and settings.is_ignored(entry.name) or _ignored(rules, entry.path, is_folder):
                continue
            if is_folder:
                yield folder, os.path.realpath(entry.path), entry.name, None, None, True, depth + 1, packed, None
            elif entry.is_file():
                facts = entry.stat()
                yield folder, entry.path, entry.name, facts.st_size, facts.st_mtime, False, depth, "", None
        except OSError:
            continue


def scan(spark: SparkSession, root: str, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """(files, folders) below a folder of a file system that all executors share.

    files: folder, path, name, stem, ext, size, mtime, kind, domain, textual. folders: folder, parent, depth. The whole tree is
    scanned whatever max_depth says: that limits reports, not evidence.
    """
    start = os.path.realpath(os.path.expanduser(root))
    if not os.path.isdir(start):
        raise NotADirectoryError(root)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [e for f in batch.to_pylist() for e in list_folder(f["path"], f["depth"], json.loads(f["rules"] or "[]"), settings)]
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.bool_(), pa.int32(), pa.string(), pa.string())
            names = [c.split()[0] for c in ENTRY.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    frontier = spark.createDataFrame([(start, 0, "[]")], "path string, depth int, rules string")
    folders = spark.createDataFrame([(start, os.path.dirname(start), 0)], "folder string, parent string, depth int")
    levels = []
    while True:
        level = materialise(frontier.repartition("path").mapInArrow(work, ENTRY))
        levels.append(level)
        errors = level.where("error is not null").select("path", "error").limit(1).collect()
        if errors:
            raise OSError(f"{errors[0].path}: {errors[0].error}")
        found = level.where("is_folder").groupBy("path").agg(F.min(F.struct("folder", "depth", "rules")).alias("x")).select("path", "x.folder", "x.depth", "x.rules")
        new = materialise(found.join(folders.select(F.col("folder").alias("path")), "path", "left_anti"))
        if not new.limit(1).count():
            break
        folders = materialise(folders.unionByName(new.select(F.col("path").alias("folder"), F.col("folder").alias("parent"), "depth")))
        frontier = new.select("path", "depth", "rules")
    entries = levels[0]
    for level in levels[1:]:
        entries = entries.unionByName(level)
    files = entries.where("not is_folder and error is null").select("folder", "path", "name", "size", "mtime")
    ext = F.lower(F.regexp_extract("name", r"[^.]\.([^.]*)$", 1))
    stem = F.when(F.col("name").rlike(r"[^.]\.[^.]+$"), F.regexp_replace("name", r"\.[^.]+$", "")).otherwise(F.col("name"))
    return with_kind(files.withColumns({"stem": stem, "ext": ext})), folders


def read_texts(files: DataFrame, settings: Settings = Settings(), cached: DataFrame | None = None) -> DataFrame:
    """files with text and digest. Of a folder's images only an even sample is described.

    cached: rows of an earlier run (path, size, mtime, settings, text, accessed). A file is read again if its size or time or
    the settings of reading have changed since.
    """
    images = files.where("kind = 'image'")
    counts = images.groupBy("folder").agg(F.count(F.lit(1)).alias("_n"))
    chosen = ranked(images.select("folder", "path", "name"), ["folder"], ["name"], "_at").join(counts, "folder").where(evenly_kept(F.col("_at"), F.col("_n"), settings.described_images)).select("path", F.lit(True).alias("_chosen"))
    marked = files.join(chosen, "path", "left").withColumn("described", (F.col("kind") != "image") | F.coalesce("_chosen", F.lit(False))).drop("_chosen")
    if cached is None:
        read = with_text(marked.repartition("path"), settings)
    else:
        known = materialise(looked_up(marked, cached, settings.reading_key()))
        fresh = with_text(known.where("text is null").drop("text").repartition("path"), settings)
        read = known.where("text is not null").unionByName(fresh)
    return with_digests(read.drop("described"))


def rules_of(pairs: list[tuple[str, str]]) -> list[Rule]:
    """Rules from (folder, line) pairs; blank lines and comments are passed over."""
    from kartei.sources.ignore import compile_rule

    return [r for base, line in pairs if (r := compile_rule(base, line))]
