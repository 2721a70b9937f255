"""The whole audit of a collection of files as one plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from kartei.functions.tokens import name_tokens
from kartei.operators import clustering as C
from kartei.operators.ancestry import ancestry
from kartei.operators.embedding import Embedder, embedded_texts, file_vectors, name_phrases
from kartei.operators.score import analyses
from kartei.plans.lineage import materialise
from kartei.plans.ranking import evenly_sampled
from kartei.settings import Settings, Thresholds
from kartei.signals import Frames, run_all


@dataclass
class Audit:
    analyses: DataFrame
    findings: DataFrame
    failed_signals: list[str]
    frames: Frames


def sampled_files(files: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """(files with pos, folders with n_files and truncated): folders over the limit are sampled evenly by name."""
    rows = evenly_sampled(files.where(F.col("folder").isNotNull() & F.col("name").isNotNull()), ["folder"], ["name", "path"], settings.max_files_per_folder)
    kept = materialise(rows)
    folders = kept.groupBy("folder").agg(F.count(F.lit(1)).cast("int").alias("n_files"), F.max("truncated").alias("truncated"))
    return kept.drop("truncated"), folders


#: Called with the name of a step that begins, its number from 1 and the number of steps.
Progress = Callable[[str, int, int], None]
STEPS = ("sampling", "embedding", "clustering", "labels", "signals", "scores", "placement")


def frames(files: DataFrame, embedder: Embedder, settings: Settings = Settings(), folders: DataFrame | None = None, known: DataFrame | None = None, progress: Progress | None = None) -> Frames:
    """Evidence of all folders. files: folder, path, name, stem, ext, size, mtime (timestamp or seconds), kind, textual,
    text (nullable), digest (nullable). folders: further folders (folder), which may be empty."""
    tell = (lambda step: progress(step, STEPS.index(step) + 1, 4)) if progress else (lambda step: None)
    tell("sampling")
    seconds = F.col("mtime").cast("double") if dict(files.dtypes)["mtime"] != "timestamp_ntz" else F.unix_micros(F.col("mtime").cast("timestamp")) / 1e6
    ready = files.withColumns({"mtime": seconds, "text": F.coalesce("text", F.lit("")), "tokens": name_tokens(F.col("stem"))})
    kept, counted = sampled_files(ready, settings)
    every = counted if folders is None else folders.select("folder").where("folder is not null").distinct().join(counted, "folder", "full").withColumns({"n_files": F.coalesce("n_files", F.lit(0)), "truncated": F.coalesce("truncated", F.lit(0))})
    every = materialise(every.select("folder", "n_files", "truncated"))
    named = name_phrases(kept)
    tell("embedding")
    dictionary = known if known is None else materialise(embedded_texts(named, embedder, known))
    vectors = materialise(file_vectors(named, embedder, dictionary, settings.text_weight_thin, settings.text_weight_rich, settings.min_text_chars))
    tell("clustering")
    thresholds = Thresholds.derive(embedder.scale, settings)
    enough = every.where(F.col("n_files") >= settings.min_files).select("folder")
    members = materialise(C.clusters(vectors.join(enough, "folder", "left_semi"), thresholds.cluster))
    tell("labels")
    labels = materialise(C.cluster_labels(C.file_terms(kept), members))
    tree = materialise(ancestry(every))
    return Frames(kept, vectors, members, labels, every, tree, settings, thresholds, dictionary)


def audit(files: DataFrame, embedder: Embedder, settings: Settings = Settings(), folders: DataFrame | None = None, known: DataFrame | None = None, check: bool = False, progress: Progress | None = None) -> Audit:
    """Score, verdict and findings of every folder. With ``report_placement`` folders that look out of place are judged,
    too, even where they have few files."""
    steps = len(STEPS) if settings.report_placement else len(STEPS) - 1
    tell = (lambda step: progress(step, STEPS.index(step) + 1, steps)) if progress else (lambda step: None)
    f = frames(files, embedder, settings, folders, known, lambda step, at, of: tell(step))
    tell("signals")
    found, failed = run_all(f, check=check)
    found = materialise(found)
    tell("scores")
    main = C.meaningful(f.members, f.folders, settings.meaningful_min, settings.meaningful_share)
    rows = f.folders
    judged = analyses(rows, found, f.members, main, settings)
    if settings.report_placement:
        from kartei.operators.placement import misplaced_folders

        tell("placement")
        placed = materialise(misplaced_folders(f, embedder))
        found = found.join(rows.where(F.col("n_files") >= settings.min_files).select("folder"), "folder", "left_semi").unionByName(placed.withColumn("ordinal", F.lit(1000)))
        again = analyses(rows.withColumn("n_files", F.col("n_files") + settings.min_files), found, f.members, main, settings).select("folder", "score", "verdict", "findings")
        fired = placed.select("folder").distinct()
        changed = judged.join(fired, "folder", "left_semi").drop("score", "verdict", "findings", "judged", "skip_reason").join(again, "folder").withColumns({"judged": F.lit(True), "skip_reason": F.lit(None).cast("string")})
        judged = judged.join(fired, "folder", "left_anti").unionByName(changed)
    if settings.max_depth is not None:
        # The depth of reports is no limit of the evidence: it is filtered last.
        top = f.tree.groupBy("descendant").agg(F.max("distance").alias("depth"))
        judged = judged.join(top.where(F.col("depth") <= settings.max_depth).select(F.col("descendant").alias("folder")), "folder", "left_semi")
    return Audit(judged, found, failed, f)
