"""From findings to scores, verdicts and the analyses of folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kartei.functions.scoring import contribution, family_of, verdict
from kartei.settings import Settings


def scores(findings: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(folder, raw): 100 (1 - product of (1 - c)) over families, c a family's strongest contribution. Not rounded."""
    each = findings.select("folder", family_of(F.col("code")).alias("family"), contribution(F.col("code"), F.col("severity"), settings.weights).alias("c"))
    strongest = each.groupBy("folder", "family").agg(F.max("c").alias("c"))
    return strongest.groupBy("folder").agg((100.0 * (1.0 - F.exp(F.sum(F.log1p(-F.col("c")))))).alias("raw"))


def analyses(folders: DataFrame, findings: DataFrame, members: DataFrame, main: DataFrame, settings: Settings) -> DataFrame:
    """One row per folder: folder, n_files, truncated, clusters, meaningful_clusters, judged, skip_reason, score, verdict, findings.

    Folders with fewer than min_files files are not judged. Findings are sorted by severity, then by the order of the signals.
    """
    judged = F.col("n_files") >= settings.min_files
    counted = findings.join(folders.where(judged).select("folder"), "folder", "left_semi")
    item = F.struct((-F.col("severity")).alias("weak"), "ordinal", "code", "severity", "headline", "detail", "examples", "data")
    lists = counted.groupBy("folder").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.dropFields("weak", "ordinal")).alias("findings"))
    clusters = members.groupBy("folder").agg(F.count_distinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).cast("int").alias("clusters"))
    large = main.groupBy("folder").agg(F.count(F.lit(1)).cast("int").alias("meaningful_clusters"))
    score = F.round(F.coalesce("raw", F.lit(0.0)), 1)
    rows = folders.select("folder", "n_files", "truncated").join(scores(counted, settings), "folder", "left").join(lists, "folder", "left").join(clusters, "folder", "left").join(large, "folder", "left")
    zero = F.lit(0)
    return rows.select(
        "folder", "n_files", "truncated", F.when(judged, F.coalesce("clusters", zero)).otherwise(zero).alias("clusters"), F.when(judged, F.coalesce("meaningful_clusters", zero)).otherwise(zero).alias("meaningful_clusters"), judged.alias("judged"),
        F.when(~judged, "too_few_files").alias("skip_reason"), score.alias("score"), verdict(score).alias("verdict"), "findings",
    )


def worst_first(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("score"), "folder")


def visible(rows: DataFrame, show_all: bool = False, show_skipped: bool = False, show_tidy: bool = False, min_verdict: int = 1, fail_over: int | None = None) -> DataFrame:
    """The rows a report shows: skipped ones on demand, those that fail the run always, tidy ones on demand, and
    those with findings from ``min_verdict`` on."""
    if show_all:
        return rows
    fails = F.col("verdict") >= fail_over if fail_over is not None else F.lit(False)
    level = (F.size(F.coalesce("findings", F.array())) > 0) & (F.col("verdict") >= min_verdict) if "findings" in rows.columns else F.col("verdict") >= min_verdict
    return rows.where(F.when(~F.col("judged"), F.lit(show_skipped)).when(fails, True).when(F.col("verdict") == 0, F.lit(show_tidy)).otherwise(level))


def exit_status(rows: DataFrame, fail_over: int) -> int:
    """1 if a judged folder reaches ``fail_over``, else 0."""
    worst = rows.where("judged").agg(F.max("verdict")).first()[0]
    return int((worst or 0) >= fail_over)
