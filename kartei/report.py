"""Reports of an audit: tab-separated lines, JSON, JSON Lines."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, functions as F

from kartei.functions.scoring import verdict_label
from kartei.settings import VERDICTS

COLOURS = ("\033[32m", "\033[36m", "\033[33m", "\033[31m")


def shown_path(path: str, base: str | None = None) -> str:
    """./below where the path lies in the working folder, "." for that itself, else the whole path."""
    base = os.path.realpath(base or os.getcwd())
    if path == base:
        return "."
    return "./" + os.path.relpath(path, base) if path.startswith(base.rstrip("/") + "/") else path


def lines(rows: DataFrame) -> DataFrame:
    """(score, folder, line): SCORE VERDICT FILES PATH FINDINGS, tab-separated, for sinks of text."""
    codes = F.coalesce(F.nullif(F.array_join(F.transform("findings", lambda x: x["code"]), ","), F.lit("")), F.lit("-"))
    score = F.regexp_replace(F.format_string("%.1f", "score"), r"\.0$", "")
    judged = F.concat_ws("\t", score, verdict_label(F.col("verdict")), F.col("n_files").cast("string"), "folder", codes)
    skipped = F.concat_ws("\t", F.lit("-"), F.lit("skipped"), F.col("n_files").cast("string"), "folder", "skip_reason")
    return rows.select("score", "folder", F.when(F.col("judged"), judged).otherwise(skipped).alias("line"))


def as_json(rows: DataFrame) -> DataFrame:
    """(score, folder, value): one JSON object per folder; optional keys only where they say something."""
    item = lambda x: F.struct(x["code"].alias("code"), F.round(x["severity"], 3).alias("severity"), x["headline"].alias("headline"), x["detail"].alias("detail"), x["examples"].alias("examples"), F.parse_json(x["data"]).alias("data"))
    found = F.transform(F.coalesce("findings", F.array()), item)
    judged = F.to_json(F.struct(F.col("folder").alias("path"), F.col("n_files").alias("files"), "score", verdict_label(F.col("verdict")).alias("verdict"), "clusters", found.alias("findings"), F.when(F.col("truncated") > 0, F.col("truncated")).alias("truncated")))
    skipped = F.to_json(F.struct(F.col("folder").alias("path"), F.col("n_files").alias("files"), "skip_reason"))
    return rows.select("score", "folder", F.when(F.col("judged"), judged).otherwise(skipped).alias("value"))


def write_lines(rows: DataFrame, path: str) -> None:
    """The report of a large audit, written by the executors."""
    lines(rows).orderBy(F.desc("score"), "folder").select("line").write.mode("overwrite").text(path)


def write_json_lines(rows: DataFrame, path: str) -> None:
    as_json(rows).orderBy(F.desc("score"), "folder").select("value").write.mode("overwrite").text(path)


def text_report(rows: DataFrame, colour: bool = False) -> str:
    """For the terminal: all lines of the rows, worst first."""
    out = []
    for r in lines(rows).orderBy(F.desc("score"), "folder").toLocalIterator():
        cells = r.line.split("\t")
        if colour and cells[1] in VERDICTS:
            cells[1] = f"{COLOURS[VERDICTS.index(cells[1])]}\033[1m{cells[1]}\033[0m"
        cells[3] = shown_path(cells[3])
        out.append("\t".join(cells))
    return "\n".join(out)


def json_rows(rows: DataFrame, failed: list[str] = ()) -> list[dict]:
    out = []
    for r in as_json(rows).orderBy(F.desc("score"), "folder").toLocalIterator():
        item = json.loads(r.value)
        item["path"] = shown_path(item["path"])
        out.append(item | ({"failed_signals": list(failed)} if failed and "score" in item else {}))
    return out
