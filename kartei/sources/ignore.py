"""Rules that leave files and folders out of a scan."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

#: Hidden names that are looked at all the same.
NOTABLE_HIDDEN = r"^(\.DS_Store|\.localized|\._.*)$"
#: Up to so many rules are broadcast; more are joined by the folder they hold for.
BROADCAST_RULES = 10_000


@dataclass(frozen=True)
class Rule:
    """One line of a rule file: a regular expression on paths relative to ``base``."""

    base: str
    pattern: str
    folders_only: bool


def _segment(glob: str) -> str:
    """A shell pattern of one path segment as a regular expression."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            inner = glob[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner.replace("^", "\\^", 1) if inner[0] == "^" else inner) + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return out


def compile_rule(base: str, line: str) -> Rule | None:
    """A rule from a line; None for blank lines and comments.

    A slash at the end: folders only. No other slash: the name anywhere below. Otherwise the path from ``base``;
    ``*`` stays inside a segment, ``**`` crosses segments.
    """
    text = line.strip()
    if not text or text.startswith("#"):
        return None
    parts = [p for p in text.strip("/").split("/") if p]
    if not parts:
        return None
    if len(parts) == 1 and not text.startswith("/"):
        # "**" by itself is a name pattern like "*".
        return Rule(base, f"^(?:.*/)?{_segment(parts[0])}$", text.endswith("/"))
    out = ""
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        if part == "**":
            out += ".*" if last else "(?:[^/]+/)*"
        else:
            out += _segment(part) + ("" if last else "(?:/|$)" if parts[k + 1 :] == ["**"] else "/")
    return Rule(base, f"^{out}$", text.endswith("/"))


def read_rules(base: str, content: bytes) -> list[Rule]:
    """The rules of a rule file in ``base``; UnicodeDecodeError if it isn't UTF-8."""
    return [r for line in content.decode("utf-8").splitlines() if (r := compile_rule(base, line))]


def hidden(name) -> F.Column:
    """Names that begin with a dot, but for the notable ones."""
    return name.startswith(".") & ~name.rlike(NOTABLE_HIDDEN)


def in_ignored_folder(path, names: frozenset[str]) -> F.Column:
    """Whether a folder above the last segment has one of the names."""
    parts = F.split(path, "/")
    return F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p.isin(sorted(names)))


def without_ignored(files: DataFrame, rules: list[Rule], path: str = "path") -> DataFrame:
    """files that no rule leaves out; a rule that leaves a folder out leaves out all below it.

    A path is held against the rules of the folders above it: the path's prefixes are joined to the rules' bases, so the
    plan is an equi-join. Each way from a base to the file is tried as folder, the file itself as file.
    """
    if not rules:
        return files
    spark = files.sparkSession
    table = spark.createDataFrame([(r.base.rstrip("/"), r.pattern, r.folders_only) for r in rules], "base string, pattern string, folders_only boolean")
    keyed = files.where(F.col(path).isNotNull()).select(F.col(path).alias("_path")).distinct()
    parts = F.split("_path", "/")
    prefixes = keyed.select("_path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("base"))
    pairs = prefixes.join(F.broadcast(table) if len(rules) <= BROADCAST_RULES else table, "base").where(F.length("_path") > F.length("base"))
    relative = F.split(F.expr("substring(_path, length(base) + 2)"), "/")
    ways = F.transform(F.sequence(F.lit(1), F.size(relative)), lambda k: F.struct(F.array_join(F.slice(relative, 1, k), "/").alias("way"), (k < F.size(relative)).alias("folder")))
    hits = pairs.select("_path", "pattern", "folders_only", F.explode(ways).alias("w")).where((F.col("w.folder") | ~F.col("folders_only")) & F.expr("w.way rlike pattern")).select("_path").distinct()
    return files.join(hits, F.col(path) == F.col("_path"), "left_anti")
