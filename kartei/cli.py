"""The command line: python -m kartei [PATH ...]."""

from __future__ import annotations

import argparse
import glob
import json
import os
import sys

from kartei import __version__
from kartei.settings import VERDICTS, Settings

SHOW = ("tidy", "skipped", "all")


def verdict(text: str) -> int:
    """A verdict's number from its name, its number or an unambiguous beginning."""
    text = text.strip().lower().replace("_", "-").replace(" ", "-")
    if text.isdigit() and int(text) < len(VERDICTS):
        return int(text)
    found = [k for k, v in enumerate(VERDICTS) if v == text or text and v.replace("-", "") == text.replace("-", "")]
    if not found:
        raise ValueError(f"unknown verdict {text!r}; one of {', '.join(VERDICTS)}")
    return found[0]


def depth(text: str) -> int:
    value = int(text)
    if value < 0:
        raise argparse.ArgumentTypeError("must not be negative")
    return value


def threshold(text: str) -> float:
    value = float(text)
    if not 0 < value < 1:
        raise argparse.ArgumentTypeError("must lie between 0 and 1")
    return value


def show(text: str) -> frozenset[str]:
    names = frozenset(p.strip() for p in text.split(",") if p.strip())
    if names - set(SHOW):
        raise argparse.ArgumentTypeError(f"unknown: {', '.join(sorted(names - set(SHOW)))}; choose from {', '.join(SHOW)}")
    return names


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kartei", description="Audits how well the files of folders are organised.")
    p.add_argument("paths", nargs="*", help="folders, files or patterns; - reads them from standard input (default: .)")
    form = p.add_mutually_exclusive_group()
    form.add_argument("-j", "--json", action="store_true", help="one JSON document")
    form.add_argument("--jsonl", "--json-lines", action="store_true", help="one JSON object a line")
    p.add_argument("-d", "--depth", "--max-depth", type=depth, help="report folders down to this depth only; evidence is from all")
    p.add_argument("-a", "--all", action="store_true", dest="judge_all", help="judge folders with few files, too")
    p.add_argument("--show", type=show, default=frozenset(), help="tidy, skipped, all; comma-separated")
    p.add_argument("--st", "--show-tidy", action="store_true", dest="show_tidy", help=argparse.SUPPRESS)
    p.add_argument("--ss", "--show-skipped", action="store_true", dest="show_skipped", help=argparse.SUPPRESS)
    p.add_argument("--sa", "--show-all", action="store_true", dest="show_both", help=argparse.SUPPRESS)
    p.add_argument("--hidden", action="store_true", help="include hidden files")
    p.add_argument("-t", "--threshold", type=threshold, help="similarity from which files go together")
    p.add_argument("-m", "--min-verdict", default="lived-in", help="mildest verdict shown")
    p.add_argument("--fail-over", default="messy", help="verdict from which the exit status is 1")
    p.add_argument("-c", "--crowding", action="store_true", help="report crowded folders")
    p.add_argument("-f", "--folder", action="store_true", help="report folders that look out of place")
    p.add_argument("--cache", default=os.environ.get("KARTEI_CACHE"), help="folder shared by all executors that keeps texts and vectors for the next run")
    talk = p.add_mutually_exclusive_group()
    talk.add_argument("-q", "--quiet", action="store_true", help="no report, only the exit status")
    talk.add_argument("-v", "--verbose", action="store_true", help="progress on standard error")
    p.add_argument("-z", "--null", action="store_true", help="paths on standard input end with NUL")
    p.add_argument("--color", choices=("auto", "always", "never"), nargs="?", const="always", default="never")
    p.add_argument("--no-color", dest="color", action="store_const", const="never", help=argparse.SUPPRESS)
    p.add_argument("--version", action="version", version=f"kartei {__version__}")
    return p


def operands(paths: list[str], null: bool, stdin=None) -> list[str]:
    """The paths, with the first - replaced by what standard input lists."""
    out, read = [], False
    for path in paths or ["."]:
        if path != "-":
            out.append(path)
        elif not read:
            read = True
            data = (stdin or sys.stdin.buffer).read()
            out += [os.fsdecode(part.rstrip(b"\r")) for part in (data.split(b"\0") if null else data.splitlines()) if part]
    return out


def roots(paths: list[str]) -> tuple[list[str], list[str]]:
    """(distinct folders, errors): patterns are expanded, a file stands for its folder."""
    found: dict[str, None] = {}
    errors = []
    for path in paths:
        wide = os.path.expanduser(path)
        matches = sorted(glob.glob(wide, recursive=True)) if glob.has_magic(wide) else [wide]
        if not matches:
            errors.append(f"{path}: no matches")
        for match in matches:
            if os.path.isfile(match):
                match = os.path.dirname(match) or "."
            if os.path.isdir(match):
                found.setdefault(os.path.realpath(match))
            else:
                errors.append(f"{match}: no such file or directory")
    return list(found), errors


def without_nested(folders: list[str], limited: bool) -> list[str]:
    """Folders that lie in no other; all of them under a depth limit."""
    if limited:
        return folders
    inside: set[str] = set()
    last = None
    # With / before all other characters, what lies in a folder follows it at once.
    for folder in sorted(folders, key=lambda f: f.rstrip("/").split("/")):
        if last is not None and (folder.rstrip("/") + "/").startswith(last.rstrip("/") + "/"):
            inside.add(folder)
        else:
            last = folder
    return [f for f in folders if f not in inside]


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("kartei").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def main(argv: list[str] | None = None, spark=None, embedder=None) -> int:
    args = parser().parse_args(argv)
    try:
        least, fatal = verdict(args.min_verdict), verdict(args.fail_over)
    except ValueError as x:
        print(f"kartei: {x}", file=sys.stderr)
        return 2
    try:
        folders, errors = roots(operands(args.paths, args.null))
    except OSError as x:
        print(f"kartei: standard input: {x}", file=sys.stderr)
        return 2
    for error in errors:
        print(f"kartei: {error}", file=sys.stderr)
    if not folders:
        return 2 if errors else 0
    from pyspark.sql import functions as F

    from kartei import report
    from kartei.operators.embedding import HashedEmbedder
    from kartei.operators.score import visible
    from kartei.plans.audit import audit
    from kartei.plans.lineage import materialise
    from kartei.sources.cache import StoredCache
    from kartei.sources.tree import read_texts, scan

    settings = Settings(max_depth=args.depth, include_hidden=args.hidden, report_crowding=args.crowding, report_placement=args.folder, threshold=args.threshold, min_files=1 if args.judge_all else Settings().min_files)
    spark, embedder = spark or session(), embedder or HashedEmbedder()
    store = StoredCache(spark, args.cache) if args.cache else None
    colour = args.color == "always" or args.color == "auto" and sys.stdout.isatty() and not os.environ.get("NO_COLOR")
    status, worst, texts, documents, seen = bool(errors), 0, [], [], None
    for root in without_nested(folders, args.depth is not None):
        if args.verbose:
            print(f"kartei {__version__} · {embedder.name} · {root}", file=sys.stderr)
        try:
            files, tree = scan(spark, root, settings)
            read = materialise(read_texts(files, settings, store and store.texts()))
            tell = (lambda step, at, of: print(f"kartei: {at}/{of} {step}", file=sys.stderr)) if args.verbose else None
            done = audit(read, embedder, settings, tree, store and store.vectors(embedder.name), progress=tell)
            if store:
                store.keep_texts(read, settings.reading_key())
                store.keep_vectors(done.frames.dictionary, embedder.name)
        except OSError as x:
            print(f"kartei: {root}: {x}", file=sys.stderr)
            status = True
            continue
        rows = materialise(done.analyses)
        if seen is not None:  # a folder that several roots reach is reported by the first
            rows = rows.join(seen, "folder", "left_anti")
        names = rows.select("folder")
        seen = names if seen is None else seen.unionByName(names)
        worst = max(worst, rows.where("judged").agg(F.max("verdict")).first()[0] or 0)
        shown = visible(rows, "all" in args.show, args.show_skipped or args.show_both or "skipped" in args.show, args.show_tidy or args.show_both or "tidy" in args.show, least, fatal)
        if args.quiet:
            continue
        if args.json or args.jsonl:
            items = report.json_rows(shown, done.failed_signals)
            documents.append({"root": report.shown_path(root), "folders": items})
            texts += [json.dumps(i, ensure_ascii=False) for i in items] if args.jsonl else []
        elif text := report.text_report(shown, colour):
            texts.append(text)
    if not args.quiet:
        out = json.dumps({"roots": documents}, ensure_ascii=False, indent=2) if args.json else "\n".join(texts)
        try:
            if out:
                print(out, flush=True)
        except BrokenPipeError:
            sys.stdout = None
    return 2 if status else int(worst >= fatal)
