"""Kinds of files by extension and name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Extensions by kind; an extension listed twice belongs to the later kind.
EXTENSIONS = {
    "image": "jpg jpeg png gif bmp tiff tif webp heic heif raw cr2 nef arw dng svg ico avif",
    "video": "mp4 mov avi mkv wmv flv webm m4v mpg mpeg 3gp mts",
    "audio": "mp3 wav flac aac ogg m4a wma aiff opus mid midi",
    "document": "doc docx odt rtf pages wpd",
    "spreadsheet": "xls xlsx ods numbers",
    "presentation": "ppt pptx odp key",
    "pdf": "pdf",
    "ebook": "epub mobi azw azw3 djvu fb2",
    "text": "txt md markdown rst log tex org adoc",
    "code": "py js ts jsx tsx java c h cpp hpp cs go rs rb php swift kt scala sh bash zsh ps1 bat pl lua r m sql vim el hs ml clj ex exs dart sc",
    "config": "json yaml yml toml ini cfg conf env properties plist xml editorconfig lock",
    "data": "csv tsv parquet feather arrow jsonl ndjson xml sav dta rdata rds npy npz mat h5 hdf5",
    "notebook": "ipynb rmd qmd",
    "archive": "zip tar gz bz2 xz 7z rar tgz tbz zst lz4 cab",
    "installer": "exe msi dmg pkg deb rpm appimage apk snap flatpak",
    "disk_image": "iso img vhd vmdk vdi qcow2 sparseimage",
    "font": "ttf otf woff woff2 eot",
    "database": "db sqlite sqlite3 mdb accdb realm",
    "design": "psd ai xd fig sketch indd afdesign afphoto blend obj fbx stl step dwg dxf",
    "subtitle": "srt vtt ass sub",
    "shortcut": "lnk url webloc desktop alias",
    "junk": "tmp temp part crdownload partial download bak old swp swo ds_store thumbs lock pid err stackdump dmp",
    "unknown": "",
}
# The phrase that stands for a kind.
PHRASES = {
    "image": "photograph picture image snapshot",
    "video": "video footage movie clip recording",
    "audio": "audio sound recording music track",
    "document": "written document text letter report",
    "spreadsheet": "spreadsheet table of numbers accounts",
    "presentation": "slide deck presentation talk",
    "pdf": "pdf document printed page",
    "ebook": "book ebook reading",
    "text": "plain text notes writing",
    "code": "source code program software",
    "config": "configuration settings file",
    "data": "dataset records data table",
    "notebook": "computational notebook analysis",
    "archive": "compressed archive bundle zip",
    "installer": "software installer package setup",
    "disk_image": "disk image system volume",
    "font": "typeface font",
    "database": "database file records",
    "design": "design artwork graphics project",
    "subtitle": "subtitles captions",
    "shortcut": "shortcut link",
    "junk": "temporary leftover file",
    "unknown": "file",
}
DOMAINS = {
    "media": "image video audio design subtitle font",
    "office": "document spreadsheet presentation pdf ebook text",
    "dev": "code config notebook data database",
    "system": "archive installer disk_image shortcut junk",
    "other": "unknown",
}
TEXTUAL = frozenset("document presentation spreadsheet pdf ebook text code config notebook data subtitle".split())
DOMAIN_OF = {kind: domain for domain, kinds in DOMAINS.items() for kind in kinds.split()}
KIND_OF = {ext: kind for kind, exts in EXTENSIONS.items() for ext in exts.split()}

# Names of leftovers, and stems that were never given by a person.
LEFTOVER = r"(?i)^(~\$.*|\._.*|\.DS_Store|Thumbs\.db|desktop\.ini|Icon\r?|.*\.(tmp|temp|part|partial|crdownload|swp|swo|bak|old|orig|rej))$"
UNNAMED = r"(?i)^(untitled|unnamed|new\s+(text\s+)?(document|folder|file)|document|scan|image|download|file)[\s_\-]*\(?\d*\)?$"


def dimension(spark: SparkSession) -> DataFrame:
    """(ext, kind): a table of fixed size."""
    return spark.createDataFrame(sorted(KIND_OF.items()), "ext string, kind string")


def is_leftover(name: Column) -> Column:
    return F.coalesce(name.rlike(LEFTOVER), F.lit(False))


def is_unnamed(stem: Column) -> Column:
    return F.coalesce(stem.rlike(UNNAMED), F.lit(False))


def _choose(kind: Column, values: dict[str, str]) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for value in sorted(set(values.values())):
        out = out.when(kind.isin([k for k, v in values.items() if v == value]), value)
    return out


def domain_of(kind: Column) -> Column:
    return _choose(kind, DOMAIN_OF)


def phrase_of(kind: Column) -> Column:
    return _choose(kind, PHRASES)


def is_textual(kind: Column) -> Column:
    return kind.isin(*sorted(TEXTUAL))


def with_kind(files: DataFrame, name: str = "name", ext: str = "ext") -> DataFrame:
    """files with columns kind, domain and textual; a leftover by name is junk whatever its extension."""
    kinds = dimension(files.sparkSession).select(F.col("ext").alias("_ext"), F.col("kind").alias("_kind"))
    key = F.regexp_replace(F.lower(F.coalesce(F.col(ext), F.lit(""))), r"^\.+", "")
    joined = files.drop("kind", "domain", "textual").withColumn("_key", key).join(F.broadcast(kinds), F.col("_key") == F.col("_ext"), "left")
    kind = F.when(is_leftover(F.col(name)), "junk").otherwise(F.coalesce("_kind", F.lit("unknown")))
    return joined.withColumn("kind", kind).drop("_key", "_ext", "_kind").withColumns({"domain": domain_of(F.col("kind")), "textual": is_textual(F.col("kind"))})
