import io
import os
import struct
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from kartei.settings import Settings
from kartei.sources import binary, readers
from kartei.sources.cache import StoredCache, evicted_texts, hex_seconds, looked_up, missing, updated
from kartei.sources.tree import RULE_FILE, read_texts, scan


def text_of(data, ext, kind="text", **settings):
    return readers.extract(lambda: io.BytesIO(data), ext, kind, len(data), Settings(**settings))


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name.replace("__", "/"), data)
    return out.getvalue()


@pytest.mark.parametrize(
    "data, out",
    [
        ("grün  und\tblau".encode(), "grün und blau"),
        ("﻿mit Marke".encode("utf-16-le"), "mit Marke"),
        (b"\xfe\xff" + "andere Marke".encode("utf-16-be"), "andere Marke"),
        ("ganz ohne Marke".encode("utf-16-le"), "ganz ohne Marke"),
        ("ganz ohne Marke".encode("utf-16-be"), "ganz ohne Marke"),
        ("naïve cafés".encode("cp1252"), "naïve cafés"),
        (b"abc\0def", ""),
        (b"", ""),
    ],
)
def test_plain_text(data, out):
    assert text_of(data, "txt") == out


def test_budgets():
    assert text_of(b"x" * 5000, "txt") == "x" * 1000 and text_of(b"abcdef", "txt", max_read_bytes=3) == "abc"
    assert text_of(b"words", "exe", "installer") == ""


def test_documents():
    assert text_of(zipped(word__document__xml="") or b"", "docx", "document") == ""
    docx = zipped(**{"word/document.xml": "<w:p>One</w:p><w:p>Two &amp; three</w:p>", "word/styles.xml": "<a>no</a>"})
    assert text_of(docx, "docx", "document") == "One\nTwo & three"
    xlsx = zipped(**{"xl/sharedStrings.xml": "<si>a</si><si>b</si>", "xl/worksheets/sheet1.xml": "<v>7</v>", "xl/worksheets/_rels/s.xml": "no"})
    assert text_of(xlsx, "xlsx", "spreadsheet") == "a b 7"
    assert text_of(zipped(**{"content.xml": "<text:p>Hi</text:p>there"}), "odt", "document") == "Hi\nthere"
    assert text_of(zipped(**{"b/1.xhtml": "<p>x</p>", "a.html": "<p>y</p>"}), "epub", "ebook") == "y\nx"
    assert text_of(b"not a zip", "docx", "document") == ""


def test_rtf():
    data = rb"{\rtf1\ansi{\fonttbl{\f0 Arial;}{\f1 Times;}}{\*\generator Some tool;}\f0 Hello {\b bold} world\par}"
    assert text_of(data, "rtf", "document").split() == ["Hello", "bold", "world"]
    assert readers.without_rtf_groups("a{\\info never closed") == "a"


def test_markup_and_old_documents():
    assert text_of(b"<html><script>no</script><p>A &eacute;</p><div>B</div></html>", "html") == "A é\nB"
    assert text_of(b"\x00\x01Some old words\x02ab\x03more words", "doc", "document") == "Some old words more words"
    assert text_of(b"%PDF-1.4 nothing", "pdf", "pdf") == ""


def png(width, height):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", width, height) + b"\0" * 8


@pytest.mark.parametrize(
    "data, size",
    [
        (png(3, 4), "3x4"),
        (b"GIF89a" + struct.pack("<HH", 5, 6) + b"\0" * 4, "5x6"),
        (b"BM" + b"\0" * 16 + struct.pack("<ii", 7, 8), "7x8"),
        (b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 9, 10) + b"\0" * 9, "10x9"),
        (b"\xff\xd8", ""),
        (png(0, 4), ""),
        (b"", ""),
    ],
)
def test_image_size(data, size):
    assert binary.image_size(data) == size


def test_image_words():
    assert binary.Origin.of({"Make": "Acme", "Model": "One", "DateTime": "2024:01:01"}).words() == ["photograph", "camera", "Acme", "One", "2024"]
    assert binary.Origin.of({"Software": "Epson X"}).words()[0] == "scanned document" and binary.Origin.of({"Software": "SnipTool"}).words()[0] == "screenshot" and binary.Origin.of({}).words() == []


def test_phrases():
    assert binary.phrase(["a  b", "A B", "", "c"]) == "a b c" and binary.phrase(["x" * 60, "y" * 60, "z"]) == "x" * 60


def test_archives_and_fonts():
    z = zipped(**{"trip-photos/oslo_fjord.jpg": "", "trip-photos/notes.txt": ""})
    assert binary.describe(lambda: io.BytesIO(z), "a.zip", "zip", "archive", len(z)) == "oslo fjord notes"
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        t.addfile(tarfile.TarInfo("budget-2024.csv"))
    assert binary.describe(lambda: io.BytesIO(out.getvalue()), "a.tar.gz", "gz", "archive", 9) == "budget 2024"
    assert binary.describe(lambda: io.BytesIO(b"junk"), "a.zip", "zip", "archive", 4) == ""
    names = [(1, "Fancy"), (2, "Bold"), (8, "Maker")]
    strings = b"".join(v.encode("utf-16-be") for _, v in names)
    records, at = b"", 0
    for which, v in names:
        records += struct.pack(">6H", 3, 1, 0, which, 2 * len(v), at)
        at += 2 * len(v)
    table = struct.pack(">HHH", 0, 3, 6 + 36) + records + strings
    data = struct.pack(">IHHHH", 0x10000, 1, 0, 0, 0) + struct.pack(">4sIII", b"name", 0, 28, len(table)) + table
    assert binary.font(data) == "Fancy Bold Maker" and binary.font(data[:40]) == "" and binary.font(b"") == ""


@pytest.fixture
def tree(tmp_path):
    for name, data in {"a.txt": b"alpha text", "b.md": b"beta", ".secret": b"x", ".DS_Store": b"x", "node_modules/c.txt": b"no", "sub/d.txt": b"delta", "sub/deep/e.png": png(2, 2), "sub/skip.tmp": b"t"}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    (tmp_path / "sub" / RULE_FILE).write_text("*.tmp\n")
    (tmp_path / "loop").symlink_to(tmp_path)
    return tmp_path


def test_scan(spark, tree):
    files, folders = scan(spark, str(tree))
    assert {r.name for r in files.collect()} == {"a.txt", "b.md", ".DS_Store", "d.txt", "e.png"}
    assert {(r.folder.removeprefix(str(tree)), r.depth) for r in folders.collect()} == {("", 0), ("/sub", 1), ("/sub/deep", 2)}
    texts = {r.name: r.text for r in read_texts(files).collect()}
    assert texts == {"a.txt": "alpha text", "b.md": "beta", ".DS_Store": "", "d.txt": "delta", "e.png": "2x2"}
    hidden, _ = scan(spark, str(tree), Settings(include_hidden=True, follow_symlinks=True))
    assert ".secret" in {r.name for r in hidden.collect()} and hidden.where("name = 'a.txt'").count() == 1
    with pytest.raises(NotADirectoryError):
        scan(spark, str(tree / "a.txt"))


def test_bad_rule_file(spark, tree):
    (tree / RULE_FILE).write_bytes(b"\xff\xfe\xff")
    with pytest.raises(OSError):
        scan(spark, str(tree))


def test_binary_file_source(spark, tree):
    files = spark.read.format("binaryFile").load(str(tree / "sub")).select("path", F.lit("d.txt").alias("name"), F.lit("txt").alias("ext"), F.lit("text").alias("kind"), F.col("length").alias("size"), F.lit(False).alias("described"), "content").where("path like '%d.txt'")
    assert [r.text for r in readers.with_text(files, content="content").collect()] == ["delta"]


@pytest.mark.parametrize("seconds", [0.0, 1.0, 1431562369.3149617, 1700000000.25, 0.1, -3.5])
def test_hexadecimal_times(spark, seconds):
    micros = round(seconds * 1e6)
    assert spark.range(1).select(hex_seconds(F.lit(micros))).first()[0] == (micros / 1e6).hex()


def test_cache(spark):
    cache = spark.createDataFrame([("/a", 1, (5.0).hex(), "s", "old", 1), ("/a", 1, (5.0).hex(), "s", "new", 2), ("/b", 1, (5.0).hex(), "t", "x", 3)], "path string, size long, mtime string, settings string, text string, accessed long")
    files = spark.sql("select '/a' path, 1L size, timestamp_seconds(5) mtime union all select '/b', 1L, timestamp_seconds(5) union all select '/a', 2L, timestamp_seconds(5)")
    assert sorted(str(r.text) for r in looked_up(files, cache, "s").collect()) == ["None", "None", "new"]
    assert missing(files, cache, "s").count() == 2
    assert [r.path for r in evicted_texts(cache, 1).collect()] == ["/b"]
    fresh = spark.createDataFrame([("/b", 1, (5.0).hex(), "t", "y", 9)], cache.schema)
    assert {r.text for r in updated(cache, fresh, ["path", "size", "mtime", "settings"]).collect()} == {"old", "new", "y"}


def test_staged_digests(spark, tmp_path):
    middle = bytearray(b"x" * 300_000)
    other = bytearray(middle)
    other[150_000] = 65
    held = {"a": b"same size", "b": b"same sizE", "c": b"same size", "alone": b"a size of its own", "big1": middle, "big2": other, "big3": middle, "empty": b"", "empty2": b""}
    for name, data in held.items():
        (tmp_path / name).write_bytes(bytes(data))
    files = spark.createDataFrame([(str(tmp_path), str(tmp_path / n), len(d)) for n, d in held.items()], "folder string, path string, size long").withColumn("digest", F.lit("old"))
    got = {r.path.rsplit("/", 1)[-1]: r.digest for r in readers.with_digests(files).collect()}
    assert got["a"] == got["c"] != got["b"] and got["big1"] == got["big3"] != got["big2"] and got["big2"] is not None
    assert got["alone"] is got["empty"] is got["empty2"] is None


def test_cached_texts_keep_digests(spark, tmp_path):
    for name in ("one.txt", "two.txt"):
        (tmp_path / name).write_text("the very same words")
    files, _ = scan(spark, str(tmp_path))
    cache = StoredCache(spark, str(tmp_path / ".kept"))
    first = read_texts(files, cached=cache.texts())
    cache.keep_texts(first, Settings().reading_key())
    before = (tmp_path / "one.txt").stat()
    (tmp_path / "one.txt").write_text("THE VERY SAME WORDS")
    os.utime(tmp_path / "one.txt", ns=(before.st_atime_ns, before.st_mtime_ns))
    (tmp_path / "two.txt").write_text("longer than it was before")
    files, _ = scan(spark, str(tmp_path))
    again = {r.name: r for r in read_texts(files, cached=cache.texts()).collect()}
    assert again["one.txt"].text == "the very same words" and again["two.txt"].text == "longer than it was before"
    assert {r.digest is None for r in first.collect()} == {False}


def test_budget_of_bytes():
    source = readers.Budgeted(io.BytesIO(bytes(range(100))), 30)
    source.seek(50)
    assert source.read(20) == bytes(range(50, 70)) and source.seek(0) == 0 and source.read(10) == bytes(range(10))
    with pytest.raises(OSError):
        source.read(1)
