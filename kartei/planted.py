"""Small inputs with known outcomes: files of every format, and folders in which signals fire that the test tables leave silent.

What is expected stands here as plain values; the queries compute it, and their SQL repeats the values.
"""

from __future__ import annotations

import io
import struct
import tarfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

FILE = "folder string, path string, name string, stem string, ext string, size long, mtime double, kind string, textual boolean, text string, digest string"
MARKS = ("alpha", "beta")


def _zip(**members: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def _tar(*names: str) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for name in names:
            t.addfile(tarfile.TarInfo(name))
    return out.getvalue()


def _font(family: str, style: str) -> bytes:
    """A name table alone: records of platform 3 point to UTF-16 strings."""
    strings = [family.encode("utf-16-be"), style.encode("utf-16-be")]
    records = struct.pack(">6H", 3, 1, 0x409, 1, len(strings[0]), 0) + struct.pack(">6H", 3, 1, 0x409, 2, len(strings[1]), len(strings[0]))
    table = struct.pack(">3H", 0, 2, 6 + len(records)) + records + b"".join(strings)
    return struct.pack(">4sHHHH", b"\0\1\0\0", 1, 16, 0, 0) + struct.pack(">4sIII", b"name", 0, 28, len(table)) + table


#: (name, content, the text that is read or told of it)
FORMATS: tuple[tuple[str, bytes, str], ...] = (
    ("plain.txt", "Grüße   aus\n\n\n\nKöln \n".encode(), "Grüße aus\n\nKöln"),
    ("western.txt", "caf\xe9 cr\xe8me!".encode("cp1252"), "café crème!"),  # an odd number of bytes, or UTF-16 comes first
    ("marked.txt", b"\xff\xfe" + "wide words".encode("utf-16-le"), "wide words"),
    ("unmarked.txt", "words without a mark".encode("utf-16-be"), "words without a mark"),
    ("zeros.txt", b"abc\0\0\0def", ""),
    ("empty.txt", b"", ""),
    ("page.xml", b"<html><style>p {}</style><p>One &amp; two</p><script>x()</script><p>three<br></br>four</p></html>", "One & two\nthree four"),
    ("letter.rtf", rb"{\rtf1\ansi{\fonttbl{\f0 Arial;}}\b Dear\b0  reader}", "Dear reader"),
    ("letter.docx", _zip(**{"word/document.xml": "<w:p>First line</w:p><w:p>Second</w:p>", "word/styles.xml": "<w:p>no</w:p>", "word/header1.xml": "<w:p>Head</w:p>"}), "First line\nSecond\nHead"),
    ("slides.pptx", _zip(**{"ppt/slides/slide1.xml": "<a:p>Title</a:p>", "ppt/theme/theme1.xml": "<a:p>no</a:p>"}), "Title"),
    ("sheet.xlsx", _zip(**{"xl/sharedStrings.xml": "<si>red</si><si>blue</si>", "xl/worksheets/_rels/sheet1.xml.rels": "no"}), "red blue"),
    ("note.odt", _zip(**{"content.xml": "<text:p>Open text</text:p>", "meta.xml": "no"}), "Open text"),
    ("book.epub", _zip(**{"OEBPS/one.xhtml": "<p>Chapter one</p>", "toc.ncx": "no"}), "Chapter one"),
    ("broken.docx", b"PK\x03\x04 not a zip", ""),
    ("old.doc", b"\xd0\xcf\x11\xe0\x00\x01Printable run here\x00\x02tiny\x00Another run", "Printable run here Another run"),
    ("bundle.zip", _zip(**{"src/main_loop.py": "", "docs/read-me.txt": ""}), "main loop read me"),
    ("bundle.tar", _tar("photos/summer_trip.jpg", "photos/winter.jpg"), "summer trip winter"),
    ("type.ttf", _font("Lumen Sans", "Bold"), "Lumen Sans Bold"),
    ("shot.png", b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + struct.pack(">II", 640, 480) + b"\x08\x02\x00\x00\x00", "640x480"),
    ("move.gif", b"GIF89a" + struct.pack("<HH", 33, 44) + b"\0\0\0", "33x44"),
    ("dot.bmp", b"BM" + b"\0" * 16 + struct.pack("<ii", 7, 9) + b"\0" * 10, "7x9"),
    ("snap.jpg", b"\xff\xd8\xff\xe0\x00\x06ABCD\xff\xc2\x00\x11\x08" + struct.pack(">HH", 600, 800) + b"\x03" + b"\0" * 12, "800x600"),
)


def formats(spark: SparkSession) -> DataFrame:
    """(path, name, ext, size, content) of FORMATS."""
    rows = [(f"/formats/{n}", n, n.rsplit(".", 1)[-1], len(c), c) for n, c, _ in FORMATS]
    return spark.createDataFrame([(p, n, e, s, bytearray(c)) for p, n, e, s, c in rows], "path string, name string, ext string, size long, content binary")


def _body(mark: str, k: int) -> str:
    return f"{mark} " + " ".join(f"{mark}{'abcdefghij'[(k + j) % 10]}{'klmnopqrst'[(3 * k + j * j) % 10]}word" for j in range(24))


def _file(folder: str, name: str, text: str, size: int = 10, digest: str | None = None) -> tuple:
    stem, _, ext = name.rpartition(".")
    return folder, f"{folder}/{name}", name, stem, ext, size, 1e9, "text", True, text, digest or f"{folder}/{name}"


def _subject(folder: str, mark: str, n: int) -> list[tuple]:
    return [_file(folder, f"{mark} {'abcdefghij'[k]}.txt", _body(mark, k), 100 + k) for k in range(n)]


def folders_that_fire(spark: SparkSession) -> DataFrame:
    """Files of a tree with copies, near-copies, misfiled files and a folder out of place."""
    long = "alpha " + " ".join(f"a sentence number {'abcdefghijklmnopqrstuvwxyz'[k]} of some length" for k in range(24))
    rows = [_file("/p/copies", f"copy {c}.txt", _body("alpha", 9), 77, "same") for c in "abc"] + _subject("/p/copies", "alpha", 6)
    rows += [_file("/p/edits", "first.txt", long, 700), _file("/p/edits", "second.txt", long + "!", 701), _file("/p/edits", "third.txt", long + "?", 701)] + _subject("/p/edits", "alpha", 5)
    rows += _subject("/p/loose", "beta", 6) + [_file("/p/loose", f"alpha {c}{c}.txt", _body("alpha", k), 200 + k) for k, c in enumerate("xyz")] + _subject("/p/loose/child", "alpha", 5)
    for name in ("one", "two", "three"):
        rows += _subject(f"/r/greek/{name}", "alpha", 6)
    rows += _subject("/r/greek/odd", "beta", 6) + _subject("/r/greek", "alpha", 3)
    for name in ("four", "five"):
        rows += _subject(f"/r/latin/{name}", "beta", 6)
    return spark.createDataFrame(rows, FILE)


#: (folder, exact copies too many, near-copies)
EXPECTED_COPIES = (("/p/copies", 2, 0), ("/p/edits", 0, 2))
#: (folder, pairs of near-copies by name)
EXPECTED_EDITS = (("/p/edits", "first.txt", "second.txt"), ("/p/edits", "first.txt", "third.txt"))
#: (folder, subfolder, files)
EXPECTED_MISFILED = (("/p/loose", "child", 3),)
#: (folder, whether a related place was found)
EXPECTED_PLACEMENT = (("/r/greek/odd", True),)
#: (folder, line of the report)
EXPECTED_LINES = (
    ("/p/quiet", "0\ttidy\t8\t/p/quiet\t-"),
    ("/p/worst", "81.3\tchaotic\t12\t/p/worst\tstrays,debris"),
    ("/p/small", "-\tskipped\t2\t/p/small\ttoo_few_files"),
)
#: (path, files, score, verdict, number of findings, severity of the first, truncated, skip_reason)
EXPECTED_JSON = (
    ("/p/quiet", 8, 0.0, "tidy", 0, None, None, None),
    ("/p/worst", 12, 81.25, "chaotic", 2, 0.913, 5, None),
    ("/p/small", 2, None, None, None, None, None, "too_few_files"),
)


def analyses(spark: SparkSession) -> DataFrame:
    """Judged folders as an audit gives them."""
    item = "struct<code:string,severity:double,headline:string,detail:string,examples:array<string>,data:string>"
    found = [("strays", 0.9126, "h", "d", ["x"], '{"count": 3}'), ("debris", 0.2, "h", "d", [], '{"count": 2}')]
    rows = [("/p/quiet", 8, 0, 1, True, None, 0.0, 0, []), ("/p/worst", 12, 5, 3, True, None, 81.25, 3, found), ("/p/small", 2, 0, 0, False, "too_few_files", 0.0, 0, None)]
    return spark.createDataFrame(rows, f"folder string, n_files int, truncated int, clusters int, judged boolean, skip_reason string, score double, verdict int, findings array<{item}>")
