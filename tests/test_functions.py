import re

import pytest
from pyspark.sql import functions as F

from kartei.functions import kinds, scoring, text, tokens, vectors


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "stem, words",
    [("QuarterlyReport", "quarterly report"), ("HTMLParser_v2", "html parser v2"), ("été-2024 Ⅷ", "été 2024 ⅷ"), ("", ""), ("a__b--c", "a b c"), ("ABCdef", "ab cdef")],
)
def test_split_words(spark, stem, words):
    assert " ".join(one(spark, stem, tokens.split_words)) == words


@pytest.mark.parametrize(
    "stem, kept", [("budget_final2", "budget"), ("Invoice finalv2 (1)", "invoice"), ("scan0042 march deadbeef99", "scan0042"), ("notes v3 x", "notes"), ("my trip to Oslo", "trip oslo")]
)
def test_name_tokens(spark, stem, kept):
    assert " ".join(one(spark, stem, tokens.name_tokens)) == kept


def test_names_keep_noise_on_demand(spark):
    assert one(spark, "old photo", lambda c: tokens.name_tokens(c, drop_noise=False)) == ["old", "photo"]


def test_content_tokens_are_cut_after_the_limit(spark):
    assert one(spark, "alpha to beta 12345 gamma the delta", lambda c: tokens.content_tokens(c, 3)) == ["alpha", "beta", "gamma"]


@pytest.mark.parametrize("stem, base, marks", [("plan_draft", "plan", ["draft"]), ("plan v2", "plan", ["version-suffix"]), ("plan (3)", "plan", ["version-suffix"]), ("plan7", "plan7", []), ("Final", "", ["final"])])
def test_base_and_markers(spark, stem, base, marks):
    assert one(spark, stem, tokens.base_stem) == base
    assert one(spark, stem, tokens.version_markers) == marks


@pytest.mark.parametrize("name, ext, kind", [("a.PDF", "PDF", "pdf"), ("a.xml", "xml", "data"), ("x.lock", "lock", "junk"), ("~$a.docx", "docx", "junk"), ("Thumbs.db", "db", "junk"), ("a.zzz", "zzz", "unknown"), ("a", None, "unknown"), ("a.jpg", ".jpg", "image")])
def test_kinds(spark, name, ext, kind):
    row = kinds.with_kind(spark.createDataFrame([(name, ext)], "name string, ext string")).first()
    assert row.kind == kind and row.domain == kinds.DOMAIN_OF[kind] and row.textual == (kind in kinds.TEXTUAL)


@pytest.mark.parametrize("stem, unnamed", [("Untitled (3)", True), ("scan 12", True), ("New Text Document", True), ("scanner", False), ("file-7", True), ("profile", False)])
def test_unnamed(spark, stem, unnamed):
    assert one(spark, stem, kinds.is_unnamed) == unnamed


def test_clean(spark):
    assert one(spark, "  a\t  b \n \n\n\n\n c  ", text.clean) == "a b\n\n\nc" or one(spark, "  a\t  b \n\n\n\n c  ", text.clean) == "a b\n\nc"
    assert one(spark, "abcdef", lambda c: text.clean(c, 3)) == "abc"
    assert one(spark, "", text.clean) == ""


def test_html(spark):
    page = "<script>no</script><p>one</p><ul><li>two</li></ul>x<br></br>&lt;b&gt; &amp;amp;<style>p{}</style>"
    assert one(spark, page, text.html_text) == "one\ntwo\nx <b> &amp;"


def test_printable_runs(spark):
    assert one(spark, "ok\x01hello world\x02no\x03another", text.printable_runs) == "hello world another"


@pytest.mark.parametrize("value, low, high, out", [(1, 2, 12, 0.0), (7, 2, 12, 0.5), (99, 2, 12, 1.0), (5, 5, 5, 1.0), (4, 5, 5, 0.0)])
def test_ramp(spark, value, low, high, out):
    assert spark.range(1).select(scoring.ramp(F.lit(value), low, high)).first()[0] == out


@pytest.mark.parametrize("score, level", [(0, 0), (24.9, 0), (25, 1), (49.9, 1), (50, 2), (75, 3), (100, 3)])
def test_verdict(spark, score, level):
    assert spark.range(1).select(scoring.verdict(F.lit(float(score)))).first()[0] == level


@pytest.mark.parametrize(
    "words, name, textual, mix",
    [("", "", True, (0, 0, 1)), ("", "plan", True, (0, 0.8, 0.2)), ("x" * 500, "plan", True, (0.75, 0.2, 0.05)), ("camera photo", "p", False, (0.85, 0.15, 0)), ("12 34", "p", False, None)],
)
def test_channel_mix(spark, words, name, textual, mix):
    row = spark.createDataFrame([(words, name, textual)], "t string, n string, x boolean").select(scoring.channel_mix(F.col("t"), F.col("n"), F.col("x")).alias("m")).first().m
    assert abs(sum(row) - 1) < 1e-9
    if mix:
        assert tuple(row) == pytest.approx(mix)


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [float("nan"), 1.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    row = df.select(vectors.normalised(F.col("a")), vectors.finite(F.col("b")), vectors.normalised(F.col("z")), vectors.is_usable(F.col("b"), 2), vectors.is_usable(F.col("a"), 2), vectors.is_usable(F.col("z"), 2)).first()
    assert list(row[0]) == pytest.approx([0.6, 0.8]) and row[1] == [0.0, 1.0] and row[2] == [0.0, 0.0] and row[3:] == (False, True, False)


def test_word_class_is_python_s_own():
    import unicodedata

    pattern = re.compile(r"[^\W_]")
    wrong = [c for c in range(0x3000) if bool(pattern.fullmatch(chr(c))) != (unicodedata.category(chr(c))[0] in "LN")]
    assert not wrong
