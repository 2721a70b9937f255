import io
import json

import pytest

from kartei import cli
from kartei.operators.embedding import MarkerEmbedder

EMBEDDER = MarkerEmbedder(("alpha", "beta", "gamma"))


@pytest.fixture(scope="module")
def home(tmp_path_factory):
    root = tmp_path_factory.mktemp("home")
    for folder, marks in {"mixed": ("alpha", "beta", "gamma"), "tidy": ("alpha",)}.items():
        for mark in marks:
            for k in range(9 // len(marks)):
                path = root / folder / f"{mark}{k}q.txt"
                path.parent.mkdir(exist_ok=True)
                path.write_text(f"{mark} " + "with a few more words to read here " * 5 + f"{folder} number {k} " + "abcdefghij"[k] * 9 * (k + 1))
    (root / "few").mkdir()
    (root / "few" / "one.txt").write_text("alpha")
    return root


def run(spark, capsys, *argv):
    status = cli.main([str(a) for a in argv], spark, EMBEDDER)
    return status, capsys.readouterr().out


def test_lines(spark, home, capsys):
    status, out = run(spark, capsys, home)
    score, verdict, files, path, found = out.strip().split("\t")
    assert status == 1 and path.endswith("mixed") and files == "9" and "unrelated_topics" in found and verdict in ("messy", "chaotic") and float(score) >= 50


def test_json(spark, home, capsys):
    status, out = run(spark, capsys, "--json", "--show", "all", home)
    folders = {f["path"].rsplit("/", 1)[-1]: f for f in json.loads(out)["roots"][0]["folders"]}
    assert folders["few"] == {"path": folders["few"]["path"], "files": 1, "skip_reason": "too_few_files"}
    assert folders["tidy"]["verdict"] == "tidy" and folders["tidy"]["findings"] == [] and "truncated" not in folders["tidy"]
    assert {"code", "severity", "headline", "detail", "examples", "data"} == set(folders["mixed"]["findings"][0])


def test_status_and_quiet(spark, home, capsys):
    assert run(spark, capsys, "-q", home / "tidy") == (0, "")
    assert run(spark, capsys, "-q", home / "missing") == (2, "")
    assert run(spark, capsys, "--fail-over", "nonsense", home) == (2, "")


def test_json_lines_of_small_folders(spark, home, capsys):
    _, out = run(spark, capsys, "--jsonl", "-a", "--st", home / "few")
    assert json.loads(out)["files"] == 1


@pytest.mark.parametrize("text, level", [("tidy", 0), ("Lived-In", 1), ("lived_in", 1), ("3", 3)])
def test_verdicts(text, level):
    assert cli.verdict(text) == level


def test_operands():
    assert cli.operands([], False) == ["."] and cli.operands(["-", "a", "-"], False, io.BytesIO(b"x y\r\nz\n")) == ["x y", "z", "a"] and cli.operands(["-"], True, io.BytesIO(b"p\nq\0r")) == ["p\nq", "r"]


def test_roots(home):
    found, errors = cli.roots([str(home / "t*"), str(home / "few" / "one.txt"), str(home / "few"), str(home / "no*"), str(home / "gone")])
    assert [f.rsplit("/", 1)[-1] for f in found] == ["tidy", "few"] and len(errors) == 2
    assert cli.without_nested(["/a", "/a/b", "/ab"], False) == ["/a", "/ab"] and len(cli.without_nested(["/a", "/a/b"], True)) == 2


@pytest.mark.parametrize("argv", [["-t", "2"], ["-d", "-1"], ["--show", "odd"], ["-q", "-v"], ["-j", "--jsonl"]])
def test_bad_options(argv, capsys):
    with pytest.raises(SystemExit) as x:
        cli.parser().parse_args(argv)
    assert x.value.code == 2


def test_second_run_embeds_nothing(spark, home, capsys, tmp_path):
    """A warm run takes all texts and vectors from the cache and says the same."""
    asked = []

    class Counting(MarkerEmbedder):
        def encode(self, texts):
            asked.append(texts.count())
            return super().encode(texts)

    out = []
    for _ in range(2):
        cli.main(["--cache", str(tmp_path / "kept"), "--jsonl", "--show", "all", str(home)], spark, Counting(("alpha", "beta", "gamma")))
        out.append(capsys.readouterr().out)
        asked.append(None)
    half = asked.index(None)
    assert sum(asked[:half]) > 0 and sum(filter(None, asked[half:])) == 0 and out[0] == out[1]
