import json

import pytest

from lectern.cli import main
from lectern.functions.links import LINKS_AND_AUTOLINKS, links
from lectern.sources import ignore


@pytest.fixture
def tree(tmp_path, monkeypatch):
    (tmp_path / "a.md").write_text('# **T**\nSay "x". Then more...\n')
    (tmp_path / "bad.md").write_text("a $ x $ b\n")
    (tmp_path / "skip").mkdir()
    (tmp_path / "skip/s.md").write_text("x\n")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/k.md").write_text("![](x)\n")
    (tmp_path / "sub/.gitignore").write_text("gone.md\n")
    (tmp_path / "sub/gone.md").write_text("x\n")
    (tmp_path / ".gitignore").write_text("skip/\n")
    monkeypatch.chdir(tmp_path)
    return tmp_path


def test_list_files(spark, tree, capsys):
    assert main(["format", "--list-files", "."]) == 0
    assert capsys.readouterr().out.split() == ["a.md", "bad.md", "sub/k.md"]
    assert main(["format", "--list-files", "--no-respect-gitignore", "."]) == 0
    assert len(capsys.readouterr().out.split()) == 5


def test_format(spark, tree, capsys):
    assert main(["format", "-s", "-c", "--smartquotes", "--ellipses", "a.md"]) == 0
    assert capsys.readouterr().out == "# T\n\nSay “x”. Then more …\n"
    assert main(["format", "-o", "out.md", "a.md"]) == 0 and (tree / "out.md").read_text().startswith("# **T**\n\n")
    assert main(["format", "--inplace", "a.md", "bad.md"]) == 1  # one is refused, the other written
    assert (tree / "a.md.orig").exists() and (tree / "bad.md").read_text() == "a $ x $ b\n"


def test_lint(spark, tree, capsys):
    assert main(["lint", "sub/k.md"]) == 1
    assert "1:1: warning accessibility/image-alt" in capsys.readouterr().out
    assert main(["lint", "--format", "json", "--exit-zero", "sub/k.md"]) == 0
    assert json.loads(capsys.readouterr().out)["files"][0]["path"] == "sub/k.md"
    assert main(["lint", "--rule", "accessibility/image-alt=off", "sub/k.md"]) == 0
    assert main(["lint", "--rule", "nope/none=off", "sub/k.md"]) == 2
    (tree / "u.md").write_text("see http://a.b now\n")
    assert main(["lint", "--style", "bare-url", "--fix", "u.md"]) == 0 and (tree / "u.md").read_text() == "see <http://a.b> now\n"
    assert main(["lint", "--list-rules"]) == 0 and capsys.readouterr().out.count("\n") > 70


def test_links():
    found = links('[a](u "t") [b](v "") ![c](w) <http://x.y> http://z.q [r]\n\n[r]: s\n')
    assert [(x["text"], x["url"], x["title"], x["kind"]) for x in found] == [
        ("a", "u", "t", "link"), ("b", "v", "", "link"), ("c", "w", None, "image"), ("http://x.y", "http://x.y", None, "autolink"), ("http://z.q", "http://z.q", None, "bare_url"), ("r", "s", None, "link"),
    ]
    assert len(links("[a](u) ![b](v) <http://x.y>", LINKS_AND_AUTOLINKS)) == 2


def test_ignore_files(tmp_path):
    assert ignore.below("*.md", "a/b") == "/a/b/**/*.md" and ignore.below("!/x", "a") == "!/a/x" and ignore.below("x/", "") == "x/"
    (tmp_path / "p").mkdir()
    (tmp_path / ".lecternignore").write_text("# c\nx/\n")
    assert ignore.tool_patterns(str(tmp_path / "p")) == ["x/"]
    (tmp_path / "bin").write_bytes(b"\xff\xfe")
    assert ignore.read_patterns(str(tmp_path / "bin")) == [] == ignore.read_patterns(str(tmp_path / "no"))
