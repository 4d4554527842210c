import pytest

from lectern.sources import documents as d
from lectern.sources import settings


@pytest.fixture
def tree(tmp_path):
    files = {"a.md": "a", "sub/b.md": "b", "sub/c.txt": "c", "node_modules/x.md": "x", "build/y.md": "y", "draft/z.md": "z", "big.md": "x" * 5000, "sub/keep/k.md": "k"}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    return tmp_path


def names(frame):
    return [r.below for r in frame.collect()]


def test_discovery(spark, tree):
    assert names(d.files(spark, f"file:{tree}", d.Discovery(max_size=1000))) == ["a.md", "draft/z.md", "sub/b.md", "sub/keep/k.md"]
    assert "big.md" in names(d.files(spark, f"file:{tree}", d.Discovery(max_size=0)))
    ignored = d.ignore_patterns("# comment\n\ndraft/\nsub/*\n!sub/keep/\n")
    assert names(d.files(spark, f"file:{tree}", d.Discovery(max_size=1000), ignored)) == ["a.md", "sub/keep/k.md"]
    assert names(d.files(spark, f"file:{tree}", d.Discovery(include=("*.txt",)))) == ["sub/c.txt"]


def test_named_files_pass_exclusions(spark, tree):
    one = [f"file:{tree}/build/y.md"]
    assert d.named_files(spark, one).count() == 1
    assert d.named_files(spark, one, d.Discovery(force_exclude=True)).count() == 0
    assert d.named_files(spark, [f"file:{tree}/sub/*"]).count() == 1
    with pytest.raises(Exception):
        d.named_files(spark, [f"file:{tree}/none.md"]).count()


def test_texts(spark, tree):
    (tree / "sp ace+é.md").write_text("s")
    found = d.texts(spark, f"file:{tree}", d.Discovery(max_size=1000), ["draft/"])
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r.path.rsplit("/", 1)[1]: r.text for r in found.collect()}
    assert sorted(got.values()) == ["a", "b", "k", "s"]
    assert [tuple(r) for r in d.from_texts(spark, {"-": "x"}).collect()] == [(0, "-", "x")]


def test_write_in_place(spark, tree):
    rows = [(f"file:{tree}/a.md", "new", "a"), (f"file:{tree}/sub/b.md", "b", "b"), (f"file:{tree}/fresh/n.md", "n", None)]
    got = {r.path: (r.written, r.error) for r in d.write_files(spark.createDataFrame(rows, "path string, text string, before string")).collect()}
    assert [got[p][0] for p, _, _ in rows] == [True, False, True]
    assert (tree / "a.md").read_text() == "new" and (tree / "a.md.orig").read_text() == "a" and (tree / "fresh/n.md").read_text() == "n"


def test_backups_survive_a_second_attempt(spark, tree):
    rows = [(f"file:{tree}/a.md", "new", "a")]
    for _ in range(2):  # as a task that runs again
        assert d.write_files(spark.createDataFrame(rows, "path string, text string, before string")).first().error is None
    assert (tree / "a.md").read_text() == "new" and (tree / "a.md.orig").read_text() == "a"
    later = [(f"file:{tree}/a.md", "newer", "new")]
    d.write_files(spark.createDataFrame(later, "path string, text string, before string")).collect()
    assert (tree / "a.md").read_text() == "newer" and (tree / "a.md.orig").read_text() == "new"
    assert not [p for p in tree.iterdir() if len(p.suffix) > 30]


def test_a_file_is_one_row(spark, tree):
    (tree / "lines.md").write_text("a\nb\n\nc\n")
    assert [r.text for r in d.texts(spark, f"file:{tree}").where("path LIKE '%lines.md'").collect()] == ["a\nb\n\nc\n"]


def test_nearest_settings(tmp_path):
    (tmp_path / "p/q").mkdir(parents=True)
    (tmp_path / "p/pyproject.toml").write_text("[tool.other]\nx = 1\n")
    (tmp_path / "lectern.toml").write_text("width = 50\n")
    path, found = settings.find(str(tmp_path / "p/q"))
    assert path.endswith("lectern.toml") and found.options().width == 50
    (tmp_path / "p/pyproject.toml").write_text("[tool.lectern]\nwidth = 40\n")
    assert settings.find(str(tmp_path / "p/q"))[1].options().width == 40
