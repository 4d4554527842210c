import pytest

from lectern.plans import formatter as f
from lectern.plans import gate
from lectern.samples import markdown_documents

ALL = f.Options("semantic", 0, frozenset(f.PASSES))


@pytest.mark.parametrize(
    "step, text, want",
    [
        (f.spell, "_a_ __b__ [r] [r][r]\n\n[r]: x\n", "*a* **b** [r][] [r][]\n\n[r]: x\n"), (f.spell, "a  \nb\n", "a\\\nb\n"), (f.spell, ":::{.x}\na\n:::\n", "::: {.x}\na\n:::\n"), (f.spell, "a $x\n+y$ b\n", "a $x +y$ b\n"),
        (f.expand_tabs, "\ta\n\n-\tb\n", "\ta\n\n-   b\n"), (f.separate_lists, "a\n- b\n- c\n", "a\n\n- b\n- c\n"), (f.separate_lists, "a\n2019. b\n", "a\n2019. b\n"), (f.separate_notes, "a[^1]\n[^1]: x\n", "a[^1]\n\n[^1]: x\n"),
        (f.place_items, "-   a\n\n    b\n", "- a\n\n  b\n"), (f.place_items, "- a\n    - b\n", "- a\n  - b\n"), (f.place_items, "1.  a\n    - b\n", "1. a\n   - b\n"), (f.unbold_headings, "# **a**\n\n## b **c**\n", "# a\n\n## b **c**\n"),
        (f.same_rules, "a\n\n---\n\n***\n", "a\n\n* * *\n\n* * *\n"), (f.close_gaps, "a\n\n\n\nb\n\n```\n\n\n\n```\n", "a\n\nb\n\n```\n\n\n\n```\n"), (f.space_headings, "# a\nb\n", "# a\n\nb\n"), (f.quote_blanks, "> a\n>\n> b\n", "> a\n> \n> b\n"),
        (f.fence_code, "a\n\n    x\n    `y`\n", "a\n\n```\nx\n`y`\n```\n"), (f.align_tables, "|a|b|\n|:-|-:|\n|1|2|\n", "| a | b |\n| :--- | ---: |\n| 1 | 2 |\n"), (f.space_tags, "{% a %}\n- x\n", "{% a %}\n\n- x\n"), (f.dots, "a...b `c...d`\n", "a … b `c...d`\n"),
        (f.curl, 'a "b" `"c"` it\'s\n', 'a “b” `"c"` it’s\n'), (f.curl, "\"He said 'x y' now\"\n", "“He said ‘x y’ now”\n"),
    ],
)
def test_passes(step, text, want):
    assert step(text) == want
    assert step(want) == want


def test_hyphens():
    assert f.join_hyphens("well-\nknown\n") == ("well-known\n", 1)
    for text in ("short-\nand long\n", "a-\nUpper\n", "`x-\ny`\n"):
        assert f.join_hyphens(text) == (text, 0)


@pytest.mark.parametrize("spacing, text, want", [("loose", "- a\n- b\n", "- a\n\n- b\n"), ("tight", "- a\n\n- b\n", "- a\n- b\n"), ("preserve", "- a\n- b\n", "- a\n- b\n"), ("preserve", "- a\n\n- b\n", "- a\n\n- b\n"), ("tight", "- a\n\n  b\n\n- c\n", "- a\n\n  b\n\n- c\n"), ("loose", "> - a\n> - b\n", "> - a\n>\n> - b\n")])
def test_list_spacing(spacing, text, want):
    assert f.fill_markdown(text, f.Options(list_spacing=spacing)) == want


def test_wrapping_keeps_constructs_whole():
    text = "Some words stand here and then [a link with words](http://a.b) and `code with words` and more.\n"
    out = f.fill_markdown(text, f.Options(width=30))
    assert "[a link with words](http://a.b)" in out and "`code with words`" in out
    assert f.fill_markdown("> [!note]\n> a\n") == "> [!NOTE]\n> a\n"
    assert f.fill_markdown("- [ ] a task\n") == "- [ ] a task\n"
    assert f.fill_markdown("---\nt: 1\n---\na\n") == "---\nt: 1\n---\n\na\n"


@pytest.mark.parametrize("text", ["+---+---+\n| a | b |\n+===+===+\n| 1 | 2 |\n+---+---+\n", "| The first line\n| and    another\n", "Term\n:   Its   definition, and\n    more of it\n", "Term\n\n:   Loose   one\n", "  a    b\n ---  ---\n  1    2\n"])
def test_what_is_kept_as_it_is(text):
    around = f"Words before.\n\n{text}\nWords after.\n"
    assert f.fill_markdown(around, ALL) == around


@pytest.mark.parametrize("text, why", [("a $ x $ b\n", "line 1"), ("```\nx\n", "line 1"), ("|a|\n|-|\n|1|2|\n", "outside of every column"), ("---\nt: 1\n---\na $ x $\n", "line 4")])
def test_refusals(text, why):
    got = f.reformat(text, ALL)
    assert got["status"] == "refused" and got["text"] == text and why in got["error"]


# a pair for each normalisation: what it accepts and what it doesn't
@pytest.mark.parametrize(
    "name, before, good, bad",
    [
        ("unbold_heading", "# **a**\n", "# a\n", "# b\n"), ("list_spacing", "- a\n- b\n", "- a\n\n- b\n", "- a\n\n- c\n"), ("smart_quotes", 'a "b" c\n', "a “b” c\n", "a “b c”\n"),
        ("alert_type", "> [!note]\n> a\n", "> [!NOTE]\n> a\n", "> [!TIP]\n> a\n"), ("lazy_list", "a\n- b\n", "a\n\n- b\n", "a\n\n- c\n"), ("hyphen_join", "well-\nknown\n", "well-known\n", "wellknown\n"),
    ],
)
def test_gate(name, before, good, bad):
    assert name in gate.check(before, good)["normalizations"] and gate.check(before, good)["ok"]
    assert not gate.check(before, bad)["ok"]
    assert gate.check(before, before) == {"ok": True, "normalizations": [], "detail": None, "block": None}


def test_gate_is_directed():
    assert not gate.check("a\n\n- b\n", "a\n- b\n")["ok"]
    assert not gate.check("well-known\n", "well-\nknown\n")["ok"]


def test_lists_of_any_depth():
    deep = "".join("    " * k + f"- {k}\n" for k in range(20))
    assert f.place_items(deep) == "".join("  " * k + f"- {k}\n" for k in range(20))


def test_gate_stands_alone():
    """It accepts what no pass of the formatter makes, and knows none of them."""
    import inspect

    assert "formatter" not in inspect.getsource(gate).replace("the formatter makes", "")
    assert gate.check("a b\n- c\n  d\n- e\n", "a b\n\n- c d\n\n- e\n")["normalizations"] == ["lazy_list"]
    assert gate.check("a\n- b\n  - c\n", "a\n\n- b\n\n  - c\n")["ok"]
    assert gate.check("a-\n$x$ b\n", "a-$x$ b\n")["normalizations"] == ["hyphen_join"]
    assert gate.check("x \"a-\nb\" c\n- d\n", "x “a-b” c\n\n- d\n")["normalizations"] == ["smart_quotes", "lazy_list", "hyphen_join"]
    for before, after in (("a\n- b\n", "a\n\n- b c\n"), ("a\n- b\n- c\n", "a\n\n- c\n- b\n"), ("a-\nB\n", "a-B\n"), ("a- b\n", "a-b\n"), ("one-\nor two\n", "one-or two\n"), ("a\n2. b\n", "a\n\n2. b\n")):
        assert not gate.check(before, after)["ok"], before


def test_corpus_is_stable(spark):
    docs = markdown_documents(spark, "/root/testdata/sf0.001").limit(80).collect()
    for r in docs:
        for options in (ALL, f.Options(), f.Options("semantic", 88, frozenset(f.PASSES), "tight")):
            first = f.reformat(r.text, options)
            if first["status"] != "refused":
                again = f.reformat(first["text"], options)
                assert again["text"] == first["text"]


def test_batch_isolates_refusals(spark):
    rows = [(1, "a   b\n"), (2, "$ x $\n"), (3, None), (4, "a b\n")]
    got = {r.doc_id: r for r in f.reformat_documents(spark.createDataFrame(rows, "doc_id long, text string"), f.Options()).collect()}
    assert (got[1].status, got[2].status, got[3].status, got[4].status) == ("ok", "refused", None, "unchanged")
    assert got[1].formatted == "a b\n" and got[2].formatted == "$ x $\n"


def test_a_formatter_of_ones_own_is_checked(spark):
    docs = spark.createDataFrame([(1, "- a\n- b\n"), (2, "words\n")], "doc_id long, text string")
    apart = f.reformat_documents(docs, f.Options(), lambda t, o: t.replace("\n-", "\n\n-"))
    assert {r.doc_id: (r.status, r.formatted, r.normalizations) for r in apart.collect()} == {1: ("ok", "- a\n\n- b\n", ["list_spacing"]), 2: ("unchanged", "words\n", [])}
    loud = f.reformat_documents(docs, f.Options(), lambda t, o: t.upper())
    assert {(r.status, r.formatted) for r in loud.collect()} == {("refused", "- a\n- b\n"), ("refused", "words\n")}
