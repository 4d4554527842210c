import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.operators import preflight as pre
from lectern.plans import reader


def kinds(text, *wanted):
    return [(r["kind"], text[r["start"] : r["end"]]) for r in reader.rows(text) if not wanted or r["kind"] in wanted]


@pytest.mark.parametrize(
    "text, kind, source",
    [
        ("# T #\n", "heading", "# T #"), ("T\n===\n", "heading", "T\n==="), ("```a\nx\n```\n", "code_block", "```a\nx\n```"), ("    x\n    y\n", "code_block", "    x\n    y"), ("> a\nb\n", "quote", "> a\nb"),
        ("- a\n- b\n", "bullet_list", "- a\n- b"), ("3) a\n4) b\n", "ordered_list", "3) a\n4) b"), ("|a|b|\n|-|-|\n|1|2|\n", "table", "|a|b|\n|-|-|\n|1|2|"), ("* * *\n", "rule", "* * *"), ("::: x\na\n:::\n", "div", "::: x\na\n:::"),
        ("{% a %}\n", "tag", "{% a %}"), ("[^n]: x\n", "note_definition", "[^n]: x"), ("[a]: http://x\n", "definition", "[a]: http://x"), ("<div>\nx\n</div>\n", "raw_block", "<div>\nx\n</div>"), ("a `c` b", "code", "`c`"), ("a $x$ b", "math", "$x$"),
        ("a [t](u) b", "link", "[t](u)"), ("![t](u)", "image", "![t](u)"), ("<http://a.b>", "autolink", "<http://a.b>"), ("see www.a.b/c.", "bare_url", "www.a.b/c"), ("[[P|t]]", "wikilink", "[[P|t]]"), ("[@a; @b]", "cite_group", "[@a; @b]"),
        ("x[^1]", "note", "[^1]"), ("*a*", "emph", "*a*"), ("__a__", "strong", "__a__"), ("~~a~~", "strikeout", "~~a~~"), ("[a]{.b}", "span", "[a]{.b}"), (r"\cmd{a}", "raw_inline", r"\cmd{a}"), ("a\\\nb", "line_break", "\\\n"),
    ],
)
def test_constructs(text, kind, source):
    assert (kind, source) in kinds(text)


def test_what_interrupts_a_paragraph():
    assert [k for k, _ in kinds("a\n- b\n", "para", "bullet_list")] == ["para"]
    assert [k for k, _ in kinds("a\n# b\n", "para", "heading")] == ["para"]
    assert [k for k, _ in kinds("a\n```\nb\n```\n", "para", "code_block")] == ["para", "code_block"]
    assert [k for k, _ in kinds("- a\n  - b\n", "bullet_list")] == ["bullet_list"] * 2


def test_not_math():
    for text in ("$ x $", "$20 and $30", "a $x$1", r"\$x\$"):
        assert not kinds(text, "math")


def test_identifiers_count_up():
    assert [r["ident"] for r in reader.rows("# A b!\n\n# A b\n\n# 1 x {#own}\n") if r["kind"] == "heading"] == ["a-b", "a-b-1", "own"]


def test_nested_offsets():
    text = "> - one *two*\n>   three `x`\n>\n>   more\n"
    for kind, source in (("emph", "*two*"), ("code", "`x`")):
        assert (kind, source) in kinds(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["# h\n", "a *b* c\n", "\n", "- x\n", "  - y\n", "> q\n", "```\n", "::: d\n", ":::\n", "|a|b|\n|-|-|\n", "1. z\n", "    code\n", "$x$ `y`\n", "[^1]: n\n", "[a](b)\n", "<!-- c -->\n", "---\n", "{% t %}\n", "[[", "**", "$", "[@k]\n", "\t- t\n"]), max_size=14).map("".join))
def test_any_text_is_read(text):
    rows = reader.rows(text)
    for r in rows:
        assert 0 <= r["start"] <= r["end"] <= len(text)
        assert r["parent_id"] is None or r["parent_id"] < r["node_id"]


@pytest.mark.parametrize("text, want", [("```\nx\n", [1]), ("```\nx\n```\n", []), ("````\n```\n", [1]), ("`` ` ``\n", []), ("~~~\n```\n~~~\n", []), ("a\n\n~~~ x\n", [3])])
def test_unclosed_fences(text, want):
    assert [line for line, _ in pre.unclosed_fences(text)] == want


@pytest.mark.parametrize("text, rejected, stray", [("a $ x $ b", [1], []), ("$x$1", [1], []), ("costs $5 and $6", [], []), ("a $x$ b", [], []), ("one $ only", [], [1]), ("`$ x $`", [], []), ("```\n$ x $\n```", [], []), ("a\n\nb $ y $", [3], [])])
def test_math_checks(text, rejected, stray):
    assert [line for line, _ in pre.rejected_math(text)] == rejected
    assert [line for line, _ in pre.stray_dollars(text)] == stray
