"""Scalar and tokenizer semantics: native columns against Python, unit tables, offset invariants."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import patterns as p
from lectern.functions import text as t
from lectern.functions.frontmatter import split_frontmatter
from lectern.functions.typography import ellipses, smart_quotes
from lectern.operators import wrapping as w

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "word, ends",
    [("end.", True), ("end?!", False), ("Dr.", False), ("(vs.", False), ("a.", False), ("NASA.", False), ("über.", True), ("x1.", False), ("“word.”", True), ("word”.", True), ("$x$.", True), ("[@key].", True), ("p.m.", False), ("etc.)", False), ("word", False), ("don't.", False), ("half-word.", True)],
)
def test_sentence_ends(spark, word, ends):
    assert p.ends_sentence(word) is ends
    assert spark.createDataFrame([(word,)], "w string").select(t.ends_sentence(F.col("w")).alias("e")).first().e is ends


def test_native_sentences_equal_the_fold(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", t.sentences(F.col("text")).alias("s"))
    for r in docs.collect():
        assert r.s == p.plain_sentences(r.text, 0)


@pytest.mark.parametrize("text, n, want", [("One. Two is a longer one here. Three.", 0, ["One.", "Two is a longer one here.", "Three."]), ("One. Two is a longer one here. Three.", 15, ["One. Two is a longer one here.", "Three."]), ("", 0, []), ("  no end", 0, ["no end"])])
def test_sentences(text, n, want):
    assert p.plain_sentences(text, n) == want
    assert [s.text for s in p.sentence_spans(text, n)] == want


pieces = st.lists(st.sampled_from(["word", " ", "\n", "`code x`", "[a b](u v)", "$x + y$", "https://a.b/c.", "{% t %}", "{% /t %}", "<!-- c -->", "<b>", "</b>", ".", "\\", "[", "`", "$"]), max_size=25).map("".join)


@settings(max_examples=200, deadline=None)
@given(pieces)
def test_spans_cover_the_text(text):
    for patterns in (p.ATOMIC_PATTERNS, p.INLINE_PATTERNS, p.TAG_PATTERNS, ()):
        found = p.spans(text, patterns)
        assert "".join(s.text for s in found) == text
        assert all(text[s.start : s.end] == s.text for s in found)
        for piece in [*p.atomic_words(text, patterns), *p.sentence_spans(text, 0, patterns=patterns)]:
            assert text[piece.start : piece.end] == piece.text
            assert not any(s.is_atomic and s.start < piece.start < s.end for s in found)


def test_span_names():
    assert [s.name for s in p.spans("a `c` $x$ [l](u) {% a %}{% /a %} <b>") if s.is_atomic] == ["inline_code_span", "inline_math", "markdown_link", "paired_jinja_tag", "html_open_tag"]


@pytest.mark.parametrize("word, want", [("-", "\\-"), ("1.", "1\\."), ("12)", "12\\)"), ("##", "\\##"), (">", "\\>"), ("(2)", "\\(2)"), ("(@a)", "\\(@a)"), ("iv.", "iv\\."), ("xxxxx.", "xxxxx."), ("A)", "A\\)"), ("A.", "A."), ("-x", "-x"), ("word", "word")])
def test_escape_word(spark, word, want):
    assert w.escape_word(word) == want
    assert spark.createDataFrame([(word,)], "w string").select(t.escape_word(F.col("w")).alias("e")).first().e == want


def test_fill_lines():
    assert w.fill_lines("aaa bbb ccc ddd", 7) == ["aaa bbb", "ccc ddd"]
    assert w.fill_lines("aaa bbb", 7, column=4) == ["aaa", "bbb"]
    assert w.fill_lines(" a  b ", 0) == ["a  b"] and w.fill_lines("", 10) == []
    assert w.fill_lines("word - next", 6, escape=w.escape_word) == ["word -", "next"]
    assert w.fill_lines("words - next", 6, escape=w.escape_word) == ["words", "\\-", "next"]
    assert w.fill_lines("a {% if x y z %} b", 6) == ["a", "{% if x y z %}", "b"]


def test_fill_modes():
    text = "one two three four\n\nfive six seven"
    assert w.fill_text(text, "wrap", 10) == "one two\nthree four\n\nfive six\nseven"
    assert w.fill_text(text, "hanging_indent", 16) == "one two\n    three\n    four\n\n    five six\n    seven"
    assert w.fill_text(text, "markdown_item", 12).splitlines()[1].startswith("  ")
    assert w.fill_text("a\nb", "indent_only") == "    a\n    b" and w.fill_text("", "none", empty="-") == "-"


def test_sentence_wrap():
    wrap = w.by_sentence(30)
    assert wrap("This is one sentence here. And this is another one.", "", "") == "This is one sentence here.\nAnd this is another one."
    assert wrap("Short one. And this is more.", "", "") == "Short one. And this is more."
    assert w.by_sentence(0)("One two. Three four. - five.", "> ", "  ") == "> One two.\n  Three four.\n  - five."
    assert w.by_sentence(0)("One two. Three four.", "", "  ") == "One two.\nThree four."


def test_hard_breaks_and_tags():
    assert w.markdown_by_width(20)("one two  \nthree\\\nfour", "", "") == "one two\\\nthree\\\nfour"
    assert w.markdown_by_width(40)("{% a %}\n- item one\n{% /a %}", "", "") == "{% a %}\n\n- item one\n\n{% /a %}"
    assert w.closing_tags_apart("{% t a=1\nb=2 %}{% /t %}") == "{% t a=1\nb=2 %}\n{% /t %}"
    assert w.markdown_by_width(80)("{% f %}{% /f %} text", "", "") == "{% f %}{% /f %} text"


@pytest.mark.parametrize("text, want", [("a...b", "a … b"), ("wait ... what", "wait … what"), ("end...", "end …"), ("...start", "… start"), ('"...so"', '"… so"'), ("x...)", "x …)"), ("./...", "./..."), ("1...2", "1 … 2"), ("a....b", "a ….b")])
def test_ellipses(text, want):
    assert ellipses(text) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("I'm there with \"George\"", "I’m there with “George”"), ('"Hello," he said.', "“Hello,” he said."), ("X is 'foo'", "X is ‘foo’"), ("James' book", "James’ book"), ("the '80s and '90s", "the ’80s and ’90s"),
        ('x="foo"', 'x="foo"'), ("Blah'blah'blah", "Blah'blah'blah"), ("the '90s, rock 'n' roll", "the '90s, rock 'n' roll"), ('{% f k="s" %} "a"', '{% f k="s" %} “a”'), ('"two\n\npars"', '"two\n\npars"'), ("'apos", "'apos"), ("$James' x", "$James' x"),
    ],
)
def test_smart_quotes(text, want):
    assert smart_quotes(text) == want and len(want) == len(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab s'\"\n.—{%}", max_size=40))
def test_quotes_keep_length_and_settle(text):
    assert len(smart_quotes(text)) == len(text)
    assert smart_quotes(text).replace("“", '"').replace("”", '"').replace("‘", "'").replace("’", "'") == text


@pytest.mark.parametrize("text, want", [("---\na: 1\n---\nbody\n", ("---\na: 1\n---\n", "body")), ("body", ("", "body")), ("---\nopen", ("---\nopen", "")), ("\n\n---\n---\nx", ("---\n---\n", "x")), ("", ("", ""))])
def test_frontmatter(text, want):
    assert split_frontmatter(text) == want
