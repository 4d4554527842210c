"""Literal cases with the results they are to have: small inputs on Spark's side, VALUES on DuckDB's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import patterns, text, typography
from lectern.functions.arrow import udf_of
from lectern.lint import tex
from lectern.operators import preflight, wrapping
from lectern.plans import formatter, gate
from lectern.plans.formatter import Options
from lectern.sources import documents, references, settings

Case = tuple[str, str]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def quoted(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def literal(name: str, rows: list[tuple[str, ...]], columns: tuple[str, ...], run: Callable[[SparkSession], DataFrame]) -> None:
    """A query and the rows that it is to give, all strings."""
    values = ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows)
    QUERIES[name] = lambda spark, sf_dir: run(spark).select(*[F.col(c).cast("string").alias(c) for c in columns])
    ORACLE_SQL[name] = f"SELECT {', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in columns)} FROM (VALUES {values}) AS t({', '.join(columns)})"


def mapped(name: str, cases: list[tuple[str, str, str]], functions: dict[str, Callable[[], Column]]) -> None:
    """Cases (function, input, result) of functions of the column input. Columns are made when the query runs, as workers
    import this module, too."""

    def run(spark: SparkSession) -> DataFrame:
        rows = spark.createDataFrame([(f, i) for f, i, _ in cases], "function string, input string")
        result = F.coalesce(*[F.when(F.col("function") == f, c().cast("string")) for f, c in functions.items()])
        return rows.select("function", "input", result.alias("result"))

    literal(name, cases, ("function", "input", "result"), run)


def of(function: Callable[[str], str]) -> Callable[[], Column]:
    return lambda: udf_of(function, "string")("input")


def listed(found) -> str:
    return "|".join(found)


# Words, constructs, sentences ------------------------------------------------------------------------------------------

mapped(
    "word_cases",
    [
        ("tag_words", "a {% x y %} b", "a|{% x y %}|b"),
        ("tag_words", "{% a %}{% /a %} c", "{% a %} {% /a %}|c"),
        ("tag_words", 'see <a href="x y">this</a> now', 'see|<a href="x y">this</a>|now'),
        ("tag_words", "x <!-- a b --> y", "x|<!-- a b -->|y"),
        ("tag_words", "{{ v }}{# c d #}", "{{ v }}{# c d #}"),
        ("inline_words", "a [b c](d e) `f  g` h", "a|[b c](d e)|`f  g`|h"),
        ("inline_words", "so ($x + y$), then", "so|($x + y$),|then"),
        ("no_words", "a {% x y %} b", "a|{%|x|y|%}|b"),
    ],
    {
        "tag_words": of(lambda t: listed(wrapping.tag_words(t))),
        "inline_words": of(lambda t: listed(w.text for w in patterns.atomic_words(t, patterns.INLINE_PATTERNS))),
        "no_words": of(lambda t: listed(w.text for w in patterns.atomic_words(t, ()))),
    },
)

NAMES = lambda kinds: of(lambda t: listed(f"{s.name}:{s.text}" for s in patterns.spans(t, kinds) if s.is_atomic))
mapped(
    "construct_cases",
    [
        ("atomic", "`c d` $x$ [l](u)", "inline_code_span:`c d`|inline_math:$x$|markdown_link:[l](u)"),
        ("atomic", "{% t %} {# c #} {{ v }} <!-- h --> <b> </b>", "single_jinja_tag:{% t %}|single_jinja_comment:{# c #}|single_jinja_var:{{ v }}|single_html_comment:<!-- h -->|html_open_tag:<b>|html_close_tag:</b>"),
        ("atomic", "{% a %}{% /a %} {# b #}{# /b #} {{ c }}{{ /c }}", "paired_jinja_tag:{% a %}{% /a %}|paired_jinja_comment:{# b #}{# /b #}|paired_jinja_var:{{ c }}{{ /c }}"),
        ("atomic", "<!-- f --><!-- /f -->", "paired_html_comment:<!-- f --><!-- /f -->"),
        ("atomic", "cost $5 and $6, \\$x", ""),
        ("inline", "<http://a.b> <me@x.org> www.c.d/e. https://f.g/h)", "autolink:<http://a.b>|autolink:<me@x.org>|bare_url:www.c.d/e|bare_url:https://f.g/h"),
        ("inline", "``a ` b`` and $$x$$ and \\(y\\)", "inline_code_span:``a ` b``|inline_math:$$x$$|inline_math:\\(y\\)"),
        ("inline", "[ref][id] ![alt](src) {% t %}", "markdown_link:[ref][id]|markdown_link:[alt](src)"),
        ("own", "a @@b c@@ d", "marked:@@b c@@"),
    ],
    {"atomic": NAMES(patterns.ATOMIC_PATTERNS), "inline": NAMES(patterns.INLINE_PATTERNS), "own": NAMES((patterns.Pattern("marked", "@@.*?@@"),))},
)

PLACES = lambda f: of(lambda t: listed(f"{s.start}-{s.end}" for s in f(t)))
mapped(
    "sentence_cases",
    [
        ("spans", "One is here now. Two is there too.", "0-16|17-34"),
        ("spans", "Hi. This one is long enough.", "0-28"),
        ("spans", "As `a. b` says it. Then [c. d](e) ends it.", "0-18|19-42"),
        ("spans_any_length", "Hi. This.\n\nAnd that.", "0-3|4-9|11-20"),
        ("tag_sentences", "He {% a. b %} said so. Yes.", "He {% a. b %} said so.|Yes."),
        ("plain", "Mr. Smith met Dr. Jones there. Then he left it.", "Mr. Smith met Dr. Jones there.|Then he left it."),
        ("plain", "So it says [@doe2020]. And then $x = y$. The end is near.", "So it says [@doe2020].|And then $x = y$.|The end is near."),
        ("plain", "Sie fährt nach Köln. Él habló así. Fine.", "Sie fährt nach Köln.|Él habló así. Fine."),
        ("plain", "He said “stop.” Then he went (home.) So.", "He said “stop.”|Then he went (home.)|So."),
        ("first_two", "One is here now. Two is there too. Three is gone.", "One is here now.|Two is there too."),
    ],
    {
        "spans": PLACES(patterns.sentence_spans),
        "spans_any_length": PLACES(lambda t: patterns.sentence_spans(t, 0)),
        "tag_sentences": of(lambda t: listed(wrapping.tag_sentences(t))),
        "plain": of(lambda t: listed(patterns.plain_sentences(t))),
        "first_two": of(lambda t: listed(patterns.first_sentences(t, 2))),
    },
)

# Filling and wrapping ---------------------------------------------------------------------------------------------------

SHORT_WORDS = "word - word * word + word > word # word ## word 1. word 2) word"
mapped(
    "wrap_cases",
    [
        ("width_10", "aa bb cc dd ee", "aa bb cc\ndd ee"),
        ("width_10", "abcdefghijklm n", "abcdefghijklm\nn"),
        ("width_0", "  aa bb\ncc  ", "aa bb cc"),
        ("escaped_5", "- word", "-\nword"),
        ("escaped_5", SHORT_WORDS, "word\n\\-\nword\n\\*\nword\n\\+\nword\n\\>\nword\n\\#\nword\n\\##\nword\n1\\.\nword\n2\\)\nword"),
        ("indented_12", "aa bb cc dd ee", "* aa bb cc\n  dd ee"),
        ("by_letters", "aa-- bb cc", "aa-- bb\ncc"),
        ("sentence_30", "One is here. Two is there and it goes on for long. Three.", "One is here. Two is there and\nit goes on for long.\nThree."),
        ("sentence_0", "One is here. Two is there. - three", "One is here.\nTwo is there.\n\\- three"),
        ("sentence_30", "He. Yes, that one.", "He. Yes, that one."),
        ("markdown_20", "one two  \nthree four five six seven", "one two\\\nthree four five six\nseven"),
        ("markdown_20", "{% a %}\ntext of it here and more\n{% /a %}", "{% a %}\ntext of it here and\nmore\n{% /a %}"),
        ("markdown_40", "{% list %}\n- one\n- two\n{% /list %}", "{% list %}\n\n- one\n- two\n\n{% /list %}"),
        ("markdown_40", "<!-- a -->\n| x | y |\n|---|---|\n| 1 | 2 |\n<!-- /a -->", "<!-- a -->\n\n| x | y |\n|---|---|\n| 1 | 2 |\n\n<!-- /a -->"),
        ("closing", "{% a %} begins here\nand ends {% b %} {% /a %}", "{% a %} begins here\nand ends {% b %}\n{% /a %}"),
        ("markdown_sentence", "One is here now. Two is\\\nthere too. - x", "One is here now.\nTwo is\\\nthere too.\n\\- x"),
    ],
    {
        "width_10": of(lambda t: wrapping.by_width(10)(t, "", "")),
        "width_0": of(lambda t: wrapping.by_width(0)(t, "", "")),
        "escaped_5": of(lambda t: wrapping.by_width(5, wrapping.escape_word)(t, "", "")),
        "indented_12": of(lambda t: wrapping.fill(t, 12, "* ", "  ")),
        "by_letters": of(lambda t: "\n".join(wrapping.fill_lines(t, 6, length=lambda w: sum(c.isalpha() for c in w)))),
        "sentence_30": of(lambda t: wrapping.by_sentence(30)(t, "", "")),
        "sentence_0": of(lambda t: wrapping.by_sentence(0, escape=wrapping.escape_word)(t, "", "")),
        "markdown_20": of(lambda t: wrapping.markdown_by_width(20)(t, "", "")),
        "markdown_40": of(lambda t: wrapping.markdown_by_width(40)(t, "", "")),
        "closing": of(wrapping.closing_tags_apart),
        "markdown_sentence": of(lambda t: wrapping.markdown_by_sentence(0)(t, "", "")),
    },
)

TWO = "aa bb cc dd\n\nee ff gg"
mapped(
    "fill_cases",
    [
        ("none", TWO, "aa bb cc dd\n\nee ff gg"),
        ("wrap", TWO, "aa bb cc\ndd\n\nee ff gg"),
        ("wrap", "a   b", "a b"),
        ("wrap_full", TWO, "aa bb cc\ndd\n\nee ff gg"),
        ("wrap_indent", TWO, "    aa\n    bb\n    cc\n    dd\n\n    ee\n    ff\n    gg"),
        ("indent_only", TWO, "    aa bb cc dd\n    \n    ee ff gg"),
        ("hanging_indent", TWO, "aa\n    bb\n    cc\n    dd\n\n    ee\n    ff\n    gg"),
        ("markdown_item", TWO, "aa bb\n  cc\n  dd\n\n  ee\n  ff\n  gg"),
    ],
    {how.value: of(lambda t, how=how: wrapping.fill_text(t, how, 8)) for how in wrapping.Fill},
)

mapped(
    "line_cases",
    [
        ("starts_with_tag", "  {% a %} x", "true"), ("starts_with_tag", "x {% a %}", "false"), ("ends_with_tag", "x --> ", "true"), ("ends_with_tag", "--> x", "false"),
        ("is_tag_line", "{{ a }}", "true"), ("is_tag_line", " {{ a }}", "false"), ("is_closing_tag", "  <!-- /a -->", "true"), ("is_closing_tag", "<!-- a -->", "false"),
        ("segments", "a\nb\n{% t %}\n- c\n- d\ne", "text:2|text:1|item:1|item:1|text:1"), ("segments", "a\n| b |\n|---|\n| c |\nd", "text:1|table:3|text:1"), ("segments", "- a\n- b", "text:2"),
        ("table_rows", "| a |\n|:-:|\n| b |\nc", "3"), ("table_rows", "| a |\n| b |", "0"),
        ("spaced", "{% a %}{% /a %}<!-- x --><!-- y -->", "{% a %} {% /a %}<!-- x --> <!-- y -->"), ("rejoined", "{% a %} {% /a %} <!-- x --> <!-- y -->", "{% a %}{% /a %} <!-- x --><!-- y -->"),
        ("several_paragraphs", "a\n \nb", "true"), ("several_paragraphs", "a\nb", "false"), ("fence", "```py", "```"), ("fence", "``` a`b", ""), ("fence", "    ```", ""),
        ("prose_runs", "a\nb\n\n```\nc\n```\nd", "0,1|6"),
        ("escaped", "1. x", "1\\. x"), ("escaped", "iv) x", "iv\\) x"), ("escaped", "(a) x", "\\(a) x"), ("escaped", "-x y", "-x y"), ("escaped", "## x", "\\## x"),
    ],
    {
        **{f.__name__: of(lambda t, f=f: str(f(t)).lower()) for f in (wrapping.starts_with_tag, wrapping.ends_with_tag, wrapping.is_tag_line, wrapping.is_closing_tag)},
        "segments": of(lambda t: listed(f"{k}:{len(x)}" for k, x in wrapping.segments(t.split("\n")))),
        "table_rows": of(lambda t: str(wrapping.table_rows(t.split("\n")))),
        "spaced": lambda: text.spaced_tags(F.col("input")),
        "rejoined": lambda: text.rejoined_tags(F.col("input")),
        "several_paragraphs": lambda: text.is_multi_paragraph(F.col("input")),
        "fence": of(preflight.fence_of),
        "prose_runs": of(lambda t: listed(",".join(map(str, r)) for r in preflight.runs_of_prose(t.split("\n")))),
        "escaped": lambda: text.escape_line_start(F.col("input")),
    },
)

# Typography --------------------------------------------------------------------------------------------------------------

mapped(
    "typography_cases",
    [
        ("ellipses", "Wait...what", "Wait … what"), ("ellipses", "and so on...", "and so on …"), ("ellipses", "\"...so\" he said", "\"… so\" he said"), ("ellipses", "a ...\nb", "a …\nb"), ("ellipses", "word....word", "word ….word"), ("ellipses", "word.....", "word....."), ("ellipses", "/...", "/..."),
        ("quotes", 'He said "hi" to me.', "He said “hi” to me."), ("quotes", "She said 'hi' to me.", "She said ‘hi’ to me."), ("quotes", "it's James' own", "it’s James’ own"), ("quotes", "the '90s and 'til then", "the ’90s and ’til then"),
        ("quotes", 'x="y" and 6" wide', 'x="y" and 6" wide'), ("quotes", 'He "began and "ended" it', 'He "began and "ended" it'), ("quotes", '{% a b="c" %} "d"', '{% a b="c" %} “d”'), ("quotes", 'one "a\n\nb" two', 'one "a\n\nb" two'),
        ("sourced_quotes", 'a "b" `"c"` [d "e" f](f "g")\n', 'a “b” `"c"` [d “e” f](f "g")\n'), ("sourced_ellipses", "a...b `c...d` $x...$\n", "a … b `c...d` $x...$\n"),
    ],
    {"ellipses": of(typography.ellipses), "quotes": of(typography.smart_quotes), "sourced_quotes": of(formatter.curl), "sourced_ellipses": of(formatter.dots)},
)

# Formatter ---------------------------------------------------------------------------------------------------------------

mapped(
    "formatter_passes",
    [
        ("1 leading tabs", "\ta\n\n-\tb\n", "\ta\n\n-   b\n"),
        ("2 spelling", "_a_ __b__ [r] [r][r]\n\n[r]: x\n", "*a* **b** [r][] [r][]\n\n[r]: x\n"),
        ("2 spelling", "a  \nb $x\n+y$\n", "a\\\nb $x +y$\n"),
        ("2 spelling", ":::{.x}\na\n:::\n", "::: {.x}\na\n:::\n"),
        ("2 escapes", "It is 1990\\. and so.\n\n1990\\. It is.\n", "It is 1990. and so.\n\n1990\\. It is.\n"),
        ("3 tag block spacing", "{% a %}\n- x\n", "{% a %}\n\n- x\n"),
        ("4 lazy lists", "a\n- b\n- c\n", "a\n\n- b\n- c\n"),
        ("4 lazy lists", "a\n2019. b\n", "a\n2019. b\n"),
        ("5 note definitions", "a[^1]\n[^1]: x\n", "a[^1]\n\n[^1]: x\n"),
        ("6 marker spacing", "-   a\n\n    b\n", "- a\n\n  b\n"),
        ("7 list indentation", "- a\n    - b\n        - c\n", "- a\n  - b\n    - c\n"),
        ("7 list indentation", "1.  a\n    - b\n", "1. a\n   - b\n"),
        ("8 html block layout", "<div>\nSome words\nof it.\n</div>\n", "<div> Some words\nof it. </div>\n"),
        ("8 html block layout", "<pre>\nx\n</pre>\n\n> <p>\n> y\n", "<pre>\nx\n</pre>\n\n> <p>\n> y\n"),
        ("9 unbold headings", "# **a**\n\n## b **c**\n", "# a\n\n## b **c**\n"),
        ("10 join hyphen breaks", "well-\nknown, short-\nand long, `x-\ny`\n", "well-known, short-\nand long, `x-\ny`\n"),
        ("11 smart quotes", 'a "b" `"c"` it\'s\n', 'a “b” `"c"` it’s\n'),
        ("12 ellipses", "a...b `c...d`\n", "a … b `c...d`\n"),
        ("13 wrap paragraphs", "# A title\n\nOne is here now. Two is\nthere too.\n\n> Quoted is it. And that.\n", "# A title\n\nOne is here now.\nTwo is there too.\n\n> Quoted is it.\n> And that.\n"),
        ("13 display math", "So we have\n$$\na = b\n$$\nand the rest.\n", "So we have\n$$\na = b\n$$\nand the rest.\n"),
        ("14 list spacing", "- a\n- b\n\n1. c\n2. d\n", "- a\n\n- b\n\n1. c\n\n2. d\n"),
        ("15 indented code", "a\n\n    x\n    `y`\n", "a\n\n```\nx\n`y`\n```\n"),
        ("16 pipe tables", "|a|b|\n|:-|-:|\n|1|2|\n", "| a | b |\n| :--- | ---: |\n| 1 | 2 |\n"),
        ("17 rules", "a\n\n---\n\n***\n", "a\n\n* * *\n\n* * *\n"),
        ("18 blank gaps", "a\n\n\n\nb\n\n```\n\n\n\n```\n", "a\n\nb\n\n```\n\n\n\n```\n"),
        ("19 heading spacing", "# a\nb\n", "# a\n\nb\n"),
        ("20 quote blank lines", "> a\n>\n> b\n", "> a\n> \n> b\n"),
    ],
    {
        "1 leading tabs": of(formatter.expand_tabs),
        "2 spelling": of(formatter.spell),
        "2 escapes": of(formatter.drop_escapes),
        "3 tag block spacing": of(formatter.space_tags),
        "4 lazy lists": of(formatter.separate_lists),
        "5 note definitions": of(formatter.separate_notes),
        "6 marker spacing": of(formatter.place_items),
        "7 list indentation": of(formatter.place_items),
        "8 html block layout": of(formatter.join_html_lines),
        "9 unbold headings": of(formatter.unbold_headings),
        "10 join hyphen breaks": of(lambda t: formatter.join_hyphens(t)[0]),
        "11 smart quotes": of(formatter.curl),
        "12 ellipses": of(formatter.dots),
        "13 wrap paragraphs": of(lambda t: formatter.wrap_paragraphs(t, formatter.wrapper_of(formatter.AUTO))),
        "13 display math": of(lambda t: formatter.wrap_paragraphs(t, formatter.wrapper_of(formatter.AUTO))),
        "14 list spacing": of(lambda t: formatter.space_items(t, "loose")),
        "15 indented code": of(formatter.fence_code),
        "16 pipe tables": of(formatter.align_tables),
        "17 rules": of(formatter.same_rules),
        "18 blank gaps": of(formatter.close_gaps),
        "19 heading spacing": of(formatter.space_headings),
        "20 quote blank lines": of(formatter.quote_blanks),
    },
)

DOCUMENT = "---\nt: 1\n---\n# **Title**\nIt's \"quoted\"... so. A second\nsentence of it.\n* one\n* two\n\n|a|b|\n|-|-|\n|1|2|\n"
mapped(
    "format_cases",
    [
        ("auto", DOCUMENT, "---\nt: 1\n---\n\n# Title\n\nIt’s “quoted”... so.\nA second sentence of it.\n\n* one\n\n* two\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n"),
        ("width_30", "Some words stand here and then [a link with words](http://a.b) and more.\n", "Some words stand here and then\n[a link with words](http://a.b)\nand more.\n"),
        ("semantic_40", "One is here now. Two is there and it goes on for rather long.\n", "One is here now.\nTwo is there and it goes\non for rather long.\n"),
        ("plain", "a\nb\n\nc\n", "a b\n\nc"),
        ("preserve", "- one\n- two\n- three\n", "- one\n- two\n- three\n"),
        ("preserve", "- one\n\n- two\n", "- one\n\n- two\n"),
        ("preserve", "1. one\n2. two\n", "1. one\n2. two\n"),
        ("tight", "- one\n\n- two\n", "- one\n- two\n"),
        ("loose", "- one\n- two\n", "- one\n\n- two\n"),
        ("loose", "- a\n  - b\n  - c\n", "- a\n\n  - b\n\n  - c\n"),
        ("own_formatter", "- a\n- b\n", "ok: - a\n\n- b\n"),
        ("own_formatter", "lost words\n", "refused: lost words\n"),
        ("status", "fine\n", "unchanged||"),
        ("status", "a   b\n", "ok||"),
        ("status", "# **a**\n", "ok|unbold_heading|"),
        ("status", "a\n- b\n", "ok|lazy_list|lazy_list"),
    ],
    {
        "auto": of(lambda t: formatter.reformat(t, formatter.AUTO)["text"]),
        "width_30": of(lambda t: formatter.fill_markdown(t, Options(width=30))),
        "semantic_40": of(lambda t: formatter.fill_markdown(t, Options("semantic", 40))),
        "plain": of(lambda t: formatter.reformat(t, Options("plain"))["text"]),
        **{s: of(lambda t, s=s: formatter.fill_markdown(t, Options(list_spacing=s))) for s in formatter.SPACINGS},
        "own_formatter": of(lambda t: "{status}: {text}".format(**formatter.reformat(t, Options(), lambda x, o: x.replace("\n-", "\n\n-").replace("lost ", "")))),
        "status": of(lambda t: "|".join((r := formatter.reformat(t, formatter.AUTO if t[0] == "#" else Options(list_spacing="preserve")))[k] if k == "status" else ",".join(r[k]) for k in ("status", "normalizations", "unasked"))),
    },
)

#: (before, after, verdict): for each change that a format may make one that is accepted and one that isn't.
GATE = [
    ("# **X**\n", "# X\n", "unbold_heading"), ("# **X**\n", "# *X*\n", "refused: 0"), ("- a\n- b\n", "- a\n\n- b\n", "list_spacing"), ("- a\n- b\n", "- a\n\n- b\n\n- c\n", "refused: 0"),
    ('He said "hi" and there.\n', "He said “hi” and there.\n", "smart_quotes"), ('He said "hi" and there.\n', "He said hi and there.\n", "refused: 0"),
    ("> [!note]\n> Text.\n", "> [!NOTE]\n> Text.\n", "alert_type"), ("> [!note]\n> Text.\n", "> [!NOTED]\n> Text.\n", "refused: 0"),
    ("Shared infrastructure:\n- a\n- b\n", "Shared infrastructure:\n\n- a\n\n- b\n", "lazy_list"), ("Shared infrastructure:\n\n- a\n\n- b\n", "Shared infrastructure: - a - b\n", "refused: 0"),
    ("the degree-\n2 Coble locus\n", "the degree-2 Coble locus\n", "hyphen_join"), ("the degree-2 Coble locus\n", "the degree- 2 Coble locus\n", "refused: 0"),
    ("same\n\nsame\n", "same\n\nother\n", "refused: 1"), ("a b\n", "a\nb\n", ""), ("a\n", "a\n\nb\n", "refused: 1"), ("short-\nand long\n", "short-and long\n", "refused: 0"), ("a\n- b\n- c\n", "a\n\n- b\n", "refused: 0"),
]


def verdict(before: str, after: str) -> str:
    got = gate.check(before, after)
    return ",".join(got["normalizations"]) if got["ok"] else f"refused: {got['block']}"


literal(
    "gate_cases",
    GATE,
    ("before", "after", "verdict"),
    lambda spark: spark.createDataFrame([g[:2] for g in GATE], "before string, after string").select("before", "after", udf_of(verdict, "string")(F.col("before"), F.col("after")).alias("verdict")),
)

PREFLIGHT = [
    ("a\n```\nb", "2:unclosed_fence"), ("~~~\n```\n~~~\n", ""), ("a $ x$ b\n\nc $y $\n", "1:rejected_math|3:rejected_math"), ("it is $5\n", ""), ("a $x b\n", "1:stray_dollar"), ("`$` and \\$ and $x$\n", ""), ("a $x$2\n", "1:rejected_math"),
]
mapped("preflight_cases", [("preflight", i, r) for i, r in PREFLIGHT], {"preflight": of(lambda t: listed(f"{f['line']}:{f['check']}" for f in preflight.preflight(t)))})

# Sources -------------------------------------------------------------------------------------------------------------------

MACROS = [
    (r"\newcommand{\R}{\mathbb{R}}", "R", r"\mathbb{R}", "0", "false"), (r"\renewcommand\abs[1]{|#1|}", "abs", "|#1|", "1", "false"), (r"\providecommand{\opt}[2][x]{#1#2}", "opt", "#1#2", "2", "true"),
    (r"\DeclareMathOperator{\Hom}{Hom}", "Hom", r"\operatorname{Hom}", "0", "false"), (r"\DeclareMathOperator*{\colim}{colim}", "colim", r"\operatorname*{colim}", "0", "false"), (r"\def\foo#1{a#1}", "foo", "a#1", "1", "false"),
    (r"\DeclarePairedDelimiter\norm{\lVert}{\rVert}", "norm", r"\lVert#1\rVert", "1", "false"), (r"\DeclarePairedDelimiterX\ip[2]{\langle}{\rangle}{#1,#2}", "ip", r"\langle#1,#2\rangle", "2", "false"),
    (r"\NewDocumentCommand{\pair}{o m m}{(#2,#3)}", "pair", "(#2,#3)", "3", "true"), (r"\DeclareDocumentCommand\star{s m}{#2}", "star", "#2", "2", "false"), (r"\NewExpandableDocumentCommand\e{r() m}{#2}", "e", "#2", "2", "false"),
    (r"\newrobustcmd{\bf}[1]{\mathbf{#1}}", "bf", r"\mathbf{#1}", "1", "false"), (r"\let\eps=\varepsilon", "eps", r"\varepsilon", "0", "false"), (r"\let\to\rightarrow", "to", r"\rightarrow", "0", "false"),
    ("% \\newcommand{\\no}{x}\n\\newcommand{\\yes}{y}", "yes", "y", "0", "false"),
]


def macro_cases(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(m[0],) for m in MACROS], "source string")
    return rows.select("source", F.inline(tex.macros_column("source")))


literal("macro_source_cases", MACROS, ("source", "name", "replacement", "argument_count", "optional_first"), macro_cases)

BIBLIOGRAPHIES = [("a.bib", "@book{k1, t={x}}\n@comment{no, x}\n@article{k2,\n"), ("b.json", '[{"id": "k3"}]'), ("c.ris", "TY  - B\nID  - k4\n"), ("d.yaml", "references:\n- id: k5\n"), ("e.txt", "@book{k6, x}")]
literal("bibliography_cases", [(f"k{n}",) for n in range(1, 6)], ("key",), lambda spark: references.bibliography(spark.createDataFrame(BIBLIOGRAPHIES, "path string, text string")))

INDEX = '{"core": ["\\\\alpha", "beta"], "packages": {"p": {"commands": ["\\\\gamma"], "includes": ["q"]}, "q": {"commands": ["delta"], "includes": []}}}'


def vocabulary_cases(spark: SparkSession) -> DataFrame:
    schema = "core array<string>, packages map<string,struct<commands:array<string>,includes:array<string>>>"
    one = spark.createDataFrame([(INDEX,)], "text string").select(F.from_json("text", schema).alias("x")).select("x.*")
    commands, includes = references.vocabulary_tables(one)
    return commands.select("package", F.col("command").alias("name"), F.lit("command").alias("kind")).unionByName(includes.select("package", F.col("include").alias("name"), F.lit("include").alias("kind")))


literal("vocabulary_cases", [("", "alpha", "command"), ("", "beta", "command"), ("p", "gamma", "command"), ("q", "delta", "command"), ("p", "q", "include")], ("package", "name", "kind"), vocabulary_cases)

LOADED = r"\documentclass[12pt]{article} \usepackage{a, b}\RequirePackage[x]{c}"
literal("package_cases", [("a",), ("b",), ("c",), ("article",)], ("package",), lambda spark: references.packages_of(spark.createDataFrame([(1, LOADED)], "doc_id long, text string")))

#: A tree of files (path, size), and which are documents: by default, with patterns, by a glob.
TREE = [("a.md", 10), ("b.txt", 10), ("big.md", 2 << 20), ("d/c.md", 10), ("d/e/f.md", 10), ("node_modules/g.md", 10), ("build/h.md", 10), ("d/i.MD", 10), ("x.egg-info/j.md", 10), ("d/builder/k.md", 10), ("drafts/l.md", 10), ("drafts/keep.md", 10)]


def tree_cases(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([("/root/" + p, n) for p, n in TREE], "path string, size long")
    below = documents.relative(F.col("path"), "file:/root").alias("path")
    default, every = documents.Discovery(), documents.Discovery(include=("*.md", "*.txt"), exclude=(), max_size=0)
    ways = {"default": (default, None), "everything": (every, None), "ignored": (default, ["drafts/*", "!keep.md", "/d/e/"]), "extra": (documents.Discovery(extra=("d/",)), None)}
    kept = [rows.where(documents.wanted(F.col("path"), F.col("size"), "file:/root", d, i)).select(F.lit(name).alias("way"), below) for name, (d, i) in ways.items()]
    kept.append(rows.where(F.col("path").rlike(documents.glob_regex("file:/root/{a,d/*}.{md,txt}"))).select(F.lit("glob").alias("way"), below))
    out = kept[0]
    for k in kept[1:]:
        out = out.unionByName(k)
    return out


DEFAULT = ["a.md", "d/c.md", "d/e/f.md", "d/builder/k.md", "drafts/l.md", "drafts/keep.md"]
literal(
    "file_cases",
    [
        *[("default", p) for p in DEFAULT],
        *[("everything", p) for p, _ in TREE if p != "d/i.MD"],
        *[("ignored", p) for p in ("a.md", "d/c.md", "d/builder/k.md", "drafts/keep.md")],
        *[("extra", p) for p in ("a.md", "drafts/l.md", "drafts/keep.md")],
        *[("glob", p) for p in ("a.md", "d/c.md")],
    ],
    ("way", "path"),
    tree_cases,
)


def setting(source: str) -> str:
    try:
        s = settings.parse(source)
    except ValueError as e:
        return f"error: {str(e).partition(': ')[2]}"
    o, d = s.options(), s.discovery()
    return f"{o.wrap} {o.width} {','.join(sorted(o.passes))} {o.list_spacing} {len(d.include)} {d.max_size} {','.join(f'{k}={v}' for k, v in sorted(s.lint.get('rules', {}).items()))}".strip()


mapped(
    "setting_cases",
    [
        ("settings", "", "width 88  loose 1 1048576"),
        ("settings", "semantic = true\nsmartquotes = true\n", "semantic 0 smartquotes loose 1 1048576"),
        ("settings", '[formatting]\nwidth = 60\nlist-spacing = "tight"\n[file-discovery]\nextend-include = ["*.txt"]\nfiles-max-size = 5\n', "width 60  tight 2 5"),
        ("settings", 'plain = true\n[lint.rules]\n"heading/duplicate" = "off"\n', "plain 88  loose 1 1048576 heading/duplicate=off"),
        ("settings", "nope = 1", "error: no such setting: nope"),
        ("settings", 'width = "x"', "error: width is to be int"),
        ("settings", "width = true", "error: width is to be int"),
        ("settings", "include = [1]", "error: include is to be a list of strings"),
        ("settings", 'list-spacing = "odd"', "error: list-spacing is to be one of preserve, loose, tight"),
    ],
    {"settings": of(setting)},
)
