"""Markdown made from the columns of ``documents``, as one expression for Spark's SQL and DuckDB's."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources.session import spread

#: (divisor, remainder, text): the text stands in documents whose id has the remainder; divisor 1: in all.
PARTS = (
    (10, 0, "---\ntitle: T\ntitle: U\n---\n\n"),
    (10, 5, "---\ntitle: T\n---\n\n"),
    (13, 0, "## Part {source}\n\n"),
    (-13, 0, "# {source}\n\n"),
    (3, 0, "### **{lang}**\n\n"),
    (-3, 0, "## {lang}\n\n"),
    (4, 0, "# {source}\n\n"),
    (7, 0, "## Ends here.\n\n"),
    (1, 0, "See [text](#{lang}) and [here](#nope).\n\n"),
    (6, 0, "![](img.png)\n\n"),
    (6, 1, "[gone]()\n\n"),
    (1, 0, "- one\n"),
    (2, 0, "* two\n"),
    (1, 0, "\n"),
    (3, 1, "~~~\n\tcode\n~~~\n\n"),
    (-3, 1, "```sql\nselect 1\n```\n\n"),
    (8, 0, "~~~py\nx\n~~~\n\n"),
    (1, 0, "Visit http://ex.org/{id}.\n\n"),
    (9, 0, "TODO write.\n\n"),
    (5, 1, "Let $x_a_b$ be.\n\n"),
    (5, 2, "Now $\\epsilon$, $\\varepsilon$ and $\\varepsilon$.\n\n"),
    (5, 3, "So $A \\subset B$ holds.\n\n"),
    (11, 0, "Not $ x $ math.\n\n"),
    (1, 0, "Noted[^a].\n\n[^a]: First.\n\n"),
    (4, 1, "[^b]: Never.\n\n"),
    (4, 2, "[^a]: Again.\n\n"),
    (1, 0, "By [@key{key}].\n\n[[Page{page}]]\n\n"),
    (12, 3, "well-\nknown and short-\nand long\n\n"),
    (12, 4, "---\n\n\n\n"),
    (12, 5, "> a\n>\n> b\n\n"),
    (1, 0, "{para}\n"),
)
COLUMNS = {"id": "CAST(doc_id AS VARCHAR(20))", "key": "CAST(doc_id % 50 AS VARCHAR(20))", "page": "CAST(doc_id % 30 AS VARCHAR(20))", "lang": "lang", "source": "source", "para": "para"}


def sql_text(text: str) -> str:
    """A text with {columns} as a SQL expression that both engines read alike."""
    out = []
    for piece in re.split(r"(\{[a-z]+\}|[\n\t\\'`])", text):
        if not piece:
            continue
        out.append(COLUMNS[piece[1:-1]] if piece[0] == "{" and piece[1:-1] in COLUMNS else f"chr({ord(piece)})" if piece in "\n\t\\'`" else f"'{piece}'")
    return " || ".join(out)


#: Parts as the formatter writes them, where it changes something.
FORMATTED = {
    "### **{lang}**\n\n": "### {lang}\n\n",
    "* two\n": "\n* two\n",
    "well-\nknown and short-\nand long\n\n": "well-known and short- and long\n\n",
    "---\n\n\n\n": "* * *\n\n",
    "> a\n>\n> b\n\n": "> a\n> \n> b\n\n",
}


def markdown_sql(formatted: bool = False) -> str:
    cases = []
    for divisor, remainder, text in PARTS:
        text = FORMATTED.get(text, text) if formatted else text
        sign = "<>" if divisor < 0 else "="
        cases.append(f"({sql_text(text)})" if divisor == 1 else f"CASE WHEN doc_id % {abs(divisor)} {sign} {remainder} THEN {sql_text(text)} ELSE '' END")
    return " || ".join(cases)


#: DuckDB's: md (doc_id, text) and its lines l (doc_id, line_no, line, start).
MD = (
    "src AS (SELECT doc_id, lang, source, array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '[^\\p{L} .,\n]', '', 'g'), '[.]+', '.', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10) || chr(10)) AS para FROM documents), "
    f"md AS (SELECT doc_id, {markdown_sql()} AS text FROM src), "
    "l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM md), "
    "l AS (SELECT doc_id, line_no, line, COALESCE(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM l0)"
)


def prose_of(text: Column) -> Column:
    """All words of a text without what Markdown reads as marks, with single points, each line a paragraph."""
    lines = F.transform(F.split(F.regexp_replace(F.regexp_replace(text, r"[^\p{L} .,\n]", ""), r"\.+", "."), "\n"), lambda x: F.trim(x))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n\n")


def markdown_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, text: the made-up Markdown of ``documents``, with all of their words: each line is a paragraph."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "text"), "doc_id")
    src = docs.select("doc_id", "lang", "source", prose_of(F.col("text")).alias("para"))
    return src.select("doc_id", F.concat(F.lit("doc-"), F.col("doc_id"), F.lit(".md")).alias("path"), F.expr(markdown_sql()).alias("text"))


#: (rule, divisor, remainder, text, the line that the rule finds): more Markdown, each text in documents by id.
EXTRAS = (
    ("pandoc/duplicate-identifier", 5, 0, "# A {#x1}\n\n## B {#x1}\n\n", "## B {#x1}"),
    ("structure/nested-fenced-div", 5, 1, "::: outer\n::: inner\nx\n:::\n:::\n\n", "::: inner"),
    ("structure/heading-in-fenced-div", 5, 2, "::: box\n## In div\n:::\n\n", "## In div"),
    ("structure/statement-boundary", 5, 3, "::: theorem\ns\n\n::: proof\np\n:::\n:::\n\n", "::: proof"),
    ("structure/bold-label", 5, 4, "**Question.** What is it\n\n", "**Question.** What is it"),
    ("structure/yaml-in-body", 3, 0, "notes: some words\n\n", "notes: some words"),
    ("reference/multiple-theorem-classes", 4, 0, "::: {.theorem .lemma}\nt\n:::\n\n", "::: {.theorem .lemma}"),
    ("reference/theorem-proof-class-conflict", 4, 1, "::: {.corollary .proof}\nt\n:::\n\n", "::: {.corollary .proof}"),
    ("reference/proof-id-no-target", 4, 2, "::: {.proof #prf-a}\nt\n:::\n\n", "::: {.proof #prf-a}"),
    ("reference/missing-theorem-class", 4, 3, "::: {#thm:{id}}\nt\n:::\n\n", "::: {#thm:{id}}"),
    ("reference/class-family-mismatch", 7, 0, "::: {.theorem #lem:{id}}\nt\n:::\n\n", "::: {.theorem #lem:{id}}"),
    ("numbering/manual", 6, 0, "# 1. Numbered\n\n", "# 1. Numbered"),
    ("numbering/manual", 6, 1, "Theorem 7. stands.\n\nas Theorem 7 says\n\n", "Theorem 7. stands."),
    ("numbering/manual", 6, 1, "", "as Theorem 7 says"),
    ("math/bare-operator", 7, 1, "has $sin x$ in\n\n", "has $sin x$ in"),
    ("math/set-operation-notation", 7, 2, "has $A \\cup B$ in\n\n", "has $A \\cup B$ in"),
    ("math/repeated-superscript", 7, 3, "has $a^b^c$ in\n\n", "has $a^b^c$ in"),
    ("math/unclosed-group", 7, 4, "has $a{b$ in\n\n", "has $a{b$ in"),
    ("math/unmatched-group-close", 7, 5, "has $a}b$ in\n\n", "has $a}b$ in"),
    ("math/unclosed-left", 7, 6, "has $\\left( a$ in\n\n", "has $\\left( a$ in"),
    ("math/unmatched-right", 8, 0, "has $a \\right)$ in\n\n", "has $a \\right)$ in"),
    ("math/display-economy", 8, 1, "$$z + 1$$\n\n", "$$z + 1$$"),
    ("math/structural-sequence-display", 8, 2, "has $0 \\to A \\to B \\to 0$ in\n\n", "has $0 \\to A \\to B \\to 0$ in"),
    ("math/outside-math-mode", 8, 3, "a x_0 stands\n\n", "a x_0 stands"),
    ("math/unicode-symbol", 8, 4, "as a ≤ b stands\n\n", "as a ≤ b stands"),
    ("prose/untyped-vague-claim", 8, 5, "so the map is natural now\n\n", "so the map is natural now"),
    ("prose/untyped-map-reference", 8, 6, "then the induced map is good\n\n", "then the induced map is good"),
    ("link/reference-format", 8, 7, "as lem:main says\n\n", "as lem:main says"),
    ("link/file-path", 9, 0, "see `src/a.py` there\n\n", "see `src/a.py` there"),
    ("style/no-inline-html", 9, 1, "some <b>words\n\n", "some <b>words"),
    ("table/dropped-cells", 9, 2, "| a |\n|---|\n| 1 | 2 |\n\n", "| 1 | 2 |"),
    ("table/caption-id-on-caption", 9, 3, "| a |\n|---|\n| 1 |\n\n: A table {#tbl:a}\n\n", ": A table {#tbl:a}"),
    ("tikz/fence-attributes", 9, 4, "```tikzcd wide\na\n```\n\n", "```tikzcd wide"),
    ("tikz/environment-wrapper", 9, 5, "\\begin{tikzcd}\na\n\\end{tikzcd}\n\n", "\\begin{tikzcd}"),
    ("reference/duplicate-definition", 9, 6, "[d{id}]: x\n\n[d{id}]: yy\n\n", "[d{id}]: yy"),
    ("citation/mixed-reference-types", 9, 7, "by [@one; @fig:two] there\n\n", "by [@one; @fig:two] there"),
    ("reference/missing-workspace-definition", 9, 8, "as @thm:nowhere says\n\n", "as @thm:nowhere says"),
    ("link/missing-local-target", 10, 0, "in [t](gone.md) there\n\n", "in [t](gone.md) there"),
    ("tex/missing-resource", 10, 1, "\\input{gone}\n\n", "\\input{gone}"),
    ("tex/unknown-command", 10, 2, "has $\\alpa$ in\n\n", "has $\\alpa$ in"),
    ("tex/macro-arity", 10, 3, "has $\\abs x$ in\n\n", "has $\\abs x$ in"),
    ("math/house-delimiter-macro", 10, 4, "has $\\left\\lvert x \\right\\rvert$ in\n\n", "has $\\left\\lvert x \\right\\rvert$ in"),
    ("math/user-macro-candidates", 10, 5, "has $\\mathbb{R}$ in\n\n", "has $\\mathbb{R}$ in"),
    ("math/script-macro-candidates", 10, 6, "has $V^\\vee$ in\n\n", "has $V^\\vee$ in"),
    ("math/manual-semantic-macro", 10, 7, "has $\\mathrm{sign}(x)$ in\n\n", "has $\\mathrm{sign}(x)$ in"),
    ("math/manual-cardinality", 10, 8, "has $|X|$ in\n\n", "has $|X|$ in"),
    # what the texts above break besides
    ("structure/nested-fenced-div", 5, 3, "", "::: proof"),
    ("reference/missing-workspace-definition", 9, 7, "", "by [@one; @fig:two] there"),
    ("math/user-macro-candidates", 10, 6, "", "has $V^\\vee$ in"),
    ("pandoc/unclosed-fenced-div", 12, 5, "::: endless\nlast words\n", "::: endless"),
)


def extras_sql() -> str:
    return " || ".join(f"CASE WHEN doc_id % {d} = {r} THEN {sql_text(t)} ELSE '' END" for _, d, r, t, _ in EXTRAS if t)


EXTRA_MD = (
    "src AS (SELECT doc_id, array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '[^\\p{L} .,\n]', '', 'g'), '[.]+', '.', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10) || chr(10)) AS para FROM documents), "
    f"md AS (SELECT doc_id, para || chr(10) || chr(10) || {extras_sql()} AS text FROM src), "
    "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM md)"
)


def extras_oracle(*rules: str) -> str:
    """What the rules find, by the lines they are about."""
    each = [f"SELECT doc_id, '{rule}' AS rule, CAST(line_no AS INTEGER) AS line FROM l WHERE doc_id % {d} = {r} AND line = {sql_text(mark)}" for rule, d, r, _, mark in EXTRAS if rule in rules]
    return f"WITH {EXTRA_MD} " + " UNION ALL ".join(each)


def extra_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, text: the other made-up Markdown of ``documents``, after all of their words."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    whole = docs.select("doc_id", prose_of(F.col("text")).alias("para"))
    return whole.select("doc_id", F.concat(F.lit("extra-"), F.col("doc_id"), F.lit(".md")).alias("path"), F.concat("para", F.lit("\n\n"), F.expr(extras_sql())).alias("text"))
