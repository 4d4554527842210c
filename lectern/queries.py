"""Named queries over the tables of a folder, and the same results in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import cases
from lectern.functions import patterns, text, typography
from lectern.functions.frontmatter import split_column
from lectern.lint import fix as fixes
from lectern.lint import rules  # noqa: F401  (fills the registry)
from lectern.lint.registry import REGISTRY, Context, diagnostics
from lectern.operators import preflight, similar, wrapping
from lectern.plans import formatter, gate
from lectern.plans.model import Model, asof, lines, not_within
from lectern.rule_cases import CASES, FOUND, LEVELS, context_of
from lectern.samples import EXTRAS, MD, extra_documents, extras_oracle, markdown_documents, markdown_sql, prose_of
from lectern.sources import documents as sources
from lectern.sources.session import shared_folder, spread
from lectern.streaming import documents as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source"))


# Plain text ------------------------------------------------------------------------------------------------------

ABBREVIATED = ", ".join(f"'{a}'" for a in text.ABBREVIATIONS)
QUOTES = "''\"’”)"
ENDS = (
    f"((regexp_matches(w, '(^|[^\\p{{L}}\\p{{N}}_])\\p{{L}}+\\p{{Ll}}([.?!][{QUOTES}]?|[{QUOTES}][.?!]) *$') OR regexp_matches(w, '\\$[.?!][{QUOTES}]?\\s*$') "
    f"OR regexp_matches(w, '\\[-?@[^\\[\\]]*\\][.?!][{QUOTES}]?\\s*$')) "
    f"AND lower(ltrim(rtrim(w, '.?!''\"’”)'), '([''\"‘“')) NOT IN ({ABBREVIATED}))"
)
WORDS = "ws AS (SELECT doc_id, lang, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM documents)"
SENTENCES = (
    f"{WORDS}, w AS (SELECT doc_id, lang, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM ws), "
    f"e AS (SELECT *, CASE WHEN {ENDS} THEN 1 ELSE 0 END AS ends FROM w), "
    "n AS (SELECT *, COALESCE(sum(ends) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sid FROM e), "
    "s AS (SELECT doc_id, lang, sid, string_agg(w, ' ' ORDER BY i) AS sentence FROM n GROUP BY doc_id, lang, sid)"
)


@query(f"WITH {SENTENCES} SELECT doc_id, CAST(sid AS INTEGER) AS sid, sentence FROM s")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of every document."""
    return documents(spark, sf_dir).select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("sid", "sentence"))


@query(f"WITH {SENTENCES} SELECT lang, count(DISTINCT doc_id) AS n_docs, count(*) AS n_sentences, CAST(sum(length(sentence)) AS BIGINT) AS n_chars, max(length(sentence)) AS longest FROM s GROUP BY lang")
def sentence_stats_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of sentences; arrays are summed before anything is shuffled."""
    s = F.transform(text.sentences(F.col("text")), lambda x: F.length(x))
    each = documents(spark, sf_dir).where(F.col("text").rlike(r"(?U)\S")).select("lang", s.alias("s"))  # texts without a word have none
    total = F.aggregate("s", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return each.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(F.size("s")).alias("n_sentences"), F.sum(total).alias("n_chars"), F.max(F.array_max("s")).cast("bigint").alias("longest"))


#: Sentences of at least 15 characters: short ones are merged with what follows, from the left.
MERGED = (
    f"WITH RECURSIVE {SENTENCES}, t AS (SELECT doc_id, sid, sentence, CASE WHEN sid = (max(sid) OVER (PARTITION BY doc_id)) THEN 1 ELSE 0 END AS last FROM s), "
    "m AS (SELECT doc_id, sid, sentence, 0 AS mid FROM t WHERE sid = 0 UNION ALL "
    "SELECT t.doc_id, t.sid, CASE WHEN length(m.sentence) >= 15 THEN t.sentence ELSE m.sentence || ' ' || t.sentence END, CASE WHEN length(m.sentence) >= 15 THEN m.mid + 1 ELSE m.mid END "
    "FROM m JOIN t ON t.doc_id = m.doc_id AND t.sid = m.sid + 1), "
    "k AS (SELECT doc_id, mid, arg_max(sentence, sid) AS sentence FROM m GROUP BY doc_id, mid)"
)


@query(f"{MERGED} SELECT doc_id, CAST(mid AS INTEGER) AS sid, sentence FROM k")
def sentence_split_min15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of 15 characters or more."""
    return documents(spark, sf_dir).select("doc_id", F.posexplode(patterns.sentences_column("text")).alias("sid", "sentence"))


@query(f"{MERGED} SELECT d.doc_id, COALESCE(k.sentence, d.text) AS sentence FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id AND k.mid = 0")
def first_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sentence, or the text itself if it has none."""
    first = F.get(patterns.sentences_column("text"), F.lit(0))
    return documents(spark, sf_dir).select("doc_id", F.coalesce(first, "text").alias("sentence"))


def wrap_sql(width: int) -> str:
    return (
        f"WITH {WORDS} SELECT doc_id, list_reduce(list_transform(ws, lambda x: {{'out': x, 'col': length(x)}}), lambda a, x: CASE WHEN a.col + 1 + x.col <= {width} "
        "THEN {'out': a.out || ' ' || x.out, 'col': a.col + 1 + x.col} ELSE {'out': a.out || chr(10) || x.out, 'col': x.col} END).out AS wrapped FROM ws WHERE len(ws) > 0"
    )


@query(wrap_sql(88))
def wrap_width_88(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrapped = wrapping.wrapped_column(wrapping.by_width(88), "text")
    return documents(spark, sf_dir).where(F.size(text.words(F.col("text"))) > 0).select("doc_id", wrapped.alias("wrapped"))


@query(wrap_sql(60))
def wrap_width_60(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrapped = wrapping.wrapped_column(wrapping.by_width(60), "text")
    return documents(spark, sf_dir).where(F.size(text.words(F.col("text"))) > 0).select("doc_id", wrapped.alias("wrapped"))


ESCAPED = "CASE WHEN regexp_matches(sentence, '^([-*+>]|#+)( |$)') AND sid > 0 THEN chr(92) || sentence WHEN regexp_matches(sentence, '^([0-9]+|[a-z]|#)[.)]( |$)') AND sid > 0 THEN regexp_replace(sentence, '^([0-9]+|[a-z]|#)([.)])', '\\1' || chr(92) || chr(92) || '\\2') ELSE sentence END"


@query(f"WITH {SENTENCES} SELECT doc_id, string_agg({ESCAPED}, chr(10) ORDER BY sid) AS wrapped FROM s GROUP BY doc_id")
def semantic_wrap_nolimit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence on each line: native, nothing shuffled."""
    return documents(spark, sf_dir).where(F.size(text.words(F.col("text"))) > 0).select("doc_id", text.semantic_lines(F.col("text")).alias("wrapped"))


#: The words of a sentence filled greedily from a column on; lines follow a short line of at most 20 characters where that fits.
FILLED = (
    "list_reduce(list_transform(string_split(t.sentence, ' '), lambda x: {'out': x, 'len': length(x), 'col': CASE WHEN begun + length(x) <= 88 THEN begun + length(x) ELSE length(x) END}), "
    "lambda a, x: CASE WHEN a.col + 1 + x.len <= 88 THEN {'out': a.out || ' ' || x.out, 'len': 0, 'col': a.col + 1 + x.len} ELSE {'out': a.out || chr(10) || x.out, 'len': 0, 'col': x.len} END).out"
)
SEMANTIC = (
    f"WITH RECURSIVE {SENTENCES}, m AS (SELECT t.doc_id, t.sid, {FILLED.replace('begun +', '0 +')} AS out FROM s AS t WHERE t.sid = 0 UNION ALL SELECT doc_id, sid, out || CASE WHEN short AND last + 1 + length(string_split(new, chr(10))[1]) <= 88 THEN ' ' ELSE chr(10) END || new AS out FROM ("
    f"SELECT doc_id, sid, out, last, short, {FILLED} AS new FROM (SELECT t.doc_id, t.sid, t.sentence, m.out, length(string_split(m.out, chr(10))[-1]) AS last, length(string_split(m.out, chr(10))[-1]) < 20 AS short, "
    "CASE WHEN length(string_split(m.out, chr(10))[-1]) < 20 THEN length(string_split(m.out, chr(10))[-1]) ELSE 0 END AS begun FROM m JOIN s AS t ON t.doc_id = m.doc_id AND t.sid = m.sid + 1) AS t) AS n) "
    "SELECT d.doc_id, COALESCE(w.out, '') AS wrapped FROM documents d LEFT JOIN (SELECT doc_id, arg_max(out, sid) AS out FROM m GROUP BY doc_id) AS w ON d.doc_id = w.doc_id WHERE d.text IS NOT NULL"
)


@query(SEMANTIC)
def semantic_wrap_88(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", wrapping.wrapped_column(wrapping.by_sentence(88), "text").alias("wrapped"))


@query("SELECT doc_id, regexp_replace(text, '\\s+', ' ', 'g') AS normalized FROM documents")
def normalize_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", text.normalize_whitespace(F.col("text")).alias("normalized"))


@query("WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents), q AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS n FROM p) SELECT doc_id, CAST(n AS INTEGER) AS line_no, CAST(COALESCE(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start, CAST(length(line) AS INTEGER) AS width FROM q")
def line_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line's number, offset and length."""
    return lines(documents(spark, sf_dir)).select("doc_id", "line_no", "start", (F.col("end") - F.col("start")).cast("int").alias("width"))


@query("WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents), q AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS n FROM p) SELECT doc_id, CAST(n AS INTEGER) AS line, CAST(length(line) AS INTEGER) AS width FROM q WHERE length(line) > 400")
def long_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(documents(spark, sf_dir)).where(F.length("text") > 400).select("doc_id", F.col("line_no").alias("line"), F.length("text").alias("width"))


@query(f"WITH {MD} SELECT doc_id, CAST(i - 1 AS INTEGER) AS ord, trim(p, chr(10) || ' ') AS paragraph FROM (SELECT doc_id, unnest(x) AS p, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, regexp_split_to_array(text, chr(10) || '{{2,}}') AS x FROM md))".replace("{{", "{").replace("}}", "}"))
def split_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown_documents(spark, sf_dir).select("doc_id", F.posexplode(text.paragraphs(F.col("text"))).alias("ord", "paragraph"))


BROKEN = "CASE WHEN doc_id % 2 = 0 THEN replace(text, chr(10), '  ' || chr(10)) ELSE replace(text, chr(10), chr(92) || chr(10)) END"


@query(f"SELECT doc_id, CAST(i - 1 AS INTEGER) AS ord, seg AS segment FROM (SELECT doc_id, unnest(x) AS seg, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, regexp_split_to_array({BROKEN}, '\\\\' || chr(10) || '|  ' || chr(10)) AS x FROM documents))")
def hard_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of the texts, with two spaces or a backslash at their ends."""
    made = documents(spark, sf_dir).select("doc_id", F.expr(BROKEN.replace("chr(10)", "'\n'").replace("chr(92)", "'\\\\'")).alias("t"))
    return made.select("doc_id", F.posexplode(text.hard_break_segments(F.col("t"))).alias("ord", "segment"))


MARKERS = "CASE doc_id % 10 WHEN 0 THEN '-' WHEN 1 THEN '12.' WHEN 2 THEN '##' WHEN 3 THEN 'word' WHEN 4 THEN '(3)' WHEN 5 THEN 'b)' WHEN 6 THEN '>' WHEN 7 THEN '-x' WHEN 8 THEN 'A)' ELSE 'xiv.' END"
ROMANS = "(m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3}))"


@query(
    f"WITH {WORDS}, d AS (SELECT doc_id, list_append(ws, {MARKERS}) AS ws FROM ws), w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d) "
    f"SELECT doc_id, CAST(i - 1 AS INTEGER) AS ord, CASE WHEN regexp_matches(w, '^([0-9]+|[a-z]|#|{ROMANS})[.)]$') AND length(w) > 1 OR regexp_matches(w, '^([A-Z]|{ROMANS.upper().replace('{0,3}', '{0,3}')})\\)$') AND length(w) > 1 THEN left(w, length(w) - 1) || chr(92) || right(w, 1) "
    "WHEN regexp_matches(w, '^\\(([0-9]+|[A-Za-z]|@[\\p{L}\\p{N}_-]*)\\)$') OR regexp_matches(w, '^([-*+>]|#+)$') THEN chr(92) || w ELSE w END AS word FROM w"
)
def escape_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word of the texts, and a marker, as it may begin a line."""
    words = documents(spark, sf_dir).select("doc_id", F.array_append(text.words(F.col("text")), F.expr(MARKERS)).alias("ws"))
    return words.select("doc_id", F.posexplode(F.transform("ws", text.escape_word)).alias("ord", "word"))


PROSE = f"WITH {MD}, p AS (SELECT doc_id, regexp_replace(regexp_replace(para, '[.]+', '.', 'g'), ' +', ' ', 'g') AS t FROM src)"


def prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, t: the words of whole texts, with single points, commas and single spaces between them."""
    return documents(spark, sf_dir).select("doc_id", F.regexp_replace(F.regexp_replace(prose_of(F.col("text")), r"\.+", "."), " +", " ").alias("t"))


@query(f"{PROSE} SELECT doc_id, replace(t, ' ', '{{% a %}} {{% /a %}} <!-- x --> <!-- y -->') AS spaced FROM p".replace("{{", "{").replace("}}", "}"))
def spaced_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.replace("t", F.lit(" "), F.lit("{% a %}{% /a %} <!-- x --><!-- y -->"))
    return prose(spark, sf_dir).select("doc_id", text.spaced_tags(made).alias("spaced"))


@query(f"{PROSE} SELECT doc_id, regexp_replace(t, '([\\p{{L}}]), ?([\\p{{L}}])', '\\1 … \\2', 'g') AS typeset FROM p".replace("{{", "{").replace("}}", "}"))
def ellipses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each comma between words as three points, and those as one character."""
    return prose(spark, sf_dir).select("doc_id", F.regexp_replace("t", r"(\p{L}), ?(\p{L})", "$1...$2").alias("t")).select("doc_id", typography.ellipses_column("t").alias("typeset"))


@query(f"{PROSE} SELECT doc_id, regexp_replace(t, '(^|\\n)([\\p{{L}}]+) ([\\p{{L}}]+) ', '\\1“\\2 it’s” so ‘\\3’ ', 'g') AS typeset FROM p".replace("{{", "{").replace("}}", "}"))
def smart_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first words of each paragraph in straight quotes, and those as typographic ones."""
    quoted = F.regexp_replace("t", r"(^|\n)(\p{L}+) (\p{L}+) ", "$1\"$2 it's\" so '$3' ")
    return prose(spark, sf_dir).select("doc_id", quoted.alias("t")).select("doc_id", typography.smart_quotes_column("t").alias("typeset"))


def fill_sql(width: int, first: str = "", later: str = "") -> str:
    """Words filled greedily, the lines with indents."""
    room = width - len(later)
    start = f"'{first}' || x" if first else "x"
    return (
        f"list_reduce(list_transform(ws, lambda x: {{'out': {start}, 'col': {len(first)} + length(x)}}), lambda a, x: CASE WHEN a.col + 1 + x.col - {len(first)} <= {room} "
        f"THEN {{'out': a.out || ' ' || substr(x.out, {len(first) + 1}), 'col': a.col + 1 + x.col - {len(first)}}} ELSE {{'out': a.out || chr(10) || '{later}' || substr(x.out, {len(first) + 1}), 'col': {len(later)} + x.col - {len(first)}}} END).out"
    )


@query(
    f"WITH {WORDS}, t AS (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x: '    ' || x), chr(10)) AS indented, text FROM documents) "
    f"SELECT t.doc_id, t.text AS none, {fill_sql(72)} AS wrap, {fill_sql(72)} AS wrap_full, {fill_sql(72, '    ', '    ')} AS wrap_indent, t.indented AS indent_only, "
    f"{fill_sql(72, '', '    ')} AS hanging_indent, {fill_sql(72, '', '  ')} AS markdown_item FROM t JOIN ws ON t.doc_id = ws.doc_id"
)
def fill_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every way to fill a plain text."""
    filled = documents(spark, sf_dir).select("doc_id", wrapping.all_filled_column("text", 72).alias("f"))
    return filled.select("doc_id", "f.*")


# Spans and Markdown ---------------------------------------------------------------------------------------------


@query(
    f"{PROSE}, n AS (SELECT doc_id, length(t) - length(replace(t, '. ', ' ')) AS n FROM p), k AS (SELECT doc_id, n, unnest(['markdown_link', 'inline_code_span', 'inline_math', 'bare_url']) AS name FROM n) SELECT doc_id, name, n FROM k WHERE n > 0"
)
def atomic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constructs of the texts with a link, code, math and a URL after each sentence."""
    made = F.replace("t", F.lit(". "), F.lit(". [l m](u) `c  d` $x + y$ http://e.org/a_b "))
    found = prose(spark, sf_dir).select("doc_id", made.alias("t")).select("doc_id", F.inline(patterns.spans_column("t", patterns.INLINE_PATTERNS)))
    return found.where("is_atomic").groupBy("doc_id", "name").agg(F.count("*").alias("n"))


#: Sentences of at least 15 characters of the words of whole texts in one line, in which they follow one another.
FLAT = f"{MD.partition(', md AS')[0]}, flat AS (SELECT doc_id, lang, regexp_replace(regexp_replace(para, '[.]+', '.', 'g'), '\\s+', ' ', 'g') AS text FROM src)"
FLAT_MERGED = MERGED.replace("FROM documents", "FROM flat").replace("WITH RECURSIVE ", f"WITH RECURSIVE {FLAT}, ", 1)


@query(
    f"{FLAT_MERGED}, o AS (SELECT doc_id, sentence, COALESCE(sum(length(sentence) + 1) OVER (PARTITION BY doc_id ORDER BY mid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM k) "
    "SELECT doc_id, sentence AS text, CAST(start AS INTEGER) AS start, CAST(start + length(sentence) AS INTEGER) AS \"end\" FROM o"
)
def sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of the texts with their offsets."""
    flat = prose(spark, sf_dir).select("doc_id", F.regexp_replace("t", r"\s+", " ").alias("t"))
    return flat.select("doc_id", F.inline(patterns.sentence_spans_column("t")))


@query(
    f"WITH {MD}, x AS (SELECT doc_id, text, CASE WHEN text LIKE '---%' THEN instr(substr(text, 4), '---') + 5 ELSE 0 END AS n FROM md) "
    "SELECT doc_id, CASE WHEN n > 0 THEN left(text, n) || chr(10) ELSE '' END AS frontmatter, CASE WHEN n > 0 THEN rtrim(substr(text, n + 2), chr(10)) ELSE rtrim(text, chr(10)) END AS body FROM x"
)
def frontmatter_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = markdown_documents(spark, sf_dir).select("doc_id", split_column("text").alias("p"))
    return parts.select("doc_id", "p.frontmatter", F.regexp_replace("p.body", "\n+$", "").alias("body"))


@query(f"WITH {MD} SELECT doc_id, CAST(line_no AS INTEGER) AS line, 'rejected_math' AS \"check\" FROM l WHERE line LIKE '%$ x $%'")
def preflight_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preflight.findings(markdown_documents(spark, sf_dir)).select("doc_id", "line", "check")


def sample_model(spark: SparkSession, sf_dir: str) -> Model:
    """The model of the made-up Markdown; nodes and lines are kept, as several rules read them."""
    return Model(markdown_documents(spark, sf_dir), shared_folder(spark, "model"))


def linted(spark: SparkSession, sf_dir: str, *names: str, context: Context | None = None) -> DataFrame:
    """doc_id, rule, line of the findings of some rules."""
    model = sample_model(spark, sf_dir)
    settings = {r: ("warning" if r in names else "off") for r in REGISTRY.rules}
    return diagnostics(REGISTRY.run(model, settings, context), model).select("doc_id", "rule", "line")


HEADINGS = "h AS (SELECT doc_id, line_no, length(regexp_extract(line, '^(#+) ', 1)) AS level, replace(regexp_replace(line, '^#+ ', ''), '**', '') AS title FROM l WHERE regexp_matches(line, '^#{1,6} '))"
LINE = "CAST(line_no AS INTEGER) AS line"


@query(f"WITH {MD}, {HEADINGS} SELECT doc_id, CAST(level AS INTEGER) AS level, title, {LINE} FROM h")
def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings with their lines: a map, as the reader knows both."""
    return Model(markdown_documents(spark, sf_dir)).headings.select("doc_id", "level", F.col("text").alias("title"), "line")


@query(
    f"WITH {MD}, {HEADINGS} SELECT doc_id, 'heading/increment' AS rule, {LINE} FROM (SELECT *, lag(level) OVER (PARTITION BY doc_id ORDER BY line_no) AS b FROM h) WHERE level > b + 1 UNION ALL "
    f"SELECT doc_id, 'heading/duplicate', {LINE} FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(title) ORDER BY line_no) AS n FROM h) WHERE n > 1 UNION ALL "
    f"SELECT doc_id, 'heading/multiple-h1', {LINE} FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS n FROM h WHERE level = 1) WHERE n > 1 UNION ALL "
    f"SELECT doc_id, 'style/heading-punctuation', {LINE} FROM h WHERE regexp_matches(title, '[.,;:!?]$')"
)
def heading_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linted(spark, sf_dir, "heading/increment", "heading/duplicate", "heading/multiple-h1", "style/heading-punctuation")


@query(f"WITH {MD}, {HEADINGS} SELECT doc_id, 'style/required-h1' AS rule, 1 AS line FROM md WHERE doc_id NOT IN (SELECT doc_id FROM h WHERE level = 1)")
def required_h1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linted(spark, sf_dir, "style/required-h1")


@query(f"WITH {MD} SELECT doc_id, 'style/unordered-list-marker' AS rule, {LINE} FROM l WHERE line = '* two'")
def list_marker_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linted(spark, sf_dir, "style/unordered-list-marker")


FENCES = "f AS (SELECT doc_id, line_no, line, left(line, 1) AS marker, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS n FROM l WHERE line LIKE '```%' OR line LIKE '~~~%')"


@query(
    f"WITH {MD}, {FENCES} SELECT doc_id, 'style/fence-marker' AS rule, {LINE} FROM (SELECT *, first_value(marker) OVER (PARTITION BY doc_id ORDER BY line_no) AS m FROM f) WHERE n % 2 = 1 AND marker <> m UNION ALL "
    f"SELECT doc_id, 'code/missing-language', {LINE} FROM f WHERE n % 2 = 1 AND length(line) = 3 UNION ALL "
    f"SELECT doc_id, 'code/hard-tab', {LINE} FROM l WHERE line LIKE chr(9) || '%'"
)
def fence_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linted(spark, sf_dir, "style/fence-marker", "code/missing-language", "code/hard-tab")


@query(
    f"WITH {MD} SELECT doc_id, 'accessibility/image-alt' AS rule, {LINE} FROM l WHERE line = '![](img.png)' UNION ALL SELECT doc_id, 'link/empty-destination', {LINE} FROM l WHERE line = '[gone]()' UNION ALL "
    f"SELECT doc_id, 'link/non-descriptive-text', {LINE} FROM l WHERE line LIKE '%[here](%'"
)
def link_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linted(spark, sf_dir, "accessibility/image-alt", "link/empty-destination", "link/non-descriptive-text")


@query(f"WITH {MD} SELECT doc_id, kind, text, url, {LINE} FROM (SELECT doc_id, line_no, 'link' AS kind, 'text' AS text, regexp_extract(line, '#([a-z]+)', 1) AS url FROM l WHERE line LIKE 'See [text]%' UNION ALL SELECT doc_id, line_no, 'link', 'here', 'nope' FROM l WHERE line LIKE '%[here](#nope)%')")
def fragment_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links to fragments in order, each with its line."""
    links = Model(markdown_documents(spark, sf_dir)).links.where("kind = 'link' AND url LIKE '#%'")
    return links.select("doc_id", "kind", "text", F.expr("substring(url, 2)").alias("url"), "line")


@query(
    f"WITH {MD}, {HEADINGS}, ids AS (SELECT DISTINCT doc_id, lower(title) AS id FROM h), u AS (SELECT doc_id, line_no, unnest(regexp_extract_all(line, '\\(#([a-z]+)\\)', 1)) AS id FROM l) "
    f"SELECT u.doc_id, 'link/invalid-fragment' AS rule, {LINE} FROM u ANTI JOIN ids ON u.doc_id = ids.doc_id AND u.id = ids.id"
)
def invalid_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anti-join of links with identifiers."""
    return linted(spark, sf_dir, "link/invalid-fragment")


@query(
    f"WITH {MD}, d AS (SELECT doc_id, line_no, regexp_extract(line, '^\\[\\^([a-z]+)\\]:', 1) AS id FROM l WHERE line LIKE '[^%'), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, id ORDER BY line_no) AS k FROM d), "
    "u AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(line, '[A-Za-z]\\[\\^([a-z]+)\\]', 1)) AS id FROM l) "
    f"SELECT doc_id, 'footnote/duplicate-definition' AS rule, {LINE} FROM n WHERE k > 1 UNION ALL SELECT n.doc_id, 'footnote/unused-definition', {LINE} FROM n ANTI JOIN u ON n.doc_id = u.doc_id AND n.id = u.id WHERE k = 1"
)
def footnote_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linted(spark, sf_dir, "footnote/duplicate-definition", "footnote/unused-definition")


@query(f"WITH {MD} SELECT doc_id, 'citation/missing-bibliography-entry' AS rule, {LINE} FROM l WHERE line LIKE 'By [@key%' AND doc_id % 50 >= 40")
def missing_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anti-join of citations with a bibliography."""
    keys = spark.range(40).select(F.concat(F.lit("key"), F.col("id")).alias("key"))
    return linted(spark, sf_dir, "citation/missing-bibliography-entry", context=Context({"bibliography": keys}))


@query(f"WITH {MD} SELECT doc_id, CASE WHEN doc_id % 30 >= 25 THEN 'link/missing-wikilink-target' ELSE 'link/ambiguous-wikilink' END AS rule, {LINE} FROM l WHERE line LIKE '[[Page%' AND doc_id % 30 >= 20")
def wikilink_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Join of wikilinks with what they resolve to."""
    status = F.when(F.col("id") >= 25, "missing").when(F.col("id") >= 20, "ambiguous").otherwise("resolved")
    pages = spark.range(30).select(F.concat(F.lit("Page"), F.col("id")).alias("name"), status.alias("status"), F.lit(False).alias("relative"), F.lit(None).cast("string").alias("canonical"), F.array(F.lit("A"), F.lit("B")).alias("candidates"))
    return linted(spark, sf_dir, "link/missing-wikilink-target", "link/ambiguous-wikilink", "link/relative-wikilink", context=Context({"wikilinks": pages}))


@query(f"WITH {MD} SELECT doc_id, 'style/bare-url' AS rule, {LINE} FROM l WHERE line LIKE 'Visit http%' UNION ALL SELECT doc_id, 'document/authorial-residue', {LINE} FROM l WHERE line LIKE 'TODO %'")
def prose_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linted(spark, sf_dir, "style/bare-url", "document/authorial-residue")


@query(
    f"WITH {MD} SELECT doc_id, 'math/repeated-subscript' AS rule, {LINE} FROM l WHERE line LIKE '%$x_a_b$%' UNION ALL SELECT doc_id, 'math/subset-notation', {LINE} FROM l WHERE line LIKE '%subset%' UNION ALL "
    f"SELECT doc_id, 'math/notation-consistency', {LINE} FROM l WHERE line LIKE 'Now $%'"
)
def math_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linted(spark, sf_dir, "math/repeated-subscript", "math/subset-notation", "math/notation-consistency", "math/unclosed-group")


@query(f"WITH {MD} SELECT doc_id, 'frontmatter/duplicate-key' AS rule, {LINE} FROM l WHERE line = 'title: U'")
def frontmatter_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linted(spark, sf_dir, "frontmatter/duplicate-key", "frontmatter/malformed-flow")


@query(f"WITH {MD}, {HEADINGS} SELECT l.doc_id, CAST(l.line_no AS INTEGER) AS line, h.title FROM l ASOF LEFT JOIN h ON l.doc_id = h.doc_id AND l.line_no >= h.line_no")
def section_of_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of join: the heading that each line stands under."""
    model = sample_model(spark, sf_dir)
    points = model.lines.select("doc_id", F.col("start").alias("at"), F.col("line_no").alias("line"))
    return asof(points, model.headings.select("doc_id", "start", F.col("text").alias("title")), ["title"]).select("doc_id", "line", "title")


@query(
    f"WITH {MD}, {FENCES}, r AS (SELECT a.doc_id, a.line_no AS s, b.line_no AS e FROM f a JOIN f b ON a.doc_id = b.doc_id AND b.n = a.n + 1 WHERE a.n % 2 = 1) "
    f"SELECT doc_id, {LINE} FROM l WHERE length(line) > 0 AND NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = l.doc_id AND l.line_no BETWEEN r.s AND r.e)"
)
def lines_outside_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range anti-join of lines with fenced code."""
    model = sample_model(spark, sf_dir).narrowed(["code_block"])
    return not_within(model.lines.where("end > start").select("doc_id", "start", "end", "line_no"), model.fences.select("doc_id", "start", "end")).select("doc_id", F.col("line_no").alias("line"))


@query(f"WITH {MD}, r AS (SELECT doc_id, 'heading/multiple-h1' AS rule FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS n FROM l WHERE line LIKE '# %') WHERE n > 1 UNION ALL SELECT doc_id, 'link/non-descriptive-text' FROM l WHERE line LIKE '%[here](%') SELECT rule, severity, count(*) AS n FROM (SELECT rule, CASE rule WHEN 'heading/multiple-h1' THEN 'error' ELSE 'warning' END AS severity FROM r) GROUP BY ROLLUP (rule, severity)")
def findings_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by rule and severity, with totals; one level is overridden by a setting."""
    settings = {r: "off" for r in REGISTRY.rules} | {"heading/multiple-h1": "error", "link/non-descriptive-text": "warning"}
    return fixes.rollup(REGISTRY.run(sample_model(spark, sf_dir), settings))


#: Queries whose rules are all that find something in the made-up Markdown by default, besides some that are off by default.
ON_BY_DEFAULT = ("heading_findings", "fence_findings", "link_findings", "invalid_fragments", "footnote_findings", "prose_findings", "math_findings", "frontmatter_findings")
SEVERITIES = "(VALUES " + ", ".join(f"('{name}', '{level}')" for name, level in LEVELS) + ") AS s(rule, severity)"


@query("SELECT doc_id, f.rule, severity, line FROM (" + " UNION ALL ".join(f"SELECT doc_id, rule, line FROM ({ORACLE_SQL[n]})" for n in ON_BY_DEFAULT) + f") AS f JOIN {SEVERITIES} ON f.rule = s.rule WHERE severity <> 'off'")
def lint_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule that is on by default, with lines."""
    model = sample_model(spark, sf_dir)
    return diagnostics(REGISTRY.run(model), model).select("doc_id", "rule", "severity", "line")


@query("SELECT * FROM (VALUES " + ", ".join(f"('{name}', '{level}')" for name, level in LEVELS) + ") AS t(name, level)")
def rule_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return REGISTRY.table(spark).select("name", "level")


def case_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each rule what it finds in a text that breaks it, and nothing in one that doesn't: place, message, fix, suggestions."""
    rows = [(2 * k + j, c[1] if j == 0 else c[3]) for k, c in enumerate(CASES) for j in (0, 1)]
    model = Model(spread(spark.createDataFrame(rows, "doc_id long, text string")), shared_folder(spark, "model"))
    about = spark.createDataFrame([(2 * k + j, c[0]) for k, c in enumerate(CASES) for j in (0, 1)], "doc_id long, rule string")
    found = diagnostics(REGISTRY.run(model, {r: "warning" for r in REGISTRY.rules}, context_of(spark)), model).join(about, ["doc_id", "rule"])
    place = F.format_string("%d:%d-%d:%d", "line", "column", "end_line", "end_column")
    better = F.array_join(F.transform("suggestions", lambda s: s["replacement"]), "|")
    return found.select("rule", place.alias("place"), "message", F.coalesce("fix.replacement", F.lit("")).alias("fix"), better.alias("suggestions"))


QUERIES["rule_cases"] = case_findings
ORACLE_SQL["rule_cases"] = "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(cases.quoted, f)) + ")" for f in FOUND) + ") AS t(rule, place, message, fix, suggestions)"


@query(f"WITH {MD} SELECT doc_id, regexp_replace(replace(text, chr(10) || '* two', chr(10) || '- two'), 'Visit (http://ex.org/[0-9]+)', 'Visit <\\1>') AS text FROM md")
def fix_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rules' fixes, until none is left."""
    settings = {r: "off" for r in REGISTRY.rules} | {"style/unordered-list-marker": "warning", "style/bare-url": "warning"}
    return fixes.fix(markdown_documents(spark, sf_dir), REGISTRY, settings, folder=shared_folder(spark, "fix")).select("doc_id", "text")


@query(f"WITH {MD} SELECT doc_id, 'doc-' || doc_id || '.md:' || line_no || ':1: warning accessibility/image-alt: the image has no text' AS report FROM l WHERE line = '![](img.png)'")
def lint_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = sample_model(spark, sf_dir)
    settings = {r: ("warning" if r == "accessibility/image-alt" else "off") for r in REGISTRY.rules}
    return fixes.report_text(diagnostics(REGISTRY.run(model, settings), model), model.documents.select("doc_id", "path")).select("doc_id", "report")


@query(
    f"WITH {MD}, f AS (SELECT doc_id, 'accessibility/image-alt' AS rule, line_no, 1 AS first, 'the image has no text' AS message, NULL AS fix FROM l WHERE line = '![](img.png)' UNION ALL "
    "SELECT doc_id, 'style/bare-url', line_no, 7, 'a bare URL', '<http://ex.org/' || doc_id || '>' FROM l WHERE line LIKE 'Visit http%') "
    "SELECT 'doc-' || doc_id || '.md' AS path, 1 AS version, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS INTEGER) AS nth, rule, CAST(line_no AS INTEGER) AS line, first AS \"column\", message, fix FROM f"
)
def lint_report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reports as JSON, read again."""
    model = sample_model(spark, sf_dir)
    settings = {r: ("warning" if r in ("accessibility/image-alt", "style/bare-url") else "off") for r in REGISTRY.rules}
    made = fixes.report_json(diagnostics(REGISTRY.run(model, settings), model), model.documents.select("doc_id", "path"))
    read = F.from_json("report", "version int, path string, diagnostics array<struct<rule:string,line:int,column:int,message:string,fix:struct<replacement:string>>>")
    rows = made.select(read.alias("r")).select("r.path", "r.version", F.posexplode("r.diagnostics").alias("nth", "d"))
    return rows.select("path", "version", "nth", "d.rule", "d.line", "d.column", "d.message", F.col("d.fix.replacement").alias("fix"))


@query(
    "WITH v AS (SELECT DISTINCT n_name AS c FROM nation), w AS (SELECT DISTINCT substr(n_name, 2) AS name FROM nation), "
    "p AS (SELECT name, c, damerau_levenshtein(name, c) AS d FROM w JOIN v ON name <> c AND damerau_levenshtein(name, c) <= greatest(length(name), 3) // 3), b AS (SELECT *, min(d) OVER (PARTITION BY name) AS m FROM p), "
    "r AS (SELECT name, c, d, row_number() OVER (PARTITION BY name ORDER BY (list_sort(string_split(name, '')) = list_sort(string_split(c, ''))) DESC, (length(name) = length(c)) DESC, c) AS rank FROM b WHERE d = m) "
    "SELECT name, c AS candidate, CAST(d AS INTEGER) AS distance, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3"
)
def similar_names_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fuzzy join: nations' names without their first letter, and the names."""
    names = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("name")).distinct()
    return similar.similar_names(names.select(F.expr("substring(name, 2)").alias("name")), names)


@query(
    "WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS package, 'r' || n_regionkey AS include FROM nation UNION ALL SELECT 'r' || r_regionkey, 'r' || (r_regionkey + 1) % 5 FROM region), "
    "c AS (SELECT DISTINCT package, package AS member FROM e UNION SELECT c.package, e.include FROM c JOIN e ON c.member = e.package) SELECT package, member FROM c"
)
def package_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitive includes, with a cycle among them."""
    nation, region = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    label = lambda letter, c: F.concat(F.lit(letter), c.cast("string"))
    edges = nation.select(label("n", F.col("n_nationkey")).alias("package"), label("r", F.col("n_regionkey")).alias("include"))
    edges = edges.unionByName(region.select(label("r", F.col("r_regionkey")).alias("package"), label("r", (F.col("r_regionkey") + 1) % 5).alias("include")))
    return similar.package_closure(edges, edges.select("package").distinct())


def extra_context(spark: SparkSession) -> Context:
    make = spark.createDataFrame
    words = "sin cup left right to lvert rvert mathbb vee mathrm abs alpha".split()
    return Context(
        {
            "files": make([("there.md",)], "path string"),
            "vocabulary": make([("", w) for w in words], "package string, command string"),
            "macros": make([("abs", "\\left\\lvert #1 \\right\\rvert", 1, False), ("R", "\\mathbb{R}", 0, False), ("dual", "#1^\\vee", 1, False), ("signature", "", 1, False), ("cardinality", "", 1, False)], "name string, replacement string, argument_count int, optional_first boolean"),
        }
    )


def extra_query(name: str, *names: str) -> None:
    """A query that runs some rules over the other made-up Markdown."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        model = Model(extra_documents(spark, sf_dir), shared_folder(spark, "model"))
        settings = {r: ("warning" if r in names else "off") for r in REGISTRY.rules}
        return diagnostics(REGISTRY.run(model, settings, extra_context(spark)), model).select("doc_id", "rule", "line")

    QUERIES[name], ORACLE_SQL[name] = run, extras_oracle(*names)


def of_group(*prefixes: str) -> list[str]:
    return sorted({r for r, *_ in EXTRAS if r.startswith(prefixes)})


extra_query("structure_findings", *of_group("structure/"), "pandoc/duplicate-identifier", "pandoc/unclosed-fenced-div")
extra_query("reference_findings", *of_group("reference/"), "citation/mixed-reference-types")
extra_query("numbering_findings", "numbering/manual")
extra_query("formula_findings", "math/bare-operator", "math/set-operation-notation", "math/repeated-superscript", "math/unclosed-group", "math/unmatched-group-close", "math/unclosed-left", "math/unmatched-right", "math/display-economy", "math/structural-sequence-display")
extra_query("text_findings", "math/outside-math-mode", "math/unicode-symbol", *of_group("prose/"), "link/reference-format", "link/file-path", "style/no-inline-html", "tikz/environment-wrapper")
extra_query("table_and_fence_findings", *of_group("table/"), "tikz/fence-attributes")
extra_query("resource_findings", "link/missing-local-target", "tex/missing-resource", "tex/unknown-command")
extra_query("macro_findings", "tex/macro-arity", "math/house-delimiter-macro", "math/user-macro-candidates", "math/script-macro-candidates", "math/manual-semantic-macro", "math/manual-cardinality")


# Formatter ---------------------------------------------------------------------------------------------------------


def passed(step: Callable[[str], str]) -> Column:
    from lectern.functions.arrow import udf_of

    return udf_of(step, "string")("text")


@query(f"WITH {MD} SELECT doc_id, regexp_replace(text, '### \\*\\*([a-z]+)\\*\\*', '### \\1') AS text FROM md")
def unbold_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown_documents(spark, sf_dir).select("doc_id", passed(formatter.unbold_headings).alias("text"))


@query(f"WITH {MD} SELECT doc_id, replace(text, 'well-' || chr(10) || 'known', 'well-known') AS text FROM md")
def hyphen_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown_documents(spark, sf_dir).select("doc_id", passed(lambda t: formatter.join_hyphens(t)[0]).alias("text"))


@query(f"WITH {MD} SELECT doc_id, regexp_replace(text, chr(10) || '---' || chr(10) || chr(10) || chr(10), chr(10) || '* * *' || chr(10) || chr(10) || chr(10)) AS text FROM md")
def rule_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown_documents(spark, sf_dir).select("doc_id", passed(formatter.same_rules).alias("text"))


@query(f"WITH {MD} SELECT doc_id, regexp_replace(text, chr(10) || chr(10) || chr(10) || '+', chr(10) || chr(10), 'g') AS text FROM md")
def blank_gap_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown_documents(spark, sf_dir).select("doc_id", passed(formatter.close_gaps).alias("text"))


@query(f"WITH {MD} SELECT doc_id, replace(text, '> a' || chr(10) || '>' || chr(10), '> a' || chr(10) || '> ' || chr(10)) AS text FROM md")
def quote_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown_documents(spark, sf_dir).select("doc_id", passed(formatter.quote_blanks).alias("text"))


@query(f"WITH {MD} SELECT CASE WHEN regexp_matches(text, 'Not \\$ x \\$') THEN 'refused' ELSE 'ok' END AS status, count(*) AS n FROM md GROUP BY 1")
def format_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents are formatted, and how many refused."""
    made = formatter.reformat_documents(markdown_documents(spark, sf_dir), formatter.AUTO)
    return made.groupBy(F.when(F.col("status") == "refused", "refused").otherwise("ok").alias("status")).agg(F.count("*").alias("n"))


#: Paragraphs with a sentence on each line, by documents; then all parts as they are to be.
PARAGRAPHS = (
    f"WITH {MD}, ps AS (SELECT doc_id, unnest(x) AS text, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, string_split(para, chr(10) || chr(10)) AS x FROM src)), paras AS (SELECT doc_id * 1000000 + i AS doc_id, '' AS lang, text FROM ps), "
    f"{SENTENCES.replace('FROM documents', 'FROM paras')}, wrapped AS (SELECT doc_id, string_agg({ESCAPED}, chr(10) ORDER BY sid) AS text FROM s GROUP BY doc_id), "
    "whole AS (SELECT doc_id // 1000000 AS doc_id, string_agg(text, chr(10) || chr(10) ORDER BY doc_id) AS para FROM wrapped GROUP BY 1), "
    f"made AS (SELECT doc_id, rtrim({markdown_sql(True)}, chr(10)) || chr(10) AS text FROM (SELECT s.doc_id, lang, source, COALESCE(w.para, '') AS para FROM src AS s LEFT JOIN whole AS w ON s.doc_id = w.doc_id))"
)


@query(
    f"{PARAGRAPHS} SELECT md.doc_id, CASE WHEN md.text LIKE '%Not $ x $ math%' THEN 'refused' WHEN md.text = made.text THEN 'unchanged' ELSE 'ok' END AS status, "
    "CASE WHEN md.text LIKE '%Not $ x $ math%' THEN md.text ELSE made.text END AS formatted FROM md JOIN made ON md.doc_id = made.doc_id"
)
def full_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All passes over whole texts, each checked by the gate."""
    return formatter.reformat_documents(markdown_documents(spark, sf_dir), formatter.AUTO).select("doc_id", "status", "formatted")


@query(f"WITH {MD} SELECT doc_id, true AS same_ok, false AS other_ok FROM md")
def meaning_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text means what it means; with a word more it doesn't."""
    docs = markdown_documents(spark, sf_dir).withColumn("other", F.concat("text", F.lit("\n\nMore.\n")))
    return docs.select("doc_id", gate.check_column(F.col("text"), F.col("text")).alias("a"), gate.check_column(F.col("text"), F.col("other")).alias("b")).select("doc_id", F.col("a.ok").alias("same_ok"), F.col("b.ok").alias("other_ok"))


@query(f"WITH {MD} SELECT kind, count(*) AS n FROM (SELECT 'heading' AS kind FROM l WHERE regexp_matches(line, '^#{{1,6}} ') UNION ALL SELECT 'item' FROM l WHERE line IN ('- one', '* two') UNION ALL SELECT 'wikilink' FROM l WHERE line LIKE '[[Page%' UNION ALL SELECT 'note_definition' FROM l WHERE line LIKE '[^%') GROUP BY kind")
def node_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of some kinds that the reader finds."""
    kinds = ("heading", "item", "wikilink", "note_definition")
    return Model(markdown_documents(spark, sf_dir)).of(*kinds).groupBy("kind").agg(F.count("*").alias("n"))


# Files, differences, figures ---------------------------------------------------------------------------------------------


@query(f"WITH {MD} SELECT 'doc-' || doc_id || '.md' AS name, text FROM md")
def file_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Markdown written to files, a document each, and the folder read again; what isn't Markdown is left out."""
    folder = shared_folder(spark, "files")
    docs = markdown_documents(spark, sf_dir).select(F.concat(F.lit(f"{folder}/"), "path").alias("path"), "text", F.lit(None).cast("string").alias("before"))
    other = docs.limit(3).withColumn("path", F.concat("path", F.lit(".txt")))
    sources.write_files(docs.unionByName(other), None).where("error IS NOT NULL").select(F.raise_error("error")).count()
    return sources.texts(spark, folder).select(F.substring_index("path", "/", -1).alias("name"), "text")


@query(
    f"WITH {MD}, a AS (SELECT doc_id, line_no, line FROM l), b AS (SELECT doc_id, line_no, CASE WHEN line = '- one' THEN '- two' ELSE line END AS line FROM l WHERE NOT (doc_id % 4 = 0 AND line_no = 1)), "
    "d AS (SELECT COALESCE(a.doc_id, b.doc_id) AS doc_id, COALESCE(a.line_no, b.line_no) AS line_no FROM a FULL OUTER JOIN b ON a.doc_id = b.doc_id AND a.line_no = b.line_no WHERE a.line IS DISTINCT FROM b.line) "
    "SELECT doc_id, CAST(min(line_no) AS INTEGER) AS line FROM d GROUP BY doc_id"
)
def first_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full outer join of the lines of two versions: the first that differs, or that one of them lacks."""
    old = lines(markdown_documents(spark, sf_dir)).select("doc_id", "line_no", F.col("text").alias("old"))
    new = old.where(~((F.col("doc_id") % 4 == 0) & (F.col("line_no") == 1))).select("doc_id", "line_no", F.when(F.col("old") == "- one", "- two").otherwise(F.col("old")).alias("new"))
    both = old.join(new, ["doc_id", "line_no"], "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    return both.groupBy("doc_id").agg(F.min("line_no").alias("line"))


@query("SELECT lang, avg(n) AS mean, median(n) AS median, min(n) AS least, max(n) AS most, round(stddev_samp(n), 6) AS deviation FROM (SELECT lang, CAST(length(text) AS DOUBLE) AS n FROM documents) GROUP BY lang")
def length_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, exact median, extremes and deviation of the texts' lengths."""
    sizes = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", F.length("text").cast("double").alias("n"))
    return sizes.groupBy("lang").agg(F.avg("n").alias("mean"), F.median("n").alias("median"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.stddev_samp("n"), 6).alias("deviation"))


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY CUBE (lang, source)")
def documents_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cube("lang", "source").agg(F.count("*").alias("n"))


@query("SELECT w FROM (SELECT unnest(regexp_split_to_array(text, '\\s+')) AS w FROM benchmark) INTERSECT SELECT w FROM (SELECT unnest(regexp_split_to_array(text, '\\s+')) AS w FROM conversations) EXCEPT SELECT w FROM (SELECT unnest(regexp_split_to_array(html, '\\s+')) AS w FROM pages)")
def words_in_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersect and except: words of the benchmark and of conversations that no page has."""
    words = lambda table, c: spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.explode(F.split(c, r"(?U)\s+")).alias("w"))
    return words("benchmark", "text").intersect(words("conversations", "text")).exceptAll(words("pages", "html").distinct()).distinct()


@query("SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS protocol, regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path, NULLIF(regexp_extract(url, '\\?([^#]*)', 1), '') AS query FROM pages")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL functions."""
    part = lambda p: F.try_parse_url("url", F.lit(p)).alias(p.lower())
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", *map(part, ("PROTOCOL", "HOST", "PATH", "QUERY")))


def windowed(spark: SparkSession, sf_dir: str, slide: str | None) -> DataFrame:
    """Events as documents whose text is a sentence, in windows of an hour."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", F.lit("It is so. And so it is.").alias("text"))
    found = streams.counts_by_window(events, "ts", "1 hour", "10 minutes", slide)
    return found.select(F.unix_timestamp("window.start").alias("begin"), "documents", "sentences")


@query("SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS \"begin\", count(*) AS documents, 2 * count(*) AS sentences FROM events GROUP BY 1")
def counts_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows one after the other: the plan that a stream has, over a table."""
    return windowed(spark, sf_dir, None)


@query("SELECT CAST(epoch(time_bucket(INTERVAL 20 MINUTE, ts)) AS BIGINT) - k * 1200 AS \"begin\", count(*) AS documents, 2 * count(*) AS sentences FROM events, (VALUES (0), (1), (2)) AS s(k) GROUP BY 1")
def counts_by_sliding_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that overlap: a new one every twenty minutes."""
    return windowed(spark, sf_dir, "20 minutes")


@query(
    "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 DAY THEN 0 ELSE 1 END AS opens FROM events), s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) "
    "SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS \"begin\", CAST(floor(epoch(max(ts))) AS BIGINT) + 86400 AS \"end\", count(*) AS n FROM s GROUP BY user_id, k"
)
def counts_by_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users: a day without an event ends one."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    found = streams.counts_by_session(events, "ts", "user_id", "1 day")
    return found.select("user_id", F.unix_timestamp("window.start").alias("begin"), F.unix_timestamp("window.end").alias("end"), "n")


QUERIES.update(cases.QUERIES)
ORACLE_SQL.update(cases.ORACLE_SQL)
