"""Native text functions: Column → Column, inside whole-stage code, nothing shuffled."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Abbreviations that end like a sentence does.
ABBREVIATIONS = (
    "dr", "mr", "mrs", "ms", "prof", "st", "sr", "jr", "rev", "hon", "gen", "col", "sgt", "capt", "lt", "gov", "sen", "rep", "vs", "etc", "al", "no", "vol", "fig",
    "eq", "ch", "pp", "inc", "ltd", "co", "corp", "dept", "univ", "est", "resp", "cf", "viz",
)
CLOSERS = "'\"’”)"
OPENERS = "(['\"‘“"

WORD_END = rf"(?:^|[^\p{{L}}\p{{N}}_])\p{{L}}+\p{{Ll}}(?:[.?!][{CLOSERS}]?|[{CLOSERS}][.?!]) *$"
MATH_END = rf"\$[.?!][{CLOSERS}]?\s*$"
CITATION_END = rf"\[-?@[^\[\]]*\][.?!][{CLOSERS}]?\s*$"

ROMAN = "(?=[ivxlcdm])m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})"
#: Words that begin a list item, a quote or a heading where they begin a line.
NUMERAL = rf"^(?:[0-9]+|[a-z]|{ROMAN}|#)[.)]$|^(?:[A-Z]|{ROMAN.upper()})\)$"
ENCLOSED = rf"^\((?:[0-9]+|[A-Za-z]|{ROMAN}|{ROMAN.upper()}|@[\p{{L}}\p{{N}}_-]*)\)$"
SPECIAL = r"^(?:[-*+>]|#+)$"


def normalize_whitespace(text: Column) -> Column:
    """Each run of white space as one space."""
    return F.regexp_replace(text, r"(?U)\s+", " ")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def words(text: Column) -> Column:
    """The words between white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def ends_sentence(word: Column) -> Column:
    """Whether a word ends a sentence: two letters or more, the last in lower case, with a full stop or the like,
    math or a citation with one; abbreviations don't."""
    shaped = word.rlike(WORD_END) | word.rlike(MATH_END) | word.rlike(CITATION_END)
    core = F.lower(F.regexp_replace(F.regexp_replace(word, rf"[.?!{CLOSERS}]+$", ""), rf"^[{OPENERS.replace('[', chr(92) + '[')}]+", ""))
    return shaped & ~core.isin(*ABBREVIATIONS)


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once for a row, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sentences(text: Column) -> Column:
    """The sentences of a text, white space normalised: cut after each word that ends one."""

    def ends(w: Column) -> Column:
        last = F.size(w) - 1
        return F.filter(F.transform(w, lambda x, i: F.when((i == last) | ends_sentence(x), i)), lambda i: i.isNotNull())

    def cut(w: Column, at: Column) -> Column:
        before = lambda k: F.coalesce(F.get(at, k - 1), F.lit(-1))
        return F.transform(at, lambda e, k: F.array_join(F.slice(w, before(k) + 2, e - before(k)), " "))

    return bound(words(text), lambda w: bound(ends(w), lambda at: cut(w, at)))


def escape_word(word: Column) -> Column:
    """A backslash in a word that Markdown would read as a marker where it begins a line."""
    return (
        F.when(word.rlike(NUMERAL), F.regexp_replace(word, r"(.)$", r"\\$1"))
        .when(word.rlike(ENCLOSED) | word.rlike(SPECIAL), F.concat(F.lit("\\"), word))
        .otherwise(word)
    )


def escape_line_start(line: Column) -> Column:
    """``escape_word`` on a line's first word."""
    first = F.substring_index(line, " ", 1)
    return F.concat(escape_word(first), F.substring(line, F.length(first) + 1, F.length(line)))


def semantic_lines(text: Column, initial_indent: str = "", subsequent_indent: str = "") -> Column:
    """A sentence on each line, no limit on its length; later lines can't begin with a marker. As elsewhere, later
    lines are indented only if the first one is."""
    rows = F.transform(sentences(text), lambda s, i: F.when(i == 0, s).otherwise(escape_line_start(s)))
    if initial_indent:
        rows = F.transform(rows, lambda s, i: F.concat(F.when(i == 0, initial_indent).otherwise(subsequent_indent), s))
    return F.array_join(rows, "\n")


def paragraphs(text: Column) -> Column:
    """Stripped pieces between empty lines."""
    return F.transform(F.split(text, r"\n{2,}"), strip)


def hard_break_segments(text: Column) -> Column:
    """Pieces between Markdown's hard line breaks: a backslash or two spaces at a line's end."""
    return F.split(text, r"\\\n|  \n")


def is_multi_paragraph(text: Column) -> Column:
    return text.rlike(r"(?U)\n\s*\n")


TAGS = ((r"%\}", r"\{%"), (r"#\}", r"\{#"), (r"\}\}", r"\{\{"), ("-->", "<!--"))


def spaced_tags(text: Column) -> Column:
    """A space between tags of one kind that touch. One look at a character tells most places, where no tag ends."""
    ends = "|".join(f"{close}(?={start})" for close, start in TAGS)
    return F.regexp_replace(text, rf"(?=[-%#}}])(?:{ends})", "$0 ")


def rejoined_tags(text: Column) -> Column:
    """Undo ``spaced_tags``."""
    return F.regexp_replace(text, "|".join(f"(?<={close}) (?={start})" for close, start in TAGS), "")
