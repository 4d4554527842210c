"""Ellipses and typographic quotes: callbacks and state over characters, so Arrow UDFs."""

from __future__ import annotations

import re
from bisect import bisect_left

from pyspark.sql import Column

from lectern.functions.arrow import udf_of
from lectern.functions.patterns import TEMPLATE_TAG

_DOTS = re.compile(r"(^|[\w\"'“‘])(\s*)\.\.\.([.,:;?!)\-—\"'”’]?)(\s*)", re.M)


def ellipses(text: str) -> str:
    """Three points as one character, where a word, a line's begin or a quote stands before and a word or the end
    of the text after; a space on either side that touches a word."""

    def one(m: re.Match) -> str:
        before, gap, mark, after = m.groups()
        following = text[m.end() : m.end() + 1]
        is_word = bool(re.match(r"\w", following))
        if following and not is_word and following != "\n":
            return m[0]
        if not gap and re.match(r"\w", before):
            gap = " "
        if is_word and not after and not mark:
            after = " "
        return f"{before}{gap}…{mark}{after}"

    return _DOTS.sub(one, text)


# Where a quotation may stand, and words that begin with an elision.
_QUOTED = re.compile(r"(^|\s|—|~~)(?:\"([^\"“”]*)\"|'([^'‘’]*)')(\s|$|\.|,|;|:|\?|!|—|\)|~~)", re.M)
_OPENER = re.compile(r"(?:^|[\s—])(['\"])(?=\S)", re.M)
_ELISION = re.compile(r"(^|\s)'(?=\d|(?:til|em|tis|twas|cause|bout|round|n)\b)", re.M)
_PARAGRAPH = re.compile(r"\n\s*\n")


def _curl_pairs(text: str) -> str:
    """Quotations of one paragraph, unless a straight mark of their kind stands open before them."""
    out = list(text)
    for mark, left, right in (('"', "“", "”"), ("'", "‘", "’")):
        left_open = [m.start(1) for m in _OPENER.finditer(text) if m[1] == mark]
        done: set[int] = set()
        for m in _QUOTED.finditer(text):
            inner = m[2] if mark == '"' else m[3]
            if inner is None or _PARAGRAPH.search(inner):
                continue
            first, last = m.start() + len(m[1]), m.end() - len(m[4]) - 1
            if any(p not in done for p in left_open[: bisect_left(left_open, first)]):
                continue
            done |= {first, last}
            out[first], out[last] = left, right
    return "".join(out)


def _curl_apostrophes(text: str) -> str:
    """Apostrophes inside words, and after an s where no quotation can end there."""
    first_open = next((m.start(1) for m in _OPENER.finditer(text) if m[1] == "'"), len(text))
    out, at = [], 0
    for m in re.finditer(r"\S+", text):
        word = m[0]
        if word.count("'") == 1:
            if re.search(r"\w'\w", word) or re.fullmatch(r"\w*[sS]'", word) and first_open >= m.end() - 1:
                out += [text[at : m.start()], word.replace("'", "’")]
                at = m.end()
    return "".join([*out, text[at:]])


def _curl(text: str) -> str:
    text = _curl_apostrophes(_curl_pairs(text))
    last_closer = max((m.start() for m in re.finditer(r"(?<=\S)'", text)), default=-1)
    return _ELISION.sub(lambda m: m[0] if last_closer > m.end() else m[1] + "’", text)


def smart_quotes(text: str) -> str:
    """Straight quotes as typographic ones where that is safe; the length stays. Template tags are left alone."""
    out, at = [], 0
    for m in TEMPLATE_TAG.finditer(text):
        out += [_curl(text[at : m.start()]), m[0]]
        at = m.end()
    return "".join([*out, _curl(text[at:])])


def ellipses_column(text: Column | str) -> Column:
    return udf_of(ellipses, "string")(text)


def smart_quotes_column(text: Column | str) -> Column:
    return udf_of(smart_quotes, "string")(text)
