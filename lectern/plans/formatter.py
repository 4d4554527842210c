"""The formatter: passes of source edits, each decided on the nodes of the text before it.

A pass is a function from text to text: it reads the document, collects edits (start, end, replacement) and applies
them from the end. Edits shift offsets, so the passes of one document run in one Arrow UDF call; documents are
independent of each other, and one that can't be formatted safely is reported, never raised.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.arrow import udf_of
from lectern.functions.frontmatter import split_frontmatter
from lectern.functions.typography import ellipses, smart_quotes
from lectern.operators.preflight import rejected_math, unclosed_fences
from lectern.operators.wrapping import Fill, Wrapper, by_sentence, escape_word, fill_text, is_tag_line, markdown_by_sentence, markdown_by_width, with_hard_breaks
from lectern.plans import gate
from lectern.plans.reader import Node, cell_ranges, parsed

Edit = tuple[int, int, str]
PASSES = ("cleanups", "smartquotes", "ellipses")
SPACINGS = ("preserve", "loose", "tight")
LITERAL = ("code_block", "raw_block", "frontmatter", "grid_table", "line_block", "column_table", "definition_list")


@dataclass(frozen=True)
class Options:
    """wrap: plain, width or semantic; width 0 or less: lines as they are (width), or no limit (semantic)."""

    wrap: str = "width"
    width: int = 88
    passes: frozenset[str] = field(default_factory=frozenset)
    list_spacing: str = "loose"

    def __post_init__(self) -> None:
        if self.wrap not in ("plain", "width", "semantic") or not self.passes <= set(PASSES) or self.list_spacing not in SPACINGS:
            raise ValueError(f"not options of the formatter: {self}")


AUTO = Options("semantic", 0, frozenset(PASSES))


def walk(nodes, above: tuple[Node, ...] = ()) -> Iterator[tuple[Node, tuple[Node, ...]]]:
    for n in nodes:
        yield n, above
        yield from walk(n.children, (*above, n))


@lru_cache(maxsize=32)
def located(text: str) -> tuple[tuple[Node, tuple[Node, ...]], ...]:
    """All nodes of a text, each with those it stands in."""
    return tuple(walk(parsed(text)))


def apply(text: str, edits: list[Edit]) -> str:
    """Edits from the last to the first; one that overlaps a later one is left out."""
    limit = len(text) + 1
    for start, end, new in sorted(set(edits), key=lambda e: (e[0], e[1]), reverse=True):
        if end <= limit:
            text = text[:start] + new + text[end:]
            limit = start
    return text


def line_start(text: str, at: int) -> int:
    return text.rfind("\n", 0, at) + 1


def line_end(text: str, at: int) -> int:
    end = text.find("\n", at)
    return len(text) if end < 0 else end


def literal_ranges(text: str) -> list[tuple[int, int]]:
    kinds = (*LITERAL, "math", "code")
    return [(n.start, n.end) for n, _ in located(text) if n.kind in kinds and ("\n" in text[n.start : n.end] or n.kind in LITERAL)]


def within(ranges: list[tuple[int, int]], at: int) -> bool:
    return any(a <= at < b for a, b in ranges)


def prefix_of(text: str, at: int) -> str:
    """What stands before ``at`` on its line, as the next lines of the same container begin."""
    return re.sub(r"[^\s>]", " ", text[line_start(text, at) : at])


def expand_tabs(text: str) -> str:
    """Tabs that indent a line, or follow its marker, as spaces."""
    keep = literal_ranges(text)
    edits, at = [], 0
    for line in text.split("\n"):
        m = re.match(r"[ \t>]*(?:(?:[-*+]|\d+[.)])[ \t]+)?", line)
        if "\t" in m[0] and not within(keep, at):
            edits.append((at, at + m.end(), m[0].expandtabs(4)))
        at += len(line) + 1
    return apply(text, edits)


def spell(text: str) -> str:
    """One spelling: stars for emphasis, collapsed references, backslashes for breaks, formulas of a line on one
    line, a space before a div's attributes."""
    edits: list[Edit] = []
    for n, above in located(text):
        source = text[n.start : n.end]
        if n.kind in ("emph", "strong") and (n.info or "")[:1] == "_":
            marks = len(n.info)
            alone = not (text[n.start - 1 : n.start].isalnum() or text[n.end : n.end + 1].isalnum())
            if alone and "*" not in source:
                edits += [(n.start, n.start + marks, "*" * marks), (n.end - marks, n.end, "*" * marks)]
        elif n.kind == "link" and n.info == "shortcut":
            edits.append((n.end, n.end, "[]"))
        elif n.kind == "link" and n.info == "full" and (m := re.fullmatch(r"\[([^\[\]]*)\]\[([^\[\]]*)\]", source)) and m[1].lower() == m[2].lower():
            edits.append((n.start + len(m[1]) + 3, n.end - 1, ""))
        elif n.kind == "math" and n.info == "inline" and "\n" in source and not any(x.kind == "quote" for x in above):
            edits.append((n.start, n.end, re.sub(r"\s*\n\s*", " ", source)))
        elif n.kind == "div" and (m := re.match(r" {0,3}:{3,}(?=\{)", source)):
            edits.append((n.start + m.end(), n.start + m.end(), " "))
        elif n.kind in ("para", "plain"):
            for m in re.finditer(r"(?<=\S) {2,}(?=\n)", source):
                edits.append((n.start + m.start(), n.start + m.end(), "\\"))
    return apply(text, edits)


def drop_escapes(text: str) -> str:
    """Backslashes before points go where the text reads the same without: all at once, else one by one."""
    literal = [(n.start, n.end) for n, _ in located(text) if n.kind in (*LITERAL, "code", "math", "raw_inline")]
    spots = [m.start() for m in re.finditer(r"(?<!\\)\\\.", text) if not within(literal, m.start())]
    if not spots:
        return text
    want = gate.canonical(text)
    every = apply(text, [(k, k + 1, "") for k in spots])
    if gate.canonical(every) == want:
        return every
    for k in reversed(spots):
        one = text[:k] + text[k + 1 :]
        if gate.canonical(one) == want:
            text = one
    return text


def blocks_in_order(text: str) -> Iterator[tuple[Node, Node]]:
    """Neighbours: blocks of one container, one after the other."""

    def pairs(nodes: list[Node]) -> Iterator[tuple[Node, Node]]:
        yield from zip(nodes, nodes[1:])
        for n in nodes:
            if n.kind in ("quote", "div", "item", "bullet_list", "ordered_list", "note_definition"):
                yield from pairs(n.children)

    yield from pairs(list(parsed(text)))


def blank_line_before(text: str, node: Node) -> Edit:
    at = line_start(text, node.start)
    return at, at, f"{prefix_of(text, node.start).rstrip()}\n"


def space_tags(text: str) -> str:
    """A blank line between a tag and a list or table next to it."""
    edits = []
    for a, b in blocks_in_order(text):
        kinds = {a.kind, b.kind}
        if "tag" in kinds and kinds & {"bullet_list", "ordered_list", "table"} and text.count("\n", a.end, b.start) == 1:
            edits.append(blank_line_before(text, b))
    return apply(text, edits)


def separate_lists(text: str) -> str:
    """A blank line before list items that continue a paragraph: bullets, or an ordered list that begins at 1."""
    edits = []
    for n, above in located(text):
        if n.kind != "para" or any(x.kind != "div" for x in above):
            continue
        at = n.start
        for k, line in enumerate(text[n.start : n.end].split("\n")):
            begin = 0 if k == 0 else len(line) - len(line.lstrip(" "))
            before = text[n.start : at].rstrip()
            if k and re.match(r"(?:[-*+]|1[.)])[ \t]+\S", line[begin:]) and before:
                edits.append((at, at, f"{prefix_of(text, at + begin).rstrip()}\n"))
                break
            at += len(line) + 1
    out = apply(text, edits)
    return out


def separate_notes(text: str) -> str:
    """A blank line before a footnote's definition that follows a line of text."""
    edits = []
    for m in re.finditer(r"(?m)^ {0,3}\[\^[^\]\s]+\]:", text):
        before = text[line_start(text, m.start() - 1) : m.start() - 1] if m.start() else ""
        if before.strip() and not re.match(r" {0,3}\[\^[^\]\s]+\]:", before) and not within(literal_ranges(text), m.start()):
            edits.append((m.start(), m.start(), "\n"))
    return apply(text, edits)


def place_items(text: str) -> str:
    """Each item's marker at the column of its list's content, one space, and its lines under its text. Lists in
    quotes and definitions stay."""
    for depth in count():
        edits: list[Edit] = []
        lists = [(n, above) for n, above in located(text) if n.kind in ("bullet_list", "ordered_list") and not any(x.kind in ("quote", "note_definition") for x in above)]
        if not any(sum(x.kind == "item" for x in above) >= depth for _, above in lists):
            return text
        for n, above in lists:
            if sum(x.kind == "item" for x in above) != depth:
                continue
            item = next((x for x in reversed(above) if x.kind == "item"), None)
            column = 0
            if item:
                column = item.start - line_start(text, item.start) + len(item.info) + (2 if re.fullmatch(r"[A-Z]\.", item.info) else 1) + (len(text[item.start :]) - len(text[item.start :].lstrip(" ")))
            for x in n.children:
                begin = line_start(text, x.start)
                m = re.match(r"( *)(\S+)( *)", text[begin : line_end(text, begin)])
                if not m or m[2] != x.info:
                    continue
                gap = m[3] if 0 < len(m[3]) < 5 else " " * bool(m[3])
                apart = " " * (2 if re.fullmatch(r"[A-Z]\.", m[2]) else 1)  # `A. Smith` begins no item
                old, new = len(m[1]) + len(m[2]) + max(1, len(gap)), column + len(m[2]) + len(apart)
                if len(m[1]) != column or m[3] and m[3] != apart and len(m[3]) < 5:
                    edits.append((begin, begin + len(m[1]) + len(m[2]) + len(gap), " " * column + m[2] + apart * bool(m[3])))
                if old != new:
                    at = line_end(text, begin) + 1
                    while at < x.end:
                        line = text[at : line_end(text, at)]
                        spaces = len(line) - len(line.lstrip(" "))
                        if line.strip() and spaces >= min(old, 4):
                            edits.append((at, at + spaces, " " * max(0, spaces + new - old)))
                        at += len(line) + 1
        text = apply(text, edits)


_OPEN_LINE, _CLOSE_LINE = re.compile(r"<[A-Za-z][^<>]*>"), re.compile(r"</[A-Za-z][A-Za-z0-9-]*>")


def join_html_lines(text: str) -> str:
    """A line that is an opening tag alone goes to the words after it, one that is a closing tag to the words before; what
    stands in lists, quotes, notes and tables stays, and so does what is written as it is to be shown."""
    edits: list[Edit] = []
    for n, above in located(text):
        if n.kind != "raw_block" or n.info != "html" or gate.VERBATIM.match(n.text or "") or any(x.kind in ("item", "quote", "note_definition", "cell") for x in above):
            continue
        lines, at = text[n.start : n.end].split("\n"), n.start
        tag = [x.strip().startswith("<") for x in lines]
        for k, line in enumerate(lines[:-1]):
            at += len(line) + 1
            opens, closes = _OPEN_LINE.fullmatch(line.strip()) and not tag[k + 1], _CLOSE_LINE.fullmatch(lines[k + 1].strip()) and not tag[k]
            if line.strip() and (opens or closes):
                edits.append((at - 1, at, " "))
    return apply(text, edits)


def unbold_headings(text: str) -> str:
    edits = []
    for n, _ in located(text):
        if n.kind == "heading" and len(n.children) == 1 and n.children[0].kind == "strong":
            s = n.children[0]
            edits += [(s.start, s.start + 2, ""), (s.end - 2, s.end, "")]
    return apply(text, edits)


_HYPHEN = re.compile(rf"(?<=\w)-\n[ >]*(?=[a-z0-9$])(?!(?:{'|'.join(gate.SUSPENDED)})\b)")


def join_hyphens(text: str) -> tuple[str, int]:
    """Close line breaks after a hyphen, and how many."""
    edits = []
    for n, _ in located(text):
        if n.kind == "text":
            for m in _HYPHEN.finditer(text, n.start, min(len(text), n.end + 1)):
                edits.append((m.start() + 1, m.end(), ""))
    return apply(text, edits), len(edits)


def curl(text: str) -> str:
    """Typographic quotes in the text of each paragraph, heading and cell; what isn't text can't change."""
    edits: list[Edit] = []
    for n, _ in located(text):
        if n.kind not in ("para", "plain", "heading", "cell"):
            continue
        free = [False] * (n.end - n.start)
        for x, _ in walk(n.children):
            if x.kind == "text":
                free[x.start - n.start : x.end - n.start] = [True] * (x.end - x.start)
        source = text[n.start : n.end]
        shown = "".join(c if f or c in "\n*_ " else "x" for c, f in zip(source, free))
        flat = re.sub(r"(?<=\n)[ >]+", lambda m: " " * len(m[0]), shown)
        new, before = flat, None
        while new != before:  # a quotation inside another shows once that is done; each round curls some more
            before, new = new, smart_quotes(new)
        for k, (a, b) in enumerate(zip(flat, new)):
            if a != b and free[k]:
                edits.append((n.start + k, n.start + k + 1, b))
    return apply(text, edits)


def dots(text: str) -> str:
    edits = []
    for n, _ in located(text):
        if n.kind == "text" and "..." in text[n.start : n.end]:
            source = text[n.start : n.end]
            new = ellipses(source)
            if new != source:
                edits.append((n.start, n.end, new))
    return apply(text, edits)


#: Characters that stand for the white space inside of a construct while its paragraph is wrapped.
_HIDE = str.maketrans({" ": "\ufdd0", "\n": "\ufdd1", "\t": "\ufdd2"})
_SHOW = str.maketrans({"\ufdd0": " ", "\ufdd1": " ", "\ufdd2": "\t"})
ATOMS = ("code", "math", "link", "image", "autolink", "bare_url", "raw_inline", "cite_group", "wikilink", "span")
_ALERT = re.compile(r"\[!(note|tip|important|warning|caution)\][ \t]*(?=\n|$)", re.I)


def around_displays(text: str, para: Node, displays: list[Node], wrapper: Wrapper, first: str, later: str) -> str:
    """A paragraph whose displayed formulas of several lines stand on lines of their own, as they are."""
    rows, at = [], para.start
    for x in [*displays, None]:
        piece = re.sub(r"\n[ \t>]*", "\n", text[at : x.start if x else para.end]).strip()
        if piece:
            rows.append(wrapper(piece, later if rows else first, later))
        if x:
            lines = text[x.start : x.end].split("\n")
            rows.append("\n".join((first if not rows and k == 0 else later if k == 0 else "") + line for k, line in enumerate(lines)))
            at = x.end
    return "\n".join(rows)


def wrap_paragraphs(text: str, wrapper: Wrapper) -> str:
    edits: list[Edit] = []
    for n, above in located(text):
        if n.kind not in ("para", "plain"):
            continue
        source = text[n.start : n.end]
        if any(x.kind in ("cell", "row") for x in above):
            continue
        begin = line_start(text, n.start)
        first, later = text[begin : n.start], prefix_of(text, n.start)
        if any(x.kind == "note_definition" for x in above) and not later.strip(" >"):
            depth = sum(x.kind == "note_definition" for x in above)
            later = re.sub(r" +$", "", later) + " " * 4 * depth
        chars = list(source)
        for x, _ in walk(n.children):
            if x.kind in ATOMS:
                for k in range(x.start - n.start, x.end - n.start):
                    chars[k] = chars[k].translate(_HIDE)
        body = "".join(chars)
        marks = r"\n[ \t>]*" if any(x.kind == "quote" for x in above) else r"\n[ \t]*"  # elsewhere `>` is text
        body = re.sub(marks, "\n", body)
        head = ""
        if above and above[-1].kind == "quote" and (m := _ALERT.match(body)):
            head, body = f"{first}{m[0].strip().upper()}\n", body[m.end() :].lstrip("\n")
            first = later
            if not body:
                edits.append((begin, n.end, head.rstrip("\n")))
                continue
        displays = [x for x in n.children if x.kind == "math" and x.info == "display" and "\n" in text[x.start : x.end]]
        if displays:
            new = around_displays(text, n, displays, wrapper, first, later)
        else:
            new = wrapper(body, first, later).translate(_SHOW)
        edits.append((begin, n.end, head + new))
    return apply(text, edits)


def space_items(text: str, spacing: str) -> str:
    """One blank line, or none, between the items of each list."""
    for _ in range(2):
        edits: list[Edit] = []
        for n, above in located(text):
            if n.kind not in ("bullet_list", "ordered_list"):
                continue
            big = any(len([c for c in x.children if c.kind not in ("bullet_list", "ordered_list")]) > 1 for x in n.children)
            loose = spacing == "loose" or big or spacing == "preserve" and n.info == "loose"
            nested = [(a, b) for x in n.children for a, b in zip(x.children, x.children[1:]) if b.kind in ("bullet_list", "ordered_list")]
            for a, b in [*zip(n.children, n.children[1:]), *nested]:
                start, end = a.end, line_start(text, b.start)
                blank = prefix_of(text, b.start).rstrip()
                gap = "\n" + (f"{blank}\n" if loose else "")
                if text[start:end] != gap and not text[start:end].strip(" >\n"):
                    edits.append((start, end, gap))
        text = apply(text, edits)
    return text


def fence_code(text: str) -> str:
    """Indented code between fences."""
    edits = []
    for n, _ in located(text):
        if n.kind == "code_block" and n.info == "indented":
            longest = max(map(len, re.findall(r"`+", n.text or "")), default=0)
            marks = "`" * max(3, longest + 1)
            begin = line_start(text, n.start)
            prefix = prefix_of(text, n.start)
            rows = [marks, *(n.text or "").split("\n"), marks]
            edits.append((begin, n.end, "\n".join((prefix + r).rstrip() if not r else prefix + r for r in rows)))
    return apply(text, edits)


#: Rows longer than this have columns of relative width.
WIDE = 72


def align_tables(text: str) -> str:
    """Rows as ``| a | b |`` and delimiters as three hyphens; a row with cells to spare stays."""
    edits = []
    for n, _ in located(text):
        if n.kind != "table":
            continue
        rows = text[n.start : n.end].split("\n")
        wide = max(map(len, rows)) > WIDE  # here the hyphens say how wide the columns are
        sign = {"l": ":---", "r": "---:", "lr": ":---:", "-": "---"}
        out = []
        for k, row in enumerate(rows):
            lead = re.match(r"[ >]*", row)[0] if k else ""
            cells = [row[len(lead) :][a:b] for a, b in cell_ranges(row[len(lead) :])]
            if k == 1 and wide:
                out.append(lead + "| " + " | ".join(cells) + " |")
            elif k == 1:
                out.append(lead + "| " + " | ".join(sign[a] for a in n.info.split(",")) + " |")
            elif len(cells) > n.level:
                out.append(row)
            else:
                out.append(lead + "| " + " | ".join(cells) + " |")
        edits.append((n.start, n.end, "\n".join(out)))
    return apply(text, edits)


def same_rules(text: str) -> str:
    return apply(text, [(n.start, n.end, "* * *") for n, _ in located(text) if n.kind == "rule"])


def close_gaps(text: str) -> str:
    """One blank line where there are more, outside of code, raw text and formulas."""
    keep = literal_ranges(text)
    return apply(text, [(m.start(1), m.end(1), "") for m in re.finditer(r"\n[ \t]*\n((?:[ \t]*\n)+)", text) if not within(keep, m.start())])


def space_headings(text: str) -> str:
    """A blank line after each heading."""
    edits = [blank_line_before(text, b) for a, b in blocks_in_order(text) if a.kind == "heading" and text.count("\n", a.end, b.start) == 1]
    return apply(text, edits)


def quote_blanks(text: str) -> str:
    """``> `` on the empty lines between the blocks of a quote."""
    edits = []
    for n, _ in located(text):
        if n.kind == "quote":
            for a, b in zip(n.children, n.children[1:]):
                edits += [(m.end(), m.end(), " ") for m in re.compile(r"(?m)^[ >]*>$").finditer(text, a.end, line_start(text, b.start))]
    return apply(text, edits)


def wrapper_of(options: Options) -> Wrapper | None:
    if options.wrap == "semantic":
        tagged, prose = markdown_by_sentence(options.width), with_hard_breaks(by_sentence(options.width, escape=escape_word))
        return lambda text, first, later: (tagged if any(map(is_tag_line, text.split("\n"))) else prose)(text, first, later)
    return markdown_by_width(options.width) if options.width > 0 else None


_ITEM_LINE = r"(?m)^[ >]*(?:[-*+]|\(?[\w@#-]+[.)])(?:[ \t]|$)"
#: Passes before and after wrapping, each with what a text must hold for it to have something to do: a pass whose
#: pattern isn't there needs no parse of the text.
BEFORE = (
    (expand_tabs, r"\t"),
    (spell, r"[_\[$]|  \n|:::\{"),
    (drop_escapes, r"\\\."),
    (space_tags, r"\{%|\{#|\{\{|<!--"),
    (separate_lists, r"\n[ >]*(?:[-*+]|1[.)])[ \t]"),
    (separate_notes, r"\n {0,3}\[\^"),
    (place_items, _ITEM_LINE),
    (space_tags, r"\{%|\{#|\{\{|<!--"),  # next to lists that the passes above set apart
    (join_html_lines, r"<[A-Za-z/]"),
)
AFTER = (
    (fence_code, r"(?m)^[ >]*(?: {4}|\t)"),
    (align_tables, r"\|"),
    (same_rules, r"(?m)(?:[-*_][ \t]*){3,}$"),
    (close_gaps, r"\n[ \t]*\n[ \t]*\n"),
    (space_headings, r"#|\n[ >]*(?:=+|-+)[ \t]*(?:\n|$)"),
    (quote_blanks, r">"),
)


def format_body(text: str, options: Options, wrapper: Wrapper | None = None) -> tuple[str, int]:
    """All passes over Markdown without its frontmatter; how many hyphens were closed."""
    joined = 0
    for step, needs in BEFORE:
        text = step(text) if re.search(needs, text) else text
    if "cleanups" in options.passes:
        text = unbold_headings(text) if "**" in text or "__" in text else text
        text, joined = join_hyphens(text) if "-\n" in text else (text, 0)
    if "smartquotes" in options.passes and re.search("[\"']", text):
        text = curl(text)
    if "ellipses" in options.passes and "..." in text:
        text = dots(text)
    wrapper = wrapper or wrapper_of(options)
    if wrapper:
        text = wrap_paragraphs(text, wrapper)
    if re.search(_ITEM_LINE, text):
        text = space_items(text, options.list_spacing)
    for step, needs in AFTER:
        text = step(text) if re.search(needs, text) else text
    return text, joined


def fill_markdown(text: str, options: Options = Options(), wrapper: Wrapper | None = None) -> str:
    """Frontmatter as it is, the body formatted, one line end at the end."""
    matter, body = split_frontmatter(text)
    body = re.sub(r"\A(?:[ \t]*\n)+", "", body).rstrip()
    if not body:
        return matter or ""
    out = format_body(body + "\n", options, wrapper)[0].rstrip("\n") + "\n"
    return f"{matter}\n{out}" if matter else out


REQUESTED = {"unbold_heading": "cleanups", "hyphen_join": "cleanups", "smart_quotes": "smartquotes"}


#: What formats a document; one of one's own stands before the same checks.
Formatter = Callable[[str, Options], str]


def reformat(text: str, options: Options = Options(), formatter: Formatter = fill_markdown) -> dict:
    """status: ok, unchanged or refused; the text to keep (the source if refused); why; which normalisations apply,
    and those of them that weren't asked for. formatter: makes the text that the gate compares with the source."""

    def result(status: str, out: str, error: str | None = None, applied: list[str] | None = None) -> dict:
        applied = applied or []
        unasked = [n for n in applied if n == "lazy_list" or n in REQUESTED and REQUESTED[n] not in options.passes]
        return {"status": status, "text": out, "error": error, "normalizations": applied, "unasked": unasked}

    if options.wrap == "plain":
        out = fill_text(text, Fill.WRAP, options.width)
        return result("ok" if out != text else "unchanged", out)
    matter, body = split_frontmatter(text)
    shift = matter.count("\n")
    wrong = sorted([*rejected_math(body), *unclosed_fences(body), *dropped_cells(body)])
    if wrong:
        return result("refused", text, "; ".join(f"line {line + shift}: {said}" for line, said in wrong))
    out = formatter(text, options)
    verdict = gate.check(body, split_frontmatter(out)[1])
    if not verdict["ok"]:
        return result("refused", text, f"block {verdict['block']}: {verdict['detail']}")
    return result("ok" if out != text else "unchanged", out, None, verdict["normalizations"])


def dropped_cells(text: str) -> list[tuple[int, str]]:
    return [(text.count("\n", 0, n.start) + 1, f"`{n.text}` is outside of every column") for n, _ in located(text) if n.kind == "dropped_cell" and (n.text or "").strip()]


RESULT = "struct<status:string,text:string,error:string,normalizations:array<string>,unasked:array<string>>"


def safely(text: str, options: Options, formatter: Formatter = fill_markdown) -> dict:
    try:
        return reformat(text, options, formatter)
    except (RecursionError, ValueError, IndexError) as e:  # a document must not fail the batch
        return {"status": "refused", "text": text, "error": f"{type(e).__name__}: {e}", "normalizations": [], "unasked": []}


def reformat_column(text: Column | str, options: Options = Options(), formatter: Formatter = fill_markdown) -> Column:
    return udf_of(lambda t: safely(t, options, formatter), RESULT)(text)


def reformat_documents(documents: DataFrame, options: Options = Options(), formatter: Formatter = fill_markdown) -> DataFrame:
    """``documents`` (doc_id, text, ...) with status, formatted, error, normalizations, unasked."""
    made = documents.withColumn("_r", reformat_column("text", options, formatter))
    return made.select(*documents.columns, F.col("_r.status").alias("status"), F.col("_r.text").alias("formatted"), F.col("_r.error").alias("error"), F.col("_r.normalizations").alias("normalizations"), F.col("_r.unasked").alias("unasked"))
