"""A reader for a written subset of Pandoc's Markdown: text → located nodes.

Blocks: frontmatter, ATX and setext headings, paragraphs, fenced and indented code, block quotes, bullet and ordered
lists (also fancy and example markers), pipe tables, thematic breaks, fenced divs, HTML blocks, TeX environments,
template tags on a line of their own, footnote and link definitions. Neither a list, a heading nor a quote interrupts
a paragraph (but a list does in a list item); a fence, a div fence, a footnote's definition and a tag line do. Inlines: code, math, links, images, autolinks, bare URLs,
wikilinks, citations, footnotes, spans with attributes, emphasis, strong, strikeout, raw TeX and HTML, hard breaks.

A node has the range of its source, ``start`` and ``end`` in characters, and a row number; rows are in pre-order. What
a document lacks to be well-formed becomes a ``message`` node. The reader is a pure function of one text, run once for
each document by an Arrow UDF; everything after it is DataFrame algebra over the nodes.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import cache, lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.arrow import udf_of
from lectern.functions.patterns import DISPLAY_DOLLARS, INLINE_DOLLARS
from lectern.operators.wrapping import starts_with_tag, ends_with_tag

SCHEMA = (
    "array<struct<node_id:int,parent_id:int,depth:int,kind:string,start:int,end:int,level:int,ident:string,classes:array<string>,"
    "info:string,url:string,title:string,text:string,div_depth:int,in_link:boolean,line:int>>"
)

#: Patterns by source, without the detour that the re module takes for each lookup.
rx = cache(re.compile)


@dataclass(slots=True)
class Node:
    kind: str
    start: int
    end: int
    level: int | None = None
    ident: str | None = None
    classes: list[str] = field(default_factory=list)
    info: str | None = None
    url: str | None = None
    title: str | None = None
    text: str | None = None
    children: list[Node] = field(default_factory=list)


@dataclass(slots=True)
class Line:
    """What is left of a source line inside its containers, and where that begins."""

    text: str
    start: int


FENCE = re.compile(r" {0,3}(`{3,}|~{3,})[ \t]*(.*?)[ \t]*$")
ATX = re.compile(r" {0,3}(#+)(?:[ \t]+(.*?))?[ \t]*$")
SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
QUOTE = re.compile(r" {0,3}> ?")
BULLET = re.compile(r"( {0,3})([-*+])(?:([ \t]+)|$)")
ORDERED = re.compile(r"( {0,3})(\(?(?:\d{1,9}|#|@[\w-]*|[ivxlcdm]+|[IVXLCDM]+|[A-Za-z])[.)])(?:([ \t]+)|$)")
DIV = re.compile(r" {0,3}(:{3,})[ \t]*(.*?)[ \t]*:*[ \t]*$")
NOTE = re.compile(r" {0,3}\[\^([^\]\s]+)\]:[ \t]*")
DEFINITION = re.compile(r" {0,3}\[(?!\^)((?:\\.|[^\]\\])+)\]:[ \t]*(<[^>]*>|\S+)(?:[ \t]+(\"[^\"]*\"|'[^']*'|\([^)]*\)))?[ \t]*$")
HTML_BLOCK = re.compile(r"(?i) {0,3}</?(?:address|article|aside|blockquote|body|center|details|dialog|div|dl|fieldset|figure|footer|form|h[1-6]|header|hr|html|iframe|li|main|nav|ol|p|pre|script|section|style|summary|table|tbody|td|th|thead|tr|ul)\b")
TEX_BEGIN = re.compile(r" {0,3}\\begin\{([A-Za-z*]+)\}")
DELIMITERS = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
ATTRIBUTES = re.compile(r"\{([^{}]*)\}")
GRID = re.compile(r" {0,3}\+(?:[-=:]+\+)+[ \t]*$")
LINE_BLOCK = re.compile(r"\|(?: |$)")
COLUMNS = re.compile(r" *-{2,}(?: +-{2,})+[ \t]*$")
DEFINITION_MARK = re.compile(r" {0,2}[:~][ \t]+\S")
#: Kinds of nodes that are made without a look into paragraphs.
BLOCKS = frozenset(("frontmatter", "heading", "code_block", "raw_block", "div", "rule", "quote", "note_definition", "definition", "bullet_list", "ordered_list", "item", "tag", "table", "row", "message"))
#: What counts when a bracket's end is looked for.
BRACKETS = re.compile(r"[\\`\[\]]")
#: Where an inline construct may begin.
MARKS = re.compile(r"[`$\\<\[!@^*_~]|https?://|www\.")


def attributes(source: str) -> tuple[str | None, list[str]]:
    """(identifier, classes) of what stands inside ``{}``."""
    ident, classes = None, []
    for part in re.findall(r"[#.][^\s.#{}=\"']+(?:[.:][^\s.#{}=\"']+)*|[\w-]+=(?:\"[^\"]*\"|'[^']*'|\S+)|-", source):
        if part[0] == "#":
            ident = part[1:]
        elif part[0] == ".":
            classes.append(part[1:])
        elif part == "-":
            classes.append("unnumbered")
    return ident, classes


def lines_of(text: str) -> list[Line]:
    out, at = [], 0
    for line in text.split("\n"):
        out.append(Line(line[:-1] if line.endswith("\r") else line, at))
        at += len(line) + 1
    return out


def blank(line: Line) -> bool:
    return not line.text.strip()


def frontmatter_lines(lines: list[Line]) -> int:
    """How many lines, from the first, are frontmatter: between ``---`` and ``---`` or ``...``."""
    if not lines or lines[0].text.rstrip() != "---":
        return 0
    return next((k + 1 for k in range(1, len(lines)) if lines[k].text.rstrip() in ("---", "...")), 0)


class Blocks:
    """The blocks of some lines, all in one container."""

    def __init__(self, source: str, inside: bool = True, prose: bool = True):
        """inside: whether paragraphs are looked into; prose: whether those with nothing but text in them are returned."""
        self.source, self.inside, self.prose = source, inside, prose
        self.messages: list[Node] = []

    def parse(self, lines: list[Line], tight: bool = False, in_item: bool = False) -> list[Node]:
        out: list[Node] = []
        k = 0
        while k < len(lines):
            if blank(lines[k]):
                k += 1
                continue
            if self.only_text(lines, k):
                if self.prose:
                    x = lines[k]
                    end = x.start + len(x.text)
                    out.append(Node("plain" if tight else "para", x.start, end, text=" ".join(x.text.split()), children=[Node("text", x.start, end, text=x.text)]))
                k += 1
                continue
            node, n = self.block(lines, k, tight, in_item)
            out.append(node)
            k += n
        return out

    def only_text(self, lines: list[Line], k: int) -> bool:
        """Whether a line is a paragraph for sure, with nothing but text in it: it begins with a letter, has no marks, and a
        blank line follows that no definition comes after."""
        text = lines[k].text
        if not text[0].isalpha() or k + 1 < len(lines) and not blank(lines[k + 1]) or MARKS.search(text) or self.marker(text):
            return False
        return k + 2 >= len(lines) or lines[k + 2].text.lstrip(" ")[:1] not in (":", "~")

    def message(self, start: int, what: str) -> None:
        self.messages.append(Node("message", start, start, info=what))

    def block(self, lines: list[Line], k: int, tight: bool, in_item: bool) -> tuple[Node, int]:
        line = lines[k].text
        for reader in OPENERS["a"] if line[0].isalpha() else OPENERS.get(line[0], READERS):
            found = reader(self, lines, k, line)
            if found:
                return found
        return self.paragraph(lines, k, tight, in_item)

    @staticmethod
    def end_of(line: Line) -> int:
        return line.start + len(line.text)

    def fence(self, lines: list[Line], k: int, line: str):
        m = FENCE.match(line)
        if not m or m[1][0] == "`" and "`" in m[2]:
            return None
        for j in range(k + 1, len(lines)):
            c = FENCE.match(lines[j].text)
            if c and not c[2] and c[1][0] == m[1][0] and len(c[1]) >= len(m[1]):
                body = "\n".join(x.text for x in lines[k + 1 : j])
                inner = ATTRIBUTES.fullmatch(m[2])
                ident, classes = attributes(inner[1]) if inner else (None, m[2].split()[:1])
                kind = "raw_block" if re.fullmatch(r"\{=\w+\}", m[2]) else "code_block"
                return Node(kind, lines[k].start, self.end_of(lines[j]), level=len(m[1]), ident=ident, classes=classes, info=m[2], url=m[1][0], text=body), j + 1 - k
        return None

    def div(self, lines: list[Line], k: int, line: str):
        m = DIV.match(line)
        if not m or not m[2]:
            return None
        depth = 1
        for j in range(k + 1, len(lines)):
            c = DIV.match(lines[j].text)
            if c:
                depth += 1 if c[2] else -1
            if not depth:
                break
        else:
            j = len(lines)
            self.message(lines[k].start, "div is never closed")
        inner = ATTRIBUTES.search(m[2])
        ident, classes = attributes(inner[1]) if inner else (None, m[2].split()[:1])
        last = lines[min(j, len(lines) - 1)]
        return Node("div", lines[k].start, self.end_of(last), ident=ident, classes=classes, info=m[2], children=self.parse(lines[k + 1 : j])), min(j, len(lines) - 1) + 1 - k

    def heading(self, lines: list[Line], k: int, line: str):
        m = ATX.match(line)
        if m:
            raw, level, n = m[2] or "", len(m[1]), 1
            at = lines[k].start + (m.start(2) if m[2] else len(line))
        elif k + 1 < len(lines) and lines[k + 1].text.lstrip(" ")[:1] in ("=", "-") and SETEXT.match(lines[k + 1].text) and not DELIMITERS.match(line) and "|" not in lines[k + 1].text:
            raw, level, n = line.strip(), 1 if "=" in lines[k + 1].text else 2, 2
            at = lines[k].start + len(line) - len(line.lstrip())
        else:
            return None
        tail = re.search(r"[ \t]*\{([^{}]*)\}[ \t]*$", raw)
        ident, classes = attributes(tail[1]) if tail else (None, [])
        body = raw[: tail.start()] if tail else raw
        body = re.sub(r"(?:^|[ \t]+)#+[ \t]*$", "", body) if n == 1 else body
        node = Node("heading", lines[k].start, self.end_of(lines[k + n - 1]), level=level, ident=ident, classes=classes, info="atx" if n == 1 else "setext")
        node.children = self.inlines(body, range(at, at + len(body)))
        node.text = plain(node.children)
        return node, n

    def rule(self, lines: list[Line], k: int, line: str):
        return (Node("rule", lines[k].start, self.end_of(lines[k])), 1) if RULE.match(line) else None

    def quote(self, lines: list[Line], k: int, line: str):
        if not QUOTE.match(line):
            return None
        inner, j, lazy = [], k, False
        while j < len(lines) and not blank(lines[j]):
            m = QUOTE.match(lines[j].text)
            if not m and not lazy:
                break
            cut = m.end() if m else 0
            inner.append(Line(lines[j].text[cut:], lines[j].start + cut))
            lazy = bool(inner[-1].text.strip())
            j += 1
        return Node("quote", lines[k].start, self.end_of(lines[j - 1]), children=self.parse(inner)), j - k

    def note(self, lines: list[Line], k: int, line: str):
        m = NOTE.match(line)
        if not m:
            return None
        inner, n = [Line(line[m.end() :], lines[k].start + m.end())], 1
        while k + n < len(lines):
            x = lines[k + n]
            if blank(x):
                if k + n + 1 < len(lines) and lines[k + n + 1].text.startswith("    "):
                    inner.append(Line("", x.start))
                    n += 1
                    continue
                break
            if NOTE.match(x.text) or DEFINITION.match(x.text):
                break
            cut = min(4, len(x.text) - len(x.text.lstrip(" ")))
            inner.append(Line(x.text[cut:], x.start + cut))
            n += 1
        return Node("note_definition", lines[k].start, self.end_of(lines[k + n - 1]), ident=m[1], children=self.parse(inner)), n

    def definition(self, lines: list[Line], k: int, line: str):
        m = DEFINITION.match(line)
        if not m:
            return None
        return Node("definition", lines[k].start, self.end_of(lines[k]), ident=" ".join(m[1].lower().split()), url=m[2].strip("<>"), title=m[3][1:-1] if m[3] else None), 1

    @staticmethod
    def marker(text: str):
        """(kind, marker, width of marker and space) of a list item's first line."""
        if text[:1].isalpha() and text[1:2] not in (".", ")") and text[0] not in "ivxlcdmIVXLCDM":
            return None
        m = BULLET.match(text)
        if m and not RULE.match(text):
            return "bullet_list", m[2], m.end() if (m[3] and len(m[3]) < 5) else m.start(2) + len(m[2]) + 1
        m = ORDERED.match(text)
        if m and (m[3] or m.end() == len(text)) and not (re.fullmatch(r"[A-Z]\.", m[2]) and len(m[3] or "") < 2):
            return "ordered_list", m[2], m.end() if (m[3] and len(m[3]) < 5) else m.start(2) + len(m[2]) + 1
        return None

    def items(self, lines: list[Line], k: int, line: str):
        head = self.marker(line)
        if not head:
            return None
        kind, sign = head[0], head[1][-1] if head[0] == "ordered_list" else None
        items: list[list[Line]] = []
        starts: list[tuple[Line, str]] = []
        j, width, gap, loose = k, 0, False, False
        while j < len(lines):
            x = lines[j]
            if blank(x):
                gap = True
                items[-1].append(Line("", x.start))
                j += 1
                continue
            spaces = len(x.text) - len(x.text.lstrip(" "))
            found = self.marker(x.text) if spaces < 4 and (not items or spaces < max(width, 2)) else None
            if found and found[0] == kind and (sign is None or found[1][-1] == sign):
                loose |= gap and bool(items)
                width = found[2]
                items.append([Line(x.text[min(width, len(x.text)) :], x.start + min(width, len(x.text)))])
                starts.append((x, found[1]))
            elif spaces >= width or spaces >= 4:
                cut = min(width, spaces)
                items[-1].append(Line(x.text[cut:], x.start + cut))
            elif gap or found or FENCE.match(x.text) or DIV.match(x.text) or NOTE.match(x.text) or starts_with_tag(x.text):
                break
            else:
                items[-1].append(Line(x.text.lstrip(" "), x.start + spaces))  # a lazy line
            gap = False
            j += 1
        while items[-1] and not items[-1][-1].text:
            items[-1].pop()
        made = []
        for body, (x, mark) in zip(items, starts):
            while len(body) > 1 and not body[-1].text:
                body.pop()
            loose |= any(not y.text for y in body)
        for body, (x, mark) in zip(items, starts):
            last = body[-1] if body else x
            item = Node("item", x.start, self.end_of(last), info=mark, children=self.parse(body, not loose, True))
            task = re.match(r"\[([ xX])\]\s", body[0].text) if body else None
            item.classes = ["task"] if task else []
            made.append(item)
        end = made[-1].end
        n = sum(1 for x in lines[k:j] if x.start <= end)
        return Node(kind, lines[k].start, end, info="loose" if loose else "tight", url=starts[0][1], children=made), max(1, n)

    def code(self, lines: list[Line], k: int, line: str):
        if not line.startswith(("    ", "\t")):
            return None
        j = last = k
        while j < len(lines) and (blank(lines[j]) or lines[j].text.startswith(("    ", "\t"))):
            last = j if not blank(lines[j]) else last
            j += 1
        body = "\n".join(x.text[1:] if x.text.startswith("\t") else x.text[4:] for x in lines[k : last + 1])
        return Node("code_block", lines[k].start, self.end_of(lines[last]), info="indented", text=body), last + 1 - k

    def html(self, lines: list[Line], k: int, line: str):
        comment = line.lstrip().startswith("<!--")
        if not comment and not HTML_BLOCK.match(line):
            return None
        j = k
        if comment:
            while j < len(lines) and "-->" not in lines[j].text:
                j += 1
            if j == len(lines) or lines[j].text.rstrip().endswith("-->") is False:
                return None
        else:
            while j + 1 < len(lines) and not blank(lines[j + 1]):
                j += 1
        return Node("raw_block", lines[k].start, self.end_of(lines[j]), info="html", text="\n".join(x.text for x in lines[k : j + 1])), j + 1 - k

    def tex(self, lines: list[Line], k: int, line: str):
        m = TEX_BEGIN.match(line)
        if not m:
            return None
        for j in range(k, len(lines)):
            if f"\\end{{{m[1]}}}" in lines[j].text:
                return Node("raw_block", lines[k].start, self.end_of(lines[j]), info="tex", ident=m[1], text="\n".join(x.text for x in lines[k : j + 1])), j + 1 - k
        return None

    def tag(self, lines: list[Line], k: int, line: str):
        if line[:1].isspace() or not starts_with_tag(line) or not ends_with_tag(line):
            return None
        return Node("tag", lines[k].start, self.end_of(lines[k]), text=line), 1

    def table(self, lines: list[Line], k: int, line: str):
        if "|" not in line or k + 1 >= len(lines) or not DELIMITERS.match(lines[k + 1].text) or "|" not in lines[k + 1].text:
            return None
        j = k + 2
        while j < len(lines) and "|" in lines[j].text and not blank(lines[j]):
            j += 1
        aligned = [f"{c.startswith(':') * 'l'}{c.endswith(':') * 'r'}" or "-" for c in cells_of(lines[k + 1].text)]
        node = Node("table", lines[k].start, self.end_of(lines[j - 1]), level=len(aligned), info=",".join(aligned))
        for r, x in enumerate(lines[k:j]):
            if r == 1:
                continue
            row = Node("row", x.start, self.end_of(x))
            for c, (a, b) in enumerate(cell_ranges(x.text)):
                body = x.text[a:b]
                kind = "cell" if c < len(aligned) else "dropped_cell"
                row.children.append(Node(kind, x.start + a, x.start + b, text=body, children=self.inlines(body, range(x.start + a, x.start + b))))
            node.children.append(row)
        return node, j - k

    def opaque(self, lines: list[Line], k: int, line: str):
        """Grid and column tables, line blocks, definition lists: kept as they are, not looked into."""

        def upto(kind: str, more) -> tuple[Node, int]:
            j = k + 1
            while j < len(lines) and more(j):
                j += 1
            while blank(lines[j - 1]):
                j -= 1
            return Node(kind, lines[k].start, self.end_of(lines[j - 1]), text="\n".join(x.text for x in lines[k:j])), j - k

        text = lambda j: lines[j].text if j < len(lines) else ""
        around = line + text(k + 1)[:4] + text(k + 2)[:4]
        if not ("+" in line or "|" in line or "--" in around or ":" in around or "~" in around):
            return None
        if GRID.match(line):
            return upto("grid_table", lambda j: text(j).lstrip()[:1] in ("+", "|"))
        if LINE_BLOCK.match(line):
            return upto("line_block", lambda j: bool(LINE_BLOCK.match(text(j))) or text(j).startswith(" ") and bool(text(j).strip()))
        if COLUMNS.match(text(k + 1)) and line.strip() or COLUMNS.match(line):
            return upto("column_table", lambda j: bool(text(j).strip()))
        first = k + 1 if DEFINITION_MARK.match(text(k + 1)) else k + 2 if k + 2 < len(lines) and blank(lines[k + 1]) and DEFINITION_MARK.match(text(k + 2)) else 0
        if first and not DEFINITION_MARK.match(line):
            def more(j: int) -> bool:
                if j <= first or DEFINITION_MARK.match(text(j)) or text(j).startswith(("    ", "\t")):
                    return True
                if blank(lines[j]):
                    later = next((i for i in range(j + 1, len(lines)) if not blank(lines[i])), None)
                    return later is not None and bool(DEFINITION_MARK.match(text(later)) or text(later).startswith(("    ", "\t")))
                return not blank(lines[j - 1])

            return upto("definition_list", more)
        return None

    def interrupts(self, line: Line) -> bool:
        if line.text[:1].isalpha():
            return False
        m = FENCE.match(line.text)
        if m and not (m[1][0] == "`" and "`" in m[2]):
            return True
        return bool(DIV.match(line.text) or NOTE.match(line.text)) or bool(self.tag([line], 0, line.text))

    def paragraph(self, lines: list[Line], k: int, tight: bool, in_item: bool) -> tuple[Node, int]:
        j = k + 1
        while j < len(lines) and not blank(lines[j]) and not self.interrupts(lines[j]) and not (in_item and self.marker(lines[j].text)):
            j += 1
        first = lines[k]
        if not self.inside:
            return Node("plain" if tight else "para", first.start + len(first.text) - len(first.text.lstrip()), self.end_of(lines[j - 1])), j - k
        bodies = [first.text, *(x.text.lstrip(" \t") for x in lines[k + 1 : j])]
        text = "\n".join(bodies)
        at: Sequence[int] = range(first.start, first.start + len(text))
        last = lines[j - 1]
        if last.start + len(last.text) != first.start + len(text):  # something is cut off before some line
            at = []
            for n, (x, body) in enumerate(zip(lines[k:j], bodies)):
                if n:
                    at.append(at[-1] + 1 if at else x.start)
                begin = x.start + len(x.text) - len(body)
                at += range(begin, begin + len(body))
        node = Node("plain" if tight else "para", lines[k].start + len(lines[k].text) - len(lines[k].text.lstrip()), self.end_of(lines[j - 1]), children=self.inlines(text, at))
        node.text = plain(node.children)
        return node, j - k

    # Inlines ------------------------------------------------------------------------------------------------

    def inlines(self, text: str, at: Sequence[int]) -> list[Node]:
        """Nodes of a text whose character k stands at ``at[k]`` of the source; what is between them is text nodes."""
        out: list[Node] = []
        plain_from = k = 0

        def place(a: int, b: int) -> tuple[int, int]:
            return (at[a], at[b - 1] + 1) if b > a else (at[a] if a < len(at) else 0, at[a] if a < len(at) else 0)

        def flush(to: int) -> None:
            if to > plain_from:
                s, e = place(plain_from, to)
                out.append(Node("text", s, e, text=text[plain_from:to]))

        while m := MARKS.search(text, k):
            k = m.start()
            found = self.inline(text, k, at)
            if found and found[0].kind == "text":  # marks that mean nothing here
                k = found[1]
            elif found:
                node, end = found
                flush(k)
                node.start, node.end = place(k, end)
                out.append(node)
                k = plain_from = end
            else:
                k += 2 if text[k] == "\\" else 1
        flush(len(text))
        return out

    def inline(self, text: str, k: int, at: list[int]):
        """(node, end) of what begins at k."""
        c, rest = text[k], text[k : k + 2]
        if c == "`":
            run = rx(r"`+").match(text, k)[0]
            m = rx(rf"(?<!`){run}(?!`)(.+?)(?<!`){run}(?!`)", re.S).match(text, k)
            if m:
                return Node("code", 0, 0, text=m[1].strip(), info=run), m.end()
            return Node("text", 0, 0, text=run), k + len(run)
        if c == "$":
            for kind, pattern, n in (("display", _DISPLAY, 2), ("inline", _INLINE, 1)):
                m = pattern.match(text, k)
                if m:
                    return Node("math", 0, 0, info=kind, text=m[0][n:-n]), m.end()
            return None
        if c == "\\":
            m = rx(r"\\\((.*?)\\\)|\\\[(.*?)\\\]", re.S).match(text, k)
            if m:
                return Node("math", 0, 0, info="inline" if m[1] is not None else "display", text=m[1] if m[1] is not None else m[2]), m.end()
            if rest == "\\\n":
                return Node("line_break", 0, 0), k + 2
            m = rx(r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])*(?:\{(?:[^{}]|\{[^{}]*\})*\})*").match(text, k)
            return (Node("raw_inline", 0, 0, info="tex", text=m[0]), m.end()) if m else None
        if c == "<":
            m = rx(r"<([A-Za-z][A-Za-z0-9+.\-]*:[^\s<>]*|[^\s<>@]+@[^\s<>]+)>").match(text, k)
            if m:
                return Node("autolink", 0, 0, url=m[1], text=m[1]), m.end()
            m = rx(r"<!--.*?-->|</?[A-Za-z][\w-]*(?:\s+[^<>]*)?/?>", re.S).match(text, k)
            return (Node("raw_inline", 0, 0, info="html", text=m[0]), m.end()) if m else None
        if c in "hw":
            m = rx(r"(?:https?://|www\.)[^\s<>]*[^\s<>?!.,:;*_~'\")\]]").match(text, k)
            if m and (k == 0 or not text[k - 1].isalnum()):
                return Node("bare_url", 0, 0, url=m[0], text=m[0]), m.end()
            return None
        if c == "!" and rest == "![":
            return self.link(text, k + 1, at, "image")
        if c == "[":
            return self.bracket(text, k, at)
        if c == "@":
            m = rx(r"@(\{[^{}\s]+\}|\w(?:[\w:.#$%&+?<>~/-]*\w)?)").match(text, k)
            if m and (k == 0 or not (text[k - 1].isalnum() or text[k - 1] in "._")):
                return Node("cite", 0, 0, ident=m[1].strip("{}"), info="bare"), m.end()
            return None
        if c == "^" and rest == "^[":
            end = closing(text, k + 1)
            return (Node("note", 0, 0, info="inline", children=self.inlines(text[k + 2 : end], at[k + 2 : end])), end + 1) if end > 0 else None
        if c in "*_~":
            return self.emphasis(text, k, at)
        return None

    def emphasis(self, text: str, k: int, at: list[int]):
        c = text[k]
        run = len(text[k:]) - len(text[k:].lstrip(c))
        if c == "~" and run != 2 or run > 3 or k + run >= len(text) or text[k + run].isspace():
            return Node("text", 0, 0, text=text[k : k + run]), k + run
        if c == "_" and k and text[k - 1].isalnum():
            return Node("text", 0, 0, text=text[k : k + run]), k + run
        end = k + run
        while end < len(text):
            end = text.find(c * run, end)
            if end < 0:
                break
            after = end + run
            longer = text[after : after + 1] == c or text[end - 1] == c
            if text[end - 1] not in " \t\n\\" and not longer and not (c == "_" and text[after : after + 1].isalnum()) and "\n\n" not in text[k:end]:
                kind = {"~": "strikeout"}.get(c, ("emph", "strong", "strong")[run - 1])
                inner = self.inlines(text[k + run : end], at[k + run : end])
                return Node(kind, 0, 0, info=c * run, text=plain(inner), children=inner), after
            end += run if not longer else 1
        return Node("text", 0, 0, text=text[k : k + run]), k + run

    def bracket(self, text: str, k: int, at: list[int]):
        if text.startswith("[[", k):
            m = rx(r"\[\[([^\[\]|\n]+)(?:\|([^\[\]\n]*))?\]\]").match(text, k)
            if m:
                return Node("wikilink", 0, 0, url=m[1], text=m[2] if m[2] is not None else m[1]), m.end()
        m = rx(r"\[\^([^\]\s]+)\]").match(text, k)
        if m:
            return Node("note", 0, 0, ident=m[1], info="reference"), m.end()
        end = closing(text, k)
        if end < 0:
            return None
        inner = text[k + 1 : end]
        if re.match(r"-?@\w|[^@\]]*[\s;(-]@\w", inner) and text[end + 1 : end + 2] not in ("(", "["):
            node = Node("cite_group", 0, 0, text=inner)
            for m in re.finditer(r"(?<![\w.])(-?)@(\{[^{}\s]+\}|\w(?:[\w:.#$%&+?<>~/-]*\w)?)", inner):
                node.children.append(Node("cite", at[k + 1 + m.start()], at[k + m.end()] + 1, ident=m[2].strip("{}"), info="suppressed" if m[1] else "normal"))
            return node, end + 1
        return self.link(text, k, at, "link")

    def link(self, text: str, k: int, at: list[int], kind: str):
        end = closing(text, k)
        if end < 0:
            return None
        label, after = text[k + 1 : end], text[end + 1 : end + 2]
        inner = self.inlines(label, at[k + 1 : end])
        node = Node(kind, 0, 0, text=plain(inner), children=inner)
        m = rx(r"\(\s*(<[^<>\n]*>|(?:\\.|[^\s()\\]|\((?:\\.|[^\s()\\])*\))*)(?:\s+(\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|\([^()]*\)))?\s*\)").match(text, end + 1)
        if m:
            node.url, node.title, node.info = m[1].strip("<>") if m[1].startswith("<") else m[1], m[2][1:-1] if m[2] else None, "inline"
            stop = m.end()
        elif after == "{" and kind == "link" and (m := ATTRIBUTES.match(text, end + 1)):
            node.kind, (node.ident, node.classes) = "span", attributes(m[1])
            return node, m.end()
        else:
            m = rx(r"\[([^\[\]]*)\]").match(text, end + 1)
            key = " ".join((m[1] if m and m[1] else label).lower().split())
            if key not in self.definitions:
                return None
            node.url, node.title = self.definitions[key]
            node.info, stop = "collapsed" if m and not m[1] else "full" if m else "shortcut", m.end() if m else end + 1
        tail = ATTRIBUTES.match(text, stop)
        if tail:
            node.ident, node.classes = attributes(tail[1])
            stop = tail.end()
        return node, stop

    definitions: dict[str, tuple[str, str | None]] = {}


READERS = (Blocks.fence, Blocks.div, Blocks.heading, Blocks.rule, Blocks.quote, Blocks.note, Blocks.items, Blocks.definition, Blocks.code, Blocks.html, Blocks.tex, Blocks.tag, Blocks.table, Blocks.opaque)
#: The block readers that a line can be for, by its first character: a letter, or some marks; all of them for the others.
OPENERS = {
    c: tuple(r for r in READERS if r in own or r in (Blocks.heading, Blocks.table, Blocks.opaque))
    for c, own in {
        "a": (Blocks.items,), "#": (Blocks.items,), "[": (Blocks.note, Blocks.definition), "`": (Blocks.fence,), "~": (Blocks.fence,), "-": (Blocks.rule, Blocks.items), "*": (Blocks.rule, Blocks.items),
        "+": (Blocks.items,), ">": (Blocks.quote,), ":": (Blocks.div,), "!": (), "$": (), "|": (),
    }.items()
}
_DISPLAY, _INLINE = re.compile(DISPLAY_DOLLARS, re.S), re.compile(INLINE_DOLLARS, re.S)


def closing(text: str, k: int) -> int:
    """Where the bracket that opens at k closes, past escapes and code; -1 if nowhere."""
    depth, j = 0, k
    while found := BRACKETS.search(text, j):
        j = found.start()
        c = text[j]
        if c == "\\":
            j += 1
        elif c == "`":
            m = rx(r"(`+)(?!`).+?(?<!`)\1(?!`)", re.S).match(text, j)
            j = m.end() - 1 if m else j
        elif c == "[":
            depth += 1
        elif c == "]":
            depth -= 1
            if not depth:
                return j
        j += 1
    return -1


def cell_ranges(row: str) -> list[tuple[int, int]]:
    """Where the cells of a pipe table's row are, without the space around them."""
    marks, j = [], 0
    while j < len(row):
        if row[j] == "\\":
            j += 1
        elif row[j] == "`":
            m = rx(r"(`+)(?!`).+?(?<!`)\1(?!`)").match(row, j)
            j = m.end() - 1 if m else j
        elif row[j] == "|":
            marks.append(j)
        j += 1
    edges = [-1, *marks, len(row)]
    found = list(zip([e + 1 for e in edges[:-1]], edges[1:]))
    if found and not row[: found[0][1]].strip():
        found = found[1:]
    if found and not row[found[-1][0] :].strip() and marks:
        found = found[:-1]
    return [(a + len(row[a:b]) - len(row[a:b].lstrip()), max(b - len(row[a:b]) + len(row[a:b].rstrip()), a + len(row[a:b]) - len(row[a:b].lstrip()))) for a, b in found]


def cells_of(row: str) -> list[str]:
    return [row[a:b] for a, b in cell_ranges(row)]


def plain(nodes: list[Node]) -> str:
    """What a reader sees of inline nodes."""
    out = []
    for n in nodes:
        if n.kind in ("text", "code", "math", "wikilink", "autolink", "bare_url"):
            out.append(n.text or "")
        elif n.kind in ("note", "raw_inline", "image"):
            out.append(n.text or "" if n.kind == "image" else "")
        elif n.kind == "line_break":
            out.append(" ")
        elif n.kind == "cite":
            out.append("@" + (n.ident or ""))
        elif n.kind == "cite_group":
            out.append(f"[{n.text}]")
        else:
            out.append(plain(n.children))
    shown = "".join(out)
    return " ".join((rx(r"\\(\W)").sub(r"\1", shown) if "\\" in shown else shown).split())


def identifier(title: str) -> str:
    """The identifier that a heading without one gets from its visible text."""
    kept = re.sub(r"[^\w\s.-]", "", title.lower())
    kept = re.sub(r"\s+", "-", kept.strip())
    return re.sub(r"^[^a-z]+", "", kept) or "section"


def read(text: str, inside: bool = True, prose: bool = True) -> list[Node]:
    """The blocks of a document, with its messages at the end. inside, prose: as in ``Blocks``."""
    reader = Blocks(text, inside, prose)
    lines = lines_of(text)
    n = frontmatter_lines(lines)
    reader.definitions = {}
    for x in lines if "]:" in text else ():
        if "]:" in x.text and (m := DEFINITION.match(x.text)):
            reader.definitions.setdefault(" ".join(m[1].lower().split()), (m[2].strip("<>"), m[3][1:-1] if m[3] else None))
    out = [Node("frontmatter", 0, Blocks.end_of(lines[n - 1]), text="\n".join(x.text for x in lines[1 : n - 1]))] if n else []
    out += reader.parse(lines[n:])
    return [*out, *reader.messages]


@lru_cache(maxsize=32)
def parsed(text: str) -> tuple[Node, ...]:
    """``read``, remembered for the passes over one document."""
    return tuple(read(text))


def rows(text: str, kinds: frozenset[str] | None = None) -> list[dict]:
    """``read`` flattened in pre-order; headings without an identifier get one, counted up where it is taken. kinds: of
    which kinds nodes are returned, all if None."""
    out: list[dict] = []
    n = 0
    taken: dict[str, int] = {}
    starts = [0, *(m.end() for m in rx("\n").finditer(text))]

    def walk(node: Node, parent: int | None, depth: int, divs: int, in_link: bool) -> None:
        nonlocal n
        me = n
        n += 1
        if node.kind == "heading" and not node.ident:
            base = identifier(node.text or "")
            node.ident = f"{base}-{taken[base]}" if base in taken else base
            taken[base] = taken.get(base, 0) + 1
            node.classes = [*node.classes, "implicit"]
        if kinds is None or node.kind in kinds:
            out.append(
                {"node_id": me, "parent_id": parent, "depth": depth, "kind": node.kind, "start": node.start, "end": node.end, "level": node.level, "ident": node.ident, "classes": node.classes}
                | {"info": node.info, "url": node.url, "title": node.title, "text": node.text, "div_depth": divs, "in_link": in_link, "line": bisect_right(starts, node.start)}
            )
        for child in node.children:
            walk(child, me, depth + 1, divs + (node.kind == "div"), in_link or node.kind in ("link", "image"))

    for node in read(text, kinds is None or not kinds <= BLOCKS, kinds is None or not kinds.isdisjoint(("para", "plain", "text"))):
        walk(node, None, 0, 0, False)
    return out


def nodes_column(text: Column | str, kinds: frozenset[str] | None = None) -> Column:
    return udf_of(lambda t: rows(t, kinds), SCHEMA)(text)


def nodes(documents: DataFrame, kinds: frozenset[str] | None = None) -> DataFrame:
    """doc_id and a row for each node of ``documents`` (doc_id, text); kinds: of these kinds only."""
    return documents.select("doc_id", F.inline(nodes_column("text", kinds)))
