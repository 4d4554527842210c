"""The meaning gate: whether two texts say the same, up to declared normalisations.

The gate knows nothing of how the formatter makes its changes. Changes that go one way only are read off the target: where
it has a paragraph and a list, the source may have one paragraph whose lines are these; where it has a hyphen inside a word,
the source may have a line's end after the hyphen.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import combinations

from pyspark.sql import Column

from lectern.functions.arrow import udf_of
from lectern.plans.reader import Node, parsed

#: Changes that a format may make. The first four are applied to both sides; the last two only to the source.
NORMALIZATIONS = ("unbold_heading", "list_spacing", "smart_quotes", "alert_type", "lazy_list", "hyphen_join")
_CURLY = str.maketrans({"“": '"', "”": '"', "‘": "'", "’": "'"})
_ALERT = re.compile(r"^\[!(note|tip|important|warning|caution)\]", re.I)


#: HTML whose white space is shown.
VERBATIM = re.compile(r"\s*<(?:pre|script|style|textarea)\b", re.I)
#: Words before which a hyphen at a line's end stays.
SUSPENDED = ("and", "or", "to", "nor", "but", "through", "versus")
#: A line's end in trees that keep those: no character of literal texts, whose lines stay lines.
BREAK = "\x1e"
#: White space that isn't a single space or line's end already.
_SPACE = re.compile(r"[\t\r\f\v][ \t\r\n\f\v]*|[ \n][ \t\r\n\f\v]+|\n")
_HARD_BREAK = re.compile(r"\\\n| {2,}\n")
_ESCAPED = re.compile(r"\\([!-/:-@\[-`{-~])")
_DOTS = re.compile(rf"[ {BREAK}]?(?:\.\.\.|…)[ {BREAK}]?")


def _narrow(t: str) -> str:
    """Single spaces, and none beside lines' ends."""
    t = re.sub("  +", " ", t) if "  " in t else t
    return re.sub(rf" *{BREAK} *", BREAK, t) if BREAK in t else t


def _inline(nodes: list[Node], breaks: bool = False) -> list:
    """Inline nodes with white space as one space, texts joined. breaks: lines' ends as BREAK."""
    out: list = []
    space = (lambda m: BREAK if "\n" in m[0] else " ") if breaks else " "
    for n in nodes:
        if n.kind in ("text", "line_break"):
            t = n.text if n.kind == "text" else "\x00"
            if "\n" in t:
                t = _HARD_BREAK.sub("\x00", t)
            t = _SPACE.sub(space, t)
            if "\\" in t:
                t = _ESCAPED.sub(r"\1", t)
            if "..." in t or "…" in t:
                t = _DOTS.sub("…", t)
            if out and isinstance(out[-1], str):
                out[-1] += t
            else:
                out.append(t)
        elif n.kind == "math":
            tex = n.text or ""
            out.append(["math", n.info, tex if "%" in tex else re.sub(r"\s+", " ", tex).strip()])
        elif n.kind in ("link", "image"):
            out.append([n.kind, n.url, n.title, n.ident, n.classes, _inline(n.children, breaks)])
        else:
            out.append([n.kind, n.ident, n.classes, n.url, re.sub(r"\s+", " ", n.text or "") if n.kind in ("code", "raw_inline", "wikilink", "autolink", "bare_url") else None, _inline(n.children, breaks)])
    return [_narrow(x) if isinstance(x, str) else x for x in out if x]


def _block(n: Node, breaks: bool = False) -> list:
    if n.kind in ("para", "plain", "heading", "cell", "dropped_cell"):
        inner = _inline(n.children, breaks)
        if inner and isinstance(inner[0], str):
            inner[0] = inner[0].lstrip()
        if inner and isinstance(inner[-1], str):
            inner[-1] = inner[-1].rstrip()
        return [n.kind, n.level, [] if "implicit" in n.classes else [n.ident, n.classes], [x for x in inner if x]]
    if n.kind == "code_block":
        return [n.kind, n.ident, n.classes, n.text]
    if n.kind == "item":
        return ["item", [_block(c, breaks) for c in n.children]]
    if n.kind in ("bullet_list", "ordered_list"):
        start = None if n.kind == "bullet_list" else (n.url or "").strip("().")
        return [n.kind, start, [_block(c, breaks) for c in n.children]]
    if n.kind == "table":
        return ["table", n.info, [_block(c) for r in n.children for c in r.children]]
    if n.kind in ("raw_block", "tag", "frontmatter", "grid_table", "line_block", "column_table", "definition_list"):
        shown = (n.text or "").strip()
        return [n.kind, n.info, " ".join(shown.split()) if n.kind == "raw_block" and n.info == "html" and not VERBATIM.match(shown) else shown]
    return [n.kind, n.ident, n.classes, n.url, n.title, [_block(c, breaks) for c in n.children]]


@lru_cache(maxsize=32)
def canonical(text: str, breaks: bool = False) -> list:
    return [_block(n, breaks) for n in parsed(text) if n.kind != "message"]


def _changed(tree, names: frozenset[str]):
    """A tree under the normalisations that hold for both sides."""
    if isinstance(tree, str):
        return tree.translate(_CURLY) if "smart_quotes" in names else tree
    if not isinstance(tree, list):
        return tree
    tree = [_changed(x, names) for x in tree]
    if tree and tree[0] == "plain" and "list_spacing" in names:
        tree[0] = "para"
    if tree and tree[0] == "heading" and "unbold_heading" in names and len(tree[3]) == 1 and isinstance(tree[3][0], list) and tree[3][0][0] == "strong":
        tree[3] = tree[3][0][-1]
    if tree and tree[0] in ("para", "plain") and len(tree) == 4 and tree[3] and isinstance(tree[3][0], str) and "alert_type" in names:
        tree[3][0] = _ALERT.sub(lambda m: m[0].upper(), tree[3][0])
    return tree


def _unbroken(tree):
    """A tree with lines' ends as spaces."""
    return tree.replace(BREAK, " ") if isinstance(tree, str) else [_unbroken(x) for x in tree] if isinstance(tree, list) else tree


def _joined(source, target):
    """``source``, which keeps lines' ends, with those after a hyphen left out that ``target`` has none of."""
    if isinstance(source, str) and isinstance(target, str):
        out, j = [], 0
        for i, c in enumerate(source):
            if c == BREAK and source[i - 1 : i] == "-" and target[j : j + 1] != " " and _may_close(source, i):
                continue
            out.append(c)
            j += 1
        return "".join(out)
    if isinstance(source, list) and isinstance(target, list) and len(source) == len(target):
        return [_joined(x, y) for x, y in zip(source, target)]
    return source


def _may_close(source: str, i: int) -> bool:
    """Whether the hyphen before the line's end at i belongs to a word that goes on."""
    after = source[i + 1 :]
    word = re.match(r"\w*", after)[0]
    return source[i - 2 : i - 1].isalnum() and (not after or after[0] in "abcdefghijklmnopqrstuvwxyz0123456789$") and word not in SUSPENDED


_MARKER = re.compile(r"(?:[-*+]|(1)[.)]) +(?=\S)")
_LATER_MARKER = re.compile(r"(?:[-*+]|(\d+)[.)]) +(?=\S)")


def _lines(inner: list) -> list[list]:
    """Inline nodes cut at lines' ends."""
    out: list[list] = [[]]
    for x in inner:
        if isinstance(x, str):
            first, *rest = x.split(BREAK)
            out[-1] += [first] if first else []
            out += [[r] if r else [] for r in rest]
        else:
            out[-1].append(x)
    return out


def _said(blocks: list) -> list | None:
    """The texts of a list's items in order, those of nested lists after their item's own; None if there is more in it."""
    out = []
    for item in blocks:
        for k, b in enumerate(item[1]):
            if b[0] in ("para", "plain") and not k:
                out.append(b[3])
            elif b[0] in ("bullet_list", "ordered_list") and k and (inner := _said(b[2])) is not None:
                out += inner
            else:
                return None
    return out


def _tidy(parts: list) -> list:
    """Inline nodes of some lines as of one text."""
    out: list = []
    for k, line in enumerate(parts):
        for x in ([BREAK, *line] if k else line):
            if out and isinstance(x, str) and isinstance(out[-1], str):
                out[-1] += x
            else:
                out.append(x)
    if out and isinstance(out[0], str):
        out[0] = out[0].lstrip()
    if out and isinstance(out[-1], str):
        out[-1] = out[-1].rstrip()
    return [x for x in out if x]


def _split(block: list, target: list, names: frozenset[str]) -> list | None:
    """What a source's paragraph becomes if its lines are the paragraph and the list that ``target`` begins with: these two
    blocks of the target, if they say the same; else None."""
    if len(target) < 2 or block[0] != "para" or target[0][0] != "para" or target[1][0] not in ("bullet_list", "ordered_list"):
        return None
    lines = _lines(block[3])
    first = next((k for k, x in enumerate(lines) if k and x and isinstance(x[0], str) and _MARKER.match(x[0])), None)
    if first is None:
        return None
    items: list[list] = []
    for line in lines[first:]:
        m = _LATER_MARKER.match(line[0]) if line and isinstance(line[0], str) else None
        if m:
            items.append([[line[0][m.end() :], *line[1:]]])
        else:
            items[-1].append(line)
    said = _said(target[1][2])
    head = ["para", block[1], block[2], _tidy(lines[:first])]
    if said is None or len(said) != len(items):
        return None
    mine, theirs = [head, *map(_tidy, items)], [target[0], *said]
    if "hyphen_join" in names:
        mine = _joined(mine, theirs)
    return target[:2] if _changed(_unbroken(mine), names) == _changed(theirs, names) else None


def _with_lists(source: list, target: list, names: frozenset[str]) -> list:
    """``source``, which keeps lines' ends, with paragraphs cut where ``target`` has a paragraph and a list; in divs, too."""
    out: list = []
    for block in source:
        there = target[len(out) :]
        if block[0] == "div" and there and there[0][0] == "div":
            out.append([*block[:-1], _with_lists(block[-1], there[0][-1], names)])
            continue
        out += _split(block, there, names) or [block]
    return out


def _unlike(source: list, target: list) -> list[tuple[list, list]]:
    """What of two trees has to be compared under normalisations, each pair by itself: blocks that are alike stay so under
    each. Trees of as many blocks are equal only if no paragraph is cut, so their blocks go in pairs; of others, what
    is alike before and after is left out. (A paragraph that is cut is longer than the target's paragraph, so none of those
    that are alike could be cut.)"""
    plain = [_unbroken(x) for x in source]
    if len(source) == len(target):
        return [([x], [y]) for x, p, y in zip(source, plain, target) if p != y]
    least = min(len(source), len(target))
    first = next((k for k in range(least) if plain[k] != target[k]), least)
    last = next((k for k in range(least - first) if plain[-1 - k] != target[-1 - k]), least - first)
    return [(source[first : len(source) - last], target[first : len(target) - last])]


def check(before: str, after: str) -> dict:
    """ok; the smallest set of normalisations that makes the two equal; else the first block that differs."""
    if before == after or canonical(before) == canonical(after):
        return {"ok": True, "normalizations": [], "detail": None, "block": None}
    source, target = canonical(before, True), canonical(after)

    def seen(chosen: frozenset[str], source: list, target: list) -> tuple[list, list]:
        """Both trees under some normalisations."""
        both, mine = chosen - {"lazy_list", "hyphen_join"}, source
        if "lazy_list" in chosen:
            mine = _with_lists(mine, target, chosen)
        if "hyphen_join" in chosen:
            mine = _joined(mine, target)
        return _changed(_unbroken(mine), both), _changed(target, both)

    parts = _unlike(source, target)
    for n in range(1, len(NORMALIZATIONS) + 1):
        for chosen in combinations(NORMALIZATIONS, n):
            if all(a == b for a, b in (seen(frozenset(chosen), *part) for part in parts)):
                return {"ok": True, "normalizations": list(chosen), "detail": None, "block": None}
    a, b = seen(frozenset(NORMALIZATIONS), source, target)
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    kind = lambda t: t[k][0] if k < len(t) else "nothing"
    return {"ok": False, "normalizations": [], "detail": f"{kind(a)} became {kind(b)}" if kind(a) != kind(b) else f"the {kind(a)} reads differently", "block": k}


VERDICT = "struct<ok:boolean,normalizations:array<string>,detail:string,block:int>"


def check_column(before: Column | str, after: Column | str) -> Column:
    return udf_of(check, VERDICT)(before, after)
