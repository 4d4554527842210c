"""Input checks: what in a document would be read differently than it is meant."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.arrow import udf_of
from lectern.functions.patterns import DOLLAR_MATH

FINDINGS = "array<struct<line:int,check:string,message:string>>"
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)$")
_SAFE = re.compile(rf"`+[^`\n]*`+|\\\$|{DOLLAR_MATH}")
_SHAPED = re.compile(r"\$(?![\d$])([^$]+?)\$(\d)?")


def fence_of(line: str, inside: str = "") -> str:
    """The marks of a fence that a line opens, or with ``inside`` closes; none: empty."""
    m = _FENCE.match(line)
    if not m:
        return ""
    if inside:
        return m[1] if m[1][0] == inside[0] and len(m[1]) >= len(inside) else ""
    return "" if m[1][0] == "`" and "`" in m[2] else m[1]


def fence_states(lines: list[str]) -> Iterator[tuple[bool, int | None, str]]:
    """For each line: whether it belongs to a fenced block, and the open fence's line and marks after it."""
    at, marks = None, ""
    for k, line in enumerate(lines):
        was = bool(marks)
        if marks:
            if fence_of(line, marks):
                at, marks = None, ""
        elif found := fence_of(line):
            at, marks = k, found
        yield was or bool(marks), at, marks


def runs_of_prose(lines: list[str]) -> list[list[int]]:
    """Line numbers, from 0, of each run of lines that are neither blank nor fenced."""
    runs: list[list[int]] = [[]]
    for k, (line, (fenced, _, _)) in enumerate(zip(lines, fence_states(lines))):
        if fenced or not line.strip():
            runs.append([])
        else:
            runs[-1].append(k)
    return [r for r in runs if r]


def _hidden(pattern: re.Pattern, text: str) -> str:
    return pattern.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def unclosed_fences(text: str) -> list[tuple[int, str]]:
    """(line, message) of the last fence if it isn't closed."""
    last = [(at, marks) for _, at, marks in fence_states(text.split("\n"))][-1]
    return [(last[0] + 1, f"the fence `{last[1]}` is never closed")] if last[0] is not None else []


def rejected_math(text: str) -> list[tuple[int, str]]:
    """(line, message) of dollar pairs that are read as text: a space inside a mark, or a digit after the last."""
    lines, out = text.split("\n"), []
    for run in runs_of_prose(lines):
        prose = _hidden(_SAFE, "\n".join(lines[k] for k in run))
        for m in _SHAPED.finditer(prose):
            if m[2] or m[1][0].isspace() or m[1][-1].isspace():
                why = "a digit follows the last `$`" if m[2] else "a space stands inside a `$`"
                out.append((run[prose.count("\n", 0, m.start())] + 1, f"`{' '.join(m[0].split())}` is no formula: {why}"))
    return out


def stray_dollars(text: str) -> list[tuple[int, str]]:
    """(line, message) of lines with a dollar sign that belongs to no formula and no amount."""
    lines, out = text.split("\n"), []
    for run in runs_of_prose(lines):
        bare = _hidden(_SHAPED, _hidden(_SAFE, "\n".join(lines[k] for k in run)))
        out += [(k + 1, "a `$` without its other half") for k, line in zip(run, bare.split("\n")) if re.search(r"\$(?!\d)", line)]
    return out


def preflight(text: str) -> list[dict]:
    checks = (("unclosed_fence", unclosed_fences), ("rejected_math", rejected_math), ("stray_dollar", stray_dollars))
    found = [{"line": line, "check": name, "message": said} for name, f in checks for line, said in f(text)]
    return sorted(found, key=lambda x: x["line"])


def preflight_column(text: Column | str) -> Column:
    return udf_of(preflight, FINDINGS)(text)


def findings(documents: DataFrame) -> DataFrame:
    """doc_id, line, check, message for ``documents`` (doc_id, text)."""
    return documents.select("doc_id", F.inline(preflight_column("text")))
