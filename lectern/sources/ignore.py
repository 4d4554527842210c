"""Ignore files, read where the driver can open them."""

from __future__ import annotations

import os

from lectern.sources.documents import ignore_patterns

TOOL_FILE = ".lecternignore"


def read_patterns(path: str) -> list[str]:
    """The patterns of a file; none if it can't be read or isn't UTF-8."""
    try:
        with open(path, encoding="utf-8") as f:
            return ignore_patterns(f.read())
    except (OSError, UnicodeDecodeError):
        return []


def below(pattern: str, folder: str) -> str:
    """A pattern of a folder's ignore file, for paths below the root."""
    back = "!" if pattern.startswith("!") else ""
    body = pattern[len(back) :]
    if not folder:
        return pattern
    anchored = "/" in body.rstrip("/")
    return f"{back}/{folder}/{body.lstrip('/')}" if anchored else f"{back}/{folder}/**/{body}"


def gitignore_patterns(root: str) -> list[str]:
    """The patterns of all ignore files from the root down, outer ones first; a local folder only."""
    out: list[str] = []
    for folder, names, files in os.walk(root):
        names[:] = sorted(n for n in names if n not in (".git", "node_modules"))
        if ".gitignore" in files:
            where = os.path.relpath(folder, root).replace(os.sep, "/")
            out += [below(p, "" if where == "." else where) for p in read_patterns(os.path.join(folder, ".gitignore"))]
    return out


def tool_patterns(start: str) -> list[str]:
    """The patterns of the nearest tool ignore file, from a folder upwards."""
    folder = os.path.abspath(start)
    while True:
        path = os.path.join(folder, TOOL_FILE)
        if os.path.isfile(path):
            return read_patterns(path)
        parent = os.path.dirname(folder)
        if parent == folder:
            return []
        folder = parent
