"""Frontmatter and body of a document."""

from __future__ import annotations

from pyspark.sql import Column

from lectern.functions.arrow import udf_of


def split_frontmatter(text: str) -> tuple[str, str]:
    """(frontmatter, body). Frontmatter stands between lines ``---``, after blank lines at most; never closed, the
    whole text is frontmatter. The body loses a line end at its end."""
    lines = text.splitlines()
    first = next((k for k, x in enumerate(lines) if x.strip()), len(lines))
    if first == len(lines) or lines[first].strip() != "---":
        return "", text
    last = next((k for k in range(first + 1, len(lines)) if lines[k].strip() == "---"), None)
    if last is None:
        return text, ""
    return "\n".join(lines[first : last + 1]) + "\n", "\n".join(lines[last + 1 :])


def split_column(text: Column | str) -> Column:
    return udf_of(lambda t: dict(zip(("frontmatter", "body"), split_frontmatter(t))), "struct<frontmatter:string,body:string>")(text)
