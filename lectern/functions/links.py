"""Links of a text in document order."""

from __future__ import annotations

from pyspark.sql import Column

from lectern.functions.arrow import udf_of

LINKS = "array<struct<text:string,url:string,title:string,kind:string,start:int,end:int>>"
KINDS = ("link", "image", "autolink", "bare_url")
LINKS_AND_AUTOLINKS = ("link", "autolink")


def links(text: str, kinds: tuple[str, ...] = KINDS) -> list[dict]:
    """Links whose destination is known, inline or by reference. A title that isn't there is None, an empty one ''."""
    from lectern.plans.reader import rows

    return [{"text": r["text"], "url": r["url"], "title": r["title"], "kind": r["kind"], "start": r["start"], "end": r["end"]} for r in rows(text) if r["kind"] in kinds]


def links_column(text: Column | str, kinds: tuple[str, ...] = KINDS) -> Column:
    return udf_of(lambda t: links(t, kinds), LINKS)(text)
