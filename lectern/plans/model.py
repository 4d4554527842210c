"""The relational document model: documents → lines, nodes and what follows from them."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.arrow import udf_of
from lectern.plans import reader


LINES = "array<struct<line_no:int,start:int,end:int,text:string>>"


def line_rows(text: str) -> list[dict]:
    out, at = [], 0
    for k, line in enumerate(text.split("\n"), 1):
        kept = line.removesuffix("\r")
        out.append({"line_no": k, "start": at, "end": at + len(kept), "text": kept})
        at += len(line) + 1
    return out


def lines(documents: DataFrame) -> DataFrame:
    """doc_id, line_no (from 1), start, end, text: the lines of ``documents`` (doc_id, text). A map: the offsets are a
    running sum within one text, for which a window would shuffle every line of the corpus."""
    return documents.select("doc_id", F.inline(udf_of(line_rows, LINES)("text")))


def asof(points: DataFrame, marks: DataFrame, value: list[str]) -> DataFrame:
    """As-of join: each row of ``points`` (doc_id, at, ...) with ``value`` of the last row of ``marks`` (doc_id,
    start, *value) that starts at or before ``at``. One sort within documents, no inequality join."""
    names = [c for c in points.columns if c not in ("doc_id", "at")]
    left = points.select("doc_id", "at", F.lit(1).alias("_point"), F.struct(*names).alias("_row"), F.lit(None).alias("_mark"))
    right = marks.select("doc_id", F.col("start").alias("at"), F.lit(0).alias("_point"), F.lit(None).alias("_row"), F.struct(*value).alias("_mark"))
    w = Window.partitionBy("doc_id").orderBy("at", "_point").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn("_mark", F.last("_mark", ignorenulls=True).over(w)).where("_point = 1")
    return both.select("doc_id", "at", "_row.*", "_mark.*")


def not_within(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """Range anti-join: rows of ``points`` (doc_id, start, end, ...) that overlap no row of ``ranges`` (doc_id,
    start, end). Ranges of a document are merged into running maxima, so this too is one sort within documents."""
    names = points.columns
    left = points.select("doc_id", F.col("start").alias("_at"), F.lit(1).alias("_point"), F.struct(*names).alias("_row"), F.lit(None).cast("int").alias("_stop"))
    right = ranges.select("doc_id", F.col("start").alias("_at"), F.lit(0).alias("_point"), F.lit(None).alias("_row"), F.col("end").cast("int").alias("_stop"))
    back = Window.partitionBy("doc_id").orderBy("_at", "_point").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("doc_id").orderBy("_at", "_point").rowsBetween(0, Window.unboundedFollowing)
    both = left.unionByName(right)
    both = both.withColumn("_before", F.max("_stop").over(back)).withColumn("_after", F.min(F.when(F.col("_point") == 0, F.col("_at"))).over(ahead))
    free = (F.coalesce("_before", F.lit(-1)) <= F.col("_row.start")) & (F.coalesce("_after", F.lit(2**31 - 1)) >= F.col("_row.end"))
    return both.where((F.col("_point") == 1) & free).select("_row.*")


@dataclass
class Model:
    """Tables over one set of documents (doc_id, text). The reader runs once if ``stored`` names a folder to keep
    nodes and lines in (Parquet, any file system), else once for each plan that uses them. kinds: of which kinds nodes are
    made, all if None; other kinds are an error then."""

    documents: DataFrame
    stored: str | None = None
    kinds: frozenset[str] | None = None
    whole: Model | None = None
    _narrowed: dict[frozenset[str], Model] = field(default_factory=dict, repr=False)

    def narrowed(self, kinds: Iterable[str]) -> Model:
        """A model of the same documents with nodes of some kinds only; this one if its nodes are made already."""
        wanted = frozenset(kinds)
        if self.kinds is not None or "_made" in self.__dict__:
            return self
        if wanted not in self._narrowed:
            folder = f"{self.stored}/{len(self._narrowed)}" if self.stored else None
            self._narrowed[wanted] = Model(self.documents, folder, wanted, self)
        return self._narrowed[wanted]

    def _kept(self, name: str, df: DataFrame) -> DataFrame:
        if self.stored is None:
            return df
        path = f"{self.stored}/{name}"
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.parquet(path)

    @cached_property
    def lines(self) -> DataFrame:
        return self.whole.lines if self.whole else self._kept("lines", lines(self.documents))

    @cached_property
    def _made(self) -> DataFrame:
        found = reader.nodes(self.documents, self.kinds)
        # sorted by kind without a shuffle: each rule's scan then skips the pages of other kinds
        return self._kept("nodes", found.sortWithinPartitions("kind") if self.stored else found)

    @property
    def nodes(self) -> DataFrame:
        if self.kinds is not None:
            raise ValueError(f"only nodes of {sorted(self.kinds)} are made")
        return self._made

    def of(self, *kinds: str) -> DataFrame:
        if self.kinds is not None and not self.kinds.issuperset(kinds):
            raise ValueError(f"nodes of {sorted(set(kinds) - self.kinds)} are not made")
        return self._made.where(F.col("kind").isin(*kinds))

    @cached_property
    def headings(self) -> DataFrame:
        return self.of("heading").select("doc_id", "node_id", "start", "end", "level", "ident", "classes", "text", "div_depth", "line")

    @cached_property
    def links(self) -> DataFrame:
        return self.of("link", "image", "autolink", "bare_url").select("doc_id", "node_id", "kind", "start", "end", "text", "url", "title", "info", "line")

    @cached_property
    def fences(self) -> DataFrame:
        return self.of("code_block").where("info <> 'indented'").select("doc_id", "node_id", "start", "end", "info", "classes", "text", F.col("url").alias("marker"))

    @cached_property
    def math(self) -> DataFrame:
        """TeX of each formula, and where it begins: after its delimiter."""
        opener = F.when(F.expr("end - start - length(text)") >= 4, 2).otherwise(1)
        return self.of("math").select("doc_id", "node_id", "parent_id", "start", "end", "info", "text", (F.col("start") + opener).cast("int").alias("tex_start"))

    @cached_property
    def divs(self) -> DataFrame:
        return self.of("div").select("doc_id", "node_id", "start", "end", "ident", "classes", "info", "div_depth")

    @cached_property
    def citations(self) -> DataFrame:
        return self.of("cite").select("doc_id", "node_id", "parent_id", "start", "end", F.col("ident").alias("key"), "info")

    @cached_property
    def frontmatter(self) -> DataFrame:
        return self.of("frontmatter").select("doc_id", "start", "end", "text")

    @cached_property
    def identifiers(self) -> DataFrame:
        return self.of("heading", "div", "code_block", "span", "link", "image").where("ident IS NOT NULL").select("doc_id", "ident", "kind", "start", "end")

    @cached_property
    def protected(self) -> DataFrame:
        """Ranges that prose rules leave alone: code, math, raw text, frontmatter, links' targets, tags, definitions."""
        whole = self.of("code_block", "raw_block", "frontmatter", "math", "code", "raw_inline", "autolink", "bare_url", "definition", "tag", "wikilink", "cite", "cite_group", "image")
        return whole.select("doc_id", "start", "end", "kind")


def title_key(title: Column) -> Column:
    return F.lower(title)
