"""Rules, settings, findings and how a run is planned: rules that are off never enter the plan."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.arrow import udf_of
from lectern.plans.model import Model

LEVELS = ("off", "info", "warning", "error")
FINDING = (
    "doc_id bigint, rule string, severity string, message string, start int, end int, suggestions array<struct<title:string,replacement:string>>, "
    "fix struct<title:string,replacement:string>, data map<string,string>"
)


@dataclass(frozen=True)
class Rule:
    name: str
    level: str
    description: str
    group: str


@dataclass(frozen=True)
class Setting:
    level: str | None = None
    options: dict[str, Any] = field(default_factory=dict)


@dataclass
class Context:
    """What rules may need besides the documents: small tables, by name, and each rule's options."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    options: dict[str, dict[str, Any]] = field(default_factory=dict)
    on: frozenset[str] | None = None  # rules that aren't off in this run; None: all

    def wants(self, rule: str) -> bool:
        return self.on is None or rule in self.on

    def option(self, rule: str, name: str, default: Any) -> Any:
        return self.options.get(rule, {}).get(name, default)


Builder = Callable[[Model, Context], DataFrame]


class Registry:
    """Rules by name, and the builders of their groups. A group's builder makes the findings of all its rules in one
    pass, as rules that look at the same table share its scan. A group may state of which kinds the nodes are that it looks
    at: no others are made then, if all groups of a run do so."""

    def __init__(self) -> None:
        self.rules: dict[str, Rule] = {}
        self.builders: dict[str, Builder] = {}
        self.kinds: dict[str, tuple[str, ...] | None] = {}

    def group(self, name: str, *rules: tuple[str, str, str], kinds: tuple[str, ...] | None = None) -> Callable[[Builder], Builder]:
        def add(builder: Builder) -> Builder:
            self.builders[name], self.kinds[name] = builder, kinds
            for rule, level, description in rules:
                self.add(Rule(rule, level, description, name))
            return builder

        return add

    def add(self, rule: Rule) -> None:
        if rule.name in self.rules or not rule.name or any(c.isspace() for c in rule.name):
            raise ValueError(f"the rule name {rule.name!r} is taken or has white space")
        if rule.level not in LEVELS:
            raise ValueError(f"no such level: {rule.level}")
        self.rules[rule.name] = rule

    def register(self, name: str, level: str, description: str, builder: Builder) -> None:
        """A rule of one's own: its builder may only emit its own name."""
        self.add(Rule(name, level, description, name))
        own = F.when(F.col("rule") == name, F.col("rule")).otherwise(F.raise_error(F.concat(F.lit(f"{name} emits "), F.col("rule"))).cast("string"))
        self.builders[name] = lambda model, context: builder(model, context).withColumn("rule", own)

    def listing(self) -> list[Rule]:
        return [self.rules[k] for k in sorted(self.rules)]

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame([(r.name, r.level, r.description) for r in self.listing()], "name string, level string, description string")

    def settings(self, raw: dict[str, Any] | None) -> dict[str, Setting]:
        """Settings as written: a truth value, a level, or a table with a level and options. Unknown rules are errors."""
        out = {}
        for name, value in (raw or {}).items():
            if name not in self.rules:
                raise ValueError(f"no such rule: {name}")
            if isinstance(value, Setting):
                out[name] = value
            elif isinstance(value, bool):
                out[name] = Setting(None if value else "off") if self.rules[name].level != "off" or not value else Setting("warning")
            elif isinstance(value, str):
                out[name] = Setting(value)
            elif isinstance(value, dict):
                out[name] = Setting(value.get("level"), {k: v for k, v in value.items() if k != "level"})
            else:
                raise ValueError(f"not a setting of {name}: {value!r}")
            if out[name].level not in (None, *LEVELS):
                raise ValueError(f"no such level: {out[name].level}")
        return out

    def level(self, name: str, settings: dict[str, Setting]) -> str:
        s = settings.get(name)
        return s.level if s and s.level else self.rules[name].level

    def run(self, model: Model, raw_settings: dict[str, Any] | None = None, context: Context | None = None) -> DataFrame:
        """The findings of all rules that aren't off, each range once for a rule, severity as set."""
        settings, context = self.settings(raw_settings), context or Context()
        context.options = {**{k: s.options for k, s in settings.items() if s.options}, **context.options}
        levels = {name: level for name in self.rules if (level := self.level(name, settings)) != "off"}
        groups = sorted({self.rules[name].group for name in levels})
        if not groups:
            return model.documents.sparkSession.createDataFrame([], FINDING)
        context.on = frozenset(levels)
        kinds = [self.kinds.get(g) for g in groups]
        if None not in kinds:
            model = model.narrowed(k for ks in kinds for k in ks)
        found = reduce(DataFrame.unionByName, [self.builders[g](model, context) for g in groups])
        severity = F.element_at(F.create_map(*[F.lit(x) for pair in sorted(levels.items()) for x in pair]), F.col("rule"))
        found = found.where(F.col("rule").isin(*levels)).withColumn("severity", severity)
        # once by document: the window, and later joins with the documents, need no other exchange
        first = Window.partitionBy("doc_id", "rule", "start", "end").orderBy("message")
        found = found.repartition("doc_id")
        return found.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def suggestion(title: Column, replacement: Column) -> Column:
    return F.struct(title.cast("string").alias("title"), replacement.cast("string").alias("replacement"))


def no_fix() -> Column:
    return F.lit(None).cast("struct<title:string,replacement:string>")


def no_suggestions() -> Column:
    return F.array().cast("array<struct<title:string,replacement:string>>")


def finding(rule: str, message: Column | str, start: Column | None = None, end: Column | None = None, suggestions: Column | None = None, fix: Column | None = None, data: dict[str, Column] | None = None) -> Column:
    """One finding as a struct; start, end: the row's own range."""
    message = F.lit(message) if isinstance(message, str) else message
    pairs = [x for k, v in (data or {}).items() for x in (F.lit(k), v.cast("string"))]
    return F.struct(
        F.lit(rule).alias("rule"),
        F.lit(None).cast("string").alias("severity"),
        message.alias("message"),
        (F.col("start") if start is None else start).cast("int").alias("start"),
        (F.col("end") if end is None else end).cast("int").alias("end"),
        (no_suggestions() if suggestions is None else suggestions).alias("suggestions"),
        (no_fix() if fix is None else fix).alias("fix"),
        (F.create_map(*pairs) if pairs else F.lit(None)).cast("map<string,string>").alias("data"),
    )


def emit(rows: DataFrame, *when: tuple[Column, Column]) -> DataFrame:
    """The findings of some conditions over the same rows, in one pass."""
    each = F.filter(F.array(*[F.when(c, f) for c, f in when]), lambda x: x.isNotNull())
    return rows.select("doc_id", F.inline(each))


def emit_matches(rows: DataFrame, matches: Column, message: Column | str = "", base: Column | None = None) -> DataFrame:
    """Findings of a column of array<struct<rule,start,end,message,replacement>>, offsets from ``base``."""
    each = rows.select("doc_id", (F.lit(0) if base is None else base).alias("_base"), F.explode(matches).alias("m"))
    text = F.col("m.message") if message == "" else message
    fix = F.when(F.col("m.replacement").isNotNull(), suggestion(F.concat(F.lit("Write "), F.col("m.replacement")), F.col("m.replacement"))).otherwise(no_fix())
    found = F.struct(
        F.col("m.rule").alias("rule"), F.lit(None).cast("string").alias("severity"), text.alias("message"), (F.col("_base") + F.col("m.start")).cast("int").alias("start"),
        (F.col("_base") + F.col("m.end")).cast("int").alias("end"), no_suggestions().alias("suggestions"), fix.alias("fix"), F.lit(None).cast("map<string,string>").alias("data"),
    )
    return each.select("doc_id", F.inline(F.array(found)))


def line_starts(text: str) -> list[int]:
    return [0, *(m.end() for m in re.finditer("\n", text))]


def placed(starts: list[int], points: list[int]) -> list[dict]:
    """Line and column of each point, from 1."""
    lines = [bisect_right(starts, p) for p in points]
    return [{"line": k, "column": p - starts[k - 1] + 1} for k, p in zip(lines, points)]


def diagnostics(findings: DataFrame, model: Model) -> DataFrame:
    """Findings with 1-based lines and columns. Only documents that have findings send something, where their lines begin;
    findings are dealt out by document already (``Registry.run``), so nothing else is shuffled or sorted."""
    starts = model.documents.select("doc_id", udf_of(line_starts, "array<int>")("text").alias("_starts"))
    both = findings.join(starts, "doc_id")
    at = udf_of(placed, "array<struct<line:int,column:int>>")(F.col("_starts"), F.array("start", "end"))
    both = both.withColumn("_at", at)
    place = {"line": "_at[0].line", "column": "_at[0].column", "end_line": "_at[1].line", "end_column": "_at[1].column"}
    return both.select(*findings.columns, *[F.expr(v).alias(k) for k, v in place.items()])


def names(rules: Iterable[Rule]) -> list[str]:
    return [r.name for r in rules]


REGISTRY = Registry()
