"""Fixes, suggestions and reports."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.arrow import udf_of
from lectern.lint.registry import Context, Registry
from lectern.plans.model import Model

ROUNDS = 10
APPLIED = "struct<text:string,applied:int>"


def splice(text: str, edits: list[dict]) -> dict:
    """Apply edits in source order; one that overlaps an earlier one waits for the next round."""
    out, at, n = [], 0, 0
    for e in sorted(edits or [], key=lambda e: (e["start"], e["end"], e["replacement"])):
        if e["start"] >= at and (n == 0 or e["start"] > 0):
            out += [text[at : e["start"]], e["replacement"]]
            at, n = e["end"], n + 1
    return {"text": "".join([*out, text[at:]]), "applied": n}


def spliced(text: Column, edits: Column) -> Column:
    return udf_of(splice, APPLIED)(text, edits)


def fix(documents: DataFrame, registry: Registry, settings: dict[str, Any] | None = None, context: Context | None = None, folder: str | None = None, rounds: int = ROUNDS) -> DataFrame:
    """``documents`` (doc_id, text) after all fixes, with how many were applied. A round fixes all documents at once;
    it ends when none has a fix left. folder: where the rounds' models are kept. Texts that are dealt out by
    document stay where they are, unless Spark's shuffle partitions are more than their parts."""
    from lectern.sources.session import cut

    now = cut(documents.select("doc_id", "text", F.lit(0).alias("applied")))
    n = now.rdd.getNumPartitions() or 1
    for k in range(rounds):
        model = Model(now.select("doc_id", "text"), f"{folder}/{k}" if folder else None)
        fixes = registry.run(model, settings, context).where("fix IS NOT NULL")
        edits = cut(fixes.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", F.col("fix.replacement").alias("replacement"))).alias("edits")))
        if edits.isEmpty():
            break
        made = now.join(edits.repartition(n, "doc_id"), "doc_id", "left").withColumn("r", spliced(F.col("text"), F.col("edits")))
        now = cut(made.select("doc_id", F.when(F.col("edits").isNull(), F.col("text")).otherwise(F.col("r.text")).alias("text"), (F.col("applied") + F.when(F.col("edits").isNull(), 0).otherwise(F.col("r.applied"))).alias("applied")))
    return now


def report_text(diagnostics: DataFrame, paths: DataFrame) -> DataFrame:
    """doc_id, line, column, report: a line for each diagnostic, with help for its suggestions. paths: doc_id, path."""
    helps = F.array_join(F.transform("suggestions", lambda s: F.concat(F.lit("\n  help: "), s["title"])), "")
    row = F.concat(F.format_string("%s:%d:%d: %s %s: %s", "path", "line", "column", "severity", "rule", "message"), helps)
    return diagnostics.join(paths, "doc_id").select("doc_id", "line", "column", row.alias("report"))


def report_json(diagnostics: DataFrame, paths: DataFrame) -> DataFrame:
    """path, report: one JSON object for each document with diagnostics."""
    one = F.struct("line", "column", "end_line", "end_column", "rule", "severity", "message", "suggestions", "fix", "data")
    each = diagnostics.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line", "column", "rule", F.to_json(one).alias("json")))).alias("d"))
    body = F.concat(F.lit('{"version":1,"path":'), F.to_json(F.array("path")).substr(F.lit(2), F.length(F.to_json(F.array("path"))) - 2), F.lit(',"diagnostics":['), F.array_join(F.transform("d", lambda x: x["json"]), ","), F.lit("]}"))
    return each.join(paths, "doc_id").select("path", body.alias("report"))


def exit_code(diagnostics: DataFrame, exit_zero: bool = False) -> int:
    """0 without findings, else 1."""
    return 0 if exit_zero or diagnostics.isEmpty() else 1


def rollup(findings: DataFrame) -> DataFrame:
    """rule, severity, n: counts with subtotals."""
    return findings.rollup("rule", "severity").agg(F.count("*").alias("n"))
