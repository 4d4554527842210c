"""Commands: ``python -m lectern format|lint PATH...``. Documents are read, processed and written by Spark."""

from __future__ import annotations

import argparse
import importlib
import json
import os
import sys
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.lint import fix as fixes
from lectern.lint import rules  # noqa: F401
from lectern.lint.registry import LEVELS, REGISTRY, Context, Registry, diagnostics
from lectern.plans.formatter import SPACINGS, reformat_documents
from lectern.plans.model import Model
from lectern.sources import documents as docs
from lectern.sources import ignore, settings

#: Tables of the context, as JSON lists of objects.
CONTEXT = {
    "bibliography": "key string",
    "wikilinks": "name string, status string, relative boolean, canonical string, candidates array<string>",
    "files": "path string",
    "roots": "root string",
    "vocabulary": "package string, command string",
    "includes": "package string, include string",
    "macros": "name string, replacement string, argument_count int, optional_first boolean",
    "definitions": "key string",
    "messages": "doc_id long, level string, message string, start int",
    "compile_errors": "doc_id long, message string, start int, end int",
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lectern")
    commands = top.add_subparsers(dest="command", required=True)
    both = argparse.ArgumentParser(add_help=False)
    both.add_argument("paths", nargs="*", default=["."], help="files, folders, globs, or - for the standard input")
    both.add_argument("--config", help="a settings file; else the nearest one")
    both.add_argument("--no-config", action="store_true")
    both.add_argument("--extend-include", action="append")
    both.add_argument("--exclude", action="append")
    both.add_argument("--extend-exclude", action="append")
    both.add_argument("--respect-gitignore", action=argparse.BooleanOptionalAction, default=None)
    both.add_argument("--force-exclude", action="store_true", default=None)
    both.add_argument("--files-max-size", type=int)
    both.add_argument("--list-files", action="store_true")
    f = commands.add_parser("format", parents=[both])
    f.add_argument("-o", "--output", default="-")
    f.add_argument("-w", "--width", type=int)
    f.add_argument("-p", "--plaintext", dest="plain", action="store_true", default=None)
    f.add_argument("-s", "--semantic", action="store_true", default=None)
    f.add_argument("-c", "--cleanups", action="store_true", default=None)
    f.add_argument("--smartquotes", action="store_true", default=None)
    f.add_argument("--ellipses", action="store_true", default=None)
    f.add_argument("--list-spacing", choices=SPACINGS)
    f.add_argument("-i", "--inplace", action="store_true")
    f.add_argument("--nobackup", action="store_true")
    f.add_argument("--auto", action="store_true", help="in place, without backups, semantic, all passes")
    n = commands.add_parser("lint", parents=[both])
    n.add_argument("--format", choices=("text", "json"), default="text")
    n.add_argument("--fix", action="store_true")
    n.add_argument("--exit-zero", action="store_true")
    n.add_argument("--style", action="append", default=[], help="turn a style rule on")
    n.add_argument("--max-line-length", type=int)
    n.add_argument("--source-path", default="-", help="what the standard input is called")
    n.add_argument("--rule", action="append", default=[], metavar="NAME=LEVEL")
    n.add_argument("--plugin", action="append", default=[], metavar="MODULE:FUNCTION")
    n.add_argument("--context", help="a JSON object of tables")
    n.add_argument("--list-rules", action="store_true")
    return top


def found_settings(args: argparse.Namespace) -> settings.Settings:
    if args.no_config:
        return settings.Settings()
    if args.config:
        with open(args.config, encoding="utf-8") as f:
            return settings.parse(f.read(), args.config, args.config.endswith("pyproject.toml"))
    first = args.paths[0] if args.paths[0] != "-" else "."
    near = settings.find(first if os.path.isdir(first) else os.path.dirname(os.path.abspath(first)))
    return near[1] if near else settings.Settings()


def listed(spark: SparkSession, args: argparse.Namespace, found: settings.Settings) -> DataFrame | None:
    """path of each document; None for the standard input."""
    if args.paths == ["-"]:
        return None
    d = found.discovery()
    d = replace(
        d,
        include=d.include + tuple(args.extend_include or ()),
        exclude=tuple(args.exclude) if args.exclude else d.exclude,
        extra=d.extra + tuple(args.extend_exclude or ()),
        force_exclude=d.force_exclude if args.force_exclude is None else True,
        max_size=d.max_size if args.files_max_size is None else args.files_max_size,
    )
    git = args.respect_gitignore if args.respect_gitignore is not None else found.formatting.get("respect-gitignore", True)
    frames = []
    named = [p for p in args.paths if not os.path.isdir(p)]
    for p in args.paths:
        if os.path.isdir(p):
            frames.append(docs.files(spark, os.path.abspath(p), d, [*(ignore.gitignore_patterns(p) if git else []), *ignore.tool_patterns(p)]))
    if named:
        frames.append(docs.named_files(spark, [p if "://" in p else os.path.abspath(p) for p in named], d))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.dropDuplicates(["path"]).orderBy("path")


def texts(spark: SparkSession, args: argparse.Namespace, files: DataFrame | None, label: str = "-") -> DataFrame:
    if files is None:
        return docs.from_texts(spark, {label: sys.stdin.read()})
    raw = spark.read.format("binaryFile").load([r.path for r in files.select("path").collect()])
    return raw.select(F.xxhash64("path").alias("doc_id"), "path", F.decode("content", "UTF-8").alias("text"))


def shown(path: str) -> str:
    bare = path.removeprefix("file:")
    return os.path.relpath(bare) if bare.startswith("/") else path


def run_format(spark: SparkSession, args: argparse.Namespace) -> int:
    found = found_settings(args)
    if args.auto:
        args.semantic = args.cleanups = args.smartquotes = args.ellipses = args.inplace = args.nobackup = True
    options = found.options(**{k: getattr(args, k) for k in ("width", "plain", "semantic", "cleanups", "smartquotes", "ellipses", "list_spacing")})
    files = listed(spark, args, found)
    if args.list_files:
        print("\n".join(shown(r.path) for r in files.collect()) if files is not None else "-")
        return 0
    if args.inplace and files is None:
        raise ValueError("the standard input has no place")
    made = reformat_documents(texts(spark, args, files), options)
    if args.inplace:
        from lectern.sources.session import cut

        made = cut(made)
        good = made.where("status = 'ok'").select("path", F.col("formatted").alias("text"), F.col("text").alias("before"))
        wrong = docs.write_files(good, None if args.nobackup else ".orig").where("error IS NOT NULL").collect()
        for r in wrong:
            print(f"{shown(r.path)}: {r.error}", file=sys.stderr)
        if wrong:
            return 2
    refused = 0
    out = []
    for r in made.orderBy("path").select("path", "status", "formatted", "error", "unasked").toLocalIterator():
        if r.status == "refused":
            refused += 1
            print(f"{shown(r.path)}: refused: {r.error}", file=sys.stderr)
        for name in r.unasked or []:
            print(f"{shown(r.path)}: {name} applied", file=sys.stderr)
        if not args.inplace:
            out.append(r.formatted)
            if args.output == "-":
                sys.stdout.write(out.pop())
    if not args.inplace and args.output != "-":
        if len(out) != 1:
            raise ValueError("one document goes to one output")
        docs.write_files(spark.createDataFrame([(os.path.abspath(args.output), out[0], None)], "path string, text string, before string"), None).collect()
    return int(refused > 0)


def context_of(spark: SparkSession, raw: dict[str, Any]) -> Context:
    unknown = set(raw) - set(CONTEXT)
    if unknown:
        raise ValueError(f"no such context: {', '.join(sorted(unknown))}")
    rows = {k: [tuple(r.get(c.strip().split()[0]) for c in CONTEXT[k].split(", ")) for r in v] for k, v in raw.items()}
    return Context({k: spark.createDataFrame(v, CONTEXT[k]) for k, v in rows.items()})


def plugin(registry: Registry, name: str) -> None:
    """A function, or a module with ``register``, that adds rules to the registry."""
    module, _, function = name.partition(":")
    found = importlib.import_module(module)
    (getattr(found, function) if function else found.register)(registry)


def run_lint(spark: SparkSession, args: argparse.Namespace) -> int:
    found = found_settings(args)
    for name in [*found.lint.get("plugins", []), *args.plugin]:
        plugin(REGISTRY, name)
    if args.list_rules:
        rows = [{"name": r.name, "level": r.level, "description": r.description} for r in REGISTRY.listing()]
        print(json.dumps(rows, indent=1) if args.format == "json" else "\n".join(f"{r['name']} ({r['level']}): {r['description']}" for r in rows))
        return 0
    raw: dict[str, Any] = {f"style/{s.removeprefix('style/')}": "warning" for s in [*found.lint.get("style", []), *args.style]}
    length = args.max_line_length or found.lint.get("max-line-length")
    if length:
        raw["style/line-length"] = {"level": "warning", "max": length}
    raw |= found.lint.get("rules", {})
    for pair in args.rule:
        name, _, level = pair.partition("=")
        raw[name] = level if level in LEVELS else level not in ("false", "no")
    path = args.context or found.lint.get("context")
    context = Context()
    if path:
        with open(path, encoding="utf-8") as f:
            context = context_of(spark, json.load(f))
    files = listed(spark, args, found)
    if args.list_files:
        print("\n".join(shown(r.path) for r in files.collect()) if files is not None else "-")
        return 0
    all_texts = texts(spark, args, files, args.source_path)
    if args.fix:
        if files is None:
            raise ValueError("the standard input can't be fixed")
        fixed = fixes.fix(all_texts.select("doc_id", "text"), REGISTRY, raw, context).select("doc_id", F.col("text").alias("fixed"))
        both = all_texts.join(fixed, "doc_id")
        docs.write_files(both.select("path", F.col("fixed").alias("text"), F.col("text").alias("before")), None).collect()
        all_texts = both.select("doc_id", "path", F.col("fixed").alias("text"))
    model = Model(all_texts)
    out = diagnostics(REGISTRY.run(model, raw, context), model)
    paths = all_texts.select("doc_id", "path")
    if args.format == "json":
        files_json = [json.loads(r.report) for r in fixes.report_json(out, paths).orderBy("path").toLocalIterator()]
        n = len(files_json)
        print(json.dumps({"version": 1, "files": [{"path": shown(x["path"]), "diagnostics": x["diagnostics"]} for x in files_json]}))
    else:
        n = 0
        for r in fixes.report_text(out, paths).orderBy("doc_id", "line", "column").toLocalIterator():
            n += 1
            print(r.report)
    return 0 if args.exit_zero or not n else 1


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("lectern").getOrCreate()
    try:
        return run_format(spark, args) if args.command == "format" else run_lint(spark, args)
    except (OSError, ValueError) as e:
        print(f"lectern: {e}", file=sys.stderr)
        return 2
