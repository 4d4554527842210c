"""Tables that rules look things up in: bibliographies, macros, vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.lint.tex import macros_column


def bibliography(texts: DataFrame) -> DataFrame:
    """key: the works of bibliographies (path, text), by the ending of their path: BibTeX, RIS, CSL as JSON or YAML."""
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    bib = F.regexp_extract_all("text", F.lit(r"(?m)^\s*@(?!(?i:comment|string|preamble)\b)\w+\s*[{(]\s*([^,\s{}()]+)\s*,"), F.lit(1))
    ris = F.regexp_extract_all("text", F.lit(r"(?m)^ID  - (\S+)"), F.lit(1))
    csl = F.from_json("text", "array<struct<id:string>>")
    yaml = F.regexp_extract_all("text", F.lit(r"(?m)^\s*(?:- )?id:\s*[\"']?([^\s\"']+)"), F.lit(1))
    keys = F.when(ending.isin("bib", "bibtex"), bib).when(ending == "ris", ris).when(ending == "json", F.transform(csl, lambda x: x["id"])).when(ending.isin("yaml", "yml"), yaml)
    return texts.select(F.explode(keys).alias("key")).where("key IS NOT NULL").distinct()


def macros(texts: DataFrame) -> DataFrame:
    """name, replacement, argument_count, optional_first: what TeX sources (path, text) and JSON maps define."""
    tex = texts.where(~F.lower("path").endswith(".json")).select(F.inline(macros_column("text")))
    mapped = texts.where(F.lower("path").endswith(".json")).select(F.explode(F.from_json("text", "map<string,string>")).alias("name", "replacement"))
    count = F.coalesce(F.array_max(F.transform(F.regexp_extract_all("replacement", F.lit("#([1-9])"), F.lit(1)), lambda x: x.cast("int"))), F.lit(0))
    return tex.unionByName(mapped.select(F.regexp_replace("name", r"^\\", "").alias("name"), "replacement", count.alias("argument_count"), F.lit(False).alias("optional_first"))).distinct()


def vocabulary(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(package, command) and (package, include) of a JSON index: core, and packages with commands and includes."""
    one = spark.read.option("multiLine", "true").schema("core array<string>, packages map<string,struct<commands:array<string>,includes:array<string>>>").json(path)
    return vocabulary_tables(one)


def vocabulary_tables(one: DataFrame) -> tuple[DataFrame, DataFrame]:
    core = one.select(F.lit("").alias("package"), F.explode("core").alias("command"))
    packages = one.select(F.explode("packages").alias("package", "p"))
    bare = F.regexp_replace("command", r"^\\", "")
    commands = core.unionByName(packages.select("package", F.explode("p.commands").alias("command"))).withColumn("command", bare).distinct()
    return commands, packages.select("package", F.explode("p.includes").alias("include")).distinct()


def packages_of(texts: DataFrame) -> DataFrame:
    """doc_id, package: what documents (doc_id, text) load."""
    names = F.regexp_extract_all("text", F.lit(r"\\(?:usepackage|RequirePackage)\s*(?:\[[^\]]*\]\s*)?\{([^{}]+)\}"), F.lit(1))
    kinds = F.regexp_extract_all("text", F.lit(r"\\documentclass\s*(?:\[[^\]]*\]\s*)?\{([^{}]+)\}"), F.lit(1))
    return texts.select("doc_id", F.explode(F.concat(names, kinds)).alias("names")).select("doc_id", F.explode(F.split("names", r"\s*,\s*")).alias("package")).where("package <> ''").distinct()
