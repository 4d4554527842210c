"""Documents as a DataFrame (doc_id, path, text): from tables, from files, from one text; and back to files."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_SIZE = 1 << 20
INCLUDE = ("*.md",)
# Directories that hold no documents of one's own.
EXCLUDE = (
    ".git/", ".hg/", ".svn/", ".bzr/", "_darcs/", ".venv/", "venv/", "__pycache__/", ".tox/", ".nox/", ".mypy_cache/", ".ruff_cache/", ".pytest_cache/", ".eggs/", "*.egg-info/",
    "build/", "dist/", "node_modules/", ".next/", ".nuxt/", ".output/", ".cache/", ".parcel-cache/", ".turbo/", ".idea/", ".vscode/", ".vs/", ".fleet/",
    "coverage/", "htmlcov/", ".coverage/", "vendor/", "third_party/", "Pods/", "target/", ".terraform/",
)


@dataclass(frozen=True)
class Discovery:
    """Which files are documents. exclude, extra: patterns as in ignore files; max_size 0: no limit."""

    include: tuple[str, ...] = INCLUDE
    exclude: tuple[str, ...] = EXCLUDE
    extra: tuple[str, ...] = ()
    force_exclude: bool = False
    max_size: int = MAX_SIZE


def pattern_regex(pattern: str) -> tuple[str, bool]:
    """An ignore file's pattern as a regular expression over paths below the root, and whether it takes back."""
    back = pattern.startswith("!")
    body = pattern[back:].rstrip()
    only_dirs = body.endswith("/")
    body = body.rstrip("/")
    anchored = "/" in body
    out = []
    for piece in re.split(r"(\*\*/?|\*|\?|\[[^\]]*\])", body.lstrip("/")):
        if piece in ("**/", "**"):
            out.append("(?:.*/)?" if piece == "**/" else ".*")
        elif piece == "*":
            out.append("[^/]*")
        elif piece == "?":
            out.append("[^/]")
        elif piece.startswith("[") and piece.endswith("]"):
            out.append("[" + piece[1:-1].replace("!", "^", 1) + "]" if piece.startswith("[!") else piece)
        else:
            out.append(re.escape(piece))
    return ("^" if anchored else "(?:^|/)") + "".join(out) + ("/" if only_dirs else "(?:/|$)"), back


def ignore_patterns(text: str) -> list[str]:
    """The patterns of an ignore file, without comments and blank lines."""
    return [x.rstrip() for x in text.splitlines() if x.strip() and not x.startswith("#")]


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether a path below the root is ignored: the last pattern that fits decides."""
    out = F.lit(False)
    for p in patterns:
        regex, back = pattern_regex(p)
        out = F.when(path.rlike(regex), F.lit(not back)).otherwise(out)
    return out


def included(name: Column, patterns: tuple[str, ...]) -> Column:
    """Whether a file's name fits one of the patterns."""
    regex = "|".join(fnmatch.translate(p).replace(r"\Z", "$").replace("\\z", "$") for p in patterns)
    return name.rlike(regex)


def relative(path: Column, root: str) -> Column:
    """A path below ``root``; both may have a scheme."""
    bare = lambda c: F.regexp_replace(c, r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "/")
    start = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "/", root).rstrip("/")
    return F.regexp_replace(bare(path), "^" + re.escape(start) + "/?", "")


def wanted(path: Column, size: Column, root: str, discovery: Discovery, ignore: list[str] | None) -> Column:
    """Whether a file below ``root`` is a document."""
    keep = included(F.substring_index(path, "/", -1), discovery.include) & ~ignored(relative(path, root), [*discovery.exclude, *discovery.extra, *(ignore or [])])
    return keep & (size <= discovery.max_size) if discovery.max_size else keep


def files(spark: SparkSession, root: str, discovery: Discovery = Discovery(), ignore: list[str] | None = None) -> DataFrame:
    """path, size, below: the documents of a folder, at any depth and in any file system, sorted by path. Spark lists
    the files; only names and sizes are read here. ignore: patterns of the root's ignore files."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("size"), relative(F.col("path"), root).alias("below"))
    return found.where(wanted(F.col("path"), F.col("size"), root, discovery, ignore)).dropDuplicates(["path"]).orderBy("path")


def texts(spark: SparkSession, root: str, discovery: Discovery = Discovery(), ignore: list[str] | None = None) -> DataFrame:
    """doc_id, path, text of the documents of a folder: one scan. The conditions are on the files' metadata, so what
    isn't a document isn't opened, and nothing is joined or shuffled. doc_id: a hash of the path."""
    path, size = F.col("_metadata.file_path"), F.col("_metadata.file_size")
    found = spark.read.text(root, wholetext=True, recursiveFileLookup=True)
    found = found.where(wanted(F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path), size, root, discovery, ignore))
    return found.select(F.xxhash64(path).alias("doc_id"), path.alias("path"), F.col("value").alias("text"))


def glob_regex(path: str) -> str:
    """A Hadoop glob as a regular expression over paths without their scheme."""
    signs = {"*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")", ",": "|"}
    depth, out = 0, []
    for c in re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "/", path):
        depth += (c == "{") - (c == "}")
        out.append(signs[c] if c in signs and (c != "," or depth) else c if c in "[]" else re.escape(c))
    return "^" + "".join(out) + "$"


def named_files(spark: SparkSession, paths: list[str], discovery: Discovery = Discovery()) -> DataFrame:
    """path, size, below: files named one by one, or by Hadoop globs. Named files pass the exclusions unless
    ``force_exclude``; the limit on size holds. A path that isn't there is an error."""
    found = spark.read.format("binaryFile").load(paths).select(F.col("path"), F.col("length").alias("size"), F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "").alias("below"))
    globs = any(re.search(r"[*?\[{]", p) for p in paths)
    keep = F.concat(F.lit("/"), "below").rlike("|".join(map(glob_regex, paths)))  # not what lies in folders that fit
    if discovery.force_exclude:
        keep &= ~ignored(F.col("below"), [*discovery.exclude, *discovery.extra])
    if globs:
        keep &= included(F.substring_index("path", "/", -1), discovery.include)
    if discovery.max_size:
        keep &= F.col("size") <= discovery.max_size
    return found.where(keep).dropDuplicates(["path"]).orderBy("path")


def from_texts(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """doc_id, path, text of some texts by label, such as one from the standard input."""
    rows = [(k, label, text) for k, (label, text) in enumerate(texts.items())]
    return spark.createDataFrame(rows, "doc_id long, path string, text string")


def from_table(table: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, path, text of a table's rows."""
    return table.select(F.col(doc_id).alias("doc_id"), F.col(doc_id).cast("string").alias("path"), F.col(text).alias("text"))


def write_files(documents: DataFrame, backup: str | None = ".orig") -> DataFrame:
    """Write each row of ``documents`` (path, text, before) to its path, in any file system that Arrow knows; rows
    whose text is ``before`` aren't written. The old file is kept beside it with ``backup`` added to its name, unless that
    is there and newer texts are in the file: a task that runs again finds its own text and touches nothing. A new file is
    written under another name and moved, so readers never see half of one. Returns path, written, error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        for b in batches:
            out = []
            for path, text, before in zip(*(b.column(k).to_pylist() for k in range(3))):
                if text is None or text == before:
                    out.append((path, False, None))
                    continue
                try:
                    local = re.sub(r"^file:/+", "/", path)
                    system, where = (fs.LocalFileSystem(), local) if "://" not in local else fs.FileSystem.from_uri(local)
                    system.create_dir(where.rpartition("/")[0] or "/", recursive=True)
                    is_file = lambda p: system.get_file_info(p).type == fs.FileType.File  # noqa: B023, E731
                    held = None
                    if is_file(where):
                        with system.open_input_stream(where) as f:
                            held = f.read()
                    if held == text.encode():  # an earlier attempt's
                        out.append((path, True, None))
                        continue
                    if held is not None and backup and (not is_file(where + backup) or before is not None and held == before.encode()):
                        system.copy_file(where, where + backup)
                    temporary = f"{where}.{uuid.uuid4().hex}"
                    try:
                        with system.open_output_stream(temporary) as f:
                            f.write(text.encode())
                        system.move(temporary, where)
                    except OSError:
                        if is_file(temporary):
                            system.delete_file(temporary)
                        raise
                    out.append((path, True, None))
                except OSError as e:
                    out.append((path, False, str(e)))
            columns = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.bool_()), pa.array(columns[2], pa.string())], ["path", "written", "error"])

    return documents.select("path", "text", "before").mapInArrow(run, "path string, written boolean, error string")
