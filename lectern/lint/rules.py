"""The rules over the document model. Each group makes the findings of its rules in one pass over its table."""

from __future__ import annotations

import mimetypes
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.lint import prose, tex
from lectern.lint.registry import FINDING, REGISTRY, Context, emit, emit_matches, finding, no_fix, suggestion
from lectern.operators.similar import package_closure, similar_names
from lectern.plans.model import Model, not_within


def decoded(url: Column) -> Column:
    """A URL's text with its %-escapes read; as it stands where one is malformed."""
    return F.coalesce(F.try_url_decode(url), url)


def resolved(path: Column) -> Column:
    """A path without `.`, `..` and empty parts; `..` that lead out of the whole stay."""
    step = lambda seen, x: (
        F.when(x.isin("", "."), seen)
        .when((x == "..") & (F.size(seen) > 0) & (F.coalesce(F.element_at(seen, -1), F.lit("")) != ".."), F.slice(seen, F.lit(1), F.greatest(F.size(seen) - 1, F.lit(0))))
        .otherwise(F.concat(seen, F.array(x)))
    )
    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.concat(F.when(path.startswith("/"), F.lit("/")).otherwise(F.lit("")), F.array_join(parts, "/"))


def beside(model: Model, rows: DataFrame, path: str = "path") -> DataFrame:
    """``rows`` (doc_id, path, ...) with paths as from the folder of their document; as from the whole where documents have no path."""
    if "path" not in model.documents.columns:
        return rows.withColumn(path, resolved(F.col(path)))
    folders = model.documents.select("doc_id", F.regexp_extract("path", r"^(.*/)?[^/]*$", 1).alias("_folder"))
    whole = F.when(F.col(path).startswith("/"), F.col(path)).otherwise(F.concat("_folder", path))
    return rows.join(folders, "doc_id").withColumn(path, resolved(whole)).drop("_folder")


def lit_in(c: Column, names) -> Column:
    return c.isin(*sorted(names))


def nothing(model: Model) -> DataFrame:
    return model.documents.sparkSession.createDataFrame([], FINDING)


def union(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


# Link texts that say nothing.
NON_DESCRIPTIVE = ("click here", "here", "link", "this link", "more", "read more", "learn more")


@REGISTRY.group(
    "links",
    ("accessibility/image-alt", "warning", "An image needs a text"),
    ("link/empty-destination", "warning", "A link needs a destination"),
    ("link/non-descriptive-text", "warning", "A link's text says where it leads"),
    kinds=("link", "image"),
)
def links(model: Model, context: Context) -> DataFrame:
    shown = F.trim(F.coalesce(F.col("text"), F.lit("")))
    return emit(
        model.of("link", "image"),
        ((F.col("kind") == "image") & (shown == ""), finding("accessibility/image-alt", "the image has no text")),
        ((F.col("kind") == "link") & (F.coalesce("url", F.lit("")) == ""), finding("link/empty-destination", "the link leads nowhere")),
        ((F.col("kind") == "link") & F.lower(shown).isin(*NON_DESCRIPTIVE), finding("link/non-descriptive-text", F.concat(F.lit("`"), shown, F.lit("` does not say where the link leads")))),
    )


@REGISTRY.group(
    "code",
    ("code/hard-tab", "warning", "Code without tabs"),
    ("code/missing-language", "warning", "A fence names its language"),
    ("tikz/fence-attributes", "error", "A diagram's fence has no other attributes"),
    kinds=("code_block",),
)
def code(model: Model, context: Context) -> DataFrame:
    rows = model.fences
    language = F.coalesce(F.get("classes", F.lit(0)), F.regexp_extract("info", r"^\{?\s*([\w+#.-]+)", 1))
    diagram = F.regexp_extract("info", r"^\{?\s*\.?(tikzcd|tikz)\b", 1)
    local = emit(
        rows,
        (F.trim(F.coalesce(language, F.lit(""))) == "", finding("code/missing-language", "the fence names no language")),
        (
            (diagram != "") & ~F.col("info").rlike(r"^(?:\{\s*\.?(?:tikzcd|tikz)\s*\}|tikzcd|tikz)$"),
            finding("tikz/fence-attributes", "a diagram's fence takes no other attributes", suggestions=F.array(suggestion(F.lit("Keep the name alone"), diagram))),
        ),
    )
    if not context.wants("code/hard-tab"):
        return local
    fenced = model.lines.join(rows.select("doc_id", F.col("start").alias("f0"), F.col("end").alias("f1")), "doc_id").where("start > f0 AND end < f1")
    at = F.col("start") + F.locate("\t", F.col("text")) - 1
    return local.unionByName(emit(fenced, (F.locate("\t", F.col("text")) > 0, finding("code/hard-tab", "a tab in code", at, at + 1))))


@REGISTRY.group(
    "headings",
    ("heading/duplicate", "warning", "Titles differ"),
    ("heading/increment", "warning", "Levels go down one at a time"),
    ("heading/multiple-h1", "warning", "One first-level heading"),
    ("style/heading-punctuation", "off", "A title ends without a mark"),
    ("structure/heading-in-fenced-div", "warning", "Headings stand outside of divs"),
    kinds=("heading",),
)
def headings(model: Model, context: Context) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy("start")
    title = F.lower(F.trim(F.col("text")))
    same = Window.partitionBy("doc_id", title).orderBy("start")
    rows = model.headings.select(
        "*",
        F.lag("level").over(order).alias("before"),
        F.row_number().over(same).alias("nth"),
        F.first("start").over(same).alias("first_at"),
        F.sum((F.col("level") == 1).cast("int")).over(order).alias("h1"),
    )
    return emit(
        rows,
        ((F.col("nth") > 1) & (title != ""), finding("heading/duplicate", F.concat(F.lit("the title `"), F.col("text"), F.lit("` stands above already")), data={"first_start": F.col("first_at")})),
        (F.col("level") > F.col("before") + 1, finding("heading/increment", F.concat(F.lit("level "), F.col("level"), F.lit(" after level "), F.col("before")))),
        ((F.col("level") == 1) & (F.col("h1") > 1), finding("heading/multiple-h1", "another first-level heading")),
        (F.trim(F.col("text")).rlike(r"[.,;:!?]$"), finding("style/heading-punctuation", "the title ends with a mark")),
        (F.col("div_depth") > 0, finding("structure/heading-in-fenced-div", "a heading inside of a div")),
    )


@REGISTRY.group("required_h1", ("style/required-h1", "off", "A document has a first-level heading"), kinds=("heading",))
def required_h1(model: Model, context: Context) -> DataFrame:
    without = model.documents.select("doc_id").join(model.headings.where("level = 1").select("doc_id").distinct(), "doc_id", "left_anti")
    return emit(without, (F.lit(True), finding("style/required-h1", "no first-level heading", F.lit(0), F.lit(0))))


# Classes of divs that are statements, proofs, and which class an identifier's prefix belongs to.
STATEMENTS = ("theorem", "lemma", "corollary", "proposition", "conjecture", "definition", "exercise", "claim", "fact", "notation", "problem", "question")
PROOFS = ("proof", "solution")
PREFIXES = {"theorem": "thm", "lemma": "lem", "corollary": "cor", "proposition": "prp", "conjecture": "cnj", "definition": "def", "example": "exm", "exercise": "exr", "remark": "rem"}
REFERENCEABLE = tuple(PREFIXES)
FAMILIES = {"thm": "theorem", "lem": "lemma", "cor": "corollary", "prp": "proposition", "prop": "proposition", "cnj": "conjecture", "conj": "conjecture", "def": "definition", "exm": "example", "exr": "exercise", "rem": "remark"}


@REGISTRY.group(
    "divs",
    ("structure/nested-fenced-div", "warning", "Divs aren't nested"),
    ("reference/multiple-theorem-classes", "error", "One theorem class"),
    ("reference/theorem-proof-class-conflict", "error", "A theorem or a proof"),
    ("reference/proof-id-no-target", "info", "A proof's identifier is no target"),
    ("reference/missing-theorem-class", "error", "A theorem's identifier needs its class"),
    ("reference/class-family-mismatch", "error", "Class and identifier agree"),
    kinds=("div",),
)
def divs(model: Model, context: Context) -> DataFrame:
    classes = F.coalesce("classes", F.array().cast("array<string>"))
    theorem = F.array_intersect(classes, F.array(*map(F.lit, REFERENCEABLE)))
    proof = F.arrays_overlap(classes, F.array(*map(F.lit, PROOFS)))
    prefix = F.regexp_extract(F.coalesce("ident", F.lit("")), r"^([a-z]+)[:-]", 1)
    family = F.element_at(F.create_map(*[F.lit(x) for p in FAMILIES.items() for x in p]), prefix)
    own = F.get(theorem, F.lit(0))
    right = F.concat(F.element_at(F.create_map(*[F.lit(x) for p in PREFIXES.items() for x in p]), own), F.regexp_extract("ident", r"([:-].*)$", 1))
    return emit(
        model.divs,
        (F.col("div_depth") > 0, finding("structure/nested-fenced-div", "a div inside of a div")),
        (F.size(theorem) > 1, finding("reference/multiple-theorem-classes", F.concat(F.lit("classes "), F.array_join(theorem, ", ")))),
        ((F.size(theorem) > 0) & proof, finding("reference/theorem-proof-class-conflict", "a theorem's class and a proof's")),
        (proof & F.col("ident").isNotNull(), finding("reference/proof-id-no-target", "nothing refers to a proof's identifier")),
        (family.isNotNull() & (F.size(theorem) == 0) & ~proof, finding("reference/missing-theorem-class", F.concat(F.lit("the identifier is a "), family, F.lit("'s, the div has no such class")))),
        ((F.size(theorem) == 1) & family.isNotNull() & (family != own), finding("reference/class-family-mismatch", F.concat(F.lit("class "), own, F.lit(", identifier "), F.col("ident")), suggestions=F.array(suggestion(F.lit("Rename the identifier"), right)))),
    )


@REGISTRY.group("statement", ("structure/statement-boundary", "warning", "Proofs and examples stand outside of statements"))
def statement(model: Model, context: Context) -> DataFrame:
    classes = F.coalesce("classes", F.array().cast("array<string>"))
    outer = model.divs.where(F.arrays_overlap(classes, F.array(*map(F.lit, STATEMENTS)))).select("doc_id", F.col("start").alias("s0"), F.col("end").alias("s1"))
    inner = model.divs.where(F.arrays_overlap(classes, F.array(*map(F.lit, (*PROOFS, "example"))))).select("doc_id", "start", "end")
    raw = model.of("raw_block").where(F.col("text").rlike(r"\\begin\{(?:proof|example|solution)\}")).select("doc_id", "start", "end")
    said = model.of("para", "plain").where(F.col("text").rlike(r"^Proof\b")).select("doc_id", "start", "end")
    within = union(inner, raw, said).join(outer, "doc_id").where("start > s0 AND end <= s1").select("doc_id", "start", "end").distinct()
    return emit(within, (F.lit(True), finding("structure/statement-boundary", "a proof or example inside of a statement")))


@REGISTRY.group("identifiers", ("pandoc/duplicate-identifier", "error", "Identifiers are unique"), kinds=("heading", "div", "code_block", "span", "link", "image"))
def identifiers(model: Model, context: Context) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("doc_id", "ident").orderBy("start"))
    return emit(model.identifiers.withColumn("nth", nth), (F.col("nth") > 1, finding("pandoc/duplicate-identifier", F.concat(F.lit("the identifier `"), F.col("ident"), F.lit("` is used above")))))


@REGISTRY.group("fragments", ("link/invalid-fragment", "warning", "A fragment names an identifier"), kinds=("heading", "div", "code_block", "span", "link", "image", "autolink", "bare_url"))
def fragments(model: Model, context: Context) -> DataFrame:
    wanted = model.links.where("kind = 'link' AND url LIKE '#_%'").select("doc_id", "start", "end", decoded(F.expr("substring(url, 2)")).alias("ident"))
    known = model.identifiers.select("doc_id", "ident").distinct()
    missing = wanted.join(known, ["doc_id", "ident"], "left_anti")
    if "path" in model.documents.columns:  # fragments of other documents of the run
        paths = model.documents.select("doc_id", "path")
        links = model.links.where("kind = 'link'").where(F.col("url").rlike(r"^(?![A-Za-z][A-Za-z0-9+.-]*:|/)[^#?]+#."))
        named = links.select("doc_id", "start", "end", decoded(F.regexp_extract("url", "#(.*)$", 1)).alias("ident"), decoded(F.regexp_replace("url", "#.*$", "")).alias("path"))
        there = beside(model, named)
        paths = paths.withColumn("path", resolved(F.col("path")))
        there = there.join(paths.select(F.col("doc_id").alias("target"), "path"), "path")
        lost = there.join(known.select(F.col("doc_id").alias("target"), "ident"), ["target", "ident"], "left_anti")
        missing = missing.unionByName(lost.select(*missing.columns))
    return emit(missing, (F.lit(True), finding("link/invalid-fragment", F.concat(F.lit("no `#"), F.col("ident"), F.lit("` in the document")))))


@REGISTRY.group(
    "files",
    ("link/missing-local-target", "warning", "Linked files exist"),
    ("pandoc/missing-resource", "warning", "Files that the frontmatter names exist"),
    ("tex/missing-resource", "warning", "Files that TeX reads exist"),
)
def files(model: Model, context: Context) -> DataFrame:
    """Context: files (path), all there are, and optionally roots (root) that TeX searches. Silent without. Links and what the
    frontmatter names are read from the document's own folder, where documents have a path."""
    if "files" not in context.tables:
        return nothing(model)
    there = context.tables["files"].select(resolved(F.col("path")).alias("path")).distinct()
    local = model.links.where("kind IN ('link', 'image') AND url <> ''").where(~F.col("url").rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:|//|#)"))
    local = beside(model, local.select("doc_id", "start", "end", decoded(F.regexp_replace("url", r"[?#].*$", "")).alias("path")).where("path <> ''"))
    named = model.frontmatter.select("doc_id", "start", "end", F.explode(F.split("text", "\n")).alias("line"))
    named = named.select("doc_id", "start", "end", F.regexp_extract("line", r"^\s*(?:bibliography|csl|template|include-(?:in-header|before-body|after-body))\s*:\s*[\"']?([^\"'#]+?)[\"']?\s*$", 1).alias("path")).where("path <> ''")
    named = beside(model, named)
    read = model.of("raw_inline", "raw_block").where("info = 'tex'").select("doc_id", F.col("start").alias("base"), F.explode(tex.resources_column("text")).alias("r"))
    read = read.select("doc_id", (F.col("base") + F.col("r.start")).alias("start"), (F.col("base") + F.col("r.end")).alias("end"), F.col("r.path").alias("path"), F.col("r.endings").alias("endings"))
    # TeX tries endings and folders: names meet files by the files' last parts, and what is before those is a folder that is searched
    tries = read.select("doc_id", "start", "path", F.explode("endings").alias("ending")).select("doc_id", "start", resolved(F.concat("path", "ending")).alias("tail"))
    parts = F.split("path", "/")
    cut = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, F.lit(1), k - 1), "/").alias("root"), F.array_join(F.slice(parts, k, F.size(parts)), "/").alias("tail"))))
    tails = there.select(cut.alias("c")).select("c.root", "c.tail")
    roots = context.tables["files"].sparkSession.range(1).select(F.lit("").alias("root"))
    if "roots" in context.tables:
        roots = roots.unionByName(context.tables["roots"].select(resolved(F.col("root")).alias("root"))).distinct()
    found = tries.join(tails.join(roots, "root", "left_semi").select("tail").distinct(), "tail", "left_semi").select("doc_id", "start").distinct()
    lost = read.join(found, ["doc_id", "start"], "left_anti")
    said = lambda what: F.concat(F.lit(what), F.col("path"), F.lit("`"))
    return union(
        emit(local.join(there, "path", "left_anti"), (F.lit(True), finding("link/missing-local-target", said("there is no file `")))),
        emit(named.join(there, "path", "left_anti"), (F.lit(True), finding("pandoc/missing-resource", said("there is no file `")))),
        emit(lost, (F.lit(True), finding("tex/missing-resource", said("there is no file `")))),
    )


@REGISTRY.group("file_path", ("link/file-path", "error", "Files are linked, not quoted"))
def file_path(model: Model, context: Context) -> DataFrame:
    """Inline code, outside of links, that names a file: a rooted path, a path with an ending, or a name whose ending is a
    known type of file (Python's table of types, and context table endings (ending), each with or without a point)."""
    names = F.lower(F.regexp_extract(F.col("text"), r"^[\w.-]+\.([A-Za-z][A-Za-z0-9]{0,7})$", 1))
    known = lit_in(names, (x[1:] for x in mimetypes.types_map))
    if "endings" in context.tables:
        more = model.of("code").where("NOT in_link").join(context.tables["endings"].select(F.lower(F.ltrim("ending", F.lit("."))).alias("ending")).distinct(), names == F.col("ending"), "left_semi")
    else:
        more = None
    rooted = F.col("text").rlike(r"^(?:~|\.{1,3}|…)?/[\w.~-][^\s]*$")
    with_ending = F.col("text").rlike(r"^[^\s`]*/[^\s`]*\.[A-Za-z][A-Za-z0-9]{0,7}$") & ~F.col("text").rlike(r"^[a-z]+://")
    said = finding("link/file-path", F.concat(F.lit("`"), F.col("text"), F.lit("` names a file; link to it")))
    found = emit(model.of("code").where("NOT in_link"), (rooted | with_ending | known, said))
    return found if more is None else found.unionByName(emit(more, (~(rooted | with_ending | known), said)))


@REGISTRY.group(
    "formulas",
    *[(f"math/{n}", level, text) for n, level, text in (
        ("bare-operator", "warning", "Operators are commands"), ("subset-notation", "warning", "Inclusions are morphisms"), ("set-operation-notation", "warning", "Set operations are constructions"),
        ("repeated-subscript", "error", "One subscript"), ("repeated-superscript", "error", "One superscript"), ("unclosed-group", "error", "Groups close"), ("unclosed-left", "error", "\\left has \\right"),
        ("unmatched-group-close", "error", "Groups open"), ("unmatched-right", "error", "\\right has \\left"),
    )],
    kinds=("math",),
)
def formulas(model: Model, context: Context) -> DataFrame:
    return emit_matches(model.math, tex.formula_column("text"), base=F.col("tex_start"))


@REGISTRY.group(
    "surroundings",
    ("math/display-economy", "warning", "Short formulas stand in the line"),
    ("math/structural-sequence-display", "error", "Exact sequences are displayed"),
    ("prose/untyped-vague-claim", "warning", "Claims come with a formula"),
    ("prose/untyped-map-reference", "warning", "Maps come with their arrow"),
    kinds=(),
)
def surroundings(model: Model, context: Context) -> DataFrame:
    return emit_matches(model.documents, prose.in_context_column("text"))


@REGISTRY.group(
    "prose",
    ("math/outside-math-mode", "warning", "TeX stands in formulas"),
    ("math/unicode-symbol", "warning", "Symbols are TeX"),
    ("document/authorial-residue", "info", "Nothing is left from drafting"),
    ("link/reference-format", "error", "Cross-references begin with @"),
    ("tikz/environment-wrapper", "error", "Diagrams stand in fences"),
    kinds=("text", "raw_inline", "raw_block"),
)
def prose_rules(model: Model, context: Context) -> DataFrame:
    found = emit_matches(model.of("text"), prose.prose_column("text"), base=F.col("start"))
    raw = emit_matches(model.of("raw_inline", "raw_block").where("info = 'tex'"), prose.raw_tex_column("text"), base=F.col("start"))
    outside = emit(model.of("raw_inline").where("info = 'tex'"), (~F.col("text").rlike(r"^\\(?:todo|begin|end|input|include|includegraphics|cite|ref|label)\b"), finding("math/outside-math-mode", F.concat(F.lit("`"), F.col("text"), F.lit("` is TeX outside of math")))))
    return union(found, raw, outside)


LITERAL = ("code_block", "frontmatter", "math", "code", "raw_block", "definition", "autolink")


@REGISTRY.group(
    "lines",
    ("style/line-length", "off", "Lines aren't too long"),
    ("style/bare-url", "off", "URLs stand in angle brackets"),
    ("style/no-inline-html", "off", "No HTML in the text"),
    kinds=LITERAL,
)
def line_rules(model: Model, context: Context) -> DataFrame:
    """Marks are looked for in whole texts, whose lines then needn't be rows."""
    literal = model.of(*LITERAL).select("doc_id", "start", "end").where("end > start")
    found = emit_matches(model.documents, prose.marks_column("text"))
    if context.wants("style/line-length"):
        most = int(context.option("style/line-length", "max", 120))
        found = found.unionByName(emit(model.lines, (F.length("text") > most, finding("style/line-length", F.concat(F.length("text"), F.lit(f" characters, more than {most}"))))))
    return not_within(found, literal)


@REGISTRY.group(
    "markers",
    ("style/unordered-list-marker", "off", "Bullets of a level are the same"),
    ("style/fence-marker", "off", "Fences are the same"),
    kinds=("item", "bullet_list", "code_block"),
)
def markers(model: Model, context: Context) -> DataFrame:
    items = model.of("item").join(model.of("bullet_list").select("doc_id", F.col("node_id").alias("parent_id")), ["doc_id", "parent_id"], "left_semi")
    items = items.withColumn("first", F.first("info").over(Window.partitionBy("doc_id", "depth").orderBy("start")))
    fences = model.fences.withColumn("first", F.first("marker").over(Window.partitionBy("doc_id").orderBy("start")))
    at = F.col("start")
    return union(
        emit(items, (F.col("info") != F.col("first"), finding("style/unordered-list-marker", F.concat(F.lit("the marker is `"), F.col("info"), F.lit("`, that of the first item `"), F.col("first"), F.lit("`")), at, at + 1, fix=suggestion(F.lit("Use the first marker"), F.col("first"))))),
        emit(fences, (F.col("marker") != F.col("first"), finding("style/fence-marker", "another marker than the first fence's"))),
    )


@REGISTRY.group("numbering", ("numbering/manual", "error", "Numbers aren't set by hand"))
def numbering(model: Model, context: Context) -> DataFrame:
    first = Window.partitionBy("doc_id", "parent_id").orderBy("node_id")
    texts = model.of("text", "strong").withColumn("nth", F.row_number().over(first))
    paras = model.of("para", "plain").select("doc_id", F.col("node_id").alias("parent_id"))
    labels = texts.where("nth = 1").join(paras, ["doc_id", "parent_id"], "left_semi").select("doc_id", F.col("start"), F.regexp_replace("text", r"^\*\*", "").alias("text"), F.lit("label").alias("at"))
    sources = union(
        model.headings.select("doc_id", (F.col("start") + F.when(F.col("level") > 0, F.col("level") + 1)).cast("int").alias("start"), "text", F.lit("heading").alias("at")),
        labels.select("doc_id", "start", "text", "at"),
        model.math.select("doc_id", F.col("tex_start").alias("start"), "text", F.lit("tag").alias("at")),
        model.of("text").select("doc_id", "start", "text", F.lit("prose").alias("at")),
    )
    sources = sources.where(F.col("text").rlike(r"(?U)\d"))  # the others never reach Python
    found = sources.select("doc_id", F.col("start").alias("base"), F.explode(prose.numbers_column(F.col("text"), F.col("at"))).alias("n")).select("doc_id", "base", "n.*")
    declared = found.where("declares")
    refers = found.where("NOT declares").join(declared.select("doc_id", "family", "number").distinct(), ["doc_id", "family", "number"], "left_semi")
    start, end = F.col("base") + F.col("start"), F.col("base") + F.col("end")
    # a label that opens a paragraph is read as a reference too: only the declaration counts
    refers = refers.join(declared.select("doc_id", "base").distinct(), ["doc_id", "base"], "left_anti").select(*declared.columns)
    return emit(declared.unionByName(refers), (F.lit(True), finding("numbering/manual", F.concat(F.lit("the number "), F.col("number"), F.lit(" is set by hand")), start, end, data={"family": F.col("family")})))


@REGISTRY.group(
    "paragraphs",
    ("structure/bold-label", "warning", "Labels are headings or divs"),
    ("structure/yaml-in-body", "error", "Metadata stands in the frontmatter"),
)
def paragraphs(model: Model, context: Context) -> DataFrame:
    first = Window.partitionBy("doc_id", "parent_id").orderBy("node_id")
    children = model.nodes.where("parent_id IS NOT NULL").select("doc_id", "parent_id", "node_id", "kind", "text", "start", "end", F.lead("text").over(first).alias("next"), F.row_number().over(first).alias("nth")).where("nth = 1")
    paras = model.of("para").select("doc_id", F.col("node_id").alias("parent_id"), F.col("text").alias("whole"), F.col("start").alias("p0"))
    rows = children.join(paras, ["doc_id", "parent_id"])
    run_in = (F.col("kind") == "strong") & (F.size(F.split(F.trim(F.col("text")), r"\s+")) <= 12) & (F.col("text").rlike(r"[.:]$") | F.coalesce(F.col("next").rlike(r"^\s*[.:]"), F.lit(False)))
    return emit(
        rows,
        (run_in, finding("structure/bold-label", F.concat(F.lit("`"), F.col("text"), F.lit("` is a label by its type only")))),
        (F.col("whole").rlike(r"^[a-z_][A-Za-z0-9_-]*:(?:\s|$)") & (F.col("start") == F.col("p0")), finding("structure/yaml-in-body", "a key of metadata opens a paragraph")),
    )


@REGISTRY.group(
    "tables",
    ("table/dropped-cells", "error", "Rows have no more cells than the header"),
    ("table/caption-id-on-caption", "info", "A table's identifier stands on the table"),
)
def tables(model: Model, context: Context) -> DataFrame:
    cells = emit(model.of("dropped_cell"), (F.trim(F.coalesce(F.col("text"), F.lit(""))) != "", finding("table/dropped-cells", F.concat(F.lit("`"), F.col("text"), F.lit("` is outside of every column")))))
    captions = emit(model.lines, (F.col("text").rlike(r"^[ \t]{0,3}:[ \t]+\S.*?[ \t]+\{#tbl[:\-][^\s{}]+\}[ \t]*$"), finding("table/caption-id-on-caption", "the identifier stands on the caption")))
    return cells.unionByName(captions)


@REGISTRY.group(
    "frontmatter",
    ("frontmatter/malformed-flow", "error", "Frontmatter can be read"),
    ("frontmatter/duplicate-key", "warning", "Keys are unique"),
    ("tex/header-includes-text", "error", "Header includes are raw TeX"),
    kinds=("frontmatter",),
)
def frontmatter(model: Model, context: Context) -> DataFrame:
    rows = model.frontmatter.select("doc_id", "start", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    before = Window.partitionBy("doc_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("doc_id", "k", "line", (F.col("start") + 4 + F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0))).cast("int").alias("at"), F.regexp_extract("line", r"^([A-Za-z_][\w.-]*)\s*:", 1).alias("key"))
    nth = F.row_number().over(Window.partitionBy("doc_id", "key").orderBy("k"))
    opens = lambda a, b: F.length("line") - F.length(F.translate("line", a, "")) - F.length("line") + F.length(F.translate("line", b, ""))
    unquoted = F.regexp_replace("line", r"\"(?:\\.|[^\"\\])*\"|'[^']*'", "")
    rows = rows.withColumn("line_", F.col("line")).withColumn("line", unquoted)
    flow = F.col("line").rlike(r"^\s*[\w.-]+\s*:\s*[\[{]") & ((opens("[", "]") != 0) | (opens("{", "}") != 0))
    text = F.col("line_").rlike(r"^\s*(?:-\s*|header-includes\s*:\s*)\"?\\\\usepackage")
    twice = F.locate("\\\\", F.col("line_")) - 1
    return emit(
        rows.withColumn("nth", nth),
        ((F.col("key") != "") & (F.col("nth") > 1), finding("frontmatter/duplicate-key", F.concat(F.lit("the key `"), F.col("key"), F.lit("` stands above already")), F.col("at"), F.col("at") + F.length("line_"))),
        (flow, finding("frontmatter/malformed-flow", "a list or mapping in the line isn't closed", F.col("at"), F.col("at") + F.length("line_"))),
        (text, finding("tex/header-includes-text", "a doubled backslash makes this text", F.col("at") + twice, F.col("at") + twice + 2, fix=suggestion(F.lit("One backslash"), F.lit("\\")))),
    )


@REGISTRY.group(
    "definitions",
    ("reference/duplicate-definition", "warning", "Link labels are unique"),
    ("footnote/duplicate-definition", "warning", "Footnotes are unique"),
    ("footnote/unused-definition", "warning", "Footnotes are used"),
    kinds=("definition", "note_definition", "note"),
)
def definitions(model: Model, context: Context) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("doc_id", "kind", "ident").orderBy("start"))
    rows = model.of("definition", "note_definition").withColumn("nth", nth)
    said = F.concat(F.lit("`"), F.col("ident"), F.lit("` is defined above"))
    used = model.of("note").where("info = 'reference'").select("doc_id", "ident").distinct()
    unused = rows.where("kind = 'note_definition' AND nth = 1").join(used, ["doc_id", "ident"], "left_anti")
    return union(
        emit(
            rows,
            ((F.col("kind") == "definition") & (F.col("nth") > 1), finding("reference/duplicate-definition", said)),
            ((F.col("kind") == "note_definition") & (F.col("nth") > 1), finding("footnote/duplicate-definition", said)),
        ),
        emit(unused, (F.lit(True), finding("footnote/unused-definition", F.concat(F.lit("nothing refers to `"), F.col("ident"), F.lit("`"))))),
    )


@REGISTRY.group(
    "reader",
    ("pandoc/unclosed-fenced-div", "warning", "Divs close"),
    ("pandoc/parse-error", "error", "The reader reads the document"),
    ("pandoc/warning", "warning", "The reader has no warnings"),
)
def reader_messages(model: Model, context: Context) -> DataFrame:
    """Context: messages (doc_id, level, message, start) of another reader."""
    own = emit(model.of("message"), (F.col("info") == "div is never closed", finding("pandoc/unclosed-fenced-div", "the div is never closed")))
    if "messages" not in context.tables:
        return own
    rows = context.tables["messages"].withColumn("end", F.col("start"))
    is_error = F.lower("level") == "error"
    return own.unionByName(emit(rows, (is_error, finding("pandoc/parse-error", F.col("message"))), (~is_error, finding("pandoc/warning", F.col("message")))))


# Macros ---------------------------------------------------------------------------------------------------------


def macro_list(context: Context) -> list[dict]:
    """The macros as literals for the scanners: a bounded list (``max_macros``)."""
    most = 20_000
    rows = context.tables["macros"].select("name", "replacement", "argument_count", "optional_first").distinct().orderBy("name").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} macros")
    return [r.asDict() for r in rows]


@REGISTRY.group(
    "macros",
    ("math/user-macro-candidates", "info", "Macros stand for what they define"),
    ("math/script-macro-candidates", "info", "Scripts that macros stand for"),
    ("math/manual-semantic-macro", "warning", "Objects are macros"),
    ("math/house-delimiter-macro", "warning", "Delimiters are macros"),
    ("tex/macro-arity", "error", "Macros have their arguments"),
    ("math/manual-cardinality", "warning", "Cardinality is a macro"),
    kinds=("math",),
)
def macro_rules(model: Model, context: Context) -> DataFrame:
    """Context: macros (name, replacement, argument_count, optional_first). Silent without."""
    if "macros" not in context.tables:
        return nothing(model)
    from lectern.functions.arrow import udf_of

    known = macro_list(context)
    bodies = tex.Bodies([m for m in known if m["replacement"]])

    def uses(t: str) -> list[dict]:
        return [x | {"rule": rule} for rule, f in scanners for x in f(t, bodies if rule == "math/user-macro-candidates" else known)]

    scanners = (
        ("math/user-macro-candidates", tex.macro_uses), ("math/script-macro-candidates", tex.script_macros), ("math/manual-semantic-macro", tex.semantic_macros),
        ("math/house-delimiter-macro", tex.house_delimiters), ("tex/macro-arity", tex.arity_errors), ("math/manual-cardinality", tex.cardinalities),
    )
    column = udf_of(uses, "array<struct<rule:string,start:int,end:int,name:string,replacement:string>>")
    rows = model.math.select("doc_id", "tex_start", F.explode(column("text")).alias("u")).select("doc_id", "tex_start", "u.*")
    start, end = F.col("tex_start") + F.col("start"), F.col("tex_start") + F.col("end")
    title = F.when(F.col("rule") == "tex/macro-arity", F.lit("Set the arguments in braces")).otherwise(F.lit("Use the macro"))
    better = F.when(F.col("replacement") != "", F.array(suggestion(title, F.col("replacement")))).otherwise(F.array().cast("array<struct<title:string,replacement:string>>"))
    fix = F.when((F.col("rule") == "math/house-delimiter-macro") & (F.col("replacement") != ""), suggestion(F.lit("Use the macro"), F.col("replacement"))).otherwise(no_fix())
    said = F.when(F.col("rule") == "tex/macro-arity", F.concat(F.lit("`\\"), F.col("name"), F.lit("` takes its arguments in braces"))).otherwise(F.concat(F.lit("a macro stands for this: "), F.col("name")))
    made = rows.select("doc_id", "rule", finding("", said, start, end, better, fix, {"macros": F.col("name")}).alias("f"))
    return made.select("doc_id", "rule", *[F.col(f"f.{c}") for c in ("severity", "message", "start", "end", "suggestions", "fix", "data")])


@REGISTRY.group(
    "commands",
    ("math/notation-consistency", "info", "One command for one symbol"),
    ("tex/unknown-command", "warning", "Commands are known"),
    kinds=("math",),
)
def command_rules(model: Model, context: Context) -> DataFrame:
    """Context for unknown commands: vocabulary (package, command), with package '' for what is always there, and
    optionally macros, includes (package, include) and packages (doc_id, package). Silent without a vocabulary."""
    uses = model.math.select("doc_id", "tex_start", F.explode(tex.commands_column("text")).alias("u")).select("doc_id", F.col("u.name").alias("name"), (F.col("tex_start") + F.col("u.start")).alias("start"), (F.col("tex_start") + F.col("u.end")).alias("end"))
    pair = F.create_map(*[F.lit(x) for p in tex.VARIANTS for name in p for x in (name[1:], p[0][1:])])
    variants = uses.withColumn("symbol", F.element_at(pair, F.col("name"))).where("symbol IS NOT NULL")
    w = Window.partitionBy("doc_id", "symbol")
    counted = variants.withColumn("plain", F.sum((F.col("name") == F.col("symbol")).cast("int")).over(w)).withColumn("all", F.count("*").over(w))
    mine = F.when(F.col("name") == F.col("symbol"), F.col("plain")).otherwise(F.col("all") - F.col("plain"))
    other = F.col("all") - mine
    found = emit(counted, ((mine < other) & (other >= 2), finding("math/notation-consistency", F.concat(F.lit("`\\"), F.col("name"), F.lit("` "), mine, F.lit(" times, its variant "), other, F.lit(" times")))))
    if "vocabulary" not in context.tables:
        return found
    vocabulary = context.tables["vocabulary"].select("package", "command")
    always = vocabulary.where("package = ''").select(F.col("command").alias("name"))
    if "macros" in context.tables:
        always = always.unionByName(context.tables["macros"].select("name"))
    unknown = uses.join(always.distinct(), "name", "left_anti")
    if "packages" in context.tables:
        loaded = context.tables["packages"].select("doc_id", "package")
        if "includes" in context.tables:
            closure = package_closure(context.tables["includes"], loaded.select("package").distinct())
            loaded = loaded.join(closure, "package").select("doc_id", F.col("member").alias("package")).distinct()
        unknown = unknown.join(loaded.join(vocabulary, "package").select("doc_id", F.col("command").alias("name")).distinct(), ["doc_id", "name"], "left_anti")
    wanted = unknown.select("name").distinct()
    providers = vocabulary.where("package <> ''").groupBy(F.col("command").alias("name")).agg(F.slice(F.array_sort(F.collect_set("package")), 1, 5).alias("providers"))
    near = similar_names(wanted, always).groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "candidate"))), lambda x: x["candidate"]).alias("near"))
    rows = unknown.join(providers, "name", "left").join(near, "name", "left")
    hints = F.transform(F.coalesce("near", F.array().cast("array<string>")), lambda c: suggestion(F.concat(F.lit("Write \\"), c), F.concat(F.lit("\\"), c)))
    hints = F.when(F.col("providers").isNull(), hints).otherwise(F.array().cast("array<struct<title:string,replacement:string>>"))
    return found.unionByName(emit(rows, (F.lit(True), finding("tex/unknown-command", F.concat(F.lit("`\\"), F.col("name"), F.lit("` is unknown")), suggestions=hints, data={"providers": F.array_join("providers", ",")}))))


# Prefixes of identifiers that cross-references name.
CROSS_REFERENCE = r"^(?:thm|prop|prp|lem|cor|conj|cnj|defn|def|exer|exr|exm|ex|rem|eqn|eq|sec|fig|tab|tbl|lst)[:-]"


@REGISTRY.group(
    "citations",
    ("citation/mixed-reference-types", "warning", "Citations and cross-references apart"),
    ("citation/missing-bibliography-entry", "error", "Cited works are in the bibliography"),
    kinds=("cite", "cite_group"),
)
def citations(model: Model, context: Context) -> DataFrame:
    """Context: bibliography (key); without it only the first rule speaks."""
    rows = model.citations.withColumn("crosses", F.col("key").rlike(CROSS_REFERENCE))
    groups = rows.groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.max("crosses").alias("any"), F.min("crosses").alias("all"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "crosses", "key"))), lambda x: F.when(x["crosses"], F.concat(F.lit("@"), x["key"])).otherwise(F.concat(F.lit("[@"), x["key"], F.lit("]")))), " ").alias("apart"))
    plain = F.col("text").rlike(r"^\s*@[\w:.-]+(?:\s*;\s*@[\w:.-]+)*\s*$")
    mixed = model.of("cite_group").join(groups, ["doc_id", "node_id"]).where("any AND NOT all")
    fix = F.when(plain, suggestion(F.lit("Set them apart"), F.col("apart"))).otherwise(no_fix())
    found = emit(mixed, (F.lit(True), finding("citation/mixed-reference-types", "cross-references and citations in one group", fix=fix)))
    if "bibliography" not in context.tables:
        return found
    cited = rows.where("NOT crosses").join(context.tables["bibliography"].select("key").distinct(), "key", "left_anti")
    return found.unionByName(emit(cited, (F.lit(True), finding("citation/missing-bibliography-entry", F.concat(F.lit("`"), F.col("key"), F.lit("` is not in the bibliography"))))))


@REGISTRY.group(
    "wikilinks",
    ("link/missing-wikilink-target", "warning", "Wikilinks lead somewhere"),
    ("link/ambiguous-wikilink", "error", "Wikilinks lead to one page"),
    ("link/relative-wikilink", "warning", "Wikilinks are canonical"),
    kinds=("wikilink",),
)
def wikilinks(model: Model, context: Context) -> DataFrame:
    """Context: wikilinks (name, status, relative, canonical, candidates array<string>)."""
    if "wikilinks" not in context.tables:
        return nothing(model)
    rows = model.of("wikilink").withColumn("name", F.regexp_replace("url", r"#.*$", "")).join(context.tables["wikilinks"], "name")
    label = F.when(F.col("text") == F.col("url"), F.lit("")).otherwise(F.concat(F.lit("|"), F.col("text")))
    written = lambda c: F.concat(F.lit("[["), c, label, F.lit("]]"))
    choices = F.transform(F.coalesce("candidates", F.array().cast("array<string>")), lambda c: suggestion(F.concat(F.lit("Link "), c), written(c)))
    return emit(
        rows,
        (F.col("status") == "missing", finding("link/missing-wikilink-target", F.concat(F.lit("there is no page `"), F.col("name"), F.lit("`")))),
        (F.col("status") == "ambiguous", finding("link/ambiguous-wikilink", F.concat(F.lit("several pages are `"), F.col("name"), F.lit("`")), suggestions=choices)),
        ((F.col("status") == "resolved") & F.col("relative") & F.col("canonical").isNotNull(), finding("link/relative-wikilink", "the link is relative", fix=suggestion(F.lit("Use the canonical name"), written(F.col("canonical"))))),
    )


@REGISTRY.group(
    "workspace",
    ("reference/duplicate-workspace-definition", "error", "Keys are defined once in the workspace"),
    ("reference/missing-workspace-definition", "warning", "References are defined in the workspace"),
)
def workspace(model: Model, context: Context) -> DataFrame:
    """Over the documents of a workspace (column workspace of the documents; without it each document is one of its own), and
    context table definitions (key) of documents elsewhere."""
    own = model.identifiers.where(F.col("ident").rlike(CROSS_REFERENCE)).select("doc_id", F.col("ident").alias("key"), "start", "end")
    cited = model.citations.where(F.col("key").rlike(CROSS_REFERENCE))
    if "workspace" in model.documents.columns:
        spaces = model.documents.select("doc_id", F.col("workspace").cast("string").alias("space"))
        own, cited = own.join(spaces, "doc_id"), cited.join(spaces, "doc_id")
    else:
        own, cited = (x.withColumn("space", F.col("doc_id").cast("string")) for x in (own, cited))
    counts = own.groupBy("space", "key").agg(F.count("*").alias("n"))
    twice = own.join(counts.where("n > 1"), ["space", "key"])
    lost = cited.join(own.select("space", "key").distinct(), ["space", "key"], "left_anti")
    keys = own.select("key")
    if "definitions" in context.tables:
        elsewhere = context.tables["definitions"].select("key").distinct()
        keys, lost = keys.unionByName(elsewhere), lost.join(elsewhere, "key", "left_anti")
    keys = keys.distinct()
    near = similar_names(lost.select(F.col("key").alias("name")), keys.select(F.col("key").alias("name")))
    near = near.groupBy(F.col("name").alias("key")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "candidate"))), lambda x: suggestion(F.concat(F.lit("Refer to "), x["candidate"]), F.concat(F.lit("@"), x["candidate"]))).alias("near"))
    hints = F.coalesce("near", F.array().cast("array<struct<title:string,replacement:string>>"))
    return union(
        emit(twice, (F.lit(True), finding("reference/duplicate-workspace-definition", F.concat(F.lit("`"), F.col("key"), F.lit("` is defined "), F.col("n"), F.lit(" times"))))),
        emit(lost.join(near, "key", "left"), (F.lit(True), finding("reference/missing-workspace-definition", F.concat(F.lit("`"), F.col("key"), F.lit("` is not defined")), suggestions=hints))),
    )


@REGISTRY.group("host", ("tikz/compile-error", "error", "Diagrams compile"))
def host(model: Model, context: Context) -> DataFrame:
    """Context: compile_errors (doc_id, message, start, end)."""
    if "compile_errors" not in context.tables:
        return nothing(model)
    return emit(context.tables["compile_errors"], (F.lit(True), finding("tikz/compile-error", F.col("message"))))
