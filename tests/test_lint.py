import pytest
from pyspark.sql import functions as F

from lectern.lint import fix, rules, tex  # noqa: F401
from lectern.lint.registry import REGISTRY, Context, Registry, Rule, diagnostics, emit, finding
from lectern.operators.similar import alignment_distance, package_closure, similar_names
from lectern.plans.model import Model, asof, not_within
from lectern.rule_cases import CASES, context_of
from lectern.sources import references, settings
from lectern.streaming import documents as streams

@pytest.fixture(scope="module")
def context(spark):
    return context_of(spark)


@pytest.fixture(scope="module")
def found(spark, context, tmp_path_factory):
    rows = [(2 * k + j, c[1] if j == 0 else c[3]) for k, c in enumerate(CASES) for j in (0, 1)]
    model = Model(spark.createDataFrame(rows, "doc_id long, text string"), f"file:{tmp_path_factory.mktemp('model')}")
    got = diagnostics(REGISTRY.run(model, {r: "warning" for r in REGISTRY.rules}, context), model).collect()
    return got


def test_every_rule_has_a_case():
    assert {c[0] for c in CASES} == set(REGISTRY.rules) and len(REGISTRY.rules) == 78


@pytest.mark.parametrize("number", range(len(CASES)), ids=[c[0] for c in CASES])
def test_rule(found, number):
    rule, _, line, _ = CASES[number]
    bad = [r.line for r in found if r.doc_id == 2 * number and r.rule == rule]
    good = [r for r in found if r.doc_id == 2 * number + 1 and r.rule == rule]
    assert line in bad and not good


@pytest.fixture(scope="module")
def more(spark, context):
    """Findings of texts that the cases don't have."""
    texts = [t for t, _, _ in MORE]
    model = Model(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = REGISTRY.run(model, {r: "warning" for r in REGISTRY.rules if not r.startswith(("reference/missing-work", "reference/duplicate-work", "style/required"))}).collect()
    return {k: {r.rule for r in got if r.doc_id == k} for k in range(len(texts))}


#: text, rules that find something, rules that don't
MORE = [
    ("Use $0\\too A\\too B\\too0$.\n", {"math/structural-sequence-display"}, set()),
    ("The cokernel sequence $A\\injects B\\twoheadrightarrow C$ is.\n", {"math/structural-sequence-display"}, set()),
    ("A cokernel sequence. It gives $X\\to\\ker{A\\too B}$.\n", set(), {"math/structural-sequence-display"}),
    ("$$x=y$$ {#eq:xy}\n", set(), {"math/display-economy"}),
    ("$$\nx=y\nz=w\n$$\n", set(), {"math/display-economy"}),
    ("The exact sequence\n$$A\\to B\\to C$$\nis.\n", set(), {"math/display-economy", "math/structural-sequence-display"}),
    ("$$\\begin{tikzcd} A & B \\end{tikzcd}$$\n", {"tikz/environment-wrapper"}, {"math/display-economy"}),
    ("The mixed terms vanish for $b$. The map is natural for $f$.\n", set(), {"prose/untyped-vague-claim"}),
    ("The mixed terms vanish. See $b$.\n", {"prose/untyped-vague-claim"}, set()),
    ("The restriction of f is good.\n", set(), {"prose/untyped-map-reference"}),
    ("####### Seven\n", set(), {"heading/duplicate", "heading/multiple-h1"}),
    ("[text][missing] and text[^missing].\n\n[unused]: /t\n", set(), {"footnote/unused-definition", "link/empty-destination", "reference/duplicate-definition"}),
    ("#NoHeading\n\n```python\nopen\n", set(), {"code/missing-language", "heading/multiple-h1"}),
    ("Text[^x].\n\n[^x]: one\n[^x]: two\n", {"footnote/duplicate-definition"}, set()),
    ("\\begin{align}\nx &= y\n", set(), {"math/outside-math-mode"}),
    ("`\\sum` and <http://x_0.y> and [a_0](b_0)\n", set(), {"math/unicode-symbol"}),
    ("$y^{2}^\\alpha$ and $Hom_R(M,N)$\n", {"math/repeated-superscript", "math/bare-operator"}, set()),
    ("$\\{ a \\}$ $% {\n a$\n", set(), {"math/unclosed-group", "math/unmatched-group-close"}),
    ("So 50% of x_1 here.\n", {"math/outside-math-mode"}, set()),
    ("::: {.definition}\n```text\nProof. x\n```\n:::\n", set(), {"structure/statement-boundary"}),
]


@pytest.mark.parametrize("number", range(len(MORE)))
def test_more(more, number):
    _, found, quiet = MORE[number]
    assert found <= more[number] and not quiet & more[number]


def test_fragments_of_other_documents(spark):
    rows = [(1, "d/a.md", "[x](b.md#here) [y](b.md#gone) [z](c.md#any)\n"), (2, "d/b.md", "# Here\n")]
    model = Model(spark.createDataFrame(rows, "doc_id long, path string, text string"))
    got = REGISTRY.run(model, {r: ("warning" if r == "link/invalid-fragment" else "off") for r in REGISTRY.rules}).collect()
    assert [(r.doc_id, r.start) for r in got] == [(1, 15)]


def run_one(spark, rows, rule, context=None, schema="doc_id long, path string, text string"):
    model = Model(spark.createDataFrame(rows, schema))
    return REGISTRY.run(model, {r: ("warning" if r == rule else "off") for r in REGISTRY.rules}, context).orderBy("doc_id", "start").collect()


def test_malformed_escapes_are_text(spark):
    rows = [(1, "a.md", "[x](#a%zz) [y](b%zz.md#c%zz) [z](#caf%C3%A9)\n\n# café\n"), (2, "b%zz.md", "# c%zz {#c%zz}\n")]
    assert [(r.doc_id, r.start) for r in run_one(spark, rows, "link/invalid-fragment")] == [(1, 0)]
    files = Context({"files": spark.createDataFrame([("b%zz.md",)], "path string")})
    assert [r.message for r in run_one(spark, [(1, "a.md", "[x](b%zz.md) [y](c%zz.md)\n")], "link/missing-local-target", files)] == ["there is no file `c%zz.md`"]


def test_long_fragments_count_whole(spark):
    name = "a" * 12_000
    rows = [(1, "a.md", f"# T {{#{name}}}\n\n[x](#{name}) [y](#{name}b)\n")]
    assert len(run_one(spark, rows, "link/invalid-fragment")) == 1


def test_links_are_read_from_their_folder(spark):
    rows = [(1, "d/e/a.md", "[1](../b.md) [2](c.md) [3](./../../top.md) [4](../../../out.md) [5](b.md) ![6](/abs.png)\n"), (2, "top.md", "[1](d/b.md) [2](b.md) [3](d/./e/../b.md)\n")]
    files = Context({"files": spark.createDataFrame([("d/b.md",), ("d/e/c.md",), ("top.md",), ("/abs.png",), ("../out.md",)], "path string")})
    got = run_one(spark, rows, "link/missing-local-target", files)
    assert [(r.doc_id, r.message) for r in got] == [(1, "there is no file `d/e/b.md`"), (2, "there is no file `b.md`")]
    rows = [(1, "d/a.md", "[x](../b.md#here) [y](../b.md#gone)\n"), (2, "b.md", "# Here\n")]
    assert [(r.doc_id, r.start) for r in run_one(spark, rows, "link/invalid-fragment")] == [(1, 18)]


def test_every_file_that_tex_reads_is_looked_for(spark):
    text = "\\begin{x}\n\\input{one} \\include{two}\n\\includegraphics[width=1cm]{fig} \\input{sub/three}\n\\end{x}\n"
    tables = {"files": spark.createDataFrame([("tex/two.tex",), ("fig.pdf",), ("more/tex/one.tex",)], "path string"), "roots": spark.createDataFrame([("./tex/",)], "root string")}
    got = run_one(spark, [(1, "a.md", text)], "tex/missing-resource", Context(tables))
    assert [r.message for r in got] == ["there is no file `one`", "there is no file `sub/three`"]
    assert [text[r.start : r.end] for r in got] == ["\\input{one}", "\\input{sub/three}"]


def test_workspaces_stand_apart(spark):
    text = "::: {.theorem #thm:main}\nx\n:::\n\nsee @thm:main and @thm:other\n"
    rows = [(1, "a", text), (2, "a", text), (3, "b", text.replace("main", "other")), (4, "b", "see @thm:main\n")]
    schema = "doc_id long, workspace string, text string"
    assert {r.doc_id for r in run_one(spark, rows, "reference/duplicate-workspace-definition", None, schema)} == {1, 2}
    assert {r.doc_id for r in run_one(spark, rows, "reference/missing-workspace-definition", None, schema)} == {1, 2, 4}
    alone = [(r[0], r[2]) for r in rows]
    assert run_one(spark, alone, "reference/duplicate-workspace-definition", None, "doc_id long, text string") == []
    elsewhere = Context({"definitions": spark.createDataFrame([("thm:other",)], "key string")})
    assert {r.doc_id for r in run_one(spark, rows, "reference/missing-workspace-definition", elsewhere, schema)} == {4}


def test_file_types(spark):
    text = "`a.tiff` `b.qqq` `c.zzz` `d.py` `no file` `https://x.y/z.py`\n"
    assert [text[r.start : r.end] for r in run_one(spark, [(1, "a.md", text)], "link/file-path")] == ["`a.tiff`", "`d.py`"]
    more = Context({"endings": spark.createDataFrame([(".qqq",)], "ending string")})
    assert [text[r.start : r.end] for r in run_one(spark, [(1, "a.md", text)], "link/file-path", more)] == ["`a.tiff`", "`b.qqq`", "`d.py`"]


def test_arguments_without_braces(spark):
    macros = [{"name": "abs", "replacement": "|#1|", "argument_count": 1, "optional_first": False}, {"name": "two", "replacement": "#1#2", "argument_count": 2, "optional_first": False}, {"name": "opt", "replacement": "#1#2", "argument_count": 2, "optional_first": True}]
    cases = [
        (r"\abs x", [(0, 6, r"\abs{x}")]), (r"\abs(x + y) z", [(0, 11, r"\abs{x + y}")]), (r"\abs \frac{a}{b}", [(0, 16, r"\abs{\frac{a}{b}}")]), (r"\abs{x}", []), (r"\two{a} b", [(0, 9, r"\two{a}{b}")]), (r"\two a", [(0, 6, "")]),
        (r"\abs,", [(0, 4, "")]), (r"\abs x_1", [(0, 6, "")]), (r"\opt[a]{b}", []), (r"\opt[a] b", [(0, 9, r"\opt[a]{b}")]), (r"\abs", [(0, 4, "")]), (r"% \abs x", []),
    ]
    for text, want in cases:
        assert [(x["start"], x["end"], x["replacement"]) for x in tex.arity_errors(text, macros)] == want, text


def test_bodies_are_found_by_their_pieces():
    import random

    rng = random.Random(5)
    letters = ["a", "b", "\\x", "\\y", "^", "(", ")", "#1", "+"]
    macros = [{"name": f"m{k}", "replacement": "".join(rng.choice(letters) for _ in range(rng.randint(1, 6))), "argument_count": 1, "optional_first": False} for k in range(60)]
    bodies = tex.Bodies(macros)
    for _ in range(200):
        text = "".join(rng.choice(letters[:7] + ["+"]) for _ in range(rng.randint(1, 20)))
        flat = tex.normalized(text)[0]
        want = {m["name"] for m in macros if (p := tex.macro_pattern(m["replacement"])) and p.search(flat)}
        assert want <= {m["name"] for m in bodies.near(flat)}, text


def test_levels_prune_and_override(spark):
    model = Model(spark.createDataFrame([(1, "# A.\n\n# A.\n")], "doc_id long, text string"))
    got = REGISTRY.run(model, {"heading/duplicate": "off", "style/heading-punctuation": {"level": "error"}}).collect()
    assert {(r.rule, r.severity) for r in got} == {("heading/multiple-h1", "warning"), ("style/heading-punctuation", "error")}
    with pytest.raises(ValueError):
        REGISTRY.run(model, {"no/such-rule": True})
    plan = REGISTRY.run(model, {r: "off" for r in REGISTRY.rules})
    assert plan.count() == 0


def test_own_rules(spark):
    registry = Registry()
    registry.register("own/short", "info", "Short documents", lambda m, c: emit(m.documents, (F.length("text") < 5, finding("own/short", "short", F.lit(0), F.lit(0)))))
    model = Model(spark.createDataFrame([(1, "abc"), (2, "abcdef")], "doc_id long, text string"))
    assert [r.doc_id for r in registry.run(model).collect()] == [1]
    registry.register("own/wrong", "info", "", lambda m, c: emit(m.documents, (F.lit(True), finding("own/other", "x", F.lit(0), F.lit(0)))))
    with pytest.raises(Exception, match="own/wrong emits own/other"):
        registry.run(model).collect()
    with pytest.raises(ValueError):
        registry.add(Rule("own/short", "info", "", "x"))


def test_fixes_until_none_is_left(spark):
    docs = spark.createDataFrame([(1, "$sin x + log y$\n\nsee http://a.b now\n"), (2, "fine\n")], "doc_id long, text string")
    on = {r: "off" for r in REGISTRY.rules} | {"math/bare-operator": "warning", "style/bare-url": "warning"}
    got = {r.doc_id: r for r in fix.fix(docs, REGISTRY, on).collect()}
    assert got[1].text == "$\\sin x + \\log y$\n\nsee <http://a.b> now\n" and got[1].applied == 3 and got[2].text == "fine\n"


def test_splice_leaves_out_overlaps():
    edits = [{"start": 0, "end": 2, "replacement": "X"}, {"start": 1, "end": 3, "replacement": "Y"}, {"start": 3, "end": 3, "replacement": "Z"}]
    assert fix.splice("abcd", edits) == {"text": "XcZd", "applied": 2}


def test_similar_names(spark):
    assert [alignment_distance(a, b) for a, b in (("ab", "ba"), ("ca", "abc"), ("", "ab"), ("same", "same"))] == [1, 3, 2, 0]
    names = spark.createDataFrame([("alpha",), ("alhpa",), ("beta",), ("aleph",), ("alpina",)], "name string")
    got = similar_names(spark.createDataFrame([("alpah",), ("zzzzzz",)], "name string"), names).collect()
    assert [(r.name, r.candidate, r.distance) for r in sorted(got, key=lambda r: r["rank"])] == [("alpah", "alpha", 1)]


def test_similar_names_match_brute_force(spark):
    import random

    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(1, 16))) for _ in range(250)})
    wanted = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(1, 16))) for _ in range(40)} | {w[1:] + w[:1] for w in words[:30]})
    got = {}
    for r in similar_names(spark.createDataFrame([(w,) for w in wanted], "name string"), spark.createDataFrame([(w,) for w in words], "name string")).collect():
        got.setdefault(r.name, []).append((r["rank"], r.candidate))
    for name in wanted:
        scored = [(alignment_distance(name, w), w) for w in words if w != name]
        close = [x for x in scored if x[0] <= max(len(name), 3) // 3]
        best = sorted((w for d, w in close if d == min(close)[0]), key=lambda w: (sorted(w) != sorted(name), len(w) != len(name), w))[:3]
        assert [w for _, w in sorted(got.get(name, []))] == best, name


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "e")], "package string, include string")
    got = {(r.package, r.member) for r in package_closure(edges, spark.createDataFrame([("a",), ("d",)], "package string")).collect()}
    assert got == {("a", "a"), ("a", "b"), ("a", "c"), ("d", "d"), ("d", "e")}


def test_asof_and_range_anti_join(spark):
    points = spark.createDataFrame([(1, 5, "p"), (1, 0, "q"), (2, 9, "r")], "doc_id long, at int, name string")
    marks = spark.createDataFrame([(1, 1, "a"), (1, 5, "b"), (2, 20, "c")], "doc_id long, start int, value string")
    assert {(r.name, r.value) for r in asof(points, marks, ["value"]).collect()} == {("p", "b"), ("q", None), ("r", None)}
    spans = spark.createDataFrame([(1, 0, 3), (1, 3, 6), (1, 6, 9), (1, 20, 22), (2, 0, 9)], "doc_id long, start int, end int")
    ranges = spark.createDataFrame([(1, 2, 4), (1, 10, 30), (1, 11, 12)], "doc_id long, start int, end int")
    assert {(r.doc_id, r.start) for r in not_within(spans, ranges).collect()} == {(1, 6), (2, 0)}


def test_macro_sources(spark):
    source = r"\newcommand{\R}{\mathbb{R}} \newcommand\abs[1]{|#1|} \newcommand{\opt}[2][x]{#1#2} \DeclareMathOperator{\Hom}{Hom} \def\foo#1{a#1} \DeclarePairedDelimiter\norm{\lVert}{\rVert}"
    assert {(m["name"], m["argument_count"], m["optional_first"]) for m in tex.macros(source)} == {("R", 0, False), ("abs", 1, False), ("opt", 2, True), ("Hom", 0, False), ("foo", 1, False), ("norm", 1, False)}
    texts = spark.createDataFrame([("a.tex", source), ("b.json", '{"\\\\x": "#1#2"}')], "path string, text string")
    assert {r.name: r.argument_count for r in references.macros(texts).collect()}["x"] == 2


def test_bibliographies(spark):
    texts = spark.createDataFrame([("a.bib", "@book{k1, t={x}}\n@comment{no, x}\n@article{k2,\n"), ("b.json", '[{"id": "k3"}]'), ("c.ris", "TY  - B\nID  - k4\n"), ("d.yaml", "references:\n- id: k5\n"), ("e.txt", "x")], "path string, text string")
    assert {r.key for r in references.bibliography(texts).collect()} == {"k1", "k2", "k3", "k4", "k5"}


def test_reports(spark):
    docs = spark.createDataFrame([(1, "a.md", "![](x)\n")], "doc_id long, path string, text string")
    model = Model(docs)
    d = diagnostics(REGISTRY.run(model, {r: ("warning" if r == "accessibility/image-alt" else "off") for r in REGISTRY.rules}), model)
    assert fix.report_text(d, docs.select("doc_id", "path")).first().report == "a.md:1:1: warning accessibility/image-alt: the image has no text"
    import json

    one = json.loads(fix.report_json(d, docs.select("doc_id", "path")).first().report)
    assert one["path"] == "a.md" and one["diagnostics"][0]["rule"] == "accessibility/image-alt"
    assert fix.exit_code(d) == 1 and fix.exit_code(d, True) == 0


def test_streams_are_the_batch_functions(spark, tmp_path):
    docs = spark.createDataFrame([(1, "One sentence here. And another one.\n"), (2, "```\nopen")], "doc_id long, text string")
    docs.write.parquet(f"file:{tmp_path}/in")
    for name, f in (("s", streams.stream_sentences), ("p", streams.stream_preflight), ("r", streams.stream_reformatted)):
        q = streams.write_parquet(f(streams.stream_of(spark, f"file:{tmp_path}/in")), f"file:{tmp_path}/{name}", f"file:{tmp_path}/c{name}")
        q.awaitTermination(120)
        assert sorted(map(str, spark.read.parquet(f"file:{tmp_path}/{name}").collect())) == sorted(map(str, f(docs).collect()))


def test_settings():
    s = settings.parse('[formatting]\nsemantic = true\nwidth = 60\nlist-spacing = "tight"\n[file-discovery]\nexclude = ["x/"]\n[lint.rules]\n"heading/duplicate" = "off"\n')
    assert s.options() == settings.Options("semantic", 60, frozenset(), "tight") and s.options(width=0, cleanups=True).passes == {"cleanups"}
    assert s.discovery().exclude == ("x/",) and s.lint["rules"] == {"heading/duplicate": "off"}
    for bad in ("nope = 1", 'width = "x"', "width = true", 'list-spacing = "odd"', "include = [1]"):
        with pytest.raises(ValueError):
            settings.parse(bad)
