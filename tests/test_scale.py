"""What keeps large tables within bounds, and results that only show on them."""

import re

import pyarrow as pa
from pyspark.sql import functions as F

from lectern.functions import arrow, text
from lectern.lint import fix, prose, rules  # noqa: F401
from lectern.lint.registry import REGISTRY
from lectern.plans import formatter, gate, reader
from lectern.plans.model import Model
from lectern.sources import session


def test_gate_looks_only_at_blocks_that_differ(monkeypatch):
    before = "".join(f"Some *words* {k}.\n\n" for k in range(200))
    gate.check(before, before + "More.\n")
    seen, changed = [], gate._changed
    monkeypatch.setattr(gate, "_changed", lambda tree, names: seen.append(1) or changed(tree, names))
    assert gate.check(before, before + "More.\n") == {"ok": False, "normalizations": [], "detail": "nothing became para", "block": 200}
    assert len(seen) < 20_000
    assert gate.check(before + "## **T**\n", before + "## T\n")["normalizations"] == ["unbold_heading"]



def test_gate_reads_lines_of_code_beside_a_normalisation():
    code = "```\na\nb\n```\n\n"
    assert gate.check(code + '"x" y\n', code + "“x” y\n") == {"ok": True, "normalizations": ["smart_quotes"], "detail": None, "block": None}
    assert not gate.check(code + '"x" y\n', code.replace("a\nb", "a b") + "“x” y\n")["ok"]



def test_reader_places_inlines_where_lines_are_cut():
    source = "> one *two*\n> www.a.b and\n> `c`\n\nx *y\n   z* http://e.org/q\n"
    found = {n.kind: source[n.start : n.end] for n, _ in formatter.located(source)}
    assert (found["code"], found["emph"], found["bare_url"]) == ("`c`", "*y\n   z*", "http://e.org/q")
    assert [n.url for n, _ in formatter.located(source) if n.kind == "bare_url"] == ["www.a.b", "http://e.org/q"]
    assert isinstance(reader.Blocks("").inlines("a b", range(3))[0].text, str)



def test_items_after_a_capital_keep_two_spaces():
    made = formatter.safely("Text.\n\nA.  one  is here. Two\n\n- x\n\n  B.   three\n", formatter.AUTO)
    assert made["status"] == "ok" and made["text"] == "Text.\n\nA.  one is here.\n    Two\n\n- x\n\n  B.  three\n"



def test_rows_are_made_in_slices(spark):
    batch = pa.array(["x" * 1000] * 5000)
    parts = list(arrow.slices((batch, batch)))
    assert sum(len(p[0]) for p in parts) == 5000 and max(p[0].nbytes for p in parts) <= arrow.SLICE and all(len(a) == len(b) for a, b in parts)
    made = spark.range(3000).select("id", F.when(F.col("id") % 7 > 0, F.repeat(F.lit("y"), 2000)).alias("t")).repartition(1)
    got = made.select("id", arrow.udf_of(lambda t, i: f"{i}{len(t)}", "string")("t", "id").alias("r")).orderBy("id").collect()
    assert [r.r for r in got] == [f"{k}2000" if k % 7 else None for k in range(3000)]



def test_a_large_table_has_more_tasks_than_cores(spark, monkeypatch):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    monkeypatch.setattr(session, "SMALL", 10_000)
    assert session.spread(table).rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
    assert session.spread(table).count() == table.count()
    made = spark.createDataFrame([(1, "a")], "doc_id long, text string")  # of a size that Spark doesn't know
    assert session.spread(made).collect() == made.collect()



def test_all_fills_are_one_pass(spark):
    from lectern.queries import QUERIES

    plan = QUERIES["fill_modes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1



def test_tags_that_touch(spark):
    ends = "|".join(f"(?<={a})(?={b})" for a, b in text.TAGS)
    cases = ["{% a %}{% /a %}{%b%}", "%}{%}{%}{%", "#}{#}{#", "}}}{{{", "--><!--><!-- x", "%}{#", "a -->b", "}} {{", "é%}{%"]
    rows = spark.createDataFrame([(c,) for c in cases], "t string").select("t", text.spaced_tags(F.col("t")).alias("s")).collect()
    assert {r.t: r.s for r in rows} == {c: re.sub(ends, " ", c) for c in cases}



MIXED = "---\na: b\n---\n\n# One *x*\n\nPlain words here.\n\n- one `c`\n* two http://e.org/a,\n\nA word\n\n: meant\n\nTitle\n===\n\n```\nhttp://in.code\n```\n\nx. item\r\n\r\nsee <b> and $http://in.math$ (http://e.org/b)\n"


def test_a_run_makes_only_the_nodes_that_its_rules_look_at(spark, tmp_path):
    docs = spark.createDataFrame([(1, MIXED)], "doc_id long, text string")
    model = Model(docs, f"file:{tmp_path}/m")
    on = {r: "off" for r in REGISTRY.rules} | {"style/unordered-list-marker": "warning", "style/bare-url": "warning"}
    got = REGISTRY.run(model, on).select("rule", "start").collect()
    assert sorted((r.rule, r.start) for r in got) == [("style/bare-url", MIXED.index("http://e.org/a")), ("style/bare-url", MIXED.index("http://e.org/b")), ("style/unordered-list-marker", MIXED.index("* two"))]
    kept = [p for p in tmp_path.rglob("*") if p.is_dir()]
    assert not [p for p in kept if p.name == "lines"]
    kinds = {r.kind for p in kept if p.name == "nodes" for r in spark.read.parquet(f"file:{p}").select("kind").collect()}
    assert kinds == {"bullet_list", "item", "code_block", "frontmatter", "code", "math"}
    part = Model(docs).narrowed(["heading"])
    assert [r.text for r in part.headings.orderBy("start").collect()] == ["One x", "Title"]
    for wrong in (lambda: part.of("para"), lambda: part.nodes):
        try:
            wrong()
            raise AssertionError("nodes that aren't made")
        except ValueError:
            pass


#: Queries, and of which kinds the nodes are that they may make and sort.
OWN_KINDS = (
    ("frontmatter_findings", ("frontmatter",)),
    ("heading_findings", ("heading",)),
    ("lint_report", ("link", "image")),
    ("list_marker_findings", ("item", "bullet_list", "code_block")),
)


def test_findings_make_nodes_of_their_own_kinds_in_parts_of_a_size(spark, monkeypatch):
    from lectern.queries import QUERIES

    seen, whole = [], reader.nodes
    monkeypatch.setattr(reader, "nodes", lambda docs, kinds=None: seen.append((kinds, docs.rdd.getNumPartitions())) or whole(docs, kinds))
    monkeypatch.setattr(session, "SMALL", 10_000)
    for name, kinds in OWN_KINDS:
        QUERIES[name](spark, "/root/testdata/sf0.001")
        made, parts = seen.pop()
        assert made == frozenset(kinds) and parts > spark.sparkContext.defaultParallelism and not seen


def test_some_kinds_of_nodes_are_as_among_all():
    for kinds in (("heading",), ("item", "bullet_list"), ("code", "math", "code_block"), ("text",), ("para", "cite")):
        both = [[{k: v for k, v in r.items() if k not in ("node_id", "parent_id")} for r in found if r["kind"] in kinds] for found in (reader.rows(MIXED), reader.rows(MIXED, frozenset(kinds)))]
        assert both[0] == both[1]


def test_marks_of_a_text_are_those_of_its_lines():
    at, by_line = 0, []
    for line in MIXED.split("\n"):
        by_line += [m | {"start": at + m["start"], "end": at + m["end"]} for m in prose.line_marks(line.removesuffix("\r"))]
        at += len(line) + 1
    assert prose.marks(MIXED) == by_line and len(by_line) == 5


def test_texts_stay_where_they_are_while_they_are_fixed(spark, monkeypatch):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("- a\n* b\n\nSee http://e.org/"), "id").alias("text")).repartition(7, "doc_id")
    seen, whole = [], session.cut
    monkeypatch.setattr(session, "cut", lambda df: seen.append((df._jdf.queryExecution().executedPlan().toString(), whole(df))) or seen[-1][1])
    on = {r: "off" for r in REGISTRY.rules} | {"style/unordered-list-marker": "warning", "style/bare-url": "warning"}
    got = {r.doc_id: (r.text, r.applied) for r in fix.fix(docs, REGISTRY, on).collect()}
    assert got == {k: (f"- a\n- b\n\nSee <http://e.org/{k}>", 2) for k in range(200)}
    texts = [plan for plan, df in seen if "text" in df.columns]
    assert len(texts) == 2 and texts[1].count("Exchange hashpartitioning") <= 1
