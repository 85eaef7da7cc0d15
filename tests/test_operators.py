"""Literal cases of hunks, ranges, groups, order and stores."""

import random
import time
from collections import Counter

from pyspark.sql import functions as F

from changeloom.operators import graph, ranges, script, source, steps
from changeloom.operators.hunks import added_lines, line_runs, parse_hunks
from changeloom.sources import store

HEAD = "diff --git a/a.py b/a.py\n--- a/a.py\n+++ b/a.py\n"


def hunks(spark, text):
    got = parse_hunks(spark.createDataFrame([(1, text)], "change_id long, diff_text string")).orderBy("hunk_seq").collect()
    return [(r.file_path, r.start_line, r.end_line, r.diff_text) for r in got]


def test_hunk_headers(spark):
    for header, want in (("@@ -5,2 +4,0 @@", (4, 4)), ("@@ -0,0 +0,0 @@", (1, 1)), ("@@ -3 +7 @@ def x", (7, 7))):
        assert [h[1:3] for h in hunks(spark, HEAD + header + "\n+x")] == [want]
    assert hunks(spark, " \n ") == []


def test_hunk_state(spark):
    assert [h[1:] for h in hunks(spark, HEAD + "@@ -1 +1 @@\n+a\n+see @@ -1,2 +9,3 @@\n+b")] == [(1, 1, "@@ -1 +1 @@\n+a"), (9, 11, "+see @@ -1,2 +9,3 @@\n+b")]
    assert hunks(spark, HEAD + "@@ -1 +1 @@\n+a\n+++ b/other.py\n+b") == [("other.py", 1, 1, "@@ -1 +1 @@\n+a\n+b")]
    two = hunks(spark, HEAD + "@@ -1 +1 @@\n+a\n" + HEAD.replace("a.py", "c.py") + "@@ -2 +2 @@\n+b\n")
    assert [h[0] for h in two] == ["a.py", "c.py"] and [h[3].endswith("\n") for h in two] == [False, True]
    assert hunks(spark, HEAD.replace("a.py", "docs/README.MD") + "@@ -1 +1 @@\n+a") == []
    assert hunks(spark, HEAD.replace("b/a.py\n", "x\n").replace("+++ x", "+++ /dev/null") + "@@ -1 +0,0 @@\n-a") == []
    assert hunks(spark, HEAD.replace("+++ b/a.py", "+++ /elsewhere/a.py") + "@@ -1 +1 @@\n+a") == []


def test_hunks_are_parsed_in_their_row(spark):
    """No shuffle before the numbers of hunks; a file of many hunks and several parts of a change number on."""
    one = spark.createDataFrame([(1, HEAD + "@@ -1 +1 @@\n+a\n" * 3)], "change_id long, diff_text string")
    plan = parse_hunks(one)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    parts = spark.createDataFrame([(1, 20, "\n"), (1, 30, HEAD + "@@ -1 +1 @@\n+a\n@@ -3 +3 @@\n+b"), (1, 7, HEAD.replace("a.py", "/dev/null") + "@@ -1 +1 @@\n+c"), (2, 5, HEAD + "@@ -9 +9 @@\n+d\r\n")], "change_id long, part int, diff_text string")
    assert sorted((r.change_id, r.hunk_seq, r.start_line, r.diff_text) for r in parse_hunks(parts).collect()) == [(1, 2, 1, "@@ -1 +1 @@\n+a"), (1, 3, 3, "@@ -3 +3 @@\n+b"), (2, 1, 9, "@@ -9 +9 @@\n+d\n")]
    long = spark.createDataFrame([(1, HEAD + "@@ -1 +1 @@\n+x\n" * 20_000 + "+" + "@" * 300_000 + "\n")], "change_id long, diff_text string")
    began = time.time()
    assert parse_hunks(long).where("hunk_seq = 20000 and length(diff_text) > 300000").count() == 1 and time.time() - began < 30


def test_added_lines_are_numbered_in_their_row(spark):
    """Context moves the new side's number, removed lines and file marks do not; nothing is shuffled."""
    text = "@@ -3,2 +7,3 @@\n a\n-b\n+c\n+++ x\n--- y\n+d\r\n+"
    some = added_lines(spark.createDataFrame([(1, 1, "a.py", text), (1, 2, "a.py", "@@ -1 +0,0 @@\n-z")], "change_id long, hunk_seq int, file_path string, diff_text string"))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    assert sorted((r.hunk_seq, r.pos, r.line_number, r.text) for r in some.collect()) == [(1, 3, 8, "c"), (1, 6, 9, "d"), (1, 7, 10, "")]


def test_a_report_reads_its_steps_once(spark):
    steps = spark.range(5).selectExpr("id % 2 as change_id", "cast(id as int) as position", "'s' as step_id", "'background' as step_type", "'a.py' as file_path", "1 as start_line", "2 as end_line", "'' as explanation", "string(null) as change_kind", "string(null) as definition_name", "string(null) as definition_type", "string(null) as diff_text", "'L' as label")
    assert store.report(steps)._jdf.queryExecution().executedPlan().toString().count("Range (") == 1
    body = "STEP s\nType: background\nFile: a.py\nRange: 1-2\nLabel: L\nExplanation:\n(empty)\n---"
    assert {r.change_id: r.report for r in store.report(steps).collect()} == {0: "\n".join(["Steps: 3\n", *[body] * 3]), 1: "\n".join(["Steps: 2\n", *[body] * 2])}


def test_strings_of_a_megabyte_on_an_executor(spark):
    """No pattern may need a stack frame per character: an overflow ends the whole process."""
    shapes = ['"' + "a" * 1_000_000 + '"', '"' + '\\"' * 400_000, "'" + "\\x" * 400_000, '"' * 500_001, "f(" + "a." * 400_000 + "b)", "x" * 1_000_000]
    units = spark.createDataFrame([(1, "a.js", k, f"@@ -1 +1 @@\n+let v{k} = {x}") for k, x in enumerate(shapes)], "change_id long, file_path string, unit_seq int, diff_text string")
    got = graph.identifiers(units).repartition(2).groupBy("unit_seq").count().collect()
    assert len(got) == len(shapes)
    lines = spark.createDataFrame([(1, "a.js", k + 1, x) for k, x in enumerate(shapes)], "change_id long, file_path string, line_number int, text string")
    uses = ranges.references(units.selectExpr("change_id", "file_path", "unit_seq", "unit_seq + 1 as start_line", "unit_seq + 1 as end_line"), lines)
    assert uses.repartition(2).groupBy("unit_seq").count().count() == 3


def test_added_lines(spark):
    df = spark.createDataFrame([(1, 1, "a.py", "@@ -0,0 +1,3 @@\n+a\n+++b\n+c")], "change_id long, hunk_seq int, file_path string, diff_text string")
    assert [(r.line_number, r.text) for r in added_lines(df).orderBy("pos").collect()] == [(1, "a"), (2, "c")]


def test_runs(spark):
    df = spark.createDataFrame([(1, n) for n in (12, 3, 4, 5, 9, 10, 4)], "k long, line_number int")
    assert sorted((r.start_line, r.end_line) for r in line_runs(df, ["k"]).collect()) == [(3, 5), (9, 10), (12, 12)]


DEF = "change_id long, file_path string, def_seq int, name string, qualified_name string, kind string, start_line int, end_line int"


def test_innermost(spark):
    defs = spark.createDataFrame([(1, "a", 0, "outer", "outer", "function", 1, 600), (1, "a", 1, "inner", "inner", "function", 5, 10), (1, "b", 0, "x", "x", "function", 1, 5), (1, "b", 1, "y", "y", "function", 1, 5)], DEF)
    points = spark.createDataFrame([(1, "a", 7), (1, "a", 590), (1, "a", 700), (1, "b", 3)], "change_id long, file_path string, line_number int")
    got = {(r.file_path, r.line_number): r.in_name for r in ranges.innermost(points, defs).collect()}
    assert got == {("a", 7): "inner", ("a", 590): "outer", ("a", 700): None, ("b", 3): "x"}


def test_enclosing_header(spark):
    text = "def a():\n    pass\nx = 1\ny(2)"
    lines = source.source_lines(spark.createDataFrame([(1, "f.py", text)], "change_id long, file_path string, text string"))
    points = spark.createDataFrame([(1, "f.py", 4)], "change_id long, file_path string, line_number int")
    (r,) = ranges.enclosing_header(points, lines).collect()
    assert (r.in_name, r.in_start_line, r.in_end_line) == ("a", 1, 2)


def test_variable_ranges():
    lines = ["G = [", "  1,", "]", 'S = """a', 'b"""', "t = (1)", 'u = f("""x""",', ")", "v = (", ") \\", "[", "]", "w = {"]
    assert [r[-1] - 1 for r in source._variables("\n".join(lines))] == [2, 4, 5, 6, 11, 12]


def _plain_end(lines, at):
    balance = 0
    for j in range(at, len(lines)):
        plain = lines[j].split("#")[0]
        balance += sum(map(plain.count, "([{")) - sum(map(plain.count, ")]}"))
        if balance <= 0 and (j == at or not lines[j].strip().endswith("\\")):
            return j
    return len(lines) - 1


def test_variable_ranges_against_a_forward_scan():
    rng = random.Random(4)
    for _ in range(300):
        lines = ["x = " * rng.randint(0, 1) + "".join(rng.choice("()[]a #\\") for _ in range(rng.randint(0, 5))) for _ in range(rng.randint(1, 30))]
        begins = [k for k, line in enumerate(lines) if line.startswith("x = ")]
        ends = source.VariableEnds(lines, begins)
        assert [ends.end(k) for k in begins] == [_plain_end(lines, k) for k in begins]


def test_variable_ranges_of_unclosed_lines():
    for line in ("x = [", 'y = """', "z = [ \\", "w = {}"):
        began = time.process_time()
        assert len(list(source._variables("\n".join([line] * 100_000)))) == 100_000
        assert time.process_time() - began < 4


def test_script_source(spark):
    text = "class A {\n  run(x) {\n    return this.b().c(x);\n  }\n}\nexport const g = (a) => {\n  return new X(a);\n};\nlet z = 1;\n"
    rows = source.analyze(spark.createDataFrame([(1, "f.ts", text)], "change_id long, file_path string, text string"))
    assert [(r.name, r.qualified_name, r.kind, r.start_line, r.end_line) for r in source.definitions(rows).orderBy("def_seq").collect()] == [("A", "A", "class", 1, 5), ("run", "A.run", "method", 2, 4), ("g", "g", "function", 6, 8)]
    assert [(r.name, r.start_line) for r in source.script_globals(rows).orderBy("start_line").collect()] == [("g", 6), ("z", 9)]


def test_script_of_a_megabyte():
    text = "class A {\n  run(x) { return this.b(x).c({ y: [x] }); }\n}\nconst g = async (a) => {\n  return new X(a);\n};\nlet z = [\n  1 ];\n" * 9000
    began = time.process_time()
    rows = list(script.read(text))
    assert time.process_time() - began < 10 and len(text) > 1_000_000
    assert Counter(r[0] for r in rows) == {"definition": 27_000, "call": 18_000, "global": 18_000}
    assert rows[26_999][-2:] == (9000 * 8 - 4, 9000 * 8 - 2)


def test_python_of_deep_nesting():
    text = "x = " + " + ".join(f"f{k}(1)" for k in range(2500)) + "\ny = " + ".a" .join(["b"] * 2000) + "()"
    assert len([r for r in source._python(text) if r[0] == "call"]) >= 2500
    assert [r[2:] for r in source._python("class A:\n    def m(self):\n        pass\n\n    x = (\ndef f(:\n  y")] == [("A", "A", "class", 1, 5), ("m", "A.m", "method", 2, 3), ("f", "f", "function", 6, 7)]


def test_groups(spark):
    rows = [(1, "a", k, s, e) for k, (s, e) in enumerate([(1, 2), (4, 20), (6, 7), (25, 25), (31, 31)])]
    df = spark.createDataFrame(rows, "change_id long, file_path string, unit_seq int, start_line int, end_line int").selectExpr("*", "'f' as symbol_name", "'f' as definition_name", "'operation' as change_kind")
    got = steps.group_ranges(steps.proximity_groups(df)).orderBy("start_line").collect()
    assert [(r.start_line, r.end_line, r.n_units) for r in got] == [(1, 25, 4), (31, 31, 1)]


def test_order():
    units = [(1, "definition", 1), (2, "definition", 5), (3, "operation", 9)]
    placed = graph._ordered_components(units, [(3, 1), (3, 2), (1, 2)])
    assert [i for i, _, _ in placed] == [2, 3, 1] and {c for _, c, _ in placed} == {1}
    assert [i for i, _, _ in graph._ordered_components(units[:2], [(1, 2), (2, 1)])] == [1, 2]


def test_references_need_a_unique_name(spark):
    schema = "change_id long, file_path string, node_id string, label string, qualified_name string"
    refs = spark.createDataFrame([(1, "c", "u", "definition", "get", None)], "change_id long, file_path string, user string, kind string, name string, qualified_name string")
    two = spark.createDataFrame([(1, "a", "a1", "get", "get"), (1, "b", "b1", "get", "get")], schema)
    assert graph.resolve_references(refs, two).count() == 0
    assert graph.resolve_references(refs, two.where("file_path = 'a'")).count() == 1


def test_playlist(spark):
    rows = [(1, 1, "background", None), (1, 2, "main", "definition"), (1, 3, "main", "global"), (1, 4, "main", "operation")]
    df = spark.createDataFrame(rows, "change_id long, position int, step_type string, change_kind string")
    got = {r.position: r for r in steps.playlist(steps.visible(df, False, False)).collect()}
    assert sorted(p for p, r in got.items() if r.visible) == [2, 4]
    assert (got[2].next_position, got[4].previous_position, got[2].previous_position, got[3].jump_position) == (4, 2, 2, 4)


def test_store(spark, tmp_path):
    main = spark.createDataFrame([(1, 1, "main", "a.py", 1, 2, "old"), (1, 2, "main", "a.py", 1, 2, "new"), (1, 3, "main", "b.py", 3, 3, "b")], "change_id long, position int, step_type string, file_path string, start_line int, end_line int, explanation string")
    path = str(tmp_path / "store")
    store.write_store(store.store_of(main, " bug ", "2024-01-01T00:00:00Z"), path)
    assert {r.key: r.explanation for r in store.read_store(spark, path, "bug").collect()} == {"main|a.py|1-2": "new", "main|b.py|3-3": "b"}
    assert store.read_store(spark, path, "other").count() == 0
    left = store.missing(main, store.read_store(spark, path, "bug").where("file_path = 'a.py'"))
    assert [r.file_path for r in left.collect()] == ["b.py"]
    store.write_store(store.store_of(main, None, "t"), path)
    assert store.read_store(spark, path, "").count() == 2


def test_clearing_a_store(spark, tmp_path):
    main = spark.createDataFrame([(1, 1, "main", "a.py", 1, 2, "text")], "change_id long, position int, step_type string, file_path string, start_line int, end_line int, explanation string")
    path = str(tmp_path / "store")
    store.write_store(store.store_of(main, "bug", "t"), path)
    store.clear_store(spark, path)
    assert [r.explanation for r in store.explained(main, store.read_store(spark, path, "bug")).collect()] == [store.PLACEHOLDER]


def test_a_store_of_many_change_sets(spark, tmp_path):
    """Saving and clearing one change set leaves the others, and a store is read and written in one job."""
    main = spark.createDataFrame([(k, 1, "main", "a.py", 1, 2, f"text {k}") for k in range(200)], "change_id long, position int, step_type string, file_path string, start_line int, end_line int, explanation string")
    path = str(tmp_path / "store")
    told = lambda: {r.change_id: r.explanation for r in store.read_store(spark, path, "bug").collect()}
    store.save_store(store.store_of(main.where("change_id < 150"), "bug", "t"), path)
    store.save_store(store.store_of(main.where("change_id >= 150"), "bug", "t"), path)
    assert told() == {k: f"text {k}" for k in range(200)}
    store.save_store(store.store_of(main.where("change_id = 7").withColumn("explanation", F.lit("new")), "bug", "t"), path)
    store.clear_store(spark, path, spark.createDataFrame([(8,), (8,), (999,)], "change_id long"))
    assert told() == {k: f"text {k}" for k in range(200) if k != 8} | {7: "new"}
    stored = spark.read.schema(store.STORE).json(path)
    store.save_store(stored.where("change_id % 2 = 0").withColumn("intent", F.lit("other")), path)
    assert told() == {k: f"text {k}" for k in range(1, 200, 2)} | {7: "new"} and store.read_store(spark, path, "other").count() == 99
    store.clear_store(spark, path)
    assert told() == {}


def test_one_huge_diff_in_many_splits(spark, tmp_path):
    """A diff of one change set is read by several tasks, and its hunks are those of its whole text."""
    text = "".join(HEAD.replace("a.py", f"f{k}.py") + f"@@ -{k} +{k} @@\n+line {k}\n" * (k % 5) for k in range(3000))
    (tmp_path / "12.diff").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        read = store.read_diffs(spark, str(tmp_path))
        assert read.rdd.getNumPartitions() > 8
        got = parse_hunks(read).orderBy("hunk_seq").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == parse_hunks(spark.createDataFrame([(12, text)], "change_id long, diff_text string")).orderBy("hunk_seq").collect() and len(got) == 6000
    (tmp_path / "12.diff").write_text("--- a/x.py\n+++ b/x.py\n@@ -1 +1 @@\n+a\r\n" + HEAD.replace("\n", "\r\n") + "@@ -2 +2 @@\r\n+b\r\n")
    assert [(r.file_path, r.start_line, r.diff_text) for r in parse_hunks(store.read_diffs(spark, str(tmp_path))).orderBy("hunk_seq").collect()] == [("x.py", 1, "@@ -1 +1 @@\n+a"), ("a.py", 2, "@@ -2 +2 @@\n+b\n")]


def test_numbers_and_neighbours_over_blocks(spark, monkeypatch):
    from changeloom.operators import ranks

    monkeypatch.setattr(ranks, "BLOCK", 4)
    rng = random.Random(5)
    rows = [(c, n, rng.random() < 0.2) for c in (1, 2, 3) for n in range(1, 60)]
    df = spark.createDataFrame(rows, "change_id long, position int, visible boolean").repartition(5)
    got = ranks.numbered(df, ["change_id"], [ranks.block_of(-F.col("position"))], [F.desc("position")], "n").collect()
    assert {(r.change_id, r.position): r.n for r in got} == {(c, n): 60 - n for c, n, _ in rows}
    for r in ranks.neighbours(df, ["change_id"], "position", F.col("visible")).collect():
        seen = [n for c, n, v in rows if c == r.change_id and v]
        assert (r.before, r.after, r["first"]) == (max((n for n in seen if n < r.position), default=None), min((n for n in seen if n > r.position), default=None), min(seen, default=None))


def test_distinct_texts_are_parsed_once(spark):
    rows = [(k, f"d{k % 3}/f.py", f"def f{k % 2}(): pass") for k in range(40)] + [(k, "g.js", "function g() {}") for k in range(5)] + [(9, "h.ts", "function g() {}"), (9, "i.py", None), (9, "j.md", "x")]
    df = spark.createDataFrame(rows, "change_id long, file_path string, text string")
    parsed = source.parse_texts(source.keyed(df).unionByName(source.keyed(df)))
    assert parsed.select("digest").distinct().count() == 3 and parsed.count() == 3
    both = source.analyze_sides(head=df.where("change_id < 20"), revised=df)
    assert [source.definitions(both[s]).count() for s in ("head", "revised")] == [26, 46]


def test_sweep_is_the_smallest_range(spark):
    rng = random.Random(6)
    defs = [(1, rng.choice("ab"), k, f"n{k}", f"n{k}", "function", s, s + rng.randint(0, 400)) for k in range(60) for s in [rng.randint(1, 500)]] + [(1, "a", 99, "huge", "huge", "class", 1, 1_000_000)]
    points = [(1, f, n) for f in "abc" for n in range(1, 600, 7)]
    got = ranges.innermost(spark.createDataFrame(points, "change_id long, file_path string, line_number int"), spark.createDataFrame(defs, DEF)).collect()
    want = {(f, n): min(((e - s, k, name) for _, g, k, name, _, _, s, e in defs if g == f and s <= n <= e), default=(0, 0, None))[2] for _, f, n in points}
    assert {(r.file_path, r.line_number): r.in_name for r in got} == want


def test_written_report(spark, tmp_path):
    schema = "change_id long, position int, step_id string, step_type string, file_path string, start_line int, end_line int, change_kind string, definition_name string, definition_type string, diff_text string, label string, explanation string"
    rows = [(1, 2, "main-1", "main", "a.py", 3, 4, "global", "G", "variable", "+G = 1", None, None), (1, 1, "bg-1", "background", "a.py", 1, 1, None, None, None, None, "C", "why")]
    store.write_report(store.report_blocks(spark.createDataFrame(rows, schema)), str(tmp_path / "report"))
    texts = sorted((tmp_path / "report" / "change_id=1").glob("*.txt"))
    want = "Steps: 2\n\nSTEP bg-1\nType: background\nFile: a.py\nRange: 1-1\nLabel: C\nExplanation:\nwhy\n---\nSTEP main-1\nType: main\nFile: a.py\nRange: 3-4\nChangeKind: global\nDefinitionName: G\nDefinitionType: variable\nDiffText:\n+G = 1\nExplanation:\n(empty)\n---\n"
    assert "".join(t.read_text() for t in texts) == want == store.report(spark.createDataFrame(rows, schema)).first().report + "\n"


def test_requests_of_a_tour(spark):
    from changeloom.plans import jobs

    diff = HEAD + "@@ -2 +2 @@\n-    return 1\n+    return g(1)\n"
    texts = lambda t: spark.createDataFrame([(1, "a.py", t)], "change_id long, file_path string, text string")
    head, revised = texts("def f():\n    return 1\ndef g(x):\n    return x\n"), texts("def f():\n    return g(1)\ndef g(x):\n    return x\n")
    tour = jobs.diff_tour(spark.createDataFrame([(1, diff)], "change_id long, diff_text string"), head, revised)
    none = store.explanations(spark.createDataFrame([], store.STORE), "why")
    got = {r.step_id: r.request for r in jobs.explanation_requests(tour, head, revised, none, "why").collect()}
    assert set(got) == {"main-1", "bg-1"} and "Symbol: g" in got["bg-1"] and "return g(1)" in got["main-1"] and "return g(1)" not in got["bg-1"]
    some = tour.main.select("change_id", F.lit("main|a.py|2-2").alias("key"), F.lit("told").alias("explanation"))
    assert [r.step_id for r in jobs.explanation_requests(tour, head, revised, some, "why").collect()] == ["bg-1"]
    assert jobs.explanation_requests(tour, head, revised, some, "why", whole_gate=True).count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "src" / "node_modules").mkdir(parents=True)
    for name in ("src/a.ts", "src/b.md", "src/node_modules/c.js", "src/d.mjs"):
        (tmp_path / name).write_text("x")
    assert [r.file_path for r in store.read_sources(spark, str(tmp_path)).collect()] == ["src/a.ts"]
    (tmp_path / "diffs").mkdir()
    (tmp_path / "diffs" / "7.diff").write_text(HEAD + "@@ -1 +1 @@\n+a")
    (tmp_path / "diffs" / "8.diff").write_text(" \n")
    assert [r.change_id for r in store.read_diffs(spark, str(tmp_path / "diffs")).collect()] == [7]
    odd = tmp_path / "a (b)+c" / "x"
    (odd / "a (b)+c" / "x").mkdir(parents=True)
    (odd / "a (b)+c" / "x" / "é +%20.py").write_text("x")
    assert [r.file_path for r in store.read_sources(spark, str(odd)).collect()] == ["a (b)+c/x/é +%20.py"]


def test_called_definition_tiers(spark):
    from changeloom.operators.background import called_definitions

    calls = spark.createDataFrame([(1, "a", 1, 1, "run", "app.run")], "change_id long, file_path string, unit_seq int, call_seq int, name string, qualified_name string")
    defs = spark.createDataFrame([(1, "a", 1, "run", "run", "function", 1, 2), (1, "a", 2, "run", "X.run", "method", 4, 5)], DEF)
    assert [r.qualified_name for r in called_definitions(calls, defs).collect()] == ["run"]
    assert [r.qualified_name for r in called_definitions(calls, defs.where("def_seq = 2")).collect()] == ["X.run"]


def test_changes_applied_in_order():
    from changeloom.operators.overall import _apply_file

    units = [[1, False, "f", 1, 10, "function", None, None]]
    changes = [
        ("f", 2, 4, "definition", "function", "a"),
        (None, 3, 3, "operation", None, "b"),
        ("g", 20, 25, "definition", "function", "c"),
        (None, 22, 22, "operation", None, "d"),
        (None, 99, 99, "operation", None, "lost"),
        ("f", 5, 5, "global", "global", "e"),
    ]
    assert _apply_file(units, changes) == [[1, False, "f", 1, 10, "global", "operation", "a\nb\ne"], [2, True, "g", 20, 25, "function", "operation", "c\nd"]]


def test_explainer_gets_batches(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "unit_seq int, request string")
    assert {r.explanation for r in store.explain(df, lambda s: s.str.upper()).collect()} == {"X", "Y"}
    assert {r.explanation for r in store.explain(df).collect()} == {store.PLACEHOLDER}


def test_visibility(spark):
    nodes = spark.createDataFrame([(1, "a", "global", True), (1, "b", "function", False)], "change_id long, node_id string, element_kind string, is_overall boolean")
    edges = spark.createDataFrame([(1, "a", "b"), (1, "b", "b")], "change_id long, from_id string, to_id string")
    kept, left = graph.global_visibility(nodes, edges, False)
    assert [r.node_id for r in kept.collect()] == ["b"] and [(r.from_id, r.to_id) for r in left.collect()] == [("b", "b")]
    assert {r.node_id: r.hidden for r in graph.overall_visibility(nodes, True).collect()} == {"a": False, "b": True}


def test_connected_groups(spark):
    edges = spark.createDataFrame([(1, "a", "b"), (1, "c", "b"), (1, "x", "y"), (2, "a", "z")], "change_id long, from_id string, to_id string")
    got = {(r.change_id, r.node_id): r.group for r in graph.connected_groups(edges).collect()}
    assert got == {(1, "a"): "a", (1, "b"): "a", (1, "c"): "a", (1, "x"): "x", (1, "y"): "x", (2, "a"): "a", (2, "z"): "a"}
