"""What the corpus and the jobs over it write and move."""

import os

from changeloom.plans.corpus import Corpus
from changeloom.sources.tables import shared_folder

SF = "/root/testdata/sf0.01"


def written(spark):
    top = shared_folder(spark).removeprefix("file:")
    return sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(top) for f in names if f.endswith(".parquet"))


def test_the_corpus_writes_less_than_it_reads(spark):
    c, before = Corpus(spark, SF), written(spark)
    assert c.diffs().where("diff_text like '%@@%'").count() > 1000
    assert c.fx("fx_hunks").where("hunk_text is null").count() == 0
    assert written(spark) - before < sum(os.path.getsize(f"{SF}/{t}.parquet") for t in ("orders", "lineitem"))


def test_a_reference_is_moved_once_a_step_and_a_definition_is_its_own_node(spark):
    from changeloom.operators import graph

    refs = spark.createDataFrame([(1, "a", "u", "definition", "f", "C.f"), (1, "a", "u", "definition", "f", "D.f"), (1, "a", "u", "definition", "g", None), (1, "a", "u", "definition", "no", None)], "change_id long, file_path string, user string, kind string, name string, qualified_name string")
    ends = spark.createDataFrame([(1, "a", "n1", "f", "C.f"), (1, "a", "n2", "f", "f"), (1, "b", "n3", "g", "g")], "change_id long, file_path string, node_id string, label string, qualified_name string")
    found = graph.resolve_references(refs, ends)
    assert sorted(r.node_id for r in found.collect()) == ["n1", "n1", "n2", "n3"]
    assert "LeftAnti" not in found._jdf.queryExecution().toString()
    step = "change_id long, file_path string, step_id string, position int, change_kind string, definition_name string, qualified_name string, symbol_name string, container_name string, element_kind string, start_line int, end_line int, segment_id string, is_overall boolean"
    some = spark.createDataFrame([(1, "a", "main-1", 1, "definition", "f", "f", None, None, "function", 1, 2, None, False)], step)
    assert [(r.node_id, r.idx, r.label, [s.id for s in r.steps]) for r in graph.nodes(some).collect()] == [("main-1", 0, "f", ["main-1"])]


def test_logs_hold_many_change_sets(spark, tmp_path):
    from pyspark.sql import functions as F

    from changeloom.sources import store

    texts = {k: f"diff --git a/f{k}.py b/f{k}.py\n--- a/f{k}.py\n+++ b/f{k}.py\n@@ -1 +1 @@\n+commit {k}\n" + "+x\n" * (k % 7) for k in range(1, 501)}
    store.write_logs(spark.createDataFrame(list(texts.items()), "change_id long, diff_text string").repartition(3), str(tmp_path / "logs"))
    assert len(list((tmp_path / "logs").glob("*.txt"))) <= 3
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        read = store.read_logs(spark, str(tmp_path / "logs"))
        assert read.rdd.getNumPartitions() > 8
        assert {r.change_id: r.diff_text for r in read.collect()} == texts
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "one.txt").write_bytes(b"preamble\ncommit 7\r\ndiff --git a/a b/a\r\n+x")
    assert [tuple(r) for r in store.read_logs(spark, str(tmp_path / "one.txt")).collect()] == [(7, "diff --git a/a b/a\r\n+x\n")]


def test_files_of_diffs_are_fewer_than_change_sets(spark):
    import glob

    from changeloom.plans.queries import QUERIES

    top = f"{shared_folder(spark).removeprefix('file:')}/diffs"
    before = set(glob.glob(f"{top}/**/*.txt", recursive=True))
    found = QUERIES["hunks_of_files"](spark, SF)
    assert found.select("change_id").distinct().count() > 10 * len(set(glob.glob(f"{top}/**/*.txt", recursive=True)) - before) > 0


def test_hunks_are_parsed_once_for_steps_and_stores(spark):
    from changeloom.plans.queries import QUERIES

    for name in ("stored_explanations", "missing_explanations", "gated_explanations", "filtered_hunks"):
        assert "diff --git" not in QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_lines_that_are_no_headers_are_moved_without_their_texts(spark):
    import pandas as pd

    from changeloom.operators import ranges

    text = ["def a(x):", "　y = 1", "\té = 2", "  ", "", "\x1c\x1cclass B:", "        async def c(self):", "            return 'x'", "    # defined", "é = 3", "class D:", "  pass"]
    lines = [(1, "a.py", k, t) for k, t in enumerate(text, 1)]
    want = pd.concat(ranges._read_headers(iter([pd.DataFrame(lines)])))
    found = ranges.header_ranges(spark.createDataFrame(lines, "change_id long, file_path string, line_number int, text string"))
    assert sorted(tuple(r) for r in found.collect()) == sorted(want.itertuples(index=False, name=None))
    assert "[^!-~]" in found._jdf.queryExecution().toString()


def test_the_walk_of_python_sees_what_a_plain_walk_sees():
    import ast

    from changeloom.operators import source

    text = "@d(1)\nclass A(f(2), k=g()):\n    x: h() = [i(y) for y in j() if k(y)]\n    async def m(self, a=n()) -> o():\n        with p() as q: r(**s())\n        match t():\n            case {'a': u.V()}: w(f'{z(1)}')\n        return lambda: -aa() + bb().cc\n"
    seen = [(n.lineno, ast.unparse(n.func)) for n in ast.walk(ast.parse(text)) if isinstance(n, ast.Call)]
    assert sorted((r[5], r[2]) for r in source._python(text) if r[0] == "call") == sorted(seen)
    assert [r[2] for r in source._python(text) if r[0] == "definition"] == ["A", "m"]
