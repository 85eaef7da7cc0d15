"""Literal cases of the column functions."""

import pytest
from pyspark.sql import functions as F

from changeloom.functions import text as T


@pytest.fixture(scope="module")
def value(spark):
    one = spark.range(1)
    return lambda c: one.select(c.alias("v")).first().v


def test_language(value):
    assert [value(T.language(F.lit(p))) for p in ("a.mjs", "b.TSX", "c.py", "d.go")] == ["javascript", "typescript", "python", None]


def test_paths(value):
    assert value(T.normalize_path(F.lit("b/src\\.//x/../f.py"))) == "src/f.py"
    assert value(T.normalize_path(F.lit("/a/../../b"))) == "/../b"
    assert value(T.relative_path(F.lit("/work/repo/x/f.py"), "/work/repo")) == "x/f.py"
    assert value(T.relative_path(F.lit("/elsewhere/f.py"), "/work/repo")) == "/elsewhere/f.py"


def test_change_type(value):
    cases = {"@@\n-x": "remove", "@@\n+x": "add", "@@\n-x\n+y": "modify", "@@ -1 +1 @@": "unknown", "+++ b/x\n--- a/x": "unknown"}
    assert {d: value(T.change_type(F.lit(d))) for d in cases} == cases


@pytest.mark.parametrize(
    "line,lang,want",
    [
        ("x == 1", "python", ("x", "variable")),
        ("x: int = 1", "python", None),
        ("from a import b", "python", None),
        ("  async def f(x):", "python", ("f", "function")),
        ("const f = (a) => b", "typescript", ("f", "variable")),
        ("const f = a=>b", "typescript", ("f", "function")),
        ("const f = function () {}", "typescript", ("f", "function")),
        ("export default function g() {}", "typescript", None),
        ("const {a} = b", "javascript", None),
        ("type T = X", "typescript", ("T", "type")),
        ("export interface I {", "typescript", ("I", "interface")),
        ("class C", "go", None),
    ],
)
def test_definition_header(value, line, lang, want):
    got = value(T.definition_header(F.lit(line), F.lit(lang)))
    assert (tuple(got) if got else None) == want


def test_strings_names_and_words(spark, value):
    assert value(T.blank_strings(F.lit('y = "abc\\" z'))) == "y =   z"
    assert value(T.blank_code(F.lit("z = 'it' + \"q'q\" # c"), F.lit("python"))) == "z =   +   "
    assert value(F.regexp_extract_all(F.lit("élan foo(bar)"), F.lit(T.WHOLE_NAME), F.lit(1))) == ["lan", "foo", "bar"]
    assert value(T.contains_name(F.lit("a f(x)"), F.lit("f"))) and not value(T.contains_name(F.lit("af(x)"), F.lit("f"))) and not value(T.contains_name(F.lit("x"), F.lit("")))
    assert value(T.contains_name(F.lit("a $x b"), F.lit("$x")))
    assert [value(T.meaningful(F.lit(x), F.lit("python"))) for x in ("\t# a", "a", " ")] == [False, True, False]
    assert [value(T.meaningful(F.lit(x), F.lit("javascript"))) for x in ("// a", "* a", "# a")] == [False, False, True]
    assert value(T.ignored(F.lit("const"))) and not value(T.ignored_in_index(F.lit("const"), F.lit("python")))
    assert value(T.ignored_in_index(F.lit("with"), F.lit("python"))) and not value(T.ignored_in_index(F.lit("with"), F.lit("typescript")))


def test_containers_and_ranks(value):
    q = F.lit("A.B.m")
    assert (value(T.container(q)), value(T.last_container(q))) == ("A.B", "B")
    assert (value(T.container(F.lit("m"))), value(T.last_container(F.lit("m")))) == (None, None)
    assert [value(T.background_rank(F.lit(x))) for x in ("Parser", "parse", "Parser.run", None)] == [0, 1, 1, 1]


def test_truncate(value):
    cut = value(T.truncate_middle(F.lit("x" * 100), 50))
    assert len(cut) == 55 and cut.startswith("x" * 30 + "\n...") and cut.endswith("\nxxxx")
    assert value(T.truncate_middle(F.lit("x" * 50), 50)) == "x" * 50
