"""A corpus of code changes derived from orders and line items: one order is a file, one customer a change set.

The SQL runs on Spark and on DuckDB, so that an oracle knows definitions and calls in closed
form. A line item is a block of four lines; its flags say whether the change adds, revises,
shortens or keeps it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from changeloom.sources.tables import settle

#: Name, condition on (lg, k), and the four lines of a block.
_PY = {
    0: ("concat('def f', n, '(x):')", "concat('    y = f', m, '(x)')", "'    return y + \"f9(1)\"'", "''"),
    1: ("concat('class C', n, ':')", "concat('    def m', m, '(self):')", "concat('        return f', n, '(self.v)')", "''"),
    2: ("concat('G', n, ' = [')", "concat('    f', m, '(1),')", "']'", "''"),
    3: ("concat('f', n, '(G', m, ')')", "'# comment'", "concat('print(\"G', n, '\")')", "''"),
    4: ("concat('async def h', n, '(self, x):')", "concat('    await f', m, '(x)')", "concat('    self.a', m, ' = x')", "''"),
    5: ("concat('# c', n)", "''", "concat('x', n, ' == ', m)", "''"),
}
_JS = {
    0: ("concat('export function f', n, '(x) {')", "concat('  const y = f', m, '(x);')", "'  return y + \"f9(1)\";'", "'}'"),
    1: ("concat('class C', n, ' {')", "concat('  m', m, '() { return this.v; }')", "'  // note'", "'}'"),
    2: ("concat('const G', n, ' = [')", "concat('  f', m, '(1),')", "'];'", "''"),
    3: ("concat('f', n, '(G', m, ');')", "'// comment'", "concat('console.log(\"G', n, '\");')", "''"),
    4: ("concat('const h', n, ' = (x) => {')", "concat('  this.a', m, ' = x;')", "concat('  return f', m, '(x);')", "'};'"),
    5: ("concat('/* c', n, ' */')", "''", "concat('let x', n, ' = ', m, ';')", "''"),
}


def _line(i: int, shift: bool = False) -> str:
    cases = []
    for lg, templates in (("js", _JS), ("py", _PY)):
        for k, lines in templates.items():
            text = lines[i]
            if shift:
                text = text.replace("m, '", "(m + 1) % 5, '") if k in (0, 1, 2, 4) else f"concat('{'//' if lg == 'js' else '#'} was ', m)"
            cases.append(f"when {'lg =' if lg == 'js' else 'lg <>'} 'js' and k = {k} then {text}")
    return f"case {' '.join(cases)} end"


def with_blocks(orders: str = "orders", lineitem: str = "lineitem") -> str:
    """Common table expressions ``fx_blocks`` and ``fx_hunks``, to put after WITH."""
    return f"""
fx_items as (
  select o_custkey as change_id, o_orderkey as ok,
    case when o_orderkey % 6 in (0, 1) then 'js' when o_orderkey % 6 = 5 then 'md' else 'py' end as lg,
    concat('src/p', o_orderkey % 7, '/f', o_orderkey, case o_orderkey % 6 when 0 then '.ts' when 1 then '.js' when 5 then '.md' else '.py' end) as file_path,
    row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate, l_linestatus, l_returnflag) as b,
    l_partkey % 5 as n, l_suppkey % 5 as m, l_partkey % 6 as k,
    case when l_returnflag = 'A' then 'A' when l_returnflag = 'R' then 'R' when l_linestatus = 'F' then 'D' else 'U' end as op
  from {lineitem} join {orders} on l_orderkey = o_orderkey),
fx_blocks as (
  select *, 4 * b - 3 as s,
    1 + coalesce(sum(case op when 'A' then 0 when 'D' then 6 else 4 end) over (partition by ok order by b rows between unbounded preceding and 1 preceding), 0) as hs,
    {_line(0)} as l1, {_line(1)} as l2, {_line(2)} as l3, {_line(3)} as l4, {_line(1, shift=True)} as was
  from fx_items),
fx_hunks as (
  select *, case op when 'A' then s when 'R' then s + 1 else s + 3 end as start_line, case op when 'R' then s + 1 else s + 3 end as end_line,
    case op
      when 'A' then concat('@@ -', hs - 1, ',0 +', s, ',4 @@', chr(10), '+', l1, chr(10), '+', l2, chr(10), '+', l3, chr(10), '+', l4)
      when 'R' then concat('@@ -', hs + 1, ' +', s + 1, ' @@', chr(10), '-', was, chr(10), '+', l2)
      else concat('@@ -', hs + 4, ',2 +', s + 3, ',0 @@', chr(10), '-old', n, '()', chr(10), '-old', m, '()') end as hunk_text,
    row_number() over (partition by change_id order by ok, b) as hunk_seq,
    row_number() over (partition by change_id order by ok desc, b desc) as from_last,
    ok % 97 = 0 or ok % 89 = 0 or lg = 'md' as dropped
  from fx_blocks where op <> 'U')"""


def with_truth(orders: str = "orders", lineitem: str = "lineitem") -> str:
    """The same and ``fx_definitions``, ``fx_calls`` and ``fx_globals`` of the revised side, and ``fx_head_definitions``, in closed form; Markdown files have none."""
    return f"""{with_blocks(orders, lineitem)},
fx_code as (select * from fx_blocks where lg <> 'md'),
fx_definition_rows as (
  select change_id, file_path, b, 0 as part, concat('f', n) as name, concat('f', n) as qualified_name, 'function' as kind, s as start_line, case lg when 'py' then s + 2 else s + 3 end as end_line from fx_code where k = 0
  union all select change_id, file_path, b, 0, concat('C', n), concat('C', n), 'class', s, case lg when 'py' then s + 2 else s + 3 end from fx_code where k = 1
  union all select change_id, file_path, b, 1, concat('m', m), concat('C', n, '.m', m), 'method', s + 1, case lg when 'py' then s + 2 else s + 1 end from fx_code where k = 1
  union all select change_id, file_path, b, 0, concat('h', n), concat('h', n), 'function', s, case lg when 'py' then s + 2 else s + 3 end from fx_code where k = 4),
fx_definitions as (select change_id, file_path, row_number() over (partition by change_id, file_path order by b, part) as def_seq, name, qualified_name, kind, start_line, end_line from fx_definition_rows),
fx_call_rows as (
  select change_id, file_path, b, 0 as part, concat('f', m) as name, concat('f', m) as qualified_name, case when k = 4 and lg = 'js' then s + 2 else s + 1 end as line from fx_code where k in (0, 2, 4)
  union all select change_id, file_path, b, 0, concat('f', n), concat('f', n), s + 2 from fx_code where k = 1 and lg = 'py'
  union all select change_id, file_path, b, 0, concat('f', n), concat('f', n), s from fx_code where k = 3
  union all select change_id, file_path, b, 1, case lg when 'py' then 'print' else 'log' end, case lg when 'py' then 'print' else 'console.log' end, s + 2 from fx_code where k = 3),
fx_calls as (select change_id, file_path, row_number() over (partition by change_id, file_path order by b, part) as call_seq, name, qualified_name, line as start_line, line as end_line from fx_call_rows),
fx_globals as (
  select change_id, file_path, concat('G', n) as name, s as start_line, case lg when 'py' then s else s + 2 end as end_line from fx_code where k = 2
  union all select change_id, file_path, concat('h', n), s, s + 3 from fx_code where k = 4 and lg = 'js'
  union all select change_id, file_path, concat('x', n), s + 2, s + 2 from fx_code where k = 5),
fx_head as (select *, case op when 'R' then (m + 1) % 5 else m end as hm from fx_code where op <> 'A'),
fx_head_rows as (
  select change_id, file_path, b, 0 as part, concat('f', n) as name, concat('f', n) as qualified_name, 'function' as kind, hs as start_line, case lg when 'py' then hs + 2 else hs + 3 end as end_line from fx_head where k = 0
  union all select change_id, file_path, b, 0, concat('C', n), concat('C', n), 'class', hs, case lg when 'py' then hs + 2 else hs + 3 end from fx_head where k = 1
  union all select change_id, file_path, b, 1, concat('m', hm), concat('C', n, '.m', hm), 'method', hs + 1, case lg when 'py' then hs + 2 else hs + 1 end from fx_head where k = 1
  union all select change_id, file_path, b, 0, concat('h', n), concat('h', n), 'function', hs, case lg when 'py' then hs + 2 else hs + 3 end from fx_head where k = 4),
fx_head_definitions as (select change_id, file_path, row_number() over (partition by change_id, file_path order by b, part) as def_seq, name, qualified_name, kind, start_line, end_line from fx_head_rows)"""


#: Scripts of shapes that the blocks above lack: an order is a block of four lines in the script of its customer.
_SHAPES = {
    0: ("concat('exports.f', n, ' = function (x) {')", "concat('  return a', m, '.b().c(x);')", "'};'", "''"),
    1: ("concat('const o', n, ' = {')", "concat('  m', m, '(x) { return `v ${g', n, '(x)}`; },')", "'};'", "''"),
    2: ("concat('const z', n, ' = (a = f', m, '()) => {')", "concat('  function inner', m, '() { h', n, '(1); }')", "'};'", "''"),
    3: ("concat('function* gen', n, '() {')", "concat('  yield new K', m, '(p', n, '()).q();')", "'}'", "''"),
    4: ("concat('class C', n, ' extends mix', m, '(B) {')", "concat('  static async run', m, '() { await this.t.u', n, '(); }')", "'}'", "''"),
    5: ("concat('s', n, ' = \"', repeat('ab', 3000), '\\\\\"', repeat('cd(', 2000), '\"; w', m, '(/re(g/);')", "''", "concat('if (x', n, ') /[/]/.test(v', m, ');')", "''"),
}


def with_scripts(orders: str = "orders") -> str:
    """``fx_scripts``: change set, file, block, first line and numbers of each block, to put after WITH."""
    return f"""fx_scripts as (select o_custkey as change_id, concat('web/s', o_custkey, '.js') as file_path, o_orderkey % 6 as k, o_orderkey % 7 as n, o_custkey % 5 as m,
    row_number() over (partition by o_custkey order by o_orderkey) as b, 4 * row_number() over (partition by o_custkey order by o_orderkey) - 3 as s from {orders})"""


#: Tables of the corpus that were written, by application, data folder, name, and the times of the folder's files.
_written: dict[tuple[str, str, str, str], DataFrame] = {}


#: What orders the line items of an order; the rest of an item is its block.
_ITEM_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate, l_linestatus, l_returnflag"
_LG = "case when ok % 6 in (0, 1) then 'js' when ok % 6 = 5 then 'md' else 'py' end as lg"
_PATH = "concat('src/p', ok % 7, '/f', ok, case ok % 6 when 0 then '.ts' when 1 then '.js' when 5 then '.md' else '.py' end) as file_path"
_PLACED = ["change_id", "ok", "lg", "file_path"]


def _of(text: str, x: str = "x", file: str = "") -> str:
    """An expression over the columns of a block, as one over the fields of ``x``, and of ``file`` for those of its file."""

    def field(t: re.Match) -> str:
        return t[1] or (f"{file}{t[2]}" if t[2] == "lg" else f"(4 * {x}.b - 3)" if t[2] == "s" else f"{x}.{t[2]}")

    return re.sub(r"('[^']*')|\b(lg|n|m|k|op|hs|s|b)\b", field, text)


def _text(i: int, shift: bool = False) -> str:
    """As ``_line`` has it, with one look at the language and one at the kind."""
    told = {lg: " ".join(f"when {k} then {_shifted(lines[i], k, lg) if shift else lines[i]}" for k, lines in templates.items()) for lg, templates in (("js", _JS), ("py", _PY))}
    return f"case when lg = 'js' then case k {told['js']} end else case k {told['py']} end end"


def _shifted(text: str, k: int, lg: str) -> str:
    return text.replace("m, '", "(m + 1) % 5, '") if k in (0, 1, 2, 4) else f"concat('{'//' if lg == 'js' else '#'} was ', m)"


def _said(template: str, n: int, m: int) -> str:
    """What a template of a line says for two numbers."""
    values = {"n": str(n), "m": str(m), "(m + 1) % 5": str((m + 1) % 5)}
    return "".join(text or values.get(name, "") for text, name in re.findall(r"'([^']*)'|(\(m \+ 1\) % 5|\bn\b|\bm\b)", template))


def _looked_up(text: str, joined: str) -> str:
    """The text of a block: looked up among those of all languages, kinds and numbers, and put together only for numbers below zero. ``text`` has places for the lines, ``was`` at 4."""
    found = []
    for lg, templates in (("js", _JS), ("py", _PY)):
        for k, lines in templates.items():
            found += [text.format(*[_said(x, n, m) for x in (*lines, _shifted(lines[1], k, lg))]) for n in range(5) for m in range(5)]
    return f"if(k >= 0 and n >= 0 and m >= 0, element_at(array('{"', '".join(found)}'), cast(if(lg = 'js', 1, 151) + 25 * k + 5 * n + m as int)), {joined})"


#: Of a block with its place: the text of its hunk, what it begins and calls, and the globals.
_ALL = f"concat_ws(chr(10), {', '.join(_text(i) for i in range(4))})"
_HUNK = f"""case op
  when 'A' then concat('@@ -', hs - 1, ',0 +', s, ',4 @@', {_looked_up("\n+{0}\n+{1}\n+{2}\n+{3}", f"concat(chr(10), '+', {_text(0)}, chr(10), '+', {_text(1)}, chr(10), '+', {_text(2)}, chr(10), '+', {_text(3)})")})
  when 'R' then concat('@@ -', hs + 1, ' +', s + 1, ' @@', {_looked_up("\n-{4}\n+{1}", f"concat(chr(10), '-', {_text(1, True)}, chr(10), '+', {_text(1)})")})
  else concat('@@ -', hs + 4, ',2 +', s + 3, ',0 @@', chr(10), '-old', n, '()', chr(10), '-old', m, '()') end"""
_REVISED = _looked_up("{0}\n{1}\n{2}\n{3}", _ALL)
_HEAD = f"""case op when 'R' then {_looked_up("{0}\n{4}\n{2}\n{3}", f"concat_ws(chr(10), {_text(0)}, {_text(1, True)}, {_text(2)}, {_text(3)})")}
  when 'D' then concat({_REVISED}, chr(10), 'old', n, '()', chr(10), 'old', m, '()') else {_REVISED} end"""


def _named(name: str, qualified: str, kind: str, start: str, end: str) -> str:
    return f"named_struct('name', {name}, 'qualified_name', {qualified}, 'kind', '{kind}', 'start_line', {start}, 'end_line', {end})"


def _defined(s: str, m: str) -> str:
    """Definitions of a block that begins on line ``s``, as an array in the order of the text."""
    whole, below = f"{s} + if(lg = 'py', 2, 3)", f"{s} + if(lg = 'py', 2, 1)"
    one = {k: _named(f"concat('{c}', n)", f"concat('{c}', n)", kind, s, whole) for k, c, kind in ((0, "f", "function"), (1, "C", "class"), (4, "h", "function"))}
    method = _named(f"concat('m', {m})", f"concat('C', n, '.m', {m})", "method", f"{s} + 1", below)
    return f"case k when 0 then array({one[0]}) when 1 then array({one[1]}, {method}) when 4 then array({one[4]}) else array() end"


def _call(name: str, qualified: str, line: str) -> str:
    return f"named_struct('name', {name}, 'qualified_name', {qualified}, 'start_line', {line}, 'end_line', {line})"


_M, _N = "concat('f', m)", "concat('f', n)"
_CALLS = f"""case k when 0 then array({_call(_M, _M, 's + 1')}) when 2 then array({_call(_M, _M, 's + 1')}) when 4 then array({_call(_M, _M, "s + if(lg = 'js', 2, 1)")})
  when 1 then if(lg = 'py', array({_call(_N, _N, 's + 2')}), array()) when 3 then array({_call(_N, _N, 's')}, {_call("if(lg = 'py', 'print', 'log')", "if(lg = 'py', 'print', 'console.log')", 's + 2')}) else array() end"""


class Corpus:
    """The corpus of one data folder as DataFrames.

    Written to the shared folder is, when it is first asked for, one row per file with a few small numbers per block. All tables and texts are made of these rows, each by itself;
    only a diff is made of several, those of its change set.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._seen: str | None = None

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, select: str, *names: str) -> DataFrame:
        """A SELECT over some of the tables of ``fx``."""
        text = select.replace("{", "{{").replace("}", "}}")
        for name in names:
            text = re.sub(rf"\b{name}\b", f"{{{name}}}", text)
        return self.spark.sql(text, **{name: self.fx(name) for name in names})

    def _version(self) -> str:
        """Files of the folder's tables with their times: what was written from others is written anew."""
        if self._seen is None:
            jvm, conf = self.spark._jvm, self.spark._jsparkSession.sessionState().newHadoopConf()
            paths = [jvm.org.apache.hadoop.fs.Path(f) for t in ("orders", "lineitem") for f in self.table(t).inputFiles()]
            self._seen = str([(p.toString(), p.getFileSystem(conf).getFileStatus(p).getModificationTime()) for p in paths])
        return self._seen

    def _once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name, self._version())
        if key not in _written:
            _written[key] = settle(make())
        return _written[key]

    def files(self) -> DataFrame:
        """``change_id, ok, lg, file_path, blocks, before, total``: a row per file; ``blocks`` has ``n, m, k, op, hs`` of each block in order, ``before`` and ``total`` count the hunks of the change set."""

        def make() -> DataFrame:
            blocks = self.spark.sql(
                f"""select change_id, ok, b, n, m, k, op, cast(1 + coalesce(sum(case op when 'A' then 0 when 'D' then 6 else 4 end) over (partition by ok order by {_ITEM_ORDER} rows between unbounded preceding and 1 preceding), 0) as int) as hs from (
                  select o_custkey as change_id, o_orderkey as ok, {_ITEM_ORDER}, cast(row_number() over (partition by o_orderkey order by {_ITEM_ORDER}) as int) as b, cast(l_partkey % 5 as tinyint) as n, cast(l_suppkey % 5 as tinyint) as m, cast(l_partkey % 6 as tinyint) as k,
                    case when l_returnflag = 'A' then 'A' when l_returnflag = 'R' then 'R' when l_linestatus = 'F' then 'D' else 'U' end as op from {{lineitem}} join {{orders}} on l_orderkey = o_orderkey)""",
                orders=self.table("orders"), lineitem=self.table("lineitem"),
            )
            files = blocks.groupBy("ok", "change_id").agg(F.array_sort(F.collect_list(F.struct("b", "n", "m", "k", "op", "hs"))).alias("blocks"))
            counted = files.withColumn("own", F.size(F.filter("blocks", lambda x: x["op"] != "U")))
            whole = Window.partitionBy("change_id")
            before = F.coalesce(F.sum("own").over(whole.orderBy("ok").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            return counted.select("change_id", "ok", "blocks", before.cast("int").alias("before"), F.sum("own").over(whole).cast("int").alias("total"))

        return self._once("files", make).selectExpr("change_id", "ok", _LG, _PATH, "blocks", "before", "total")

    def _blocks(self, only: str = "true") -> DataFrame:
        """A row per block of those for which ``only`` holds, with its place ``at`` among them."""
        each = self.files().selectExpr(*_PLACED, "before", "total", f"posexplode(filter(blocks, x -> {_of(only)})) as (at, x)")
        return each.selectExpr(*_PLACED, "before", "total", "at", "x.*", "4 * x.b - 3 as s")

    def _listed(self, of: str, what: str, seq: str, only: str = "true") -> DataFrame:
        """What the blocks of code files list, numbered in their file."""
        found = self.files().where("lg <> 'md'").selectExpr("change_id", "file_path", f"posexplode(flatten(transform(filter(blocks, x -> {_of(only)}), x -> {_of(of)}))) as (at, d)")
        return found.selectExpr("change_id", "file_path", f"at + 1 as {seq}", *[f"d.{c}" for c in what.split()])

    def fx(self, name: str) -> DataFrame:
        """One of the common table expressions."""
        block = [*_PLACED, "b", "n", "m", "k", "op", "s", "hs", *[f"{_text(i)} as l{i + 1}" for i in range(4)], f"{_text(1, True)} as was"]
        if name == "fx_blocks":
            return self._blocks().selectExpr(*block)
        if name == "fx_hunks":
            ends = ["case op when 'A' then s when 'R' then s + 1 else s + 3 end as start_line", "case op when 'R' then s + 1 else s + 3 end as end_line"]
            return self._blocks("op <> 'U'").selectExpr(*block, *ends, f"{_HUNK} as hunk_text", "before + at + 1 as hunk_seq", "total - before - at as from_last", "ok % 97 = 0 or ok % 89 = 0 or lg = 'md' as dropped")
        if name == "fx_definitions":
            return self._listed(_defined("s", "m"), "name qualified_name kind start_line end_line", "def_seq")
        if name == "fx_head_definitions":
            return self._listed(_defined("hs", "if(op = 'R', (m + 1) % 5, m)"), "name qualified_name kind start_line end_line", "def_seq", "op <> 'A'")
        if name == "fx_calls":
            return self._listed(_CALLS, "name qualified_name start_line end_line", "call_seq")
        if name == "fx_globals":
            found = self._blocks("k in (2, 4, 5)").where("lg <> 'md' and (k <> 4 or lg = 'js')")
            return found.selectExpr("change_id", "file_path", "concat(case k when 2 then 'G' when 4 then 'h' else 'x' end, n) as name", "if(k = 5, s + 2, s) as start_line", "case k when 2 then if(lg = 'py', s, s + 2) when 4 then s + 3 else s + 2 end as end_line")
        raise ValueError(name)

    def diffs(self) -> DataFrame:
        """``change_id, diff_text``: one unified diff without context per change set; the text ends with a line feed."""
        hunks = f"array_join(transform(filter(f.blocks, x -> x.op <> 'U'), x -> {_of(_HUNK, file='f.')}), chr(10))"
        target = "case when f.ok % 97 = 0 then '/dev/null' when f.ok % 89 = 0 then concat('/elsewhere/', f.file_path) else concat('b/', f.file_path) end"
        section = f"concat('diff --git a/', f.file_path, ' b/', f.file_path, chr(10), '--- a/', f.file_path, chr(10), '+++ ', {target}, chr(10), {hunks})"
        changed = self.files().where("exists(blocks, x -> x.op <> 'U')").groupBy("change_id").agg(F.array_sort(F.collect_list(F.struct("ok", "lg", "file_path", "blocks"))).alias("files"))
        return changed.selectExpr("change_id", f"concat(array_join(transform(files, f -> {section}), chr(10)), chr(10)) as diff_text")

    def scripts(self) -> DataFrame:
        """``change_id, file_path, text``: a script per customer."""

        def make() -> DataFrame:
            line = lambda i: F.expr("case k " + " ".join(f"when {k} then {lines[i]}" for k, lines in _SHAPES.items()) + " end")
            blocks = self.spark.sql(f"with {with_scripts('{orders}')} select * from fx_scripts", orders=self.table("orders")).withColumn("x", F.concat_ws("\n", *[line(i) for i in range(4)]))
            text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "x"))), lambda x: x["x"]), "\n")
            return blocks.groupBy("change_id", "file_path").agg(text.alias("text"))

        return self._once("scripts", make)

    def definitions(self, side: str = "revised") -> DataFrame:
        return self.fx("fx_definitions" if side == "revised" else "fx_head_definitions")

    def calls(self) -> DataFrame:
        return self.fx("fx_calls")

    def globals(self) -> DataFrame:
        return self.fx("fx_globals")

    def snapshots(self, side: str = "revised") -> DataFrame:
        """``change_id, file_path, text`` of one side; a file whose blocks are all added has no head text."""
        some, body = ("blocks", _REVISED) if side == "revised" else ("filter(blocks, x -> x.op <> 'A')", _HEAD)
        return self.files().where(f"size({some}) > 0").selectExpr("change_id", "file_path", f"array_join(transform({some}, x -> {_of(body)}), chr(10)) as text")
