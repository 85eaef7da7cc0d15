"""Joins of lines and ranges with ranges of the same file: equi-joins on file and a bin of lines, then the exact condition."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeloom.functions import text as T

#: Lines of a bin: a range is copied to each bin that it touches, so a huge file spreads over many keys.
BIN = 256
FILE = ["change_id", "file_path"]
_HEADER = re.compile(r"(async\s+def|def|class)\s+([A-Za-z_][A-Za-z0-9_]*)")
_DEF = ["name", "qualified_name", "kind", "start_line", "end_line"]


def _binned(df: DataFrame, start: str, end: str) -> DataFrame:
    low, high = F.floor(F.col(start) / BIN), F.floor(F.greatest(F.col(end), F.col(start)) / BIN)
    return df.withColumn("__bin", F.explode(F.sequence(low, high)))


def lines_in_ranges(points: DataFrame, ranges: DataFrame, line: str = "line_number", start: str = "start_line", end: str = "end_line") -> DataFrame:
    """All pairs of a line and a range of its file that holds it."""
    a = points.withColumn("__bin", F.floor(F.col(line) / BIN))
    return a.join(_binned(ranges, start, end), [*FILE, "__bin"]).where(F.col(line).between(F.col(start), F.col(end))).drop("__bin")


def overlapping(left: DataFrame, right: DataFrame, left_range: tuple[str, str], right_range: tuple[str, str]) -> DataFrame:
    """All pairs of ranges of a file that share a line; each pair once, in the first bin that both touch."""
    a, b = _binned(left, *left_range), _binned(right, *right_range)
    both = a.join(b, [*FILE, "__bin"]).where((F.col(left_range[0]) <= F.col(right_range[1])) & (F.col(right_range[0]) <= F.col(left_range[1])))
    first = F.floor(F.greatest(F.col(left_range[0]), F.col(right_range[0])) / BIN)
    return both.where(F.col("__bin") == first).drop("__bin")


_INNER = "change_id long, file_path string, line_number int, name string, qualified_name string, kind string, start_line int, end_line int"


def _sweep(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows arrive file by file in the order of lines, ranges before lines; only the ranges that may still hold a line are held, on a heap with the smallest first."""
    names = [c.split()[0] for c in _INNER.split(", ")]
    file, opened = None, []
    for part in parts:
        found = []
        for change, path, line, asked, seq, end, name, qualified, kind in part.itertuples(index=False, name=None):
            if (change, path) != file:
                file, opened = (change, path), []
            if not asked:
                heapq.heappush(opened, (end - line, seq, line, end, name, qualified, kind))
                continue
            while opened and opened[0][3] < line:
                heapq.heappop(opened)
            if opened:
                _, _, start, end, name, qualified, kind = opened[0]
                found.append((change, path, line, name, qualified, kind, start, end))
            else:
                found.append((change, path, line, None, None, None, None, None))
        yield pd.DataFrame(found, columns=names).astype({"start_line": "Int32", "end_line": "Int32"})


def innermost(points: DataFrame, definitions: DataFrame, line: str = "line_number", prefix: str = "in_") -> DataFrame:
    """Distinct lines ``change_id, file_path, line`` with the smallest definition that holds each, the first of equals; null if none.

    Lines and ranges meet in one shuffle by file and one sweep over their sorted union: a range is one row, however long it is.
    """
    whole = lambda c, name: F.col(c).cast("int").alias(name)
    file = [F.col("change_id").cast("long").alias("change_id"), F.col("file_path").alias("file_path")]
    none = [F.lit(None).cast("string").alias(c) for c in ("name", "qualified_name", "kind")]
    some = points.select(*FILE, line).distinct().select(*file, whole(line, "at"), F.lit(1).alias("asked"), F.lit(0).alias("def_seq"), F.lit(0).alias("end"), *none)
    named = definitions.select(*file, whole("start_line", "at"), F.lit(0).alias("asked"), whole("def_seq", "def_seq"), whole("end_line", "end"), "name", "qualified_name", "kind")
    found = named.unionByName(some).repartition(*FILE).sortWithinPartitions(*FILE, "at", "asked").mapInPandas(_sweep, _INNER)
    return found.select(*FILE, F.col("line_number").alias(line), *[F.col(c).alias(f"{prefix}{c}") for c in _DEF])


_HEADERS = "change_id long, file_path string, start_line int, name string, kind string, end_line int"


def _read_headers(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows arrive file by file in the order of lines; only the headers that are open in the current file are held."""
    names = [c.split()[0] for c in _HEADERS.split(", ")]
    file, last = None, 0
    opened: list[tuple[int, list]] = []
    for part in parts:
        found = []

        def close(least: int) -> None:
            while opened and opened[-1][0] >= least:
                found.append([*opened.pop()[1], last])  # noqa: B023

        for change, path, number, text in part.itertuples(index=False, name=None):
            if (change, path) != file:
                close(0)
                file = change, path
            plain = text.lstrip()
            if plain:
                indent = len(text) - len(plain)
                close(indent)
                last = number
                if m := _HEADER.match(plain):
                    opened.append((indent, [change, path, number, m[2], "class" if m[1] == "class" else "function"]))
        yield pd.DataFrame(found, columns=names)
    yield pd.DataFrame([[*own, last] for _, own in opened], columns=names)


def header_ranges(lines: DataFrame) -> DataFrame:
    """Every ``def`` and ``class`` line of Python texts with the last line of its indented body: one shuffle by file and one pass over the lines.

    Of a line that can be no header only what tells its indent is moved, up to its first printed character; empty ones are not.
    """
    text = F.when(F.col("text").contains("def") | F.col("text").contains("class"), F.col("text")).otherwise(F.regexp_extract("text", "^[^!-~]*+[!-~]?", 0))
    slim = lines.where("text <> ''").select(F.col("change_id").cast("long").alias("change_id"), "file_path", F.col("line_number").cast("int").alias("line_number"), text.alias("text"))
    return slim.repartition(*FILE).sortWithinPartitions(*FILE, "line_number").mapInPandas(_read_headers, _HEADERS)


def enclosing_header(points: DataFrame, lines: DataFrame, line: str = "line_number") -> DataFrame:
    """Python lines with the nearest ``def`` or ``class`` line at or before each, and where its indented body ends; it need not hold the line."""
    some = points.select(*FILE, line).distinct()
    heads = header_ranges(lines.join(some.select(*FILE).distinct(), FILE, "left_semi"))
    head = F.struct("name", "kind", "start_line", "end_line")
    both = heads.select(*FILE, F.col("start_line").alias(line), head.alias("h"), F.lit(0).alias("asked")).unionByName(some.withColumns({"h": F.lit(None).cast("struct<name:string,kind:string,start_line:int,end_line:int>"), "asked": F.lit(1)}))
    before = F.last("h", ignorenulls=True).over(Window.partitionBy(*FILE).orderBy(line, "asked"))
    found = both.withColumn("h", before).where("asked = 1 and h is not null")
    return found.select(*FILE, line, F.col("h.name").alias("in_name"), F.col("h.name").alias("in_qualified_name"), F.col("h.kind").alias("in_kind"), F.col("h.start_line").alias("in_start_line"), F.col("h.end_line").alias("in_end_line"))


def normal_kind(kind: Column) -> Column:
    return F.when(kind.isin("interface", "type", "enum"), "function").otherwise(kind)


def resolve(hits: DataFrame, definitions: DataFrame) -> DataFrame:
    """For each hit ``change_id, file_path, hunk_seq, line_number, name, type``: the definition that it stands for.

    First the definitions that hold the line, those of the expected kind before others, the smallest of them; else the first of that name in the
    file; else the line itself.
    """
    keys = [*FILE, "hunk_seq", "line_number", "name", "type"]
    d = definitions.select(*FILE, F.col("def_seq").alias("d_seq"), *[F.col(c).alias(f"d_{c}") for c in _DEF])
    span = F.col("d_end_line") - F.col("d_start_line")
    holding = lines_in_ranges(hits, d, "line_number", "d_start_line", "d_end_line")
    holding = holding.withColumn("rank", F.struct(F.lit(0).alias("tier"), (F.col("d_kind") != normal_kind(F.col("type"))).cast("int").alias("other"), span.alias("span"), F.col("d_seq").alias("seq")))
    named = hits.join(d, (hits.change_id == d.change_id) & (hits.file_path == d.file_path) & (hits.name == d.d_name)).drop(d.change_id, d.file_path)
    named = named.withColumn("rank", F.struct(F.lit(1).alias("tier"), F.lit(0).alias("other"), F.lit(0).alias("span"), F.col("d_seq").alias("seq")))
    picked = [f"d_{c}" for c in _DEF]
    both = holding.select(*keys, "rank", *picked).unionByName(named.select(*keys, "rank", *picked))
    best = both.groupBy(*keys).agg(F.min_by(F.struct(*picked), "rank").alias("d"))
    out = hits.select(*keys).join(best, keys, "left")
    return out.select(*keys, F.coalesce("d.d_start_line", "line_number").cast("int").alias("start_line"), F.coalesce("d.d_end_line", "line_number").cast("int").alias("end_line"), F.col("d.d_kind").alias("kind"), F.col("d.d_qualified_name").alias("qualified_name"))


def references(units: DataFrame, lines: DataFrame) -> DataFrame:
    """Names that stand inside each unit's range: ``change_id, file_path, unit_seq, line_number, ref_seq, name, qualified_name``.

    On a line the dotted names come first (``name`` is their last part), then all simple ones; each once a line. Strings and Python
    comments do not count, nor Python ``def`` and ``class`` lines.
    """
    lang = T.language(F.col("file_path"))
    skip = (lang == "python") & T.trim(F.col("text")).rlike(r"^(def|class)\s+")
    plain = T.blank_code(F.col("text"), lang)
    dotted = F.transform(F.regexp_extract_all(plain, F.lit(T.DOTTED_NAME), F.lit(1)), lambda q: F.struct(F.element_at(F.split(q, r"\."), -1).alias("name"), q.alias("qualified_name")))
    simple = F.transform(F.regexp_extract_all(plain, F.lit(T.WHOLE_NAME), F.lit(1)), lambda n: F.struct(n.alias("name"), F.lit(None).cast("string").alias("qualified_name")))
    refs = lines.where(~F.coalesce(skip, F.lit(False))).select(*FILE, "line_number", lang.alias("lang"), F.posexplode(F.array_distinct(F.concat(dotted, simple))).alias("ref_seq", "r"))
    refs = refs.select(*FILE, "line_number", "lang", "ref_seq", "r.*").where(~T.ignored_in_index(F.col("name"), F.col("lang"))).drop("lang")
    return lines_in_ranges(refs, units.select(*FILE, "unit_seq", F.col("start_line").alias("u_start"), F.col("end_line").alias("u_end")), "line_number", "u_start", "u_end").drop("u_start", "u_end")
