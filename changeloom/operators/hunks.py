"""From unified diffs to hunks, added lines and runs of lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeloom.functions import text as T


#: A line end before a line that opens a hunk: any line with a hunk header but one that names a file.
_OPENS = rf"\r?\n(?!\+\+\+ |diff --git )(?=[^\n@]*+(?:(?!{T.HUNK})@[^\n@]*+)*+{T.HUNK})"
_NAMES = r"(?:^|\n)\+\+\+ ([^\n]*)"


def _hunks_of(sections: Column, root: str) -> Column:
    """The hunks of file sections as an array of ``file_path, diff_text``, by passes over the pieces of each.

    A section is cut before each line that opens a hunk. A piece says which file it names last, and a hunk's file is the last named in it or before.
    What a step has found is an element of the next one's array, so that it is not found again for every piece. Most pieces name no file and have
    plain line ends: they are a hunk's text as they stand, and only the others are taken apart.
    """
    none = F.array(F.lit(None).cast("string"))
    pieces = F.transform(sections, lambda s: F.split(F.concat(F.lit("\n"), s), _OPENS, -1))

    def each_path(marks: Column, step: Callable[[Column], Column]) -> Column:
        return F.transform(marks, lambda m: F.struct(m["at"].alias("at"), step(m["path"]).alias("path")))

    def marked(some: Column) -> Column:
        named = F.transform(some, lambda p, i: F.struct(i.alias("at"), F.when(p.contains("+++ "), F.element_at(F.concat(none, F.regexp_extract_all(p, F.lit(_NAMES), F.lit(1))), -1)).alias("path")))
        marks = F.filter(named, lambda m: m["path"].isNotNull())
        for step in (T.trim, lambda path: F.nullif(path, F.lit("/dev/null")), T.normalize_path, lambda path: T.below(path, root)):
            marks = each_path(marks, step)
        return F.struct(some.alias("pieces"), marks.alias("marks"))

    def told(piece: Column, at: Column, marks: Column) -> Column:
        path = F.try_element_at(F.filter(marks, lambda m: m["at"] <= at), F.lit(-1))["path"]
        whole = F.when(piece.contains("+++ ") | piece.contains("\r"), F.array_join(F.filter(T.lines(piece), lambda line: ~line.startswith("+++ ")), "\n")).otherwise(piece)
        return F.struct(path.alias("file_path"), whole.alias("diff_text"))

    found = F.transform(F.transform(pieces, marked), lambda s: F.slice(F.transform(s["pieces"], lambda p, i: told(p, i, s["marks"])), F.lit(2), F.greatest(F.size(s["pieces"]) - 1, F.lit(0))))
    return F.flatten(found)


def parse_hunks(diffs: DataFrame, root: str = "/work/repo") -> DataFrame:
    """``change_id, hunk_seq, file_path, start_line, end_line, diff_text``: a row per hunk of the new side.

    A text is cut before each ``diff --git`` line, which resets all state, and parsed in its row: nothing is shuffled. Any line that holds a hunk header begins a hunk; a ``+++`` line names the file from there on, even inside a
    hunk, and is no part of one. A hunk's file is the last named at its last line; hunks of deleted files, of files outside
    ``root`` and of Markdown files are dropped. Blank texts have no hunks.

    A change set may be in several rows with a ``part`` that orders them, as ``read_diffs`` gives it; then only the counts of hunks of its parts meet.
    """
    sections = F.split("diff_text", r"\r?\n(?=diff --git )", -1)
    found = diffs.where(F.col("diff_text").rlike(r"\S"))
    if "part" in diffs.columns:
        before = Window.partitionBy("change_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        found = found.withColumn("hunks", _hunks_of(sections, root))
        counts = found.select("change_id", "part", F.size("hunks").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        found = found.join(counts.drop("n"), ["change_id", "part"])
    else:
        found = found.withColumns({"before": F.lit(0), "hunks": _hunks_of(sections, root)})
    each = T.exploded(found, ["change_id", "before"], F.col("hunks"), "at", "h").select("change_id", (F.col("before") + F.col("at") + 1).cast("int").alias("hunk_seq"), "h.*").withColumn("header", F.substring_index("diff_text", "\n", 1))
    start = F.greatest(F.lit(1), F.regexp_extract("header", T.HUNK, 1).cast("int"))
    length = F.coalesce(F.nullif(F.regexp_extract("header", T.HUNK, 2), F.lit("")).cast("int"), F.lit(1))
    return keep_paths(each.select("change_id", "hunk_seq", "file_path", start.alias("start_line"), F.greatest(start, start + length - 1).alias("end_line"), "diff_text"))


def keep_paths(hunks: DataFrame) -> DataFrame:
    """Hunks of named files inside the root that are not Markdown; a path inside is relative by now."""
    path = F.col("file_path")
    return hunks.where(path.isNotNull() & (path != "") & ~path.startswith("/") & ~F.lower(path).endswith(".md"))


def _is_header(m: Column) -> Column:
    return (m["pos"] == 0) & m["line"].rlike(T.HUNK)


def _is_mark(m: Column) -> Column:
    return m["line"].startswith("+++") | m["line"].startswith("---")


def _some_lines(hunks: DataFrame, chosen: Callable[[Column], Column], *more: str) -> DataFrame:
    """The chosen lines of hunks, each with its place ``pos`` in the hunk and ``rank``, how many chosen ones stand before it; found in the row, so nothing is shuffled."""
    placed = F.transform(T.lines(F.col("diff_text")), lambda line, i: F.struct(i.alias("pos"), line.alias("line")))
    each = T.exploded(hunks, ["change_id", "hunk_seq", *more], F.filter(placed, chosen), "rank", "m")
    return each.select("change_id", "hunk_seq", *more, "rank", "m.*")


def _added(hunks: DataFrame, *more: str) -> DataFrame:
    """Added lines of hunks with their number on the new side: the lines of that side before one are what counts."""
    begun = hunks.withColumn("first", F.regexp_extract(F.substring_index("diff_text", "\n", 1), T.HUNK, 1).cast("int"))
    side = _some_lines(begun, lambda m: ~_is_header(m) & ~_is_mark(m) & (m["line"].startswith("+") | m["line"].startswith(" ")), "first", *more)
    return side.where(F.col("line").startswith("+")).withColumn("number", (F.col("first") + F.col("rank")).cast("int"))


def added_lines(hunks: DataFrame) -> DataFrame:
    """``change_id, hunk_seq, file_path, pos, line_number, text`` of each added line."""
    return _added(hunks, "file_path").select("change_id", "hunk_seq", "file_path", "pos", F.col("number").alias("line_number"), F.substr("line", F.lit(2)).alias("text"))


def filter_hunks(hunks: DataFrame, keep: DataFrame, include_removed: bool) -> DataFrame:
    """Hunk texts reduced to some added lines: ``keep`` has ``change_id, hunk_seq, part, line_number``; the result a ``diff_text`` per part.

    Headers and file marks stay, removed lines if asked for, context goes.
    """
    key = ["change_id", "hunk_seq"]
    keep = keep.select(*key, "part", F.col("line_number").alias("number")).distinct()
    fixed = _some_lines(hunks, lambda m: _is_header(m) | _is_mark(m) | (m["line"].startswith("-") if include_removed else F.lit(False)))
    whole = fixed.join(keep.select(*key, "part").distinct(), key).select(*key, "part", "pos", "line")
    chosen = _added(hunks).join(keep, [*key, "number"]).select(*key, "part", "pos", "line")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    return whole.unionByName(chosen).groupBy(*key, "part").agg(text.alias("diff_text"))


def line_runs(numbers: DataFrame, keys: list[str], line: str = "line_number") -> DataFrame:
    """Contiguous runs: ``keys, start_line, end_line``; repeated numbers count once."""
    some = numbers.select(*keys, line).distinct()
    island = F.col(line) - F.row_number().over(Window.partitionBy(*keys).orderBy(line))
    return some.withColumn("island", island).groupBy(*keys, "island").agg(F.min(line).alias("start_line"), F.max(line).alias("end_line")).drop("island")
