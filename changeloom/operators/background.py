"""Existing code that a change depends on: the class around a unit and the definitions that it calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changeloom.functions import text as T
from changeloom.operators.ranges import FILE, innermost, overlapping


def unit_calls(units: DataFrame, calls: DataFrame, *more: str) -> DataFrame:
    """Calls whose lines overlap a unit's: ``change_id, file_path, unit_seq, call_seq, name, qualified_name, start_line, end_line``, and ``more`` columns of the unit."""
    u = units.select(*FILE, "unit_seq", *more, F.col("start_line").alias("u_start"), F.col("end_line").alias("u_end"))
    return overlapping(u, calls.select(*FILE, "call_seq", "name", "qualified_name", "start_line", "end_line"), ("u_start", "u_end"), ("start_line", "end_line")).drop("u_start", "u_end")


def called_definitions(calls: DataFrame, definitions: DataFrame) -> DataFrame:
    """The definition of the same file that each call names: qualified name before name on the definition's side, qualified call before simple; the first of equals."""
    keys = [*FILE, "unit_seq", "call_seq"]
    tries = F.array(*[F.struct(F.lit(t).alias("tier"), F.lit(by).alias("by"), F.col(c).alias("key")) for t, (by, c) in enumerate((("qualified", "qualified_name"), ("qualified", "name"), ("name", "qualified_name"), ("name", "name")))])
    asked = calls.select(*keys, F.explode(tries).alias("t")).select(*keys, "t.*").where("key is not null and key <> ''")
    d = definitions.select(*FILE, "def_seq", F.struct(F.col("name").alias("d_name"), "qualified_name", "kind", "start_line", "end_line").alias("d"), "name", "qualified_name")
    offered = d.select(*FILE, "def_seq", "d", F.explode(F.array(F.struct(F.lit("qualified").alias("by"), F.col("qualified_name").alias("key")), F.struct(F.lit("name").alias("by"), F.col("name").alias("key")))).alias("o")).select(*FILE, "def_seq", "d", "o.*")
    best = asked.join(offered, [*FILE, "by", "key"]).groupBy(*keys).agg(F.min_by("d", F.struct("tier", "def_seq")).alias("d"))
    return best.select(*keys, "d.*")


def background_regions(units: DataFrame, calls: DataFrame, head_definitions: DataFrame, both: DataFrame) -> DataFrame:
    """``change_id, file_path, unit_seq, pos, start_line, end_line, label``: the enclosing class's first line, then called definitions in order of call.

    ``both`` lists the files with texts on both sides. Lines of the revised side are looked up among definitions of the head side. A region
    counts once per unit, whatever its label.
    """
    some = units.join(both.select(*FILE).distinct(), FILE, "left_semi")
    at = some.select(*FILE, F.col("start_line").alias("line_number"))
    around = innermost(at, head_definitions.where("kind = 'class'")).where("in_name is not null")
    classes = some.select(*FILE, "unit_seq", F.col("start_line").alias("line_number")).join(around, [*FILE, "line_number"]).select(*FILE, "unit_seq", F.lit(0).alias("seq"), F.col("in_start_line").alias("start_line"), F.col("in_start_line").alias("end_line"), F.col("in_name").alias("label"))
    called = called_definitions(unit_calls(some, calls), head_definitions).select(*FILE, "unit_seq", F.col("call_seq").alias("seq"), "start_line", "end_line", F.coalesce("qualified_name", "d_name").alias("label"))
    every = classes.unionByName(called)
    same = Window.partitionBy(*FILE, "unit_seq", "start_line", "end_line").orderBy("seq")
    once = every.withColumn("n", F.row_number().over(same)).where("n = 1").drop("n")
    return once.withColumn("pos", F.row_number().over(Window.partitionBy(*FILE, "unit_seq").orderBy("seq"))).drop("seq")


def debug_report(units: DataFrame, calls: DataFrame, regions: DataFrame) -> DataFrame:
    """``change_id, file_path, unit_seq, report``: a text per unit that says its place, symbol, kinds, definition and segment, and lists its calls and helpers with their lines."""
    keys = [*FILE, "unit_seq"]
    span = lambda a, b: F.concat(F.lit("("), F.col(a).cast("string"), F.lit("-"), F.col(b).cast("string"), F.lit(")"))

    def listed(of: DataFrame, seq: str, name, n: str, lines: str) -> DataFrame:
        each = of.withColumn("__line", F.concat(F.lit("- "), name, F.lit(" "), span("start_line", "end_line")))
        ordered = F.transform(F.array_sort(F.collect_list(F.struct(seq, "__line"))), lambda x: x["__line"])
        return each.groupBy(*keys).agg(F.count("*").alias(n), F.array_join(ordered, "\n").alias(lines))

    c = listed(calls, "call_seq", F.coalesce("qualified_name", "name"), "n_calls", "calls")
    r = listed(regions, "pos", F.coalesce("label", F.lit("unknown")), "n_helpers", "helpers")
    said = lambda label, c, other="n/a": F.concat(F.lit(f"{label}: "), F.coalesce(F.col(c).cast("string"), F.lit(other)))
    body = F.concat_ws(
        "\n",
        F.concat(F.lit("Main "), "step_id", F.lit(": "), "file_path", F.lit(" "), span("start_line", "end_line")),
        F.concat(F.lit("Symbol: "), F.coalesce("symbol_name", F.lit("unknown"))),
        said("ChangeKind", "change_kind", "unknown"),
        F.concat(said("Definition", "definition_name"), F.lit(" ("), F.coalesce("definition_type", F.lit("n/a")), F.lit(")")),
        said("QualifiedName", "qualified_name"), said("ElementKind", "element_kind"), said("SegmentId", "segment_id"),
        said("Related calls", "n_calls", "none"), "calls", said("Resolved helpers", "n_helpers", "none"), "helpers",
    )
    return units.join(c, keys, "left").join(r, keys, "left").select(*keys, body.alias("report"))


def requests(units: DataFrame, contexts: DataFrame, intent: str, most: int = 12_000) -> DataFrame:
    """A request text per unit: guidance by change type, intent, place, diff, and both file texts cut in the middle; texts are cut before the join."""
    short = contexts.select(*FILE, T.truncate_middle(F.coalesce("original_text", F.lit("")), most).alias("before"), T.truncate_middle(F.coalesce("revised_text", F.lit("")), most).alias("after"))
    place = F.concat(F.col("file_path"), F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    body = F.concat_ws("\n", T.guidance(F.col("change_type")), F.concat(F.lit("Intent: "), F.lit(intent)), F.concat(F.lit("Place: "), place), F.concat(F.lit("Symbol: "), F.coalesce("symbol_name", "definition_name", F.lit("-"))), F.lit("Change:"), "diff_text", F.lit("Before:"), "before", F.lit("After:"), "after")
    return units.join(short, FILE, "left").withColumns({c: F.coalesce(c, F.lit("")) for c in ("before", "after")}).select("change_id", "unit_seq", "file_path", "start_line", "end_line", body.alias("request"))


def region_requests(regions: DataFrame, head: DataFrame, intent: str, most: int = 12_000) -> DataFrame:
    """A request text per distinct background region: guidance, intent, place, symbol, and the head side's text, cut in the middle before the join."""
    some = regions.select(*FILE, "start_line", "end_line", "label").distinct()
    short = head.select(*FILE, T.truncate_middle(F.coalesce("text", F.lit("")), most).alias("before"))
    place = F.concat(F.col("file_path"), F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    body = F.concat_ws("\n", F.lit(T.BACKGROUND_GUIDANCE), F.concat(F.lit("Intent: "), F.lit(intent)), F.concat(F.lit("Place: "), place), F.concat(F.lit("Symbol: "), F.coalesce("label", F.lit("-"))), F.lit("Before:"), F.coalesce("before", F.lit("")))
    return some.join(short, FILE, "left").select(*FILE, "start_line", "end_line", "label", body.alias("request"))
