"""Whole jobs: from diffs to an ordered tour, and from sources to a dependency graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.functions import text as T
from changeloom.operators import background, graph, overall, source, steps
from changeloom.operators.hunks import parse_hunks
from changeloom.operators.ranges import FILE
from changeloom.operators.units import split_units
from changeloom.sources.store import file_contexts, missing
from changeloom.sources.tables import settle


@dataclass
class Tour:
    """The tables of a diff tour."""

    units: DataFrame
    main: DataFrame
    background: DataFrame
    depends: DataFrame
    playlist: DataFrame


@dataclass
class Sources:
    """What is read from the texts of one side, once, and written, since several joins use it."""

    definitions: DataFrame
    calls: DataFrame
    variables: DataFrame
    script_globals: DataFrame
    lines: DataFrame


def read_sources(**sides: DataFrame) -> dict[str, Sources]:
    """What is read from the texts of each side; equal texts are parsed once. Lines are not written: those who need them read the few files that they are about."""
    out = {}
    for side, found in source.analyze_sides(**sides).items():
        rows = settle(found)
        variables = rows.where("what in ('variable', 'global')").select(*FILE, "name", "start_line", "end_line")
        out[side] = Sources(source.definitions(rows), source.calls(rows), variables, source.script_globals(rows), source.source_lines(sides[side]))
    return out


def change_units(diffs: DataFrame, revised: DataFrame, root: str = "/work/repo") -> DataFrame:
    hunks = settle(parse_hunks(diffs, root))
    s = read_sources(revised=revised)["revised"]
    return split_units(hunks, s.definitions, s.variables, s.lines)


def order(units: DataFrame, calls: DataFrame) -> DataFrame:
    """Main steps with ``graph_rank`` and ``position``; variables come first and take no part in the graph order."""
    rest = units.where("change_kind <> 'global'")
    placed = settle(graph.order_units(rest, graph.ordering_edges(rest, graph.related_names(rest, calls))))
    ranked = steps.main_steps(units).join(graph.graph_rank(rest, placed), ["change_id", "file_path", "unit_seq"], "left")
    return steps.globals_first(ranked)


def diff_tour(diffs: DataFrame, head: DataFrame, revised: DataFrame, root: str = "/work/repo") -> Tour:
    """Units grouped, ordered so that what is needed comes first, with the existing code they need before them."""
    hunks = settle(parse_hunks(diffs, root))
    read = read_sources(revised=revised, head=head)
    new, old = read["revised"], read["head"]
    units = settle(steps.proximity_groups(split_units(hunks, new.definitions, new.variables, new.lines)))
    calls = settle(background.unit_calls(units, new.calls))
    regions = settle(background.background_regions(units, new.calls, old.definitions, file_contexts(head, revised).select(*FILE)))
    main = settle(order(units, calls))
    used = regions.join(main.select("change_id", "unit_seq", "step_no", "step_id"), ["change_id", "unit_seq"])
    bg, deps = steps.background_steps(used)
    bg = steps.order_background(bg)
    return Tour(units, main, bg, deps, steps.playlist(steps.visible(steps.playlist_of(main, bg))))


def explanation_requests(tour: Tour, head: DataFrame, revised: DataFrame, stored: DataFrame, intent: str, whole_gate: bool = False) -> DataFrame:
    """``change_id, step_id, step_type, file_path, start_line, end_line, request`` of the steps without a stored explanation; with ``whole_gate`` of the change sets without any."""
    contexts = file_contexts(head, revised)
    keys = ["change_id", "step_id", "step_type", "file_path", "start_line", "end_line"]
    main = missing(tour.main.withColumn("step_type", F.lit("main")), stored, whole_gate)
    own = background.requests(main, contexts, intent).select("change_id", "unit_seq", "request")
    regions = missing(tour.background.withColumns({"step_type": F.lit("background"), "step_id": F.col("bg_id")}), stored, whole_gate)
    told = background.region_requests(regions, head, intent).withColumnRenamed("label", "of")
    same = [*FILE, "start_line", "end_line"]
    of_regions = regions.join(told, same).where(F.col("label").eqNullSafe(F.col("of")))
    return main.join(own, ["change_id", "unit_seq"]).select(*keys, "request").unionByName(of_regions.select(*keys, "request"))


def repository_index(snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Index units and what they use, from all source texts."""
    s = read_sources(all=snapshots)["all"]
    found = source.python_globals(snapshots).unionByName(s.script_globals)
    index = settle(overall.index_units(s.definitions, found))
    return index, overall.index_calls(index, s.calls, s.lines)


def graph_of(main: DataFrame, calls: DataFrame, index: DataFrame, uses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and weighted edges of the graph of a change and the index together; ``calls`` are those of the change's units, ``uses`` of index units."""
    whole = settle(steps.graph_input(steps.overall_steps(index), main))
    own = calls.join(main.select("change_id", "unit_seq", "step_id"), ["change_id", "unit_seq"])
    all_calls = uses.withColumn("step_id", F.concat(F.lit("overall-"), F.col("unit_seq").cast("string"))).select(*graph.STEP, "name", "qualified_name").unionByName(own.select(*graph.STEP, "name", "qualified_name"))
    far = F.when(F.col("qualified_name") != F.col("name"), F.col("qualified_name"))
    return graph.tour_graph(whole, all_calls.withColumn("qualified_name", far))


def change_summary(diffs: DataFrame, root: str = "/work/repo") -> DataFrame:
    """Which files and lines each change set adds, modifies or removes, by language."""
    hunks = parse_hunks(diffs, root)
    told = hunks.withColumns({"language": F.coalesce(T.language(F.col("file_path")), F.lit("other")), "change_type": T.change_type(F.col("diff_text"))})
    return told.groupBy("change_id", "language", "change_type").agg(F.count("*").alias("n_hunks"), F.countDistinct("file_path").alias("n_files"), F.sum(F.col("end_line") - F.col("start_line") + 1).alias("n_lines"))
