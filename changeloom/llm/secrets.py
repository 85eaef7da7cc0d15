"""Secret scans: what looks like a credential, and in how many repositories and of how many owners it stands. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeloom.llm.common import materialize

#: Fixed patterns of the base kinds, in their order; ``assign`` has its value in group 2.
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]+", r"[0-9a-f]{24,}"
#: Further candidates: tokens with a known prefix, and long mixed runs.
KNOWN = r"(?:gh[pousr]_[A-Za-z0-9]{20,}|sk_(?:live|test)_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{30,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}|[A-Za-z0-9+/_-]{32,}={0,2})"
KINDS = ["assign", "access", "hex", "live"]
#: A value of more owners, or in more repositories for each of its owners, is an example that was copied; an unlisted one needs so many different characters to look live.
MOST_OWNERS, MOST_COPIES, LEAST_KINDS = 2, 64, 12
_HINT = r"(?i)passw|secret|token|api_?key|AKIA|[0-9a-f]{24}|[A-Za-z0-9+/_-]{32}|gh[pousr]_|sk_live_|sk_test_|xox[abprs]-|AIza|eyJ"


def _matches(text: Column, kind: int, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern in their order as structs: kind, number, characters between the match before and this one, characters of the match, value of a group.

    ``split`` and ``regexp_extract_all`` find the same matches; the texts between them give the places. The last struct has no match.
    """
    long = lambda x: F.transform(x, lambda c: F.length(c))
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    found = F.arrays_zip(long(F.split(text, pattern, -1)).alias("gap"), long(whole).alias("size"), value.alias("value"))
    return F.transform(found, lambda m, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), m["gap"].alias("gap"), m["size"].alias("size"), m["value"].alias("value")))


def _looks_live(value: Column) -> Column:
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (value.rlike("[a-z]") & value.rlike("[A-Z]") | value.rlike("[_-]"))
    return mixed & (F.size(F.array_distinct(F.split(value, ""))) >= LEAST_KINDS)


def _of_kind(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda b: b["kind"] == kind)).cast("long")


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id, owner, kind, start, end, value`` of all candidates, in code points; kinds are places in KINDS. Texts are only searched if a plain pattern hits.

    Matches leave a text as rows, and a running sum of their lengths by text and kind gives their places, so work is in proportion to the matches.
    """
    hit = docs.where(F.col("text").rlike(_HINT))
    text = F.col("text")
    kinds = [_matches(text, 0, ASSIGN, 2), _matches(text, 1, ACCESS), _matches(text, 2, HEX), _matches(text, 3, KNOWN)]
    each = hit.select("doc_id", "owner", F.explode(F.concat(*kinds)).alias("m")).select("doc_id", "owner", "m.*").where("value is not null")
    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("doc_id", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    placed = each.withColumn("end", end).withColumn("start", F.col("end") - F.col("size"))
    enough = F.when(F.col("kind") == 3, _looks_live(F.col("value"))).otherwise(F.length("value") >= F.element_at(F.array(F.lit(6), F.lit(20), F.lit(24)), F.least(F.col("kind"), F.lit(2)) + 1))
    return placed.where(enough).select("doc_id", "owner", "kind", "start", "end", "value")


def ownership(found: DataFrame) -> DataFrame:
    """Per hash of a candidate: in how many documents and of how many owners it stands, and whether that is an owner's own."""
    each = found.select("hash", "owner", "doc_id").distinct()
    owned = each.groupBy("hash", "owner").agg(F.count("*").alias("n")).groupBy("hash").agg(F.sum("n").alias("n_repositories"), F.count("*").alias("n_owners"))
    return owned.withColumn("own", (F.col("n_owners") <= MOST_OWNERS) & (F.col("n_repositories") <= MOST_COPIES * F.col("n_owners")))


def clear_of_base(judged: DataFrame) -> DataFrame:
    """Base spans, and those of the other kind that are owner-specific and touch no base span: running bounds of base spans from both ends of a text."""
    at = Window.partitionBy("doc_id").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy("doc_id").orderBy(F.desc("start")).rowsBetween(Window.unboundedPreceding, -1)
    is_base = F.col("kind") < 3
    bounds = judged.withColumns({"before": F.max(F.when(is_base, F.col("end"))).over(at), "after": F.min(F.when(is_base, F.col("start"))).over(back)})
    free = F.coalesce(F.col("before") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("after") >= F.col("end"), F.lit(True))
    return bounds.where(is_base | F.col("own") & free)


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """Secrets of each document: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_examples``.

    The base kinds are reported wherever they match. Other candidates, known token forms and long mixed runs, are
    reported as ``live`` where they touch no base span and their hash is owner-specific: of at most
    MOST_OWNERS owners, and in at most MOST_COPIES documents (each counts as a repository) for each of them; widely copied examples are
    not. ``n_live`` and ``n_examples`` count the spans of all kinds that are owner-specific or copied. Places are code points, the end exclusive; a null or empty text has no
    span. A null owner is one owner. Rows without an id go; of rows that repeat an id the text that sorts last counts, with
    its owner. Other columns are ignored; an empty table gives an empty table.

    Documents and owners are counted in two steps, so a value in a third of all documents is combined before each
    shuffle; texts are never shuffled, but where ids repeat.
    """
    owners = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner")).where("doc_id is not null")
    docs = owners if not owners.groupBy("doc_id").count().where("count > 1").head(1) else owners.groupBy("doc_id").agg(F.max(F.struct("text", "owner")).alias("x")).select("doc_id", "x.*")
    found = materialize(candidates(docs).withColumn("hash", F.sha2("value", 256)).drop("value"))
    judged = found.join(ownership(found).select("hash", "own"), "hash")
    spans = clear_of_base(judged).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "own"))).alias("all"))
    spans = spans.withColumn("base", F.filter("all", lambda x: x["kind"] < 3))
    count = [_of_kind("base", k).alias(f"n_{KINDS[k]}") for k in range(3)]
    own = F.size(F.filter("all", lambda b: b["own"])).cast("long")
    told = spans.select("doc_id", *count, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"), own.alias("n_live"), (F.size("all") - own).alias("n_examples"))
    out = docs.select("doc_id").join(told, "doc_id", "left")
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_assign", "n_access", "n_hex", "n_live", "n_examples")}
    return out.withColumns(zero | {"base_sha256": F.coalesce("base_sha256", F.sha2(F.lit(""), 256)), "spans": F.coalesce("spans", F.lit(""))})
