"""Column functions over lines, paths, names and keys.

White space is trimmed on both sides as ``\\s`` does, names are ASCII, and lines are
split at an optional carriage return and a line feed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAME = r"[A-Za-z_][A-Za-z0-9_]*"
#: A name with no word character on either side, ASCII only.
WHOLE_NAME = rf"(?<![A-Za-z0-9_])({NAME})(?![A-Za-z0-9_])"
DOTTED_NAME = rf"(?<![A-Za-z0-9_])({NAME}(?:\.{NAME})++)(?![A-Za-z0-9_])"
#: A quoted string of a line: up to the first quote that no backslash escapes, or without one up to the last quote. Possessive, so long strings take no stack and no second try.
STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|"[^"]*+(?:"(?=[^"]*+")[^"]*+)*+"|' + r"'[^'\\]*+(?:\\.[^'\\]*+)*+'|'[^']*+(?:'(?=[^']*+')[^']*+)*+'"
HUNK = r"@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"

#: Words that are never references. The first set is for graphs and order; the repository index lacks the second and has the third besides; the fourth is added for Python there.
GRAPH_WORDS = "if for while return const let var function class def async await new import from export as this self true false null undefined".split()
DECLARING_WORDS = "const let var function".split()
INDEX_WORDS = [w for w in GRAPH_WORDS if w not in DECLARING_WORDS] + ["none"]
PYTHON_WORDS = "in with and or".split()

BACKGROUND_GUIDANCE = "Say what this code did before the change, and how the change depends on it."
GUIDANCE = {
    "add": "Say what this new code is for and where it is used.",
    "remove": "Say what went away and what now takes its place.",
    "modify": "Say how the behaviour differs from before.",
    "unknown": "Say what this part of the code does.",
}


def trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def exploded(df: DataFrame, columns: list, elements: Column, at: str, element: str) -> DataFrame:
    """A row per element of an array with its place from 0.

    An array that is made on the spot is made once: the plain ``posexplode`` is given a filter for empty ones, which makes it a second time.
    """
    return df.select(*columns, F.posexplode_outer(elements).alias(at, element)).where(F.col(at).isNotNull())


def lines(c: Column) -> Column:
    return F.split(c, r"\r?\n", -1)


def language(path: Column) -> Column:
    """``javascript``, ``typescript``, ``python`` or null, by extension in either case."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    return F.when(ext.isin("js", "cjs", "mjs", "jsx"), "javascript").when(ext.isin("ts", "tsx"), "typescript").when(ext == "py", "python")


#: A path that is not normal but for a leading ``b/``: with a backslash, or an empty, ``.`` or ``..`` part.
_ODD_PATH = r"\\|(?:^|/)\.{0,2}(?:/|$)"


def normalize_path(path: Column) -> Column:
    """Forward slashes, no leading ``b/``, and no empty, ``.`` or resolvable ``..`` parts; an absolute path stays absolute. Only a path that needs it is taken apart."""
    plain = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^b/", "")
    empty = F.expr("cast(array() as array<string>)")

    def step(done: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("")) != "..")
        return F.when(part.isin("", "."), done).when(up, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))

    parts = F.aggregate(F.split(plain, "/"), empty, step)
    whole = F.concat(F.when(plain.startswith("/"), "/").otherwise(""), F.array_join(parts, "/"))
    return F.when(path.rlike(_ODD_PATH), whole).otherwise(F.regexp_replace(path, "^b/", ""))


def below(path: Column, root: str) -> Column:
    """A normalised path below ``root`` without it; other paths as they are."""
    return F.when(path.startswith(root.rstrip("/") + "/"), F.substr(path, F.lit(len(root.rstrip("/")) + 2))).otherwise(path)


def relative_path(path: Column, root: str) -> Column:
    """A path normalised and, below ``root``, without it."""
    return below(normalize_path(path), root)


def change_type(diff: Column) -> Column:
    added = F.exists(lines(diff), lambda x: x.startswith("+") & ~x.startswith("+++"))
    removed = F.exists(lines(diff), lambda x: x.startswith("-") & ~x.startswith("---"))
    return F.when(added & removed, "modify").when(added, "add").when(removed, "remove").otherwise("unknown")


#: Fixed patterns of the first line of a definition: its name is the last group, and a script's keyword the first.
PYTHON_HEADER = rf"^\s*+(?!(?:from|import)\s)(?:(?:async\s+)?def\s+|class\s+|(?={NAME}\s*=))({NAME})"
SCRIPT_HEADER = r"^\s*+(?:export\s+)?(?:async\s+(?=function\s))?(function|class|interface|type|enum|const|let|var)\s+([A-Za-z0-9_$]+)"


def definition_header(line: Column, lang: Column) -> Column:
    """Struct of ``name`` and ``type`` if a line begins a definition, else null: one pattern tells whether it does, and only such a line is looked at again."""
    kind = F.when(line.rlike(r"^\s*+(?:async\s+)?def\s+[A-Za-z_]"), "function").when(line.rlike(r"^\s*+class\s+[A-Za-z_]"), "class").otherwise("variable")
    python = F.when(line.rlike(PYTHON_HEADER), F.struct(F.regexp_extract(line, PYTHON_HEADER, 1).alias("name"), kind.alias("type")))
    word = F.regexp_extract(line, SCRIPT_HEADER, 1)
    assigned = F.when(line.rlike(r"(?<=\w)=>(?=\w)|(?<![A-Za-z0-9_])function(?![A-Za-z0-9_])"), "function").otherwise("variable")
    script = F.when(line.rlike(SCRIPT_HEADER), F.struct(F.regexp_extract(line, SCRIPT_HEADER, 2).alias("name"), F.when(word.isin("const", "let", "var"), assigned).otherwise(word).alias("type")))
    return F.when(lang == "python", python).when(lang.isin("javascript", "typescript"), script)


def blank_strings(line: Column) -> Column:
    """Each quoted string becomes one blank; template literals stay."""
    return F.regexp_replace(line, STRING, " ")


def blank_code(line: Column, lang: Column) -> Column:
    """As ``blank_strings``, after a Python comment is cut at the first number sign."""
    return blank_strings(F.when(lang == "python", F.substring_index(line, "#", 1)).otherwise(line))


def container(qualified: Column) -> Column:
    """All but the last part of a dotted name, null without a dot."""
    parts = F.split(qualified, r"\.")
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), "."))


def last_container(qualified: Column) -> Column:
    """Only the part before the last one, null without a dot."""
    return F.try_element_at(F.split(qualified, r"\."), F.when(F.size(F.split(qualified, r"\.")) > 1, F.lit(-2)).otherwise(F.lit(None).cast("int")))


def segment_key(path: Column, start: Column, end: Column) -> Column:
    return F.concat(path, F.lit("|"), start.cast("string"), F.lit("-"), end.cast("string"))


def region_key(path: Column, start: Column, end: Column, label: Column) -> Column:
    return F.concat(segment_key(path, start, end), F.lit("|"), F.coalesce(label, F.lit("")))


def step_key(kind: Column, path: Column, start: Column, end: Column) -> Column:
    return F.concat(kind, F.lit("|"), segment_key(path, start, end))


def group_key(path: Column, symbol: Column, n: Column) -> Column:
    return F.concat(path, F.lit("::"), F.coalesce(symbol, F.lit("top-level")), F.lit("::"), n.cast("string"))


def bar_key(*parts: Column) -> Column:
    """Parts that are neither null nor empty, joined by a bar."""
    return F.concat_ws("|", *[F.nullif(p, F.lit("")) for p in parts])


def layout_label(qualified: Column, within: Column, definition: Column, symbol: Column) -> Column:
    """What places a unit in a graph: its qualified name, else container and name, else the name."""
    said = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(said(qualified), F.concat(said(within), F.lit("."), said(definition)), F.concat(said(within), F.lit("."), said(symbol)), definition, symbol, F.lit(""))


def truncate_middle(text: Column, most: int) -> Column:
    """Head of six tenths and tail around a marker; the marker is longer than the 16 characters kept for it."""
    head = int(most * 0.6)
    cut = F.concat(F.substring(text, 1, head), F.lit("\n... [truncated] ...\n"), F.right(text, F.lit(max(0, most - head - 16))))
    return F.when(F.length(text) <= most, text).otherwise(cut)


def background_rank(label: Column) -> Column:
    return F.when(F.coalesce(label.rlike(r"^[A-Z][A-Za-z0-9_]*$"), F.lit(False)), 0).otherwise(1)


def meaningful(line: Column, lang: Column) -> Column:
    """Not blank, and not a comment line of its language."""
    t = trim(line)
    script = t.startswith("//") | t.startswith("/*") | t.startswith("*")
    return (t != "") & F.when(lang == "python", ~t.startswith("#")).when(lang.isin("javascript", "typescript"), ~script).otherwise(True)


def contains_name(line: Column, name: Column) -> Column:
    """Whether a line holds a name as a whole word; false for an empty name."""
    quoted = F.regexp_replace(name, r"([.*+?^${}()|\[\]\\])", r"\\$1")
    return F.coalesce((name != "") & F.regexp_like(line, F.concat(F.lit("(?<![A-Za-z0-9_])"), quoted, F.lit("(?![A-Za-z0-9_])"))), F.lit(False))


def ignored(name: Column, words: list[str] = GRAPH_WORDS) -> Column:
    return F.coalesce(name == "", F.lit(True)) | name.isin(words)


def ignored_in_index(name: Column, lang: Column) -> Column:
    return ignored(name, INDEX_WORDS) | ((F.coalesce(lang, F.lit("")) == "python") & name.isin(PYTHON_WORDS))


def element_kind(kind: Column) -> Column:
    return F.when(kind == "variable", "global").when(kind.isin("class", "method"), kind).otherwise("function")


def comment_title(kind: Column, name: Column) -> Column:
    return F.concat(F.when(kind == "background", "Background: ").when(kind == "global", "Global: ").when(kind == "operation", "Operation: ").otherwise("Definition: "), F.coalesce(name, F.lit("code")))


def step_counter(kind: Column, n: Column, total: Column) -> Column:
    return F.concat(F.upper(kind), F.lit(" "), n.cast("string"), F.lit(" / "), total.cast("string"))


def operation_label(n: Column, start: Column, end: Column) -> Column:
    return F.concat(F.lit("Step "), n.cast("string"), F.lit(" · L"), start.cast("string"), F.lit("-"), end.cast("string"))


def guidance(kind: Column) -> Column:
    out = F.lit(GUIDANCE["unknown"])
    for k in ("add", "remove", "modify"):
        out = F.when(kind == k, GUIDANCE[k]).otherwise(out)
    return out
