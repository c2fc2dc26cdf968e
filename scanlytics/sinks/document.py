"""The whole analysis as one JSON document, written in fragments.

A document of all projects does not fit in a task, so none is built. Every value of it is a row with its path; braces,
brackets and commas are rows too. The rows are dealt out by ranges of the path and sorted, so that the text files, one
after the other, are the document.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OPEN, _CLOSE = {"o": "{", "a": "["}, {"o": "}", "a": "]"}
_RANK_DIGITS = 12


@dataclass(frozen=True)
class Section:
    """How a table becomes part of the document: the columns that lead to a value, outermost first, and its fields.

    ``kinds`` has one letter for each path column: ``o`` names a value in an object, ``a`` only orders it in an array.
    One field and ``bare`` give the field itself, else an object of the fields.
    """

    path: tuple[str, ...]
    kinds: str
    fields: tuple[str, ...]
    bare: bool = False
    prepare: Callable[[DataFrame], DataFrame] = lambda table: table


def _top(*by: str) -> Section:
    return Section((*by, "status", "rank"), "o" * len(by) + "oa", ("projectName", "scans"))


def _overall(table: DataFrame) -> DataFrame:
    return table.where("owner = ''")


def _of_files(table: DataFrame) -> DataFrame:
    return table.where("owner <> ''")


SECTIONS = {
    "summary": Section((), "", ("total_files", "total_rows", "total_scans", "successful_scans", "failed_scans", "unique_projects")),
    "top_projects_by_block": _top("time_block"),
    "top_projects_by_date": _top("scan_date"),
    "top_projects_by_type": _top("scanType"),
    "top_projects_by_type_date": _top("scanType", "scan_date"),
    "top_projects_by_year_block": _top("year", "time_block"),
    "scan_type_rows": Section(("scanType",), "o", ("rows",), True),
    "states": Section(("state",), "o", ("rows",), True),
    "project_summary": Section(("projectName",), "o", ("scanCount", "totalScanSize", "codeLocationName")),
    "lists": Section(("list", "value"), "oa", ("value",), True, _overall),
    "file_lists": Section(("list", "owner", "value"), "ooa", ("value",), True, _of_files),
    "file_profile": Section(("source_file",), "o", ("rows", "column_count")),
    "file_top_values": Section(("source_file", "column", "rank"), "ooa", ("value", "rows")),
    "sph_flagged_hours": Section(("hour_ts",), "a", ("hour_ts", "sph", "status")),
}


def _quoted(text: Column) -> Column:
    listed = F.to_json(F.array(text))
    return F.substr(listed, F.lit(2), F.char_length(listed) - 2)


def _plain(table: DataFrame, name: str) -> Column:
    """Path elements as text; numbers padded, so that text order is theirs."""
    kind = table.schema[name].dataType.simpleString()
    if kind in ("int", "bigint") and name == "rank":
        return F.lpad(F.col(name).cast("string"), _RANK_DIGITS, "0")
    return F.substring(F.col(name).cast("string"), 1, 19) if kind == "timestamp_ntz" else F.col(name).cast("string")


def entries(table: DataFrame, name: str) -> DataFrame:
    """``section, path, body``: one row for each value of a section; rows with a null in their path have no place."""
    section = SECTIONS[name]
    table = section.prepare(table)
    for column in section.path:
        table = table.where(F.col(column).isNotNull())
    values = [_plain(table, f).alias(f) if table.schema[f].dataType.simpleString() == "timestamp_ntz" else F.col(f) for f in section.fields]
    if not section.bare:
        body = F.to_json(F.struct(*values))
    elif table.schema[section.fields[0]].dataType.simpleString() == "string":
        body = _quoted(values[0])
    else:
        body = values[0].cast("string")
    path = F.array(*[_plain(table, c) for c in section.path]) if section.path else F.array().cast("array<string>")
    return table.select(F.lit(name).alias("section"), path.alias("path"), body.alias("body"))


def fragments(parts: DataFrame) -> DataFrame:
    """``place, text`` of ``entries`` rows: in the order of ``place`` the texts are one JSON object of the sections."""
    order = {name: f"{i:03d}" for i, name in enumerate(SECTIONS)}
    numbers = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    kinds = F.create_map(*[F.lit(x) for name, s in SECTIONS.items() for x in (name, f"o{s.kinds}")])
    # hex keeps the byte order; what encloses a value is a prefix of its place, a blank and ~ frame what is inside
    steps = F.concat(F.array(numbers[F.col("section")]), F.transform("path", lambda p: F.hex(p.cast("binary"))))
    names = F.concat(F.array(F.col("section")), F.col("path"))
    rows = parts.select(steps.alias("steps"), names.alias("names"), kinds[F.col("section")].alias("kinds"), "body")

    def place(depth: Column) -> Column:
        return F.array_join(F.slice("steps", 1, depth), " ")

    depth = F.size("steps")
    leaves = rows.select(place(depth).alias("place"), place(depth - 1).alias("parent"), _named(depth), F.col("body").alias("text"))
    inner = rows.select("steps", "names", "kinds", F.explode(F.sequence(F.lit(1), depth - 1)).alias("depth")).where("depth < size(steps) AND depth > 0")
    inner = inner.withColumns({"place": place(F.col("depth")), "parent": place(F.col("depth") - 1), "name": _named(F.col("depth"))})
    inner = inner.withColumn("kind", F.substring(F.col("kinds"), F.col("depth") + 1, F.lit(1))).select("place", "parent", "name", "kind").distinct()
    begun = inner.select("place", "parent", "name", _by_kind(_OPEN).alias("text"))
    ended = inner.select(F.concat("place", F.lit(" ~")).alias("place"), _by_kind(_CLOSE).alias("text"))
    children = leaves.unionByName(begun)
    firsts = children.groupBy("parent").agg(F.min("place").alias("first"))
    joined = children.join(firsts.select("first"), F.col("place") == F.col("first"), "left")
    comma = F.when(F.col("first").isNull(), ",").otherwise("")
    told = joined.select("place", F.concat(comma, "name", "text").alias("text"))
    frame = parts.sparkSession.createDataFrame([("", "{"), ("~", "}")], "place string, text string")
    return told.unionByName(ended).unionByName(frame)


def _named(depth: Column) -> Column:
    """The name before a value, if what encloses it is an object."""
    named = F.substring(F.col("kinds"), depth, F.lit(1)) == "o"
    return F.when(named, F.concat(_quoted(F.get("names", depth - 1)), F.lit(":"))).otherwise("").alias("name")


def _by_kind(signs: dict[str, str]) -> Column:
    return F.when(F.col("kind") == "o", signs["o"]).otherwise(signs["a"])


def write_whole(tables: dict[str, DataFrame], path: str, compress: bool = False) -> None:
    """The tables that have a section, as one JSON document in text files that follow each other by name."""
    if "lists" in tables:
        tables = {**tables, "file_lists": tables["lists"]}
    parts = [entries(table, name) for name, table in tables.items() if name in SECTIONS]
    if not parts:
        raise ValueError(f"none of the tables has a section: {sorted(tables)}")
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    pieces = fragments(whole)
    writer = pieces.repartitionByRange("place").sortWithinPartitions("place").select("text").write.mode("overwrite")
    (writer.option("compression", "gzip") if compress else writer).text(path)
