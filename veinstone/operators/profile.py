"""Untyped tables: column types, casts, headers."""

from __future__ import annotations

import html
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veinstone.functions import text as T

#: In order of priority among equal votes.
TYPES = ["int", "float", "text", "datetime", "bool"]
SUFFIXES = {"int": "_long", "float": "_flt", "text": "_tks", "datetime": "_dt", "bool": "_kwd"}


def cell_type(value: Column) -> Column:
    """int, float, bool, datetime or text; big for an integer beyond 64 bits. An empty cell counts as float, and 0 or 0.5 as text."""
    s = F.replace(value, F.lit("%%"), F.lit(""))
    whole = s.rlike(r"^[+-]?[0-9]+$") & ~s.startswith("0")
    kind = F.when(whole & s.try_cast("long").isNull(), "big").when(whole, "int")
    return kind.when(s.rlike(r"^[+-]?[0-9.]{0,19}$") & ~s.startswith("0"), "float").when(T.as_boolean(s).isNotNull(), "bool").when(T.as_datetime(s).isNotNull(), "datetime").otherwise("text")


def column_types(cells: DataFrame) -> DataFrame:
    """(column, type, votes of each type) of cells (column, value): the type with most votes; one scan, counted before it moves."""
    kinds = cells.where(F.col("value").isNotNull()).select("column", cell_type(F.col("value")).alias("kind"))
    votes = kinds.groupBy("column").agg(*(F.count_if(F.col("kind") == t).alias(f"n_{t}") for t in [*TYPES, "big"]))
    most = F.greatest(*(F.col(f"n_{t}") for t in TYPES))
    chosen = F.when(F.col("n_big") > 0, "float")
    for t in TYPES:
        chosen = chosen.when(F.col(f"n_{t}") == most, t)
    return votes.select("column", chosen.alias("type"), *(f"n_{t}" for t in TYPES))


def long_form(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value): each cell of the columns, as text."""
    return rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))).alias("c")).select("c.*")


def typed(value: Column, kind: str) -> Column:
    """A cell as its column's type; null where it doesn't fit."""
    if kind == "int":
        return F.when(value.rlike(r"^\s*[+-]?[0-9]+\s*$"), value.try_cast("long"))
    if kind == "float":
        return F.when(value.rlike(r"[0-9]"), value.try_cast("double"))
    return {"bool": T.as_boolean, "datetime": T.as_datetime}.get(kind, lambda v: v)(value)


def field_name(name: str, kind: str, spelled: dict[str, str] | None = None) -> str:
    """A field's name: without units and remarks, lower case, with a suffix for its type.

    spelled: how characters are spelled in Latin letters (a table of pronunciations); spelled ones are set apart by underscores.
    """
    bare = re.sub(r"(/.*|（[^（）]+?）|\([^()]+?\))", "", name)
    parts = re.findall("|".join([*map(re.escape, spelled), f"[^{re.escape(''.join(spelled))}]+"]), bare) if spelled else [bare]
    return "_".join(spelled.get(x, x) if spelled else x for x in parts).strip().lower() + SUFFIXES[kind]


def simple_headers(names: list[str | None]) -> list[str]:
    return [(name or "").strip() or f"Column_{k + 1}" for k, name in enumerate(names)]


def looks_like_header(value: Column) -> Column:
    letters = F.length(F.regexp_replace(value, r"[^\p{L}]", ""))
    return (F.length(value) > 0) & (value.rlike(r"[^\x00-\x7F]") | (letters >= 2) | value.rlike(r"[():：（）_-]"))


def looks_like_data(value: Column) -> Column:
    return F.upper(value).isin("Y", "N", "M", "X", "/", "-") | F.regexp_replace(value, "[.,-]", "").rlike("^[0-9]+$")


def header_rows(cells: DataFrame) -> DataFrame:
    """(table_id, header_rows) of cells (table_id, row, col, value): rows 1 to 4 are headers as long as they look no less like headers than data."""
    value = F.trim("value")
    counted = cells.groupBy("table_id", "row").agg(
        F.count("value").alias("filled"), F.count_if(looks_like_header(value)).alias("header"), F.count_if(looks_like_data(value)).alias("data")
    )
    fails = (F.col("filled") == 0) | (F.col("header") < F.col("data"))
    end = F.min(F.when((F.col("row") >= 1) & (F.col("row") <= 4) & fails, F.col("row")))
    return counted.groupBy("table_id").agg(F.coalesce(end, F.least(F.max("row") + 1, F.lit(5))).alias("header_rows"))


def merged_headers(cells: DataFrame, merges: DataFrame, headers: DataFrame) -> DataFrame:
    """(table_id, col, header) from cells, merged ranges (table_id, r1, c1, r2, c2) and header_rows: parts from top to bottom, joined by -.

    A merged range has the value of its first cell everywhere; parts that look like data are left out.
    """
    spread = merges.select("table_id", "r1", "c1", F.explode(F.sequence("r1", "r2")).alias("row"), "c2").select("table_id", "r1", "c1", "row", F.explode(F.sequence("c1", "c2")).alias("col"))
    first = spread.join(cells.select("table_id", F.col("row").alias("r1"), F.col("col").alias("c1"), F.col("value").alias("whole")), ["table_id", "r1", "c1"]).select("table_id", "row", "col", "whole")
    full = cells.join(first, ["table_id", "row", "col"], "full").withColumn("value", F.trim(F.coalesce("whole", "value")))
    top = full.join(headers, "table_id").where((F.col("row") < F.col("header_rows")) & (F.col("value") != "") & ~looks_like_data(F.col("value")))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("row", "value"))), lambda x: x["value"])
    return top.groupBy("table_id", "col").agg(F.array_join(F.array_distinct(parts), "-").alias("header")).where(F.col("header") != "-")


def effective_rows(cells: DataFrame) -> DataFrame:
    """(table_id, rows): rows down to the last with a cell that is not blank."""
    return cells.where(T.not_blank(F.col("value"))).groupBy("table_id").agg((F.max("row") + 1).alias("rows"))


def named_columns(rows: DataFrame) -> DataFrame:
    """rows with Col_i for columns without a name."""
    return reduce(lambda df, kc: df.withColumnRenamed(kc[1], f"Col_{kc[0]}") if not kc[1].strip() or kc[1].startswith("_c") else df, list(enumerate(rows.columns)), rows)


def escaped(value: Column) -> Column:
    """A cell as HTML: trimmed, signs and both quotes replaced; nothing for null."""
    text = T.trim_all(F.coalesce(value.cast("string"), F.lit("")))
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def html_tables(rows: DataFrame, columns: list[str], sheet: str, size: int = 256) -> DataFrame:
    """(part, html) of rows (row, columns), numbered from 0: tables of ``size`` rows, each with caption and header; one more, empty, after a full last one."""
    line = F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), escaped(F.col(c)), F.lit("</td>")) for c in columns), F.lit("</tr>"))
    parts = rows.select(F.floor(F.col("row") / size).alias("part"), F.struct("row", line.alias("line")).alias("cells"))
    bodies = parts.groupBy("part").agg(F.array_join(F.transform(F.sort_array(F.collect_list("cells")), lambda x: x["line"]), "").alias("body"))  # ``size`` rows each
    every = rows.agg(F.count("*").alias("n")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / size))).alias("part"))
    head = f"<table><caption>{sheet}</caption><tr>" + "".join(f"<th>{html.escape(c.strip())}</th>" for c in columns) + "</tr>"
    return every.join(bodies, "part", "left").select("part", F.concat(F.lit(head), F.coalesce("body", F.lit("")), F.lit("</table>\n")).alias("html"))


def markdown_rows(columns: list[str]) -> Column:
    shown = [F.coalesce(F.when(T.not_blank(F.col(c).cast("string")), F.col(c).cast("string")), F.lit("")) for c in columns]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *shown), F.lit(" |"))


def last_filled(rows: DataFrame, partition: str, order: str, column: str) -> DataFrame:
    """rows with the column's last value that is not null, up to each row."""
    return rows.withColumn(column, F.last(column, ignorenulls=True).over(Window.partitionBy(partition).orderBy(order)))
