"""What extraction found, as the graph's tables: symbols with identities, references, exports, marked comments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..operators import lookup


def symbols_of(extracted: DataFrame, repo: str) -> DataFrame:
    """One row per symbol with its id; the ordinal tells apart symbols of one place, name and kind."""
    rows = extracted.select("path", "grade", F.inline("symbols")).withColumn("ordinal", ids.ordinal())
    key = ids.symbol_id(F.lit(repo), F.col("path"), F.col("container"), F.col("name"), F.col("kind"), F.col("ordinal"))
    return rows.select(key.alias("id"), "path", "container", "name", "kind", F.col("ordinal").cast("long").alias("ordinal"), "body", "byte_start", "byte_end", "line_start", "line_end", "name_at", "ix", "grade")


def references_of(extracted: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, at, name, resolution, declared_at, target): the target is the symbol whose name stands where the reference was declared.

    References are never broadcast: the file's size doesn't tell how many its arrays hold.
    """
    rows = extracted.select("path", F.inline("refs"))
    named = symbols.select("path", F.col("name_at").alias("declared_at"), F.col("id").alias("target"))
    return rows.join(named.hint("merge"), ["path", "declared_at"], "left").select("path", "at", "name", "resolution", "declared_at", "target")


def edges_of(extracted: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (src, dst) between symbols of one file, and how many references fell into each class."""
    return lookup.file_edges(references_of(extracted, symbols), symbols)


def exports_of(extracted: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, name, id) of exported names that one top-level symbol has; a name that several have points nowhere."""
    top = symbols.where(F.size("container") == 0).groupBy("path", "name").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1")
    return extracted.select("path", F.explode("exports.names").alias("name")).join(top, ["path", "name"]).select("path", "name", "id")


def comments_of(extracted: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, byte_start, body, attached): marked comments with the ids of the symbols they attach to."""
    rows = extracted.select("path", F.inline("comments")).withColumn("ix", F.explode_outer("attached"))
    rows = rows.join(symbols.select("path", "ix", "id"), ["path", "ix"], "left")
    return rows.groupBy("path", "byte_start", "body").agg(F.array_sort(F.collect_set("id")).alias("attached"))
