"""Identities as column expressions: a domain tag, then fields with a separator no field holds."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

SEP = "\x1f"


def digest(tag: str, *fields: Column) -> Column:
    return F.sha2(F.concat_ws(SEP, F.lit(tag), *(f.cast("string") for f in fields)), 256)


def symbol_id(repo: Column, path: Column, container: Column, name: Column, kind: Column, ordinal: Column) -> Column:
    """A symbol's coordinate. The path is part of it: a moved file has other symbols, by design."""
    return digest("symbol", repo, path, F.array_join(container, "."), name, kind, ordinal)


def ordinal() -> Column:
    """Running number among equal (container, name, kind) of one file, in file order."""
    return F.row_number().over(Window.partitionBy("path", "container", "name", "kind").orderBy("ix")) - 1


def binding_id(target: Column, note: Column) -> Column:
    """Sixteen hex digits: binding the same note to the same target again gives the same id."""
    return F.substring(digest("binding", target, note), 1, 16)


def args_digest(*args: Column) -> Column:
    return F.substring(digest("args", *args), 1, 16)


def cache_key(blob: Column, grammar: Column, extractor: Column, path: Column, declared: Column, axis: Column) -> Column:
    """All inputs that decide an extraction."""
    return digest("cache", blob, grammar, extractor, path, F.coalesce(declared, F.lit("")), axis)


def export_digest(has_default: Column, names: Column, stars: Column) -> Column:
    return digest("exports", has_default, F.array_join(F.array_sort(names), ","), F.lit("star"), F.array_join(F.array_sort(stars), ","))


def derived_id(label: Column, targets: Column, provenance: Column, producer: Column, inputs: Column) -> Column:
    joined = F.array_join(F.transform(F.array_sort(targets), lambda t: F.concat(F.length(t).cast("string"), F.lit(":"), t)), "")
    return digest("derived", label, joined, provenance, producer, inputs)


def identity_of(first: Column, measured: Column) -> Column:
    """The weaker of Exact (only the first of its name) and what the extractor measured; both as ranks 0..2."""
    return F.least(F.when(first == 0, 2).otherwise(1), measured)
