"""Path globs as Java regular expressions: *, ?, ** as a whole segment, name-only and directory-only patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


class GlobError(ValueError):
    pass


def glob_regex(pattern: str) -> str:
    """The pattern of path + "/", in which every segment ends with a slash, that ``pattern`` matches.

    Without a slash it is about the last name; with a trailing slash about everything below such a directory.
    Character classes are refused rather than half understood.
    """
    if not pattern:
        raise GlobError("empty pattern")
    if "[" in pattern:
        raise GlobError(f"character class in {pattern!r}")
    body = pattern.rstrip("/").removeprefix("/")
    segments, name_only = body.split("/"), "/" not in body
    if pattern.endswith("/"):
        segments = ["**"] * name_only + segments + ["*", "**"]
    elif name_only:
        segments = ["**", body if body != "**" else "*"]
    one = lambda s: "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in s)
    return r"\A" + "".join("(?:[^/]*/)*" if s == "**" else one(s) + "/" for s in segments) + r"\z"


def glob_matches(path: Column, pattern: str) -> Column:
    return F.concat(path, F.lit("/")).rlike(glob_regex(pattern))
