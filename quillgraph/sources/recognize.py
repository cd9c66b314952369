"""Which language a file is, and which bucket it falls into: ordered cascades as column expressions."""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import names
from ..functions.glob import glob_matches
from ..operators import budget

# Languages by extension, name and interpreter.
FIRST_CLASS = {
    "kt": "Kotlin", "kts": "Kotlin", "java": "Java", "js": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript", "jsx": "JavaScript",
    "ts": "TypeScript", "mts": "TypeScript", "cts": "TypeScript", "tsx": "TypeScript", "rs": "Rust",
}
BY_EXTENSION = {
    "sql": "SQL", "md": "Markdown", "markdown": "Markdown", "json": "JSON", "yml": "YAML", "yaml": "YAML", "xml": "XML", "toml": "TOML",
    "properties": "Java Properties", "gradle": "Gradle", "sh": "Shell", "bash": "Shell", "bat": "Batch", "cmd": "Batch", "html": "HTML",
    "htm": "HTML", "css": "CSS", "scss": "SCSS", "py": "Python", "go": "Go", "rb": "Ruby", "svelte": "Svelte", "vue": "Vue",
}
BY_NAME = {"Dockerfile": "Dockerfile", "Makefile": "Make", "Jenkinsfile": "Groovy"}
BY_INTERPRETER = {
    "sh": "Shell", "bash": "Shell", "zsh": "Shell", "dash": "Shell", "ksh": "Shell", "python": "Python", "python2": "Python", "python3": "Python",
    "node": "JavaScript", "ruby": "Ruby", "perl": "Perl",
}
EXTRACTED = {"Kotlin": 1, "TypeScript": 2, "Rust": 1}
GENERATED_PATHS = ("/generated/", "/build/generated/", ".generated.")
GENERATED_MARKS = ("Code generated by", "@generated", "DO NOT EDIT", "AUTO-GENERATED", "자동 생성")


def _table(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*map(F.lit, chain.from_iterable(values.items()))), key)


def language(path: Column, declared: Column, head: Column) -> Column:
    """Declared attribute, extension in any case, file name, interpreter of the first line; else null."""
    wanted = {v.lower(): v for v in FIRST_CLASS.values()}
    named = F.when(declared.isNotNull(), F.coalesce(_table(wanted, F.lower(declared)), declared))
    ext = F.lower(names.extension(path))
    line = F.rtrim(F.get(F.split(F.substring(head, 1, budget.SHEBANG_BYTES), "\n"), F.lit(0)))
    words = F.when(line.startswith("#!"), F.split(F.trim(F.substring(line, 3, budget.SHEBANG_BYTES)), r"\s+")).otherwise(F.array().cast("array<string>"))
    shells = F.transform(F.filter(words, lambda w: ~w.startswith("-")), lambda w: _table(BY_INTERPRETER, F.substring_index(w, "/", -1)))
    return F.coalesce(named, _table(FIRST_CLASS, ext), _table(BY_EXTENSION, ext), _table(BY_NAME, names.file_name(path)), F.get(F.array_compact(shells), F.lit(0)))


def attribute(path: Column, rules: list[tuple[str, str]]) -> Column:
    """The value of an attribute by ordered (glob, value) rules: the last that matches wins."""
    return F.coalesce(*(F.when(glob_matches(path, g), F.lit(v)) for g, v in reversed(rules)), F.lit(None).cast("string"))


def excluded(path: Column, rules: list[tuple[str, str]]) -> Column:
    """The id of the exclusion rule (glob, id) that a path falls under: the first that matches wins."""
    return F.coalesce(*(F.when(glob_matches(path, g), F.lit(v)) for g, v in rules), F.lit(None).cast("string"))


def bucket(path: Column, size: Column, head: Column, has_nul: Column, rule: Column, lang: Column, error_percent: Column) -> Column:
    """excluded, binary, generated, unrecognized, unsupported, parsed or partial; the first that holds."""
    p = F.concat(F.lit("/"), path)
    generated = reduce(lambda a, b: a | b, (F.contains(p, F.lit(x)) for x in GENERATED_PATHS)) & reduce(lambda a, b: a | b, (F.contains(F.substring(head, 1, budget.MARKER_BYTES), F.lit(x)) for x in GENERATED_MARKS))
    return (
        F.when(rule.isNotNull() | (size > budget.OVERSIZE_BYTES), "excluded")
        .when(has_nul, "binary")
        .when(generated, "generated")
        .when(lang.isNull(), "unrecognized")
        .when(~lang.isin(*EXTRACTED), "unsupported")
        .when(F.coalesce(error_percent, F.lit(0)) == 0, "parsed")
        .when(error_percent > budget.ERROR_RATIO_PERCENT, "unsupported")
        .otherwise("partial")
    )
