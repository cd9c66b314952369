"""Repository manifests (TOML) and attribute files: ordered rules."""

from __future__ import annotations

import tomllib

from ..functions.glob import GlobError, glob_regex


def manifest(text: str) -> dict:
    """{"repos": [...], "exclusions": [(glob, id)]} of a manifest; the first rule that matches a path excludes it."""
    data = tomllib.loads(text)
    rules = []
    for r in data.get("exclusion", []):
        if "id" not in r or "pattern" not in r:
            raise ValueError("an exclusion rule needs an id and a pattern")
        glob_regex(r["pattern"])
        rules.append((r["pattern"], r["id"]))
    if len({i for _, i in rules}) != len(rules):
        raise ValueError("rule ids repeat")
    return {"repos": data.get("repo", []), "exclusions": rules}


def attributes(files: dict[str, str]) -> dict[str, list[tuple[str, str | None]]]:
    """attribute -> ordered (glob, value) of attribute files by folder ("" is the top); deeper folders come later.

    -name and !name unset (None); a rule below a folder is anchored there. Globs that aren't understood are skipped.
    """
    out: dict[str, list[tuple[str, str | None]]] = {}
    for folder in sorted(files, key=lambda d: (d.count("/") + bool(d), d)):
        for line in files[folder].split("\n"):
            parts = line.split()
            if not parts or parts[0].startswith("#"):
                continue
            pattern = parts[0]
            if folder:
                body = pattern.lstrip("/")
                pattern = f"{folder}/{body}" if "/" in pattern.rstrip("/") else f"{folder}/**/{body}"
            try:
                glob_regex(pattern)
            except GlobError:
                continue
            for a in parts[1:]:
                name, _, value = a.partition("=")
                out.setdefault(name.lstrip("-!"), []).append((pattern, None if a[0] in "-!" else value or "set"))
    return out
