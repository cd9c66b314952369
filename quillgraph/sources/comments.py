"""Comments that carry a decision and the declaration they attach to."""

from __future__ import annotations

import re

# What marks such a comment.
MARKS = ("@decision:", "ADR-")
_COMMENT = re.compile(r"(?:[ \t]*//[^\n]*\n?)+|[ \t]*/\*.*?\*/[ \t]*\n?", re.S)


def marked_comments(text: str, symbols: list[dict]) -> list[dict]:
    """body, byte_start and attached (places in ``symbols``): runs of line comments are one; a blank line attaches nothing."""
    out = []
    for m in _COMMENT.finditer(text):
        if not any(x in m[0] for x in MARKS):
            continue
        end = len(text[: m.end()].encode())
        gap = lambda s: text.encode()[end : s["byte_start"]].decode("utf-8", "replace")
        after = [s for s in symbols if s["byte_start"] >= end]
        first = min(after, key=lambda s: s["byte_start"], default=None)
        near = first is not None and "\n\n" not in gap(first) and not gap(first).startswith("\n") and re.fullmatch(r"[\w\s]*", gap(first)) is not None
        lines = [re.sub(r"^\s*(?://+!?|/\*+|\*+/|\*)\s?|\s*\*+/\s*$", "", x) for x in m[0].strip().split("\n")]
        out.append({"body": "\n".join(lines).strip(), "byte_start": len(text[: m.start()].encode()), "attached": [first["ix"]] if near else []})
    return out
