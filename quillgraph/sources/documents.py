"""Markdown into fragments, plans into items."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .workers import ship

_HEADING = re.compile(r"^(#{1,6})\s+(.*?)\s*#*\s*$")
_CODE = re.compile(r"`([^`\n]+)`")
_PATH = re.compile(r"[\w.@-]+(?:/[\w.@-]+)+\.\w+(?::\d+(?::\d+)?)?")
_CAMEL = re.compile(r"\b[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]*)+\b")
_BOX = re.compile(r"^\s*[-*]\s+\[[ xX]\]\s+(.*)$")
_LINE = re.compile(r"(?::\d+){1,2}$")


def slug(heading: str) -> str:
    return re.sub(r"\s+", "-", re.sub(r"[^\w\s-]", "", heading.strip().lower()))


def _front(text: str) -> tuple[dict[str, list[str]], str]:
    """Front matter (only "key: value" lines and "- item" lists) and the rest."""
    if not text.startswith("---\n") or "\n---" not in text[3:]:
        return {}, text
    head, rest = text[4:].split("\n---", 1)
    found: dict[str, list[str]] = {}
    key = ""
    for line in head.split("\n"):
        if m := re.match(r"^(\w[\w-]*):\s*(.*)$", line):
            key = m[1]
            found[key] = [x.strip().strip("\"'") for x in m[2].strip("[]").split(",") if x.strip()]
        elif (m := re.match(r"^\s*-\s+(.*)$", line)) and key:
            found[key].append(m[1].strip().strip("\"'"))
    return found, rest.split("\n", 1)[1] if "\n" in rest else ""


def fragments(text: str) -> list[dict]:
    """A fragment per heading (what precedes the first is "_preamble"), its body led by the heading's text; empty ones are dropped.

    Inline code gives spans, code blocks (fenced, or indented after an empty line) give path tokens, front matter
    "grounds" goes to the first fragment.
    """
    front, body = _front(text.replace("\r\n", "\n"))
    parts: list[tuple[str, list[str]]] = [("_preamble", [])]
    fence = ""
    for line in body.split("\n"):
        mark = re.match(r"^\s*(```+|~~~+)", line)
        if mark and not fence:
            fence = mark[1]
        elif mark and mark[1].startswith(fence):
            fence = ""
        heading = None if fence or mark else _HEADING.match(line)
        if heading:
            parts.append((slug(heading[2]), [heading[2]]))
        else:
            parts[-1][1].append(line)
    seen: Counter = Counter()
    out = []
    for anchor, lines in parts:
        seen[anchor] += 1
        name = anchor if seen[anchor] == 1 else f"{anchor}-{seen[anchor]}"
        whole = "\n".join(lines).strip()
        if not whole:
            continue
        prose, fenced, inside, indented = [], [], "", False
        for n, line in enumerate(lines):
            mark = re.match(r"^\s*(```+|~~~+)", line)
            if mark and not inside:
                inside = mark[1]
            elif mark and mark[1].startswith(inside):
                inside = ""
            else:
                deep = line.startswith(("    ", "\t"))
                indented = not inside and deep and (indented or n == 0 or not lines[n - 1].strip()) or indented and not line.strip()
                (fenced if inside or indented else prose).append(line)
        paths = sorted({_LINE.sub("", p) for p in _PATH.findall("\n".join(fenced))})
        out.append({"anchor": name, "body": whole, "grounds": front.get("grounds", []) if not out else [], "fenced_paths": paths, "spans": sorted(set(_CODE.findall("\n".join(prose))))})
    return out


def plan_items(text: str) -> dict:
    """baseline and items (anchor, statement, verify, patterns) of a plan; an item is a check box's line, or else a
    fragment after the first. Anchors of boxes are their fragment's and a number.

    Patterns of an item, first source wins per text: "coords:" lines (declared), code spans, path tokens, CamelCase
    identifiers. "(new)" after a text makes it a new symbol. A plan without items is refused.
    """
    front, body = _front(text.replace("\r\n", "\n"))
    parts = fragments(text)
    boxes = [(f"{f['anchor']}#{n}", m[1], [m[1]]) for f in parts for n, m in enumerate(filter(None, map(_BOX.match, f["body"].split("\n"))), 1)]
    heads = [(f["anchor"], f["body"].split("\n")) for f in parts[1:]]
    starts = boxes or [(a, next((x.strip() for x in lines[1:] if x.strip()), lines[0].strip()), lines) for a, lines in heads]
    if not starts:
        raise ValueError("a plan needs at least one item")
    items = []
    for anchor, statement, block in starts:
        whole = "\n".join(block)
        found: dict[str, tuple[str, str]] = {}

        def put(raw: str, source: str, found=found) -> None:
            new = raw.rstrip().endswith("(new)") or raw.rstrip().endswith("(신규)")
            raw = raw.rstrip().removesuffix("(new)").removesuffix("(신규)").strip().strip("`")
            path = "/" in raw
            if raw and raw not in found:
                found[raw] = ("paths" if path else "new_symbol" if new else "symbol", source)

        for line in block:
            if m := re.match(r"^\s*(?:coords|좌표):\s*(.*)$", line):
                for raw in m[1].split(","):
                    put(raw.strip(), "declared")
        for m in re.finditer(r"`([^`\n]+)`(\s*\((?:new|신규)\))?", whole):
            put(m[1] + (" (new)" if m[2] else ""), "span")
        bare = _CODE.sub(" ", whole)
        for p in _PATH.findall(bare):
            put(_LINE.sub("", p), "path")
        for m in re.finditer(_CAMEL.pattern + r"(\s*\((?:new|신규)\))?", bare):
            put(m[0], "identifier")
        verify = next((m[1] for x in block if (m := re.match(r"^\s*(?:verify|검증):\s*(.*)$", x))), None)
        items.append({"anchor": anchor, "statement": statement, "verify": verify, "patterns": [{"text": t, "kind": k, "source": s} for t, (k, s) in found.items()]})
    return {"baseline": (front.get("baseline") or [None])[0], "items": items}


def fragment_table(docs: DataFrame) -> DataFrame:
    """(path, anchor, body, grounds, fenced_paths, spans) of documents (path, text)."""
    schema = "path string, anchor string, body string, grounds array<string>, fenced_paths array<string>, spans array<string>"

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            rows = [{"path": p, **f} for p, t in zip(pdf["path"], pdf["text"], strict=True) for f in fragments(t or "")]
            yield pd.DataFrame(rows, columns=["path", "anchor", "body", "grounds", "fenced_paths", "spans"])

    ship(docs.sparkSession)
    return docs.select("path", "text").mapInPandas(run, schema)


def plan_table(docs: DataFrame) -> DataFrame:
    """(path, baseline, item, statement, verify, kind, text, source): the patterns of every plan (path, text); an item
    without patterns has one row of nulls, and a document without items none."""
    schema = "path string, baseline string, item string, statement string, verify string, kind string, text string, source string"

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            rows = []
            for path, text in zip(pdf["path"], pdf["text"], strict=True):
                try:
                    plan = plan_items(text or "")
                except ValueError:
                    continue
                for i in plan["items"]:
                    own = {"path": path, "baseline": plan["baseline"], "item": i["anchor"], "statement": i["statement"], "verify": i["verify"]}
                    rows += [own | p for p in i["patterns"]] or [own]
            yield pd.DataFrame(rows, columns=["path", "baseline", "item", "statement", "verify", "kind", "text", "source"]).astype(object)

    ship(docs.sparkSession)
    return docs.select("path", "text").mapInPandas(run, schema)
