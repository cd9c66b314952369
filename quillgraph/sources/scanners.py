"""Declarations, exports and imports of source files by lexical scanning.

No grammar library is at hand, so these scanners see declarations by their keywords, nesting by braces, statement ends
by semicolons or, where a language has none, by line ends between tokens that don't continue each other. Their grade is
1 (declarations and nesting), 2 for TypeScript, whose references are resolved too. Comments, strings and template texts
never count as code. Unbalanced braces are recovery sites; a file that is mostly such sites counts as defeated.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .workers import ship

_TOKEN = {
    "TypeScript": re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?|[\w$]+|\s+|.""", re.S),
    "Kotlin": re.compile(r'''//[^\n]*|/\*.*?(?:\*/|\Z)|""".*?(?:"""|\Z)|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?|`[^`\n]*`|\w+|\s+|.''', re.S),
    "Rust": re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|b?r(#*)".*?"\1|b?"(?:\\.|[^"\\])*"?|'(?:\\.|[^'\\\n])'|'\w+|\w+|\s+|.""", re.S),
}
# What declares what.
_KINDS = {
    "TypeScript": {"function": "function", "class": "class", "interface": "interface", "type": "type_alias", "enum": "enum", "const": "variable", "let": "variable", "var": "variable", "namespace": "module"},
    "Kotlin": {"fun": "function", "class": "class", "interface": "class", "object": "object", "typealias": "type_alias", "val": "property", "var": "property"},
    "Rust": {"fn": "function", "struct": "struct", "enum": "enum", "trait": "trait", "impl": "impl", "mod": "module", "const": "const", "static": "static", "type": "type_alias", "union": "union", "macro_rules": "macro"},
}
#: Raised whenever the scanners find other things in the same text.
VERSION = 2
#: 2: references within the file are resolved.
GRADES = {"TypeScript": 2, "Kotlin": 1, "Rust": 1}
# What may stand before a declaration's keyword.
_BEFORE = frozenset(
    "export default declare abstract async public private protected static readonly pub open data sealed internal override inline suspend unsafe get set const extern crate "
    "enum annotation value inner companion lateinit operator infix tailrec external expect actual final".split()
)
#: Tokens after which, and before which, a statement goes on across a line end.
_GOES_ON_AFTER = frozenset("= , . : ? & | + - * / % < ( [ { ! ~ ^ extends implements as is in of new return typeof keyof infer else by".split())
_GOES_ON_BEFORE = frozenset("= . , ? : & | + - * / % < > ) ] ^ ( [ extends implements as satisfies instanceof in of is by where else catch finally".split())
_BLOCKS = frozenset("function class object interface enum module method struct trait union macro".split())
_NAME = re.compile(r"[\w$]+|`[^`\n]*`")
#: Kinds inside which further declarations are symbols; elsewhere (function bodies) they are local.
_HOLDS = {"TypeScript": {"class", "interface", "module", "enum"}, "Kotlin": set(), "Rust": {"module", "impl", "trait"}}
_SCHEMA = (
    "path string, symbols array<struct<ix:int,container:array<string>,name:string,kind:string,body:string,byte_start:long,byte_end:long,line_start:int,line_end:int,name_at:long>>, "
    "exports struct<has_default:boolean,names:array<string>,stars:array<string>>, imports array<string>, recovery_sites int, grade int, "
    "refs array<struct<at:long,name:string,resolution:string,declared_at:long>>, comments array<struct<body:string,byte_start:long,attached:array<int>>>"
)


def tokens(text: str, language: str) -> list[tuple[str, int]]:
    """(token, place) of code: comments and white space are gone, strings stay whole."""
    return [(m[0], m.start()) for m in _TOKEN[language].finditer(text) if not (m[0].isspace() or m[0].startswith(("//", "/*")))]


def normalized(code: list[str]) -> str:
    """Code text by which bodies are compared: no comments or layout, one quote style, no ";" or trailing comma."""
    out: list[str] = []
    for t in code:
        if t == ";":
            continue
        if t in ")]}" and out and out[-1] == ",":
            out.pop()
        if t[:1] == "'" and len(t) > 2 and t.endswith("'") and '"' not in t:
            t = '"' + t[1:-1] + '"'
        out.append(t)
    return "\x1f".join(out)


def _starts_line(text: str, code: list[tuple[str, int]]) -> list[bool]:
    """Of each token, whether a line end lies between it and the token before."""
    end, out = 0, []
    for t, at in code:
        out.append("\n" in text[end:at] or not out)
        end = at + len(t)
    return out


def _goes_on(code: list[tuple[str, int]], i: int, language: str) -> bool:
    """Whether the token at i continues the statement of the token before it, across a line end."""
    last, t = code[i - 1][0], code[i][0]
    arrow = last == ">" and i > 1 and code[i - 2][0] in ("=", "-")
    accessor = language == "Kotlin" and t in ("get", "set") and i + 1 < len(code) and code[i + 1][0] in ("(", "=")
    return arrow or accessor or last in _KINDS[language] or last in _BEFORE or last in _GOES_ON_AFTER or t in _GOES_ON_BEFORE or t == "{" and last not in (";", "}")


def _end(code: list[tuple[str, int]], i: int, kind: str, language: str, fresh: list[bool]) -> int:
    """Index just past the declaration that starts at i: its block, or the statement's end."""
    depth, opened, begun = 0, False, i
    while i < len(code):
        t = code[i][0]
        if not depth and i > begun and fresh[i] and language != "Rust" and not _goes_on(code, i, language):
            return i
        if t in ("{", "(", "["):
            depth += 1
            opened |= t == "{"
        elif t in ("}", ")", "]"):
            if depth == 0:
                return i
            depth -= 1
            follows = code[i + 1][0] if i + 1 < len(code) else ""
            if depth == 0 and t == "}" and opened and kind in _BLOCKS and (language == "Rust" or follows != "{" and not (language == "Kotlin" and follows in _GOES_ON_BEFORE)):
                return i + 1
        elif t == ";" and depth == 0:
            return i + 1
        i += 1
    return i


def _byte_of(text: str):
    """A function from places in the text to places in its UTF-8 bytes."""
    if text.isascii():
        return lambda at: at
    sums = [0]
    for c in text:
        sums.append(sums[-1] + len(c.encode("utf-8", "surrogatepass")))
    return lambda at: sums[at]


def _past_angles(code: list[tuple[str, int]], i: int) -> int:
    """Past the <...> that starts at i; ">" of an arrow closes nothing."""
    depth = 0
    while i < len(code):
        t = code[i][0]
        depth += (t == "<") - (t == ">" and code[i - 1][0] not in ("-", "="))
        i += 1
        if depth <= 0:
            break
    return i


def _kotlin_name(code: list[tuple[str, int]], i: int, kind: str, hi: int) -> int | None:
    """Place of the declared name after the keyword at i: the last one before "(" (functions) or the type and value."""
    i, found, stop = i + 1, None, ("(", "{", "=") if kind == "function" else (":", "=", "by", "{", "(", ";", "get", "set")
    while i < hi and code[i][0] not in stop:
        if code[i][0] == "<":
            i = _past_angles(code, i)
            continue
        if _NAME.fullmatch(code[i][0]):
            if found is not None and code[i - 1][0] not in (".", ">", "?"):
                break
            found = i
            if kind not in ("function", "property"):
                break
        i += 1
    return found


def _rust_target(head: list[tuple[str, int]]) -> str:
    """The last segment of the path of the type that an impl is for; generic lists don't count."""
    flat, i = [], 0
    while i < len(head):
        if head[i][0] == "<":
            i = _past_angles(head, i)
            flat.append("<>")
            continue
        flat.append(head[i][0])
        i += 1
    at = next((k for k, t in enumerate(flat) if t == "for" and flat[k + 1 : k + 2] != ["<>"]), -1)
    path: list[str] = []
    for t in flat[at + 1 :]:
        if t == "where" or path and t in ("<>", "{"):
            break
        if _NAME.fullmatch(t) and t not in ("dyn", "mut", "const"):
            path.append(t)
    return path[-1] if path else "?"


def scan(text: str, language: str) -> dict:
    """Symbols with nesting, exports, imports, references, marked comments and recovery sites of one file."""
    code = tokens(text, language)
    fresh = _starts_line(text, code)
    lines = [0, *(m.end() for m in re.finditer("\n", text))]
    byte = _byte_of(text)
    line = lambda at: bisect_right(lines, at)
    symbols: list[dict] = []
    impls: list[tuple[int, int, str, list[str]]] = []
    kinds, holds = _KINDS[language], _HOLDS[language]

    def add(name: str, kind: str, lo: int, hi: int, container: list[str], at: int) -> None:
        first, last = code[lo][1], code[min(hi, len(code)) - 1]
        end = last[1] + len(last[0])
        body = hashlib.sha256(("body\x1f" + normalized([t for t, _ in code[lo:hi]])).encode("utf-8", "surrogatepass")).hexdigest()
        place = {"byte_start": byte(first), "byte_end": byte(end), "line_start": line(first), "line_end": line(max(first, end - 1)), "name_at": byte(code[at][1])}
        symbols.append({"ix": len(symbols), "container": container, "name": name, "kind": kind, "body": body, **place})

    def declared(i: int, hi: int, container: list[str], inside: str | None) -> int | None:
        """Past the declaration whose keyword is at i; None if there is none."""
        t, n = code[i][0], i + 1
        kind = kinds[t]
        if language == "Rust" and t == "impl":
            while n < hi and code[n][0] not in ("{", ";"):
                n += 1
            end, before = _end(code, i, "trait", language, fresh), len(symbols)
            head = code[i + 1 : n]
            head = head[_past_angles(head, 0) :] if head and head[0][0] == "<" else head
            members(n + 1, end - 1, container, "impl")
            impls.append((before, len(symbols), _rust_target(head), container))
            return end
        if language == "Kotlin":
            n = _kotlin_name(code, i, kind, hi)
            if t == "fun" and i + 1 < hi and code[i + 1][0] == "interface":
                return None
        else:
            while n < hi and code[n][0] in ("*", "!", "mut"):
                n += 1
        if n is None or n >= hi or not _NAME.fullmatch(code[n][0]) or language == "TypeScript" and kind == "variable" and container:
            return None
        end, name = _end(code, i, kind, language, fresh), code[n][0].strip("`")
        if language == "Rust" and (t == "fn" and code[end - 1][0] == ";" or t == "type" and inside == "trait"):
            return end  # a signature or an associated type declares no item
        add(name, kind, i, end, container, n)
        if kind in holds:
            body = next((k for k in range(n, end) if code[k][0] == "{"), end)
            members(body + 1, end - 1, [*container, name], kind)
        return end

    def members(lo: int, hi: int, container: list[str], inside: str | None) -> None:
        i, at_start = lo, True
        while i < hi:
            t = code[i][0]
            at_start = at_start or language != "Rust" and fresh[i] and not _goes_on(code, i, language)
            nxt = code[i + 1][0] if i + 1 < hi else ""
            if t == "const" and nxt in ("enum", "fn", "unsafe", "async", "extern") and at_start:
                i += 1
                continue
            if t in kinds and at_start and (inside is None or inside in holds) and (end := declared(i, hi, container, inside)) is not None:
                i, at_start = end, True
                continue
            if language == "TypeScript" and inside == "class" and at_start and _NAME.fullmatch(t) and nxt in ("(", "<") and t not in ("if", "for", "while", "switch", "return"):
                end = _end(code, i, "method", language, fresh)
                add(t, "method", i, end, container, i)
                i, at_start = end, True
                continue
            if t in "{([":
                i = _end(code, i, "class", language, fresh) if t == "{" else _matching(code, i)
                at_start = t == "{"
                continue
            abi = language == "Rust" and t[:1] == '"' and i > lo and code[i - 1][0] == "extern"
            at_start = t in (";", "}", "]", ")", "fun") and (t != "fun" or nxt == "interface") or t in _BEFORE or abi
            i += 1

    members(0, len(code), [], None)
    types = {(tuple(s["container"]), s["name"]) for s in symbols if s["kind"] in ("struct", "enum", "trait", "union", "type_alias")}
    for lo, hi, target, container in impls:  # after the whole file, so that the order of declarations doesn't matter
        for s in symbols[lo:hi]:
            s["container"] = [*container, target] if (tuple(container), target) in types else container
    depth = broken = 0
    for t, _ in code:
        depth += (t == "{") - (t == "}")
        if depth < 0:
            broken, depth = broken + 1, 0
    exports, imports = _modules([t for t, _ in code]) if language == "TypeScript" else ({"has_default": False, "names": [], "stars": []}, [])
    from . import comments, scopes

    refs = scopes.references(text) if language == "TypeScript" else []
    for r in refs:
        r["at"], r["declared_at"] = byte(r["at"]), byte(r["declared_at"]) if r["declared_at"] >= 0 else -1
    marked = comments.marked_comments(text, symbols) if any(m in text for m in comments.MARKS) else []
    return {"symbols": symbols, "exports": exports, "imports": imports, "recovery_sites": broken + depth, "grade": GRADES[language], "refs": refs, "comments": marked}


def _matching(code: list[tuple[str, int]], i: int) -> int:
    depth = 0
    while i < len(code):
        depth += (code[i][0] in ("(", "[", "{")) - (code[i][0] in (")", "]", "}"))
        i += 1
        if depth <= 0:
            break
    return i


def _modules(code: list[str]) -> tuple[dict, list[str]]:
    """Export names (aliases resolved), the default flag, star modules; modules imported or required."""
    names, stars, imports, default = set(), set(), [], False
    text = lambda t: t[1:-1] if t[:1] in "\"'`" and len(t) > 1 else None
    for i, t in enumerate(code):
        nxt = code[i + 1] if i + 1 < len(code) else ""
        if t == "export":
            if nxt == "default":
                default = True
            elif nxt == "*":
                module = next((text(x) for x in code[i + 2 : i + 6] if text(x)), None)
                if module and code[i + 2] == "from":
                    stars.add(module)
            elif nxt == "{":
                part: list[str] = []
                for x in code[i + 2 :]:
                    if x in (",", "}"):
                        if part:
                            default |= part[-1] == "default"
                            names.update({part[-1]} - {"default"})
                        part = []
                        if x == "}":
                            break
                    elif x != "type":
                        part.append(x)
            else:
                rest = [x for x in code[i + 1 : i + 7] if x not in ("async", "abstract", "declare", "*")]
                if rest and rest[0] in _KINDS["TypeScript"]:
                    k = 2 if rest[0] == "const" and len(rest) > 1 and rest[1] == "enum" else 1
                    if len(rest) > k and _NAME.fullmatch(rest[k]):
                        names.add(rest[k])
        if t == "from" and text(nxt) or t == "import" and text(nxt):
            imports.append(text(nxt))
        if t in ("require", "import") and nxt == "(" and i + 2 < len(code) and text(code[i + 2]):
            imports.append(text(code[i + 2]))
    return {"has_default": default, "names": sorted(names), "stars": sorted(stars)}, sorted(set(imports))


def extract(files: DataFrame) -> DataFrame:
    """``files`` (path, language, text) of scanned languages to one row each; run it on cache misses only."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            rows = [{"path": p, **scan(t or "", lang)} for p, lang, t in zip(pdf["path"], pdf["language"], pdf["text"], strict=True) if lang in _KINDS]
            yield pd.DataFrame(rows, columns=["path", "symbols", "exports", "imports", "recovery_sites", "grade", "refs", "comments"])

    ship(files.sparkSession)
    return files.select("path", "language", "text").mapInPandas(run, _SCHEMA)
