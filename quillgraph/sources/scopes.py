"""Scopes of a TypeScript file and how its references resolve.

Two passes: declarations first (function and var rise to the function around them; let, const and class don't), then
references. A declaration is visible if it is hoisted, if a function boundary lies between, or if it comes before.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from .scanners import normalized, tokens

_KEYWORDS = frozenset(
    "abstract any as async await boolean break case catch class const continue debugger declare default delete do else enum export extends false finally for from function get if implements "
    "import in instanceof interface keyof let never new null number object of private protected public readonly return satisfies set static string super switch this throw true try type typeof "
    "undefined unknown var void while with yield namespace".split()
)


@dataclass
class Scope:
    parent: int | None
    function: bool
    #: (name, space, declared at, hoisted) in source order; space: value, type or both.
    bindings: list[tuple[str, str, int, bool]] = field(default_factory=list)


@dataclass
class ScopeChain:
    scopes: list[Scope] = field(default_factory=lambda: [Scope(None, True)])

    def open(self, parent: int, function: bool) -> int:
        self.scopes.append(Scope(parent, function))
        return len(self.scopes) - 1

    def declare(self, scope: int, name: str, at: int, hoisted: bool, to_function: bool = False, space: str = "value") -> None:
        while to_function and not self.scopes[scope].function:
            scope = self.scopes[scope].parent
        self.scopes[scope].bindings.append((name, space, at, hoisted))

    def is_within(self, scope: int, outer: int) -> bool:
        at: int | None = scope
        while at is not None and at != outer:
            at = self.scopes[at].parent
        return at is not None

    def resolve(self, scope: int, name: str, at: int, space: str | None = None) -> tuple[str, int | None, int | None]:
        """("bound", scope, declared at), ("before", ...) where matches are not yet visible, or ("outside", None, None).

        The first visible of all declarations of the name and space in the innermost scope that has one; ``space`` None
        is a reference whose space the text doesn't tell, which any declaration answers.
        """
        here: int | None = scope
        crossed = False
        while here is not None:
            s = self.scopes[here]
            hidden = None
            for own, of, declared, hoisted in s.bindings:
                if own == name and (space is None or of in (space, "both")):
                    if hoisted or crossed or declared <= at:
                        return "bound", here, declared
                    hidden = declared if hidden is None else hidden
            if hidden is not None:
                return "before", here, hidden
            crossed |= s.function
            here = s.parent
        return "outside", None, None


def resolution_percent(resolutions: list[str]) -> int | None:
    """Bound references among those that the file could resolve; None if there are none."""
    inside = [r for r in resolutions if r != "outside"]
    return 100 * inside.count("bound") // len(inside) if inside else None


def build(text: str) -> tuple[ScopeChain, list[tuple[int, str, int, str | None]]]:
    """The scope chain and all references (scope, name, place in the text, space where the text around tells it)."""
    code = tokens(text, "TypeScript")
    chain, stack, refs, waiting = ScopeChain(), [0], [], []
    word = lambda t: (t[0].isalpha() or t[0] in "_$") if t else False
    skip: set[int] = set()
    opened: list[str] = []
    for i, (t, at) in enumerate(code):
        before, after = (code[i - 1][0] if i else ""), (code[i + 1][0] if i + 1 < len(code) else "")
        if t == "{":
            function = bool(waiting) or before == ">" and code[i - 2][0] == "="
            scope = chain.open(stack[-1], function)
            for name, where in waiting.pop() if waiting else ():
                chain.declare(scope, name, where, True)
            stack.append(scope)
            opened.append("{")
        elif t == "}" and len(stack) > 1:
            stack.pop()
        elif t in ("function", "class", "interface", "enum", "type", "namespace") and before != "." and word(after) and after not in _KEYWORDS:
            space = "value" if t == "function" else "type" if t in ("interface", "type") else "both"
            chain.declare(stack[-1], after, code[i + 1][1], t in ("function", "interface", "type"), t == "function", space)
            skip.add(i + 1)
        elif t in ("let", "const", "var") and before != ".":
            for k in _binding_names(code, i + 1):
                chain.declare(stack[-1], code[k][0], code[k][1], t == "var", t == "var")
                skip.add(k)
        elif t == "import" and after != "(":
            k = i + 1
            while k < len(code) and code[k][0] not in ("from", ";") and code[k][0][:1] not in "\"'":
                if word(code[k][0]) and code[k][0] not in _KEYWORDS and not (k + 1 < len(code) and code[k + 1][0] == "as"):
                    chain.declare(0, code[k][0], code[k][1], True, space="both")
                    skip.add(k)
                k += 1
        if t == "(" and (before == "function" or i > 1 and code[i - 2][0] == "function" or _arrow(code, i)):
            names = []
            depth, k = 1, i + 1
            while k < len(code) and depth:
                x = code[k][0]
                depth += (x in "([{") - (x in ")]}")
                if depth and word(x) and x not in _KEYWORDS and code[k - 1][0] in ("(", ",", "{", "[", ".") and not (code[k - 1][0] == "." and code[k - 2][0] != "."):
                    names.append((x, code[k][1]))
                    skip.add(k)
                k += 1
            waiting.append(names)
        if word(t) and i not in skip and t not in _KEYWORDS and before != "." and not (after == ":" and before in ("{", ",")):
            typed = before in ("implements", "satisfies", "keyof") or before == "as" or before == ":" and (i - 2 in skip or code[i - 2][0] == ")")
            refs.append((stack[-1], t, at, "type" if typed else None if before in ("extends", "<", "|", "&", ",", "[") else "value"))
    return chain, refs


def _arrow(code: list[tuple[str, int]], i: int) -> bool:
    depth = 0
    for k in range(i, len(code)):
        depth += (code[k][0] in "([{") - (code[k][0] in ")]}")
        if not depth:
            rest = [t for t, _ in code[k + 1 : k + 3]]
            return rest == ["=", ">"]
    return False


def _binding_names(code: list[tuple[str, int]], i: int) -> list[int]:
    """Places of the names that a let, const or var declares, patterns included."""
    out, depth, start = [], 0, True
    for k in range(i, len(code)):
        t = code[k][0]
        if t in ("{", "["):
            depth += 1
        elif t in ("}", "]"):
            depth -= 1
        elif t in (";", "=", "of", "in") and depth <= 0:
            break
        elif (t[0].isalpha() or t[0] in "_$") and t not in _KEYWORDS:
            following = code[k + 1][0] if k + 1 < len(code) else ""
            if (start or code[k - 1][0] in ("{", "[", ",", ":", ".")) and not (depth and following == ":"):
                out.append(k)
            start = False
            if not depth and following != ",":
                break
    return out


def references(text: str) -> list[dict]:
    """at, name, resolution and declared_at of every reference of a file."""
    chain, refs = build(text)
    out = []
    for scope, name, at, space in refs:
        how, _, declared = chain.resolve(scope, name, at, space)
        out.append({"at": at, "name": name, "resolution": how, "declared_at": declared if declared is not None else -1})
    return out


def erased_digest(text: str) -> str:
    """Digest of a body in which local names are numbers by order of declaration: renaming a local changes nothing."""
    chain, refs = build(text)
    local = {at: (s, n) for s, scope in enumerate(chain.scopes) if s for n, _, at, _ in scope.bindings}
    number: dict[tuple[int, str], int] = {}
    for _, place in sorted((at, p) for at, p in local.items()):  # declarations of one name in one scope are one
        number.setdefault(place, len(number))
    named = {at: f"#{number[p]}" for at, p in local.items()}
    for scope, name, at, space in refs:
        how, where, _ = chain.resolve(scope, name, at, space)
        if how == "bound" and where:
            named[at] = f"#{number[(where, name)]}"
    return hashlib.sha256(("erased\x1f" + normalized([named.get(at, t) for t, at in tokens(text, "TypeScript")])).encode()).hexdigest()
