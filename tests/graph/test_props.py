"""Properties in both directions: layout never changes a digest, meaning always does; globs follow a plain matcher."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.functions.glob import glob_regex
from quillgraph.sources import scanners, scopes

SEEDS = (
    "function f(a, b) { const c = a + b; if (c > 1) { return [c, 'x']; } return { k: c }; }",
    "class K { m(x) { return x * 2; } n() { return this.m(3); } }",
    "interface I { p: string; q(): number }",
    "enum E { A = 1, B = 2 }",
)


def digests(text):
    return [s["body"] for s in scanners.scan(text, "TypeScript")["symbols"]]


@settings(max_examples=60, deadline=None)
@given(st.sampled_from(SEEDS), st.randoms())
def test_layout_and_comments_do_not_change_bodies(seed, rng):
    out = []
    for t, _ in scanners.tokens(seed, "TypeScript"):
        out.append(t + rng.choice((" ", "\n", "  /* c */ ", " // c\n", "\t")))
    assert digests("".join(out)) == digests(seed)


@settings(max_examples=60, deadline=None)
@given(st.sampled_from(SEEDS), st.randoms())
def test_a_changed_token_changes_a_body(seed, rng):
    code = [t for t, _ in scanners.tokens(seed, "TypeScript")]
    places = [i for i, t in enumerate(code) if re.fullmatch(r"\d+|[*+>]", t)]
    if places:
        i = rng.choice(places)
        code[i] = {"+": "-", "*": "/", ">": "<"}.get(code[i], code[i] + "7")
        assert digests(" ".join(code)) != digests(seed)


@settings(max_examples=40, deadline=None)
@given(st.sampled_from(("a", "b", "c")), st.from_regex(r"\A[p-z]{3,6}[0-9]\Z"))
def test_renaming_a_local_is_erased(name, new):
    assert scopes.erased_digest(re.sub(rf"\b{name}\b", new, SEEDS[0])) == scopes.erased_digest(SEEDS[0])


def plain(pattern, path):
    one = lambda p, t: re.fullmatch("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in p), t) is not None

    def segments(p, t):
        if not p:
            return not t
        if p[0] == "**":
            return any(segments(p[1:], t[i:]) for i in range(len(t) + 1))
        return bool(t) and one(p[0], t[0]) and segments(p[1:], t[1:])

    body = pattern.rstrip("/").removeprefix("/")
    parts = body.split("/")
    if pattern.endswith("/"):
        return segments((["**"] if len(parts) == 1 else []) + parts + ["*", "**"], path.split("/"))
    return segments(parts, path.split("/") if len(parts) > 1 else [path.rsplit("/", 1)[-1]])


part = st.sampled_from(("**", "*", "a", "b", "a*", "?", "a.b"))


@settings(max_examples=400, deadline=None)
@given(st.lists(part, min_size=1, max_size=4), st.booleans(), st.booleans(), st.lists(st.sampled_from(("a", "b", "ab", "a.b", "axb")), min_size=1, max_size=4))
def test_globs_follow_the_plain_matcher(parts, lead, tail, path):
    pattern, path = "/" * lead + "/".join(parts) + "/" * tail, "/".join(path)
    assert bool(re.search(glob_regex(pattern).replace(r"\z", r"\Z"), path + "/")) == plain(pattern, path)
