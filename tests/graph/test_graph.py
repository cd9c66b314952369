"""Graph operators against plain models, and odd cases one at a time."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from quillgraph.functions.glob import GlobError, glob_matches
from quillgraph.operators import bindings, defect, deviation, doctor, lookup, narrative, traverse
from quillgraph.operators.traverse import Budget
from quillgraph.plans import queries
from quillgraph.sources import documents, recognize, scanners, store


def model_reaches(start, edges, b):
    """The budgeted search as a queue, one step at a time."""
    out, cut, seen, queue = [], {}, {start}, deque([(start, 0, 1)])
    more = lambda r, n=1: cut.__setitem__(r, cut.get(r, 0) + n) if n else None
    out.append(start) if b.nodes >= 1 else more("node_max")
    while queue:
        node, depth, product = queue.popleft()
        steps = sorted(edges.get(node, {}).items())
        if depth >= b.depth:
            more("depth", len({d for d, _ in steps if d not in seen}))
            continue
        for d, c in steps:
            if c > b.candidates:
                more("candidates")
                continue
            np = product * max(c, 1)
            if np > b.product:
                more("path_product", 1 + len(queue))
                return out, cut
            if d in seen:
                continue
            seen.add(d)
            if len(out) >= b.nodes:
                more("node_max")
                continue
            out.append(d)
            queue.append((d, depth + 1, np))
    return out, cut


def test_reaches_matches_the_queue(spark):
    rng = random.Random(2)
    for limits in (Budget(), Budget(nodes=6), Budget(depth=1), Budget(candidates=2), Budget(product=5), Budget(2, 6, 2, 9), Budget(nodes=0)):
        edges, starts, rows = {}, [], []
        for g in range(12):
            nodes = [f"{g:02d}-{i:02d}" for i in range(12)]
            starts.append(nodes[0])
            for a in nodes:
                for d in rng.sample(nodes, rng.randint(0, 3)):
                    edges.setdefault(a, {})[d] = rng.choice((1, 1, 2, 3, 4))
        rows = [(a, d, c) for a, to in edges.items() for d, c in to.items()]
        nodes, cut = traverse.reaches(spark.createDataFrame([(s,) for s in starts], "start string"), spark.createDataFrame(rows, "src string, dst string, candidates int"), limits)
        got = {}
        for r in nodes.orderBy("start", "rank").collect():
            got.setdefault(r["start"], []).append(r["node"])
        told = {}
        for r in cut.collect():
            told.setdefault(r["start"], {})[r["reason"]] = r["count"]
        for s in starts:
            want, lost = model_reaches(s, edges, limits)
            assert got.get(s, []) == want and told.get(s, {}) == lost


def test_reaches_without_candidates(spark):
    rng = random.Random(5)
    nodes = [f"n{i:02d}" for i in range(20)]
    edges = {a: dict.fromkeys(rng.sample(nodes, rng.randint(0, 4)), 1) for a in nodes}
    df = spark.createDataFrame([(a, d) for a, to in edges.items() for d in to], "src string, dst string")
    limits = Budget(depth=2, nodes=7)
    found, cut = traverse.reaches(spark.createDataFrame([(n,) for n in nodes], "start string"), df, limits)
    got, told = {}, {n: {} for n in nodes}
    for r in found.orderBy("start", "rank").collect():
        got.setdefault(r["start"], []).append(r["node"])
    for r in cut.collect():
        told[r["start"]][r["reason"]] = r["count"]
    for n in nodes:
        assert (got[n], told[n]) == model_reaches(n, edges, limits)


def test_whole_queries_take_every_name_and_start(spark, sf):
    found = {r["id"]: r["name"] for r in queries.QUERIES["graph_nodes"](spark, sf).collect()}
    edges, named = {}, {}
    for r in queries.QUERIES["graph_edges"](spark, sf).collect():
        edges.setdefault(r["src"], {})[r["dst"]] = 1
    for i, n in found.items():
        named.setdefault(n, set()).add(i)
    run = lambda name: queries.QUERIES[name](spark, sf).collect()
    got = {}
    for r in run("symbol_resolve"):
        got.setdefault(r["asked"], set()).add(r["id"])
    assert got == named
    told = {r["asked"]: (r["n"], r["id"]) for r in run("symbol_outcome")}
    assert told == {n: (len(x), min(x) if len(x) == 1 else None) for n, x in named.items()} | {n: (0, None) for n in ("O_11", "o-1-3", "nothing")}
    nodes, cut = {}, {}
    for r in run("symbol_reaches"):
        nodes.setdefault(r["start"], set()).add(r["node"])
    for r in run("symbol_reaches_cut"):
        cut.setdefault(r["start"], {})[r["reason"]] = r["count"]
    model = {i: model_reaches(i, edges, Budget()) for i in found}
    assert nodes == {i: set(out) for i, (out, _) in model.items()}
    assert cut == {i: {r: n for r, n in lost.items() if n} for i, (_, lost) in model.items() if any(lost.values())}
    assert run("symbol_coverage")[0]["accessed"] == len(found)


def test_cascade_stops_with_residuals(spark):
    rows = [("a", True, []), ("b", False, ["a"]), ("c", False, ["b", "x"]), ("d", False, ["c"]), ("e", False, ["d"]), ("f", False, ["e"]), ("x", False, [])]
    got = {r["key"]: (r["grade"], r["via"]) for r in traverse.cascade(spark.createDataFrame(rows, "key string, stale boolean, inputs array<string>")).collect()}
    assert got == {"a": ("stale", []), "b": ("stale_derived", ["a"]), "c": ("stale_derived", ["b"]), "d": ("stale_derived", ["c"]), "e": ("residual", []), "f": ("live", []), "x": ("live", [])}


SYMBOLS = "id string, path string, container array<string>, name string, body string, grade int, bucket string, byte_start long, byte_end long, ix long, ordinal long"


def symbol(i, name="n", path="p", container=(), body="b", grade=2, bucket="parsed", at=0):
    return (i, path, list(container), name, body, grade, bucket, at, at + 10, at, 0)


def test_binding_precedence(spark):
    s = spark.createDataFrame([symbol("same"), symbol("moved", body="other"), symbol("blind", grade=0), symbol("half", bucket="partial")], SYMBOLS)
    watch = lambda *ids: [(i, "b") for i in ids]
    rows = [
        ("live", "same", watch("same")), ("stale", "moved", watch("moved", "same")), ("orphan", "gone", watch("gone", "blind", "moved")), ("blind", "same", watch("same", "blind", "half", "lost")),
        ("half", "same", watch("same", "half", "lost", "moved")), ("lost", "same", watch("same", "lost", "moved")), ("none", "same", []),
    ]
    b = spark.createDataFrame(rows, "id string, target string, watch array<struct<symbol:string,digest:string>>")
    got = {r["id"]: (r["code"], r["reason"], r["ids"]) for r in bindings.status(b, s).collect()}
    assert got == {
        "live": ("live", None, []), "stale": ("stale", None, ["moved"]), "orphan": ("orphaned", None, ["gone"]), "blind": ("undeterminable", "identity_grade", ["blind"]),
        "half": ("undeterminable", "partial_parse", ["half"]), "lost": ("undeterminable", "watch_member_gone", ["lost"]), "none": ("live", None, []),
    }
    assert {r["reason"] for r in bindings.status(b, s, projection_current=False).collect()} == {"projection_stale"}


def test_touch_never_cuts_what_is_not_live(spark):
    rows = [(f"b{i:02d}", "t", [("t", "b" if i % 2 else "old")]) for i in range(40)]
    b = spark.createDataFrame(rows, "id string, target string, watch array<struct<symbol:string,digest:string>>")
    s = spark.createDataFrame([symbol("t")], SYMBOLS)
    edges = spark.createDataFrame([("t", "t"), ("q", "t")], "src string, dst string")
    recall, facts = bindings.touch(s.select(F.col("id").alias("start")), b, bindings.status(b, s), edges)
    assert recall.count() == 20 and recall.where("code = 'live'").count() == 0
    f = facts.first()
    assert (f["callers"], f["callees"], f["on"], f["beyond"]) == (2, 1, 40, 20)


def test_narrative_first_signal_decides(spark):
    s = spark.createDataFrame([symbol("1", "f", "a.ts"), symbol("2", "g", "a.ts", ["K"]), symbol("3", "f", "b.ts")], SYMBOLS)
    rows = [("d", "att", "x", ["9"], ["a.ts"], [], []), ("d", "ground", "x", [], ["a.ts#K.g"], [], ["f"]), ("d", "file", "x", [], ["a.ts"], [], []), ("d", "fence", "x", [], [], ["b.ts"], []), ("d", "span", "x", [], [], [], ["K#g", "1f"]), ("d", "no", "x\ny", [], ["z.ts"], [], ["h"])]
    f = spark.createDataFrame(rows, "path string, anchor string, body string, attached array<string>, grounds array<string>, fenced_paths array<string>, spans array<string>")
    done = narrative.resolve(f, s)
    got = {r["anchor"]: (r["class"], r["by"], r["candidates"]) for r in done.collect()}
    assert got == {
        "att": ("bound", "attached", ["9"]), "ground": ("bound", "frontmatter", ["2"]), "file": ("candidates", "frontmatter", ["1", "2"]), "fence": ("candidates", "fenced_path", ["3"]),
        "span": ("candidates", "span", ["2"]), "no": ("unbound", None, []),
    }
    assert narrative.unbound_items(f, done).first().asDict() == {"path": "d", "anchor": "no", "head": "x", "signals_seen": 2}
    sizes = spark.createDataFrame([("candidates", "span", ["x"] * k) for k in (1, 2, 3, 4)], "class string, by string, candidates array<string>")
    r = narrative.spread(sizes).first()
    assert (r["items"], r["median"], r["max"], r["reviewable"]) == (4, 3, 4, 3)
    none = f.select("path", "anchor", F.lit("t").alias("target")).limit(0)
    with pytest.raises(ValueError):
        narrative.bulk_approve(done, "d", none)


def test_deviation_gives_all_four_classes(spark):
    base = spark.createDataFrame([symbol("1", "a"), symbol("2", "b"), symbol("3", "c", "q")], SYMBOLS)
    head = spark.createDataFrame([symbol("1", "a", body="new"), symbol("2", "b"), symbol("4", "d")], SYMBOLS)
    files = spark.createDataFrame([("p",), ("q",)], "path string")
    pat = spark.createDataFrame([("i1", "symbol", "a", "span"), ("i2", "symbol", "b", "span"), ("i3", "symbol", "zzz", "span"), ("i4", "new_symbol", "d", "declared"), ("i5", "new_symbol", "e", "declared"), ("i6", "paths", "none/*", "path")], "item string, kind string, text string, source string")
    delta = deviation.symbol_delta(base, head)
    assert {(r["id"], r["change"]) for r in delta.collect()} == {("1", "changed"), ("3", "removed"), ("4", "added")}
    split = deviation.deviate(deviation.resolve_patterns(pat, base, files), deviation.resolve_patterns(pat, head, files), delta)
    got = {(r["class"], r["item"], r["coord"]) for r in split.collect()}
    assert got == {("as_planned", "i1", "1"), ("as_planned", "i4", "4"), ("unplanned", None, "3"), ("unimplemented", "i2", None), ("unmeasurable", "i3", None), ("unimplemented", "i5", None), ("unimplemented", "i6", None)}
    assert deviation.rate(split.where("false"), delta.where("false")).first()["tag"] == "undefined"


def test_votes_go_to_the_commit_just_newer(spark):
    h = spark.createDataFrame([("k", "s", 0, "x"), ("k", "s", 1, "x"), ("k", "s", 2, "y"), ("k", "t", 0, "x"), ("k", "t", 1, None), ("k", "u", 0, "x"), ("k", "u", 1, "x")], "case string, id string, rank int, body string")
    votes = defect.introduction_votes(h)
    assert {(r["id"], r["rank"]) for r in votes.collect()} == {("s", 1), ("t", 0)}
    c = spark.createDataFrame([("k", 0, "b"), ("k", 1, "a"), ("k", 2, "c")], "case string, rank int, commit string")
    w = defect.winners(votes, c).first()
    assert (w["commit"], w["votes"], w["cast"], w["majority"], w["strict"], w["percent"]) == ("a", 1, 2, True, False, 50)


def test_doctor_sampling_and_empty_population(spark):
    rows = spark.range(1000).withColumnRenamed("id", "k")
    kept, skipped = doctor.sampled(rows, "k", 100)
    assert sorted(r["k"] for r in kept.collect()) == list(range(0, 1000, 10)) and skipped == 900
    found = spark.createDataFrame([("endpoints", "x")], "invariant string, subject string")
    got = {r["invariant"]: r["outcome"] for r in doctor.diagnosis(found, {"endpoints": 3, "evidence": 2}).collect()}
    assert got["endpoints"] == "violated" and got["evidence"] == "clean" and got["freshness"] == "not_built"


def test_globs(spark):
    cases = {"*.ts": {"a.ts", "x/a.ts", "c.ts", "src/b/c.ts"}, "src/**": {"src/a", "src/b/c.ts"}, "src/": {"src/a", "src/b/c.ts", "x/src/a"}, "/src/*": {"src/a"}, "**/c.ts": {"src/b/c.ts", "c.ts"}, "a?ts": {"a.ts", "x/a.ts"}}
    paths = spark.createDataFrame([(p,) for p in ("a.ts", "x/a.ts", "src/a", "src/b/c.ts", "x/src/a", "c.ts")], "path string")
    for g, want in cases.items():
        assert {r["path"] for r in paths.where(glob_matches(F.col("path"), g)).collect()} == want, g
    with pytest.raises(GlobError):
        glob_matches(F.col("path"), "[ab]")


def test_recognition_order(spark):
    rows = [("a.RS", None, ""), ("a.sql", "kotlin", ""), ("a.zzz", "Elm", ""), ("x/Makefile", None, ""), ("makefile", None, ""), ("run", None, "#!/usr/bin/env -S python3 -u\n"), ("run2", None, "#! /bin/zsh"), ("x.md", None, "#!/bin/sh")]
    got = [r["l"] for r in spark.createDataFrame(rows, "path string, declared string, head string").select(recognize.language(F.col("path"), F.col("declared"), F.col("head")).alias("l")).collect()]
    assert got == ["Rust", "Kotlin", "Elm", "Make", None, "Python", "Shell", "Markdown"]


def test_classification_order(spark):
    rows = [("g/generated/a.ts", 10, "x DO NOT EDIT", False, None, 0), ("g/a.ts", 10, "DO NOT EDIT", False, None, 0), ("a.ts", 10, "", True, None, 0), ("a.ts", 3_000_000, "", True, None, 0), ("a.ts", 1, "", False, "r", 0), ("a.ts", 1, "", False, None, 30), ("a.ts", 1, "", False, None, 31), ("a.java", 1, "", False, None, 0), ("a", 1, "", False, None, 0)]
    df = spark.createDataFrame(rows, "path string, size long, head string, nul boolean, rule string, err int")
    lang = recognize.language(F.col("path"), F.lit(None).cast("string"), F.col("head"))
    got = [r["b"] for r in df.select(recognize.bucket(F.col("path"), F.col("size"), F.col("head"), F.col("nul"), F.col("rule"), lang, F.col("err")).alias("b")).collect()]
    assert got == ["generated", "parsed", "binary", "excluded", "excluded", "partial", "unsupported", "unsupported", "unrecognized"]


TS = """// c
import { x } from './m'; const r = require("q");
export default function main(a: number) { const inner = 1; function hidden() { return 2; } }
export class K<T> { private m(): void { } async n<T>(b = "}") { if (b) { } } }
interface I { f(): void }
type T2 = { a: 1 };
export const enum E { A, B }
export { y as z, w };
export * from "s";
const v = () => { };
"""


def test_typescript_scan():
    got = scanners.scan(TS, "TypeScript")
    assert [(s["name"], s["kind"], s["container"]) for s in got["symbols"]] == [
        ("r", "variable", []), ("main", "function", []), ("K", "class", []), ("m", "method", ["K"]), ("n", "method", ["K"]), ("I", "interface", []), ("T2", "type_alias", []), ("E", "enum", []), ("v", "variable", []),
    ]
    assert got["exports"] == {"has_default": True, "names": ["E", "K", "w", "z"], "stars": ["s"]} and got["imports"] == ["./m", "q", "s"]
    assert got["recovery_sites"] == 0 and scanners.scan("function f() {", "TypeScript")["recovery_sites"] == 1


def test_rust_and_kotlin_scan():
    rust = scanners.scan("pub struct S { a: u8 }\nimpl<T> Tr for S { fn go(&self) -> u8 { fn local() {} 1 } }\nmod m { pub const fn k() {} }\nconst X: &str = \"}{\";", "Rust")
    assert [(s["name"], s["kind"], s["container"]) for s in rust["symbols"]] == [("S", "struct", []), ("go", "function", ["S"]), ("m", "module", []), ("k", "function", ["m"]), ("X", "const", [])]
    kt = scanners.scan("class A { fun inside() {} }\nfun top(x: Int) { }\nobject O { }\ntypealias Q = Int;", "Kotlin")
    assert [(s["name"], s["kind"]) for s in kt["symbols"]] == [("A", "class"), ("top", "function"), ("O", "object"), ("Q", "type_alias")]


def declared(text, language):
    return [(s["name"], s["kind"], s["container"]) for s in scanners.scan(text, language)["symbols"]]


def test_declarations_without_semicolons():
    ts = "const a = 1\nfunction h() {}\nlet b: { x: number } = { x: 1 }\nexport const c = () =>\n  a\ntype T = { y: 1 }\n  & U\nclass K {\n  f = 1\n  m() { return 1 }\n  static n<T>(x: T) {}\n}\nfoo()\nenum E { A }\nfunction o(): { z: 1 } { return q }\nvar last = [\n1]"
    assert declared(ts, "TypeScript") == [
        ("a", "variable", []), ("h", "function", []), ("b", "variable", []), ("c", "variable", []), ("T", "type_alias", []), ("K", "class", []), ("m", "method", ["K"]), ("n", "method", ["K"]),
        ("E", "enum", []), ("o", "function", []), ("last", "variable", []),
    ]
    changed = ts.replace("{ x: 1 }", "{ x: 2 }")
    body = lambda t, n: next(s["body"] for s in scanners.scan(t, "TypeScript")["symbols"] if s["name"] == n)
    assert body(ts, "b") != body(changed, "b") and body(ts, "a") == body(changed, "a")


def test_kotlin_top_level():
    kt = (
        "package p\nval a = 1\nvar b: Int = 2\n    get() = field\nfun g() {}\nfun String.ext() = 1\nfun <T> List<T>.second(): T = this[1]\nenum class E { A, B }\nval Int.half: Int\n    get() = this / 2\n"
        "private const val C = 3\ndata class D(val x: Int)\nfun interface F { fun run() }\ninterface I\nval (p, q) = pair\nfun f() = if (x) { 1 } else { 2 }\nval l by lazy { 5 }\n@Ann\nsuspend fun `odd name`() {}\nobject O { val inside = 1 }\ntypealias Q = Int\n"
    )
    assert [(n, k) for n, k, c in declared(kt, "Kotlin") if not c] == [
        ("a", "property"), ("b", "property"), ("g", "function"), ("ext", "function"), ("second", "function"), ("E", "class"), ("half", "property"), ("C", "property"), ("D", "class"),
        ("F", "class"), ("I", "class"), ("f", "function"), ("l", "property"), ("odd name", "function"), ("O", "object"), ("Q", "type_alias"),
    ]


def test_rust_impls_go_to_types_of_their_module():
    rust = (
        "impl<T: Fn(u8) -> T> Foo<T> { fn a() {} }\nstruct Foo<T>(T);\nimpl super::Bar { fn b() {} }\nunion U { x: u8 }\nimpl fmt::Display for crate::U { fn c() {} }\n"
        "mod m { impl Foo { fn d() {} } pub struct S; impl<'a> From<&'a u8> for S where u8: Copy { fn e() {} const K: u8 = 1; type X = u8; } }\n"
        "trait Tr { type A; fn sig(); fn def() {} const Z: u8; }\npub(crate) const unsafe fn g() {}\nextern \"C\" fn h() {}\nstatic mut N: u8 = 1;\nmacro_rules! mac { () => { fn no() {} } }\nimpl<F> Tr for F where F: for<'x> Fn(&'x u8) { fn i() {} }"
    )
    assert declared(rust, "Rust") == [
        ("a", "function", ["Foo"]), ("Foo", "struct", []), ("b", "function", []), ("U", "union", []), ("c", "function", ["U"]), ("m", "module", []), ("d", "function", ["m"]), ("S", "struct", ["m"]),
        ("e", "function", ["m", "S"]), ("K", "const", ["m", "S"]), ("X", "type_alias", ["m", "S"]), ("Tr", "trait", []), ("def", "function", ["Tr"]), ("Z", "const", ["Tr"]), ("g", "function", []),
        ("h", "function", []), ("N", "static", []), ("mac", "macro", []), ("i", "function", []),
    ]


def test_body_digest_ignores_layout_and_sees_meaning():
    a = scanners.scan("function f(a, b) { return 'x' + a; }", "TypeScript")["symbols"][0]["body"]
    b = scanners.scan("/* moved */ function f(a,\n  b,\n) {\n  return \"x\" + a // c\n}", "TypeScript")["symbols"][0]["body"]
    c = scanners.scan("function f(a, b) { return 'y' + a; }", "TypeScript")["symbols"][0]["body"]
    assert a == b != c


def test_fragments_and_plans():
    text = "---\ngrounds: [src/a.ts#K.m]\n---\nintro `x`\n# Head\n## Empty\n## Head\nsee `K.m`\n```\nsrc/b.ts:12:3\n# not a heading\n```\n"
    got = documents.fragments(text)
    assert [(f["anchor"], f["grounds"], f["fenced_paths"], f["spans"]) for f in got] == [("_preamble", ["src/a.ts#K.m"], [], ["x"]), ("head", [], [], []), ("empty", [], [], []), ("head-2", [], ["src/b.ts"], ["K.m"])]
    assert got[3]["body"].split("\n")[0] == "Head" and got[2]["body"] == "Empty"
    assert documents.fragments("# A\ntext\n\n    src/c.ts\n    # no heading `z`\n\nafter `q`")[0]["fenced_paths"] == ["src/c.ts"]
    plan = documents.plan_items("---\nbaseline: abc\n---\n# P\n- [ ] do `a.b` in src/x.ts and NewThing (new)\n  coords: q, w (new)\n  verify: run it\n- [x] nothing\n")
    assert plan["baseline"] == "abc" and [(i["anchor"], len(i["patterns"])) for i in plan["items"]] == [("p#1", 3), ("p#2", 0)]
    assert {(p["text"], p["kind"], p["source"]) for p in plan["items"][0]["patterns"]} == {("a.b", "symbol", "span"), ("src/x.ts", "paths", "path"), ("NewThing", "new_symbol", "identifier")}
    plan = documents.plan_items("# P\nintro\n## First\ndo it to `k`\ncoords: q, w (new)\nverify: run it\n## Second\n")
    assert [(i["anchor"], i["statement"], i["verify"], len(i["patterns"])) for i in plan["items"]] == [("first", "do it to `k`", "run it", 3), ("second", "Second", None, 0)]
    assert ("w", "new_symbol", "declared") in {(p["text"], p["kind"], p["source"]) for p in plan["items"][0]["patterns"]}
    with pytest.raises(ValueError):
        documents.plan_items("no items")


def test_extract_and_fragment_tables(spark):
    files = spark.createDataFrame([("a.ts", "TypeScript", TS), ("b.md", "Markdown", "x"), ("c.rs", "Rust", None)], "path string, language string, text string")
    assert {r["path"]: len(r["symbols"]) for r in scanners.extract(files).collect()} == {"a.ts": 9, "c.rs": 0}
    assert documents.fragment_table(files.select("path", "text").where("path = 'b.md'")).count() == 1


def test_plan_table(spark):
    docs = spark.createDataFrame([("p.md", "---\nbaseline: c0\n---\n# T\n- [ ] change `f` in src/a.ts\n- [x] rest\nprose about `g`\n"), ("none.md", "text"), ("null.md", None)], "path string, text string")
    got = sorted((r["path"], r["item"], r["kind"] or "", r["text"] or "", r["baseline"]) for r in documents.plan_table(docs).collect())
    assert got == [("p.md", "t#1", "paths", "src/a.ts", "c0"), ("p.md", "t#1", "symbol", "f", "c0"), ("p.md", "t#2", "", "", "c0")]


def test_cache_usage_and_quarantine(spark):
    e = spark.createDataFrame([("c/a", 10, 1), ("c/b", 5, 2), ("c/quarantine/x", 7, 1), ("c/quarantine/y", 7, 3)], "path string, bytes long, mtime long")
    assert store.cache_usage(e).first().asDict() == {"entries": 2, "bytes": 15, "quarantined": 2, "quarantined_bytes": 14}
    assert [r["path"] for r in store.quarantine_swept(e, 8).collect()] == ["c/quarantine/x"]
    assert {r["path"] for r in store.stray(spark.createDataFrame([("a.tmp", 1, 0), ("b.tmp", 1, 9000), ("c", 1, 0)], "path string, bytes long, mtime long"), 9000).collect()} == {"a.tmp"}


def test_generations_swap_whole(spark, tmp_path):
    g = store.Generations(spark, f"file://{tmp_path}/gen")
    assert g.current() is None and not g.built_for("s1")
    g.publish("s1", {"symbols": spark.range(3)})
    g.publish("s2", {"symbols": spark.range(5)})
    assert g.table("symbols").count() == 5 and g.built_for("s2") and not g.built_for("s1")
    with pytest.raises(LookupError):
        g.table("edges")


def test_intent_round_trip_and_aliases(spark):
    b = spark.createDataFrame([("1", "t", "n"), ("2", "u", "m")], "id string, target string, note string")
    a = spark.createDataFrame([("r0", "r1"), ("r1", "r2"), ("c", "d"), ("d", "c")], "was string, now string")
    lines = store.intent_export(b, a)
    back, already = store.intent_import(lines, b.where("id = '1'"))
    assert already == 1 and {tuple(r) for r in back.collect()} == {tuple(r) for r in b.collect()}
    assert store.alias_of(a, "r0") == "r2" and store.alias_of(a, "c") in ("c", "d") and store.alias_of(a, "x") == "x"
    with pytest.raises(ValueError):
        store.intent_import(lines.where("value not like '%header%'"), b)


def test_innermost_takes_the_narrowest(spark):
    spans = spark.createDataFrame([symbol("wide", at=0)[:7] + (0, 100, 0, 0), symbol("near", at=0)[:7] + (10, 20, 1, 0), symbol("twin", at=0)[:7] + (10, 20, 2, 0)], SYMBOLS)
    got = {r["at"]: r["inner"] for r in lookup.innermost(spark.createDataFrame([("p", 5), ("p", 12), ("p", 20), ("p", 100), ("z", 1)], "path string, at long"), spans).collect() if True}
    assert got == {5: "wide", 12: "near", 20: "wide", 100: None, 1: None}


def test_innermost_broadcasts_nothing(spark, tmp_path):
    """Points out of a nested file that is small for what it holds: the plan may not send them to the driver."""
    spark.range(40).selectExpr("'p' AS path", "sequence(0L, 99L) AS ats").write.parquet(str(tmp_path / "points"))
    spark.createDataFrame([symbol("wide", at=0)[:7] + (0, 100, 0, 0), symbol("near", at=0)[:7] + (10, 20, 1, 0)], SYMBOLS).write.parquet(str(tmp_path / "spans"))
    points = spark.read.parquet(str(tmp_path / "points")).selectExpr("path", "explode(ats) AS at")
    got = lookup.innermost(points, spark.read.parquet(str(tmp_path / "spans")))
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert {(r["inner"], r["count"]) for r in got.groupBy("inner").count().collect()} == {("near", 400), ("wide", 3600)}


def test_edges_broadcast_no_references(spark, tmp_path):
    """Edges need a target, which makes the join with the declared names an inner one: it may not send references to the driver either."""
    from quillgraph.sources import projection

    ref = "named_struct('at', 15L + n, 'name', 'x', 'resolution', 'bound', 'declared_at', 50L)"
    spark.range(40).selectExpr("concat('p', id) AS path", f"transform(sequence(0L, 4L), n -> {ref}) AS refs").write.parquet(str(tmp_path / "found"))
    made = ("concat('p', id) AS path", "n * 40L + 10 AS name_at", "n * 40L AS byte_start", "n * 40L + 30 AS byte_end", "n AS ix", "concat(id, '-', n) AS id")
    spark.range(40).selectExpr("id", "explode(array(0, 1)) AS n").selectExpr(*made).write.parquet(str(tmp_path / "symbols"))
    edges = projection.edges_of(spark.read.parquet(str(tmp_path / "found")), spark.read.parquet(str(tmp_path / "symbols")))[0]
    assert "Broadcast" not in edges._jdf.queryExecution().executedPlan().toString()
    assert {(r["src"], r["dst"]) for r in edges.collect()} == {(f"{i}-0", f"{i}-1") for i in range(40)}


def test_totals_broadcast_no_references(spark, tmp_path):
    from quillgraph.sources import projection

    ref = "named_struct('at', 15L + n, 'name', 'x', 'resolution', 'bound', 'declared_at', 50L)"
    spark.range(40).selectExpr("concat('p', id) AS path", f"transform(sequence(0L, 4L), n -> {ref}) AS refs").write.parquet(str(tmp_path / "found"))
    spark.range(40).selectExpr("concat('p', id) AS path", "50L AS name_at", "0L AS byte_start", "30L AS byte_end", "0 AS ix", "string(id) AS id").write.parquet(str(tmp_path / "symbols"))
    found, symbols = spark.read.parquet(str(tmp_path / "found")), spark.read.parquet(str(tmp_path / "symbols"))
    totals = lookup.ref_totals(projection.references_of(found, symbols), projection.edges_of(found, symbols)[1])
    assert "Broadcast" not in totals._jdf.queryExecution().executedPlan().toString()
    assert {(r["path"], r["refs"], r["classed"]) for r in totals.collect()} == {(f"p{i}", 5, 5) for i in range(40)}


def test_bind_refuses_what_it_cannot_watch(spark, monkeypatch):
    s = spark.createDataFrame([symbol("1", "a"), symbol("2", "b"), symbol("3", "b"), symbol("4", "z", grade=0)], SYMBOLS)
    edges = spark.createDataFrame([("2", "1"), ("3", "2")], "src string, dst string")
    empty = spark.createDataFrame([], "id string, subject string")
    row = bindings.bind("a", "n", empty, s, edges, "closure", 2).first()
    assert [w["symbol"] for w in row["watch"]] == ["1", "2", "3"] and row["target"] == "1"
    for name in ("b", "nope", "z"):
        with pytest.raises(bindings.BindRefused):
            bindings.bind(name, "n", empty, s, edges)
    monkeypatch.setattr("quillgraph.operators.budget.WATCH_PRODUCT", 2)
    with pytest.raises(bindings.BindRefused):
        bindings.bind("a", "n", empty, s, edges, "closure", 2)


def test_approval_and_refusal(spark):
    done = spark.createDataFrame([("d", "a", "candidates", "span", ["1", "2"])], "path string, anchor string, class string, by string, candidates array<string>")
    no = spark.createDataFrame([], "path string, anchor string, target string, reason string")
    assert narrative.approve(done, "d", "a", "2", no).count() == 1
    no = narrative.refused(no, "d", "a", "2", "wrong")
    assert narrative.refused(no, "d", "a", "2", "again").collect() == no.collect()
    for target, refusals in (("2", no), ("9", no)):
        with pytest.raises(ValueError):
            narrative.approve(done, "d", "a", target, refusals)
    with pytest.raises(ValueError):
        narrative.refused(no, "d", "a", "1", " ")
    kept = narrative.minted(done.select("path", "anchor", F.lit("e").alias("entity")).limit(0), done)
    assert narrative.minted(kept, done).collect() == kept.collect() and kept.count() == 1


def test_item_states(spark):
    schema = "item string, kind string, text string, source string, state string, why string, targets array<string>"
    base = spark.createDataFrame([("i", "new_symbol", "a", "s", "pending", "declared_new", []), ("i", "symbol", "b", "s", "bound", None, ["1"]), ("j", "new_symbol", "c", "s", "pending", "declared_new", [])], schema)
    head = spark.createDataFrame([("i", "new_symbol", "a", "s", "bound", None, ["2"]), ("i", "symbol", "b", "s", "bound", None, ["9"]), ("j", "new_symbol", "c", "s", "pending", "declared_new", [])], schema)
    got = {r["item"]: (r["expected"], r["still_pending"], r["promoted"]) for r in deviation.item_states(base, head).collect()}
    assert got == {"i": (2, False, 1), "j": (0, True, 0)}
