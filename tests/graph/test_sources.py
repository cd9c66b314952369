"""Git, rules, scopes, comments, entity ids and the schema."""

import subprocess

import pytest

from quillgraph.functions import entity
from quillgraph.plans import schema
from quillgraph.sources import comments, git, rules, scanners, scopes


@pytest.fixture
def repo(tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.ts").write_text("function f() {}\n")
    (tmp_path / "d").mkdir()
    (tmp_path / "d/b.rs").write_bytes(b"fn g() {}\n\x00")
    run("add", "."), run("commit", "-qm", "one")
    (tmp_path / "a.ts").write_text("function f() { return 1 }\n")
    (tmp_path / "c.kt").write_text("fun h() {}\n")
    run("rm", "-q", "d/b.rs"), run("add", "."), run("commit", "-qm", "two")
    return str(tmp_path)


def test_git_snapshots(spark, repo):
    tree = git.list_tree(spark, repo, "HEAD~1")
    assert {r["path"]: bytes(r["content"]) for r in git.read_blobs(tree, repo).collect()} == {"a.ts": b"function f() {}\n", "d/b.rs": b"fn g() {}\n\x00"}
    assert {(r["path"], r["change"]) for r in git.changed_in(spark, repo, "HEAD").collect()} == {("a.ts", "changed"), ("c.kt", "added"), ("d/b.rs", "deleted")}
    assert {r["change"] for r in git.changed_in(spark, repo, "HEAD~1").collect()} == {"added"}
    log = git.commits(spark, repo, "HEAD").orderBy("rank").collect()
    assert [r["summary"] for r in log] == ["two", "one"] and log[0]["first_parent"] == log[1]["id"] and log[1]["first_parent"] is None
    assert {r["path"] for r in git.worktree(spark, repo).collect()} == {"a.ts", "c.kt"}


def test_git_points_and_work_tree(spark, repo):
    import os

    tree = {r["path"]: r["blob"] for r in git.list_tree(spark, repo, "HEAD").collect()}
    assert git.head(repo) == git.resolve_commit(repo, "HEAD") and git.path_at(repo, "HEAD", "c.kt") == tree["c.kt"]
    assert git.path_at(repo, "HEAD~1", "c.kt") is None and git.path_at(repo, "HEAD~1", "d") is None
    at = git.list_tree(spark, repo, "HEAD")
    assert git.matches(spark, repo, at) and not git.matches(spark, repo, git.list_tree(spark, repo, "HEAD~1"))
    os.remove(f"{repo}/c.kt")
    os.symlink("a.ts", f"{repo}/c.kt")
    odd = f"{repo}/new\nline.ts"
    with open(odd, "wb") as f:
        f.write(b"x\r\ny\r\n")
    with open(f"{repo}/.gitattributes", "w") as f:
        f.write("*.ts text\n")
    subprocess.run(["git", "-C", repo, "add", "."], check=True, capture_output=True)
    with open(odd, "ab") as f:
        f.write(b"z\r\n")
    assert git.read_worktree_file(repo, "c.kt") == b"a.ts" and git.read_worktree_file(repo, "new\nline.ts") == b"x\ny\nz\n"
    now = {r["path"]: r["blob"] for r in git.worktree(spark, repo).collect()}
    said = lambda data: subprocess.run(["git", "hash-object", "--stdin"], input=data, capture_output=True, check=True).stdout.decode().strip()
    assert now == {"a.ts": tree["a.ts"], "c.kt": said(b"a.ts"), "new\nline.ts": said(b"x\ny\nz\n"), ".gitattributes": said(b"*.ts text\n")}
    assert not git.matches(spark, repo, at)


def test_rules():
    m = rules.manifest('[[repo]]\nname = "r"\n[[exclusion]]\nid = "gen"\npattern = "gen/"\n[[exclusion]]\nid = "min"\npattern = "*.min.js"\n')
    assert m["exclusions"] == [("gen/", "gen"), ("*.min.js", "min")]
    with pytest.raises(ValueError):
        rules.manifest('[[exclusion]]\npattern = "a"\n')
    a = rules.attributes({"": "*.x linguist-language=Rust text\n# c\n[ab] text\n", "d/e": "*.x -text\n/y linguist-language=Kotlin\n"})
    assert a["linguist-language"] == [("*.x", "Rust"), ("d/e/y", "Kotlin")] and a["text"] == [("*.x", "set"), ("d/e/**/*.x", None)]


def test_scope_visibility():
    text = "use(a); let a = 1; use2(a); function use(x) { return x + later; } let later = 2; v; var v = 3; function k() { early; let early; } out.prop;"
    got = [(r["name"], r["resolution"]) for r in scopes.references(text)]
    assert got == [("use", "bound"), ("a", "before"), ("use2", "outside"), ("a", "bound"), ("x", "bound"), ("later", "bound"), ("v", "bound"), ("early", "before"), ("out", "outside")]
    assert scopes.resolution_percent([r for _, r in got]) == 71 and scopes.resolution_percent(["outside"]) is None
    chain = scopes.ScopeChain()
    inner = chain.open(chain.open(0, True), False)
    assert chain.is_within(inner, 0) and not chain.is_within(0, inner)


def test_types_and_values_are_told_apart():
    text = "interface A {} const A = 1; let x: A = A; function f(a: A): A { return a as A }"
    got = {(r["name"], r["at"]): (r["resolution"], r["declared_at"]) for r in scopes.references(text)}
    kind, value = text.index("A {"), text.index("A = 1")
    at = [i for i, c in enumerate(text) if c == "A"][2:]
    assert [got["A", i][1] for i in at] == [kind, value, kind, kind, kind]
    chain = scopes.ScopeChain()
    chain.declare(0, "n", 50, False)
    chain.declare(0, "n", 5, False)
    assert chain.resolve(0, "n", 10) == ("bound", 0, 5) and chain.resolve(0, "n", 1)[0] == "before" and chain.resolve(0, "n", 60, "type")[0] == "outside"


def test_erasure_ignores_local_names_only():
    a = scopes.erased_digest("function f(x) { const y = x + g; return y; }")
    assert a == scopes.erased_digest("function f(p) {\n const q = p + g; return q }")
    assert a != scopes.erased_digest("function f(x) { const y = x + h; return y; }")
    assert a != scopes.erased_digest("function f(x) { const y = x + g; return x; }")


def test_marked_comments():
    text = "// @decision: keep it\n// because\nfunction f() {}\n\n/* ADR-7 */\n\nfunction g() {}\n// plain\nfunction h() {}\n"
    symbols = scanners.scan(text, "TypeScript")["symbols"]
    got = comments.marked_comments(text, symbols)
    assert [(c["body"], c["attached"]) for c in got] == [("@decision: keep it\nbecause", [0]), ("ADR-7", [])]


def test_entity_ids():
    a = entity.mint(1_700_000_000_000, b"\x01" * 10)
    assert len(a) == 26 and entity.millis(a) == 1_700_000_000_000 and a < entity.mint(1_700_000_000_001, b"\0" * 10)
    assert entity.derived("a", "b") == entity.derived("a", "b") != entity.derived("ab")
    for bad in ("", "8" + "0" * 25, "U" * 26):
        with pytest.raises(ValueError):
            entity.parse(bad)
    r = entity.Registry.core()
    r.register("risk", "something")
    assert "unknown" in r.describe("x") and r.describe("risk") == "something"
    with pytest.raises(ValueError):
        r.register("plan", "again")


def test_schema(spark):
    schema.validate()
    assert schema.NODES[0].field_names()[0] == "body" and not schema.can_assert_existence("inferred")
    for e in (schema.Edge("X", "Symbol", "Nowhere", "many-to-one", "exact"), schema.Edge("X", "Symbol", "Symbol", "many-to-one", "candidate"), schema.EDGES[0]):
        with pytest.raises(ValueError):
            schema.validate(edges=(*schema.EDGES, e))
    view = spark.createDataFrame([(n.label,) for n in schema.NODES if n.label not in ("Journey", "Actor")], "label string")
    assert {(r["label"], r["reason"]) for r in schema.coverage_gaps(spark, view).collect()} == {("Journey", "not_built"), ("Actor", "not_stored")}


def test_capabilities_by_language(spark):
    from pyspark.sql import functions as F

    from quillgraph.sources import capabilities as C

    rows = C.table(spark)
    assert rows.count() == len(C.LANGUAGES) * len(C.SLOTS) and {r["language"] for r in rows.where("built").collect()} == {"TypeScript"}
    assert set(C.BUILT) == set(scanners.GRADES) and C.axis().count(";") == len(C.LANGUAGES) - 1 and "Java|no-extractor" in C.axis()
    df = spark.createDataFrame([("TypeScript", 3), ("Kotlin", 0), ("Java", 0)], "language string, n int")
    got = {r["language"]: r["v"].asDict() for r in df.select("language", C.value_of("references", F.col("language"), F.col("n")).alias("v")).collect()}
    assert got["TypeScript"] == {"value": 3, "not_built": None} and got["Kotlin"] == got["Java"] == {"value": None, "not_built": "references"}
    assert [r["name"] for r in C.symbols_of_file(spark, "a.rs", "Rust", "fn g() {}\nstruct S;").collect()] == ["g", "S"]
    assert C.symbols_of_file(spark, "a.java", "Java", "class A {}") is None
    cached = scanners.extract(spark.createDataFrame([("a.ts", "TypeScript", "const a = 1\nconst b = a")], "path string, language string, text string")).withColumn("language", F.lit("TypeScript"))
    assert C.restored(cached).count() == 1
    with pytest.raises(Exception, match="builds none"):
        C.restored(cached.withColumn("language", F.lit("Kotlin"))).collect()


def test_residuals_have_a_reason_and_a_place(spark):
    from quillgraph.operators import doctor

    good = spark.createDataFrame([("no_label", ["x"])], "reason string, coords array<string>")
    assert doctor.residuals_of(good).count() == 1
    for bad in (("no_label", []), ("no_label", [None]), ("no_label", None), ("other", ["x"]), (None, ["x"])):
        with pytest.raises(Exception, match="no residual"):
            doctor.residuals_of(spark.createDataFrame([bad], "reason string, coords array<string>")).collect()


def test_fold_is_moved_not_dropped():
    from quillgraph.plans.catalog import Fold

    f = Fold().push("ledger", 3, "ledger.snapshot").push("ledger", 9, "other").push("more", 2, "q")
    assert f.moved() == 5 and f.rows()[0] == {"part": "ledger", "count": 3, "unfolded_by": "ledger.snapshot"}
