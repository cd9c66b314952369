"""The closed catalog, envelopes, incremental ingest and the driver's entry."""

import importlib
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from quillgraph.plans import catalog
from quillgraph.plans import queries as Q
from quillgraph.sources import adapter as A
from quillgraph.sources.tables import written
from quillgraph.streaming.ingest import ingest


@pytest.fixture(scope="module")
def graph(spark):
    sf = "/root/testdata/sf0.001"
    symbols = written(A.symbols(spark, sf), "symbols")
    base = written(A.symbols(spark, sf, "base"), "base")
    bound = written(A.bindings(base, A.edges(base)), "bindings")
    return catalog.Graph("s1", A.files(spark, sf), symbols, written(A.edges(symbols), "edges"), bindings=bound, fragments=Q._fragments(spark, sf, symbols), base=base)


def test_only_the_catalog_is_answered(graph):
    for name, args in (("symbol.drop", {}), ("symbol.callers", {}), ("symbol.callers", {"name": ""})):
        with pytest.raises(catalog.CatalogError):
            catalog.execute(graph, name, args)


def test_every_answer_has_its_evidence(graph):
    unique = graph.symbols.groupBy("name").count().where("count = 1").orderBy("name").first()["name"]
    many = graph.symbols.groupBy("name").count().where("count > 1").orderBy("name").first()["name"]
    for name, args in catalog.CATALOG.items():
        e = catalog.execute(graph, name, {a: unique for a in args})
        row = e.rows().first()
        assert row["tokens"] > 10 and set(e.capabilities["not_built"]) == {"F07", "F08", "F13", "F15"}
        assert (e.ledger is None) != (e.fold is None)
        assert e.outcome == ("unknown" if name == "plan.deviation" else "found")
    assert catalog.execute(graph, "symbol.callers", {"name": many}).outcome == "ambiguous"
    lost = catalog.execute(graph, "symbol.callers", {"name": unique.upper().replace("O", "o_")})
    assert lost.outcome == "unknown" and lost.answer["near"].where("kind = 'spelling'").count() == 1


def test_answers_are_within_the_envelope(graph, spark, tmp_path):
    """Tokens measure answer and evidence; what an answer names counts as accessed; the log numbers of two writers differ."""
    import json

    from quillgraph.sources.store import claimed

    name = graph.edges.join(graph.symbols, F.col("dst") == F.col("id")).groupBy("name").count().join(graph.symbols.groupBy("name").agg(F.count("*").alias("n")).where("n = 1"), "name").orderBy(F.desc("count"), "name").first()["name"]
    e = catalog.execute(graph, "symbol.callers", {"name": name})
    lines = [json.loads(r["value"]) for r in e.lines().collect()]
    answers = [x["row"]["id"] for x in lines[1:]]
    assert lines[0]["query"] == "symbol.callers" and answers and {x["table"] for x in lines[1:]} == {"symbols"}
    assert e.coverage["accessed"] == len(set(answers) | {graph.symbols.where(F.col("name") == name).first()["id"]})
    assert e.coverage["out_of_scope_files"] == graph.files.where("bucket in ('unsupported', 'unrecognized')").count()
    whole = sum(len(r["value"].encode()) + 1 for r in e.lines().collect())
    assert e.rows().first()["tokens"] == whole // 4
    folder = f"file://{tmp_path}/numbers"
    assert [claimed(spark, folder), claimed(spark, folder, 5), claimed(spark, folder)] == [1, 6, 7]


def test_stale_projection_judges_nothing(graph):
    old = catalog.Graph(**{**graph.__dict__, "built_for": "s0"})
    out = catalog.execute(old, "binding.status")
    assert {r["code"] for r in out.answer["reports"].collect()} == {"undeterminable"} and not out.projection["current"]


def test_answers_are_logged_in_order(graph, spark, tmp_path):
    logged = catalog.Graph(**{**graph.__dict__, "log": f"file://{tmp_path}/log"})
    for _ in range(2):
        e = catalog.execute(logged, "ledger.snapshot")
    catalog.execute(logged, "symbol.resolve", {"name": graph.symbols.first()["name"]})
    rows = spark.read.parquet(logged.log).orderBy("seq").collect()
    assert [r["seq"] for r in rows] == [1, 2, 3] and e.log["status"] == "recorded" and rows[0]["args_digest"] == rows[1]["args_digest"] != rows[2]["args_digest"]
    assert not rows[0]["accessed"] and rows[2]["accessed"]


def test_ingest_extracts_each_content_once(spark, tmp_path):
    rows = [("a.ts", "TypeScript", "b1", "function f() {}"), ("b.rs", "Rust", "b2", "fn g() {}")]
    schema = "path string, language string, blob string, text string"
    src, cache, check = (f"file://{tmp_path}/{x}" for x in ("in", "cache", "check"))
    for more in (rows, rows[:1] + [("c.kt", "Kotlin", "b3", "fun h() {}")]):
        spark.createDataFrame(more, schema).write.mode("append").parquet(src)
        ingest(spark, src, cache, check).awaitTermination(60)
    assert sorted(r["path"] for r in spark.read.parquet(cache).collect()) == ["a.ts", "b.rs", "c.kt"]


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_queries_match_their_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("customer", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = Q.QUERIES[name](spark, sf)
    want = con.execute(Q.SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    show = lambda r: tuple(None if v is None else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r)
    rows = sorted(map(show, got.select(*columns).collect()), key=str)
    assert rows == sorted(map(show, want.fetchall()), key=str) and rows


def test_entry_works_without_the_training_subpackage(spark, monkeypatch):
    import importlib.util as util

    real = util.find_spec
    monkeypatch.setattr(util, "find_spec", lambda n, *a: None if n.startswith("quillgraph.llm") or n == "corpus_pipeline" else real(n, *a))
    sys.modules.pop("__spark_entry__", None)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(Q.QUERIES) and set(entry.oracle_sql()) == set(Q.SQL)
    assert entry.entry(spark).select(F.count("*")).first()[0] > 0
    sys.modules.pop("__spark_entry__", None)


def test_touch_tells_places_and_what_is_not_built(graph):
    one = graph.symbols.groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1")
    watched = graph.bindings.select("target", F.explode("watch.symbol").alias("id")).where("target <> id").join(one, "id").orderBy("name").first()
    outcome, e = catalog.touch(graph, watched["name"])
    assert outcome == "found" and {r["slot"] for r in e.answer["not_built"].collect()} == {"unresolved", "effects", "judgments"}
    places = {r["id"]: r for r in e.answer["places"].collect()}
    targets = {r["id"]: r["target"] for r in graph.bindings.collect()}
    there = {r["id"]: r for r in graph.symbols.collect()}
    assert set(places) == {r["id"] for r in e.answer["recall"].collect()} and places
    for id, r in places.items():
        want = "here" if targets[id] == watched["id"] else "known" if targets[id] in there else "gone"
        assert r["at"] == want and (r["name"] == there[targets[id]]["name"] if want == "known" else r["name"] is None)
    assert catalog.touch(graph, "nobody")[0] == "unknown"


def test_binding_reports_and_freshness(graph):
    from dataclasses import replace

    e = catalog.execute(graph, "binding.status")
    rows = e.answer["reports"].collect()
    assert len(rows) == graph.bindings.count() and {r["lineage"] for r in rows} == {"current"}
    assert all(sum(r["grades"].values()) <= r["watched"] for r in rows)
    assert catalog.stale_count(e) == sum(r["code"] == "stale" for r in rows) > 0
    assert e.projection["symbols_indexed"] == graph.symbols.count() and e.projection["rebuild"] == "settled" and e.projection["matches_worktree"] == "not_built"
    old = catalog.execute(replace(graph, built_for="s0", rebuilding=True), "binding.status")
    assert {(r["code"], r["reason"]) for r in old.answer["reports"].collect()} == {("undeterminable", "projection_stale")}
    assert not old.projection["current"] and old.projection["rebuild"] == "rebuilding" and catalog.stale_count(old) == 0


def test_projection_modes_and_named_reads(graph, spark, tmp_path):
    from quillgraph.sources import store

    gens = store.Generations(spark, f"file://{tmp_path}/p")
    exports = graph.symbols.where("ix = 1").select("path", "name", "id")
    with pytest.raises(store.ReadOnly):
        store.Projection(gens).publish("s1", graph.files, graph.symbols)
    with pytest.raises(ValueError):
        store.Projection(gens, "stitching").publish("s1", graph.files, graph.symbols)
    counts = store.Projection(gens, "stitching").publish("s1", graph.files, graph.symbols, graph.edges, exports)
    assert counts == {"edges": graph.edges.count(), "exports": exports.count(), "files": graph.files.count(), "symbols": graph.symbols.count()}
    p = store.Projection(gens)
    e = graph.edges.orderBy("src", "dst").first()
    assert e["dst"] in {r["dst"] for r in p.callees(e["src"]).collect()} and e["src"] in {r["src"] for r in p.callers(e["dst"]).collect()}
    x = exports.orderBy("path").first()
    assert p.export(x["path"], x["name"]).first()["id"] == x["id"] and p.export(x["path"], "no").count() == 0
    assert p.symbol(x["id"]).first()["name"] == x["name"] and p.file(x["path"]).count() == 1
    assert p.symbols_of(x["path"]).first()["ix"] == 1 and p.names().count() == graph.symbols.select("name").distinct().count()
    store.Projection(gens, "symbols_only").publish("s2", graph.files, graph.symbols)
    assert p.table_names() == ["files", "symbols"] and gens.built_for("s2")
    with pytest.raises(LookupError):
        p.callees(e["src"])


def test_intent_aliases_and_log_range(spark):
    from quillgraph.sources import store

    none = spark.createDataFrame([], "was string, now string")
    a = store.alias_recorded(store.alias_recorded(none, "a", "b"), "b", "c")
    assert store.alias_of(a, "a") == "c" and store.alias_of(store.alias_recorded(a, "c", "a"), "a") == "c"
    assert {(r["was"], r["now"]) for r in store.alias_recorded(a, "a", "d").collect()} == {("a", "d"), ("b", "c")}
    with pytest.raises(ValueError):
        store.alias_recorded(none, "a", "a")
    log = spark.createDataFrame([("s", 2), ("s", 1), ("s", 3), ("t", 1)], "snapshot string, seq long")
    assert [r["seq"] for r in store.log_range(log, "s", 2).collect()] == [2, 3] and [r["seq"] for r in store.log_range(log, "s", 1, 1).collect()] == [1]


def test_doctor_samples_across_ranges(spark):
    """Several ranges of anchors, each told from where it really ends: exactly every stride-th, and the rest left out."""
    from quillgraph.operators import doctor

    n, stride = 250_001, 489  # 512 at most
    units = spark.range(n).selectExpr("sha2(cast(id AS string), 256) AS anchor", "id")
    checked, left = doctor.examined(units)
    every = sorted(r["anchor"] for r in units.collect())
    assert sorted(r["anchor"] for r in checked.collect()) == every[::stride]
    assert left.count() == n - len(every[::stride]) == doctor.sampled(units, "anchor")[1]
    same = spark.range(10).selectExpr("'a' AS anchor", "id")  # a place that several units share is told for each left out
    checked, left = doctor.examined(same, 4)
    assert checked.count() == 4 and left.count() == 6


def test_doctor_samples_and_residuals(spark):
    """Small views, counted by hand: units without an anchor are always seen, and what is left out is told."""
    from quillgraph.operators import doctor

    units = spark.createDataFrame([(f"a{i:02d}", i) for i in range(10)] + [(None, 10), (None, 11)], "anchor string, n int")
    checked, left = doctor.examined(units, 4)
    assert sorted(r["n"] for r in checked.collect()) == [0, 3, 6, 9, 10, 11] and sorted(r["coord"] for r in left.collect()) == ["a01", "a02", "a04", "a05", "a07", "a08"]
    for most in (0, 10):
        checked, left = doctor.examined(units, most)
        assert checked.count() == 12 and left.count() == 0
    schema = "key string, anchor string, stale boolean, inputs array<string>"
    chain = lambda anchors: spark.createDataFrame([(f"n{i}", anchors.get(i), i == 0, [f"n{i - 1}"] if i else []) for i in range(6)], schema)
    for anchors, coords, lost in (({4: "p", 3: "q", 0: "r"}, {"p"}, set()), ({3: "q", 0: "r"}, {"q"}, set()), ({0: "r"}, {"r"}, set()), ({1: "z"}, set(), {"n4"})):
        nodes = chain(anchors)
        told, names = doctor.cut_residuals(nodes, doctor.cascade(nodes.select("key", "stale", "inputs")))
        assert {r["coord"] for r in told.collect()} == coords and {r["key"] for r in names.collect()} == lost
    d = doctor.diagnosis(spark.createDataFrame([("evidence", "x"), ("evidence", "y")], "invariant string, subject string"), {"evidence": 5, "endpoints": 1})
    assert doctor.violation_count(d) == 2 and {r["invariant"] for r in doctor.checked_invariants(d).collect()} == {"evidence", "endpoints"}
