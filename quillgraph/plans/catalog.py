"""The closed catalog of ten named queries and the envelope that says what an answer stands on."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..operators import bindings as B
from ..operators import budget, deviation, lookup, narrative, traverse
from ..sources.store import claimed
from ..sources.tables import written

#: name -> arguments. Nothing else is answered; open strings are refused.
CATALOG: dict[str, tuple[str, ...]] = {
    "ledger.snapshot": (), "symbol.resolve": ("name",), "symbol.contains": ("name",), "symbol.callers": ("name",), "symbol.reaches": ("name",),
    "graph.dump": (), "binding.status": (), "narrative.unbound": (), "binding.touch": ("name",), "plan.deviation": ("plan",),
}
#: Features that are declared and not built: an answer names them, so their absence isn't read as "none".
NOT_BUILT = {"F07": "references across files", "F08": "unresolved references", "F13": "effects", "F15": "judgment"}


class CatalogError(ValueError):
    pass


def parse(name: str, args: dict[str, str]) -> tuple[str, dict[str, str]]:
    if name not in CATALOG:
        raise CatalogError(f"{name!r} is not in the catalog")
    if missing := [a for a in CATALOG[name] if not args.get(a)]:
        raise CatalogError(f"{name} needs {', '.join(missing)}")
    return name, {a: args[a] for a in CATALOG[name]}


@dataclass
class Elision:
    """What budgets cut, by reason; counts add up."""

    counts: dict[str, int] = field(default_factory=dict)

    def add(self, reason: str, n: int) -> None:
        if n:
            self.counts[reason] = self.counts.get(reason, 0) + n

    def dropped(self) -> int:
        return sum(self.counts.values())

    def count_of(self, reason: str) -> int:
        return self.counts.get(reason, 0)

    def is_none(self) -> bool:
        return not self.counts


@dataclass
class Fold:
    """What an answer leaves to another query, by part; moved, not cut, so it is never counted as dropped."""

    parts: dict[str, tuple[int, str]] = field(default_factory=dict)

    def push(self, part: str, count: int, unfolded_by: str) -> Fold:
        """The first count of a part stays."""
        self.parts.setdefault(part, (count, unfolded_by))
        return self

    def moved(self) -> int:
        return sum(n for n, _ in self.parts.values())

    def rows(self) -> list[dict]:
        return [{"part": p, "count": n, "unfolded_by": q} for p, (n, q) in self.parts.items()]


@dataclass
class Graph:
    """The tables that queries read; those of bindings, documents and plans only where their query needs them."""

    snapshot: str
    files: DataFrame
    symbols: DataFrame
    edges: DataFrame
    built_for: str | None = None
    bindings: DataFrame | None = None
    fragments: DataFrame | None = None
    plans: dict[str, tuple[DataFrame, DataFrame]] = field(default_factory=dict)
    base: DataFrame | None = None
    #: Folder of the query log; None where answers aren't recorded.
    log: str | None = None
    #: Is the work tree what the snapshot was made of? None: not looked at.
    matches_worktree: bool | None = None
    rebuilding: bool = False

    @property
    def current(self) -> bool:
        return self.built_for in (None, self.snapshot)


@dataclass
class Envelope:
    """An answer (DataFrames by name, and an outcome) with its evidence."""

    query: str
    args: dict[str, str]
    outcome: str
    answer: dict[str, DataFrame]
    snapshot: str
    projection: dict
    coverage: dict
    capabilities: dict
    ledger: dict | None
    fold: list[dict] | None
    elision: Elision
    log: dict

    def map(self, f) -> Envelope:
        """Another answer on the same evidence."""
        return Envelope(**{**self.__dict__, "answer": f(self.answer)})

    def evidence(self) -> str:
        parts = ("query", "args", "outcome", "snapshot", "projection", "coverage", "capabilities", "ledger", "fold", "log")
        return json.dumps({k: getattr(self, k) for k in parts} | {"elision": self.elision.counts}, sort_keys=True, ensure_ascii=False)

    def lines(self) -> DataFrame:
        """(value): the envelope as JSON lines, the evidence first, then the answer's rows, each under its table's name."""
        spark = next(iter(self.answer.values())).sparkSession
        out = spark.range(1).select(F.lit(0).alias("n"), F.lit(self.evidence()).alias("value"))
        for n, (name, df) in enumerate(sorted(self.answer.items()), 1):
            out = out.unionByName(df.select(F.lit(n).alias("n"), F.to_json(F.struct(F.lit(name).alias("table"), F.struct("*").alias("row"))).alias("value")))
        return out.select("value")

    def rows(self) -> DataFrame:
        """One row: the evidence as JSON, and the whole envelope's size, answer included, in tokens of BYTES_PER_TOKEN bytes."""
        size = F.floor(F.sum(F.octet_length("value") + 1) / budget.BYTES_PER_TOKEN).alias("tokens")
        return self.lines().agg(size).select(F.lit(self.query).alias("query"), F.lit(self.outcome).alias("outcome"), F.lit(self.evidence()).alias("evidence"), "tokens")


#: What a touch answer has no table for, and the feature that would fill it.
SLOTS_NOT_BUILT = {"unresolved": "F08", "effects": "F13", "judgments": "F15"}


def freshness(graph: Graph) -> dict:
    """What the projection stands on: work tree, rebuild, the snapshot it was built for and how much it holds."""
    return {
        "built_for": graph.built_for or graph.snapshot,
        "current": graph.current,
        "matches_worktree": "not_built" if graph.matches_worktree is None else graph.matches_worktree,
        "rebuild": "rebuilding" if graph.rebuilding else "settled",
        "symbols_indexed": graph.symbols.count(),
    }


def stale_count(e: Envelope) -> int:
    """How many bindings of a binding.status answer are stale; other answers have none."""
    return e.answer["reports"].where("code = 'stale'").count() if "reports" in e.answer else 0


def touch(graph: Graph, name: str) -> tuple[str, Envelope]:
    """binding.touch by its outcome (found, ambiguous or unknown), by the same path as any query, log included."""
    e = execute(graph, "binding.touch", {"name": name})
    return e.outcome, e


def _one(df: DataFrame) -> dict:
    return df.first().asDict()


def execute(graph: Graph, name: str, args: dict[str, str] | None = None) -> Envelope:
    """Answer one named query. "Unknown" and "ambiguous" are answers, told apart from an empty one."""
    name, args = parse(name, args or {})
    began, spark = time.time(), graph.symbols.sparkSession
    elision, answer, outcome, accessed = Elision(), {}, "found", None
    start = None
    if "name" in args:
        asked = spark.range(1).select(F.lit(args["name"]).alias("asked"))
        found = lookup.resolve(asked, graph.symbols)
        n = found.count()
        if n == 0:
            near = lookup.near_names(asked, graph.symbols)
            elision.add("near_max", (near.agg(F.max("beyond")).first()[0]) or 0)
            outcome, answer = "unknown", {"near": near.select("kind", "name", "place")}
        elif name == "symbol.resolve":
            answer = {"symbols": found.drop("asked")}
        elif n > 1:
            outcome, answer = "ambiguous", {"candidates": found.drop("asked")}
        else:
            start = written(found.select(F.col("id").alias("start")), "start")
        accessed = found.select("id") if n else None
    if start is not None:
        if name == "symbol.contains":
            answer = {"symbols": written(lookup.contains(start, graph.symbols), "answer")}
        elif name == "symbol.callers":
            answer = {"symbols": written(lookup.callers(start, graph.edges, graph.symbols), "answer")}
        elif name == "symbol.reaches":
            nodes, cut = traverse.reaches(start, graph.edges)
            for r in cut.collect():  # one start: at most four rows
                elision.add(r["reason"], r["count"])
            answer = {"reached": nodes}
            accessed = nodes.select(F.col("node").alias("id"))
        elif name == "binding.touch":
            statuses = written(B.status(graph.bindings, graph.symbols, graph.current), "status")
            recall, facts = B.touch(start, graph.bindings, statuses, graph.edges)
            elision.add("binding_max", facts.first()["beyond"])
            slots = F.map_from_arrays(F.array(*map(F.lit, SLOTS_NOT_BUILT)), F.array(*map(F.lit, SLOTS_NOT_BUILT.values())))
            answer = {"recall": recall, "facts": facts, "places": B.places(recall, graph.bindings, graph.symbols), "not_built": spark.range(1).select(F.explode(slots).alias("slot", "feature"))}
            seen = recall.select("id").join(graph.bindings.select("id", "target"), "id").select(F.col("target").alias("id"))
            accessed = accessed.unionByName(seen).distinct()
        if "symbols" in answer:  # what an answer names was seen, too
            accessed = accessed.unionByName(answer["symbols"].select("id")).distinct()
    elif name == "ledger.snapshot":
        answer = {"ledger": lookup.ledger(graph.files)}
    elif name == "graph.dump":
        answer = {"nodes": graph.symbols.orderBy("id"), "edges": graph.edges.distinct().orderBy("src", "dst")}
    elif name == "binding.status":
        statuses = written(B.status(graph.bindings, graph.symbols, graph.current), "status")
        answer = {"reports": B.reports(graph.bindings, graph.symbols, statuses).orderBy("id")}
        watched = B.watch_index(graph.bindings).select(F.col("symbol").alias("id"))
        accessed = watched.unionByName(graph.bindings.select(F.col("target").alias("id"))).distinct()
    elif name == "narrative.unbound":
        done = written(narrative.resolve(graph.fragments, graph.symbols), "narrative")
        answer = {"unbound": narrative.unbound_items(graph.fragments, done), "counts": narrative.counts(done), "spread": narrative.spread(done)}
    elif name == "plan.deviation":
        if args["plan"] not in graph.plans:
            outcome, answer = "unknown", {"plans": spark.range(0).select(F.lit("").alias("plan"))}
        else:
            at_base, at_head = graph.plans[args["plan"]]
            delta = deviation.symbol_delta(graph.base, graph.symbols)
            split = written(deviation.deviate(at_base, at_head, delta), "deviation")
            answer = {"deviation": split, "rate": deviation.rate(split, delta)}
    counts = _one(lookup.ledger(graph.files))
    nothing = {"identity": 1, "unresolved": 0, "grade": 0, "accessed": 0}
    covered = _one(lookup.coverage(accessed, graph.symbols, graph.files)) if accessed is not None else nothing
    covered["out_of_scope_files"] = lookup.out_of_scope_files(graph.files)
    log = {"status": "recorded"} if graph.log else {"status": "not_recorded", "reason": "read_only_attach"}
    envelope = Envelope(
        name, args, outcome, answer, graph.snapshot, freshness(graph), covered,
        {"built": sorted(CATALOG), "not_built": NOT_BUILT}, None if name != "ledger.snapshot" else counts,
        None if name == "ledger.snapshot" else Fold().push("ledger", counts["files_total"], "ledger.snapshot").rows(), elision, log,
    )
    #: The time is an observation of the run, not part of the answer.
    envelope.micros = int((time.time() - began) * 1e6)
    if graph.log:
        _record(graph, envelope, accessed)
    return envelope


def _record(graph: Graph, e: Envelope, accessed: DataFrame | None) -> None:
    """Append the answer to the log, partitioned by snapshot; its number is claimed, so two writers never share one."""
    spark = graph.symbols.sparkSession
    schema = "snapshot string, seq long, query string, args_digest string, elision string, micros long, accessed array<string>"
    seen = accessed.agg(F.array_sort(F.collect_set("id")).alias("accessed")) if accessed is not None else spark.range(1).select(F.array().cast("array<string>").alias("accessed"))
    args = ids.args_digest(*(F.lit(v) for _, v in sorted(e.args.items())))
    new = seen.select(F.lit(e.snapshot).alias("snapshot"), F.lit(e.query).alias("query"), args.alias("args_digest"), F.lit(json.dumps(e.elision.counts, sort_keys=True)).alias("elision"), F.lit(e.micros).cast("long").alias("micros"), "accessed")
    try:
        old = spark.read.schema(schema).parquet(graph.log).where(F.col("snapshot") == e.snapshot)
        old.limit(1).count()
    except AnalysisException as x:
        if "PATH_NOT_FOUND" not in str(x):
            raise
        old = spark.range(0).select(F.lit("").alias("snapshot"), F.lit(0).cast("long").alias("seq"))
    last = old.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("s")).first()["s"]
    seq = claimed(spark, f"{graph.log.rstrip('/')}-numbers/{ids.SEP.join(e.snapshot.split('/')).encode().hex()}", last)
    new.withColumn("seq", F.lit(seq).cast("long")).write.mode("append").partitionBy("snapshot").parquet(graph.log)
