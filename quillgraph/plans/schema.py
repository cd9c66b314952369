"""The graph schema, declared once and validated when loaded."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Who may produce what.
PROVENANCE = ("extracted", "observed", "asserted", "inferred")
GRADES = ("exact", "scoped", "candidate", "unresolved")
CARDINALITY = ("one-to-one", "many-to-one", "one-to-many", "many-to-many")


def can_assert_existence(provenance: str) -> bool:
    return provenance in ("extracted", "observed")


@dataclass(frozen=True)
class Node:
    label: str
    provenance: str
    key: tuple[str, ...]
    attributes: tuple[str, ...] = ()
    built: bool = True

    def field_names(self) -> list[str]:
        return sorted({*self.key, *self.attributes})


@dataclass(frozen=True)
class Edge:
    type: str
    src: str
    dst: str
    cardinality: str
    grade: str
    provenance: str = "extracted"
    evidence: str = "span"
    snapshot: bool = True


NODES = (
    Node("Symbol", "extracted", ("id",), ("path", "container", "name", "kind", "body", "span", "identity")),
    Node("File", "extracted", ("path",), ("language", "grade", "export_digest", "refs")),
    Node("Binding", "asserted", ("id",), ("subject", "note", "bound_at", "bound_at_time", "radius", "watch", "promoted_by")),
    Node("NarrativeItem", "inferred", ("item",), ("fragment", "class")),
    Node("NarrativeRefusal", "asserted", ("item", "target"), ("at", "reason")),
    Node("Actor", "extracted", ("id",), ("display",)),
    Node("Change", "extracted", ("id",), ("kind", "summary", "at")),
    Node("Defect", "extracted", ("id",), ("description", "at")),
    Node("UnresolvedRef", "extracted", ("id",), (), False),
    Node("Journey", "extracted", ("id",), (), False),
)
EDGES = (
    Edge("BOUND_TO", "Binding", "Symbol", "many-to-one", "exact", "asserted"),
    Edge("AUTHORED_BY", "Change", "Actor", "many-to-one", "exact"),
    Edge("TOUCHES", "Change", "Symbol", "many-to-many", "exact"),
    Edge("FOLLOWS", "Change", "Change", "many-to-many", "exact"),
    Edge("MANIFESTS_AT", "Defect", "Symbol", "many-to-many", "exact"),
    Edge("INTRODUCED_BY", "Defect", "Change", "many-to-one", "candidate", "inferred"),
    Edge("RESOLVED_BY", "Defect", "Change", "many-to-one", "exact"),
    Edge("REFERENCES", "Symbol", "Symbol", "many-to-many", "scoped"),
)


def validate(nodes: tuple[Node, ...] = NODES, edges: tuple[Edge, ...] = EDGES) -> None:
    """Raise on a label or type declared twice, an unknown value or end, or a candidate edge that claims extraction."""
    labels = [n.label for n in nodes]
    if len(set(labels)) != len(labels) or len({e.type for e in edges}) != len(edges):
        raise ValueError("declared twice")
    for n in nodes:
        if n.provenance not in PROVENANCE or not n.key or set(n.key) & set(n.attributes):
            raise ValueError(f"node {n.label}")
    for e in edges:
        if e.src not in labels or e.dst not in labels or e.cardinality not in CARDINALITY or e.grade not in GRADES or e.provenance not in PROVENANCE or not e.evidence or not e.snapshot:
            raise ValueError(f"edge {e.type}")
        if e.grade == "candidate" and e.provenance == "extracted":
            raise ValueError(f"edge {e.type}: a candidate is inferred")


def label_table(spark: SparkSession) -> DataFrame:
    """(label, built, fields): the schema as a dimension to join with."""
    rows = F.array(*(F.struct(F.lit(n.label).alias("label"), F.lit(n.built).alias("built"), F.array(*map(F.lit, n.field_names())).alias("fields")) for n in NODES))
    return spark.range(1).select(F.inline(rows))


def coverage_gaps(spark: SparkSession, view: DataFrame) -> DataFrame:
    """(label, reason) of labels that a view (label) doesn't hold: not_built or not_stored."""
    gone = label_table(spark).join(view.select("label").distinct(), "label", "left_anti")
    return gone.select("label", F.when(F.col("built"), "not_stored").otherwise("not_built").alias("reason"))
