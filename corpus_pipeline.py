"""A training corpus from raw documents: five operators of quillgraph.llm, each stage written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import mixing, neardups, packing, quality, substrings
from quillgraph.llm.common import read, written

#: (name, function of (spark, docs, sf_dir)); all but the last return the columns of documents.
STAGES = [
    ("quality rules", quality.stage),
    ("MinHash near-dedup", neardups.stage),
    ("substring dedup", substrings.stage),
    ("mixing sources", mixing.stage),
    ("best-fit packing", packing.stage),
]

#: SQL cannot express the stages (robust estimates, sketches, automata, tokens); tests/llm holds each to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
