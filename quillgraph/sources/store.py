"""Generations, query log, cache, intent records, exports."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import cypher_quoted
from ..operators import budget


def claimed(spark: SparkSession, folder: str, after: int = 0) -> int:
    """The next number above ``after`` and all that were claimed in ``folder``: creating its file decides between writers."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(sc._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    names = (x.getPath().getName() for x in fs.listStatus(at))
    n = max([after, *(int(x) for x in names if x.isdigit())]) + 1
    while not fs.createNewFile(sc._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n:012d}")):
        n += 1
    return n


class Generations:
    """Whole generations of tables under one folder; a manifest names the current one, so readers never see a mix."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        sc = self.spark.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(sc._jsc.hadoopConfiguration()), at

    def publish(self, snapshot: str, tables: dict[str, DataFrame]) -> str:
        """Write all tables, then the manifest of a new number; numbers only grow, and the greatest is current."""
        name = f"gen-{uuid.uuid4().hex}"
        for table, df in tables.items():
            df.write.parquet(f"{self.folder}/{name}/{table}")
        number = claimed(self.spark, f"{self.folder}/numbers", max((n for n, _ in self._manifests()), default=0))
        row = json.dumps({"number": number, "snapshot": snapshot, "folder": name, "tables": sorted(tables)})
        self.spark.createDataFrame([(row,)], "value string").coalesce(1).write.text(f"{self.folder}/manifest/{number:012d}")
        return name

    def _manifests(self) -> list[tuple[int, dict]]:
        fs, at = self._fs(f"{self.folder}/manifest")
        if not fs.exists(at):
            return []
        found = []
        for d in fs.listStatus(at):
            if fs.exists(self._fs(f"{d.getPath()}/_SUCCESS")[1]):
                row = json.loads(self.spark.read.text(str(d.getPath())).first()[0])
                found.append((row["number"], row))
        return found

    def current(self) -> dict | None:
        return max(self._manifests(), key=lambda x: x[0], default=(0, None))[1]

    def table(self, name: str) -> DataFrame:
        now = self.current()
        if not now or name not in now["tables"]:
            raise LookupError(f"no generation holds {name!r}")
        return self.spark.read.parquet(f"{self.folder}/{now['folder']}/{name}")

    def built_for(self, snapshot: str) -> bool:
        now = self.current()
        return bool(now) and now["snapshot"] == snapshot


class ReadOnly(PermissionError):
    pass


#: How a projection is opened: with edges and exports, symbols and names alone, or without writing.
MODES = ("stitching", "symbols_only", "read_only")


class Projection:
    """Named reads and counts of the current generation; writes publish a whole new one."""

    def __init__(self, generations: Generations, mode: str = "read_only"):
        if mode not in MODES:
            raise ValueError(f"mode {mode!r}")
        self.generations, self.mode = generations, mode

    def publish(self, snapshot: str, files: DataFrame, symbols: DataFrame, edges: DataFrame | None = None, exports: DataFrame | None = None) -> dict[str, int]:
        """Rows written by table. Symbols only: no edges and exports, those of the generation before are gone, too."""
        if self.mode == "read_only":
            raise ReadOnly("opened without writing")
        tables = {"files": files, "symbols": symbols}
        if self.mode == "stitching":
            if edges is None or exports is None:
                raise ValueError("stitching needs edges and exports")
            tables |= {"edges": edges, "exports": exports}
        self.generations.publish(snapshot, tables)
        return self.row_counts()

    def table_names(self) -> list[str]:
        now = self.generations.current()
        return sorted(now["tables"]) if now else []

    def row_counts(self) -> dict[str, int]:
        """Rows of every table; edges are stored once and read both ways, so both directions count the same."""
        return {t: self.generations.table(t).count() for t in self.table_names()}

    def files(self) -> DataFrame:
        return self.generations.table("files")

    def file(self, path: str) -> DataFrame:
        return self.files().where(F.col("path") == path)

    def symbol(self, id: str) -> DataFrame:
        return self.generations.table("symbols").where(F.col("id") == id)

    def symbols_of(self, path: str) -> DataFrame:
        return self.generations.table("symbols").where(F.col("path") == path).orderBy("byte_start", "id")

    def names(self) -> DataFrame:
        return self.generations.table("symbols").select("name").distinct()

    def callees(self, id: str) -> DataFrame:
        return self.generations.table("edges").where(F.col("src") == id).select("dst").distinct().orderBy("dst")

    def callers(self, id: str) -> DataFrame:
        return self.generations.table("edges").where(F.col("dst") == id).select("src").distinct().orderBy("src")

    def export(self, path: str, name: str) -> DataFrame:
        return self.generations.table("exports").where((F.col("path") == path) & (F.col("name") == name)).select("id")


def log_range(log: DataFrame, snapshot: str, first: int = 1, last: int | None = None) -> DataFrame:
    """A snapshot's log from number ``first`` to ``last``, in order."""
    rows = log.where((F.col("snapshot") == snapshot) & (F.col("seq") >= first))
    return (rows if last is None else rows.where(F.col("seq") <= last)).orderBy("seq")


def log_rows(log: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` (snapshot, query, args_digest, accessed, micros) numbered after the log's greatest seq per snapshot."""
    last = log.groupBy("snapshot").agg(F.max("seq").alias("last"))
    nth = F.row_number().over(Window.partitionBy("snapshot").orderBy("query", "args_digest", "micros"))
    return new.join(last, "snapshot", "left").withColumn("seq", F.coalesce("last", F.lit(0)) + nth).drop("last")


def cache_misses(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """Rows whose key no whole entry of the cache answers; a corrupt entry counts as a miss."""
    return wanted.join(cache.where("not corrupt").select("cache_key"), "cache_key", "left_anti")


def cache_stats(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    w = wanted.select("cache_key").join(cache.select("cache_key", "corrupt"), "cache_key", "left")
    return w.agg(F.count_if(~F.col("corrupt")).alias("hits"), F.count_if(F.coalesce("corrupt", F.lit(True))).alias("misses"), F.count_if("corrupt").alias("corrupt"))


def evicted(entries: DataFrame, most: int = budget.CACHE_BYTES, days: int = 1) -> DataFrame:
    """(path, bytes, mtime) to delete, oldest first, until what lives fits in ``most`` bytes.

    Bytes are summed by day first, so only the entries of the day at the border are ordered one by one.
    """
    day = F.floor(F.col("mtime") / (86_400 * days))
    e = entries.withColumn("_day", day)
    by_day = e.groupBy("_day").agg(F.sum("bytes").alias("n"))
    by_day = by_day.withColumn("before", F.sum("n").over(Window.orderBy("_day")) - F.col("n")).withColumn("all", F.sum("n").over(Window.partitionBy()))
    e = e.join(F.broadcast(by_day), "_day").withColumn("over", F.col("all") - most).where(F.col("before") < F.col("over"))
    whole = e.where(F.col("before") + F.col("n") <= F.col("over"))
    border = e.where(F.col("before") + F.col("n") > F.col("over"))
    first = border.withColumn("to", F.sum("bytes").over(Window.partitionBy("_day").orderBy("mtime", "path").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    first = first.where(F.col("before") + F.col("to") - F.col("bytes") < F.col("over")).drop("to")
    return whole.unionByName(first).select("path", "bytes", "mtime")


def cache_usage(entries: DataFrame) -> DataFrame:
    """One row (entries, bytes, quarantined, quarantined_bytes): what the cache holds, quarantine apart."""
    bad = F.col("path").contains("/quarantine/")
    size = lambda test: F.coalesce(F.sum(F.when(test, F.col("bytes"))), F.lit(0)).alias
    return entries.agg(F.count_if(~bad).alias("entries"), size(~bad)("bytes"), F.count_if(bad).alias("quarantined"), size(bad)("quarantined_bytes"))


def quarantine_swept(entries: DataFrame, most: int = budget.QUARANTINE_BYTES) -> DataFrame:
    """(path, bytes, mtime) of quarantined entries to delete, oldest first, until the rest fits in ``most`` bytes."""
    return evicted(entries.where(F.col("path").contains("/quarantine/")), most)


def stray(entries: DataFrame, now: int, age: int = budget.STRAY_SECONDS) -> DataFrame:
    return entries.where(F.col("path").endswith(".tmp") & (F.col("mtime") < now - age))


def cypher_nodes(symbols: DataFrame) -> DataFrame:
    q = cypher_quoted
    return symbols.select(F.concat(F.lit("CREATE (:Symbol {id: "), q(F.col("id")), F.lit(", name: "), q(F.col("name")), F.lit(", kind: "), q(F.col("kind")), F.lit(", path: "), q(F.col("path")), F.lit("});")).alias("value"))


def cypher_edges(edges: DataFrame) -> DataFrame:
    q = cypher_quoted
    return edges.select(F.concat(F.lit("MATCH (a:Symbol {id: "), q(F.col("src")), F.lit("}), (b:Symbol {id: "), q(F.col("dst")), F.lit("}) CREATE (a)-[:REFERENCES]->(b);")).alias("value"))


def export_cypher(symbols: DataFrame, edges: DataFrame, folder: str) -> None:
    """Nodes, then edges, as two folders of statements."""
    cypher_nodes(symbols).write.text(f"{folder}/1-nodes")
    cypher_edges(edges).write.text(f"{folder}/2-edges")


def missing_labels(schema: DataFrame, exported: DataFrame, built: Column) -> DataFrame:
    """(label, reason) of declared labels that an export does not hold: not_built or not_stored."""
    return schema.join(exported.select("label").distinct(), "label", "left_anti").select("label", F.when(built, "not_stored").otherwise("not_built").alias("reason"))


INTENT_VERSION = 2


def intent_export(bindings: DataFrame, aliases: DataFrame) -> DataFrame:
    """JSON lines (value): a header, then records with their kind."""
    head = bindings.sparkSession.range(1).select(F.to_json(F.struct(F.lit("header").alias("record"), F.lit(INTENT_VERSION).alias("schema_version"))).alias("value"))
    lines = lambda df, kind: df.select(F.to_json(F.struct(F.lit(kind).alias("record"), *df.columns)).alias("value"))
    return head.unionByName(lines(bindings, "binding")).unionByName(lines(aliases, "alias"))


def intent_import(lines: DataFrame, bindings: DataFrame) -> tuple[DataFrame, int]:
    """Bindings after an additive import (the line's record wins) and how many were there already; versions 1 and 2.

    Version 1 lacks radius and times: it watches the symbol, at no recorded time.
    """
    head = lines.where(F.get_json_object("value", "$.record") == "header").select(F.get_json_object("value", "$.schema_version").cast("int").alias("v")).first()
    if head is None or head["v"] not in (1, 2):
        raise ValueError("no header of a known schema version")
    schema = bindings.schema.simpleString()
    new = lines.where(F.get_json_object("value", "$.record") == "binding").select(F.from_json("value", schema).alias("b")).select("b.*")
    if head["v"] == 1 and "radius" in new.columns:
        new = new.withColumn("radius", F.coalesce("radius", F.lit("symbol")))
    new = new.dropDuplicates(["id"])
    already = new.join(bindings.select("id"), "id", "left_semi").count()
    return bindings.join(new.select("id"), "id", "left_anti").unionByName(new), already


def alias_recorded(aliases: DataFrame, was: str, now: str) -> DataFrame:
    """``aliases`` (was, now) with one more; a later record of the same name replaces the earlier. Nothing is deleted."""
    if was == now:
        raise ValueError("a repository is no alias of itself")
    new = aliases.sparkSession.range(1).select(F.lit(was).alias("was"), F.lit(now).alias("now"))
    return aliases.join(new.select("was"), "was", "left_anti").select("was", "now").unionByName(new)


def alias_of(aliases: DataFrame, repo: str) -> str:
    """Where a renamed repository lives now; a cycle ends where it began to repeat."""
    seen = {repo}
    while row := aliases.where(F.col("was") == repo).select("now").first():
        if row["now"] in seen:
            break
        repo = row["now"]
        seen.add(repo)
    return repo
