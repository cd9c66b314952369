"""A code graph made from the star-schema tables: customers are files, orders symbols, line items bodies.

``SQL`` holds the same definitions for DuckDB, as common tables that every oracle begins with.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids

REPO = "warehouse"
EXTENSIONS = ("ts", "kt", "rs", "java", "md", "sql", "xyz")
LANGUAGES = ("TypeScript", "Kotlin", "Rust", "Java", "Markdown", "SQL", None)
#: Extraction grade of each: 2 with scopes, 1 declarations only, 0 no extractor.
GRADES = (2, 1, 1, 0, 0, 0, 0)
#: Line items shipped before this day are what the base snapshot has seen.
BASE_DAY = "1999-01-01"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _by(column, values):
    at = reduce(lambda a, i: a.when(column % len(values) == i, F.lit(values[i])), range(1, len(values)), F.when(column % len(values) == 0, F.lit(values[0])))
    return at


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, blob, language, grade, bucket, refs_built, unresolved; one row per file."""
    key = F.col("c_custkey")
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_name")
    c = c.withColumn("language", _by(key, LANGUAGES)).withColumn("grade", _by(key, GRADES))
    bucket = F.when(F.col("language").isNull(), "unrecognized").when(F.col("grade") == 0, "unsupported").when(key % 11 == 0, "partial").otherwise("parsed")
    return c.select(
        F.concat(F.lit("seg/"), "c_mktsegment", F.lit("/"), key.cast("string"), F.lit("."), _by(key, EXTENSIONS)).alias("path"),
        F.sha2("c_name", 256).alias("blob"),
        "language",
        "grade",
        bucket.alias("bucket"),
        (F.col("grade") == 2).alias("refs_built"),
        (key % 5).alias("unresolved"),
        key.alias("file_key"),
    )


def _bodies(spark: SparkSession, sf_dir: str, before: str | None) -> DataFrame:
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")
    if before:
        items = items.where(F.col("l_shipdate") < F.lit(before).cast("timestamp"))
    item = F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("q"))
    lines = F.transform(F.array_sort(F.collect_list(item)), lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["q"].cast("string")))
    return items.groupBy("l_orderkey").agg(F.sha2(F.array_join(lines, "~"), 256).alias("body"))


def symbols(spark: SparkSession, sf_dir: str, snapshot: str = "head") -> DataFrame:
    """id, path, container, name, kind, ordinal, body, byte_start, byte_end, ix of one snapshot.

    Groups of four orders of a customer share a container: the first is the root, the others lie in it.
    """
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    f = files(spark, sf_dir).select("path", "file_key", "language", "bucket", "grade")
    ix = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = orders.withColumn("ix", ix).join(f, F.col("o_custkey") == F.col("file_key"))
    name = F.concat(F.lit("o"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") % 97).otherwise(F.col("o_orderkey")).cast("string"))
    rows = rows.withColumn("name", name).withColumn("group", F.floor((F.col("ix") - 1) / 4))
    root = F.first(F.struct("name", "o_orderpriority")).over(Window.partitionBy("o_custkey", "group").orderBy("ix").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("root", root)
    container = F.when(F.col("ix") % 4 == 1, F.array("o_orderpriority")).otherwise(F.array("root.o_orderpriority", "root.name"))
    kind = F.when(F.col("o_orderstatus") == "F", "function").when(F.col("o_orderstatus") == "O", "class").otherwise("method")
    rows = rows.withColumn("container", container).withColumn("kind", kind)
    rows = rows.withColumn("ordinal", ids.ordinal())
    rows = rows.where(F.col("o_orderkey") % 17 != 0) if snapshot == "head" else rows.where(F.col("o_orderkey") % 13 != 0)
    bodies = _bodies(spark, sf_dir, None if snapshot == "head" else BASE_DAY)
    rows = rows.join(bodies, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.select(
        ids.symbol_id(F.lit(REPO), F.col("path"), F.col("container"), F.col("name"), F.col("kind"), F.col("ordinal")).alias("id"),
        "path", "container", "name", "kind", F.col("ordinal").cast("long").alias("ordinal"),
        F.coalesce("body", F.sha2(F.lit(""), 256)).alias("body"),
        (F.col("ix") * 100).cast("long").alias("byte_start"), (F.col("ix") * 100 + 80).cast("long").alias("byte_end"),
        F.col("ix").cast("long").alias("ix"), F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("file_key"), "language", "bucket", "grade",
    )


def edges(symbols: DataFrame) -> DataFrame:
    """(src, dst), distinct, within a file: each symbol to the one before, even ones to the first, every tenth to itself."""
    s = symbols.select("file_key", "ix", "id")
    order = Window.partitionBy("file_key").orderBy("ix")
    s = s.withColumn("before", F.lag("id").over(order)).withColumn("first", F.first("id").over(order))
    to = F.array_distinct(F.array_compact(F.array("before", F.when(F.col("ix") % 2 == 0, F.col("first")), F.when(F.col("ix") % 10 == 0, F.col("id")))))
    return s.select(F.col("id").alias("src"), F.explode(to).alias("dst"))


def bindings(base: DataFrame, base_edges: DataFrame) -> DataFrame:
    """id, target, note, radius, k, watch (array of symbol and digest): urgent roots, by key % 3 symbol, callers or closure."""
    from ..operators.traverse import expand_radius

    t = base.where(F.element_at("container", 1) == "1-URGENT").select(F.col("id").alias("target"), F.concat(F.lit("n"), F.col("key").cast("string")).alias("note"), "key")
    radius = F.when(F.col("key") % 3 == 0, "symbol").when(F.col("key") % 3 == 1, "callers").otherwise("closure")
    t = t.select(ids.binding_id(F.col("target"), F.col("note")).alias("id"), "target", "note", radius.alias("radius"), F.when(F.col("key") % 3 == 2, 2).alias("k"), "key")
    watch = expand_radius(t.select("id", "target", "radius", "k"), base_edges).join(base.select(F.col("id").alias("symbol"), F.col("body").alias("digest")), "symbol")
    return t.join(watch.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("symbol", "digest"))).alias("watch")), "id")


_CASE = lambda values, show: "CASE c_custkey % 7 " + " ".join(f"WHEN {i} THEN {show(v)}" for i, v in enumerate(values)) + " END"
_TEXT = lambda v: "NULL" if v is None else f"'{v}'"
_US = "chr(31)"


def _symbols_sql(snapshot: str) -> str:
    gone, before = ("o_orderkey % 17 <> 0", "") if snapshot == "head" else ("o_orderkey % 13 <> 0", f" WHERE l_shipdate < TIMESTAMP '{BASE_DAY}'")
    return f"""
bodies_{snapshot} AS (SELECT l_orderkey, sha256(string_agg(l_linenumber || ':' || l_quantity::INT, '~' ORDER BY l_linenumber, l_quantity::INT)) AS body FROM lineitem{before} GROUP BY l_orderkey),
symbols_{snapshot} AS (
  SELECT sha256(concat_ws({_US}, 'symbol', '{REPO}', path, array_to_string(container, '.'), name, kind, ordinal::VARCHAR)) AS id,
    path, container, name, kind, ordinal, coalesce(body, sha256('')) AS body, ix * 100 AS byte_start, ix * 100 + 80 AS byte_end, ix, o_orderkey AS key, o_custkey AS file_key, language, bucket, grade
  FROM numbered LEFT JOIN bodies_{snapshot} ON o_orderkey = l_orderkey WHERE {gone}),
edges_{snapshot} AS (
  SELECT DISTINCT src, dst FROM (
    SELECT id AS src, unnest([lag(id) OVER w, CASE WHEN ix % 2 = 0 THEN first_value(id) OVER w END, CASE WHEN ix % 10 = 0 THEN id END]) AS dst
    FROM symbols_{snapshot} WINDOW w AS (PARTITION BY file_key ORDER BY ix)) WHERE dst IS NOT NULL)"""


SQL = f"""
files AS (
  SELECT 'seg/' || c_mktsegment || '/' || c_custkey || '.' || {_CASE(EXTENSIONS, _TEXT)} AS path, sha256(c_name) AS blob, {_CASE(LANGUAGES, _TEXT)} AS language, {_CASE(GRADES, str)} AS grade,
    CASE WHEN c_custkey % 7 = 6 THEN 'unrecognized' WHEN c_custkey % 7 >= 3 THEN 'unsupported' WHEN c_custkey % 11 = 0 THEN 'partial' ELSE 'parsed' END AS bucket,
    c_custkey % 7 = 0 AS refs_built, c_custkey % 5 AS unresolved, c_custkey AS file_key FROM customer),
placed AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ix,
  'o' || CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 97 ELSE o_orderkey END AS name FROM orders),
rooted AS (SELECT placed.*, path, language, bucket, grade, first_value(name) OVER w AS root_name, first_value(o_orderpriority) OVER w AS root_priority,
  CASE o_orderstatus WHEN 'F' THEN 'function' WHEN 'O' THEN 'class' ELSE 'method' END AS kind
  FROM placed JOIN files ON o_custkey = file_key WINDOW w AS (PARTITION BY o_custkey, (ix - 1) // 4 ORDER BY ix)),
contained AS (SELECT *, CASE WHEN ix % 4 = 1 THEN [o_orderpriority] ELSE [root_priority, root_name] END AS container FROM rooted),
numbered AS (SELECT *, row_number() OVER (PARTITION BY path, container, name, kind ORDER BY ix) - 1 AS ordinal FROM contained),{_symbols_sql("head")},{_symbols_sql("base")},
bound AS (SELECT substr(sha256(concat_ws({_US}, 'binding', id, 'n' || key)), 1, 16) AS id, id AS target, 'n' || key AS note,
  CASE key % 3 WHEN 0 THEN 'symbol' WHEN 1 THEN 'callers' ELSE 'closure' END AS radius, key FROM symbols_base WHERE container[1] = '1-URGENT'),
hop1 AS (SELECT b.id, e.src AS symbol FROM bound b JOIN edges_base e ON e.dst = b.target WHERE radius <> 'symbol'),
hop2 AS (SELECT h.id, e.src AS symbol FROM hop1 h JOIN bound b ON h.id = b.id AND radius = 'closure' JOIN edges_base e ON e.dst = h.symbol),
watch AS (SELECT DISTINCT w.id, w.symbol, s.body AS digest FROM (SELECT id, target AS symbol FROM bound UNION SELECT * FROM hop1 UNION SELECT * FROM hop2) w JOIN symbols_base s ON s.id = w.symbol)"""
