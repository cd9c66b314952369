"""Queries over the adapted tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids, names
from ..operators import bindings as B
from ..operators import budget, defect, deviation, doctor, lookup, narrative, traverse
from ..sources import adapter as A
from ..sources import projection, recognize, scanners, store
from ..sources.tables import kept, written

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, tables: str = ""):
    """Register a query under its function's name; ``sql`` follows the adapter's common tables (and ``tables``)."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH RECURSIVE {A.SQL}{',' if tables else ''}{tables}\n{sql}"
        return f

    return add


def _symbols(spark: SparkSession, sf_dir: str, snapshot: str = "head") -> DataFrame:
    """The snapshot's symbols: a projection, built once and then read by every query."""
    return kept(spark, (sf_dir, snapshot, "symbols"), lambda: A.symbols(spark, sf_dir, snapshot))


def _graph(spark: SparkSession, sf_dir: str, snapshot: str = "head") -> tuple[DataFrame, DataFrame]:
    symbols = _symbols(spark, sf_dir, snapshot)
    return symbols, kept(spark, (sf_dir, snapshot, "edges"), lambda: A.edges(symbols))


#: Names asked for: every name there is (some ambiguous), and three that don't exist.
_MISSING = ("O_11", "o-1-3", "nothing")
_ASKED = f"asked AS (SELECT DISTINCT name AS asked FROM symbols_head UNION SELECT unnest({list(_MISSING)}))"


def _asked(symbols: DataFrame) -> DataFrame:
    more = symbols.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, _MISSING))).alias("asked"))
    return symbols.select(F.col("name").alias("asked")).unionByName(more).distinct()


@query("""SELECT count(*) AS files_total, count(*) FILTER (bucket = 'parsed') AS parsed, count(*) FILTER (bucket = 'partial') AS partial,
  count(*) FILTER (bucket = 'unsupported') AS unsupported, count(*) FILTER (bucket = 'unrecognized') AS unrecognized,
  count(DISTINCT language) FILTER (grade = 0) AS unbindable_languages FROM files""")
def ledger_snapshot(spark, sf_dir):
    return lookup.ledger(A.files(spark, sf_dir))


@query("""SELECT b AS bucket, (SELECT count(*) FROM files WHERE bucket = b) AS n
  FROM (SELECT unnest(['parsed', 'partial', 'unsupported', 'unrecognized', 'excluded', 'generated', 'binary']) AS b)""")
def ledger_buckets(spark, sf_dir):
    return lookup.bucket_counts(A.files(spark, sf_dir))


@query("""SELECT language, count(*) AS n, max(grade)::INTEGER AS grade, CASE max(grade) WHEN 0 THEN 'unavailable' WHEN 1 THEN 'ordinal' ELSE 'exact' END AS identity
  FROM files WHERE bucket IN ('parsed', 'partial', 'unsupported') GROUP BY language""")
def ledger_capabilities(spark, sf_dir):
    return lookup.language_capabilities(A.files(spark, sf_dir))


@query("SELECT asked, row_number() OVER (PARTITION BY asked ORDER BY path, byte_start, id) AS place, id, path, kind, byte_start FROM asked JOIN symbols_head ON asked = name", _ASKED)
def symbol_resolve(spark, sf_dir):
    symbols = _symbols(spark, sf_dir)
    return lookup.resolve(_asked(symbols), symbols).select("asked", "place", "id", "path", "kind", "byte_start")


@query("""SELECT asked, coalesce(n, 0) AS n, CASE coalesce(n, 0) WHEN 0 THEN 'unknown' WHEN 1 THEN 'found' ELSE 'ambiguous' END AS outcome, CASE WHEN n = 1 THEN id END AS id
  FROM asked LEFT JOIN (SELECT name, count(*) AS n, min(id) AS id FROM symbols_head GROUP BY name) ON asked = name""", _ASKED)
def symbol_outcome(spark, sf_dir):
    symbols = _symbols(spark, sf_dir)
    return lookup.outcomes(_asked(symbols), symbols)


@query("""SELECT r.id AS start, row_number() OVER (PARTITION BY r.id ORDER BY s.byte_start, s.id) AS place, s.id FROM symbols_head r JOIN symbols_head s ON r.path = s.path AND r.id <> s.id
  AND s.container[1:len(r.container) + 1] = list_append(r.container, r.name)""")
def symbol_contains(spark, sf_dir):
    symbols = _symbols(spark, sf_dir)
    return lookup.contains(symbols.select(F.col("id").alias("start")), symbols)


@query("SELECT dst AS start, row_number() OVER (PARTITION BY dst ORDER BY path, byte_start, id) AS place, id FROM edges_head JOIN symbols_head ON src = id")
def symbol_callers(spark, sf_dir):
    symbols, edges = _graph(spark, sf_dir)
    return lookup.callers(edges.select(F.col("dst").alias("start")), edges, symbols)


@query("SELECT src AS start, count(*) AS callees FROM edges_head GROUP BY src")
def symbol_callees(spark, sf_dir):
    return _graph(spark, sf_dir)[1].groupBy(F.col("src").alias("start")).agg(F.count("*").alias("callees"))


#: The search from every symbol; the files are smaller than the budget of nodes, so only the depth cuts.
_FORWARD = """reach AS (
  SELECT id AS start, id AS node, 0 AS depth FROM symbols_head UNION SELECT r.start, dst, depth + 1 FROM reach r JOIN edges_head ON node = src WHERE depth < 3)"""


def _every_start(symbols: DataFrame) -> DataFrame:
    return symbols.select(F.col("id").alias("start"))


@query("SELECT start, node, min(depth)::INTEGER AS depth FROM reach GROUP BY start, node", _FORWARD)
def symbol_reaches(spark, sf_dir):
    symbols, edges = _graph(spark, sf_dir)
    return traverse.reaches(_every_start(symbols), edges)[0].select("start", "node", "depth")


@query(
    """SELECT start, 'depth' AS reason, count(*) AS count FROM (
  SELECT DISTINCT r.start, r.node, e.dst FROM (SELECT start, node FROM reach GROUP BY start, node HAVING min(depth) = 3) r JOIN edges_head e ON r.node = e.src
  WHERE NOT EXISTS (SELECT 1 FROM reach x WHERE x.start = r.start AND x.node = e.dst)) GROUP BY start""",
    _FORWARD,
)
def symbol_reaches_cut(spark, sf_dir):
    symbols, edges = _graph(spark, sf_dir)
    return traverse.reaches(_every_start(symbols), edges)[1]


@query("SELECT id, path, name, kind, body, byte_start FROM symbols_head")
def graph_nodes(spark, sf_dir):
    return _symbols(spark, sf_dir).select("id", "path", "name", "kind", "body", "byte_start")


@query("""SELECT s.id, arg_min(p.id, p.byte_start) AS parent FROM symbols_head s JOIN symbols_head p ON p.path = s.path AND list_append(p.container, p.name) = s.container GROUP BY s.id""")
def symbol_parents(spark, sf_dir):
    return lookup.parents(_symbols(spark, sf_dir))


@query("SELECT src, dst FROM edges_head")
def graph_edges(spark, sf_dir):
    return _graph(spark, sf_dir)[1]


#: Asked are all names in another spelling, most of which no symbol has, and two short texts that many names hold.
_NEAR = """want AS (SELECT DISTINCT 'O_' || name[2:] AS asked FROM symbols_head UNION SELECT unnest(['O5', 'x', 'o'])),
have AS (SELECT DISTINCT name FROM symbols_head),
wl AS (SELECT DISTINCT len(asked) AS n FROM want), hl AS (SELECT DISTINCT len(name) AS n FROM have),
hit AS (
  SELECT asked, name, 1 AS k FROM (SELECT DISTINCT name, lower(name)[i:i + n - 1] AS part FROM have, wl, range(1, 20) r(i) WHERE i + n - 1 <= len(name)) JOIN want ON lower(asked) = part
  UNION ALL SELECT asked, name, 1 FROM (SELECT DISTINCT asked, lower(asked)[i:i + n - 1] AS part FROM want, hl, range(1, 20) r(i) WHERE i + n - 1 <= len(asked)) JOIN have ON lower(name) = part
  UNION ALL SELECT asked, name, 0 FROM want JOIN have ON replace(replace(lower(asked), '_', ''), '-', '') = replace(replace(lower(name), '_', ''), '-', '')),
f AS (SELECT asked, name, min(k) AS k FROM hit WHERE asked <> name GROUP BY asked, name),
n AS (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY k, name) AS place, count(*) OVER (PARTITION BY asked) AS c FROM f)"""


@query("SELECT asked, CASE k WHEN 0 THEN 'spelling' ELSE 'substring' END AS kind, name, place, greatest(c - 10, 0) AS beyond FROM n WHERE place <= 10", _NEAR)
def symbol_near_names(spark, sf_dir):
    symbols = _symbols(spark, sf_dir)
    more = spark.range(1).select(F.explode(F.array(*map(F.lit, ("O5", "x", "o")))).alias("asked"))
    asked = symbols.select(F.concat(F.lit("O_"), F.substring("name", 2, 1000)).alias("asked")).unionByName(more)
    return lookup.near_names(asked, symbols)


@query("""SELECT coalesce(min(CASE WHEN ordinal = 0 THEN 2 ELSE 1 END), 1)::INTEGER AS identity,
  (SELECT coalesce(sum(unresolved), 0)::BIGINT FROM files WHERE refs_built AND path IN (SELECT path FROM symbols_head)) AS unresolved,
  (SELECT coalesce(min(grade), 0)::INTEGER FROM files WHERE path IN (SELECT path FROM symbols_head)) AS grade, count(*) AS accessed FROM symbols_head""")
def symbol_coverage(spark, sf_dir):
    symbols = _symbols(spark, sf_dir)
    return lookup.coverage(symbols.select("id"), symbols, A.files(spark, sf_dir))


_STATUS = """e AS (SELECT w.id, b.target, w.symbol, CASE WHEN s.id IS NULL THEN 'gone' WHEN s.grade = 0 THEN 'identity_grade' WHEN s.bucket = 'partial' THEN 'partial_parse' WHEN s.body <> w.digest THEN 'changed' END AS event
  FROM watch w JOIN bound b ON w.id = b.id LEFT JOIN symbols_head s ON s.id = w.symbol),
st AS (SELECT id, target, CASE WHEN bool_or(event = 'gone' AND symbol = target) THEN 'orphaned' WHEN bool_or(event IN ('identity_grade', 'partial_parse', 'gone')) THEN 'undeterminable'
    WHEN bool_or(event = 'changed') THEN 'stale' ELSE 'live' END AS code,
    CASE WHEN bool_or(event = 'gone' AND symbol = target) THEN 'gone' WHEN bool_or(event = 'identity_grade') THEN 'identity_grade' WHEN bool_or(event = 'partial_parse') THEN 'partial_parse'
    WHEN bool_or(event = 'gone') THEN 'gone' ELSE 'changed' END AS told FROM e GROUP BY id, target)"""


def _bound(spark, sf_dir) -> DataFrame:
    base, edges = _graph(spark, sf_dir, "base")
    return kept(spark, (sf_dir, "bindings"), lambda: A.bindings(base, edges))


@query("""SELECT st.id, st.target, code, CASE WHEN code = 'undeterminable' THEN CASE told WHEN 'gone' THEN 'watch_member_gone' ELSE told END END AS reason,
  coalesce(string_agg(symbol, ',' ORDER BY symbol) FILTER (event = told), '') AS ids, count(*) AS watched FROM st JOIN e ON st.id = e.id GROUP BY st.id, st.target, code, told""", _STATUS)
def binding_status(spark, sf_dir):
    bound = _bound(spark, sf_dir)
    out = B.status(bound, _symbols(spark, sf_dir)).join(bound.select("id", F.size("watch").cast("long").alias("watched")), "id")
    return out.select("id", "target", "code", "reason", F.array_join("ids", ",").alias("ids"), "watched")


@query("SELECT code, count(*) AS n FROM st GROUP BY code", _STATUS)
def binding_status_counts(spark, sf_dir):
    return B.status(_bound(spark, sf_dir), _symbols(spark, sf_dir)).groupBy("code").agg(F.count("*").alias("n"))


@query("""SELECT st.id, st.target, st.code, 'current' AS lineage, b.radius, count(*) AS watched,
  coalesce((SELECT string_agg(i || ':' || n, ',' ORDER BY i) FROM (SELECT CASE WHEN s.grade = 0 THEN 'unavailable' WHEN s.grade = 1 OR s.ordinal > 0 THEN 'ordinal' ELSE 'exact' END AS i, count(*) AS n
    FROM watch x JOIN symbols_head s ON s.id = x.symbol WHERE x.id = st.id GROUP BY i)), '') AS grades
  FROM st JOIN bound b ON st.id = b.id JOIN watch w ON w.id = st.id GROUP BY st.id, st.target, st.code, b.radius""", _STATUS)
def binding_reports(spark, sf_dir):
    bound, symbols = _bound(spark, sf_dir), _symbols(spark, sf_dir)
    grades = F.transform(F.array_sort(F.map_entries("grades")), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))
    out = B.reports(bound, symbols, B.status(bound, symbols))
    return out.select("id", "target", "code", "lineage", "radius", "watched", F.array_join(grades, ",").alias("grades"))


@query("SELECT DISTINCT id FROM watch WHERE symbol IN (SELECT coalesce(b.id, h.id) FROM symbols_base b FULL JOIN symbols_head h ON b.id = h.id WHERE b.id IS NULL OR h.id IS NULL OR b.body <> h.body)")
def binding_affected(spark, sf_dir):
    """The bindings that the change between the snapshots can have made stale."""
    delta = deviation.symbol_delta(_symbols(spark, sf_dir, "base"), _symbols(spark, sf_dir))
    return B.watching_any(delta.select(F.col("id").alias("symbol")), _bound(spark, sf_dir)).select("id")


_TOUCH = _STATUS + """,
items AS (SELECT target AS start, id, 'on' AS how FROM bound UNION ALL SELECT w.symbol, w.id, 'watching' FROM watch w JOIN bound b ON w.id = b.id AND w.symbol <> b.target),
ranked AS (SELECT i.*, code, row_number() OVER (PARTITION BY start ORDER BY CASE code WHEN 'stale' THEN 0 WHEN 'orphaned' THEN 0 WHEN 'undeterminable' THEN 1 ELSE 3 END, i.id) AS place,
  count(*) FILTER (code <> 'live') OVER (PARTITION BY start) AS urgent, count(*) OVER (PARTITION BY start) AS c FROM items i JOIN st ON i.id = st.id WHERE start IN (SELECT id FROM symbols_head))"""


@query("SELECT start, id, how, code, place FROM ranked WHERE place <= greatest(10, urgent)", _TOUCH)
def binding_touch(spark, sf_dir):
    bound, (symbols, edges) = _bound(spark, sf_dir), _graph(spark, sf_dir)
    return B.touch(symbols.select(F.col("id").alias("start")), bound, B.status(bound, symbols), edges)[0]


@query("""SELECT r.start, r.id, CASE WHEN b.target = r.start THEN 'here' WHEN s.id IS NULL THEN 'gone' ELSE 'known' END AS "at", CASE WHEN b.target <> r.start THEN s.path END AS path,
  CASE WHEN b.target <> r.start THEN array_to_string(s.container, '.') END AS container, CASE WHEN b.target <> r.start THEN s.name END AS name
  FROM ranked r JOIN bound b ON r.id = b.id LEFT JOIN symbols_head s ON s.id = b.target WHERE place <= greatest(10, urgent)""", _TOUCH)
def binding_places(spark, sf_dir):
    bound, (symbols, edges) = _bound(spark, sf_dir), _graph(spark, sf_dir)
    recall = B.touch(symbols.select(F.col("id").alias("start")), bound, B.status(bound, symbols), edges)[0]
    return B.places(recall, bound, symbols).select("start", "id", "at", "path", F.array_join("container", ".").alias("container"), "name")


@query("""SELECT s.id AS start, (SELECT count(*) FROM edges_head WHERE dst = s.id) AS callers, (SELECT count(*) FROM edges_head WHERE src = s.id) AS callees,
  coalesce(r.o, 0) AS "on", coalesce(r.w, 0) AS watching, coalesce(greatest(r.c - greatest(10, r.urgent), 0), 0) AS beyond
  FROM symbols_head s LEFT JOIN (SELECT start, count(*) FILTER (how = 'on') AS o, count(*) FILTER (how = 'watching') AS w, max(c) AS c, max(urgent) AS urgent FROM ranked GROUP BY start) r ON s.id = r.start""", _TOUCH)
def binding_touch_facts(spark, sf_dir):
    bound, (symbols, edges) = _bound(spark, sf_dir), _graph(spark, sf_dir)
    return B.touch(symbols.select(F.col("id").alias("start")), bound, B.status(bound, symbols), edges)[1]


@query("""SELECT b.id, b.target, n.id AS candidate, (1 + (n.name = o.name)::INT + (n.container = o.container)::INT)::INTEGER AS strength
  FROM bound b JOIN symbols_base o ON o.id = b.target JOIN symbols_head n ON n.body = o.body WHERE b.target NOT IN (SELECT id FROM symbols_head) AND o.body <> sha256('')""")
def binding_rebind(spark, sf_dir):
    base = _symbols(spark, sf_dir, "base").where(F.col("body") != F.sha2(F.lit(""), 256))
    return B.propose(_bound(spark, sf_dir), base, _symbols(spark, sf_dir))


@query("""SELECT coalesce(b.id, h.id) AS id, CASE WHEN b.id IS NULL THEN 'added' WHEN h.id IS NULL THEN 'removed' ELSE 'changed' END AS change
  FROM symbols_base b FULL JOIN symbols_head h ON b.id = h.id WHERE b.id IS NULL OR h.id IS NULL OR b.body <> h.body""")
def plan_symbol_delta(spark, sf_dir):
    return deviation.symbol_delta(_symbols(spark, sf_dir, "base"), _symbols(spark, sf_dir))


@query("""SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted' ELSE 'changed' END AS change
  FROM (SELECT path, blob FROM files WHERE file_key % 5 <> 0) a FULL JOIN (SELECT path, CASE WHEN file_key % 4 = 0 THEN sha256(blob) ELSE blob END AS blob FROM files WHERE file_key % 6 <> 0) b ON a.path = b.path
  WHERE a.path IS NULL OR b.path IS NULL OR a.blob <> b.blob""")
def tree_differing_paths(spark, sf_dir):
    f = A.files(spark, sf_dir)
    return deviation.differing_paths(f.where("file_key % 5 <> 0"), f.where("file_key % 6 <> 0").withColumn("blob", F.when(F.col("file_key") % 4 == 0, F.sha2("blob", 256)).otherwise(F.col("blob"))))


#: Plans are items made from file keys: each asks for a name, some for a new name, some for the file's path.
_PATTERNS = """pat AS (
  SELECT 'i' || file_key AS item, 'symbol' AS kind, 'o' || file_key AS text, 'span' AS source FROM files WHERE file_key % 9 = 0
  UNION ALL SELECT 'i' || file_key, 'new_symbol', 'o' || (file_key * 13), 'declared' FROM files WHERE file_key % 9 < 2
  UNION ALL SELECT 'i' || file_key, 'paths', path, 'path' FROM files WHERE file_key % 8 = 0
  UNION ALL SELECT 'wide', 'paths', 'seg/**', 'path')"""


def _patterns(spark, sf_dir) -> DataFrame:
    f, key = A.files(spark, sf_dir), F.col("file_key")
    item = F.concat(F.lit("i"), key.cast("string")).alias("item")
    row = lambda df, kind, text, source: df.select(item, F.lit(kind).alias("kind"), text.alias("text"), F.lit(source).alias("source"))
    out = row(f.where("file_key % 9 = 0"), "symbol", F.concat(F.lit("o"), key.cast("string")), "span")
    out = out.unionByName(row(f.where("file_key % 9 < 2"), "new_symbol", F.concat(F.lit("o"), (key * 13).cast("string")), "declared"))
    out = out.unionByName(row(f.where("file_key % 8 = 0"), "paths", F.col("path"), "path"))
    return out.unionByName(spark.range(1).select(F.lit("wide").alias("item"), F.lit("paths").alias("kind"), F.lit("seg/**").alias("text"), F.lit("path").alias("source")))


def _resolved_sql(at: str) -> str:
    return f"""res_{at} AS (
  SELECT item, kind, text, source, CASE WHEN n = 1 THEN 'bound' WHEN n = 0 AND kind = 'new_symbol' THEN 'pending' ELSE 'unresolved' END AS state,
    CASE WHEN n = 1 THEN NULL WHEN n > 1 THEN 'many' WHEN kind = 'new_symbol' THEN 'declared_new' ELSE 'not_at_baseline' END AS why, CASE WHEN n = 1 THEN ids ELSE [] END AS targets
  FROM (SELECT p.*, count(s.id) AS n, list_sort(list(s.id) FILTER (s.id IS NOT NULL)) AS ids FROM pat p LEFT JOIN symbols_{at} s ON s.name = p.text WHERE p.kind <> 'paths' GROUP BY p.item, p.kind, p.text, p.source)
  UNION ALL SELECT p.item, p.kind, p.text, p.source, CASE WHEN p.item = 'wide' THEN CASE WHEN (SELECT count(*) FROM files) > 32 THEN 'unresolved' ELSE 'bound' END WHEN count(s.id) > 0 THEN 'bound' ELSE 'unresolved' END,
    CASE WHEN p.item = 'wide' THEN 'pattern_too_broad' WHEN count(s.id) = 0 THEN 'not_at_baseline' END,
    CASE WHEN p.item = 'wide' OR count(s.id) = 0 THEN [] ELSE list_sort(list(s.id)) END
  FROM pat p LEFT JOIN symbols_{at} s ON s.path = p.text WHERE p.kind = 'paths' GROUP BY p.item, p.kind, p.text, p.source)"""


_DEVIATION = f"""{_PATTERNS}, {_resolved_sql('base')}, {_resolved_sql('head')},
delta AS (SELECT coalesce(b.id, h.id) AS id FROM symbols_base b FULL JOIN symbols_head h ON b.id = h.id WHERE b.id IS NULL OR h.id IS NULL OR b.body <> h.body),
expected AS (SELECT DISTINCT item, coord FROM (SELECT item, unnest(targets) AS coord FROM res_base
  UNION ALL SELECT h.item, unnest(h.targets) FROM res_head h JOIN res_base b ON (b.item, b.kind, b.text, b.source) = (h.item, h.kind, h.text, h.source) AND b.state = 'pending')),
hit AS (SELECT * FROM expected WHERE coord IN (SELECT id FROM delta)),
srcs AS (SELECT item, coord, arg_max(source, turn || text) AS detail FROM (SELECT item, '0' AS turn, text, source, unnest(targets) AS coord FROM res_base
  UNION ALL SELECT item, '1', text, source, unnest(targets) FROM res_head) GROUP BY item, coord),
items AS (SELECT item, min(CASE WHEN state = 'unresolved' THEN CASE why WHEN 'not_at_baseline' THEN 1 WHEN 'many' THEN 2 ELSE 3 END END) AS w FROM res_base GROUP BY item),
dev AS (
  SELECT 'as_planned' AS class, h.item, h.coord, s.detail FROM hit h JOIN srcs s ON h.item = s.item AND h.coord = s.coord
  UNION ALL SELECT 'unplanned', NULL, id, NULL FROM delta WHERE id NOT IN (SELECT coord FROM expected)
  UNION ALL SELECT CASE WHEN i.item NOT IN (SELECT item FROM expected) AND i.item NOT IN (SELECT item FROM res_head WHERE state = 'pending') THEN 'unmeasurable' ELSE 'unimplemented' END, i.item, NULL,
    CASE WHEN i.item NOT IN (SELECT item FROM expected) AND i.item NOT IN (SELECT item FROM res_head WHERE state = 'pending') THEN CASE coalesce(w, 1) WHEN 1 THEN 'not_at_baseline' WHEN 2 THEN 'many' ELSE 'pattern_too_broad' END END
  FROM items i WHERE i.item NOT IN (SELECT item FROM hit))"""


def _deviation(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    p, f = _patterns(spark, sf_dir), A.files(spark, sf_dir)
    base, head = _symbols(spark, sf_dir, "base"), _symbols(spark, sf_dir)
    delta = deviation.symbol_delta(base, head)
    at_base = written(deviation.resolve_patterns(p, base, f), "resolved")
    return deviation.deviate(at_base, written(deviation.resolve_patterns(p, head, f), "resolved"), delta), delta


@query("SELECT item, kind, text, source, state, why, array_to_string(targets, ',') AS targets FROM res_base", f"{_PATTERNS}, {_resolved_sql('base')}")
def plan_resolution(spark, sf_dir):
    out = deviation.resolve_patterns(_patterns(spark, sf_dir), _symbols(spark, sf_dir, "base"), A.files(spark, sf_dir))
    return out.withColumn("targets", F.array_join("targets", ","))


@query("SELECT class, item, coord, detail FROM dev", _DEVIATION)
def plan_deviation(spark, sf_dir):
    return _deviation(spark, sf_dir)[0]


@query("SELECT c AS class, count(dev.class) AS n, count(DISTINCT item) AS items FROM (SELECT unnest(['as_planned', 'unplanned', 'unimplemented', 'unmeasurable']) AS c) LEFT JOIN dev ON c = dev.class GROUP BY c", _DEVIATION)
def plan_deviation_summary(spark, sf_dir):
    return deviation.summary(_deviation(spark, sf_dir)[0])


@query("SELECT (SELECT count(*) FROM delta) AS changed, count(*) FILTER (class = 'unplanned') AS unplanned, 'defined' AS tag, round(count(*) FILTER (class = 'unplanned') / (SELECT count(*) FROM delta), 6) AS rate FROM dev", _DEVIATION)
def plan_deviation_rate(spark, sf_dir):
    return deviation.rate(*_deviation(spark, sf_dir))


@query("SELECT s AS source, count(dev.class) AS n FROM (SELECT unnest(['declared', 'span', 'path', 'identifier']) AS s) LEFT JOIN dev ON s = detail AND class = 'as_planned' GROUP BY s", _DEVIATION)
def plan_by_source(spark, sf_dir):
    return deviation.by_source(_deviation(spark, sf_dir)[0])


@query("SELECT s AS reason, count(dev.class) AS n FROM (SELECT unnest(['not_at_baseline', 'many', 'pattern_too_broad']) AS s) LEFT JOIN dev ON s = detail AND class = 'unmeasurable' GROUP BY s", _DEVIATION)
def plan_by_reason(spark, sf_dir):
    return deviation.unmeasurable_by_reason(_deviation(spark, sf_dir)[0])


@query("SELECT count(DISTINCT item) FILTER (class <> 'unmeasurable') AS resolved, count(DISTINCT item) AS total FROM dev WHERE item IS NOT NULL", _DEVIATION)
def plan_items_measured(spark, sf_dir):
    return deviation.resolution(_deviation(spark, sf_dir)[0])


#: Fragments are customers' notes: signals by key, so that each kind of find (one, several, none) occurs.
_FRAGMENTS = """frag AS (
  SELECT 'doc/' || (file_key % 10) || '.md' AS path, 'a' || file_key AS anchor, 'note ' || file_key || chr(10) || 'more' AS body,
    CASE WHEN file_key % 6 = 0 THEN [path] ELSE [] END AS grounds, CASE WHEN file_key % 6 = 1 THEN [path] ELSE [] END AS fenced,
    CASE WHEN file_key % 6 IN (2, 3) THEN ['o' || file_key, 'not an id', '1x'] ELSE [] END AS spans, CASE WHEN file_key % 12 = 4 THEN path END AS own FROM files),
att AS (SELECT f.path, f.anchor, 0 AS prio, s.id FROM frag f JOIN symbols_head s ON s.path = f.own AND s.ix = 1),
cand AS (SELECT * FROM att
  UNION SELECT f.path, f.anchor, 1, s.id FROM frag f JOIN symbols_head s ON list_contains(f.grounds, s.path)
  UNION SELECT f.path, f.anchor, 2, s.id FROM frag f JOIN symbols_head s ON list_contains(f.fenced, s.path)
  UNION SELECT f.path, f.anchor, 3, s.id FROM frag f JOIN symbols_head s ON list_contains(f.spans, s.name)),
firsts AS (SELECT path, anchor, min(prio) AS prio FROM cand GROUP BY path, anchor),
res AS (SELECT f.path, f.anchor, CASE WHEN p.prio IS NULL THEN 'unbound' WHEN count(c.id) = 1 AND p.prio < 2 THEN 'bound' ELSE 'candidates' END AS class,
  CASE p.prio WHEN 0 THEN 'attached' WHEN 1 THEN 'frontmatter' WHEN 2 THEN 'fenced_path' WHEN 3 THEN 'span' END AS "by", count(c.id) AS k, coalesce(string_agg(c.id, ',' ORDER BY c.id), '') AS candidates
  FROM frag f LEFT JOIN firsts p ON f.path = p.path AND f.anchor = p.anchor LEFT JOIN cand c ON c.path = p.path AND c.anchor = p.anchor AND c.prio = p.prio GROUP BY f.path, f.anchor, p.prio)"""


def _fragments(spark, sf_dir, symbols: DataFrame) -> DataFrame:
    key, none = F.col("file_key"), F.array().cast("array<string>")
    f = A.files(spark, sf_dir).select("file_key", F.col("path").alias("code"))
    first = symbols.where("ix = 1").select("file_key", F.array("id").alias("own"))
    f = f.join(first, "file_key", "left")
    when = lambda test, value: F.when(test, value).otherwise(none)
    return f.select(
        F.concat(F.lit("doc/"), (key % 10).cast("string"), F.lit(".md")).alias("path"),
        F.concat(F.lit("a"), key.cast("string")).alias("anchor"),
        F.concat(F.lit("note "), key.cast("string"), F.lit("\nmore")).alias("body"),
        when((key % 12 == 4) & F.col("own").isNotNull(), F.col("own")).alias("attached"),
        when(key % 6 == 0, F.array("code")).alias("grounds"),
        when(key % 6 == 1, F.array("code")).alias("fenced_paths"),
        when((key % 6).isin(2, 3), F.array(F.concat(F.lit("o"), key.cast("string")), F.lit("not an id"), F.lit("1x"))).alias("spans"),
    )


def _resolved(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    symbols = _symbols(spark, sf_dir)
    fragments = _fragments(spark, sf_dir, symbols)
    return fragments, narrative.resolve(fragments, symbols)


@query('SELECT path, anchor, class, "by", candidates FROM res', _FRAGMENTS)
def narrative_resolve(spark, sf_dir):
    return _resolved(spark, sf_dir)[1].withColumn("candidates", F.array_join("candidates", ","))


@query("""SELECT path, anchor, split_part(body, chr(10), 1) AS head, (len(grounds) + len(fenced) + len(spans))::INTEGER AS signals_seen FROM frag WHERE (path, anchor) IN (SELECT (path, anchor) FROM res WHERE class = 'unbound')""", _FRAGMENTS)
def narrative_unbound(spark, sf_dir):
    return narrative.unbound_items(*_resolved(spark, sf_dir))


@query("SELECT c AS class, count(res.class) AS n FROM (SELECT unnest(['bound', 'candidates', 'unbound']) AS c) LEFT JOIN res ON c = class GROUP BY c", _FRAGMENTS)
def narrative_counts(spark, sf_dir):
    return narrative.counts(_resolved(spark, sf_dir)[1])


@query("""SELECT "by" AS signal, count(*) AS items, list_sort(list(k))[count(*) // 2 + 1]::INTEGER AS median, max(k)::INTEGER AS max, count(*) FILTER (k <= 3) AS reviewable FROM res WHERE class = 'candidates' GROUP BY "by" """, _FRAGMENTS)
def narrative_spread(spark, sf_dir):
    return narrative.spread(_resolved(spark, sf_dir)[1])


@query('SELECT "by" AS signal, count(*) AS n FROM res WHERE class <> \'unbound\' GROUP BY "by"', _FRAGMENTS)
def narrative_by_signal(spark, sf_dir):
    return narrative.by_signal(_resolved(spark, sf_dir)[1])


#: Commits are the events' days, newest first, and touch the users of the day; every tenth user is a document.
_CHANGES = """chg AS (SELECT DISTINCT date_diff('day', ts::DATE, (SELECT max(ts)::DATE FROM events)) AS rank, 'u' || user_id AS path, user_id FROM events),
doc AS (SELECT path, min(rank) FILTER (rank < 400) AS rank FROM chg WHERE user_id % 10 = 0 GROUP BY path)"""


def _changes(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    ev = A.read(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "user_id")
    newest = ev.agg(F.max("day").alias("newest"))
    rank = F.date_diff(F.col("newest"), F.col("day"))
    path = F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path")
    ev = ev.distinct().withColumn("one", F.lit(1)).join(newest.withColumn("one", F.lit(1)), "one")
    changes = ev.select(rank.alias("rank"), F.concat(F.lit("c"), rank.cast("string")).alias("commit"), path, "user_id")
    return changes.where("user_id % 10 = 0").select("path"), changes.drop("user_id")


@query("SELECT path, 'c' || rank AS commit FROM doc", _CHANGES)
def narrative_last_commit(spark, sf_dir):
    return narrative.history(*_changes(spark, sf_dir))[0]


@query("SELECT d.path, c.path AS other FROM doc d JOIN chg c ON c.rank = d.rank AND c.path <> d.path", _CHANGES)
def narrative_co_changed(spark, sf_dir):
    return narrative.history(*_changes(spark, sf_dir))[1]


#: Histories are events: a user is a case, its commits are its events newest first, an event type a symbol.
_HISTORY = """ev AS (SELECT user_id AS "case", event_type AS id, floor(value / 50)::BIGINT::VARCHAR AS body, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS rank,
  'c' || event_id AS commit FROM events),
cases AS (SELECT DISTINCT "case" FROM ev), now AS (SELECT "case", id, body FROM ev QUALIFY row_number() OVER (PARTITION BY "case", id ORDER BY rank) = 1),
votes AS (SELECT ev."case", ev.id, min(ev.rank) - 1 AS rank FROM ev JOIN now ON ev."case" = now."case" AND ev.id = now.id AND ev.body <> now.body AND ev.rank < 400 GROUP BY ev."case", ev.id),
tally AS (SELECT v."case", e.commit, count(*) AS votes FROM votes v JOIN ev e ON e."case" = v."case" AND e.rank = v.rank GROUP BY v."case", e.commit)"""


def _history(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(history, commits); a symbol's body at a commit without an event of its type is the one before it in time."""
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))) - 1
    ev = A.read(spark, sf_dir, "events").select(F.col("user_id").alias("case"), F.col("event_type").alias("id"), F.floor(F.col("value") / 50).cast("string").alias("body"), rank.alias("rank"), F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("commit"))
    return ev.select("case", "id", "rank", "body"), ev.select("case", "rank", "commit")


@query('SELECT "case", id, rank FROM votes', _HISTORY)
def defect_votes(spark, sf_dir):
    return _votes(spark, sf_dir)[0]


def _votes(spark, sf_dir, limit: int = budget.HISTORY):
    history, commits = _history(spark, sf_dir)
    newest = history.groupBy("case", "id").agg(F.min_by("body", "rank").alias("body"))
    whole = history.withColumn("rank", F.col("rank") + 1).unionByName(newest.withColumn("rank", F.lit(0).cast("int")))
    votes = defect.introduction_votes(whole, limit).withColumn("rank", F.col("rank") - 1)
    return votes, commits


@query("""SELECT "case", commit, votes, c AS cast, 2 * votes >= c AS majority, 2 * votes > c AS strict, (100 * votes // c)::BIGINT AS percent FROM (
  SELECT *, sum(votes) OVER (PARTITION BY "case")::BIGINT AS c, row_number() OVER (PARTITION BY "case" ORDER BY votes DESC, commit) AS place FROM tally) WHERE place = 1""", _HISTORY)
def defect_introduced_by(spark, sf_dir):
    return defect.winners(*_votes(spark, sf_dir))


@query("""SELECT (SELECT count(*) FROM cases) AS attempted, count(*) AS bound, count(*) FILTER (2 * votes >= c) AS majority, count(*) FILTER (2 * votes > c) AS strict, (SELECT count(*) FROM cases) - count(*) AS uncapturable
  FROM (SELECT *, sum(votes) OVER (PARTITION BY "case") AS c, row_number() OVER (PARTITION BY "case" ORDER BY votes DESC, commit) AS place FROM tally) WHERE place = 1""", _HISTORY)
def defect_summary(spark, sf_dir):
    history, _ = _history(spark, sf_dir)
    return defect.summary(defect.winners(*_votes(spark, sf_dir)), history)


@query('SELECT "case", least(max(rank) + 1, 4) AS walked FROM ev WHERE "case" NOT IN (SELECT "case" FROM votes WHERE rank + 1 < 4) GROUP BY "case"', _HISTORY)
def defect_unsettled(spark, sf_dir):
    """Cases that a budget of four commits leaves unsettled, with how many were looked at; 400 settle them all."""
    history, _ = _history(spark, sf_dir)
    return defect.unsettled(history.withColumn("rank", F.col("rank") + 1), _votes(spark, sf_dir, 4)[0], 4)


@query("SELECT id FROM symbols_base b WHERE NOT EXISTS (SELECT 1 FROM symbols_head h WHERE h.id = b.id AND h.body = b.body)")
def defect_manifestations(spark, sf_dir):
    return defect.manifestations(_symbols(spark, sf_dir, "base"), _symbols(spark, sf_dir))


_CASCADE = """root AS (SELECT id AS k FROM symbols_head WHERE key % 29 = 0),
w1 AS (SELECT DISTINCT src AS k FROM edges_head JOIN root ON dst = k WHERE src NOT IN (SELECT k FROM root)),
w2 AS (SELECT DISTINCT src AS k FROM edges_head JOIN w1 ON dst = k WHERE src NOT IN (SELECT k FROM root UNION SELECT k FROM w1)),
w3 AS (SELECT DISTINCT src AS k FROM edges_head JOIN w2 ON dst = k WHERE src NOT IN (SELECT k FROM root UNION SELECT k FROM w1 UNION SELECT k FROM w2)),
seen AS (SELECT k FROM root UNION SELECT k FROM w1 UNION SELECT k FROM w2 UNION SELECT k FROM w3),
w4 AS (SELECT DISTINCT src AS k FROM edges_head JOIN w3 ON dst = k WHERE src NOT IN (SELECT k FROM seen))"""


@query("""SELECT id AS key, CASE WHEN id IN (SELECT k FROM root) THEN 'stale' WHEN id IN (SELECT k FROM seen) THEN 'stale_derived' WHEN id IN (SELECT k FROM w4) THEN 'residual' ELSE 'live' END AS grade,
  CASE WHEN id IN (SELECT k FROM seen) AND id NOT IN (SELECT k FROM root) THEN (SELECT string_agg(DISTINCT dst, ',' ORDER BY dst) FROM edges_head WHERE src = id AND dst IN (SELECT k FROM seen)) ELSE '' END AS via FROM symbols_head""", _CASCADE)
def doctor_cascade(spark, sf_dir):
    symbols, edges = _graph(spark, sf_dir)
    return traverse.cascade(_derived(symbols, edges)).withColumn("via", F.array_join("via", ","))


def _derived(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    inputs = edges.groupBy("src").agg(F.collect_set("dst").alias("inputs"))
    nodes = symbols.join(inputs, F.col("src") == F.col("id"), "left")
    return written(nodes.select(F.col("id").alias("key"), (F.col("key") % 29 == 0).alias("stale"), F.coalesce("inputs", F.array().cast("array<string>")).alias("inputs")), "derived")


#: The view that the doctor examines: nodes are symbols whose key 31 doesn't divide, edges all edges (so some have no
#: end). Planted, for each invariant, are rows that keep it and rows that break it, by key or by the id's first digits.
_VIEW = (
    "dn AS (SELECT id, key FROM symbols_head WHERE key % 31 <> 0), de AS (SELECT src, dst FROM edges_head WHERE src IN (SELECT id FROM dn)),\n"
    + _CASCADE.replace("symbols_head", "dn").replace("edges_head", "de")
    + """,
told AS (
  SELECT id, grade, CASE WHEN key % 41 = 0 THEN 'live' ELSE grade END AS stored, id IN (SELECT src FROM de) AS fed FROM (
    SELECT id, key, CASE WHEN id IN (SELECT k FROM root) THEN 'stale' WHEN id IN (SELECT k FROM seen) THEN 'stale_derived' WHEN id IN (SELECT k FROM w4) THEN 'residual' ELSE 'live' END AS grade FROM dn))"""
)


@query("""SELECT invariant, checked, violations, CASE WHEN checked = 0 THEN 'not_built' WHEN violations > 0 THEN 'violated' ELSE 'clean' END AS outcome FROM (
  SELECT 'endpoints' AS invariant, (SELECT count(*) FROM edges_head) AS checked,
    (SELECT count(*) FROM edges_head WHERE dst NOT IN (SELECT id FROM dn) OR src NOT IN (SELECT id FROM dn)) AS violations
  UNION ALL SELECT 'registered', (SELECT count(*) FROM dn), (SELECT count(*) FROM dn WHERE key % 37 = 0)
  UNION ALL SELECT 'producers', (SELECT count(*) FROM dn), (SELECT count(*) FROM dn WHERE key % 23 = 0)
  UNION ALL SELECT 'evidence', (SELECT count(*) FROM dn), (SELECT count(*) FROM dn WHERE key % 23 = 0)
  UNION ALL SELECT 'candidates', (SELECT count(*) FROM edges_head), (SELECT count(*) FROM edges_head WHERE src LIKE '00%')
  UNION ALL SELECT 'residuals', (SELECT count(*) FROM dn WHERE id LIKE '1%'), (SELECT count(*) FROM dn WHERE id LIKE '11%')
  UNION ALL SELECT 'bindings', (SELECT count(*) FROM bound) + (SELECT count(*) FROM bound WHERE id LIKE '0%'), (SELECT count(*) FROM bound WHERE id LIKE '0%')
  UNION ALL SELECT 'freshness', (SELECT count(*) FROM told WHERE fed OR stored <> 'live'), (SELECT count(*) FROM told WHERE (fed OR stored <> 'live') AND stored <> grade))""", _VIEW)
def doctor_diagnosis(spark, sf_dir):
    """All eight invariants, each with rows that keep it and rows that break it (see ``_VIEW``)."""
    symbols, edges = _graph(spark, sf_dir)
    text, none = F.lit(None).cast("string"), F.array().cast("array<string>")
    derived = _derived(symbols.where("key % 31 <> 0"), edges)
    inferred = F.col("k") % 23 == 0
    nodes = derived.join(traverse.cascade(derived).select("key", "grade"), "key").join(symbols.select(F.col("id").alias("key"), F.col("key").alias("k")), "key")
    nodes = nodes.select(
        "key",
        F.lit("Symbol").alias("label"),
        F.when(inferred, "inferred").otherwise("extracted").alias("provenance"),
        F.when(~inferred, F.lit("span")).alias("evidence"),
        "stale",
        "inputs",
        F.when(F.col("k") % 41 == 0, "live").otherwise(F.col("grade")).alias("grade"),
        F.when(F.col("k") % 37 == 0, F.array(F.lit("path"))).otherwise(F.array(F.lit("path"), F.lit("name"))).alias("attrs"),
    )
    nodes = written(nodes, "nodes")
    cut = F.col("src").startswith("0")
    e = edges.select(
        F.concat("src", F.lit(">"), "dst").alias("id"),
        F.lit("REFERENCES").alias("type"),
        "src",
        F.array("dst").alias("targets"),
        F.lit("scoped").alias("grade"),
        F.lit("extracted").alias("provenance"),
        F.lit("scope").alias("evidence"),
        F.when(cut & ~F.col("src").startswith("00"), F.col("src")).alias("demoted_to"),
        cut.alias("truncated"),
    )
    one, bound = spark.range(1), _bound(spark, sf_dir).select("id")
    index = bound.unionByName(bound.where("id LIKE '0%'").select(F.concat(F.lit("lost-"), "id").alias("id")))
    residuals = nodes.where("key LIKE '1%'").select(F.col("key").alias("id"), F.array(F.when(F.col("key").startswith("11"), "nowhere").otherwise(F.col("key"))).alias("coords"))
    view = {
        "nodes": nodes,
        "edges": e,
        "labels": one.select(F.lit("Symbol").alias("label"), F.array(F.lit("path"), F.lit("name")).alias("required"), F.array(F.lit("kind")).alias("allowed")),
        "types": one.select(F.lit("REFERENCES").alias("type"), F.lit("Symbol").alias("src_label"), F.lit("Symbol").alias("dst_label"), F.lit("scoped").alias("grade")),
        "producers": one.select(F.lit("Symbol").alias("label"), F.lit("extracted").alias("provenance")),
        "residuals": residuals,
        "binding_index": index,
        "bound": bound,
    }
    fed = F.count_if((F.size("inputs") > 0) | (F.col("grade") != "live"))
    n, told, rest = nodes.agg(F.count("*"), fed, F.count_if(F.col("key").startswith("1"))).first()
    m = edges.count()
    checked = {"endpoints": m, "registered": n, "producers": n, "evidence": n, "candidates": m, "residuals": rest, "bindings": index.count(), "freshness": told}
    return doctor.diagnosis(doctor.violations(view), checked)


@query("""SELECT id, CASE WHEN key % 10 = 0 OR (row_number() OVER (PARTITION BY key % 10 = 0 ORDER BY id) - 1) % ceil((SELECT count(*) FROM symbols_head WHERE key % 10 <> 0) / 512) = 0 THEN 'checked' ELSE 'outside_sample' END AS state FROM symbols_head""")
def doctor_sample(spark, sf_dir):
    """What a sampled examination looks at: every tenth key has no anchor and is always seen."""
    units = _symbols(spark, sf_dir).select("id", F.when(F.col("key") % 10 != 0, F.col("id")).alias("anchor"))
    checked, residuals = doctor.examined(units)
    return checked.select("id", F.lit("checked").alias("state")).unionByName(residuals.select(F.col("coord").alias("id"), F.col("reason").alias("state")))


@query("SELECT id AS key, 'body' AS attr, 'observed' AS made, 'extracted' AS declared FROM symbols_head WHERE key % 19 = 0")
def doctor_attribute_producers(spark, sf_dir):
    made = F.array(F.struct(F.lit("name").alias("attr"), F.lit("extracted").alias("producer")), F.struct(F.lit("body").alias("attr"), F.when(F.col("key") % 19 == 0, "observed").otherwise("extracted").alias("producer")))
    nodes = _symbols(spark, sf_dir).select(F.col("id").alias("key"), F.lit("Symbol").alias("label"), made.alias("made"))
    rules = spark.range(1).select(F.lit("Symbol").alias("label"), F.explode(F.array(F.lit("name"), F.lit("body"))).alias("attr"), F.lit("extracted").alias("producer"))
    return doctor.attribute_producers(nodes, rules)


@query("SELECT DISTINCT 'cascade_budget_exceeded' AS reason, path AS coord FROM symbols_head WHERE id IN (SELECT k FROM w4) AND key % 2 = 0", _CASCADE)
def doctor_cut_residuals(spark, sf_dir):
    """Where the cascade stopped, told by path; odd keys have none."""
    symbols, edges = _graph(spark, sf_dir)
    derived = _derived(symbols, edges)
    nodes = derived.join(symbols.select(F.col("id").alias("key"), F.when(F.col("key") % 2 == 0, F.col("path")).alias("anchor")), "key")
    return doctor.cut_residuals(nodes, traverse.cascade(derived))[0]


_LOG = """log AS (SELECT 'snap' || (user_id % 3) AS snapshot, event_type AS query, substr(sha256(concat_ws(chr(31), 'args', event_id)), 1, 16) AS args_digest, (value * 10)::BIGINT AS micros, event_id FROM events)"""


@query("""SELECT snapshot, query, args_digest, micros, 100 * (snapshot = 'snap1')::INT + row_number() OVER (PARTITION BY snapshot ORDER BY query, args_digest, micros) AS seq FROM log""", _LOG)
def query_log_append(spark, sf_dir):
    ev = A.read(spark, sf_dir, "events")
    new = ev.select(F.concat(F.lit("snap"), (F.col("user_id") % 3).cast("string")).alias("snapshot"), F.col("event_type").alias("query"), ids.args_digest(F.col("event_id")).alias("args_digest"), F.rint(F.col("value") * 10).cast("long").alias("micros"))
    old = spark.range(1).select(F.lit("snap1").alias("snapshot"), F.lit(100).cast("long").alias("seq"))
    return store.log_rows(old, new)


@query("""SELECT path, bytes, mtime FROM (SELECT *, sum(bytes) OVER (ORDER BY mtime, path) - bytes AS before, sum(bytes) OVER () AS total FROM (
  SELECT 'e' || event_id AS path, (event_id % 1000) + 1 AS bytes, floor(epoch(ts))::BIGINT AS mtime FROM events)) WHERE before < total - 100000""")
def cache_evict(spark, sf_dir):
    e = A.read(spark, sf_dir, "events").select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("path"), (F.col("event_id") % 1000 + 1).alias("bytes"), F.unix_timestamp("ts").alias("mtime"))
    return store.evicted(e, 100_000)


@query("""SELECT count(*) FILTER (file_key % 3 = 0 AND file_key % 12 <> 0) AS hits, count(*) FILTER (file_key % 3 <> 0 OR file_key % 12 = 0) AS misses, count(*) FILTER (file_key % 12 = 0) AS corrupt FROM files""")
def cache_lookup(spark, sf_dir):
    f = A.files(spark, sf_dir)
    keys = f.select("file_key", ids.cache_key(F.col("blob"), F.lit("g1"), F.lit("x1"), F.col("path"), F.col("language"), F.lit("a")).alias("cache_key"))
    return store.cache_stats(keys, keys.where("file_key % 3 = 0").select("cache_key", (F.col("file_key") % 12 == 0).alias("corrupt")))


@query("""SELECT 'CREATE (:Symbol {id: ''' || id || ''', name: ''' || name || ''', kind: ''' || kind || ''', path: ''' || path || '''});' AS value FROM symbols_head
  UNION ALL SELECT 'MATCH (a:Symbol {id: ''' || src || '''}), (b:Symbol {id: ''' || dst || '''}) CREATE (a)-[:REFERENCES]->(b);' FROM edges_head""")
def export_cypher(spark, sf_dir):
    symbols, edges = _graph(spark, sf_dir)
    return store.cypher_nodes(symbols).unionByName(store.cypher_edges(edges))


@query("""SELECT path, language, bucket FROM (SELECT path, CASE file_key % 7 WHEN 6 THEN NULL ELSE language END AS language,
  CASE WHEN file_key % 50 = 0 THEN 'excluded' WHEN file_key % 7 = 6 THEN 'unrecognized' WHEN file_key % 7 >= 3 THEN 'unsupported' WHEN file_key % 11 = 0 THEN 'partial' ELSE 'parsed' END AS bucket FROM files)""")
def ingest_classify(spark, sf_dir):
    """The cascade itself over the files' paths: excluded by a rule on the number, partial by an error share."""
    f = A.files(spark, sf_dir).select("path", "file_key")
    head = F.lit("")
    lang = recognize.language(F.col("path"), F.lit(None).cast("string"), head)
    rule = F.coalesce(recognize.excluded(F.col("path"), [("*.nothing", "none")]), F.when(F.col("file_key") % 50 == 0, "numbered"))
    bucket = recognize.bucket(F.col("path"), F.lit(10), head, F.lit(False), rule, lang, F.when(F.col("file_key") % 11 == 0, 7).otherwise(0))
    return f.select("path", lang.alias("language"), bucket.alias("bucket"))


_REFS = """refs AS (SELECT path, id AS own, byte_start + 10 AS at, ix, lag(id) OVER (PARTITION BY path ORDER BY ix) AS prev FROM symbols_head),
cls AS (SELECT path, own, prev, CASE WHEN ix % 6 = 0 THEN 'unresolved' WHEN ix % 6 = 1 THEN 'before_declaration' WHEN ix % 6 = 2 THEN 'declaration' WHEN ix % 6 = 3 OR prev IS NULL THEN 'local' WHEN ix % 6 = 4 THEN 'top_level' ELSE 'edge' END AS class FROM refs)"""


def _refs(symbols: DataFrame) -> DataFrame:
    prev = F.lag("id").over(Window.partitionBy("path").orderBy("ix"))
    kind = F.col("ix") % 6
    at = F.when(kind == 4, F.col("byte_start") + 90).otherwise(F.col("byte_start") + 10)  # 90: past the span, no symbol around
    return symbols.select("path", at.alias("at"), F.when(kind == 0, "outside").when(kind == 1, "before").otherwise("bound").alias("resolution"), F.when(kind == 2, at).otherwise(F.lit(-1)).alias("declared_at"), F.when(kind != 3, prev).alias("target"))


@query("SELECT path, class, count(*) AS n FROM cls GROUP BY path, class", _REFS)
def file_ref_classes(spark, sf_dir):
    symbols = _symbols(spark, sf_dir)
    return lookup.file_edges(_refs(symbols), symbols)[1]


@query("SELECT DISTINCT own AS src, prev AS dst FROM cls WHERE class = 'edge'", _REFS)
def file_scope_edges(spark, sf_dir):
    symbols = _symbols(spark, sf_dir)
    return lookup.file_edges(_refs(symbols), symbols)[0]


@query("""SELECT id, symbol FROM (SELECT id, target AS symbol FROM bound UNION SELECT id, symbol FROM hop1 UNION SELECT id, symbol FROM hop2)""")
def radius_expand(spark, sf_dir):
    base, edges = _graph(spark, sf_dir, "base")
    t = base.where(F.element_at("container", 1) == "1-URGENT").select(F.col("id").alias("target"), F.concat(F.lit("n"), F.col("key").cast("string")).alias("note"), "key")
    radius = F.when(F.col("key") % 3 == 0, "symbol").when(F.col("key") % 3 == 1, "callers").otherwise("closure")
    return traverse.expand_radius(t.select(ids.binding_id(F.col("target"), F.col("note")).alias("id"), "target", radius.alias("radius"), F.lit(2).alias("k")), edges)


@query("SELECT DISTINCT name, regexp_replace(regexp_replace(lower(trim(name)), '[^a-z0-9\\s_-]', '', 'g'), '\\s+', '-', 'g') AS slug, len(regexp_extract_all(name, '.')) <= 128 AS identifier FROM symbols_head")
def name_shapes(spark, sf_dir):
    n = _symbols(spark, sf_dir).select("name").distinct()
    return n.select("name", names.slug(F.col("name")).alias("slug"), names.is_identifier(F.col("name")).alias("identifier"))


#: Source texts made from the orders of every customer whose file is TypeScript, Kotlin or Rust: the i-th order is a
#: function that calls the one before and itself (TypeScript), a function and a property (Kotlin), a type with a method
#: (Rust). SQL derives from the orders what extraction must find in the texts.
def _sources(spark, sf_dir) -> DataFrame:
    ix = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    o = A.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file_key"), ix.alias("ix"))
    f = A.files(spark, sf_dir).where("file_key % 7 < 3").select("file_key", "path", "language")
    i = F.col("ix").cast("string")
    ts = F.concat(F.lit("// @decision: "), i, F.lit("\nexport function f"), i, F.lit("(v) {\n  const w = f"), (F.col("ix") - 1).cast("string"), F.lit("(v)\n  return ext(w, f"), i, F.lit(")\n}\n"))
    kt = F.concat(F.lit("fun f"), i, F.lit("() = "), i, F.lit("\nval p"), i, F.lit(" = { \"}\" }\n"))
    rs = F.concat(F.lit("impl<T> S"), i, F.lit("<T> { pub fn f"), i, F.lit("(&self) { fn local() {} } }\nstruct S"), i, F.lit(";\n"))
    rows = o.join(f, "file_key").withColumn("part", F.when(F.col("language") == "TypeScript", ts).when(F.col("language") == "Kotlin", kt).otherwise(rs))
    parts = rows.groupBy("path", "language").agg(F.array_sort(F.collect_list(F.struct("ix", "part"))).alias("p"))
    return parts.select("path", "language", F.array_join(F.transform("p", lambda x: x["part"]), "").alias("text"))


def _extracted(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    found = kept(spark, (sf_dir, "extracted"), lambda: scanners.extract(_sources(spark, sf_dir)))
    return found, kept(spark, (sf_dir, "source-symbols"), lambda: projection.symbols_of(found, A.REPO))


_SOURCES = """src AS (SELECT path, language, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders JOIN files ON o_custkey = file_key WHERE file_key % 7 < 3)"""


@query(
    """SELECT path, '' AS container, 'f' || i AS name, 'function' AS kind, 0 AS ordinal FROM src WHERE language IN ('TypeScript', 'Kotlin')
  UNION ALL SELECT path, '', 'p' || i, 'property', 0 FROM src WHERE language = 'Kotlin'
  UNION ALL SELECT path, '', 'S' || i, 'struct', 0 FROM src WHERE language = 'Rust'
  UNION ALL SELECT path, 'S' || i, 'f' || i, 'function', 0 FROM src WHERE language = 'Rust'""",
    _SOURCES,
)
def source_symbols(spark, sf_dir):
    symbols = _extracted(spark, sf_dir)[1]
    return symbols.select("path", F.array_join("container", ".").alias("container"), "name", "kind", "ordinal")


@query("SELECT path, 'f' || i AS src, 'f' || unnest([i - 1, i]) AS dst FROM src WHERE language = 'TypeScript' AND i > 1 UNION ALL SELECT path, 'f1', 'f1' FROM src WHERE language = 'TypeScript' AND i = 1", _SOURCES)
def source_edges(spark, sf_dir):
    found, symbols = _extracted(spark, sf_dir)
    name = lambda end: symbols.select(F.col("id").alias(end), "path", F.col("name").alias(f"{end}_name"))
    out = projection.edges_of(found, symbols)[0].join(name("src"), "src").join(name("dst").drop("path"), "dst")
    return out.select("path", F.col("src_name").alias("src"), F.col("dst_name").alias("dst"))


@query(
    """SELECT path, 'edge' AS class, 2 * count(*) - 1 AS n FROM src WHERE language = 'TypeScript' GROUP BY path
  UNION ALL SELECT path, 'local', 2 * count(*) FROM src WHERE language = 'TypeScript' GROUP BY path
  UNION ALL SELECT path, 'unresolved', count(*) + 1 FROM src WHERE language = 'TypeScript' GROUP BY path""",
    _SOURCES,
)
def source_ref_classes(spark, sf_dir):
    found, symbols = _extracted(spark, sf_dir)
    return projection.edges_of(found, symbols)[1]


@query("SELECT path, 5 * count(*) AS refs, 5 * count(*) AS classed FROM src WHERE language = 'TypeScript' GROUP BY path", _SOURCES)
def source_ref_totals(spark, sf_dir):
    """Every reference falls into one class."""
    found, symbols = _extracted(spark, sf_dir)
    return lookup.ref_totals(projection.references_of(found, symbols), projection.edges_of(found, symbols)[1])


@query("SELECT path, 'f' || i AS name, '@decision: ' || i AS comment FROM src WHERE language = 'TypeScript'", _SOURCES)
def source_exports(spark, sf_dir):
    """Exported names with the marked comment that is attached to their symbol."""
    found, symbols = _extracted(spark, sf_dir)
    said = projection.comments_of(found, symbols).select(F.explode("attached").alias("id"), F.col("body").alias("comment"))
    return projection.exports_of(found, symbols).join(said, "id").select("path", "name", "comment")
