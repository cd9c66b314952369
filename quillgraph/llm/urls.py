"""URL filter: rules first, then a per-host tree of path templates judged by smoothed labelled purity; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_hot, read, written

#: (host, path, verdict): a rule fits its host and all subdomains; the longest that fits decides.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Two groups of siblings are branches of their own if their labels differ by so many standard errors; K: weight of
#: the parent's purity in the child's; REJECT: purity of "block" above which a template is rejected.
Z, K, REJECT = 3.0, 5.0, 0.5
#: Up to so many templates (under 1 kB each) are broadcast; beyond, only those of hot shapes are.
MAX_BROADCAST_TEMPLATES = 50_000
#: Names of merged branches; "?" is in no path. Like siblings, the purer and the less pure of those that differ, siblings without labels.
MERGED, LOW, HIGH, UNLABELLED = "/?", "/?-", "/?+", "/?0"

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: What varies within a segment: runs of digits, and hexadecimal strings of eight or more.
_VARIABLE = r"[0-9a-fA-F]{8,}|[0-9]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    u = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(u, _URL, 1), _UPPER, _LOWER), F.regexp_extract(u, _URL, 2)


def _children(shapes: DataFrame, d: int) -> DataFrame:
    """Shapes of nodes whose labels differ, with what follows at depth ``d``: "/" and a segment, or "" at the end."""
    return shapes.withColumn("seg", F.coalesce(F.concat(F.lit("/"), F.get("segs", F.lit(d))), F.lit("")))


def _branches(kids: DataFrame) -> DataFrame:
    """(host, tpl, seg, name, bl, bb): the branch of every child, its labels and those that say "block".

    Children are ordered by purity; the cut between the two groups that differ most, by a two-proportion test, parts
    them into two branches if the difference reaches Z, else they are one. Children of one purity count as one, so
    what is sorted for a node is bounded by its different purities, not by its children.
    """
    node = ["host", "tpl"]
    pure = kids.where("l > 0").withColumn("r", F.col("b") / F.col("l")).groupBy(*node, "r").agg(F.sum("l").alias("l"), F.sum("b").alias("b"))
    upto = Window.partitionBy(*node).orderBy("r")
    both = Window.partitionBy(*node)
    pure = pure.select(*node, "r", *(F.sum(x).over(upto).cast("double").alias(f"{x}1") for x in "lb"), *(F.sum(x).over(both).cast("double").alias(f"{x}0") for x in "lb"))
    pure = pure.where("l1 < l0").withColumn("l2", F.col("l0") - F.col("l1")).withColumn("b2", F.col("b0") - F.col("b1"))
    diff = F.col("b1") / F.col("l1") - F.col("b2") / F.col("l2")
    share = F.col("b0") / F.col("l0")
    z2 = diff * diff / (share * (1.0 - share) * (1.0 / F.col("l1") + 1.0 / F.col("l2")))
    cut = pure.withColumn("z2", z2).groupBy(*node).agg(F.max(F.struct("z2", (-F.col("r")).alias("minus"))).alias("f"))
    cut = cut.where(F.col("f.z2") >= Z * Z).select(*node, (-F.col("f.minus")).alias("cut"))
    code = F.when(F.col("l") == 0, UNLABELLED).when(F.col("cut").isNull(), MERGED).when(F.col("b") / F.col("l") <= F.col("cut"), LOW).otherwise(HIGH)
    kids = kids.join(cut, node, "left").withColumn("code", code)
    pool = kids.groupBy(*node, "code").agg(F.sum("l").alias("bl"), F.sum("b").alias("bb"), F.count("*").alias("m"), F.min("seg").alias("one"))
    named = pool.select(*node, "code", "bl", "bb", F.when(F.col("m") == 1, F.col("one")).otherwise(F.col("code")).alias("name"))
    return kids.select(*node, "seg", "code").join(named, [*node, "code"]).drop("code")


def template_tree(shapes: DataFrame) -> DataFrame:
    """(host, shape, n, tpl, p): each shape's template and its smoothed purity; ``shapes``: host, shape, n, l, b.

    A node's purity is its share of "block" among labels, smoothed by K labels toward its parent's, hosts toward all.
    A node whose labels agree, or that has none, is a template; any other is parted by the next segment (see
    ``_branches``), level by level, until no path has a further segment.
    """
    all_ = shapes.agg(F.sum("l"), F.sum("b")).first()
    prior = ((all_[1] or 0) + 1.0) / ((all_[0] or 0) + 2.0)
    purity = lambda b, l, p: (b + K * p) / (l + K)  # noqa: E731, E741
    hosts = shapes.groupBy("host").agg(F.sum("l").alias("hl"), F.sum("b").alias("hb"))
    hosts = hosts.select("host", purity(F.col("hb"), F.col("hl"), F.lit(prior)).alias("p"))
    segs = F.when(F.col("shape") == "", F.array().cast("array<string>")).otherwise(F.split("shape", "/"))
    active = written(shapes.join(hosts, "host").select("host", "shape", segs.alias("segs"), "n", "l", "b", F.lit("").alias("tpl"), "p"), "url-tree")
    tree, d, columns = None, 0, ["host", "shape", "n", "tpl", "p"]
    while True:
        mixed = active.where(F.size("segs") >= d).groupBy("host", "tpl").agg(F.sum("l").alias("nl"), F.sum("b").alias("nb")).where("nb > 0 AND nb < nl").select("host", "tpl")
        mixed = written(mixed, "url-mixed")
        if not mixed.limit(1).count():
            return active.select(columns) if tree is None else tree.unionByName(active.select(columns))
        open_ = F.size("segs") >= d
        done = active.where(~open_).select(columns).unionByName(active.where(open_).join(mixed, ["host", "tpl"], "left_anti").select(columns))
        tree = done if tree is None else tree.unionByName(done)
        parted = _children(active.where(open_).join(mixed, ["host", "tpl"], "left_semi"), d)
        branches = _branches(parted.groupBy("host", "tpl", "seg").agg(F.sum("l").alias("l"), F.sum("b").alias("b")))
        next_ = parted.join(branches, ["host", "tpl", "seg"])
        next_ = next_.select("host", "shape", "segs", "n", "l", "b", F.concat("tpl", "name").alias("tpl"), purity(F.col("bb"), F.col("bl"), F.col("p")).alias("p"))
        active, d = written(next_, "url-tree"), d + 1


def url_filter(pages: DataFrame, url: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """Every page with ``host``, ``path``, ``rule`` (null: none fits), ``template``, ``verdict`` (allow or block).

    Urls that a rule decides are the labels. What varies lexically in a segment becomes "*"; per host, segments then
    form a tree whose similar siblings are merged (see ``template_tree``). A template is rejected when its smoothed
    share of "block" passes REJECT; without any label that is never. The tree is built over distinct (host, shape) with counts, so a host with a
    third of the pages is aggregated before anything else happens to it.

    Null urls and those without "://" have empty host and path and one template. Repeated rows are all returned;
    ``host``, ``path``, ``rule``, ``template`` and ``verdict`` replace columns of these names. Empty table: no rows.
    """
    own = ["host", "path", "rule", "template", "verdict"]
    carry = [c for c in pages.columns if c not in own]
    h, p = host_and_path(F.col(url))
    rows = pages.select(F.struct(*carry).alias("_row"), h.alias("_h"), p.alias("_p"))
    rule = verdict = F.lit(None).cast("string")
    for host, path, what in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest is tested first
        fits = ((F.col("_h") == host) | F.col("_h").endswith("." + host)) & F.col("_p").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    shape = F.regexp_replace(F.regexp_replace("_p", "^/|/$", ""), _VARIABLE, "*")
    rows = rows.select("_row", "_h", "_p", rule.alias("_r"), verdict.alias("_v"), shape.alias("_shape"))
    labels = F.count("*").alias("n"), F.count("_v").alias("l"), F.count_if(F.col("_v") == "block").alias("b")
    counts = written(rows.groupBy(F.col("_h").alias("host"), F.col("_shape").alias("shape")).agg(*labels), "url-shapes")
    tree = template_tree(counts)
    judged = F.when(F.col("p") > REJECT, "block").otherwise("allow").alias("judged")
    side = tree.select(F.col("host").alias("_h"), F.col("shape").alias("_shape"), "n", "tpl", judged)
    many, total = side.agg(F.count("*"), F.sum("n")).first()
    out = rows.join(F.broadcast(side.drop("n")), ["_h", "_shape"]) if many <= MAX_BROADCAST_TEMPLATES else join_hot(rows, side, ["_h", "_shape"], "n", total)
    template = F.concat("_h", "tpl").alias("template")
    return out.select("_row.*", F.col("_h").alias("host"), F.col("_p").alias("path"), F.col("_r").alias("rule"), template, F.coalesce("_v", "judged").alias("verdict"))


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every page's verdict and template; odd inputs as in ``url_filter``."""
    return url_filter(read(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "template")


#: Levels of the tree that the SQL writes out; a path of more segments than this, under mixed labels, would show as a difference.
SQL_LEVELS = 6


def oracle() -> str:
    by_length = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    case = lambda pick: "CASE " + " ".join(f"WHEN {fits(r[0], r[1])} THEN '{pick(r)}'" for r in by_length) + " END"
    levels = []
    for d in range(SQL_LEVELS):
        # x: candidates for a cut are the purities themselves; the sums on either side come from joining them with all others.
        levels.append(f"""
open{d} AS MATERIALIZED (
  SELECT t.*, CASE WHEN len(segs) > {d} THEN '/' || segs[{d + 1}] ELSE '' END AS seg FROM t{d} t
  WHERE len(segs) >= {d} AND (host, tpl) IN (SELECT (host, tpl) FROM t{d} WHERE len(segs) >= {d} GROUP BY host, tpl HAVING sum(b) BETWEEN 1 AND sum(l) - 1)),
kid{d} AS MATERIALIZED (SELECT host, tpl, seg, sum(l)::DOUBLE AS l, sum(b)::DOUBLE AS b FROM open{d} GROUP BY ALL),
side{d} AS (
  SELECT x.host, x.tpl, x.r, sum(k.l) FILTER (k.b / k.l <= x.r) AS l1, sum(k.b) FILTER (k.b / k.l <= x.r) AS b1,
    sum(k.l) FILTER (k.b / k.l > x.r) AS l2, sum(k.b) FILTER (k.b / k.l > x.r) AS b2, sum(k.b) / sum(k.l) AS share
  FROM (SELECT DISTINCT host, tpl, b / l AS r FROM kid{d} WHERE l > 0) x JOIN kid{d} k ON k.host = x.host AND k.tpl = x.tpl AND k.l > 0 GROUP BY ALL),
best{d} AS (
  SELECT host, tpl, r AS cut FROM (
    SELECT *, (b1 / l1 - b2 / l2) * (b1 / l1 - b2 / l2) / (share * (1.0 - share) * (1.0 / l1 + 1.0 / l2)) AS z2 FROM side{d} WHERE l2 > 0)
  WHERE z2 >= {Z * Z} QUALIFY row_number() OVER (PARTITION BY host, tpl ORDER BY z2 DESC, r) = 1),
code{d} AS (
  SELECT k.*, CASE WHEN l = 0 THEN '{UNLABELLED}' WHEN cut IS NULL THEN '{MERGED}' WHEN b / l <= cut THEN '{LOW}' ELSE '{HIGH}' END AS code
  FROM kid{d} k LEFT JOIN best{d} USING (host, tpl)),
name{d} AS MATERIALIZED (
  SELECT host, tpl, seg, sum(l) OVER w AS bl, sum(b) OVER w AS bb, CASE WHEN count(*) OVER w = 1 THEN seg ELSE code END AS name
  FROM code{d} WINDOW w AS (PARTITION BY host, tpl, code)),
t{d + 1} AS MATERIALIZED (
  SELECT o.host, o.shape, o.segs, o.l, o.b, o.tpl || m.name AS tpl, (m.bb + {K} * o.p) / (m.bl + {K}) AS p
  FROM open{d} o JOIN name{d} m ON o.host = m.host AND o.tpl = m.tpl AND o.seg = m.seg
  UNION ALL
  SELECT t.host, t.shape, t.segs, t.l, t.b, t.tpl, t.p FROM t{d} t ANTI JOIN open{d} o ON t.host = o.host AND t.shape = o.shape)""")
    levels = ",".join(levels)
    return f"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{_URL}', 1), '{_UPPER}', '{_LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '{_URL}', 2) AS path FROM pages),
r AS (
  SELECT *, regexp_replace(regexp_replace(path, '^/|/$', '', 'g'), '{_VARIABLE}', '*', 'g') AS shape,
    {case(lambda r: r[0] + r[1])} AS rule, {case(lambda r: r[2])} AS v FROM u),
shapes AS MATERIALIZED (SELECT host, shape, count(v) AS l, count(*) FILTER (v = 'block') AS b FROM r GROUP BY host, shape),
prior AS (SELECT (sum(b) + 1.0) / (sum(l) + 2.0) AS p FROM shapes),
t0 AS MATERIALIZED (
  SELECT s.host, s.shape, CASE WHEN s.shape = '' THEN [] ELSE string_split(s.shape, '/') END AS segs, s.l, s.b, '' AS tpl,
    (sum(s.b) OVER (PARTITION BY s.host) + {K} * prior.p::DOUBLE) / (sum(s.l) OVER (PARTITION BY s.host) + {K}) AS p FROM shapes s, prior),
{levels.lstrip()}
SELECT r.page_id, r.host, r.path, r.rule, coalesce(r.v, CASE WHEN t.p > {REJECT} THEN 'block' ELSE 'allow' END) AS verdict, r.host || t.tpl AS template
FROM r JOIN t{SQL_LEVELS} t ON r.host = t.host AND r.shape = t.shape"""
