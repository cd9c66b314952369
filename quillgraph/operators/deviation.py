"""Plan against change: symbol deltas, pattern resolution, the four-way split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..functions.glob import glob_regex
from . import budget


def symbol_delta(base: DataFrame, head: DataFrame) -> DataFrame:
    """(id, change): added, removed or changed (the body differs)."""
    b, h = base.select("id", F.col("body").alias("b")), head.select("id", F.col("body").alias("h"))
    change = F.when(F.col("b").isNull(), "added").when(F.col("h").isNull(), "removed").when(F.col("b") != F.col("h"), "changed")
    return b.join(h, "id", "full_outer").select("id", change.alias("change")).where("change IS NOT NULL")


def differing_paths(a: DataFrame, b: DataFrame) -> DataFrame:
    """(path, change) of two trees (path, blob)."""
    x, y = a.select("path", F.col("blob").alias("x")), b.select("path", F.col("blob").alias("y"))
    change = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "deleted").when(F.col("x") != F.col("y"), "changed")
    return x.join(y, "path", "full_outer").select("path", change.alias("change")).where("change IS NOT NULL")


def resolve_patterns(patterns: DataFrame, symbols: DataFrame, files: DataFrame, cap: int = budget.PLAN_PATH_CAP) -> DataFrame:
    """(item, kind, text, source, state, why, targets) at one snapshot.

    kind symbol: one match is bound, none or many unresolved; new_symbol: none is pending; paths: more than ``cap``
    files is too broad, none pending, files without symbols unresolved, else all their symbols. Patterns are a plan's,
    few; names and plain paths are matched in one join each, wildcards in one pass over the files.
    """
    key = ["item", "kind", "text", "source"]
    none = F.array().cast("array<string>")
    p = patterns.select(*key).distinct()
    chain, last = names.split_qualified(F.col("text"))
    named = p.where("kind <> 'paths'").withColumn("chain", chain).withColumn("last", last)
    hit = named.join(symbols.select("id", "name", "container"), F.col("last") == F.col("name")).where(names.chain_is_tail(F.col("chain"), F.col("container")))
    ids = hit.groupBy(*key).agg(F.array_sort(F.collect_set("id")).alias("ids"))
    n = F.size(F.coalesce("ids", none))
    state = F.when(n == 1, "bound").when((n == 0) & (F.col("kind") == "new_symbol"), "pending").otherwise("unresolved")
    why = F.when(n == 1, None).when(n > 1, "many").when(F.col("kind") == "new_symbol", "declared_new").otherwise("not_at_baseline")
    out = named.join(ids, key, "left").select(*key, state.alias("state"), why.alias("why"), F.when(n == 1, F.col("ids")).otherwise(none).alias("targets"))
    paths = p.where("kind = 'paths'").select("text").distinct()
    #: A text with a slash inside and no wildcard is one path, found by a join.
    plain = ~F.col("text").rlike(r"[*?\[]") & F.regexp_replace("text", "^/|/$", "").contains("/") & ~F.col("text").endswith("/")
    globs = [r["text"] for r in paths.where(~plain).collect()]  # a plan's patterns with wildcards: few
    at = files.select("path", F.col("path").alias("own")).join(paths.where(plain).select("text", F.regexp_replace("text", "^/", "").alias("own")), "own").select("path", "text")
    if globs:
        test = F.array_compact(F.array(*(F.when(F.concat("path", F.lit("/")).rlike(glob_regex(g)), F.lit(g)) for g in globs)))
        at = at.unionByName(files.select("path", F.explode(test).alias("text")))
    wide = at.groupBy("text").agg(F.count("*").alias("files"))
    inside = at.join(wide.where(F.col("files") <= cap), "text").join(symbols.select("path", "id"), "path").groupBy("text").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    paths = p.where("kind = 'paths'").join(wide, "text", "left").join(inside, "text", "left")
    n = F.coalesce("files", F.lit(0))
    state = F.when(n > cap, "unresolved").when(n == 0, "pending").when(F.col("ids").isNull(), "unresolved").otherwise("bound")
    why = F.when(n > cap, "pattern_too_broad").when(n == 0, "path_absent").when(F.col("ids").isNull(), "not_at_baseline")
    return out.unionByName(paths.select(*key, state.alias("state"), why.alias("why"), F.coalesce("ids", none).alias("targets")))


#: Where a pattern can come from.
SOURCES = ("declared", "span", "path", "identifier")
#: Reasons in the order in which the first one present is told.
WHY = ("not_at_baseline", "many", "pattern_too_broad")


def deviate(at_base: DataFrame, at_head: DataFrame, delta: DataFrame) -> DataFrame:
    """Rows (class, item, coord, detail): as_planned, unplanned, unimplemented, unmeasurable.

    An item expects the targets bound at the baseline, and those bound at the head of patterns that were pending then.
    """
    key = ["item", "kind", "text", "source"]
    pending = at_base.where("state = 'pending'").select(*key)
    later = at_head.join(pending, key, "left_semi").select("item", F.explode("targets").alias("coord"))
    expected = at_base.select("item", F.explode("targets").alias("coord")).unionByName(later).distinct()
    ordered = at_base.withColumn("turn", F.lit(0)).unionByName(at_head.withColumn("turn", F.lit(1)))
    source = ordered.select("item", "turn", "source", "text", F.explode("targets").alias("coord")).groupBy("item", "coord").agg(F.max_by("source", F.struct("turn", "text")).alias("detail"))
    hit = expected.join(delta.select(F.col("id").alias("coord")), "coord", "left_semi")
    planned = hit.join(source, ["item", "coord"], "left").select(F.lit("as_planned").alias("class"), "item", "coord", F.coalesce("detail", F.lit("identifier")).alias("detail"))
    nothing = F.lit(None).cast("string")
    unplanned = delta.select(F.col("id").alias("coord")).join(expected.select("coord"), "coord", "left_anti").select(F.lit("unplanned").alias("class"), nothing.alias("item"), "coord", nothing.alias("detail"))
    order = F.array_position(F.array(*map(F.lit, WHY)), F.col("why"))
    why = at_base.where("state = 'unresolved'").groupBy("item").agg(F.min_by("why", order).alias("why"))
    still = at_head.where("state = 'pending'").select("item").distinct().withColumn("still", F.lit(True))
    state = at_base.select("item").distinct().join(expected.groupBy("item").agg(F.count("*").alias("n")), "item", "left").join(hit.groupBy("item").agg(F.count("*").alias("hits")), "item", "left").join(still, "item", "left").join(why, "item", "left")
    lost = F.when(F.col("n").isNull() & F.col("still").isNull(), "unmeasurable").when(F.col("hits").isNull(), "unimplemented")
    rest = state.withColumn("class", lost).where("class IS NOT NULL").select("class", "item", nothing.alias("coord"), F.when(F.col("class") == "unmeasurable", F.coalesce("why", F.lit(WHY[0]))).alias("detail"))
    return planned.unionByName(unplanned).unionByName(rest)


def rate(deviation: DataFrame, delta: DataFrame) -> DataFrame:
    """One row (changed, unplanned, tag, rate): the share of the change that no item planned; undefined without change."""
    n = delta.agg(F.count("*").alias("changed")).withColumn("k", F.lit(1)).join(deviation.agg(F.count_if(F.col("class") == "unplanned").alias("unplanned")).withColumn("k", F.lit(1)), "k")
    some = F.col("changed") > 0
    return n.select("changed", "unplanned", F.when(some, "defined").otherwise("undefined").alias("tag"), F.when(some, F.round(F.col("unplanned") / F.col("changed"), 6)).alias("rate"))


def summary(deviation: DataFrame) -> DataFrame:
    """(class, detail, n), zeros of the four classes included."""
    dim = deviation.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, ("as_planned", "unplanned", "unimplemented", "unmeasurable")))).alias("class"))
    return dim.join(deviation.groupBy("class").agg(F.count("*").alias("n"), F.count_distinct("item").alias("items")), "class", "left").select("class", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("items", F.lit(0)).alias("items"))


def by_source(deviation: DataFrame) -> DataFrame:
    """(source, n) of the planned rows, by where a pattern came from; zeros of all sources included."""
    dim = deviation.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, SOURCES))).alias("source"))
    n = deviation.where("class = 'as_planned'").groupBy(F.col("detail").alias("source")).agg(F.count("*").alias("n"))
    return dim.join(n, "source", "left").select("source", F.coalesce("n", F.lit(0)).alias("n"))


def unmeasurable_by_reason(deviation: DataFrame) -> DataFrame:
    """(reason, n) of unmeasurable items; zeros of all reasons included."""
    dim = deviation.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, WHY))).alias("reason"))
    n = deviation.where("class = 'unmeasurable'").groupBy(F.col("detail").alias("reason")).agg(F.count("*").alias("n"))
    return dim.join(n, "reason", "left").select("reason", F.coalesce("n", F.lit(0)).alias("n"))


def resolution(deviation: DataFrame) -> DataFrame:
    """One row (resolved, total): items whose coordinates were found, of all; unmeasurable ones are not resolved."""
    items = deviation.where("item IS NOT NULL").groupBy("item").agg(F.min(F.col("class") != "unmeasurable").alias("ok"))
    return items.agg(F.count_if("ok").alias("resolved"), F.count("*").alias("total"))


def item_states(at_base: DataFrame, at_head: DataFrame) -> DataFrame:
    """(item, expected, still_pending, promoted): targets expected, patterns pending at the head, and those bound since."""
    key = ["item", "kind", "text", "source"]
    both = at_base.select(*key, F.col("state").alias("b"), F.col("targets").alias("bt")).join(at_head.select(*key, F.col("state").alias("h"), F.col("targets").alias("ht")), key)
    promoted = (F.col("b") == "pending") & (F.col("h") == "bound")
    coords = F.when(promoted, F.array_union("bt", "ht")).otherwise(F.col("bt"))
    per = both.groupBy("item").agg(F.size(F.array_distinct(F.flatten(F.collect_list(coords)))).cast("long").alias("expected"), F.max(F.col("h") == "pending").alias("still_pending"), F.count_if(promoted).alias("promoted"))
    return per.select("item", "expected", "still_pending", "promoted")
