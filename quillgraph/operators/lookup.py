"""Name resolution, containment, callers, near names, coverage, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from . import budget


def resolve(asked: DataFrame, symbols: DataFrame) -> DataFrame:
    """(asked, place, all of symbols): exact, case-sensitive; many is normal. ``asked``: column asked, distinct names."""
    found = asked.select("asked").distinct().join(symbols, F.col("asked") == F.col("name"))
    return found.withColumn("place", F.row_number().over(Window.partitionBy("asked").orderBy("path", "byte_start", "id")))


def outcomes(asked: DataFrame, symbols: DataFrame) -> DataFrame:
    """(asked, n, outcome, id): found with the one id, ambiguous or unknown. All three are answers."""
    n = symbols.groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    out = asked.select("asked").distinct().join(n, F.col("asked") == F.col("name"), "left")
    n = F.coalesce("n", F.lit(0)).cast("long")
    return out.select("asked", n.alias("n"), F.when(n == 0, "unknown").when(n == 1, "found").otherwise("ambiguous").alias("outcome"), F.when(n == 1, F.col("id")).alias("id"))


def contains(starts: DataFrame, symbols: DataFrame) -> DataFrame:
    """(start, place, id) of what lies within each start at any depth, in byte order; ``starts``: start (a symbol id)."""
    s = starts.select("start").distinct().join(symbols.select(F.col("id").alias("start"), "path", F.concat("container", F.array("name")).alias("head")), "start")
    inner = s.join(symbols.select("id", "path", "container", "byte_start"), "path").where(names.chain_is_head(F.col("head"), F.col("container")) & (F.col("id") != F.col("start")))
    place = F.row_number().over(Window.partitionBy("start").orderBy("byte_start", "id"))
    return inner.select("start", place.alias("place"), "id")


def parents(symbols: DataFrame) -> DataFrame:
    """(id, parent) of symbols that lie in another of their file: the first one whose name ends the container.

    Joined on the whole container chain, so equal names in other places don't meet.
    """
    inner = symbols.where(F.size("container") > 0).select("id", "path", F.col("container").alias("chain"))
    outer = symbols.select("path", F.concat("container", F.array("name")).alias("chain"), F.struct("byte_start", "id").alias("at"))
    return inner.join(outer.groupBy("path", "chain").agg(F.min("at").alias("at")), ["path", "chain"]).select("id", F.col("at.id").alias("parent"))


def ref_totals(refs: DataFrame, classes: DataFrame) -> DataFrame:
    """(path, refs, classed): references of each file and the sum of its six classes, which must agree."""
    n, c = refs.groupBy("path").agg(F.count("*").alias("refs")), classes.groupBy("path").agg(F.sum("n").alias("classed"))
    zero = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    return n.join(c, "path", "full_outer").select("path", zero("refs"), zero("classed"))


def callers(starts: DataFrame, edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(start, place, id) of what points at each start; one hop, recursion kept, in order of path and byte."""
    hit = starts.select("start").distinct().join(edges.distinct(), F.col("start") == F.col("dst")).join(symbols.select("id", "path", "byte_start"), F.col("src") == F.col("id"))
    place = F.row_number().over(Window.partitionBy("start").orderBy("path", "byte_start", "id"))
    return hit.select("start", place.alias("place"), "id")


def _lengths(texts: DataFrame, column: str) -> list[int]:
    """The different lengths of texts: no more numbers than the longest has characters."""
    return sorted(r["n"] for r in texts.select(F.length(column).alias("n")).distinct().collect() if r["n"])


def _parts(texts: DataFrame, column: str, lengths: list[int]) -> DataFrame:
    """(column, part): what each text holds, in lower case, of the given lengths."""
    low = F.lower(F.col(column))
    sizes = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length(low))
    of = F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.length(low) - n + 1), lambda i: F.substring(low, i, n)))
    return texts.select(column, F.explode(F.array_distinct(F.flatten(of))).alias("part"))


def near_names(asked: DataFrame, symbols: DataFrame, cap: int = budget.NEAR_CAP) -> DataFrame:
    """(asked, kind, name, place, beyond): spelling before substring, then by name; ``beyond`` counts what the cap cut.

    Spelling is a join on folded names. For substrings, the parts of every text that have the length of some text of
    the other side are joined with it, so pairs come from equal keys alone; a text of n characters has under n * n / 2
    parts. An empty name is near to nothing.
    """
    asked, every = asked.select("asked").distinct(), symbols.select("name").distinct()
    fold = lambda c: names.folded(F.col(c)).alias("fold")
    spelling = asked.select("asked", fold("asked")).join(every.select("name", fold("name")), "fold").select("asked", "name", F.lit(0).alias("kind"))
    inside = _parts(every, "name", _lengths(asked, "asked")).join(asked.select("asked", F.lower("asked").alias("part")), "part")
    around = _parts(asked, "asked", _lengths(every, "name")).join(every.select("name", F.lower("name").alias("part")), "part")
    near = spelling.unionByName(inside.unionByName(around).select("asked", "name", F.lit(1).alias("kind")))
    near = near.where("asked <> name").groupBy("asked", "name").agg(F.min("kind").alias("kind"))
    total = near.groupBy("asked").agg(F.count("*").alias("all"))
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("asked").orderBy("kind", "name")))
    out = near.where(F.col("place") <= cap).join(total, "asked")
    return out.select("asked", F.when(F.col("kind") == 0, "spelling").otherwise("substring").alias("kind"), "name", "place", F.greatest(F.col("all") - cap, F.lit(0)).alias("beyond"))


def coverage(accessed: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """One row: weakest identity (2 exact, 1 ordinal), unresolved references and least grade of the files accessed."""
    s = accessed.select("id").distinct().join(symbols.select("id", "path", "ordinal"), "id")
    identity = s.agg(F.min(F.when(F.col("ordinal") == 0, 2).otherwise(1)).alias("identity"), F.count("*").alias("n"))
    f = files.join(s.select("path").distinct(), "path", "left_semi").agg(F.sum(F.when(F.col("refs_built"), F.col("unresolved"))).alias("unresolved"), F.min("grade").alias("grade"))
    one = identity.withColumn("k", F.lit(1)).join(f.withColumn("k", F.lit(1)), "k")
    return one.select(F.coalesce("identity", F.lit(1)).alias("identity"), F.coalesce("unresolved", F.lit(0)).cast("long").alias("unresolved"), F.coalesce("grade", F.lit(0)).alias("grade"), F.col("n").alias("accessed"))


def innermost(points: DataFrame, spans: DataFrame) -> DataFrame:
    """``points`` (path, at) with the narrowest span of the same path that holds ``at``; the first of equals.

    A span is cut into aligned pieces whose lengths are powers of four, at most three of a length at either end; a
    point lies in one piece of each length. So the join is on (path, length, piece): a point meets the spans that hold
    it, and no others, however many a file has. Neither side is ever broadcast: the size of a compressed file says nothing
    of the rows that its arrays, and then the pieces, are turned into.
    """
    p = points.withColumn("_p", F.struct("path", "at"))
    s = spans.select("path", "byte_start", "byte_end", "ix", F.col("id").alias("inner")).where("byte_start < byte_end")
    #: State while a span is cut: what is left of it, from both ends, in pieces of 4^level.
    left = F.array(F.struct(F.col("byte_start").alias("a"), F.col("byte_end").alias("b"), F.lit(0).alias("level"), F.array().cast("array<struct<level:int,piece:bigint>>").alias("pieces")))

    def step(t, _):
        up = F.least(t["b"], F.ceil(t["a"] / 4).cast("long") * 4)
        down = F.greatest(up, F.floor(t["b"] / 4).cast("long") * 4)
        run = lambda lo, hi: F.when(lo < hi, F.transform(F.sequence(lo, hi - 1), lambda x: F.struct(t["level"].alias("level"), x.alias("piece")))).otherwise(F.array().cast("array<struct<level:int,piece:bigint>>"))
        return F.struct((up / 4).cast("long").alias("a"), (down / 4).cast("long").alias("b"), (t["level"] + 1).alias("level"), F.concat(t["pieces"], run(t["a"], up), run(down, t["b"])).alias("pieces"))

    steps = F.sequence(F.lit(1), F.ceil(F.log(4.0, F.greatest(F.col("byte_end"), F.lit(4)))).cast("int") + 1)
    s = s.withColumn("_c", F.explode(F.aggregate(steps, left[0], step, lambda t: t["pieces"])))
    top = s.agg(F.coalesce(F.max("_c.level"), F.lit(0))).first()[0]
    cells = F.transform(F.sequence(F.lit(0), F.lit(top)), lambda n: F.struct(n.alias("level"), F.floor(F.col("at") / F.pow(F.lit(4.0), n)).cast("long").alias("piece")))
    q = p.select("_p", "path", "at").distinct().withColumn("_c", F.explode(cells))
    hit = q.join(s.hint("merge"), ["path", "_c"])
    best = hit.groupBy("_p").agg(F.min_by("inner", F.struct(F.col("byte_end") - F.col("byte_start"), "ix")).alias("inner"))
    return p.join(best.hint("merge"), "_p", "left").drop("_p")


def file_edges(refs: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (src, dst) and counts (path, class, n): each reference falls into one of six classes.

    ``refs``: path, at, resolution (bound, outside, before), declared_at, target (a symbol id or null for a local).
    """
    r = innermost(refs, spans)
    kind = (
        F.when(F.col("resolution") == "outside", "unresolved")
        .when(F.col("resolution") == "before", "before_declaration")
        .when(F.col("declared_at") == F.col("at"), "declaration")
        .when(F.col("target").isNull(), "local")
        .when(F.col("inner").isNull(), "top_level")
        .otherwise("edge")
    )
    r = r.withColumn("class", kind)
    return r.where("class = 'edge'").select(F.col("inner").alias("src"), F.col("target").alias("dst")).distinct(), r.groupBy("path", "class").agg(F.count("*").alias("n"))


def ledger(files: DataFrame) -> DataFrame:
    """One row: how much of the snapshot was seen, by bucket, and languages whose symbols cannot be bound."""
    n = lambda b: F.count_if(F.col("bucket") == b)
    return files.agg(
        F.count("*").alias("files_total"), n("parsed").alias("parsed"), n("partial").alias("partial"), n("unsupported").alias("unsupported"), n("unrecognized").alias("unrecognized"),
        F.count_distinct(F.when((F.col("grade") == 0) & F.col("language").isNotNull(), F.col("language"))).alias("unbindable_languages"),
    )


def exclusions_by_rule(files: DataFrame) -> DataFrame:
    """(rule, n) of excluded files."""
    return files.where("bucket = 'excluded'").groupBy("rule").agg(F.count("*").alias("n"))


def head_moved(ledger_base: str, head_now: str) -> bool:
    """Did the branch move after the ledger was made? Then the ledger is another commit's."""
    return ledger_base != head_now


def unbindable_languages(files: DataFrame) -> DataFrame:
    """(language, n, grade, identity) of the languages whose symbols nothing can be bound to."""
    return language_capabilities(files).where("identity = 'unavailable'")


def out_of_scope_files(files: DataFrame) -> int:
    """How many files no answer about symbols can see: all that are neither parsed nor partly parsed."""
    return files.where(~F.col("bucket").isin("parsed", "partial")).count()


BUCKETS = ("parsed", "partial", "unsupported", "unrecognized", "excluded", "generated", "binary")


def bucket_counts(files: DataFrame) -> DataFrame:
    """(bucket, n) for all seven buckets, zeros included."""
    dim = files.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, BUCKETS))).alias("bucket"))
    return dim.join(files.groupBy("bucket").count(), "bucket", "left").select("bucket", F.coalesce("count", F.lit(0)).alias("n"))


def language_capabilities(files: DataFrame) -> DataFrame:
    """(language, n, grade, identity) of recognised files: grade is the best; identity follows from it."""
    g = files.where(F.col("bucket").isin("parsed", "partial", "unsupported")).groupBy("language").agg(F.count("*").alias("n"), F.max("grade").alias("grade"))
    return g.withColumn("identity", F.when(F.col("grade") == 0, "unavailable").when(F.col("grade") == 1, "ordinal").otherwise("exact"))
