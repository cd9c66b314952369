"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, let, read, uniform, word_count, written

WEIGHTS = (1, 2, 3)
MAX_PASSES = 3
#: Output shards: at least so many, and more as the words grow, so that a shard stays within one task's reach.
LEAST_SHARDS, SHARD_WORDS = 32, 2**20
SEED = 20240
#: Words in a block; a source has LEAST_BLOCKS blocks at least, so that quotas of small sources are fine enough.
BLOCK_WORDS, LEAST_BLOCKS = 65_536, 64
#: A source is filled on, block by block, while more than this share of its target is open and a document fits.
OPEN_SHARE = 0.001
#: Up to so many rows (each under 100 bytes beside the hashes of documents drawn one by one, which count as rows)
#: the table of drawn blocks is broadcast; beyond, it is joined.
MAX_BROADCAST_BLOCKS = 200_000
#: Up to so many sources what is kept per source (under 2 kB) is broadcast; beyond, it is joined.
MAX_BROADCAST_SOURCES = 10_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_PASSES) -> DataFrame:
    """(source, source_size) with ``place``, ``weight`` and ``target``; one row per source.

    Sources by code point, null last, weigh ``weights`` in turn and share the sum of all sizes. A target stops at
    ``cap`` times its source, and the excess goes to the others by weight: target = min(cap * size, level * weight)
    at the level where the targets sum to the whole. It is found by sorting sources by the level that caps them.
    """
    whole = Window.partitionBy()
    ranked = sizes.withColumn("place", F.row_number().over(whole.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.get(F.array(*map(F.lit, weights)), F.col("place") % len(weights)).cast("double"))
    most = (F.col("source_size") * cap).cast("double")
    level_at = F.col("most") / F.col("weight")
    before = whole.orderBy("caps", "place").rowsBetween(Window.unboundedPreceding, -1)
    from_here = whole.orderBy("caps", "place").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = ranked.withColumn("most", most).withColumn("caps", level_at).withColumn("all", F.sum("source_size").over(whole))
    level = (F.col("all") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(from_here)
    ranked = ranked.withColumn("level", level)
    # The levels fall while sources are capped; the first source that is not capped gives the level of all that follow.
    final = F.min(F.when(F.col("level") <= F.col("caps"), F.struct("caps", "place", "level"))).over(whole)["level"]
    return ranked.select("source", "source_size", "place", "weight", F.least("most", F.coalesce(final * F.col("weight"), F.col("most"))).alias("target"))


def hypergeometric(population: Column, marked: Column, draws: Column, u: Column) -> Column:
    """A hypergeometric number from the uniform ``u``: inversion outward from the mode by the ratio of neighbours.

    It looks 12 standard deviations to either side, beyond which no double of ``u`` reaches.
    """
    n, k, d = (c.cast("double") for c in (population, marked, draws))
    low, high = F.greatest(F.lit(0.0), d + k - n), F.least(d, k)
    mode = F.least(high, F.greatest(low, F.floor((d + 1) * (k + 1) / (n + 2)).cast("double")))
    spread = F.ceil(12 * F.sqrt(F.greatest(F.lit(0.0), d * k / F.greatest(n, F.lit(1.0)) * (1 - k / F.greatest(n, F.lit(1.0)))))) + 10
    fixed = F.struct(n.alias("n"), k.alias("k"), d.alias("d"), mode.alias("m"), F.least(high, mode + spread).cast("long").alias("hi"), F.greatest(low, mode - spread).cast("long").alias("lo"), u.alias("u"))

    def drawn(p: Column) -> Column:
        m = p["m"].cast("long")
        none = F.array().cast("array<bigint>")
        up = F.when(p["hi"] > m, F.sequence(m + 1, p["hi"])).otherwise(none)
        down = F.when(p["lo"] < m, F.sequence(m - 1, p["lo"])).otherwise(none)
        rise = lambda x: (p["k"] - x + 1) * (p["d"] - x + 1) / (x * (p["n"] - p["k"] - p["d"] + x))
        fall = lambda x: (x + 1) * (p["n"] - p["k"] - p["d"] + x + 1) / ((p["k"] - x) * (p["d"] - x))
        first = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))

        def total(xs: Column, ratio) -> Column:
            return F.aggregate(xs, first, lambda s, x: F.struct((s["w"] * ratio(x)).alias("w"), (s["sum"] + s["w"] * ratio(x)).alias("sum")))["sum"]

        def walk(xs: Column, ratio, left: Column) -> Column:
            start = F.struct(F.lit(1.0).alias("w"), left.alias("left"), m.alias("x"))
            return F.aggregate(xs, start, lambda s, x: F.struct((s["w"] * ratio(x)).alias("w"), (s["left"] - s["w"] * ratio(x)).alias("left"), F.when(s["left"] > 0, x).otherwise(s["x"]).alias("x")))["x"]

        sums = F.struct(total(up, rise).alias("up"), total(down, fall).alias("down"))

        def pick(t: Column) -> Column:
            goal = p["u"] * (1 + t["up"] + t["down"])
            return F.when(goal <= 1, m).when(goal <= 1 + t["up"], walk(up, rise, goal - 1)).otherwise(walk(down, fall, goal - 1 - t["up"]))

        return let(sums, pick)

    return let(fixed, drawn)


def _split(counts: Column, take: Column, lo: Column, hi: Column, seed: int) -> Column:
    """How many of each source's blocks the left child gets when ``take`` of all are drawn without replacement."""
    start = F.struct(F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x).alias("n"), take.alias("d"), F.array().cast("array<bigint>").alias("out"))

    def step(s: Column, k: Column) -> Column:
        u = uniform(F.lit(seed), lo, hi, F.size(s["out"]))
        return let(hypergeometric(s["n"], k, s["d"], u), lambda x: F.struct((s["n"] - k).alias("n"), (s["d"] - x).alias("d"), F.concat(s["out"], F.array(x)).alias("out")))

    return F.aggregate(counts, start, step)["out"]


#: Nodes of the tree that one task splits.
NODES_A_TASK = 64


def _halves(node: Column, seed: int) -> Column:
    """A node's children, or the node itself if it is one shard."""
    lo, hi, counts = node["lo"], node["hi"], node["counts"]
    mid = lo + F.shiftright(hi - lo, 1)
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    take = F.floor(total * (mid - lo) / (hi - lo)).cast("long")
    child = lambda a, b, c: F.struct(a.alias("lo"), b.alias("hi"), c.alias("counts"))
    both = lambda left: F.array(child(lo, mid, left), child(mid, hi, F.zip_with(counts, left, lambda a, b: a - b)))
    return F.when(hi - lo > 1, let(_split(counts, take, lo, hi, seed), both)).otherwise(F.array(child(lo, hi, counts)))


def shard_quotas(counts: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """From one row ``counts`` (blocks to draw of each source, by place): rows (place, shard, k, start) with the
    number of draws of a source that go to a shard and how many go to the shards before it.

    A tree splits the shards in halves; a node's blocks are dealt to its children by a multivariate hypergeometric
    draw, so all quotas are exact and each shard is a fair sample of the mix. One expression splits the levels that fit
    one task, so the plan doesn't grow with them; further levels' nodes are split in parallel.
    """
    levels = (n_shards - 1).bit_length()
    first = min(levels, NODES_A_TASK.bit_length())
    root = F.array(F.struct(F.lit(0).alias("lo"), F.lit(n_shards).alias("hi"), F.col("counts").alias("counts")))
    deeper = lambda nodes, _: F.flatten(F.transform(nodes, lambda x: _halves(x, seed)))
    nodes = counts.select(F.inline(F.aggregate(F.sequence(F.lit(1), F.lit(first)), root, deeper) if first else root))
    for level in range(first, levels):
        nodes = written(nodes.repartition(2**level // NODES_A_TASK, "lo"), "mix-nodes")
        nodes = nodes.select(F.inline(_halves(F.struct("lo", "hi", "counts"), seed)))
    cells = nodes.select("lo", F.posexplode("counts").alias("place", "k")).where("k > 0")
    before = F.sum("k").over(Window.partitionBy("place").orderBy("lo")) - F.col("k")
    return cells.select("place", F.col("lo").alias("shard"), "k", before.alias("start"))


def _greedy(docs: Column, want: Column) -> Column:
    """(open, hashes): documents (h, size) taken in their order while they fit into ``want`` words."""
    start = F.struct(want.cast("double").alias("open"), F.array().cast("array<bigint>").alias("taken"))

    def step(s: Column, d: Column) -> Column:
        fits = d["size"] <= s["open"]
        return F.when(fits, F.struct((s["open"] - d["size"]).alias("open"), F.concat(s["taken"], F.array(d["h"])).alias("taken"))).otherwise(s)

    return F.aggregate(docs, start, step)


def _filled(cells: DataFrame, sized: DataFrame, few) -> DataFrame:
    """(_s, _b, cut): of blocks drawn in part, the hashes of the documents that fill what is open of their sources.

    ``cells``: the blocks of each source in permuted order (nth, size, least: its smallest document) with ``from``
    and ``rest``. The first block that does not fit whole is offered the rest, document by document in hash order;
    what is still open is offered to the next blocks that hold a document small enough, until at most OPEN_SHARE of
    the target is open or nothing fits. A round is one block of each source, read from ``sized`` alone.
    """
    outside = cells.where((F.col("from") + F.col("size") > F.col("rest")) & (F.col("size") > 0)).select("_s", "_b", "nth", "least", "bar")
    whole = F.coalesce(F.max(F.when(F.col("from") + F.col("size") <= F.col("rest"), F.col("from") + F.col("size"))), F.lit(0))
    state = cells.groupBy("_s", "rest").agg(whole.alias("got")).select("_s", (F.col("rest") - F.col("got")).alias("open"), F.lit(-1).cast("long").alias("nth"))
    state, cuts = written(state, "mix-open"), None
    outside = written(outside, "mix-outside")
    while True:
        was = state.select("_s", "open", F.col("nth").alias("at"))
        fit = outside.join(few(was), "_s").where("nth > at AND least <= open AND open > bar")
        turn = fit.groupBy("_s").agg(F.min(F.struct("nth", "_b", "open")).alias("f")).select("_s", "f.*")
        docs = sized.join(few(turn), ["_s", "_b"]).where("size > 0").groupBy("_s", "_b", "nth", "open").agg(F.array_sort(F.collect_list(F.struct("h", "size"))).alias("docs"))
        done = docs.select("_s", F.struct("_b", "nth", _greedy(F.col("docs"), F.col("open")).alias("g")).alias("d"))
        led = was.join(few(done), "_s", "left")
        state = written(led.select("_s", F.coalesce("d.g.open", "open").alias("open"), F.coalesce("d.nth", "at").alias("nth"), "d._b", F.col("d.g.taken").alias("cut")), "mix-cut")
        turned = state.where("cut IS NOT NULL").select("_s", "_b", "cut")
        if turned.isEmpty():
            return cuts
        cuts = turned if cuts is None else cuts.unionByName(turned)


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, n_shards: int | None = None, seed: int = SEED, size: str | None = None) -> DataFrame:
    """Every document with ``_size``, ``_source_size``, ``_target`` and ``_draws``, array of (pass, shard).

    Each source is cut into blocks by the key's hash. A source whose target is f times its size gives all blocks
    floor(f) times, then blocks in a permuted order up to the rest, and documents of the next blocks one by one while
    they fit (see ``_filled``). The draws of all sources are the quotas at the root of the splitting tree; it deals
    them to the output shards by hypergeometric draws, and each shard takes its quota of a source from the source's
    permuted draws, so no draw is in two shards. Nothing depends on partitioning: reruns agree.

    ``size`` names a column with the number of words, where that is known; else they are counted. Null source is a
    source of its own, weighed last. Null or empty text has size 0 and comes along with its block. Rows with one key
    move together, which bounds how near a target can be met: all rows of a null key are one unit. Other columns are
    kept in the struct ``_row``. Empty table: empty result.
    """
    show = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("-"))
    words = word_count(F.col(text)) if size is None else F.coalesce(F.col(size).cast("long"), F.lit(0))
    name = F.col(source).cast("string")
    rows = docs.select(F.struct("*").alias("_row"), show(name).alias("_s"), name.alias("_src"), F.xxhash64(F.lit(seed), F.col(key).cast("string")).alias("_h"), words.alias("_size"))
    sized = written(rows.select("_s", "_src", "_h", "_size"), "mix-sizes")
    sizes = sized.groupBy("_s").agg(F.first("_src").alias("source"), F.sum("_size").alias("source_size"))
    plan = source_targets(sizes.select("source", "source_size"), weights)
    blocks = F.greatest(F.lit(LEAST_BLOCKS), F.ceil(F.col("source_size") / BLOCK_WORDS)).cast("long")
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("_s", show(F.col("source"))).withColumn("blocks", blocks).withColumn("full", full)
    plan = written(plan.withColumn("rest", F.col("target") - F.col("full") * F.col("source_size")), "mix-plan")
    few = F.broadcast if plan.count() <= MAX_BROADCAST_SOURCES else lambda df: df
    small = plan.select("_s", "blocks", "full", "rest", (OPEN_SHARE * F.col("target")).alias("bar"))
    in_block = lambda df: df.join(few(small), "_s").withColumn("_b", F.pmod(F.xxhash64(F.lit(seed + 1), "_h"), "blocks"))

    # Rows of one key are one unit, taken whole or not at all.
    units = in_block(sized).groupBy("_s", "_b", F.col("_h").alias("h"), "full", "rest", "bar").agg(F.sum("_size").alias("size"))
    units = written(units, "mix-units")
    least = F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least")
    cells = units.groupBy("_s", "_b", "full", "rest", "bar").agg(F.sum("size").alias("size"), least)
    permuted = Window.partitionBy("_s").orderBy(F.xxhash64(F.lit(seed + 2), "_s", "_b"), "_b")
    cells = cells.withColumn("from", F.sum("size").over(permuted) - F.col("size")).withColumn("nth", F.row_number().over(permuted).cast("long"))
    cells = written(cells, "mix-blocks")
    cuts = _filled(cells, units.select("_s", "_b", "h", "size"), few)
    dropped(units)
    cells = cells.withColumn("cut", F.lit(None).cast("array<bigint>")) if cuts is None else cells.join(few(cuts), ["_s", "_b"], "left")

    none = F.array().cast("array<int>")
    once = F.transform(F.sequence(F.lit(1), F.greatest(F.col("full"), F.lit(1))), lambda x: x.cast("int"))
    last = (F.col("from") + F.col("size") <= F.col("rest")) | F.col("cut").isNotNull()
    passes = F.concat(F.when(F.col("full") > 0, once).otherwise(none), F.when(last, F.array((F.col("full") + 1).cast("int"))).otherwise(none))
    draws = cells.select("_s", "_b", "cut", "full", F.explode(passes).alias("pass"))
    nth = F.row_number().over(Window.partitionBy("_s").orderBy(F.xxhash64(F.lit(seed + 3), "_s", "_b", "pass"), "_b", "pass")) - 1
    draws = written(draws.withColumn("nth", nth.cast("long")), "mix-draws")
    dropped(cells)
    per_source = plan.join(draws.groupBy("_s").agg(F.count("*").alias("k")), "_s", "left").select("place", F.coalesce("k", F.lit(0)).cast("long").alias("k"))
    one = per_source.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "k"))), lambda x: x["k"]).alias("counts"))
    if n_shards is None:
        n_shards = max(LEAST_SHARDS, -(-(plan.agg(F.sum("source_size")).first()[0] or 0) // SHARD_WORDS))
    quotas = written(shard_quotas(one, n_shards, seed + 4), "mix-quotas")
    # A shard's quota of a source is a run of the source's permuted draws: each draw finds the last run that starts at or before it.
    runs = quotas.select("place", F.col("start").alias("nth"), "shard").unionByName(draws.join(few(plan.select("_s", "place")), "_s").select("place", "nth", F.lit(None).cast("int").alias("shard"), "_s", "_b", "pass", "cut", "full"), allowMissingColumns=True)
    upto = Window.partitionBy("place").orderBy("nth", F.col("shard").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dealt = runs.withColumn("to", F.last("shard", ignorenulls=True).over(upto)).where("pass IS NOT NULL")
    border = F.when(F.col("pass") == F.col("full") + 1, F.col("cut"))
    dealt = dealt.groupBy("_s", "_b").agg(F.array_sort(F.collect_list(F.struct("pass", F.col("to").alias("shard"), border.alias("cut")))).alias("_d"))
    dealt = written(dealt, "mix-dealt")
    dropped(draws)
    dropped(quotas)
    heavy = dealt.agg(F.count("*") + F.coalesce(F.sum(F.aggregate("_d", F.lit(0), lambda a, d: a + F.greatest(F.size(d["cut"]), F.lit(0)))), F.lit(0))).first()[0]
    out = in_block(rows).join(F.broadcast(dealt) if heavy <= MAX_BROADCAST_BLOCKS else dealt, ["_s", "_b"], "left").join(few(plan.select("_s", "source_size", "target")), "_s")
    mine = F.filter(F.coalesce("_d", F.array().cast(dealt.schema["_d"].dataType)), lambda d: d["cut"].isNull() | F.array_contains(d["cut"], F.col("_h")))
    drawn = F.transform(mine, lambda d: F.struct(d["pass"].alias("pass"), d["shard"].alias("shard")))
    return out.select("_row", "_h", "_size", F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), drawn.alias("_draws"))


def mixed_rows(mixed: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself: the documents' own columns, a row for each draw, by shard and in a random order within it."""
    rows = mixed.select("_row", "_h", F.inline("_draws")).select("_row", "shard", F.xxhash64(F.lit(seed + 5), "_h", "pass").alias("_o"))
    return rows.repartition("shard").sortWithinPartitions("shard", "_o").select("_row.*")


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    """Per document what the mix takes of it and ``shards``, the output shard of each time; odd inputs as in ``mix``."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    mixed = mix(written(docs, "mix-input"), size="size")
    taken = (F.col("_size") * F.size("_draws")).alias("taken")
    shards = F.transform("_draws", lambda d: d["shard"]).alias("shards")
    return mixed.select("_row.doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), taken, shards)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the mixed documents, repeats as rows of their own; odd inputs as in ``mix``."""
    return mixed_rows(mix(docs))
