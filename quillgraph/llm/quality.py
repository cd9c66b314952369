"""Quality rules: robust multivariate outliers by minimum covariance determinant, DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, dropped, join_hot, let, read, words_of, written

SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Share of a group's rows that the estimate rests on, and what makes the covariance of that share consistent
#: for four normal variables: 0.75 / P(chi2_6 <= q) where P(chi2_4 <= q) = 0.75.
SUBSET, CONSISTENCY = 0.75, 1.485
#: Squared distance above which a document is an outlier: the 1 - 5e-6 quantile of chi2_4.
CUTOFF = 30.0
#: The least standard deviation taken for each statistic, so that one that is constant within a group
#: (no symbols at all, say) leaves the covariance invertible and does not reject on trifles.
STATS = ("log_word_len", "sqrt_symbols", "dup_lines", "repeats")
FLOORS = (0.03, 0.04, 0.12, 0.12)
MIN_GROUP = 50
#: Concentration goes on while the logarithm of a determinant still falls by more than this.
LEAST_FALL = 1e-4
#: Squared distances are counted in bins of ratio exp(1 / BINS), from exp(FIRST_BIN / BINS) on, to find the nearest share.
BINS, FIRST_BIN = 64, -1024
#: Up to so many groups their estimates (28 numbers each) are broadcast; beyond, only those of hot groups are.
MAX_BROADCAST_GROUPS = 20_000
#: Up to so many estimates, what is summed up for them (some two thousand bins each, however many rows) goes to one task.
MAX_GATHERED = 1_000


def _repeat_words(words: Column) -> Column:
    """How many words lie in a three-word window that the text holds at least twice.

    Windows are hashed. Where no hash occurs twice that is all; else they are sorted with their place and compared with
    their neighbours: n log n on any length.
    """
    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def placed(h: Column) -> Column:
        return F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))

    def twice(g: Column) -> Column:
        same = lambda x, i: F.get(g, i)["h"].eqNullSafe(x["h"])
        kept = F.filter(g, lambda x, i: same(x, i - 1) | same(x, i + 1))
        return F.sort_array(F.transform(kept, lambda x: x["p"]))

    def covered(p: Column) -> Column:
        return F.aggregate(
            p,
            F.struct(F.lit(0).alias("n"), F.lit(-1).alias("end")),
            lambda s, x: F.struct((s["n"] + x + 3 - F.greatest(x, s["end"])).alias("n"), (x + 3).alias("end")),
            lambda s: s["n"].cast("long"),
        )

    none = F.lit(0).cast("long")
    repeated = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(let(placed(h), lambda g: covered(twice(g))))
    return let(words, lambda w: F.when(F.size(w) < 4, none).otherwise(let(hashes(w), repeated)))


def text_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the base statistics ``_q``: struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_count(x, F.lit(WORD)) > 0)
    return docs.withColumn(
        "_q",
        let(
            words_of(text),
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
                let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
                _repeat_words(w).alias("n_repeat_words"),
                F.size(lines).cast("long").alias("n_lines"),
            ),
        ),
    )


def _vector(q: Column) -> list[Column]:
    n = F.greatest(q["n_words"], F.lit(1)).cast("double")
    return [
        F.log(F.greatest(q["word_chars"], F.lit(1)) / n),
        F.sqrt(q["n_symbols"] / n),
        q["n_dup_lines"] / F.greatest(q["n_lines"], F.lit(1)),
        q["n_repeat_words"] / n,
    ]


def base_failed(q: Column) -> Column:
    return (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > MAX_REPEAT_PERCENT * q["n_words"])


def _keys(lang: str, source: str) -> list[Column]:
    """The finest group first; a text form in which null differs from every value."""
    show = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    return [F.concat_ws("\x01", show(lang), show(source)), show(lang), F.lit("*")]


def _with_cholesky(est: DataFrame) -> DataFrame:
    """l_ij, the lower triangular factor of the covariance c_ij, and ``det``, the logarithm of its determinant."""
    p = len(STATS)
    for i in range(p):
        for j in range(i + 1):
            rest = reduce(lambda a, k: a - F.col(f"l{i}{k}") * F.col(f"l{j}{k}"), range(j), F.col(f"c{i}{j}"))  # noqa: B023
            est = est.withColumn(f"l{i}{j}", F.sqrt(rest) if i == j else rest / F.col(f"l{j}{j}"))
    det = reduce(lambda a, b: a + b, (2 * F.log(f"l{i}{i}") for i in range(p)))
    return est.select("key", "start", "n", det.alias("det"), *(f"m{i}" for i in range(p)), *(f"l{i}{j}" for i in range(p) for j in range(i + 1)))


def _distance(x: list[Column], est: Column) -> Column:
    y: list[Column] = []
    for i, v in enumerate(x):
        rest = reduce(lambda a, k: a - est[f"l{i}{k}"] * y[k], range(i), v - est[f"m{i}"])  # noqa: B023
        y.append(rest / est[f"l{i}{i}"])
    return reduce(lambda a, b: a + b, (v * v for v in y))


def _moments(rows: DataFrame, factor: float) -> DataFrame:
    """Mean and covariance of each (key, start); a statistic's variance is floored by adding the square of its floor."""
    p = len(STATS)
    sums = rows.groupBy("key", "start").agg(
        F.count("*").alias("n"),
        *(F.avg(f"x{i}").alias(f"m{i}") for i in range(p)),
        *(F.covar_pop(f"x{i}", f"x{j}").alias(f"v{i}{j}") for i in range(p) for j in range(i + 1)),
    )
    cov = [(factor * F.col(f"v{i}{j}") + (FLOORS[i] ** 2 if i == j else 0.0)).alias(f"c{i}{j}") for i in range(p) for j in range(i + 1)]
    return sums.select("key", "start", "n", *(f"m{i}" for i in range(p)), *cov)


def _gathered(sums: DataFrame, alone: bool) -> DataFrame:
    """Sums of few groups in one partition, so that nothing that follows deals them out again."""
    return sums.coalesce(1) if alone else sums


def _nearest(vectors: DataFrame, est: DataFrame, few: bool, share: float, alone: bool = False) -> DataFrame:
    """For each (key, start) of ``est`` the rows of ``vectors`` nearest to it: the fewest whole bins of distance with ``share`` of all.

    Bins are counts, so the cut is exact, bounded by the number of bins for any key, and the same on every run.
    """
    d = _distance([F.col(f"x{i}") for i in range(len(STATS))], F.col("e"))
    bin_ = F.greatest(F.lit(FIRST_BIN), F.floor(F.log(d + 1e-300) * BINS)).cast("int")
    far = _joined(vectors, est, few).where("e IS NOT NULL").select("key", F.col("e")["start"].alias("start"), *(f"x{i}" for i in range(len(STATS))), bin_.alias("bin"))
    order = Window.partitionBy("key", "start").orderBy("bin")
    seen = _gathered(far.groupBy("key", "start", "bin").count(), alone)
    seen = seen.withColumn("upto", F.sum("count").over(order)).withColumn("all", F.sum("count").over(Window.partitionBy("key", "start")))
    cut = seen.where(F.col("upto") >= share * F.col("all")).groupBy("key", "start").agg(F.min("bin").alias("cut"), F.max("all").alias("_n"))
    if few:
        return far.join(F.broadcast(cut.drop("_n")), ["key", "start"]).where("bin <= cut")
    cut = written(cut, "mcd-cut")
    return join_hot(far, cut, ["key", "start"], "_n", cut.agg(F.sum("_n")).first()[0] or 0).where("bin <= cut")


def mcd_estimates(vectors: DataFrame) -> DataFrame:
    """Minimum-covariance-determinant location and factor of each ``key``; ``vectors``: key, x0..x3.

    Three starts: 0 the mean and covariance of all rows, 1 the medians with the spread of the half around them, 2 the
    half of the rows nearest to start 1. A concentration step keeps the SUBSET share nearest to an estimate and
    estimates again; each start is led on until its determinant falls no more (every step but the last lowers it, so
    it ends), and each key takes the start that ends lowest. A step is two aggregates with partial sums, so a key
    that holds a third of the rows costs no more than any other.
    """
    p = len(STATS)
    tri = [(i, j) for i in range(p) for j in range(i + 1)]
    quartiles = (F.percentile_approx(f"x{i}", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 2000).alias(f"q{i}") for i in range(p))
    med = vectors.groupBy("key").agg(F.count("*").alias("n"), *quartiles)
    spread = lambda i: ((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349) ** 2 + FLOORS[i] ** 2
    med = med.select("key", F.lit(1).alias("start"), "n", *(F.col(f"q{i}")[1].alias(f"m{i}") for i in range(p)), *((spread(i) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in tri))
    est = written(_with_cholesky(med.unionByName(_moments(vectors.withColumn("start", F.lit(0)), 1.0))), "mcd")
    groups = est.count()
    few = groups <= MAX_BROADCAST_GROUPS
    alone = few and groups <= MAX_GATHERED
    half = _nearest(vectors, est.where("start = 1"), few, 0.5, alone).withColumn("start", F.lit(2))
    est = _swapped(est, _gathered(est.unionByName(_with_cholesky(_gathered(_moments(half, CONSISTENCY), alone))), alone))
    columns = [c for c in est.columns if c not in ("key", "start")]
    whole = lambda df, name: df.select("key", "start", F.struct(*columns).alias(name))
    step = lambda df: _with_cholesky(_gathered(_moments(_nearest(vectors, df, few, SUBSET, alone), CONSISTENCY), alone))
    state = written(whole(step(est), "e").withColumn("active", F.lit(True)), "mcd")
    while not state.where("active").isEmpty():
        active = state.where("active")
        both = whole(step(active.select("key", "start", "e.*")), "new").join(_gathered(active.select("key", "start", "e"), alone), ["key", "start"])
        falls = F.col("new.det") < F.col("e.det") - LEAST_FALL
        led = both.select("key", "start", F.when(falls, F.col("new")).otherwise(F.col("e")).alias("e"), falls.alias("active"))
        state = _swapped(state, _gathered(state.where("not active").unionByName(led), alone))
    lowest = F.min_by(F.struct("start", "e"), F.struct("e.det", "start")).alias("b")
    return state.groupBy("key").agg(lowest).select("key", "b.start", "b.e.*")


def _swapped(old: DataFrame, new: DataFrame) -> DataFrame:
    new = written(new, "mcd")
    dropped(old)
    return new


def _joined(rows: DataFrame, est: DataFrame, few: bool, name: str = "e") -> DataFrame:
    side = est.select("key", "n", F.struct("*").alias(name))
    if few:
        return rows.join(F.broadcast(side.drop("n")), "key", "left")
    return join_hot(rows, side.withColumnRenamed("n", "_n"), ["key"], "_n", est.agg(F.sum("n")).first()[0] or 0, "left")


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", carry: list[str] | None = None) -> DataFrame:
    """Every document with its statistics and verdict: ``_q`` struct, ``base_failed``, ``distance``, ``kept``.

    A document fails the base rules below 50 words or when more than half of its words repeat. Of the others,
    robust location and scatter are estimated per language and source (null is a value of its own), and a
    document is rejected when its squared Mahalanobis distance passes CUTOFF. A group with fewer than MIN_GROUP
    documents takes the estimate of its language, then of all; with too few in all, the base rules alone decide.
    Null text: no words, so it fails. Repeated rows are judged alike and all returned; other columns pass through
    (``carry`` names those to keep; all by default; names of this operator's own columns are replaced).
    """
    p, own = len(STATS), ["_q", "base_failed", "distance", "kept"]
    carry = [c for c in docs.columns if c not in own] if carry is None else carry
    table = text_stats(docs.select(F.struct(*carry).alias("_row"), F.col(text).alias("_t"), F.array(*_keys(lang, source)).alias("_k")), "_t")
    table = written(table.select("_row", "_q", F.array(*_vector(F.col("_q"))).alias("_x"), "_k"), "quality")
    failed = base_failed(F.col("_q"))
    vectors = table.where(~failed).select(F.explode("_k").alias("key"), *(F.col("_x")[i].alias(f"x{i}") for i in range(p)))
    est = mcd_estimates(vectors)
    est = written(est.select("key", "n", *(f"m{i}" for i in range(p)), *(f"l{i}{j}" for i in range(p) for j in range(i + 1))).join(vectors.groupBy("key").count().where(F.col("count") >= MIN_GROUP).select("key"), "key", "left_semi"), "mcd")
    few, levels = est.count() <= MAX_BROADCAST_GROUPS, range(3)
    out = table
    for level in levels:
        out = _joined(out.withColumn("key", F.col("_k")[level]), est, few, f"e{level}").drop("key")
    distance = _distance([F.col("_x")[i] for i in range(p)], F.col("e"))
    out = out.withColumn("e", F.coalesce(*(F.col(f"e{i}") for i in levels))).select("_row", "_q", failed.alias("base_failed"), distance.alias("distance"))
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= CUTOFF)
    return out.select(*(F.col("_row")[c].alias(c) for c in carry), "_q", "base_failed", "distance", kept.alias("kept"))


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Statistics and verdicts of all documents; null texts have no words and fail, repeated rows are each returned."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    out = quality_rules(docs, carry=["doc_id"])
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return out.select("doc_id", *(F.col("_q")[n].alias(n) for n in names), "base_failed", "kept")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the rules keep. Null texts go, repeated rows are judged alike, no rows give none."""
    return quality_rules(docs).where("kept").select(*docs.columns)
