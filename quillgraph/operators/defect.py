"""Where a defect came from: manifestations, introduction votes, outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import budget


def manifestations(parent: DataFrame, fix: DataFrame) -> DataFrame:
    """(id) of symbols of the fix's parent whose body differs at the fix or that are gone; new ones don't count."""
    was, now = parent.select("id", F.col("body").alias("was")), fix.select("id", "body")
    return was.join(now, "id", "left").where(F.col("body").isNull() | (F.col("body") != F.col("was"))).select("id")


def introduction_votes(history: DataFrame, limit: int = budget.HISTORY) -> DataFrame:
    """(case, id, rank) of the commit each manifesting symbol votes for.

    ``history``: case, id, rank (0: the fix's parent, older are greater), body (null: absent). The first older commit
    where the body differs from rank 0 settles it, and the vote goes to the commit just newer. Unsettled: no row.
    """
    h = history.where(F.col("rank") <= limit)
    now = h.where("rank = 0").select("case", "id", F.col("body").alias("now"))
    settled = h.where("rank > 0").join(now, ["case", "id"]).where(~F.col("body").eqNullSafe(F.col("now")))
    return settled.groupBy("case", "id").agg(F.min("rank").alias("at")).select("case", "id", (F.col("at") - 1).alias("rank"))


def winners(votes: DataFrame, commits: DataFrame) -> DataFrame:
    """(case, commit, votes, cast, majority, strict, percent): most votes, ties to the smallest commit id."""
    n = votes.join(commits.select("case", "rank", "commit"), ["case", "rank"]).groupBy("case", "commit").agg(F.count("*").alias("votes"))
    best = n.withColumn("place", F.row_number().over(Window.partitionBy("case").orderBy(F.desc("votes"), "commit")))
    cast = n.groupBy("case").agg(F.sum("votes").alias("cast"))
    out = best.where("place = 1").join(cast, "case")
    return out.select("case", "commit", "votes", "cast", (2 * F.col("votes") >= F.col("cast")).alias("majority"), (2 * F.col("votes") > F.col("cast")).alias("strict"), F.floor(100 * F.col("votes") / F.col("cast")).cast("long").alias("percent"))


def unsettled(history: DataFrame, votes: DataFrame, limit: int = budget.HISTORY) -> DataFrame:
    """(case, walked) of cases where no symbol settled: how many commits were looked at before history or budget ended."""
    walked = history.where(F.col("rank") <= limit).groupBy("case").agg(F.max("rank").cast("long").alias("walked"))
    return walked.join(votes.select("case").distinct(), "case", "left_anti")


def outcome(cases: DataFrame) -> DataFrame:
    """(case, outcome) from counts has_parent, changed, recognised, readable, symbols, settled."""
    kind = (
        F.when(~F.col("has_parent"), "no_semantic_change")
        .when(F.col("recognised") == 0, "outside_code")
        .when(F.col("readable") == 0, "no_extractor")
        .when(F.col("symbols") == 0, "no_semantic_change")
        .when(F.col("settled") == 0, "history_budget")
        .otherwise("bound")
    )
    return cases.select("case", kind.alias("outcome"))


def summary(won: DataFrame, cases: DataFrame) -> DataFrame:
    """One row: attempted, bound, majority, strict, uncapturable."""
    c = cases.select("case").distinct().join(won, "case", "left")
    return c.agg(
        F.count("*").alias("attempted"), F.count("commit").alias("bound"), F.count_if("majority").alias("majority"), F.count_if("strict").alias("strict"), F.count_if(F.col("commit").isNull()).alias("uncapturable"),
    )
