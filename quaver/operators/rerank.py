"""Display policies over a ranked list of candidates (rank, id, similarity, artist)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

POLICY = "artist-spread-v1"
MAX_CANDIDATES = 64


def artist_spread(candidates: DataFrame, limit: int, mode: str = "more-artists") -> DataFrame:
    """The first candidate of each artist in rank order, then the others in rank order, up to ``limit``.

    ``closest`` keeps the ranking. Adds selection and display_rank. Candidates are at most MAX_CANDIDATES.
    """
    if mode not in ("closest", "more-artists") or not 1 <= limit <= 20:
        raise ValueError("Unsupported display policy")
    nth = F.row_number().over(Window.partitionBy("artist").orderBy("rank"))
    later = (nth > 1) if mode == "more-artists" else F.lit(False)
    reason = F.lit("source-ranking") if mode == "closest" else F.when(F.col("later"), "backfill").otherwise("first-of-artist")
    chosen = candidates.withColumn("later", later).orderBy("later", "rank").limit(limit)
    shown = F.row_number().over(Window.orderBy("later", "rank"))
    return chosen.withColumn("selection", reason).withColumn("display_rank", shown).drop("later")


def spread_diagnostics(candidates: DataFrame, selected: DataFrame, limit: int) -> DataFrame:
    """One row: artists and mean similarity before and after, how many stay, the deepest rank shown."""
    before = candidates.filter(F.col("rank") <= limit)
    a = before.agg(F.countDistinct("artist").alias("artists_before"), F.avg("similarity").alias("mean_before"))
    b = selected.agg(
        F.countDistinct("artist").alias("artists_after"),
        F.avg("similarity").alias("mean_after"),
        F.count_if(F.col("rank") <= limit).alias("kept"),
        F.max("rank").alias("max_rank"),
    )
    return a.crossJoin(b).withColumn("drop", F.col("mean_before") - F.col("mean_after"))  # one row each


def contract_problems(candidates: DataFrame) -> DataFrame:
    """Candidates that break the contract: unique ids, ranks 1, 2, ..., falling similarity within +-1.00001."""
    by_rank = Window.orderBy("rank")  # a bounded list
    by_id = Window.partitionBy("id")
    checked = (
        candidates.withColumn("at", F.row_number().over(by_rank))
        .withColumn("before", F.lag("similarity").over(by_rank))
        .withColumn("same", F.count("*").over(by_id))
    )
    bad = (
        (F.col("at") > MAX_CANDIDATES)
        | (F.col("rank") != F.col("at"))
        | (F.col("same") > 1)
        | F.isnan("similarity")
        | (F.abs("similarity") > 1.00001)
        | F.coalesce(F.col("similarity") > F.col("before"), F.lit(False))
        | (F.coalesce("artist", F.lit("")) == "")
    )
    return checked.filter(F.coalesce(bad, F.lit(True))).select("rank", "id")


def nearest_rank(values: DataFrame, column: str, q: float) -> DataFrame:
    return values.agg(F.expr(f"percentile_disc({q}) within group (order by {column})").alias("quantile"))


def reply_problems(replies: DataFrame, k: int) -> DataFrame:
    """(query, rank, id, problem) of replies (query, rank, id, similarity) that break the contract, by the first rule.

    At most k to a query, unique ids, finite similarities within +-1.00001 that don't rise with the rank.
    """
    by_rank = Window.partitionBy("query").orderBy("rank")
    checked = replies.withColumn("at", F.row_number().over(by_rank)).withColumn("before", F.lag("similarity").over(by_rank)).withColumn("same", F.count("*").over(Window.partitionBy("query", "id")))
    problem = (
        F.when(F.col("at") > k, "over k")
        .when(F.col("id").isNull() | (F.col("same") > 1), "repeated")
        .when(F.col("similarity").isNull() | F.isnan("similarity") | (F.abs("similarity") > 1.00001), "out of range")
        .when(F.col("similarity") > F.col("before"), "rising")
    )
    return checked.select("query", "rank", "id", problem.alias("problem")).filter("problem is not null")
