"""Cohorts: accounts that amplify the same originals closely together, again and again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.operators.cascade import seconds
from tidewake.operators.propagation import hhi, median_floor
from tidewake.operators.ranking import numbered
from tidewake.session import Stage

ROUNDS = 40


def tight_edges(overlaps: DataFrame, min_shared: int = 2, min_tight: int = 2) -> DataFrame:
    """``(a, b, w)`` of the pairs with enough shared originals and enough close ones, weighted
    4, 2 and 1 for 15 minutes, 60 minutes and any time."""
    kept = overlaps.where((F.col("shared_retweets") >= min_shared) & (F.col("shared_within_15m") + F.col("shared_within_60m") >= min_tight))
    weight = 4 * F.col("shared_within_15m") + 2 * F.col("shared_within_60m") + F.col("shared_retweets")
    return kept.select(F.least("account_a", "account_b").alias("a"), F.greatest("account_a", "account_b").alias("b"), weight.alias("w")).groupBy("a", "b").agg(F.sum("w").alias("w"))


def closest_edges(overlaps: DataFrame, min_tight: int = 2) -> DataFrame:
    """``(a, b, w)`` of pairs that are close in time, whatever they share in all."""
    close = (F.col("shared_within_15m") >= 2) | (F.col("shared_within_60m") >= max(3, min_tight + 1))
    return overlaps.where(close).select(
        F.least("account_a", "account_b").alias("a"), F.greatest("account_a", "account_b").alias("b"), (4 * F.col("shared_within_15m") + 2 * F.col("shared_within_60m")).alias("w")
    )


def _half_round(both: DataFrame, labels: DataFrame, moves: Column) -> DataFrame:
    """``labels (n, label, moved)`` after the accounts that ``moves`` picks looked around once."""
    current = labels.select("n", "label")
    votes = both.withColumnRenamed("a", "n").where(moves).join(current.withColumnsRenamed({"n": "b", "label": "vote"}), "b").groupBy("n", "vote").agg(F.sum("w").alias("w"))
    own = votes.join(current, "n")
    # heaviest first; of those the account's own label, else the smallest
    place = F.struct((-F.col("w")).alias("w"), (F.col("vote") != F.col("label")).alias("other"), "vote")
    best = own.groupBy("n").agg(F.min(place).alias("p")).where("p.other").select("n", F.col("p.vote").alias("to"))
    return labels.join(best, "n", "left").select("n", F.coalesce("to", "label").alias("label"), (F.col("moved") | F.col("to").isNotNull()).alias("moved"))


def label_communities(stage: Stage, edges: DataFrame, seed: int = 42) -> DataFrame:
    """``(account_handle, label)`` by weighted label propagation over edges ``(a, b, w)``.

    In each round every account looks at its neighbours' labels and takes the heaviest
    one; it keeps its own if that is among the heaviest, else takes the smallest. One
    seeded half of the accounts moves, then the other, so that neighbours don't swap
    labels for ever; the halves are drawn anew each round; a round without a move, or
    round ``ROUNDS``, ends it. The sequential form of the method visits accounts one by
    one, which only one machine can do; labels can differ from it where votes tie. An
    account's half depends on the md5 of its handle, seed and round, so SQL can repeat it.
    """
    live = edges.where((F.col("w") > 0) & F.col("a").isNotNull() & F.col("b").isNotNull())
    both = stage.cut(live.select("a", "b", "w").unionAll(live.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "w")))
    labels = stage.cut(both.select(F.col("a").alias("n"), F.col("a").alias("label")).distinct())
    for turn in range(ROUNDS):
        early = F.md5(F.concat_ws(":", "n", F.lit(seed), F.lit(turn))) < "8"
        still = labels.select("n", "label", F.lit(False).alias("moved"))
        following, moved = stage.cut_counting(_half_round(both, _half_round(both, still, early), ~early), "moved")
        stage.drop(labels)
        labels = following
        if not moved:
            break
    return labels.select(F.col("n").alias("account_handle"), "label")


def communities(overlaps: DataFrame, seed: int = 42, min_shared: int = 2, min_size: int = 3, min_tight: int = 2) -> DataFrame:
    """``(account_handle, community)``, each account in one. Communities above
    ``max(6 * min_size, 18)`` are split once more on their closest edges; what no part
    of two or more holds stays together."""
    stage = Stage(overlaps.sparkSession)
    edges = stage.cut(tight_edges(overlaps, min_shared, min_tight))
    if not edges.limit(1).count():
        edges = stage.cut(tight_edges(overlaps, max(min_shared, 3), 1))
    first = stage.cut(label_communities(stage, edges, seed))
    large = first.groupBy("label").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > max(6 * min_size, 18)).select("label")
    inside = first.join(large, "label")
    a = inside.select(F.col("account_handle").alias("a"), F.col("label").alias("la"))
    b = inside.select(F.col("account_handle").alias("b"), F.col("label").alias("lb"))
    sub = stage.cut(closest_edges(overlaps, min_tight).join(a, "a").join(b, "b").where("la = lb").select("a", "b", "w"))
    if not sub.limit(1).count():
        return first.select("account_handle", F.concat(F.lit("0:"), "label").alias("community"))
    again = stage.cut(label_communities(stage, sub, seed).withColumnRenamed("label", "part"))
    kept = again.join(again.groupBy("part").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("part"), "part")
    name = F.when(F.col("part").isNotNull(), F.concat(F.lit("1:"), "part")).otherwise(F.concat(F.lit("0:"), "label"))
    return first.join(kept, "account_handle", "left").select("account_handle", name.alias("community"))


def cohorts(
    casc: DataFrame, accounts: DataFrame, groups: DataFrame, nodes: DataFrame, min_size: int = 3, min_cascades: int = 2, max_tightness_sec: int | None = None
) -> DataFrame:
    """Communities with enough members and enough cascades that enough members took part
    in, with their timing, targets and score, numbered from 1 by falling score.

    Ties for the top target and top cascade go to the smaller name.
    """
    sizes = groups.groupBy("community").agg(F.count(F.lit(1)).alias("m"), F.array_sort(F.collect_list("account_handle")).alias("members")).where(F.col("m") >= min_size)
    present = accounts.join(groups, "account_handle").groupBy("community", "original_tweet_id").agg(F.count(F.lit(1)).alias("here"))
    threshold = F.greatest(F.lit(2), F.least(F.ceil(F.log(F.greatest("m", F.lit(2))) + 1), F.ceil(F.col("m") * 0.3), F.lit(4)))
    span = F.floor(F.greatest(seconds("last_retweet_at", "first_retweet_at").cast("bigint"), F.lit(0)) / F.greatest(F.col("retweet_count") - 1, F.lit(1)))
    chosen = (
        present.join(sizes.select("community", "m"), "community")
        .where(F.col("here") >= threshold)
        .join(casc, "original_tweet_id")
        .select("community", "original_tweet_id", "original_author_handle", "here", "m", span.alias("tightness"))
    )
    timed = chosen.groupBy("community").agg(
        F.count(F.lit(1)).alias("cascade_count"), median_floor(F.col("tightness")).alias("median_time_tightness_sec"), F.max(F.struct("here", "m")).alias("most"),
        F.min(F.struct((-F.col("here")).alias("h"), "original_tweet_id")).alias("top"),
    )
    targets = chosen.groupBy("community", "original_author_handle").agg(F.count(F.lit(1)).alias("n"))
    aims = targets.groupBy("community").agg(F.count(F.lit(1)).alias("unique_targets"), F.min(F.struct((-F.col("n")).alias("n"), "original_author_handle")).alias("t"))
    homes = groups.join(nodes, "account_handle").groupBy("community").agg(F.array_sort(F.collect_set("component_id")).alias("component_ids"))
    rows = sizes.join(timed, "community").join(aims, "community").join(hhi(targets, "community"), "community").join(homes, "community", "left")
    rows = rows.where(F.col("cascade_count") >= min_cascades)
    if max_tightness_sec is not None:
        rows = rows.where(F.coalesce(F.col("median_time_tightness_sec") <= max_tightness_sec, F.lit(True)))
    closeness = F.coalesce(F.greatest(F.lit(0.0), 20 - F.least("median_time_tightness_sec", F.lit(3600)) / 180), F.lit(0.0))
    score = F.round(4 * F.log1p("m") + 6 * F.log1p("cascade_count") + 25 * F.col("hhi") + closeness, 4)
    rows = rows.withColumn("cohort_score", score)
    rows = numbered(rows, [F.desc("cohort_score"), F.desc("m"), F.desc("cascade_count"), F.col("members")[0]], "cohort_id")
    return rows.select(
        "cohort_id", F.col("m").alias("member_count"), "cascade_count", "median_time_tightness_sec",
        F.round("hhi", 4).alias("target_concentration_hhi"), F.col("t.original_author_handle").alias("top_target_author"), (-F.col("t.n")).alias("top_target_count"),
        "unique_targets", F.coalesce("component_ids", F.array().cast("array<bigint>")).alias("component_ids"), "members",
        F.col("top.original_tweet_id").alias("top_cascade_tweet_id"), F.round(-F.col("top.h") / F.col("m"), 4).alias("top_cascade_member_share"), "cohort_score",
    )


def cohorts_by_account(coh: DataFrame) -> DataFrame:
    """``(account_handle, cohort_ids)``, ids ascending."""
    return coh.select("cohort_id", F.explode("members").alias("account_handle")).groupBy("account_handle").agg(F.array_sort(F.collect_list("cohort_id")).alias("cohort_ids"))


def cohorts_by_cascade(members: DataFrame, accounts: DataFrame) -> DataFrame:
    """``(original_tweet_id, cohort_ids)`` of the cohorts with two members and a fifth of
    their members (rounded down) in the cascade; ``members`` is ``(cohort_id, account_handle)``."""
    sizes = members.groupBy("cohort_id").agg(F.count(F.lit(1)).alias("size"))
    here = accounts.join(members, "account_handle").groupBy("original_tweet_id", "cohort_id").agg(F.count(F.lit(1)).alias("n"))
    enough = here.join(sizes, "cohort_id").where(F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("size") * 0.2)))
    return enough.groupBy("original_tweet_id").agg(F.array_sort(F.collect_list("cohort_id")).alias("cohort_ids"))
