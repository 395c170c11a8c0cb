"""Account pairs that amplify the same originals, and the network they form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewake.operators.cascade import HOUR, QUARTER_HOUR, cascade_order
from tidewake.operators.ranking import numbered
from tidewake.session import Stage


#: Accounts of an original that meet in one block; an original with more is split into pairs of blocks.
BLOCK_ACCOUNTS = 1000


def account_overlap(posts: DataFrame, min_shared: int = 2, block: int = BLOCK_ACCOUNTS) -> DataFrame:
    """Pairs that share ``min_shared`` originals or more, with rounded Jaccard and the
    numbers of amplification pairs at most 15 and 60 minutes apart.

    Pairs are made of amplifications, so an account that amplified an original twice
    is paired with itself. Accounts with fewer originals than ``min_shared`` can be in
    no such pair and leave before the self-join; the others are numbered in order of
    their handles, so that pairs are two numbers. An original's accounts are dealt into
    blocks of about ``block`` by account; every two blocks meet in a group of their own,
    so no task holds all pairs of a popular original, and two accounts meet once per
    original. Rows without an account or an original belong to no pair.
    """
    stage = Stage(posts.sparkSession)
    boosts = posts.where("is_retweet and author_handle is not null and content_tweet_id is not null").select(
        F.col("content_tweet_id").alias("o"), F.col("author_handle").alias("h"), F.unix_micros("posted_at").alias("t"), "row_id"
    )
    again = Window.partitionBy("o", "h").orderBy("row_id")
    rows = stage.cut(boosts.select("o", "h", "t", F.row_number().over(again).alias("r")))
    sizes = rows.where("r = 1").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_shared)
    able = numbered(sizes, [F.col("h")], "id")
    kept = stage.cut(rows.join(able.select("h", "id"), "h").select("o", "id", "t", "r"))
    crowds = kept.groupBy("o").agg(F.count(F.lit(1)).alias("m"))
    crowds = crowds.where("m > 1").select("o", F.ceil(F.col("m") / F.lit(block)).cast("int").alias("parts"))
    placed = kept.join(crowds, "o").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    left = placed.select("o", F.col("part").alias("i"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("j"), *[F.col(c).alias("l" + c) for c in ("id", "t", "r")])
    right = placed.select("o", F.explode(F.sequence(F.lit(0), "part")).alias("i"), F.col("part").alias("j"), *[F.col(c).alias("r" + c) for c in ("id", "t", "r")])
    own = F.col("lid") == F.col("rid")
    once = (F.col("i") < F.col("j")) | (F.col("lid") < F.col("rid")) | (own & (F.col("lr") < F.col("rr")))
    lag = F.abs(F.col("lt") - F.col("rt"))
    near = lambda s: F.count_if(lag <= s * 1_000_000)
    first = (F.col("lr") == 1) & (F.col("rr") == F.when(own, 2).otherwise(1))
    pairs = (
        left.join(right, ["o", "i", "j"])
        .where(once)
        .groupBy(F.least("lid", "rid").alias("a"), F.greatest("lid", "rid").alias("b"))
        .agg(F.count_if(first).alias("shared_retweets"), near(QUARTER_HOUR).alias("shared_within_15m"), near(HOUR).alias("shared_within_60m"))
        .where(F.col("shared_retweets") >= min_shared)
    )
    side = lambda x: able.select(F.col("id").alias(x), F.col("h").alias(f"account_{x}"), F.col("n").alias(f"{x}n"))
    union = F.when(F.col("a") == F.col("b"), F.col("an")).otherwise(F.col("an") + F.col("bn") - F.col("shared_retweets"))
    return (
        pairs.join(side("a"), "a")
        .join(side("b"), "b")
        .select("account_a", "account_b", "shared_retweets", F.round(F.col("shared_retweets") / union, 4).alias("jaccard"), "shared_within_15m", "shared_within_60m")
    )


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, root)``: the smallest node reachable, by alternating large-star and
    small-star steps on checkpointed edges until they stand still.

    Every node gets linked to the smallest node of its surroundings; the number of
    edges never grows, and no step gathers a node's neighbours into one row.
    """
    stage = Stage(edges.sparkSession)
    nodes = edges.select(F.col(a).alias("node")).unionAll(edges.select(F.col(b).alias("node"))).where("node is not null").distinct()
    links = stage.cut(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    def state(df: DataFrame) -> tuple:
        """Size and digest of the links, to see when they stand still."""
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first())

    before = state(links)
    while before[0]:
        both = links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = stage.cut(both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.where("u <> m").select("u", F.col("m").alias("v"))).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v"))).distinct()
        following = stage.cut(small)
        stage.drop(large, links)
        links, now = following, state(following)
        if now == before:
            break
        before = now
    return nodes.join(links.withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("v", "node").alias("root"))


def overlap_network(overlaps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, components) of the overlap graph.

    Component ids count from 1 by falling size, then by smallest handle. A pair of an
    account with itself adds twice to its weighted degree and once to its neighbours. Of
    equally strong neighbours the largest handle is the strongest.
    """
    stage = Stage(overlaps.sparkSession)
    edges = stage.cut(overlaps.select("account_a", "account_b", "shared_retweets", "shared_within_15m", "shared_within_60m"))
    root = stage.cut(components(edges, "account_a", "account_b"))
    sides = edges.select(F.col("account_a").alias("node"), F.col("account_b").alias("other"), "shared_retweets", "shared_within_15m", "shared_within_60m").unionAll(
        edges.select(F.col("account_b"), F.col("account_a"), "shared_retweets", "shared_within_15m", "shared_within_60m")
    )
    per_node = sides.groupBy("node").agg(
        F.countDistinct("other").alias("neighbor_count"),
        F.sum("shared_retweets").alias("weighted_degree"),
        F.sum("shared_within_15m").alias("within_15m_weight"),
        F.sum("shared_within_60m").alias("within_60m_weight"),
        F.max(F.struct("shared_retweets", "other")).alias("best"),
    )
    ranked = root.groupBy("root").agg(F.count(F.lit(1)).alias("component_size"))
    ids = stage.cut(numbered(ranked, [F.desc("component_size"), F.col("root")], "component_id"))
    nodes = stage.cut(
        per_node.join(root, "node").join(ids, "root").select(
            F.col("node").alias("account_handle"), "component_id", "component_size", "neighbor_count", "weighted_degree", "within_15m_weight", "within_60m_weight",
            F.col("best.other").alias("strongest_neighbor"), F.col("best.shared_retweets").alias("max_shared_edge"),
        )
    )
    home = nodes.select(F.col("account_handle").alias("account_a"), "component_id")
    totals = edges.join(home, "account_a").groupBy("component_id").agg(
        F.count(F.lit(1)).alias("edge_count"),
        F.sum("shared_retweets").alias("total_shared_retweets"),
        F.sum("shared_within_15m").alias("total_within_15m"),
        F.sum("shared_within_60m").alias("total_within_60m"),
    )
    order = Window.partitionBy("component_id").orderBy(F.desc("weighted_degree"), F.desc("neighbor_count"), "account_handle")
    top = (
        nodes.withColumn("k", F.row_number().over(order))
        .where("k <= 10")
        .groupBy("component_id", F.col("component_size").alias("node_count"))
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "account_handle"))), lambda s: s["account_handle"]).alias("top_accounts"))
    )
    n = F.col("node_count")
    density = F.when(n > 1, F.round(2 * F.col("edge_count") / (n * (n - 1)), 4)).otherwise(0.0)
    parts = top.join(totals, "component_id").select(
        "component_id", "node_count", "edge_count", density.alias("density"), "total_shared_retweets", "total_within_15m", "total_within_60m", "top_accounts"
    )
    return nodes, parts


def k_core(edges: DataFrame, k: int = 3, weight: str = "shared_within_15m") -> DataFrame:
    """``(account_handle, core_rank)``: the largest threshold, up to ``k + 1``, at which the
    account stays when accounts of smaller weighted degree are pruned repeatedly.

    All thresholds are pruned at once: an account's rank starts at ``k + 1`` and falls to
    the largest threshold that the weight of its links to accounts of that rank or more
    still reaches, round by round, until nothing falls. A round is one job over the
    links, which sums per account before anything is shuffled.
    """
    stage = Stage(edges.sparkSession)
    kept = edges.where(F.col(weight) > 0).select(F.col("account_a").alias("a"), F.col("account_b").alias("b"), F.col(weight).alias("w"))
    # a pair with itself weighs once
    links = stage.cut(kept.unionAll(kept.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "w")))
    ranks = stage.cut(links.select(F.col("a").alias("account_handle")).distinct().withColumn("core_rank", F.lit(k + 1).cast("bigint")))
    levels = range(1, k + 2)
    while True:
        met = links.join(ranks.withColumnsRenamed({"account_handle": "b", "core_rank": "other"}), "b")
        reached = met.groupBy("a").agg(*[F.sum(F.when(F.col("other") >= level, F.col("w")).otherwise(0)).alias(f"d{level}") for level in levels])
        holds = F.greatest(F.lit(0), *[F.when(F.col(f"d{level}") >= level, level).otherwise(0) for level in levels])
        fallen = F.least("core_rank", holds).cast("bigint")
        now = ranks.join(reached.withColumnRenamed("a", "account_handle"), "account_handle").select(
            "account_handle", fallen.alias("core_rank"), (fallen < F.col("core_rank")).alias("fell")
        )
        following, fell = stage.cut_counting(now, "fell")
        stage.drop(ranks)
        ranks = following.select("account_handle", "core_rank")
        if not fell:
            return ranks
