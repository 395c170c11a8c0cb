"""Dataset statistics, cascades, their sources, tokens and amplification edges.

Inputs are posts with a unique ``row_id`` (capture order), which settles every tie
that input order would settle. A post with ``is_retweet`` is an amplification; all
amplifications of one ``content_tweet_id`` are a cascade, in order of (missing time
last, time, author, row_id). Posts are counted as they are captured.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUARTER_HOUR, HOUR = 900, 3600


def seconds(later: Column | str, earlier: Column | str) -> Column:
    """Elapsed seconds with fraction."""
    at = lambda c: F.unix_micros(F.col(c) if isinstance(c, str) else c)
    return (at(later) - at(earlier)) / F.lit(1_000_000)


def cascade_order() -> Column:
    return F.struct(F.col("posted_at").isNull().alias("untimed"), "posted_at", "author_handle", "row_id")


def dataset_stats(posts: DataFrame, members: DataFrame) -> DataFrame:
    """One row: counts of members, posts, active accounts, amplifications and originals
    (quotes are originals), the time span, and the active accounts no member list has."""
    totals = posts.agg(
        F.count(F.lit(1)).alias("tweet_count"),
        F.countDistinct("author_handle").alias("active_account_count"),
        F.count_if("is_retweet").alias("retweet_count"),
        F.min("posted_at").alias("date_start"),
        F.max("posted_at").alias("date_end"),
    )
    missing = posts.select(F.col("author_handle").alias("screen_name")).distinct().join(members, "screen_name", "left_anti")
    return totals.join(members.agg(F.count(F.lit(1)).alias("member_count")), F.lit(True)).join(
        missing.agg(F.count(F.lit(1)).alias("missing_member_count"), F.min("screen_name").alias("first_missing_member")), F.lit(True)
    ).select(
        "member_count", "tweet_count", "active_account_count", "retweet_count", (F.col("tweet_count") - F.col("retweet_count")).alias("original_count"),
        "date_start", "date_end", "missing_member_count", "first_missing_member",
    )


def missing_members(posts: DataFrame, members: DataFrame) -> DataFrame:
    """``(account_handle)``: accounts that post but are on no member list."""
    return posts.select(F.col("author_handle").alias("screen_name")).distinct().join(members, "screen_name", "left_anti").withColumnRenamed("screen_name", "account_handle")


def cascades(posts: DataFrame) -> DataFrame:
    """One row per original with amplifications.

    Fields of the original come from the first amplification. With an untimed
    amplification the last one has no time, so ``last_retweet_at`` and
    ``span_minutes`` are null. The 15 and 60 minute counts are inclusive and hold the
    first amplification.
    """
    boosts = posts.where("is_retweet")
    lead = F.struct(
        "content_author_handle", "content_created_at", "author_handle", F.array_distinct("hashtags").alias("hashtags"), F.array_distinct("mentions").alias("mentions"),
        F.trim(F.regexp_replace("content_text", "\n", " ")).alias("sample_text"),
    )
    grouped = boosts.groupBy("content_tweet_id").agg(
        F.min_by(lead, cascade_order()).alias("lead"),
        F.count(F.lit(1)).alias("retweet_count"),
        F.countDistinct("author_handle").alias("unique_retweeter_count"),
        F.min("posted_at").alias("first_retweet_at"),
        F.max("posted_at").alias("latest"),
        F.count("posted_at").alias("timed"),
    )
    starts = grouped.select("content_tweet_id", F.col("first_retweet_at").alias("started"))
    lag = seconds("posted_at", "started")
    early = (
        boosts.select("content_tweet_id", "posted_at")
        .join(starts, "content_tweet_id")
        .groupBy("content_tweet_id")
        .agg(F.count_if(lag <= QUARTER_HOUR).alias("retweets_within_15m"), F.count_if(lag <= HOUR).alias("retweets_within_60m"))
    )
    last = F.when(F.col("timed") == F.col("retweet_count"), F.col("latest"))
    return grouped.join(early, "content_tweet_id").select(
        F.col("content_tweet_id").alias("original_tweet_id"),
        F.col("lead.content_author_handle").alias("original_author_handle"),
        F.col("lead.content_created_at").alias("original_created_at"),
        "retweet_count",
        "unique_retweeter_count",
        F.col("lead.author_handle").alias("first_retweeter"),
        "first_retweet_at",
        last.alias("last_retweet_at"),
        F.floor(seconds(last, F.col("first_retweet_at")) / 60).alias("span_minutes"),
        "retweets_within_15m",
        "retweets_within_60m",
        F.col("lead.hashtags").alias("hashtags"),
        F.col("lead.mentions").alias("mentions"),
        F.col("lead.sample_text").alias("sample_text"),
    )


def first_amplifiers(posts: DataFrame) -> DataFrame:
    """``(original_tweet_id, first_retweeter)`` of every cascade, from the order's columns alone."""
    led = posts.where("is_retweet").groupBy(F.col("content_tweet_id").alias("original_tweet_id")).agg(F.min(cascade_order()).alias("o"))
    return led.select("original_tweet_id", F.col("o.author_handle").alias("first_retweeter"))


def cascade_accounts(posts: DataFrame) -> DataFrame:
    """``(original_tweet_id, account_handle, first)``: who amplified what, and when first
    (the order key). The relation behind every list of a cascade's accounts."""
    return (
        posts.where("is_retweet")
        .groupBy(F.col("content_tweet_id").alias("original_tweet_id"), F.col("author_handle").alias("account_handle"))
        .agg(F.min(cascade_order()).alias("first"))
    )


def retweeter_lists(accounts: DataFrame) -> DataFrame:
    """``(original_tweet_id, retweeters)`` in order of first appearance, for sinks."""
    entry = F.struct("first", "account_handle")
    return accounts.groupBy("original_tweet_id").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda s: s["account_handle"]).alias("retweeters"))


def source_cascades(casc: DataFrame, accounts: DataFrame) -> DataFrame:
    """Cascades rolled up to the source account; of equally large cascades the latest,
    then the one with the largest id, is the top one."""
    rank = F.struct("retweet_count", F.coalesce("first_retweet_at", "original_created_at").alias("at"), "original_tweet_id")
    rolled = casc.groupBy("original_author_handle").agg(
        F.sum("retweet_count").alias("total_retweet_count"),
        F.count(F.lit(1)).alias("unique_retweeted_tweet_count"),
        F.min("first_retweet_at").alias("first_retweet_at"),
        F.max("last_retweet_at").alias("last_retweet_at"),
        F.sum("retweets_within_15m").alias("total_retweets_within_15m"),
        F.sum("retweets_within_60m").alias("total_retweets_within_60m"),
        F.max(rank).alias("top"),
    )
    reach = (
        accounts.join(casc.select("original_tweet_id", "original_author_handle"), "original_tweet_id")
        .groupBy("original_author_handle")
        .agg(F.countDistinct("account_handle").alias("unique_retweeter_count"))
    )
    return rolled.join(reach, "original_author_handle").select(
        "original_author_handle", "total_retweet_count", "unique_retweeted_tweet_count", "unique_retweeter_count", "first_retweet_at", "last_retweet_at",
        "total_retweets_within_15m", "total_retweets_within_60m", F.col("top.original_tweet_id").alias("top_cascade_tweet_id"),
        F.col("top.retweet_count").alias("top_cascade_retweet_count"),
    )


def tokens(posts: DataFrame, token_type: str, samples: int = 10) -> DataFrame:
    """Frequency of every hashtag or mention over all posts, repeats within a post included;
    shown as first written; with the first accounts by name that used it."""
    if token_type not in ("hashtags", "mentions"):
        raise ValueError(f"no such token type: {token_type}")
    pair = F.arrays_zip(F.col(token_type).alias("token"), F.col(f"{token_type}_raw").alias("raw"))
    both = F.least(F.size(token_type), F.size(f"{token_type}_raw"))
    used = (
        posts.select("row_id", "author_handle", both.alias("both"), F.posexplode(pair).alias("pos", "t"))
        .where("pos < both")
        .select(F.col("t.token").alias("token"), F.col("t.raw").alias("raw"), "author_handle", F.struct("row_id", "pos").alias("seen"))
    )
    by_account = used.groupBy("token", "author_handle").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("seen", "raw")).alias("first"))
    # the row number's limit is applied before the shuffle, so a popular token keeps few accounts per task
    first_names = by_account.withColumn("k", F.row_number().over(Window.partitionBy("token").orderBy("author_handle"))).where(F.col("k") <= samples)
    names = first_names.groupBy("token").agg(F.array_sort(F.collect_list("author_handle")).alias("sample_accounts"))
    counts = by_account.groupBy("token").agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique_account_count"), F.min("first").alias("first"))
    return counts.join(names, "token").select("token", F.col("first.raw").alias("display_token"), "count", "unique_account_count", "sample_accounts")


def amplifier_edges(posts: DataFrame) -> DataFrame:
    """``(retweeter, source_author, count)``."""
    return (
        posts.where("is_retweet")
        .groupBy(F.col("author_handle").alias("retweeter"), F.col("content_author_handle").alias("source_author"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
