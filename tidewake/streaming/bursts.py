"""Amplification bursts on a stream of posts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def burst_counts(posts: DataFrame, window: str = "15 minutes", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """``(window_start, window_end, content_tweet_id, amplifications, accounts)`` per event-time window.

    Works on a stream and on a table alike. Amplifications up to ``late`` behind the
    newest are still counted; state older than that is let go. Posts without a
    time are in no window. ``accounts`` is exact on a table; on a stream it is
    approximate (a mergeable sketch), so that a window's state stays small however
    popular an original is.
    """
    boosts = posts.where("is_retweet and posted_at is not null").withWatermark("posted_at", late)
    span = F.window("posted_at", window, slide) if slide else F.window("posted_at", window)
    if posts.isStreaming:
        counted = boosts.groupBy(span.alias("w"), "content_tweet_id").agg(F.count(F.lit(1)).alias("amplifications"), F.approx_count_distinct("author_handle").alias("accounts"))
    else:
        each = boosts.groupBy(span.alias("w"), "content_tweet_id", "author_handle").agg(F.count(F.lit(1)).alias("n"))
        counted = each.groupBy("w", "content_tweet_id").agg(F.sum("n").alias("amplifications"), F.count("author_handle").alias("accounts"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "content_tweet_id", "amplifications", "accounts")
