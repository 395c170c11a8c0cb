"""Accounts of a burst window are counted exactly on a table."""

from tests.fixtures import post, posts
from tidewake.plans import analysis


def test_accounts_of_a_window_are_exact(spark, tmp_path):
    data = [post(i, f"u{i % 3000}", "o1", "s", 1) for i in range(4000)] + [post(5000, "u1", "o2", "s", 20)]
    posts(spark, data).write.parquet(str(tmp_path / "tweets.parquet"))
    got = {r["content_tweet_id"]: (r["amplifications"], r["accounts"]) for r in analysis.burst_windows(spark, str(tmp_path)).collect()}
    assert got == {"o1": (4000, 3000), "o2": (1, 1)}
