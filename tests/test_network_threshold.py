"""The registered network queries run on the pipeline's default threshold."""

import inspect

from tests.fixtures import member, members, post, posts
from tidewake.plans import analysis, pipeline


def test_network_queries_take_pairs_with_two_shared_originals(spark, tmp_path):
    # a and b share two originals, c and d share five, e and f one
    data, i = [], 0
    for pair, shared in (("ab", 2), ("cd", 5), ("ef", 1)):
        for o in range(shared):
            for k, who in enumerate(pair):
                i += 1
                data.append(post(i, who, f"{pair}{o}", "s", 10 * o + k))
    posts(spark, data).write.parquet(str(tmp_path / "tweets.parquet"))
    people = members(spark, [member("s")]).selectExpr("*", "'m1' as snapshot_id", "current_timestamp() as loaded_at")
    people.write.parquet(str(tmp_path / "members.parquet"))
    sf = str(tmp_path)
    assert analysis.MIN_SHARED == inspect.signature(pipeline.analyse).parameters["min_shared"].default
    assert {r["account_handle"] for r in analysis.overlap_nodes(spark, sf).collect()} == {"a", "b", "c", "d"}
    assert sorted(r["total_shared_retweets"] for r in analysis.overlap_components(spark, sf).collect()) == [2, 5]
    assert {r["account_handle"] for r in analysis.k_core(spark, sf).collect()} == {"a", "b", "c", "d"}
