"""The registered queries carry the cohorts that the whole pipeline carries."""

from tests.fixtures import CREW, member, members, post, posts
from tidewake.plans import analysis, pipeline

TABLES = {
    "feature_matrix": "ml_feature_matrix", "account_roles": "account_roles", "target_summary": "amplified_targets", "propagation": "cascade_propagation",
    "first_profiles": "first_retweeter_profiles",
}


def test_registered_queries_equal_the_pipeline(spark, tmp_path):
    # crew_b is a suspect by its cohort alone: top target under half, never first
    more = [post(300 + i, "crew_b", f"x{i}", f"other{i}", 600) for i in range(4)] + [post(310 + i, "early", f"x{i}", f"other{i}", 100) for i in range(4)]
    df = posts(spark, [*CREW, *more])
    people = members(spark, [member("source"), member("crew_b")])
    df.write.parquet(str(tmp_path / "tweets.parquet"))
    people.selectExpr("*", "'m1' as snapshot_id", "timestamp'2026-04-16' as loaded_at").write.parquet(str(tmp_path / "members.parquet"))
    sf = str(tmp_path)
    want = pipeline.analyse(df, people, with_ml=False)
    for name, table in TABLES.items():
        got, whole = analysis.QUERIES[name](spark, sf), analysis.shown(want[table])
        assert sorted(map(str, (r.asDict() for r in got.select(*whole.columns).collect()))) == sorted(map(str, (r.asDict() for r in whole.collect()))), name
    matrix = {r["account_handle"]: r for r in analysis.feature_matrix(spark, sf).collect()}
    assert (matrix["crew_a"]["cohort_count"], matrix["crew_a"]["cohort_max_size"], matrix["outsider"]["cohort_count"]) == (1, 3, 0)
    assert {r["original_tweet_id"]: r["cohort_ids"] for r in analysis.cohort_by_cascade(spark, sf).collect()} == {"o1": "1", "o2": "1", "o3": "1"}
    path = {r["original_tweet_id"]: r["steps"] for r in analysis.spread_path(spark, sf).collect()}
    assert path["o1"].split("|")[0] == "crew_a,0,1,1"
    roles = {r["account_handle"]: r for r in want["account_roles"].collect()}
    assert roles["crew_b"]["role_label"] == "amplifier_suspect" and "cohort_member(1)" in roles["crew_b"]["signals"]
    mix = {r["target"]: r["role_mix"] for r in analysis.role_mix(spark, sf).collect()}
    assert mix == {r["amplified_author_handle"]: r["captured_role_mix"] for r in want["amplified_targets"].collect()}
