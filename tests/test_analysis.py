import itertools
import random

import pytest
from pyspark.sql import functions as F

from tests.fixtures import CREW, member, members, post, posts
from tidewake.operators import account, cascade, cohort, overlap
from tidewake.operators import propagation as prop


def rows(df, *order):
    return [r.asDict(recursive=True) for r in (df.orderBy(*order) if order else df).collect()]


def test_one_cascade(spark):
    df = posts(spark, [post(1, "alice", "o1", "src", 0), post(2, "bob", "o1", "src", 5), post(3, "carol", "o1", "src", 80)])
    (c,) = rows(cascade.cascades(df))
    assert (c["first_retweeter"], c["retweets_within_15m"], c["retweets_within_60m"], c["span_minutes"]) == ("alice", 2, 2, 80)


def test_untimed_amplification_is_last_and_clears_the_end(spark):
    df = posts(spark, [post(1, "zoe", "o1", "src", None), post(2, "bob", "o1", "src", 5)])
    (c,) = rows(cascade.cascades(df))
    assert (c["first_retweeter"], c["last_retweet_at"], c["span_minutes"], c["retweet_count"], c["retweets_within_15m"]) == ("bob", None, None, 2, 1)


def test_sources_roll_up(spark):
    df = posts(spark, [post(1, "alice", "o1", "a", 0), post(2, "bob", "o1", "a", 1), post(3, "carol", "o2", "a", 2), post(4, "dave", "o3", "b", 3)])
    got = {r["original_author_handle"]: r for r in rows(cascade.source_cascades(cascade.cascades(df), cascade.cascade_accounts(df)))}
    a = got["a"]
    assert (a["total_retweet_count"], a["unique_retweeted_tweet_count"], a["unique_retweeter_count"], a["top_cascade_tweet_id"], a["top_cascade_retweet_count"]) == (3, 2, 3, "o1", 2)


def test_tokens(spark):
    df = posts(spark, [post(1, "alice", boost=False, tags=["Go", "go"]), post(2, "bob", "o", "s", tags=["GO"])])
    (t,) = rows(cascade.tokens(df, "hashtags"))
    assert t == {"token": "go", "display_token": "Go", "count": 3, "unique_account_count": 2, "sample_accounts": ["alice", "bob"]}
    with pytest.raises(ValueError):
        cascade.tokens(df, "links")


def brute_overlap(data, least):
    by, sets, shared, w15, w60 = {}, {}, {}, {}, {}
    for r in data:
        if r["is_retweet"]:
            by.setdefault(r["content_tweet_id"], []).append(r)
            sets.setdefault(r["author_handle"], set()).add(r["content_tweet_id"])
    for o, items in by.items():
        for x, y in itertools.combinations(items, 2):
            k = tuple(sorted((x["author_handle"], y["author_handle"])))
            shared.setdefault(k, set()).add(o)
            if x["posted_at"] and y["posted_at"]:
                lag = abs((x["posted_at"] - y["posted_at"]).total_seconds())
                w15[k] = w15.get(k, 0) + (lag <= 900)
                w60[k] = w60.get(k, 0) + (lag <= 3600)
    return {k: (len(v), round(len(v) / len(sets[k[0]] | sets[k[1]]), 4), w15.get(k, 0), w60.get(k, 0)) for k, v in shared.items() if len(v) >= least}


def test_overlap_against_brute_force(spark):
    rng = random.Random(3)
    data = [post(i, f"u{rng.randrange(6)}", f"o{rng.randrange(8)}", "s", rng.choice([None, *range(0, 200, 7)])) for i in range(70)]
    for least in (1, 2, 3):
        got = {(r["account_a"], r["account_b"]): (r["shared_retweets"], r["jaccard"], r["shared_within_15m"], r["shared_within_60m"]) for r in rows(overlap.account_overlap(posts(spark, data), least))}
        assert got == brute_overlap(data, least)
        assert least > 1 or any(a == b for a, b in got)


def test_network(spark):
    df = posts(spark, [post(1, "alice", "o1", "s", 0), post(2, "bob", "o1", "s", 1), post(3, "carol", "o1", "s", 2), post(4, "alice", "o2", "s", 3), post(5, "bob", "o2", "s", 4)])
    nodes, parts = overlap.overlap_network(overlap.account_overlap(df, 1))
    (p,) = rows(parts)
    assert (p["node_count"], p["edge_count"], p["density"], p["top_accounts"][0]) == (3, 3, 1.0, "alice")
    assert {r["account_handle"]: r["strongest_neighbor"] for r in rows(nodes)} == {"alice": "bob", "bob": "alice", "carol": "bob"}
    nodes, parts = overlap.overlap_network(overlap.account_overlap(df, 9))
    assert nodes.count() == parts.count() == 0


def test_components_of_chains_and_cycles(spark):
    pairs = [(f"n{i:03}", f"n{i + 1:03}") for i in range(40)] + [("x", "y"), ("y", "z"), ("z", "x"), ("q", "q"), ("n005", None)]
    got = {r["node"]: r["root"] for r in rows(overlap.components(spark.createDataFrame(pairs, "a string, b string"), "a", "b"))}
    assert all(got[f"n{i:03}"] == "n000" for i in range(41))
    assert (got["x"], got["z"], got["q"]) == ("x", "x", "q")


def brute_core(edges, k):
    adj = {}
    for a, b, w in edges:
        if w > 0:
            adj.setdefault(a, {})[b] = w
            adj.setdefault(b, {})[a] = w
    rank = {}
    for level in range(1, k + 2):
        while weak := [n for n in adj if sum(adj[n].values()) < level]:
            for n in weak:
                for m in adj.pop(n):
                    adj.get(m, {}).pop(n, None)
                rank[n] = level - 1
    return rank | dict.fromkeys(adj, k + 1)


def test_k_core_against_brute_force(spark):
    rng = random.Random(5)
    edges = [(a, b, rng.randrange(3)) for a, b in itertools.combinations("abcdefgh", 2) if rng.random() < 0.5]
    df = spark.createDataFrame(edges, "account_a string, account_b string, shared_within_15m bigint")
    assert {r["account_handle"]: r["core_rank"] for r in rows(overlap.k_core(df, 3))} == brute_core(edges, 3)


def test_accounts_and_features(spark):
    data = [post(1, "alice", "o1", "src", 0), post(2, "alice", "o2", "bob", 1), post(3, "bob", boost=False, minute=2), post(4, "bob", "o1", "src", 3)]
    people = members(spark, [member("src"), member("alice", followers_count=7)])
    df = posts(spark, data)
    casc = cascade.cascades(df)
    acc = account.account_summary(df, people, casc)
    got = {r["account_handle"]: r for r in rows(acc)}
    a = got["alice"]
    assert (a["in_member_list"], a["retweet_ratio"], a["first_retweeter_count"], a["retweets_to_member_count"], a["top_amplified_account"]) == (True, 1.0, 2, 1, "src")
    assert a["coordination_score"] == 35 + 2.5 + 5 + 7.5
    assert got["bob"]["followers_count"] is None and not got["bob"]["in_member_list"]
    nodes, _ = overlap.overlap_network(overlap.account_overlap(df, 1))
    when = F.lit("2026-04-16 00:00:00").cast("timestamp")
    leads = casc.groupBy(F.col("first_retweeter").alias("account_handle")).agg(F.count("*").alias("propagation_lead_count"))
    matrix = account.feature_matrix(acc, nodes, when, account.account_roles(people, acc), leads, casc.agg(F.count("*").alias("total_cascades")))
    m = {r["account_handle"]: r for r in rows(matrix)}
    assert (m["alice"]["account_age_days"], m["alice"]["first_retweeter_ratio"], m["bob"]["account_age_days"], m["bob"]["network_neighbor_count"]) == (836, 1.0, None, 1)


def test_roles(spark):
    data = [post(i, "hub", boost=False, minute=i) for i in range(4)] + [post(10 + i, "amp", f"o{i}", "hub", i) for i in range(6)] + [post(30, "retail", "o1", "hub", 30), post(31, "retail", boost=False)]
    data += [post(40, "paper", "o1", "hub", 40), post(41, "γραφείο", "o1", "hub", 41), post(42, "nofriends", "o1", "hub", 42)]
    people = members(
        spark,
        [member("retail"), member("paper", description="Local NEWSPAPER of the coast"), member("γραφείο", description="ΕΦΗΜΕΡΊΔΑ της πόλης"), member("nofriends", followers_count=20_000, friends_count=0)],
    )
    df = posts(spark, data)
    got = {r["account_handle"]: r for r in rows(account.account_roles(people, account.account_summary(df, people, cascade.cascades(df))))}
    labels = {h: r["role_label"] for h, r in got.items()}
    assert labels == {"hub": "source_hub", "amp": "amplifier_suspect", "retail": "retail_user", "paper": "media_business", "γραφείο": "media_business", "nofriends": "media_business"}
    assert got["nofriends"]["followers_friends_ratio"] == float("inf")
    assert "zero_or_single_original" in got["amp"]["signals"]


def test_cohort_of_a_tight_crew(spark):
    df = posts(spark, CREW)
    casc, who = cascade.cascades(df), cascade.cascade_accounts(df)
    pairs = overlap.account_overlap(df, 2)
    nodes, _ = overlap.overlap_network(pairs)
    groups = cohort.communities(pairs)
    (c,) = rows(cohort.cohorts(casc, who, groups, nodes))
    assert c["members"] == ["crew_a", "crew_b", "crew_c"] and c["cascade_count"] == 3 and c["cohort_score"] > 0 and c["cohort_id"] == 1
    by = cohort.cohorts_by_cascade(cohort.cohorts(casc, who, groups, nodes).select("cohort_id", F.explode("members").alias("account_handle")), who)
    assert {r["original_tweet_id"] for r in rows(by)} == {"o1", "o2", "o3"}
    assert cohort.cohorts(casc, who, cohort.communities(pairs.limit(0)), nodes).count() == 0


def test_propagation_against_brute_force(spark):
    rng = random.Random(8)
    data = [post(i, f"u{rng.randrange(9)}", f"o{i % 3}", "s", rng.randrange(300) / 10, client=rng.choice(["A", "B", ""])) for i in range(60)]
    df = posts(spark, data)
    people, casc = members(spark, [member("s")]), cascade.cascades(df)
    nodes, _ = overlap.overlap_network(overlap.account_overlap(df, 2))
    for r in rows(prop.propagation(df, casc, people, nodes)):
        mine = sorted((d for d in data if d["content_tweet_id"] == r["original_tweet_id"]), key=lambda d: (d["posted_at"], d["author_handle"], d["row_id"]))
        e = [int((d["posted_at"] - mine[0]["posted_at"]).total_seconds()) for d in mine]
        best = max(((sum(0 <= x - s <= 60 for x in e), -s) for s in e))
        assert (r["burst_peak_window_count"], r["burst_peak_window_start_sec"]) == (best[0], -best[1])
        assert (r["time_to_k5_sec"], r["time_to_k10_sec"], r["time_to_k50_sec"]) == (e[4], e[9], None)
        mean = sum(e) / len(e)
        var = sum((x - mean) ** 2 for x in e) / len(e)
        assert abs(r["burst_kurtosis"] - (sum((x - mean) ** 4 for x in e) / len(e) / var**2 - 3)) < 1e-3
        assert r["origin_is_member"]


def test_targets_and_profiles(spark):
    df = posts(spark, CREW)
    casc, who = cascade.cascades(df), cascade.cascade_accounts(df)
    people = members(spark, [member("source")])
    nodes, _ = overlap.overlap_network(overlap.account_overlap(df, 2))
    got = {r["amplified_author_handle"]: r for r in rows(prop.amplified_targets(df, casc, who, cascade.source_cascades(casc, who), people, nodes))}
    s = got["source"]
    assert (s["in_member_list"], s["total_inbound_retweets"], s["unique_amplifier_count"], s["repeat_crew_overlap"], s["fastest_amplifier_handle"]) == (True, 12, 4, 1.0, "crew_a")
    assert s["median_first_retweet_lag_sec"] == 60 and s["captured_role_mix"] == "unknown:1.00"
    p = {r["account_handle"]: r for r in rows(prop.first_profiles(casc))}
    assert (p["crew_a"]["first_retweeter_count"], p["crew_a"]["unique_targets_first"], p["crew_a"]["target_hhi"]) == (4, 2, 0.625)


def test_empty_tables(spark):
    df, people = posts(spark, []), members(spark, [])
    casc, who = cascade.cascades(df), cascade.cascade_accounts(df)
    assert casc.count() == cascade.source_cascades(casc, who).count() == overlap.account_overlap(df).count() == 0
    assert account.account_summary(df, people, casc).count() == 0
    assert cascade.dataset_stats(df, people).first()["tweet_count"] == 0
