import csv
import json

import pytest
from pyspark.sql import functions as F

from tidewake import curation
from tidewake.__main__ import parser
from tidewake.functions import text as tx
from tidewake.operators import ml
from tidewake.plans import pipeline
from tidewake.sources import discovery
from tidewake.sources.members import extra_handles, handles, members_csv, read_members
from tidewake.sources.posts import export_rows, normalised_posts
from tidewake.streaming.bursts import burst_counts
from tests.fixtures import CREW, post, posts

TIME = "Wed Apr 16 10:55:44 +0000 2026"


def raw_post(ident, author, text, tags=(), mentions=(), **legacy):
    return {
        "rest_id": ident, "source": '<a href="https://x.example">Client One</a>', "core": {"user_results": {"result": {"core": {"screen_name": author, "name": author.upper()}}}},
        "legacy": {"created_at": TIME, "full_text": text, "entities": {"hashtags": [{"text": t} for t in tags], "user_mentions": [{"screen_name": m} for m in mentions]}} | legacy,
    }


def boost(ident, author, of, wrapped=False):
    return raw_post(ident, author, f"RT @{of['core']['user_results']['result']['core']['screen_name']}: x", retweeted_status_result={"result": {"tweet": of} if wrapped else of})


def bundle(rows):
    return json.dumps({"data": {"data": [{"tableName": "users", "rows": []}, {"tableName": "tweets", "rows": rows}]}})


def member_item(handle, **over):
    return {"id": "id-" + handle, "screen_name": handle, "name": handle, "description": "line one\nline, two", "followers_count": "12.0", "friends_count": 3, "created_at": "2026-04-16 10:00:00 +00:00",
            "is_blue_verified": True, "metadata": {"legacy": {"default_profile": True}, "profile_description_language": "en"}} | over


@pytest.fixture
def raw_dir(tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    own = raw_post("1", "src", "Héllo https://t.example/a  World", ["Café", ""], ["Bob"])
    rows = [own, *[boost(str(10 + i), h, own, i % 2 == 0) for i, h in enumerate(("alice", "bob", "carol", "alice"))], {"rest_id": "x"}, raw_post("20", "dave", "RT @ghost: hi", retweeted_status_result={"a": 1})]
    for n in (150, 250):
        (raw / f"twitter-web-exporter-{n}.json").write_text(bundle(rows))
    (raw / "twitter-ListMembers-100.json").write_text(json.dumps({"users": [member_item("src"), "junk", member_item("alice")]}))
    (raw / "twitter-ListMembers-200.json").write_text(json.dumps([member_item("src")]))
    (raw / "manual_member_handles_240.txt").write_text("https://x.example/Bob/status/3\n@SRC\n\nbob\nplain/\n")
    return raw


def test_normalised_posts(spark, raw_dir):
    got = {r["tweet_id"]: r for r in normalised_posts(export_rows(spark, str(raw_dir / "twitter-web-exporter-150.json"))).collect()}
    assert len(got) == 6
    own, b = got["1"], got["10"]
    assert (own["canonical_text"], own["hashtags"], own["mentions"], own["source_client"], own["is_retweet"]) == ("héllo world", ["cafe"], ["bob"], "Client One", False)
    assert own["posted_at"].isoformat() == "2026-04-16T10:55:44"
    assert (b["is_retweet"], b["content_tweet_id"], b["content_author_handle"], b["hashtags_raw"], b["author_name"]) == (True, "1", "src", ["Café"], "ALICE")
    assert got["11"]["content_author_handle"] == "src" and got["20"]["content_author_handle"] == "dave" and got["20"]["is_retweet"]


def test_many_bundles_in_one_read(spark, tmp_path):
    for n, rows in ((1, 3), (2, 2)):
        (tmp_path / f"b{n}.json").write_text(bundle([raw_post(f"{n}{i}", "src", "x") for i in range(rows)]))
    (tmp_path / "b3.json").write_text(json.dumps({"data": {"data": [{"tableName": "tweets"}]}}))
    got = normalised_posts(export_rows(spark, str(tmp_path / "b*.json"))).orderBy("row_id").collect()
    assert [r["tweet_id"] for r in got] == ["10", "11", "12", "20", "21"] and len({r["row_id"] for r in got}) == 5


def test_bundle_errors(spark, tmp_path):
    for i, doc in enumerate(({"data": {"data": {}}}, {"data": {"data": []}}, {"data": {"data": [{"tableName": "tweets", "rows": 3}]}})):
        path = tmp_path / f"b{i}.json"
        path.write_text(json.dumps(doc))
        with pytest.raises(Exception, match="bundle|posts|list"):
            export_rows(spark, str(path)).collect()


def test_member_files(spark, tmp_path, raw_dir):
    rows = {r["screen_name"]: r for r in read_members(spark, str(raw_dir / "twitter-ListMembers-100.json"), extra_handles(spark, str(raw_dir / "manual_member_handles_240.txt"))).collect()}
    assert set(rows) == {"src", "alice", "Bob", "plain"}
    assert (rows["src"]["followers_count"], rows["src"]["friends_count"], rows["src"]["default_profile"], rows["src"]["default_profile_image"]) == (0, 3, True, None)
    assert (rows["Bob"]["member_id"], rows["Bob"]["followers_count"], rows["Bob"]["default_profile"], rows["Bob"]["is_blue_verified"]) == ("Bob", 0, None, False)
    path = tmp_path / "members.csv"
    with path.open("w", newline="", encoding="utf-8-sig") as f:
        w = csv.DictWriter(f, ["id", "screen_name", "description", "followers_count", "created_at", "is_blue_verified", "metadata"])
        w.writeheader()
        w.writerow({"id": "1", "screen_name": "src", "description": 'a "quoted"\nline', "followers_count": "7", "created_at": TIME, "is_blue_verified": "True", "metadata": json.dumps({"legacy": {"default_profile_image": False}})})
        w.writerow({"id": "2", "screen_name": "b", "description": " ", "followers_count": "x", "metadata": "{bad"})
    a, b = members_csv(spark, str(path)).orderBy("member_id").collect()
    assert (a["description"], a["followers_count"], a["is_blue_verified"], a["default_profile_image"], a["created_at"].year) == ('a "quoted"\nline', 7, True, False, 2026)
    assert (b["description"], b["followers_count"], b["created_at"], b["default_profile"]) == (None, 0, None, None)
    with pytest.raises(ValueError):
        read_members(spark, "x.xml")


def test_handle_lists(spark, tmp_path):
    (tmp_path / "h.json").write_text(json.dumps({"handles": ["@A", "http://x.example/", "b"]}))
    (tmp_path / "h.csv").write_text("n,username\n1,@c\n2,C\n")
    read = lambda n: {r[0] for r in handles(extra_handles(spark, str(tmp_path / n))).collect()}
    assert read("h.json") == {"A", "b"} and read("h.csv") == {"c"}
    with pytest.raises(ValueError):
        extra_handles(spark, "x.xml")


def test_text_functions(spark):
    df = spark.createDataFrame([("ΔΌΞΑΣ", '<a href="x"> App </a>'), ("ΣΊΣΥΦΟΣ", "plain"), (None, "")], "t string, c string")
    got = df.select(tx.normalize_token("t"), tx.canonical_text(F.lit("A   test https://x.com/demo   text")), tx.client_label(F.col("c"))).collect()
    assert [r[0] for r in got] == ["δοξασ", "σισυφοσ", None] and got[0][1] == "a test text" and [r[2] for r in got] == ["App", "plain", None]
    times = spark.createDataFrame([(TIME,), ("Thu, 16 Apr 2026 10:55:44 +0200",), ("soon",), (None,)], "s string").select(tx.post_time(F.col("s"))).collect()
    assert [t[0] and t[0].hour for t in times] == [10, 8, None, None]


def test_batches(spark, raw_dir, tmp_path):
    clean = tmp_path / "clean"
    planned = [b["sources"] for b in curation.wanted(spark, raw_dir)]
    assert [tuple(s[k] and s[k]["snapshot_id"] for k in curation.KINDS) for s in planned] == [(150, 100, None), (250, 200, 240)]
    built, index = curation.build(spark, raw_dir, clean)
    assert [b.status for b in built] == ["built", "built"] and json.loads(index.read_text())["latest_batch_id"] == built[1].batch_id == "batch_exporter-250__members-200"
    assert {b.status for b in curation.build(spark, raw_dir, clean)[0]} == {"skipped"}
    (raw_dir / "twitter-ListMembers-200.json").write_text(json.dumps([member_item("src"), member_item("new")]))
    assert [b.status for b in curation.build(spark, raw_dir, clean)[0]] == ["skipped", "built"]
    with pytest.raises(ValueError):
        curation.resolve(spark, clean, "none")
    with pytest.raises(FileNotFoundError):
        curation.resolve(spark, tmp_path)
    # the clean batch analyses to what its raw files do
    files = discovery.dataset(raw_dir, raw_dir / "twitter-ListMembers-200.json", raw_dir / "twitter-web-exporter-250.json", raw_dir / "manual_member_handles_240.txt")
    a = pipeline.run_raw(spark, raw_dir, tmp_path / "a", files["members"], files["exporter"], files["extra_members"], with_ml=False, min_shared=1)
    b = pipeline.run_clean(spark, clean, tmp_path / "b", with_ml=False, min_shared=1)
    assert a.keys() == b.keys() and "cascade_spread_paths" in a
    for name in a:
        read = lambda p: p.read_text() if p.is_file() else "".join(sorted(x.read_text() for x in p.glob("part-*")))
        one, two = read(a[name]), read(b[name])
        if name == "summary":
            one, two = (json.dumps({k: v for k, v in json.loads(x).items() if k != "inputs"}) for x in (one, two))
        if name != "normalized_tweets":  # carries row ids
            assert one == two, name
    assert json.loads(a["summary"].read_text())["ml"]["run"]["status"] == "skipped_disabled"
    report = a["report"].read_text()
    assert "# Amplification report" in report and "not proof" in report


def test_model(spark):
    rows = [("a%d" % i, float(i % 2), *([i % 2 * 100] * 3)) for i in range(12)]
    df = spark.createDataFrame(rows, "account_handle string, retweet_ratio double, tweet_count bigint, network_weighted_degree bigint, mention_count bigint")
    df = df.select("*", *[F.lit(0).alias(f) for f in ml.FEATURES if f not in df.columns], F.lit(1.0).alias("coordination_score"))
    run, accounts, clusters = ml.run_model(df)
    r, got = run.first(), accounts.collect()
    assert (r["status"], r["cluster_count"], r["cluster_selection"]) == ("ready", 2, "silhouette")
    assert sorted(a["anomaly_rank"] for a in got) == list(range(1, 13)) and {a["cluster_size"] for a in got} == {6} and {a["cluster_id"] for a in got} == {1, 2}
    assert all(0 < a["anomaly_score"] < 1 and a["centroid_distance"] < 1e-6 for a in got) and clusters.count() == 2
    run, accounts, clusters = ml.run_model(df.limit(0))
    assert run.first()["status"] == "skipped_no_samples" and accounts.count() == clusters.count() == 0
    run, accounts, _ = ml.run_model(df.limit(2))
    assert run.first()["cluster_selection"] == "fallback_small_sample" and {a["anomaly_score"] for a in accounts.collect()} == {0.0}


def test_stream_equals_table(spark, tmp_path):
    df = posts(spark, [*CREW, post(300, "late", "o1", "source", None)])
    df.write.parquet(str(tmp_path / "in"))
    want = {tuple(r) for r in burst_counts(df).collect()}
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = burst_counts(stream).writeStream.format("memory").queryName("bursts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("bursts").collect()} == want and len(want) == 7


def test_command_line():
    a = parser().parse_args(["analyze-clean", "--no-with-ml", "--min-shared-overlap", "3", "--no-batch-subdir"])
    assert (a.with_ml, a.min_shared_overlap, a.batch_subdir, a.auto_build) == (False, 3, False, True)
    with pytest.raises(SystemExit):
        parser().parse_args(["analyze", "--ml-clusters", "0"])


def test_queries_against_sql(spark):
    """Each registered query with SQL gives that SQL's rows on the smallest tables."""
    import duckdb

    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    import pathlib

    if not pathlib.Path(sf).exists():
        pytest.skip("no test data")
    for p in pathlib.Path(sf).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    as_text = lambda v: "" if v is None or v != v else f"{v:.6g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    for name in ("cascade_summary", "account_overlap", "p2_changed_fields", "p5_entity_features", "target_summary", "propagation"):
        df = queries[name](spark, sf)
        cols = sorted(df.columns)
        got = sorted(tuple(as_text(r[c]) for c in cols) for r in df.collect())
        rel = con.sql(sql[name])
        at = [rel.columns.index(c) for c in cols]
        assert got == sorted(tuple(as_text(r[i]) for i in at) for r in rel.fetchall()), name
