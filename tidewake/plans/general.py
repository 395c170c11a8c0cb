"""Queries of the general training-data operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.operators.entity_features import by_entity, cumulative_store, measures, widen, window_features, write_store
from tidewake.operators.nested import POST, nested_rows, shaped_rows
from tidewake.operators.snapshot_diff import snapshot_changes
from tidewake.session import Stage

COMPARED = ["screen_name", "followers_count", "statuses_count"]
KINDS = ["original", "amplification", "quote"]
WINDOWS = {"7d": 7, "28d": 28}


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    changes = snapshot_changes(read(spark, sf, "members"), "snapshot_id", "member_id", COMPARED, "loaded_at")
    return changes.select("from_snapshot", "to_snapshot", "member_id", "change_kind")


def p2_changed_fields(spark: SparkSession, sf: str) -> DataFrame:
    """The same changes with the columns that differ."""
    changes = snapshot_changes(read(spark, sf, "members"), "snapshot_id", "member_id", COMPARED, "loaded_at")
    return changes.withColumn("changed_fields", F.array_join("changed_fields", ","))


def distinct_posts(tweets: DataFrame, *columns: str) -> DataFrame:
    """The first capture (lowest ``row_id``) of every post; a row without a post id is its own post."""
    kept = [c for c in columns if c not in ("row_id", "tweet_id")]
    key = F.coalesce(F.col("tweet_id"), F.concat(F.lit("row "), F.col("row_id").cast("string")))
    rows = tweets.select(key.alias("tweet_id"), F.struct("row_id", *kept).alias("r"))
    return rows.groupBy("tweet_id").agg(F.min_by("r", "r.row_id").alias("r")).select("tweet_id", "r.*")


def _actions(spark: SparkSession, sf: str) -> DataFrame:
    """Every post once, with its event type (kind of action and client) and the tags and mentions it uses."""
    posts = distinct_posts(
        read(spark, sf, "tweets").withColumn("used", F.coalesce(F.size("hashtags"), F.lit(0)) + F.coalesce(F.size("mentions"), F.lit(0))),
        "row_id", "author_handle", "posted_at", "source_client", "is_retweet", "is_quote", "content_tweet_id", "content_author_handle", "used",
    )
    kind = F.when(F.col("is_retweet"), "amplification").when(F.col("is_quote"), "quote").otherwise("original")
    return posts.withColumn("type", F.concat_ws(":", kind, F.coalesce("source_client", F.lit("unknown"))))


def _type_features(stage: Stage, posts: DataFrame) -> DataFrame:
    """Features of every (account, event type) as of the day of the newest post, from the written store."""
    store = write_store(cumulative_store(posts, "author_handle", "type", "posted_at", "used"), stage.place())
    return window_features(store, posts.agg(F.max(F.to_date("posted_at"))).first()[0], WINDOWS)


def p5_type_features(spark: SparkSession, sf: str) -> DataFrame:
    """One row per account and event type (kind of action and client, some hundreds): count,
    total of tags and mentions used, latest time, recency and windows."""
    stage = Stage(spark)
    return _type_features(stage, stage.cut(_actions(spark, sf))).withColumnsRenamed({"entity": "author_handle", "kind": "type"})


def p5_entity_features(spark: SparkSession, sf: str) -> DataFrame:
    """One row per account: count, total, latest time, recency and windows per kind of
    action, the same for every event type the account has (``types``, as text
    ``type,figures`` joined by ``|``), and the current amplification figures."""
    stage = Stage(spark)
    posts = stage.cut(_actions(spark, sf))  # deduplicated once for the store and the two figures below
    fine = stage.cut(_type_features(stage, posts))
    # the kinds' features are sums of their types'
    coarse = fine.groupBy("entity", F.substring_index("kind", ":", 1).alias("kind")).agg(
        *[F.sum(m).alias(m) for m in measures(WINDOWS)], F.max("last_at").alias("last_at"), F.min("recency_days").alias("recency_days")
    )
    by_kind = widen(coarse, KINDS, [*measures(WINDOWS), "last_at", "recency_days"])
    dated = ("last_at", "recency_days")
    by_kind = by_kind.select("entity", *[(F.col(c) if c.endswith(dated) else F.coalesce(c, F.lit(0))).alias(c) for c in by_kind.columns[1:]])
    text = lambda t: F.concat_ws(
        ",", t["kind"], t["count"], t["total"], F.coalesce(F.date_format(t["last_at"], "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("")), F.coalesce(t["recency_days"].cast("string"), F.lit("")),
        *[t[m] for m in measures(WINDOWS)[2:]],
    )
    listed = by_entity(fine, WINDOWS).select("entity", F.size("types").alias("type_count"), F.array_join(F.transform("types", text), "|").alias("types"))

    boosts = posts.where("is_retweet")
    order = F.struct(F.col("posted_at").isNull().alias("a"), F.col("posted_at").alias("b"), F.col("author_handle").alias("c"), F.col("row_id").alias("d"))
    firsts = (
        boosts.groupBy("content_tweet_id").agg(F.min(order).alias("o")).groupBy(F.col("o.c").alias("entity")).agg(F.count(F.lit(1)).alias("first_retweeter_count"))
    )
    tops = (
        boosts.groupBy(F.col("author_handle").alias("entity"), "content_author_handle")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("entity")
        .agg(F.sum("n").alias("retweet_count"), F.max("n").alias("top_n"))
    )
    account = tops.join(firsts, tops["entity"].eqNullSafe(firsts["entity"]), "left").select(
        tops["entity"],
        "retweet_count",
        F.coalesce("first_retweeter_count", F.lit(0)).alias("first_retweeter_count"),
        F.round(F.col("top_n") / F.col("retweet_count"), 4).alias("top_amplified_share"),
    )
    out = by_kind.join(listed, by_kind["entity"].eqNullSafe(listed["entity"])).drop(listed["entity"])
    out = out.join(account, out["entity"].eqNullSafe(account["entity"]), "left").drop(account["entity"])
    filled = {c: F.coalesce(c, F.lit(0)) for c in ("retweet_count", "first_retweeter_count")} | {"top_amplified_share": F.coalesce("top_amplified_share", F.lit(0.0))}
    return out.withColumns(filled).withColumnRenamed("entity", "author_handle")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = shaped_rows(read(spark, sf, "raw_posts"), "raw_id", "payload", POST, "post_id", "hashtag")
    return rows.withColumnsRenamed({"post_id": "tweet_id", "parent_post_id": "parent_tweet_id"})


def p7_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the flat tables of every repeated ancestor: table, row and parent key and the fields
    that have a value, as text."""
    rows = nested_rows(read(spark, sf, "raw_posts"), "raw_id", "payload")
    key = lambda c: F.array_join(F.col(c).cast("array<string>"), ".")
    filled = F.filter(F.map_entries("fields"), lambda e: e["value"].isNotNull())
    text = F.array_join(F.array_sort(F.transform(filled, lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "|")
    return rows.select("raw_id", F.col("group_path").alias("table_path"), key("ordinals").alias("row_key"), key("parent_ordinals").alias("parent_key"), text.alias("fields"))


QUERIES = {f.__name__: f for f in (p2_found, p2_changed_fields, p5_entity_features, p5_type_features, p7_found, p7_tables)}

_P2 = """
WITH latest AS (
  SELECT snapshot_id, member_id, screen_name, followers_count, statuses_count FROM members
  QUALIFY row_number() OVER (PARTITION BY snapshot_id, member_id ORDER BY loaded_at DESC) = 1),
steps AS (SELECT snapshot_id AS a, lead(snapshot_id) OVER (ORDER BY snapshot_id) AS b FROM (SELECT DISTINCT snapshot_id FROM members) QUALIFY b IS NOT NULL),
old AS (SELECT s.a, s.b, l.* FROM steps s JOIN latest l ON l.snapshot_id = s.a),
new AS (SELECT s.a, s.b, l.* FROM steps s JOIN latest l ON l.snapshot_id = s.b)
SELECT coalesce(o.a, n.a) AS from_snapshot, coalesce(o.b, n.b) AS to_snapshot, coalesce(o.member_id, n.member_id) AS member_id,
  CASE WHEN o.member_id IS NULL THEN 'added' WHEN n.member_id IS NULL THEN 'removed' ELSE 'changed' END AS change_kind{extra}
FROM old o FULL JOIN new n ON o.a = n.a AND o.member_id = n.member_id
WHERE o.member_id IS NULL OR n.member_id IS NULL OR o.screen_name IS DISTINCT FROM n.screen_name
  OR o.followers_count IS DISTINCT FROM n.followers_count OR o.statuses_count IS DISTINCT FROM n.statuses_count
"""
_DIFFER = ", ".join(f"CASE WHEN o.member_id IS NOT NULL AND n.member_id IS NOT NULL AND o.{c} IS DISTINCT FROM n.{c} THEN '{c}' END" for c in COMPARED)

_POSTS = """posts AS (
  SELECT row_id, author_handle, posted_at, is_retweet, content_tweet_id, content_author_handle,
    coalesce(len(hashtags), 0) + coalesce(len(mentions), 0) AS used,
    CASE WHEN is_retweet THEN 'amplification' WHEN is_quote THEN 'quote' ELSE 'original' END AS kind,
    coalesce(source_client, 'unknown') AS client
  FROM tweets QUALIFY row_number() OVER (PARTITION BY coalesce(tweet_id, 'row ' || row_id) ORDER BY row_id) = 1),
ending AS (SELECT max(posted_at::DATE) AS d FROM posts)"""


def _figures(where: str, name: str = "") -> str:
    """The figures of one group's posts, of those ``where`` holds for."""
    inside = {w: f"{where} AND posted_at::DATE > d - {n}" for w, n in WINDOWS.items()}
    parts = [
        f"count(*) FILTER ({where}) AS {name}count, coalesce(sum(used) FILTER ({where}), 0)::BIGINT AS {name}total, max(posted_at) FILTER ({where}) AS {name}last_at",
        f"any_value(d) - (max(posted_at) FILTER ({where}))::DATE AS {name}recency_days",
        *[f"count(*) FILTER ({x}) AS {name}count_{w}, coalesce(sum(used) FILTER ({x}), 0)::BIGINT AS {name}total_{w}" for w, x in inside.items()],
    ]
    return ", ".join(parts)


_P5_TYPES = f"WITH {_POSTS} SELECT author_handle, kind || ':' || client AS type, {_figures('true')} FROM posts, ending GROUP BY 1, 2"
_P5_TEXT = "type || ',' || count || ',' || total || ',' || coalesce(strftime(last_at, '%Y-%m-%d %H:%M:%S.%f'), '') || ',' || coalesce(recency_days::VARCHAR, '')" + "".join(
    f" || ',' || {m}_{w}" for w in WINDOWS for m in ("count", "total")
)
_P5 = f"""
WITH {_POSTS},
kinds AS (SELECT author_handle AS h, {", ".join(_figures(f"kind = '{k}'", f"{k}_") for k in KINDS)} FROM posts, ending GROUP BY 1),
types AS (SELECT author_handle AS h, count(*)::INT AS type_count, string_agg({_P5_TEXT}, '|' ORDER BY type) AS types FROM (
  SELECT author_handle, kind || ':' || client AS type, {_figures('true')} FROM posts, ending GROUP BY 1, 2) GROUP BY 1),
firsts AS (SELECT a AS h, count(*) AS n FROM (SELECT author_handle AS a FROM posts WHERE is_retweet
  QUALIFY row_number() OVER (PARTITION BY content_tweet_id ORDER BY posted_at NULLS LAST, author_handle, row_id) = 1) GROUP BY 1),
tops AS (SELECT h, sum(n)::BIGINT AS n, max(n) AS m FROM (SELECT author_handle AS h, content_author_handle, count(*) AS n FROM posts WHERE is_retweet GROUP BY 1, 2) GROUP BY 1)
SELECT k.h AS author_handle, k.* EXCLUDE (h), type_count, types, coalesce(p.n, 0) AS retweet_count, coalesce(f.n, 0) AS first_retweeter_count,
  coalesce(round(p.m / p.n, 4), 0.0) AS top_amplified_share
FROM kinds k JOIN types t USING (h) LEFT JOIN tops p USING (h) LEFT JOIN firsts f USING (h)
"""

_P7 = """
WITH good AS MATERIALIZED (SELECT raw_id, payload FROM raw_posts WHERE payload IS NOT NULL AND json_valid(payload)),
nodes AS (SELECT g.raw_id, j.fullkey, j.value FROM good g, json_tree(g.payload) j WHERE j.type = 'OBJECT'),
posts AS MATERIALIZED (SELECT raw_id, fullkey, coalesce(nullif(value ->> '$.core.user_results.result.core.screen_name', ''), nullif(value ->> '$.core.user_results.result.legacy.screen_name', '')) AS author,
  coalesce(nullif(value ->> '$.rest_id', ''), nullif(value ->> '$.legacy.id_str', '')) AS id,
  CASE WHEN json_type(value, '$.note_tweet.note_tweet_results.result.entity_set.hashtags') = 'ARRAY' THEN value -> '$.note_tweet.note_tweet_results.result.entity_set.hashtags'
    ELSE value -> '$.legacy.entities.hashtags' END AS tags FROM nodes WHERE author IS NOT NULL AND id IS NOT NULL),
linked AS (SELECT p.raw_id, p.fullkey, arg_max(q.id, length(q.fullkey)) AS parent FROM posts p JOIN posts q
  ON p.raw_id = q.raw_id AND (starts_with(p.fullkey, q.fullkey || '.') OR starts_with(p.fullkey, q.fullkey || '[')) GROUP BY 1, 2),
kept AS (SELECT *, list_filter(CASE WHEN json_type(tags) = 'ARRAY' THEN json_extract_string(tags, '$[*].text') ELSE [] END, lambda t: t IS NOT NULL AND t <> '') AS k FROM posts)
SELECT raw_id, id AS tweet_id, coalesce(parent, '') AS parent_tweet_id, author AS author_handle, CASE WHEN len(k) = 0 THEN -1 ELSE i END::INT AS pos, CASE WHEN len(k) = 0 THEN '' ELSE k[i + 1] END AS hashtag
FROM kept LEFT JOIN linked USING (raw_id, fullkey), unnest(range(greatest(len(k), 1))) AS u(i)
"""

_P7_TABLES = """
WITH good AS MATERIALIZED (SELECT raw_id, payload FROM raw_posts WHERE payload IS NOT NULL AND json_valid(payload)),
nodes AS (SELECT raw_id, regexp_replace(j.fullkey, '"([A-Za-z0-9_]+)"', '\\1', 'g') AS p, j.type AS t, j.value ->> '$' AS v FROM good, json_tree(payload) j),
split AS (SELECT raw_id, p, t, v, regexp_extract(p, '^(.*\\])[^\\]]*$', 1) AS head FROM nodes),
named AS (SELECT raw_id, CASE WHEN head = '' THEN '$' ELSE regexp_replace(head, '\\[\\d+\\]', '[]', 'g') END AS table_path, regexp_extract_all(head, '\\[(\\d+)\\]', 1) AS ords,
  ltrim(CASE WHEN head = '' THEN substr(p, 2) ELSE substr(p, length(head) + 1) END, '.') AS f, t, v FROM split)
SELECT raw_id, table_path, array_to_string(ords, '.') AS row_key, CASE WHEN len(ords) > 0 THEN array_to_string(ords[:-2], '.') END AS parent_key,
  coalesce(string_agg(CASE WHEN f = '' THEN 'value' ELSE f END || '=' || v, '|' ORDER BY CASE WHEN f = '' THEN 'value' ELSE f END || '=' || v) FILTER (t NOT IN ('OBJECT', 'ARRAY', 'NULL')), '') AS fields
FROM named GROUP BY 1, 2, 3, 4
"""

ORACLE = {
    "p7_found": _P7,
    "p7_tables": _P7_TABLES,
    "p2_found": _P2.format(extra=""),
    "p2_changed_fields": _P2.format(extra=f", concat_ws(',', {_DIFFER}) AS changed_fields"),
    "p5_entity_features": _P5,
    "p5_type_features": _P5_TYPES,
}
