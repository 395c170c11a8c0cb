"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.llm import look, quality
from tidewake.llm.components import connected_groups
from tidewake.llm.density_peaks import density_clusters, describe, scaled_vectors
from tidewake.llm.leaks import leaked
from tidewake.llm.mixing import mix
from tidewake.llm.set_pairs import expanded, linked_classes, similar_sets
from tidewake.operators import ml
from tidewake.session import Stage


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    keys = Stage(spark).cut(look.look_keys(read(spark, sf, "tweets"), "row_id", ["canonical_text"], ["hashtags_raw", "mentions_raw"]))
    tags = look.look_keys(read(spark, sf, "hashtag_registry"), "tag_id", ["tag"])
    names = look.look_keys(read(spark, sf, "members").select("member_id", "screen_name").distinct(), "member_id", ["screen_name"])
    found = (
        look.look_alikes(keys.where("field_name = 'canonical_text'"))
        .unionByName(look.look_like(keys.where("field_name = 'hashtags_raw'"), tags))
        .unionByName(look.look_like(keys.where("field_name = 'mentions_raw'"), names))
    )
    return found.select("field_name", F.col("id").cast("bigint").alias("row_id"), "pos", "look_ref")


def _amplified(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "tweets").where("is_retweet").select("author_handle", "content_tweet_id")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs, members = similar_sets(_amplified(spark, sf), "author_handle", "content_tweet_id", threshold=0.5, min_shared=3)
    return expanded(pairs, members, 3).withColumnsRenamed({"record_a": "account_a", "record_b": "account_b"})


def p3_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Similar pairs of accounts with different sets, one account for all with an equal set."""
    pairs, _ = similar_sets(_amplified(spark, sf), "author_handle", "content_tweet_id", threshold=0.5, min_shared=3)
    return pairs.select(F.col("rec_a").alias("account_a"), F.col("rec_b").alias("account_b"), F.col("shared").alias("shared_retweets"), F.round("jaccard", 6).alias("jaccard"))


def p3_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Every account with the account that stands for its set, the set's size and its number of similar accounts."""
    pairs, members = similar_sets(_amplified(spark, sf), "author_handle", "content_tweet_id", threshold=0.5, min_shared=3)
    return linked_classes(pairs, members, 3).withColumnsRenamed({"record": "account_handle", "rep": "class_handle", "n": "set_size"})


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    groups = connected_groups(read(spark, sf, "account_overlap"), "account_a", "account_b", read(spark, sf, "network_nodes"), "account_handle")
    return groups.withColumnsRenamed({"record": "account_handle", "group": "group_handle"})


#: What a profile shows says less about behaviour, and for many accounts it is unknown.
PROFILE = ("followers_count", "friends_count", "statuses_count", "account_age_days", "default_profile", "default_profile_image", "is_blue_verified")
PROFILE_WEIGHT = 0.25
BEHAVIOUR = [*ml.FEATURES, "coordination_score"]
#: Features on no log scale.
RATIOS = ("retweet_ratio", "retweets_to_member_ratio", "top_amplified_share", "first_retweeter_ratio", "coordination_score", "default_profile", "default_profile_image", "is_blue_verified")


def _behaviour(spark: SparkSession, sf: str) -> DataFrame:
    table = read(spark, sf, "ml_feature_matrix")
    logs = [c for c in BEHAVIOUR if c not in RATIOS and not c.startswith("role_")]
    return density_clusters(scaled_vectors(table, "account_handle", BEHAVIOUR, logs, weights=dict.fromkeys(PROFILE, PROFILE_WEIGHT)))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    clusters = _behaviour(spark, sf)
    names = clusters.groupBy("cluster").agg(F.min("record").alias("cluster_handle"))
    return clusters.join(F.broadcast(names), "cluster").select(F.col("record").alias("account_handle"), "cluster_handle")


def p6_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Every cluster with its size and its most typical accounts."""
    return describe(_behaviour(spark, sf))


def p8_edited(spark: SparkSession, sf: str) -> DataFrame:
    """Every document and item whose alignment earns what 12 words in a row do: whole, partial and
    edited copies, with score and place."""
    return leaked(read(spark, sf, "documents"), "doc_id", "text", read(spark, sf, "eval_items"), "item_id", "passage")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return p8_edited(spark, sf).where("longest_run >= 12").select("doc_id", "item_id")


def _mixed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return mix(read(spark, sf, "documents"), "doc_id", "source", "text", read(spark, sf, "mix_targets"))


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The documents of every mix with their number of copies."""
    return _mixed(spark, sf)[0]


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target and actual shares of every mix's sources."""
    return _mixed(spark, sf)[1]


#: How far a source's actual share may lie from its target; documents are taken whole, so small tables miss it by more.
SHARE_TOLERANCE = 0.02


def p9_kept(spark: SparkSession, sf: str) -> DataFrame:
    """Whether every source keeps its share (its part of the sources that have documents) and its repeats."""
    chosen, report = _mixed(spark, sf)
    copies = chosen.groupBy("mix_id", "source").agg(F.max("copies").alias("most"))
    there = report.where("documents > 0").groupBy("mix_id").agg(F.sum("target_share").alias("whole"))
    rows = report.join(there, "mix_id", "left").join(copies, ["mix_id", "source"], "left")
    due = F.when(F.col("documents") > 0, F.col("target_share") / F.col("whole")).otherwise(0.0)
    kept = (F.abs(F.col("actual_share") - due) <= SHARE_TOLERANCE).alias("on_target")
    return rows.select("mix_id", "source", "target_share", "max_repeats", "documents", kept, (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("within_repeats"))


#: A list of common words that is sent to the tasks has no more; a larger one is an error, not cut.
MOST_WORDS = 1_000_000


def _common_words(spark: SparkSession, sf: str) -> list[str]:
    words = [r[0] for r in read(spark, sf, "common_words").select("word").distinct().limit(MOST_WORDS + 1).collect()]
    if len(words) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} common words")
    return words


#: Statistics that plain SQL can count, too.
COUNTED = ("words", "mean_word_length", "symbol_ratio", "digit_ratio", "lines", "punctuated_line_share", "common_word_share")


def _quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality(read(spark, sf, "documents"), "doc_id", "text", _common_words(spark, sf))


def p10_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Word, symbol, line and common-word statistics of every document."""
    return _quality(spark, sf).select("doc_id", *[F.round(c, 6).alias(c) for c in COUNTED])


def p10_structure(spark: SparkSession, sf: str) -> DataFrame:
    """Alignment, periods and the shares of prose, tables, lists, logs and junk of every document."""
    return _quality(spark, sf).select("doc_id", *[c for c in quality.COLUMNS if c not in COUNTED])


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return _quality(spark, sf).where("not_prose_share > 0.5").select("doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p3_found, p3_pairs, p3_classes, p4_found, p6_found, p6_clusters, p8_found, p8_edited, p9_mix, p9_shares, p9_kept, p10_found, p10_statistics, p10_structure)}

def _p1_form(source: str) -> str:
    return f"({look.look_query(source, '* EXCLUDE (value, look), value AS v, look AS form')})"


_SETS = """
WITH s AS (SELECT DISTINCT author_handle AS h, content_tweet_id AS t FROM tweets WHERE is_retweet AND author_handle IS NOT NULL AND content_tweet_id IS NOT NULL),
n AS (SELECT h, count(*) AS n FROM s GROUP BY 1),
k AS (SELECT x.h AS a, y.h AS b, count(*) AS k FROM s x JOIN s y ON x.t = y.t AND x.h < y.h GROUP BY 1, 2 HAVING count(*) >= 3),
p AS (SELECT a, b, k, k / (x.n + y.n - k) AS j FROM k JOIN n x ON x.h = a JOIN n y ON y.h = b WHERE k / (x.n + y.n - k) >= 0.5),
c AS (SELECT h, items, min(h) OVER (PARTITION BY items) AS rep FROM (SELECT h, list(t ORDER BY t) AS items FROM s GROUP BY 1))"""

#: A letter, or a number that is no digit.
_LETTER = r"[\p{L}\p{Nl}\p{No}]"

ORACLE = {
    "p9_kept": r"""
WITH t AS (SELECT DISTINCT mix_id, regexp_replace(lower(trim(source)), '[\s\-_]+', '_', 'g') AS source, target_share, max_repeats FROM mix_targets),
d AS (SELECT regexp_replace(lower(trim(source)), '[\s\-_]+', '_', 'g') AS source, count(*) AS documents FROM documents WHERE source IS NOT NULL GROUP BY 1)
SELECT mix_id, source, target_share, max_repeats, coalesce(documents, 0) AS documents, true AS on_target, true AS within_repeats FROM t LEFT JOIN d USING (source)
""",
    "p10_statistics": rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents),
x AS (SELECT doc_id, regexp_extract_all(t, '{_LETTER}+(?:[''’]{_LETTER}+)*') AS w, regexp_matches(t, '[.!?…;·。！？｡．؟؛۔।॥։՞፧][»"”’」』）'')*]*\s*$') AS ends FROM l WHERE regexp_matches(t, '[^\s\x{{0B}}\x{{1C}}-\x{{1F}}\x{{85}}\p{{Z}}]')),
c AS (SELECT DISTINCT strip_accents(lower(word)) AS v FROM common_words WHERE word <> ''),
s AS (SELECT doc_id, count(*) AS n, avg(ends::INT) AS ends FROM x GROUP BY 1),
u AS (SELECT doc_id, unnest(w) AS w FROM x),
w AS (SELECT doc_id, count(*) AS n, sum(length(w)) AS size, count(*) FILTER (strip_accents(replace(lower(w), 'ς', 'σ')) IN (SELECT replace(v, 'ς', 'σ') FROM c)) AS common FROM u GROUP BY 1)
SELECT doc_id, coalesce(w.n, 0)::DOUBLE AS words, coalesce(round(size / w.n, 6), 0) AS mean_word_length,
  coalesce(round(length(regexp_replace(text, '[\p{{L}}\p{{N}}\s\x{{0B}}\x{{1C}}-\x{{1F}}\x{{85}}\p{{Z}}]', '', 'g')) / length(text), 6), 0) AS symbol_ratio,
  coalesce(round(length(regexp_replace(text, '[^\p{{Nd}}]', '', 'g')) / length(text), 6), 0) AS digit_ratio,
  coalesce(s.n, 0)::DOUBLE AS lines, coalesce(round(s.ends, 6), 0) AS punctuated_line_share, coalesce(round(common / w.n, 6), 0) AS common_word_share
FROM documents LEFT JOIN s USING (doc_id) LEFT JOIN w USING (doc_id)
""",
    "p1_found": f"""
WITH t AS MATERIALIZED {_p1_form("SELECT row_id, canonical_text AS value FROM tweets WHERE canonical_text IS NOT NULL")},
h AS MATERIALIZED {_p1_form("SELECT * FROM (SELECT row_id, unnest(range(len(hashtags_raw)))::INT AS pos, unnest(hashtags_raw) AS value FROM tweets) WHERE value IS NOT NULL")},
m AS MATERIALIZED {_p1_form("SELECT * FROM (SELECT row_id, unnest(range(len(mentions_raw)))::INT AS pos, unnest(mentions_raw) AS value FROM tweets) WHERE value IS NOT NULL")},
r AS MATERIALIZED {_p1_form("SELECT tag_id::VARCHAR AS id, tag AS value FROM hashtag_registry WHERE tag IS NOT NULL")},
n AS MATERIALIZED {_p1_form("SELECT DISTINCT member_id AS id, screen_name AS value FROM members WHERE screen_name IS NOT NULL")}
SELECT 'canonical_text' AS field_name, row_id, 0 AS pos, ref::VARCHAR AS look_ref
FROM (SELECT row_id, v, first_value(row_id) OVER w AS ref, first_value(v) OVER w AS ref_v FROM t WINDOW w AS (PARTITION BY form ORDER BY row_id)) WHERE v <> ref_v
UNION ALL SELECT 'hashtags_raw', row_id, pos, r.id FROM h JOIN r USING (form) WHERE h.v <> r.v
UNION ALL SELECT 'mentions_raw', row_id, pos, n.id FROM m JOIN n USING (form) WHERE m.v <> n.v
""",
    "p8_found": """
WITH d AS (SELECT doc_id, regexp_extract_all(replace(lower(strip_accents(text)), 'ς', 'σ'), '[\\p{L}\\p{N}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(replace(lower(strip_accents(passage)), 'ς', 'σ'), '[\\p{L}\\p{N}]+') AS w FROM eval_items),
g AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS x FROM d WHERE len(w) >= 12),
s AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS x FROM i WHERE len(w) >= 12)
SELECT DISTINCT doc_id, item_id FROM g JOIN s USING (x)
""",
    "p3_found": f"{_SETS} SELECT a AS account_a, b AS account_b FROM p",
    "p3_pairs": f"{_SETS} SELECT a AS account_a, b AS account_b, k AS shared_retweets, round(j, 6) AS jaccard FROM p JOIN c x ON x.h = a JOIN c y ON y.h = b WHERE x.rep = a AND y.rep = b AND x.items <> y.items",
    "p3_classes": f"""{_SETS}, l AS (SELECT h, count(*) AS links FROM (SELECT a AS h FROM p UNION ALL SELECT b FROM p) GROUP BY 1)
SELECT h AS account_handle, rep AS class_handle, len(items) AS set_size, coalesce(links, 0) AS links FROM c LEFT JOIN l USING (h)""",
    "p4_found": """
WITH RECURSIVE e AS (
  SELECT DISTINCT account_a AS x, account_b AS y FROM account_overlap WHERE account_a <> account_b
  UNION SELECT DISTINCT account_b, account_a FROM account_overlap WHERE account_a <> account_b),
n AS (SELECT account_a AS v FROM account_overlap UNION SELECT account_b FROM account_overlap UNION SELECT account_handle FROM network_nodes),
r(v, g) USING KEY (v) AS (
  SELECT v, v FROM n WHERE v IS NOT NULL
  UNION SELECT e.y, min(r.g) FROM r JOIN e ON e.x = r.v JOIN recurring.r AS o ON o.v = e.y WHERE r.g < o.g GROUP BY e.y)
SELECT v AS account_handle, g AS group_handle FROM r
""",
}
