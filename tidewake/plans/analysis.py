"""Queries of the analytical operators over the post and member tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewake.functions import text as tx
from tidewake.operators import account, cascade, cohort, ml, overlap
from tidewake.operators import propagation as prop
from tidewake.session import Stage, table_stamp

MIN_SHARED = 2
#: Tables that several queries read, built once per session and state of the input.
_BUILT: dict[tuple, tuple] = {}


def _once(spark: SparkSession, sf: str, name: str, build, table: str = "tweets") -> tuple:
    """What ``build(stage)`` gives, kept while the input ``table`` and the written tables are there unchanged."""
    key = (id(spark), spark.sparkContext.applicationId, sf, name)
    stamp = table_stamp(spark, f"{sf}/{table}.parquet")
    known = _BUILT.get(key)
    if known is None or known[0] != stamp or known[1] is not spark or not known[2].there():
        stage = Stage(spark)
        _BUILT[key] = known = (stamp, spark, stage, build(stage))
    return known[3]


def posts_of(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/tweets.parquet")
    return rows.withColumns({c: F.col(c).cast("timestamp") for c in ("posted_at", "content_created_at")})


def members_of(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/members.parquet")
    return account.current_members(rows.withColumns({c: F.col(c).cast("timestamp") for c in ("created_at", "loaded_at")}))


def shown(df: DataFrame) -> DataFrame:
    """Lists as text joined by ``|`` and times without zone, as tables and SQL give them."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), "|")
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        out.append(c.alias(f.name))
    return df.select(*out)


def _cascades(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    posts = posts_of(spark, sf)
    return posts, cascade.cascades(posts), cascade.cascade_accounts(posts)


def _network(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, nodes, components)."""

    def build(stage: Stage) -> tuple:
        pairs = stage.cut(overlap.account_overlap(posts_of(spark, sf), MIN_SHARED))
        return (pairs, *map(stage.cut, overlap.overlap_network(pairs)))

    return _once(spark, sf, "network", build)


def _accounts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    posts, casc, _ = _cascades(spark, sf)
    members = members_of(spark, sf)
    return posts, casc, members, account.account_summary(posts, members, cascade.first_amplifiers(posts))


def dataset_stats(spark: SparkSession, sf: str) -> DataFrame:
    return shown(cascade.dataset_stats(posts_of(spark, sf), members_of(spark, sf)))


def missing_members(spark: SparkSession, sf: str) -> DataFrame:
    return cascade.missing_members(posts_of(spark, sf), members_of(spark, sf))


def cascade_summary(spark: SparkSession, sf: str) -> DataFrame:
    _, casc, accounts = _cascades(spark, sf)
    return shown(casc.join(cascade.retweeter_lists(accounts), "original_tweet_id"))


def source_cascades(spark: SparkSession, sf: str) -> DataFrame:
    _, casc, accounts = _cascades(spark, sf)
    return shown(cascade.source_cascades(casc, accounts))


def token_hashtags(spark: SparkSession, sf: str) -> DataFrame:
    return shown(cascade.tokens(posts_of(spark, sf), "hashtags"))


def token_mentions(spark: SparkSession, sf: str) -> DataFrame:
    return shown(cascade.tokens(posts_of(spark, sf), "mentions"))


def amplifier_edges(spark: SparkSession, sf: str) -> DataFrame:
    return cascade.amplifier_edges(posts_of(spark, sf))


def account_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.account_overlap(posts_of(spark, sf), MIN_SHARED)


def account_summary(spark: SparkSession, sf: str) -> DataFrame:
    return shown(_accounts(spark, sf)[3])


def coordination_score(spark: SparkSession, sf: str) -> DataFrame:
    """Recomputed from the ratios an earlier run stored."""
    stored = spark.read.parquet(f"{sf}/account_summary.parquet")
    return stored.select("account_handle", account.coordination_score().alias("score"))


def overlap_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return _network(spark, sf)[1]


def overlap_components(spark: SparkSession, sf: str) -> DataFrame:
    return shown(_network(spark, sf)[2])


def k_core(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.k_core(_network(spark, sf)[0], 3)


def tight_edges(spark: SparkSession, sf: str) -> DataFrame:
    return cohort.tight_edges(_network(spark, sf)[0])


def _cohorts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Nodes of the network and its cohorts."""
    pairs, nodes, _ = _network(spark, sf)

    def build(stage: Stage) -> tuple:
        _, casc, accounts = _cascades(spark, sf)
        groups = stage.cut(cohort.communities(pairs, min_shared=MIN_SHARED))
        return (stage.cut(cohort.cohorts(casc, accounts, groups, nodes)),)

    return nodes, _once(spark, sf, "cohorts", build)[0]


def _by_cascade(coh: DataFrame, accounts: DataFrame) -> DataFrame:
    return cohort.cohorts_by_cascade(coh.select("cohort_id", F.explode("members").alias("account_handle")), accounts)


def cohort_by_cascade(spark: SparkSession, sf: str) -> DataFrame:
    return shown(_by_cascade(_cohorts(spark, sf)[1], _cascades(spark, sf)[2]))


def cohorts(spark: SparkSession, sf: str) -> DataFrame:
    return shown(_cohorts(spark, sf)[1])


def account_roles(spark: SparkSession, sf: str) -> DataFrame:
    posts, _, members, accounts = _accounts(spark, sf)
    when = posts.agg(F.max("posted_at")).first()[0]
    return shown(account.account_roles(members, accounts, cohort.cohorts_by_account(_cohorts(spark, sf)[1]), F.lit(when)))


def target_summary(spark: SparkSession, sf: str) -> DataFrame:
    posts, casc, members, accounts = _accounts(spark, sf)
    who = cascade.cascade_accounts(posts)
    nodes, coh = _cohorts(spark, sf)
    roles = account.account_roles(members, accounts, cohort.cohorts_by_account(coh))
    return shown(prop.amplified_targets(posts, casc, who, cascade.source_cascades(casc, who), members, nodes, roles))


def propagation(spark: SparkSession, sf: str) -> DataFrame:
    posts, casc, members, accounts = _accounts(spark, sf)
    nodes, coh = _cohorts(spark, sf)
    roles = account.account_roles(members, accounts, cohort.cohorts_by_account(coh))
    return shown(prop.propagation(posts, casc, members, nodes, roles, _by_cascade(coh, cascade.cascade_accounts(posts))))


def target_hhi(spark: SparkSession, sf: str) -> DataFrame:
    posts = posts_of(spark, sf).where("is_retweet")
    counts = posts.groupBy(F.col("content_author_handle").alias("target"), "author_handle").agg(F.count(F.lit(1)).alias("n"))
    return prop.hhi(counts, "target").select("target", F.round("hhi", 6).alias("hhi"))


def repeat_crew(spark: SparkSession, sf: str) -> DataFrame:
    _, casc, accounts = _cascades(spark, sf)
    return prop.repeat_crew(casc, accounts).select("original_author_handle", F.round("repeat_overlap", 6).alias("repeat_overlap"))


def burst(spark: SparkSession, sf: str) -> DataFrame:
    posts, casc, _ = _cascades(spark, sf)
    return prop.burst(prop.steps(posts, casc)).withColumn("kurtosis", F.round("kurtosis", 5))


def client_share(spark: SparkSession, sf: str) -> DataFrame:
    posts, casc, _ = _cascades(spark, sf)
    return prop.client_share(prop.steps(posts, casc)).withColumn("share", F.round("share", 6))


def role_mix(spark: SparkSession, sf: str) -> DataFrame:
    posts, _, members, accounts = _accounts(spark, sf)
    counts = posts.where("is_retweet").groupBy(F.col("content_author_handle").alias("target"), F.col("author_handle").alias("account_handle"))
    roles = account.account_roles(members, accounts, cohort.cohorts_by_account(_cohorts(spark, sf)[1]))
    return prop.role_mix(counts.agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("seen")), "target", roles)


def burst_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Amplifications and their accounts per original and quarter of an hour, as the streaming operator counts them."""
    from tidewake.streaming.bursts import burst_counts

    return shown(burst_counts(posts_of(spark, sf)))


def spread_path(spark: SparkSession, sf: str) -> DataFrame:
    posts, casc, accounts = _cascades(spark, sf)
    nodes, coh = _cohorts(spark, sf)
    paths = prop.spread_paths(prop.steps(posts, casc), casc, nodes, _by_cascade(coh, accounts))
    one = lambda s: F.concat_ws(",", s["handle"], *[s[c].cast("string") for c in ("elapsed_sec", "component_id", "cohort_id")])
    return shown(paths.withColumn("steps", F.transform("steps", one)))


def first_profiles(spark: SparkSession, sf: str) -> DataFrame:
    _, casc, members, accounts = _accounts(spark, sf)
    nodes, coh = _cohorts(spark, sf)
    by_account = cohort.cohorts_by_account(coh)
    return shown(prop.first_profiles(casc, account.account_roles(members, accounts, by_account), by_account, nodes))


def _matrix(spark: SparkSession, sf: str) -> DataFrame:
    posts, _, members, accounts = _accounts(spark, sf)
    when = posts.agg(F.max("posted_at")).first()[0]
    led = cascade.first_amplifiers(posts)
    leads = led.groupBy(F.col("first_retweeter").alias("account_handle")).agg(F.count(F.lit(1)).alias("propagation_lead_count"))
    total = led.agg(F.count(F.lit(1)).alias("total_cascades"))
    nodes, coh = _cohorts(spark, sf)
    roles = account.account_roles(members, accounts, cohort.cohorts_by_account(coh))
    return account.feature_matrix(accounts, nodes, F.lit(when), roles, leads, total, coh)


def feature_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return _matrix(spark, sf)


def canonical_text(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/tweets.parquet")
    return rows.select("row_id", tx.canonical_text("text").alias("canonical"), F.array_join(tx.normalize_tokens("hashtags_raw"), "|").alias("tokens"))


def stored_canonical_text_differs(spark: SparkSession, sf: str) -> DataFrame:
    """Posts whose stored canonical form isn't the one of their text."""
    rows = spark.read.parquet(f"{sf}/tweets.parquet").withColumn("canonical", tx.canonical_text("text"))
    return rows.where("canonical <> canonical_text").select("row_id")


def client_label(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/raw_posts.parquet")
    source = F.get_json_object("payload", "$.source")
    return rows.where(F.get_json_object("payload", "$").isNotNull()).select("raw_id", tx.client_label(source).alias("client"))


def normalised_posts(spark: SparkSession, sf: str) -> DataFrame:
    """The post table's columns from raw payloads; normal forms of text and tokens are those of ``canonical_text``."""
    from tidewake.sources.posts import normalised_posts as normalised

    raw = spark.read.parquet(f"{sf}/raw_posts.parquet")
    rows = raw.select(F.col("raw_id").alias("row_id"), F.try_parse_json("payload").alias("post")).where("post is not null")
    return shown(normalised(rows).drop("canonical_text", "content_canonical_text", "hashtags", "mentions").withColumnRenamed("row_id", "raw_id"))


def handle_from_url(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/members.parquet").select("screen_name").distinct()
    forms = F.explode(F.array(F.concat(F.lit("https://social.example/"), "screen_name", F.lit("/status/1")), F.concat(F.lit(" @"), "screen_name"), F.concat("screen_name", F.lit("/"))))
    return rows.select("screen_name", forms.alias("given")).select("screen_name", "given", tx.clean_handle(F.col("given")).alias("handle"))


def members_placeholder(spark: SparkSession, sf: str) -> DataFrame:
    """The member list with placeholders for mentioned handles that it lacks."""
    from tidewake.sources.members import with_placeholders

    mentioned = posts_of(spark, sf).select(F.explode("mentions_raw").alias("value")).distinct()
    return with_placeholders(members_of(spark, sf), mentioned).select("screen_name", "member_id", "followers_count", "is_blue_verified")


def snapshot_asof(spark: SparkSession, sf: str) -> DataFrame:
    """Each export with the newest member snapshot not newer than it, else the newest of all."""
    from tidewake.operators.asof import latest_not_newer

    exports = spark.read.parquet(f"{sf}/tweets.parquet").select("export_id").distinct()
    snapshots = spark.read.parquet(f"{sf}/members.parquet").select("snapshot_id").distinct()
    return latest_not_newer(exports, "export_id", snapshots, "snapshot_id", fallback_newest=True)


def ml_features(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/ml_feature_matrix.parquet").distinct()
    return ml.model_features(rows).select("account_handle", *[F.round(f, 6).alias(f) for f in ml.FEATURES])


def ml_scaled(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/ml_feature_matrix.parquet").distinct()
    return ml.standardised(ml.model_features(rows)).select("account_handle", *[F.round(f, 5).alias(f) for f in ml.FEATURES])


def _model(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(run record, accounts, clusters); of an account's rows that differ the largest counts."""

    def build(stage: Stage) -> tuple:
        table = spark.read.parquet(f"{sf}/ml_feature_matrix.parquet")
        others = [c for c in table.columns if c != "account_handle"]
        rows = table.groupBy("account_handle").agg(F.max(F.struct(*others)).alias("r")).select("account_handle", "r.*")
        return tuple(map(stage.cut, ml.run_model(rows)))

    return _once(spark, sf, "model", build, "ml_feature_matrix")


def ml_run(spark: SparkSession, sf: str) -> DataFrame:
    return shown(_model(spark, sf)[0])


def ml_accounts(spark: SparkSession, sf: str) -> DataFrame:
    return _model(spark, sf)[1]


def ml_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return shown(_model(spark, sf)[2])


QUERIES = {
    f.__name__: f
    for f in (
        dataset_stats, missing_members, cascade_summary, source_cascades, token_hashtags, token_mentions, amplifier_edges, account_overlap, account_summary, coordination_score,
        overlap_nodes, overlap_components, k_core, tight_edges, cohort_by_cascade, cohorts, account_roles, target_summary, propagation, target_hhi, repeat_crew, burst, client_share, role_mix, burst_windows, spread_path, first_profiles, feature_matrix,
        canonical_text, stored_canonical_text_differs, client_label, normalised_posts, handle_from_url, members_placeholder, snapshot_asof, ml_features, ml_scaled, ml_run, ml_accounts, ml_clusters,
    )
}
