"""The whole analysis of a member list and a post table."""

from __future__ import annotations

import datetime as dt
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake import curation
from tidewake.operators import account, cascade, cohort, ml, overlap
from tidewake.operators import propagation as prop
from tidewake.session import Stage
from tidewake.sinks import report
from tidewake.sinks.tables import write_csv, write_jsonl
from tidewake.sources import discovery
from tidewake.sources.members import extra_handles, members_clean_csv, read_members
from tidewake.sources.posts import export_rows, normalised_posts, posts_clean_csv


def analyse(posts: DataFrame, members: DataFrame, min_shared: int = 2, with_ml: bool = True, clusters: int | None = None, seed: int = 42) -> dict[str, DataFrame]:
    """All result tables by name. Tables that several others read are written once."""
    stage = Stage(posts.sparkSession)
    posts, members = stage.cut(posts), stage.cut(account.current_members(members))
    casc, who = stage.cut(cascade.cascades(posts)), stage.cut(cascade.cascade_accounts(posts))
    sources = cascade.source_cascades(casc, who)
    accounts = stage.cut(account.account_summary(posts, members, casc))
    pairs = stage.cut(overlap.account_overlap(posts, min_shared))
    nodes, parts = overlap.overlap_network(pairs)
    groups = stage.cut(cohort.communities(pairs, seed, min_shared))
    cohorts = stage.cut(cohort.cohorts(casc, who, groups, nodes))
    by_account = cohort.cohorts_by_account(cohorts)
    in_cohort = cohorts.select("cohort_id", F.explode("members").alias("account_handle"))
    by_cascade = stage.cut(cohort.cohorts_by_cascade(in_cohort, who))
    when = F.lit(posts.agg(F.max("posted_at")).first()[0]).cast("timestamp")
    roles = stage.cut(account.account_roles(members, accounts, by_account, when))
    leads = casc.groupBy(F.col("first_retweeter").alias("account_handle")).agg(F.count(F.lit(1)).alias("propagation_lead_count"))
    matrix = stage.cut(account.feature_matrix(accounts, nodes, when, roles, leads, casc.agg(F.count(F.lit(1)).alias("total_cascades")), cohorts))
    out = {
        "dataset_stats": cascade.dataset_stats(posts, members),
        "normalized_tweets": posts,
        "account_summary": accounts,
        "retweet_cascades": casc.join(cascade.retweeter_lists(who), "original_tweet_id"),
        "retweet_user_cascades": sources,
        "retweet_edges": cascade.amplifier_edges(posts),
        "hashtag_summary": cascade.tokens(posts, "hashtags"),
        "mention_summary": cascade.tokens(posts, "mentions"),
        "account_overlap": pairs,
        "network_nodes": nodes,
        "network_components": parts,
        "account_roles": roles,
        "amplified_targets": prop.amplified_targets(posts, casc, who, sources, members, nodes, roles),
        "cohorts": cohorts,
        "cohort_members": cohorts.select("cohort_id", F.explode("members").alias("member_handle"), "cohort_score", F.col("member_count").alias("cohort_size")),
        "missing_members": cascade.missing_members(posts, members),
        "cascade_propagation": prop.propagation(posts, casc, members, nodes, roles, by_cascade),
        "cascade_spread_paths": prop.spread_paths(prop.steps(posts, casc), casc, nodes, by_cascade),
        "first_retweeter_profiles": prop.first_profiles(casc, roles, by_account, nodes),
        "ml_feature_matrix": matrix,
    }
    if with_ml:
        return out | dict(zip(("ml_run", "ml_accounts", "ml_clusters"), ml.run_model(matrix, clusters, seed)))
    return out | {"ml_run": ml.run_record(posts.sparkSession, "skipped_disabled", matrix.count(), note="disabled by the caller")}


def write_outputs(tables: dict[str, DataFrame], folder: Path, inputs: dict | None = None) -> dict[str, Path]:
    """Every table as CSV (spread paths as JSON lines), a summary (with the model's run record) and a report."""
    folder.mkdir(parents=True, exist_ok=True)
    out = {}
    for name, df in tables.items():
        if name in ("dataset_stats", "ml_run"):
            continue
        out[name] = folder / (f"{name}.jsonl" if name == "cascade_spread_paths" else f"{name}.csv")
        if name == "cascade_spread_paths":
            write_jsonl(df.orderBy(F.desc(F.size("steps")), F.asc_nulls_last("first_retweet_at"), "original_tweet_id"), str(out[name]))
        else:
            write_csv(df, str(out[name]), name)
    stats = {k: v.isoformat() if isinstance(v, dt.datetime) else v for k, v in tables["dataset_stats"].first().asDict().items()}
    report.write(tables, stats, folder, inputs or {})
    return out | {"summary": folder / "summary.json", "report": folder / "report.md"}


def run_raw(spark: SparkSession, folder: Path, output: Path, members: Path | None = None, exporter: Path | None = None, extra: Path | None = None, **options) -> dict[str, Path]:
    files = discovery.dataset(folder, members, exporter, extra)
    more = extra_handles(spark, str(files["extra_members"])) if files["extra_members"] else None
    posts = normalised_posts(export_rows(spark, str(files["exporter"])))
    return write_outputs(analyse(posts, read_members(spark, str(files["members"]), more), **options), output, {k: str(v) if v else None for k, v in files.items()})


def run_clean(spark: SparkSession, clean: Path, output: Path, batch_id: str | None = None, **options) -> dict[str, Path]:
    batch = curation.resolve(spark, clean, batch_id)
    posts = posts_clean_csv(spark, str(batch["tweets"]))
    return write_outputs(analyse(posts, members_clean_csv(spark, str(batch["members"])), **options), output)
