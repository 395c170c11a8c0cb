"""The summary and the Markdown report of an analysis: first rows of its tables."""

from __future__ import annotations

import datetime as dt
import json
from pathlib import Path

from pyspark.sql import DataFrame

from tidewake.sinks.tables import first_rows

# Parts of the summary, their tables and the number of rows in them.
PARTS = {
    "top_accounts": ("account_summary", 15),
    "top_cascades": ("retweet_cascades", 15),
    "top_user_cascades": ("retweet_user_cascades", 15),
    "top_hashtags": ("hashtag_summary", 15),
    "top_mentions": ("mention_summary", 15),
    "top_overlap_pairs": ("account_overlap", 15),
    "network_components": ("network_components", 15),
    "network_nodes": ("network_nodes", 15),
    "account_roles": ("account_roles", 25),
    "amplified_targets": ("amplified_targets", 25),
    "cohorts": ("cohorts", 25),
    "cascade_propagation": ("cascade_propagation", 15),
    "first_retweeter_profiles": ("first_retweeter_profiles", 25),
}
MODEL_PARTS = {"clusters": ("ml_clusters", 15), "top_anomalies": ("ml_accounts", 15)}
# Sections of the report, the summary's part and the columns shown.
SECTIONS = {
    "Accounts to review": ("top_accounts", ("account_handle", "tweet_count", "retweet_ratio", "first_retweeter_count", "top_amplified_account", "coordination_score")),
    "Largest cascades": ("top_cascades", ("original_tweet_id", "original_author_handle", "retweet_count", "unique_retweeter_count", "first_retweeter", "retweets_within_15m")),
    "Most amplified sources": ("top_user_cascades", ("original_author_handle", "total_retweet_count", "unique_retweeter_count", "top_cascade_tweet_id")),
    "Amplified targets": ("amplified_targets", ("amplified_author_handle", "total_inbound_retweets", "amplification_hhi", "repeat_crew_overlap", "amplification_score")),
    "Cohorts": ("cohorts", ("cohort_id", "member_count", "cascade_count", "median_time_tightness_sec", "top_target_author", "cohort_score")),
    "Propagation": ("cascade_propagation", ("original_tweet_id", "retweet_count", "time_to_k10_sec", "burst_peak_window_count", "same_client_share", "propagation_score")),
    "First amplifiers": ("first_retweeter_profiles", ("account_handle", "first_retweeter_count", "top_target_author", "target_hhi", "role_label")),
    "Account pairs": ("top_overlap_pairs", ("account_a", "account_b", "shared_retweets", "jaccard", "shared_within_15m")),
    "Components": ("network_components", ("component_id", "node_count", "edge_count", "density", "total_shared_retweets")),
    "Network accounts": ("network_nodes", ("account_handle", "component_id", "neighbor_count", "weighted_degree", "strongest_neighbor")),
    "Hashtags": ("top_hashtags", ("display_token", "count", "unique_account_count")),
    "Mentions": ("top_mentions", ("display_token", "count", "unique_account_count")),
    "Roles": ("account_roles", ("account_handle", "role_label", "role_confidence")),
}
MODEL_SECTIONS = {
    "Clusters": ("clusters", ("cluster_id", "account_count", "mean_coordination_score", "mean_retweet_ratio")),
    "Unusual accounts": ("top_anomalies", ("account_handle", "anomaly_rank", "anomaly_score", "cluster_id")),
}
NOTE = "All scores and roles are signals for a reviewer, not proof of coordination and no verdict about any account."


def _plain(value: object) -> object:
    return value.isoformat() if isinstance(value, (dt.date, dt.datetime)) else str(value)


def summary(tables: dict[str, DataFrame], stats: dict, inputs: dict | None = None) -> dict:
    rows = lambda parts: {k: first_rows(tables[t], t, n) if t in tables else [] for k, (t, n) in parts.items()}
    run = tables["ml_run"].first().asDict(recursive=True) if "ml_run" in tables else None
    return {"inputs": inputs or {}, "stats": stats, **rows(PARTS), "ml": {"run": run, **rows(MODEL_PARTS)}}


def _table(rows: list[dict], columns: tuple[str, ...]) -> list[str]:
    if not rows:
        return ["None found."]
    lines = [" | ".join(columns), " | ".join("---" for _ in columns), *(" | ".join(str(r.get(c)).replace("|", "\\|") for c in columns) for r in rows)]
    return [f"| {x} |" for x in lines]


def markdown(data: dict, rows: int = 10) -> str:
    out = ["# Amplification report", "", NOTE, "", "## Dataset", "", *(f"- {k}: {v}" for k, v in data["stats"].items())]
    for sections, part in ((SECTIONS, data), (MODEL_SECTIONS, data["ml"])):
        if part is not data:
            out += ["", "## Model run", "", *(f"- {k}: {v}" for k, v in (part["run"] or {}).items() if k != "feature_names")]
        for title, (name, columns) in sections.items():
            out += ["", f"## {title}", "", *_table(part[name][:rows], columns)]
    return "\n".join(out) + "\n"


def write(tables: dict[str, DataFrame], stats: dict, folder: Path, inputs: dict | None = None) -> None:
    data = summary(tables, stats, inputs)
    (folder / "summary.json").write_text(json.dumps(data, ensure_ascii=False, indent=2, default=_plain))
    (folder / "report.md").write_text(markdown(data))
