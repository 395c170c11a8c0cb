"""Result tables as flat files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Row order of each table, a leading minus for falling.
ORDERS = {
    "retweet_cascades": "-retweet_count first_retweet_at original_tweet_id",
    "retweet_user_cascades": "-total_retweet_count -unique_retweeter_count original_author_handle",
    "hashtag_summary": "-count token",
    "mention_summary": "-count token",
    "retweet_edges": "-count retweeter source_author",
    "account_overlap": "-shared_retweets -shared_within_15m account_a account_b",
    "account_summary": "-coordination_score -tweet_count account_handle",
    "ml_feature_matrix": "-coordination_score -tweet_count account_handle",
    "network_nodes": "component_id -weighted_degree -neighbor_count account_handle",
    "network_components": "component_id",
    "cohorts": "cohort_id",
    "amplified_targets": "-amplification_score -total_inbound_retweets -amplification_hhi amplified_author_handle",
    "cascade_propagation": "-propagation_score -retweet_count original_tweet_id",
    "first_retweeter_profiles": "-first_retweeter_count -target_hhi account_handle",
    "ml_accounts": "anomaly_rank cluster_id account_handle",
    "ml_clusters": "-account_count cluster_id",
    "normalized_tweets": "row_id",
    "cohort_members": "cohort_id member_handle",
    "missing_members": "account_handle",
    "account_roles": "role_priority -role_confidence account_handle",
}


def order_of(name: str) -> list[Column]:
    return [F.desc(c[1:]) if c[0] == "-" else F.asc_nulls_last(c) for c in ORDERS.get(name, "").split()]


def in_order(df: DataFrame, name: str) -> DataFrame:
    """Rows in the table's order; of roles, the surest kinds first."""
    if name == "account_roles":
        ranks = ["source_hub", "media_business", "journalist_public_figure", "amplifier_suspect", "retail_user", "mixed_behavior", "unknown"]
        df = df.withColumn("role_priority", F.array_position(F.array(*map(F.lit, ranks)), F.col("role_label")))
        return df.orderBy(*order_of(name)).drop("role_priority")
    return df.orderBy(*order_of(name)) if name in ORDERS else df


def as_cells(df: DataFrame, lists_as_json: bool = False) -> DataFrame:
    """Every column as text: ISO times, True/False, lists joined by ``|`` or as JSON."""

    def cell(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType):
            c = F.to_json(c) if lists_as_json else F.array_join(c.cast("array<string>"), "|")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            at = c.cast("timestamp")  # ISO, with a fraction where there is one, in the session's zone
            c = F.when(F.unix_micros(at) % 1_000_000 == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ssxxx")).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"))
        elif isinstance(f.dataType, T.BooleanType):
            c = F.initcap(c.cast("string"))
        return c.cast("string").alias(f.name)

    return df.select(*[cell(f) for f in df.schema.fields])


def write_csv(df: DataFrame, path: str, name: str = "", lists_as_json: bool = False) -> None:
    """A CSV table (a folder of parts in the table's order, each with a header)."""
    as_cells(in_order(df, name), lists_as_json).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="", nullValue="")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def first_rows(df: DataFrame, name: str, n: int) -> list[dict]:
    """The first ``n`` rows of a table in its order, for reports."""
    return [r.asDict(recursive=True) for r in in_order(df, name).limit(n).collect()]
