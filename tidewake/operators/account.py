"""Accounts: activity summary, coordination score, roles and the numeric feature matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.operators.cascade import seconds


def current_members(members: DataFrame) -> DataFrame:
    """The member list as of its latest snapshot: per screen name the row loaded last."""
    if "snapshot_id" not in members.columns:
        return members
    latest = members.agg(F.max("snapshot_id").alias("s"))
    rows = members.join(F.broadcast(latest), members["snapshot_id"] == latest["s"], "left_semi")
    fields = [c for c in members.columns if c not in ("snapshot_id", "loaded_at", "screen_name")]
    picked = rows.groupBy("screen_name").agg(F.max_by(F.struct(*fields), F.struct("loaded_at", "member_id")).alias("m"))
    return picked.where("screen_name is not null").select("screen_name", "m.*")


def coordination_score() -> Column:
    """0 to 100 from the ratios (rounded to 4 places): a review signal, no verdict. Summed
    as decimals, so that halves round up on any engine."""
    share = lambda c: F.col(c).cast("decimal(10,4)")
    whole = lambda n: F.lit(n).cast("decimal(4,2)")
    return F.round(
        F.least(share("retweet_ratio"), F.lit(1).cast("decimal(10,4)")) * whole(35)
        + F.when((F.col("tweet_count") >= 5) & (F.col("original_count") == 0), whole(15)).otherwise(whole(0))
        + F.least(F.col("first_retweeter_count"), F.lit(20)).cast("decimal(10,0)") * F.lit(1.25).cast("decimal(3,2)")
        + share("top_amplified_share") * whole(10)
        + share("retweets_to_member_ratio") * whole(15),
        2,
    ).cast("double")


def account_summary(posts: DataFrame, members: DataFrame, firsts: DataFrame) -> DataFrame:
    """One row per account that posted. ``firsts`` has each cascade's ``first_retweeter``. The most amplified source of an account is, of
    equally often amplified ones, the one it amplified first."""
    boost = F.col("is_retweet")
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    base = posts.groupBy("author_handle").agg(
        F.count(F.lit(1)).alias("tweet_count"),
        F.count_if(boost).alias("retweet_count"),
        F.count_if("is_quote").alias("quote_count"),
        F.countDistinct(F.when(boost, F.col("content_tweet_id"))).alias("unique_retweeted_tweet_count"),
        F.sum(size("hashtags")).alias("hashtag_count"),
        F.sum(size("mentions")).alias("mention_count"),
    )
    listed = members.select(F.col("screen_name").alias("source"), F.lit(True).alias("listed"))
    sources = (
        posts.where(boost)
        .groupBy("author_handle", F.col("content_author_handle").alias("source"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("seen"))
        .join(listed, "source", "left")
        .groupBy("author_handle")
        .agg(
            F.count(F.lit(1)).alias("unique_retweeted_author_count"),
            F.sum(F.when(F.col("listed"), F.col("n")).otherwise(0)).alias("retweets_to_member_count"),
            F.max_by(F.struct("source", "n"), F.struct("n", (-F.col("seen")).alias("seen"))).alias("top"),
        )
    )
    led = firsts.groupBy(F.col("first_retweeter").alias("author_handle")).agg(F.count(F.lit(1)).alias("first_retweeter_count"))
    profile = members.select(
        F.col("screen_name").alias("author_handle"), F.lit(True).alias("in_list"), "followers_count", "friends_count", "statuses_count",
        F.col("created_at").alias("account_created_at"), "default_profile", "default_profile_image", "is_blue_verified", "profile_description_language",
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(zero(a), F.col(b)), F.lit(0.0)), 4)
    out = base.join(sources, "author_handle", "left").join(led, "author_handle", "left").join(profile, "author_handle", "left")
    out = out.select(
        F.col("author_handle").alias("account_handle"),
        F.coalesce("in_list", F.lit(False)).alias("in_member_list"),
        "tweet_count",
        "retweet_count",
        (F.col("tweet_count") - F.col("retweet_count")).alias("original_count"),
        "quote_count",
        ratio("retweet_count", "tweet_count").alias("retweet_ratio"),
        zero("first_retweeter_count").alias("first_retweeter_count"),
        "unique_retweeted_tweet_count",
        zero("unique_retweeted_author_count").alias("unique_retweeted_author_count"),
        zero("retweets_to_member_count").alias("retweets_to_member_count"),
        ratio("retweets_to_member_count", "retweet_count").alias("retweets_to_member_ratio"),
        F.col("top.source").alias("top_amplified_account"),
        zero("top.n").alias("top_amplified_count"),
        ratio("top.n", "retweet_count").alias("top_amplified_share"),
        "hashtag_count",
        "mention_count",
        "followers_count",
        "friends_count",
        "statuses_count",
        "account_created_at",
        "default_profile",
        "default_profile_image",
        "is_blue_verified",
        "profile_description_language",
    )
    return out.withColumn("coordination_score", coordination_score())


# Words of a member description by kind, and beginnings of words.
KEYWORDS = {
    "media": (
        "news", "media", "press", "tv", "radio", "newspaper", "magazine", "journal", "official", "channel", "broadcast", "bulletin", "newsroom", "agency", "gazette",
        "publisher", "times", "herald", "tribune", "daily", "report", "reporter", "reporters", "εφημερίδα", "τηλεόραση", "κανάλι", "ειδήσεις",
    ),
    "business": ("Ltd", "LLC", "Inc", "GmbH", "S.A", "BV", "Company", "Corp", "AE", "EPE", "IKE"),
    "journalist": ("journalist", "reporter", "editor", "correspondent", "anchor", "columnist", "writer", "author", "δημοσιογράφος", "συντάκτης", "αρθρογράφος"),
    "public_figure": (
        "MP", "minister", "politician", "mayor", "president", "senator", "CEO", "founder", "professor", "βουλευτής", "υπουργός", "δήμαρχος", "πρόεδρος", "καθηγητής",
    ),
}
STEMS = {"media": ("δημοσιογρ",)}


def keyword_pattern(kind: str) -> str:
    """One case-blind alternation with word boundaries, in any script."""
    parts = [w.replace(".", r"\.") + r"\b" for w in KEYWORDS[kind]] + list(STEMS.get(kind, ()))
    return r"(?iU)\b(?:" + "|".join(parts) + ")"


def age_days(reference_time: Column) -> Column:
    """Whole days since the account's creation, 0 at least; null if that is unknown."""
    days = F.floor(seconds(reference_time, F.col("account_created_at")) / 86400)
    return F.when(days.isNotNull(), F.greatest(days, F.lit(0)))


def follower_ratio(followers: Column, friends: Column) -> Column:
    """Null if unknown or nobody on either side; infinite without friends."""
    return F.when(friends > 0, followers / friends).when((friends <= 0) & (followers > 0), F.lit(float("inf")))


def account_roles(members: DataFrame, accounts: DataFrame, cohort_accounts: DataFrame | None = None, reference_time: Column | None = None) -> DataFrame:
    """A review role per account with its confidence and the signals behind it.

    Roles steer an analyst and accuse nobody. ``cohort_accounts`` is ``(account_handle,
    cohort_ids)``. Ages are taken at ``reference_time``, so a result can be repeated.
    """
    told = members.select(F.col("screen_name").alias("account_handle"), "description", "listed_count", F.lit(True).alias("known"))
    rows = accounts.join(told, "account_handle", "left")
    if cohort_accounts is not None:
        rows = rows.join(cohort_accounts, "account_handle", "left")
    else:
        rows = rows.withColumn("cohort_ids", F.lit(None).cast("array<bigint>"))
    text = F.coalesce("description", F.lit(""))
    says = {k: F.regexp_like(text, F.lit(keyword_pattern(k))) for k in KEYWORDS}
    rows = rows.select("*", *[v.alias(f"says_{k}") for k, v in says.items()], follower_ratio(F.col("followers_count"), F.col("friends_count")).alias("ff"))
    c, yes = F.col, lambda x: F.coalesce(x, F.lit(False))
    cohort = yes(F.size("cohort_ids") > 0)
    outlet = c("says_media") | c("says_business")
    figure = c("says_journalist") | c("says_public_figure")
    verified = yes(c("is_blue_verified"))
    plus = lambda when, by: F.when(yes(when), by).otherwise(0.0)
    roles = [
        ("source_hub", (c("tweet_count") >= 3) & (c("retweet_ratio") <= 0.3) & (c("original_count") >= 3), F.lit(0.9)),
        (
            "media_business",
            outlet | yes(c("listed_count") >= 50) | yes((c("followers_count") >= 10_000) & (c("ff") >= 25)),
            0.5 + plus(outlet, 0.2) + plus(c("listed_count") >= 100, 0.15) + plus(c("followers_count") >= 250_000, 0.15),
        ),
        ("journalist_public_figure", figure & (verified | yes(c("followers_count") >= 5000) | yes(c("ff") >= 3)), 0.55 + plus(verified, 0.2) + plus(figure, 0.2)),
        (
            "amplifier_suspect",
            (c("tweet_count") >= 5) & (c("retweet_ratio") >= 0.85) & (c("original_count") <= 1) & (cohort | (c("top_amplified_share") >= 0.5) | (c("first_retweeter_count") >= 3)),
            0.55 + plus(c("retweet_ratio") >= 0.95, 0.1) + plus(c("original_count") == 0, 0.1) + plus(c("top_amplified_share") >= 0.5, 0.1) + plus(cohort, 0.1)
            + plus(c("first_retweeter_count") >= 3, 0.05),
        ),
        (
            "retail_user",
            yes(c("known")) & yes(c("followers_count") < 5000) & ~yes(c("listed_count") >= 10) & ~((c("retweet_ratio") >= 0.9) & (c("original_count") == 0)),
            F.lit(0.6),
        ),
        ("mixed_behavior", c("tweet_count") >= 3, F.lit(0.4)),
    ]
    label, sure = F.lit("unknown"), F.lit(0.2)
    for name, rule, confidence in reversed(roles):
        label, sure = F.when(rule, name).otherwise(label), F.when(rule, F.least(confidence, F.lit(0.99))).otherwise(sure)
    busy = c("tweet_count") >= 5
    shown = lambda when, *parts: F.when(yes(when), F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))
    count = lambda n: F.coalesce(n, F.lit(0)).cast("string")
    signals = F.array_compact(
        F.array(
            *[shown(c(f"says_{k}"), f"description_{k}_keyword") for k in KEYWORDS],
            shown(c("listed_count") >= 50, "listed_count>=50(", count(c("listed_count")), ")"),
            shown(c("followers_count") >= 100_000, "followers>=100k(", count(c("followers_count")), ")"),
            shown(c("ff") >= 25, "followers_friends_ratio>=25(", F.when(c("ff") == float("inf"), "inf").otherwise(F.format_string("%.1f", c("ff"))), ")"),
            shown(verified, "blue_verified"),
            shown(c("default_profile"), "default_profile"),
            shown(c("default_profile_image"), "default_profile_image"),
            shown((c("retweet_ratio") >= 0.85) & busy, "retweet_ratio>=0.85(", F.format_string("%.2f", c("retweet_ratio")), ")"),
            shown((c("original_count") <= 1) & busy, "zero_or_single_original"),
            shown(c("first_retweeter_count") >= 3, "first_retweeter_count>=3(", count(c("first_retweeter_count")), ")"),
            shown((c("top_amplified_share") >= 0.6) & (c("retweet_count") >= 5), "top_amplified_share>=0.6(", F.format_string("%.2f", c("top_amplified_share")), ")"),
            shown(cohort, "cohort_member(", count(F.size("cohort_ids")), ")"),
        )
    )
    age = age_days(reference_time) if reference_time is not None else F.lit(None).cast("bigint")
    return rows.select(
        "account_handle", label.alias("role_label"), F.round(sure, 4).alias("role_confidence"), c("in_member_list").alias("is_member"), signals.alias("signals"), "followers_count",
        "friends_count", F.round("ff", 4).alias("followers_friends_ratio"), "listed_count", c("profile_description_language").alias("description_language"),
        F.length(F.trim(text)).cast("bigint").alias("description_length"), "is_blue_verified", "default_profile", age.alias("account_age_days"), "retweet_ratio", "original_count",
        F.coalesce("cohort_ids", F.array().cast("array<bigint>")).alias("cohort_ids"),
    )


# Roles with a flag among the features.
FLAGGED_ROLES = ("retail_user", "amplifier_suspect", "media_business", "journalist_public_figure", "source_hub")


def feature_matrix(
    accounts: DataFrame, nodes: DataFrame, reference_time: Column, roles: DataFrame, leads: DataFrame, total_cascades: DataFrame, cohorts: DataFrame | None = None
) -> DataFrame:
    """One numeric row per account: activity, profile, network, cohort, role and lead features.

    ``leads`` is ``(account_handle, propagation_lead_count)``, ``total_cascades`` one row
    ``(total_cascades)``. What an account isn't part of is 0; unknown profile
    figures stay null.
    """
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("bigint")
    per_cohort = None
    if cohorts is not None:
        per_cohort = (
            cohorts.select(F.explode("members").alias("account_handle"), "member_count", "cascade_count")
            .groupBy("account_handle")
            .agg(F.count(F.lit(1)).alias("cohort_count"), F.max("member_count").alias("cohort_max_size"), F.max("cascade_count").alias("cohort_max_cascade_count"))
        )
    rows = accounts.join(nodes, "account_handle", "left").join(roles.select("account_handle", "role_label"), "account_handle", "left").join(leads, "account_handle", "left")
    rows = rows.join(F.broadcast(total_cascades), F.lit(True), "left")
    if per_cohort is not None:
        rows = rows.join(per_cohort, "account_handle", "left")
    else:
        rows = rows.select("*", *[F.lit(0).alias(c) for c in ("cohort_count", "cohort_max_size", "cohort_max_cascade_count")])
    flag = lambda x: F.col(x).cast("bigint").alias(x)
    return rows.select(
        "account_handle", "tweet_count", "retweet_count", "original_count", "quote_count", "retweet_ratio", "first_retweeter_count", "unique_retweeted_tweet_count",
        "unique_retweeted_author_count", "retweets_to_member_count", "retweets_to_member_ratio", "top_amplified_count", "top_amplified_share", "hashtag_count",
        "mention_count", "followers_count", "friends_count", "statuses_count", age_days(reference_time).alias("account_age_days"), flag("default_profile"), flag("default_profile_image"),
        flag("is_blue_verified"),
        *[zero(a).alias("network_" + a) for a in ("component_size", "neighbor_count", "weighted_degree", "within_15m_weight", "within_60m_weight", "max_shared_edge")],
        *[zero(a).alias(a) for a in ("cohort_count", "cohort_max_size", "cohort_max_cascade_count")],
        *[zero((F.col("role_label") == r).cast("bigint")).alias("role_" + r) for r in FLAGGED_ROLES],
        F.round(F.coalesce(F.try_divide(F.col("first_retweeter_count"), F.col("total_cascades")), F.lit(0.0)), 4).alias("first_retweeter_ratio"),
        zero("propagation_lead_count").alias("propagation_lead_count"), "coordination_score", F.lit("").alias("analyst_label"),
    )
