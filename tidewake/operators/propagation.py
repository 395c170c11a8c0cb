"""How cascades spread, who starts them, and which sources get amplified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.operators.cascade import cascade_order, seconds

PEAK_WINDOW_S = 60


def median_floor(values: Column) -> Column:
    """Integer median: of an even number of values the floor of the middle two's mean."""
    return F.floor(F.percentile(values, F.lit(0.5))).cast("bigint")


def hhi(counts: DataFrame, by: str, n: str = "n") -> DataFrame:
    """``(<by>, hhi)``: sum of squared shares of the counts in each group."""
    total = counts.groupBy(by).agg(F.sum(n).alias("s"), F.sum(F.pow(F.col(n).cast("double"), F.lit(2.0))).alias("q"))
    return total.select(by, (F.col("q") / (F.col("s") * F.col("s"))).alias("hhi"))


def role_mix(counts: DataFrame, by: str, roles: DataFrame | None, top: int = 4) -> DataFrame:
    """``(<by>, role_mix)``: the ``top`` roles of a group's accounts, weighted by ``n``, as
    ``role:0.00`` in falling order; ``counts`` is ``(<by>, account_handle, n, seen)``."""
    labels = roles.select("account_handle", "role_label") if roles is not None else counts.select("account_handle", F.lit("unknown").alias("role_label")).limit(0)
    per_role = (
        counts.join(labels, "account_handle", "left")
        .groupBy(by, F.coalesce("role_label", F.lit("unknown")).alias("label"))
        .agg(F.sum("n").alias("n"), F.min("seen").alias("seen"))
    )
    # a group has seven roles at most
    listed = per_role.groupBy(by).agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "seen", "label"))).alias("r"))
    share = F.transform(F.slice("r", 1, top), lambda x: F.concat(x["label"], F.lit(":"), F.call_function("format_number", -x["n"] / F.col("total"), F.lit("0.00"))))
    return listed.select(by, F.array_join(share, "; ").alias("role_mix"))


def steps(posts: DataFrame, casc: DataFrame) -> DataFrame:
    """``(original_tweet_id, k, account_handle, elapsed, source_client)``: every amplification with
    its key in the cascade's order and whole seconds since the first (0 if a time is missing)."""
    boosts = posts.where("is_retweet").select(
        F.col("content_tweet_id").alias("original_tweet_id"), F.col("author_handle").alias("account_handle"), "posted_at", "source_client", cascade_order().alias("k")
    )
    start = casc.select("original_tweet_id", "first_retweet_at")
    elapsed = F.coalesce(seconds("posted_at", "first_retweet_at").cast("bigint"), F.lit(0).cast("bigint"))
    return boosts.join(start, "original_tweet_id").select("original_tweet_id", "k", "account_handle", elapsed.alias("elapsed"), "source_client")


def first_steps(step_rows: DataFrame, n: int) -> DataFrame:
    """The first ``n`` steps of every cascade with their place ``rn``; every task keeps no more
    than that of a cascade before anything is shuffled."""
    order = Window.partitionBy("original_tweet_id").orderBy("k")
    return step_rows.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n)


def burst(step_rows: DataFrame) -> DataFrame:
    """Per cascade: times to the 5th, 10th and 50th step, excess kurtosis of the times
    (0 under four steps or without spread), and the fullest window of 60 s inclusive.

    Steps of a second are counted before they are shuffled; the windows run over
    seconds, so a cascade costs what its time span does, however many steps it has.
    """
    ahead = Window.partitionBy("original_tweet_id").orderBy("elapsed").rangeBetween(0, PEAK_WINDOW_S)
    per_second = step_rows.groupBy("original_tweet_id", "elapsed").agg(F.count(F.lit(1)).alias("n"))
    counted = per_second.withColumn("w", F.sum("n").over(ahead))
    peaks = counted.groupBy("original_tweet_id").agg(F.max(F.struct("w", (-F.col("elapsed")).alias("e"))).alias("peak"))
    reach = lambda k: F.max(F.when(F.col("rn") == k, F.col("elapsed"))).alias(f"time_to_k{k}_sec")
    reached = first_steps(step_rows, 50).groupBy("original_tweet_id").agg(reach(5), reach(10), reach(50))
    spread = F.when((F.count(F.lit(1)) >= 4) & (F.min("elapsed") < F.max("elapsed")), F.kurtosis("elapsed")).otherwise(0.0)
    spreads = step_rows.groupBy("original_tweet_id").agg(spread.alias("kurtosis"))
    return (
        reached.join(spreads, "original_tweet_id")
        .join(peaks, "original_tweet_id")
        .select(
            "original_tweet_id", "time_to_k5_sec", "time_to_k10_sec", "time_to_k50_sec", "kurtosis", (-F.col("peak.e")).alias("burst_peak_window_start_sec"),
            F.col("peak.w").alias("burst_peak_window_count"),
        )
    )


def client_share(step_rows: DataFrame) -> DataFrame:
    """``(original_tweet_id, dominant_client, share)`` of all steps; of equally frequent
    clients the one seen first."""
    per = step_rows.groupBy("original_tweet_id", F.nullif("source_client", F.lit("")).alias("client")).agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("seen"))
    named = F.when(F.col("client").isNotNull(), F.struct((-F.col("n")).alias("n"), "seen", "client"))
    best = per.groupBy("original_tweet_id").agg(F.sum("n").alias("total"), F.min(named).alias("b"))
    return best.select("original_tweet_id", F.col("b.client").alias("dominant_client"), F.coalesce(-F.col("b.n") / F.col("total"), F.lit(0.0)).alias("share"))


def spread_paths(step_rows: DataFrame, casc: DataFrame, nodes: DataFrame, cascade_cohorts: DataFrame | None, limit: int | None = None) -> DataFrame:
    """``(original_tweet_id, original_author_handle, first_retweet_at, steps)``: ordered
    steps (handle, elapsed_sec, component_id or 0, first cohort id or 0). With ``limit``
    only the first steps of each cascade are read; without, a row holds its whole
    cascade, as the path files do."""
    part = first_steps(step_rows, limit) if limit else step_rows
    rows = part.join(nodes.select("account_handle", "component_id"), "account_handle", "left")
    if cascade_cohorts is not None:
        rows = rows.join(cascade_cohorts.select("original_tweet_id", F.col("cohort_ids")[0].alias("cohort")), "original_tweet_id", "left")
    else:
        rows = rows.withColumn("cohort", F.lit(None).cast("bigint"))
    step = F.struct(
        F.col("account_handle").alias("handle"), F.col("elapsed").alias("elapsed_sec"), F.coalesce("component_id", F.lit(0)).cast("bigint").alias("component_id"),
        F.coalesce("cohort", F.lit(0)).cast("bigint").alias("cohort_id"),
    )
    listed = rows.groupBy("original_tweet_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", step.alias("s")))), lambda x: x["s"]).alias("steps"))
    return casc.select("original_tweet_id", "original_author_handle", "first_retweet_at").join(listed, "original_tweet_id")


def path_preview(path: Column) -> Column:
    one = lambda s: F.concat(s["handle"], F.lit("@+"), s["elapsed_sec"].cast("string"), F.lit("s[c"), s["component_id"].cast("string"), F.lit("/h"), s["cohort_id"].cast("string"), F.lit("]"))
    return F.array_join(F.transform(F.slice(path, 1, 5), one), " -> ")


def propagation_score(n: Column, k10: Column, kurt: Column, client: Column, cohorts: Column) -> Column:
    speed = F.coalesce(F.greatest(F.lit(0.0), 25 - F.least(k10, F.lit(3600)) / 180), F.lit(0.0))
    return 8 * F.log1p(n) + speed + 1.5 * F.greatest(F.lit(0.0), F.least(kurt, F.lit(10.0))) + 12 * client + 6 * F.log1p(cohorts)


def propagation(posts: DataFrame, casc: DataFrame, members: DataFrame, nodes: DataFrame, roles: DataFrame | None = None, cascade_cohorts: DataFrame | None = None) -> DataFrame:
    """Speed, burst, client and reach figures of every cascade with a score from the
    unrounded ones. ``cascade_cohorts`` is ``(original_tweet_id, cohort_ids)``."""
    st = steps(posts, casc)
    counts = st.groupBy("original_tweet_id", "account_handle").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("seen"))
    parts = (
        counts.join(nodes.select("account_handle", "component_id"), "account_handle").groupBy("original_tweet_id").agg(F.array_sort(F.collect_set("component_id")).alias("amplifier_component_ids"))
    )
    led = casc.groupBy("first_retweeter").agg(F.count(F.lit(1)).alias("first_retweeter_recurrence"))
    listed = members.select(F.col("screen_name").alias("original_author_handle"), F.lit(True).alias("listed"))
    preview = spread_paths(st, casc, nodes, cascade_cohorts, 5).select("original_tweet_id", path_preview(F.col("steps")).alias("spread_path_preview"))
    rows = casc.join(burst(st), "original_tweet_id").join(client_share(st), "original_tweet_id").join(role_mix(counts, "original_tweet_id", roles), "original_tweet_id")
    rows = rows.join(parts, "original_tweet_id", "left").join(led, "first_retweeter", "left").join(listed, "original_author_handle", "left").join(preview, "original_tweet_id")
    if cascade_cohorts is not None:
        rows = rows.join(cascade_cohorts.select("original_tweet_id", F.col("cohort_ids").alias("ch")), "original_tweet_id", "left")
    else:
        rows = rows.withColumn("ch", F.lit(None).cast("array<bigint>"))
    none = F.array().cast("array<bigint>")
    score = propagation_score(F.col("retweet_count"), F.col("time_to_k10_sec"), F.col("kurtosis"), F.col("share"), F.coalesce(F.size("ch"), F.lit(0)))
    return rows.select(
        "original_tweet_id", "original_author_handle", F.coalesce("listed", F.lit(False)).alias("origin_is_member"), "retweet_count", "unique_retweeter_count", "first_retweeter",
        F.coalesce("first_retweeter_recurrence", F.lit(0)).alias("first_retweeter_recurrence"), "time_to_k5_sec", "time_to_k10_sec", "time_to_k50_sec",
        F.round("kurtosis", 4).alias("burst_kurtosis"), "burst_peak_window_start_sec", "burst_peak_window_count", F.round("share", 4).alias("same_client_share"), "dominant_client",
        F.coalesce("amplifier_component_ids", none).alias("amplifier_component_ids"), F.coalesce("ch", none).alias("amplifier_cohort_ids"),
        F.col("role_mix").alias("amplifier_role_mix"), F.round(score, 4).alias("propagation_score"), "spread_path_preview",
    )


def first_profiles(casc: DataFrame, roles: DataFrame | None = None, cohort_accounts: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """One row per account that led a cascade. The lag is the mean gap between steps of a
    cascade (whole seconds), its median over the cascades the account led."""
    gap = F.when(
        (F.col("retweet_count") >= 2) & F.col("last_retweet_at").isNotNull() & F.col("first_retweet_at").isNotNull(),
        F.floor(seconds("last_retweet_at", "first_retweet_at").cast("bigint") / (F.col("retweet_count") - 1)),
    )
    led = casc.where("first_retweeter is not null").groupBy(F.col("first_retweeter").alias("account_handle"))
    base = led.agg(F.count(F.lit(1)).alias("first_retweeter_count"), median_floor(gap).alias("median_lag_to_second_retweet_sec"))
    counts = casc.where("first_retweeter is not null").groupBy(F.col("first_retweeter").alias("account_handle"), F.col("original_author_handle").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy("account_handle").agg(F.count(F.lit(1)).alias("unique_targets_first"), F.min(F.struct((-F.col("n")).alias("n"), "t")).alias("b"))
    out = base.join(top, "account_handle").join(hhi(counts, "account_handle"), "account_handle")
    extra = {"role_label": F.lit("unknown"), "cohort_ids": F.array().cast("array<bigint>"), "component_id": F.lit(None).cast("bigint")}
    for other, column in ((roles, "role_label"), (cohort_accounts, "cohort_ids"), (nodes, "component_id")):
        if other is not None:
            out = out.join(other.select("account_handle", F.col(column)), "account_handle", "left")
            extra[column] = F.coalesce(F.col(column), extra[column])
    return out.select(
        "account_handle", "first_retweeter_count", "unique_targets_first", F.col("b.t").alias("top_target_author"), (-F.col("b.n")).alias("top_target_count"),
        F.round("hhi", 4).alias("target_hhi"), "median_lag_to_second_retweet_sec", *[v.alias(k) for k, v in extra.items()],
    )


def repeat_crew(casc: DataFrame, accounts: DataFrame, top: int = 5) -> DataFrame:
    """``(original_author_handle, repeat_overlap)``: mean pairwise Jaccard of the account
    sets of a source's ``top`` largest cascades (earlier, then smaller id on a tie); 0 with one."""
    order = Window.partitionBy("original_author_handle").orderBy(F.desc("retweet_count"), F.coalesce("first_retweet_at", "original_created_at"), "original_tweet_id")
    best = casc.withColumn("k", F.row_number().over(order)).where(F.col("k") <= top)
    chosen = best.select("original_author_handle", "original_tweet_id", "k", F.col("unique_retweeter_count").alias("size"))
    sets = accounts.join(chosen, "original_tweet_id").select("original_author_handle", "k", "size", "account_handle")
    # by account: the numbers (at most ``top``) of the cascades it is in; never the accounts of a cascade
    seen = sets.groupBy("original_author_handle", "account_handle").agg(F.array_sort(F.collect_set(F.struct("k", "size"))).alias("ks"))
    both = (
        seen.where(F.size("ks") > 1)
        .select("original_author_handle", "ks", F.explode("ks").alias("x"))
        .select("original_author_handle", "x", F.explode("ks").alias("y"))
        .where("x.k < y.k")
        .groupBy("original_author_handle", "x", "y")
        .agg(F.count(F.lit(1)).alias("i"))
        .groupBy("original_author_handle")
        .agg(F.sum(F.col("i") / (F.col("x.size") + F.col("y.size") - F.col("i"))).alias("s"))
    )
    numbers = chosen.groupBy("original_author_handle").agg(F.count(F.lit(1)).alias("m"))
    mean = F.coalesce(F.try_divide(F.col("s"), F.col("m") * (F.col("m") - 1) / 2), F.lit(0.0))
    return numbers.join(both, "original_author_handle", "left").select("original_author_handle", mean.alias("repeat_overlap"))


def amplification_score(total: Column, accounts: Column, hhi_: Column, repeat: Column, within_15m: Column, parts: Column) -> Column:
    penalty = F.when((parts >= 1) & (accounts > 0), 5 * F.least(parts / F.greatest(accounts, F.lit(1)), F.lit(1.0))).otherwise(0.0)
    return F.when(total > 0, 8 * F.log1p(total) + 25 * hhi_ + 20 * repeat + 4 * F.log1p(within_15m) - penalty).otherwise(0.0)


def amplified_targets(posts: DataFrame, casc: DataFrame, accounts: DataFrame, sources: DataFrame, members: DataFrame, nodes: DataFrame, roles: DataFrame | None = None) -> DataFrame:
    """One row per amplified account: reach, concentration, repeat crew, speed and spread."""
    name = "amplified_author_handle"
    boosts = posts.where("is_retweet and content_author_handle <> ''").select(
        F.col("content_author_handle").alias(name), F.col("author_handle").alias("account_handle"), "content_tweet_id", "row_id"
    )
    counts = boosts.groupBy(name, "account_handle").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("seen"))
    top = counts.groupBy(name).agg(
        F.sum("n").alias("total_inbound_retweets"), F.count(F.lit(1)).alias("unique_amplifier_count"), F.max(F.struct("n", (-F.col("seen")).alias("s"), "account_handle")).alias("top")
    )
    distinct_posts = boosts.groupBy(name).agg(F.countDistinct("content_tweet_id").alias("unique_amplified_posts"))
    reach = counts.join(nodes.select("account_handle", "component_id"), "account_handle").groupBy(name).agg(F.countDistinct("component_id").alias("parts"))
    per = casc.withColumnRenamed("original_author_handle", name)
    lag = seconds("first_retweet_at", "original_created_at")
    quick = F.coalesce(lag, F.lit(0.0))
    speed = per.groupBy(name).agg(
        median_floor(F.when(lag >= 0, lag.cast("bigint"))).alias("median_first_retweet_lag_sec"),
        F.min(F.when(F.col("first_retweet_at").isNotNull() & (quick >= 0), F.struct(quick.alias("q"), F.col("first_retweeter").alias("h")))).alias("fast"),
    )
    led = per.groupBy(name, "first_retweeter").agg(F.count(F.lit(1)).alias("n")).groupBy(name).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("first_retweeter").alias("h"))).alias("lead"))
    listed = members.select(F.col("screen_name").alias(name), F.lit(True).alias("listed"))
    rolled = sources.select(F.col("original_author_handle").alias(name), "total_retweets_within_15m", "total_retweets_within_60m")
    crew = repeat_crew(casc, accounts).withColumnRenamed("original_author_handle", name)
    rows = top.join(distinct_posts, name).join(hhi(counts, name), name).join(role_mix(counts, name, roles), name)
    for other in (reach, speed, led, listed, rolled, crew):
        rows = rows.join(other, name, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    score = amplification_score(F.col("total_inbound_retweets"), F.col("unique_amplifier_count"), F.col("hhi"), zero("repeat_overlap"), zero("total_retweets_within_15m"), zero("parts"))
    return rows.select(
        name, F.coalesce("listed", F.lit(False)).alias("in_member_list"), "total_inbound_retweets", "unique_amplifier_count", "unique_amplified_posts",
        F.col("top.account_handle").alias("top_amplifier_handle"), F.col("top.n").alias("top_amplifier_count"),
        F.round(F.col("top.n") / F.col("total_inbound_retweets"), 4).alias("top_amplifier_share"), F.round("hhi", 4).alias("amplification_hhi"),
        F.round(zero("repeat_overlap"), 4).alias("repeat_crew_overlap"), "median_first_retweet_lag_sec", F.col("fast.h").alias("fastest_amplifier_handle"),
        zero("parts").alias("cross_component_reach"), zero("total_retweets_within_15m").alias("within_15m_inbound"), zero("total_retweets_within_60m").alias("within_60m_inbound"),
        F.col("lead.h").alias("top_first_retweeter_handle"), zero(-F.col("lead.n")).alias("top_first_retweeter_count"), F.col("role_mix").alias("captured_role_mix"),
        F.round(score, 4).alias("amplification_score"),
    )
