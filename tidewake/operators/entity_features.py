"""One feature row per entity from an event stream, by cumulative daily totals.

``cumulative_store`` keeps, per (entity, type, day), the running count and total up
to that day and the latest time; ``write_store`` puts it into files by range of
entity. ``window_features`` reads the as-of values at a window's two endpoints and
subtracts them, so any day can be asked for and any number of windows costs one pass.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Day that holds events without a time: they count in totals, in no window.
UNDATED = dt.date(1000, 1, 1)


def cumulative_store(events: DataFrame, entity: str, kind: str, time: str, value: str) -> DataFrame:
    """``(entity, kind, day, cum_count, cum_total, last_at)``, one row per day with events.

    Events are pre-aggregated by (entity, type, day) before the running sums, so an
    entity with a third of all events has at most one row per type and day left when
    the rows of an entity come together.
    A null entity or type is a group of its own; a null value adds 0; an event
    without a time is booked on ``UNDATED`` and leaves ``last_at`` alone.
    """
    daily = (
        events.select(
            F.col(entity).alias("entity"),
            F.col(kind).alias("kind"),
            F.coalesce(F.to_date(F.col(time)), F.lit(UNDATED)).alias("day"),
            F.col(time).alias("at"),
            F.coalesce(F.col(value), F.lit(0)).cast("bigint").alias("value"),
        )
        .groupBy("entity", "kind", "day")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"), F.max("at").alias("last_at"))
    )
    # one placement by entity serves the running sums and the rows made of them
    daily = daily.repartition("entity")
    run = Window.partitionBy("entity", "kind").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    cells = [F.sum("n").over(run).alias("cum_count"), F.sum("v").over(run).alias("cum_total"), F.max("last_at").over(run).alias("last_at")]
    return daily.select("entity", "kind", "day", *cells)


def write_store(store: DataFrame, path: str) -> DataFrame:
    """The store as files that each hold a range of entities in order, read back; a reader
    that asks for some entities or days opens few row groups."""
    store.repartitionByRange("entity", "kind").sortWithinPartitions("entity", "kind", "day").write.mode("overwrite").parquet(path)
    return store.sparkSession.read.schema(store.schema).parquet(path)


def _as_of(day: Column) -> Column:
    """The running values at the last day not after ``day``; null before the first."""
    return F.max(F.when(F.col("day") <= day, F.struct("day", "cum_count", "cum_total", "last_at")))


def measures(windows: dict[str, int]) -> list[str]:
    """Names of the additive figures of ``window_features``."""
    return ["count", "total", *[f"{m}_{w}" for w in windows for m in ("count", "total")]]


def window_features(store: DataFrame, as_of: dt.date | None, windows: dict[str, int]) -> DataFrame:
    """Per (entity, kind) with an event up to ``as_of``: ``count, total, last_at, recency_days``
    and ``count_<w>, total_<w>`` per window.

    A window of ``d`` days covers the days ``as_of - d + 1 .. as_of``. ``recency_days`` is
    the number of days from the latest event's to ``as_of``, null if no event has a time.
    Without an ``as_of`` (no dated event at all) every window is 0.
    """
    end = F.lit(as_of or UNDATED)
    ends = {"": end} | {w: F.lit(as_of - dt.timedelta(days=d)) if as_of else end for w, d in windows.items()}
    at = store.groupBy("entity", "kind").agg(*[_as_of(day).alias(f"at_{w}") for w, day in ends.items()]).where("at_ is not null")
    since = lambda w, c: F.col(f"at_.{c}") - F.coalesce(F.col(f"at_{w}.{c}"), F.lit(0))
    return at.select(
        "entity",
        "kind",
        F.col("at_.cum_count").alias("count"),
        F.col("at_.cum_total").alias("total"),
        F.col("at_.last_at").alias("last_at"),
        F.date_diff(end, F.to_date("at_.last_at")).cast("bigint").alias("recency_days"),
        *[since(w, f"cum_{m}").alias(f"{m}_{w}") for w in windows for m in ("count", "total")],
    )


def by_entity(features: DataFrame, windows: dict[str, int]) -> DataFrame:
    """``(entity, types)``: one row per entity; ``types`` has, in order of the kinds, a struct
    ``(kind, <figures>)`` for each kind the entity has, so hundreds of kinds need no
    column each. A null kind is left out."""
    cell = F.struct("kind", "count", "total", "last_at", "recency_days", *measures(windows)[2:])
    return features.groupBy("entity").agg(F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), cell))).alias("types"))


def widen(features: DataFrame, kinds: list[str], columns: list[str], prefix: str = "") -> DataFrame:
    """One row per entity with ``<prefix><kind>_<column>`` for every kind; absent: null.

    An entity's cells are gathered sparsely (at most one per kind) and laid out by
    place, which costs far less than a pivot with a buffer of all cells per entity
    when there are hundreds of kinds and an entity has few of them.
    """
    if not kinds:
        return features.select("entity").distinct()
    cell = F.struct(*columns)
    rows = features.where(F.col("kind").isin(kinds)) if len(kinds) < 50 else features.where("kind is not null")
    sparse = rows.groupBy("entity").agg(F.map_from_entries(F.collect_list(F.struct("kind", cell.alias("cell")))).alias("m"))
    places = F.array(*[F.lit(k) for k in kinds])
    dense = sparse.select("entity", F.transform(places, lambda k: F.try_element_at("m", k)).alias("d"))
    return dense.select("entity", *[F.col("d")[i][c].alias(f"{prefix}{k}_{c}") for i, k in enumerate(kinds) for c in columns])
