"""Consecutive numbers over a whole table without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.session import Stage

_POSITION_BITS = 33


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``name`` = 1, 2, ... in ``order``, which should be total.

    Rows are range-partitioned and sorted; a row's number is its place in its range
    plus the sizes of the ranges before, of which there are as many as partitions.
    """
    stage = Stage(df.sparkSession)
    place = F.monotonically_increasing_id()
    sorted_ = df.orderBy(*order).select("*", F.shiftright(place, _POSITION_BITS).alias("__range"), place.bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)).alias("__at"))
    written = stage.cut(sorted_)
    sizes = written.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).orderBy("__range").collect()
    before, offsets = 0, []
    for r in sizes:
        offsets.append((r["__range"], before))
        before += r["n"]
    starts = df.sparkSession.createDataFrame(offsets, "__range bigint, __before bigint")
    return written.join(F.broadcast(starts), "__range").select(*df.columns, (F.col("__before") + F.col("__at") + 1).alias(name))
