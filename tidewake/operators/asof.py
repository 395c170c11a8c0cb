"""As-of join on an order key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewake.session import Stage


def latest_not_newer(left: DataFrame, left_key: str, right: DataFrame, right_key: str, by: list[str] | None = None, fallback_newest: bool = False) -> DataFrame:
    """``left`` with the largest ``right_key`` not above its ``left_key`` (per ``by`` group).

    Both sides are laid on one line and the largest right key so far is carried
    along, so the cost is a sort, not a product of the sides. Without ``by`` the line
    is cut into key ranges; each starts from the largest right key of the ranges
    before it, so no task sees the whole line. Without a match the column is null, or
    with ``fallback_newest`` the newest of the group. Null keys match nothing.
    """
    by = by or []
    l_rows = left.withColumns({"__t": F.col(left_key), "__left": F.lit(1)})
    r_rows = right.where(F.col(right_key).isNotNull()).select(*by, F.col(right_key).alias("__t"), F.col(right_key).alias("__r"), F.lit(0).alias("__left")).distinct()
    line = l_rows.unionByName(r_rows, allowMissingColumns=True)
    if by:
        seen = Window.partitionBy(*by).orderBy("__t", "__left").rowsBetween(Window.unboundedPreceding, 0)
        match = F.max("__r").over(seen)
        newest = F.max("__r").over(Window.partitionBy(*by))
    else:
        stage = Stage(left.sparkSession)
        line = stage.cut(line.repartitionByRange("__t", "__left").withColumn("__range", F.spark_partition_id()))
        best, offsets = None, []
        for r in line.groupBy("__range").agg(F.max("__r").alias("m")).orderBy("__range").collect():
            offsets.append((r["__range"], best))
            best = r["m"] if r["m"] is not None else best
        kind = line.schema["__r"].dataType.simpleString()
        line = line.join(F.broadcast(left.sparkSession.createDataFrame(offsets, f"__range int, __before {kind}")), "__range")
        seen = Window.partitionBy("__range").orderBy("__t", "__left").rowsBetween(Window.unboundedPreceding, 0)
        match = F.coalesce(F.max("__r").over(seen), F.col("__before"))
        newest = F.lit(best).cast(kind)
    timed = F.col("__t").isNotNull()
    found = F.when(timed, match)
    if fallback_newest:
        found = F.coalesce(found, F.when(timed, newest))
    out = line.withColumn(right_key, found).where("__left = 1")
    return out.select(*left.columns, right_key)
