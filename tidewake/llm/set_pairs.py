"""All pairs of records whose sets of values overlap above a similarity threshold.

Recursive chosen-path splitting: in every tree a record enters the nodes of a few of
its tokens, chosen by a hash that all records share; large nodes split again on
further tokens; the records of a small node are compared with each other; several
trees reach the target recall; every candidate is verified exactly on its values.

Records with equal sets are one class, compared once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.session import Stage

#: Chance that a tree with two expected common children a node loses a pair (branching process).
TREE_LOSS = 0.21
#: A node that keeps more than this part of its parent's records is looked at: if its pairs share
#: values as similar ones do (this part of the threshold on average), splitting would only
#: repeat them in every branch, and most pairs are results.
SPLITS_TO = 0.75
ALIKE = 0.5
#: Sets up to this size are verified as arrays; larger ones by joining their rows.
ARRAY_LIMIT = 20_000


def trees_for(recall: float) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(TREE_LOSS)))


def _chosen(node: Column, token: Column, branches: float, left: Column) -> Column:
    """Whether ``token`` continues a path: the same answer for all records at ``node``."""
    u = F.shiftrightunsigned(F.xxhash64(node, token), 11) / F.lit(float(1 << 53))
    return u < F.lit(branches) / F.greatest(left, F.lit(1))


def equal_sets(df: DataFrame, record: str, item: str, stage: Stage) -> tuple[DataFrame, DataFrame]:
    """(membership ``(record, rep, n)``, rows ``(rec, n, item)`` of the representatives).

    Null records and null items are none. A class is found by the size and two
    64-bit digests that don't depend on order, so no set is ever collected for it.
    """
    items = stage.cut(df.where(F.col(record).isNotNull() & F.col(item).isNotNull()).select(F.col(record).alias("record"), F.col(item).alias("item")).distinct())
    digest = items.groupBy("record").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("item")).alias("x"), F.bit_xor(F.xxhash64("item", F.lit("second"))).alias("y")
    )
    digest = stage.cut(digest)
    classes = digest.groupBy("n", "x", "y").agg(F.min("record").alias("rep"))
    membership = digest.join(classes, ["n", "x", "y"]).select("record", "rep", "n")
    rows = items.join(classes.select(F.col("rep").alias("record"), "n"), "record").select(F.col("record").alias("rec"), "n", "item")
    return membership, rows


def _alike_nodes(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """``(node, alike)`` for rows ``(node, rec, n)``: whether the node's pairs share, on average, so
    much of their values as ``ALIKE`` times the threshold asks for. From the values' counts
    in the node, so no pair is made."""
    values = members.select("node", "rec").join(sets.select("rec", "tok"), "rec").groupBy("node", "tok").agg(F.count(F.lit(1)).alias("c"))
    shared = values.groupBy("node").agg(F.sum(F.col("c") * (F.col("c") - 1)).alias("shared"))
    sizes = members.groupBy("node").agg(F.count(F.lit(1)).alias("m"), F.avg("n").alias("n"))
    mean = F.col("shared") / (F.col("m") * (F.col("m") - 1))
    return sizes.join(shared, "node").select("node", (mean >= F.lit(ALIKE * threshold) * (2 * F.col("n") - mean)).alias("alike"))


def similar_sets(
    df: DataFrame,
    record: str,
    item: str,
    threshold: float = 0.5,
    min_shared: int = 1,
    recall: float = 0.9999,
    node_size: int = 24,
) -> tuple[DataFrame, DataFrame]:
    """``(pairs, membership)`` for rows of (record, item); items of a record are a set.

    ``pairs`` is ``(rec_a, rec_b, shared, jaccard)`` between class representatives,
    smaller first, with ``shared >= min_shared`` and an unrounded Jaccard of
    ``threshold`` or more; ``membership`` is ``(record, rep, n)``: records of one
    ``rep`` have equal sets of ``n`` values. Nothing reported is approximate;
    each pair is missed with a chance below ``1 - recall``.

    A record of size n shares at least ``max(min_shared, threshold * n)`` values with
    any partner, so its paths may grow that long, and no longer: records that share so
    many values are similar; where it stops it is compared with every record of the
    node whose size allows the threshold. A larger node is split however deep that goes,
    unless its records are alike on average. No node is ever gathered into one task:
    nodes are compared by an equi-join, which spills and splits.
    """
    stage = Stage(df.sparkSession)
    membership, rows = equal_sets(df, record, item, stage)
    membership = stage.cut(membership)
    sets = stage.cut(rows.where(F.col("n") >= min_shared).withColumn("tok", F.xxhash64("item")))
    branches = 2.0 / threshold
    trees = trees_for(recall)
    root = F.xxhash64(F.lit("tree"), F.col("tree"))
    level = (
        sets.select("rec", "n", "tok", F.explode(F.sequence(F.lit(1), F.lit(trees))).alias("tree"))
        .where(_chosen(root, F.col("tok"), branches, F.col("n")))
        .select(F.xxhash64(root, "tok").alias("node"), "rec", "n", F.array("tok").alias("path"), F.lit(1 << 60).alias("was"))
    )
    longest = F.greatest(F.lit(min_shared), F.ceil(F.col("n") * F.lit(threshold)))
    candidates: DataFrame | None = None
    depth = 0
    while True:
        depth += 1
        entered = stage.cut(level)
        crowds = entered.groupBy("node").agg(F.count(F.lit(1)).alias("crowd")).where("crowd > 1")
        counted = entered.join(crowds, "node")
        unparted = counted.where((F.col("crowd") > node_size) & (F.col("crowd") > SPLITS_TO * F.col("was")))
        alike = _alike_nodes(unparted, sets, threshold)
        done = (F.col("crowd") <= node_size) | F.coalesce("alike", F.lit(False)) | (F.lit(depth) >= longest)
        here = stage.cut(counted.join(alike, "node", "left").withColumn("stops", done).withColumn("was", F.col("crowd")).drop("crowd", "alike"))
        stage.drop(entered)
        x = here.where("stops").select("node", F.col("rec").alias("xr"), F.col("n").alias("xn"))
        y = here.select("node", F.col("rec").alias("yr"), F.col("n").alias("yn"), F.col("stops").alias("ys"))
        fits = F.least("xn", "yn") >= F.lit(threshold) * F.greatest("xn", "yn")
        met = x.join(y, "node").where(fits & (F.col("xr") != F.col("yr")) & (~F.col("ys") | (F.col("xr") < F.col("yr"))))
        met = met.select(
            F.least("xr", "yr").alias("a"),
            F.greatest("xr", "yr").alias("b"),
            F.when(F.col("xr") < F.col("yr"), F.col("xn")).otherwise(F.col("yn")).alias("an"),
            F.when(F.col("xr") < F.col("yr"), F.col("yn")).otherwise(F.col("xn")).alias("bn"),
        ).distinct()
        candidates = met if candidates is None else candidates.unionAll(met)
        onward = here.where("not stops")
        if not onward.limit(1).count():
            break
        level = (
            onward.join(sets.select("rec", "tok"), "rec")
            .where(~F.array_contains("path", F.col("tok")))
            .where(_chosen(F.col("node"), F.col("tok"), branches, F.col("n") - F.lit(depth)))
            .select(F.xxhash64("node", "tok").alias("node"), "rec", "n", F.array_append("path", F.col("tok")).alias("path"), "was")
        )
    found = stage.cut(candidates.distinct())
    return _verified(found, sets, threshold, min_shared), membership


def _verified(found: DataFrame, sets: DataFrame, threshold: float, min_shared: int) -> DataFrame:
    """Exact overlap of each candidate pair ``(a, b, an, bn)``."""
    small = F.greatest("an", "bn") <= ARRAY_LIMIT
    arrays = sets.where(F.col("n") <= ARRAY_LIMIT).groupBy("rec").agg(F.collect_list("item").alias("items"))
    left = arrays.select(F.col("rec").alias("a"), F.col("items").alias("ai"))
    right = arrays.select(F.col("rec").alias("b"), F.col("items").alias("bi"))
    counted = found.where(small).join(left, "a").join(right, "b").select("a", "b", "an", "bn", F.size(F.array_intersect("ai", "bi")).cast("bigint").alias("shared"))
    # large sets: row by row, the partner's rows found by (record, item)
    mine = sets.where(F.col("n") > ARRAY_LIMIT * threshold).select(F.col("rec").alias("a"), "item")
    theirs = sets.where(F.col("n") > ARRAY_LIMIT * threshold).select(F.col("rec").alias("b"), "item")
    long = found.where(~small).join(mine, "a").join(theirs, ["b", "item"]).groupBy("a", "b", "an", "bn").agg(F.count(F.lit(1)).alias("shared"))
    jaccard = F.col("shared") / (F.col("an") + F.col("bn") - F.col("shared"))
    return (
        counted.unionByName(long)
        .where(F.col("shared") >= min_shared)
        .select(F.col("a").alias("rec_a"), F.col("b").alias("rec_b"), "shared", jaccard.alias("jaccard"))
        .where(F.col("jaccard") >= threshold)
    )


def expanded(pairs: DataFrame, membership: DataFrame, min_shared: int = 1) -> DataFrame:
    """``(record_a, record_b)``: all pairs of records, also those with equal sets.

    Only for results that must list every pair; its size is that of the answer.
    """
    a = membership.select(F.col("record").alias("ra"), F.col("rep").alias("rec_a"))
    b = membership.select(F.col("record").alias("rb"), F.col("rep").alias("rec_b"))
    across = pairs.join(a, "rec_a").join(b, "rec_b").select(F.least("ra", "rb").alias("record_a"), F.greatest("ra", "rb").alias("record_b"))
    same = membership.where(F.col("n") >= min_shared)
    inside = same.select("rep", F.col("record").alias("record_a")).join(same.select("rep", F.col("record").alias("record_b")), "rep").where("record_a < record_b")
    return across.unionAll(inside.select("record_a", "record_b"))


def linked_classes(pairs: DataFrame, membership: DataFrame, min_shared: int = 1) -> DataFrame:
    """``(record, rep, n, links)``: every record with its class, the size of its set and the
    number of records it is similar to, those with an equal set included."""
    sizes = membership.groupBy("rep").agg(F.count(F.lit(1)).alias("members"))
    ends = pairs.select(F.col("rec_a").alias("rep"), F.col("rec_b").alias("other")).unionAll(pairs.select("rec_b", "rec_a"))
    far = ends.join(sizes.withColumnsRenamed({"rep": "other", "members": "there"}), "other").groupBy("rep").agg(F.sum("there").alias("far"))
    near = F.when(F.col("n") >= min_shared, F.col("members") - 1).otherwise(0)
    rows = membership.join(sizes, "rep").join(far, "rep", "left")
    return rows.select("record", "rep", "n", (near + F.coalesce("far", F.lit(0))).alias("links"))
