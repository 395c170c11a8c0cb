"""Pairwise matches consolidated into groups by deterministic Borůvka hooking.

Every component selects its smallest outgoing edge, the trees so formed collapse by
pointer doubling, edges are relabelled and deduplicated, until none is left. Edges
are ordered by (smaller label, larger label); a component's label is its smallest
record, so the root of every tree is the smallest record of the merged component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.operators.ranking import numbered
from tidewake.session import Stage


def _edges(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct (lo, hi) with lo < hi."""
    return pairs.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).distinct()


def _pointers(edges: DataFrame) -> DataFrame:
    """(c, p): each component hooks to the other end of its smallest edge.

    A tree's smallest edge is selected from both its ends; its smaller end is the
    smallest label of the tree and becomes the root, so that no cycle remains.
    """
    both = edges.select(F.col("lo").alias("c"), "lo", "hi").unionAll(edges.select(F.col("hi").alias("c"), "lo", "hi"))
    picked = both.groupBy("c").agg(F.min(F.struct("lo", "hi")).alias("e"))
    other = picked.select("c", F.when(F.col("c") == F.col("e.lo"), F.col("e.hi")).otherwise(F.col("e.lo")).alias("p"))
    back = other.select(F.col("c").alias("p"), F.col("p").alias("pp"))
    is_root = (F.col("pp") == F.col("c")) & (F.col("c") < F.col("p"))
    return other.join(back, "p").select("c", F.when(is_root, F.col("c")).otherwise(F.col("p")).alias("p"))


def _collapse(stage: Stage, tree: DataFrame) -> DataFrame:
    """Pointer doubling until every component points at its root."""
    while True:
        up = tree.select(F.col("c").alias("p"), F.col("p").alias("pp"))
        doubled, moved = stage.cut_counting(tree.join(up, "p").select("c", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")), "moved")
        stage.drop(tree)
        tree = doubled
        if not moved:
            return tree


def connected_groups(pairs: DataFrame, a: str, b: str, records: DataFrame | None = None, record: str | None = None) -> DataFrame:
    """``(record, group)``: one row per record on either side of a pair or in ``records``;
    ``group`` is the smallest record that it is linked with directly or indirectly.

    A pair with a null side or of a record with itself links nothing, but its
    records are listed; null records are none. Repeated pairs count once. Records
    are compared exactly; empty tables give an empty result.

    Each round at least halves the components that still have edges. Only the edges
    and the pointers of one round are rewritten; the pointers of all rounds are
    joined at the end from the last round back to the first, so vertices that a
    round doesn't concern aren't moved by it. Records are numbered once in their order,
    so the rounds move and compare numbers.
    """
    stage = Stage(pairs.sparkSession)
    names = pairs.select(F.col(a).alias("record")).unionAll(pairs.select(F.col(b).alias("record")))
    if records is not None:
        names = names.unionAll(records.select(F.col(record or "record").alias("record")))
    ids = stage.cut(numbered(names.where("record is not null").distinct(), [F.col("record")], "id"))
    end = lambda name, number: ids.select(F.col("record").alias(name), F.col("id").alias(number))
    linked = _edges(pairs, a, b).join(end("lo", "x"), "lo").join(end("hi", "y"), "hi")
    edges = stage.cut(linked.select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")))
    rounds: list[DataFrame] = []
    while edges.limit(1).count():
        tree = _collapse(stage, stage.cut(_pointers(edges))).select("c", "p")
        # the relabelled ends: each joined on its own, with the pointer table as the other side
        lo = edges.join(tree.select(F.col("c").alias("lo"), F.col("p").alias("a")), "lo")
        both = lo.join(tree.select(F.col("c").alias("hi"), F.col("p").alias("b")), "hi")
        following = stage.cut(_edges(both, "a", "b"))
        stage.drop(edges)
        edges = following
        rounds.append(tree)
    # from the last round back: (component at the start of the round, final root)
    final: DataFrame | None = None
    for tree in reversed(rounds):
        if final is None:
            final = tree.select("c", F.col("p").alias("root"))
        else:
            later = final.select(F.col("c").alias("p"), F.col("root").alias("r"))
            final = stage.cut(tree.join(later, "p", "left").select("c", F.coalesce("r", "p").alias("root")))
    if final is None:
        return ids.select("record", F.col("record").alias("group"))
    rooted = ids.join(final.select(F.col("c").alias("id"), "root"), "id", "left").select("record", F.coalesce("root", "id").alias("root"))
    return rooted.join(end("group", "root"), "root").select("record", "group")
