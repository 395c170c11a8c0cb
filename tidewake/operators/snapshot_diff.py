"""What changed between consecutive full snapshots of a table.

``SnapshotStore`` keeps every snapshot as files by range of the key, sorted by key, with
bounds that are fixed when the store is made; a new snapshot is the only thing that
moves. Changes are found per range by a two-pointer merge that streams the files of two
consecutive snapshots side by side, a batch of each in memory, and compares whole
batches at a time.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewake.session import Stage

#: Rows of a snapshot that a range holds, about, and keys looked at per range to place its bounds.
RANGE_ROWS = 250_000
KEYS_PER_RANGE = 200
#: Rows of a snapshot's file that are in memory at a time.
MERGE_ROWS = 32_768
#: Merges of two ranges that run as tasks of their own; beyond, tasks take several.
MOST_TASKS = 10_000


@dataclass(frozen=True)
class SnapshotStore:
    """Snapshots under ``path`` (any file system that Spark and Arrow both reach) by range and in
    order of the key. Made by ``create``, found again by ``open``."""

    spark: SparkSession
    path: str
    snapshot: str
    key: str
    compared: tuple[str, ...]
    order: str
    types: tuple[str, str]
    bounds: tuple

    @staticmethod
    def create(df: DataFrame, path: str, snapshot: str, key: str, compared: list[str], order: str, ranges: int | None = None) -> SnapshotStore:
        """A store with the bounds that suit ``df``, which it holds after that."""
        spark = df.sparkSession
        rows = df.where(F.col(snapshot).isNotNull())
        if ranges is None:
            largest = rows.groupBy(snapshot).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
            ranges = max(1, math.ceil(largest / RANGE_ROWS))
        bounds: tuple = ()
        if ranges > 1:
            # a hash of the key picks the same keys in every snapshot
            keys = rows.select(F.col(key).alias("k")).where("k is not null").distinct()
            share = max(1, keys.count() // (ranges * KEYS_PER_RANGE))
            picked = sorted(r[0] for r in keys.where(F.pmod(F.xxhash64("k"), F.lit(share)) == 0).collect())
            bounds = tuple(dict.fromkeys(picked[i * len(picked) // ranges] for i in range(1, ranges) if picked))
        types = tuple(df.schema[c].dataType.simpleString() for c in (snapshot, key))
        named = f"snapshot string, key string, compared array<string>, order string, types array<string>, bounds array<{types[1]}>"
        spark.createDataFrame([(snapshot, key, list(compared), order, list(types), list(bounds))], named).coalesce(1).write.mode("overwrite").parquet(f"{path}/about")
        store = SnapshotStore(spark, path, snapshot, key, tuple(compared), order, types, bounds)
        store.add(df)
        return store

    @staticmethod
    def open(spark: SparkSession, path: str) -> SnapshotStore:
        r = spark.read.parquet(f"{path}/about").first()
        return SnapshotStore(spark, path, r["snapshot"], r["key"], tuple(r["compared"]), r["order"], tuple(r["types"]), tuple(r["bounds"]))

    def add(self, df: DataFrame) -> None:
        """Adds whole snapshots. Of a key's rows in one the last by order counts; they are brought
        down to one where they are read, before anything moves."""
        values = [F.col(c).alias(f"v{i}") for i, c in enumerate(self.compared)]
        rows = df.where(F.col(self.snapshot).isNotNull()).select(F.col(self.snapshot).alias("s"), F.col(self.key).alias("k"), F.struct(F.col(self.order).alias("o"), *values).alias("r"))
        latest = rows.groupBy("s", "k").agg(F.max("r").alias("r"))
        placed = latest.select("s", F.xxhash64("s").alias("snap"), _range_of(F.col("k"), self.bounds).alias("range"), "k", *[f"r.v{i}" for i in range(len(self.compared))])
        placed.repartition("snap", "range").sortWithinPartitions("snap", "range", "k").write.mode("append").partitionBy("snap", "range").parquet(f"{self.path}/rows")

    def snapshots(self) -> DataFrame:
        """``(s, snap)``: the snapshots and the names of their folders."""
        return self._rows().select("s", "snap").distinct()

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(f"s {self.types[0]}, k {self.types[1]}, snap bigint, range int").parquet(f"{self.path}/rows")

    def changes(self) -> DataFrame:
        """Typed changes ``(from_snapshot, to_snapshot, <key>, change_kind, changed_fields)`` between consecutive snapshots."""
        stored = self._rows().schema
        in_turn = Window.orderBy("s")  # as many rows as snapshots
        steps = self.snapshots().select(F.lag("s").over(in_turn).alias("a"), F.lag("snap").over(in_turn).alias("old"), F.col("s").alias("b"), F.col("snap").alias("new")).where("old is not null")
        merges = steps.withColumn("range", F.explode(F.sequence(F.lit(0), F.lit(len(self.bounds)))))
        fields = [("from_snapshot", stored["s"].dataType), ("to_snapshot", stored["s"].dataType), (self.key, stored["k"].dataType), ("change_kind", T.StringType()), ("changed_fields", T.ArrayType(T.StringType()))]
        schema = T.StructType([T.StructField(n, t) for n, t in fields])
        tasks = min(MOST_TASKS, max(1, merges.count()))
        return merges.repartition(tasks).mapInArrow(_merger(self._address("rows"), self.compared, self.key), schema)

    def _address(self, part: str) -> str:
        """The full address of a part of the store, whatever the default file system is."""
        context = self.spark.sparkContext
        where = context._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        return re.sub("^file:/+", "file:///", where.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(where).toString())


def _range_of(key: Column, bounds: tuple) -> Column:
    """How many of the sorted bounds aren't above the key, by halving; a null key is in range 0."""
    if not bounds:
        return F.lit(0)
    all_ = F.array(*[F.lit(b) for b in bounds])
    whole = lambda a, b: F.struct(a.cast("int").alias("lo"), b.cast("int").alias("hi"))

    def halve(at: Column, _: Column) -> Column:
        mid = F.floor((at["lo"] + at["hi"]) / 2)
        below = F.get(all_, mid.cast("int")) <= key
        return F.when(at["lo"] >= at["hi"], at).when(below, whole(mid + 1, at["hi"])).otherwise(whole(at["lo"], mid))

    turns = F.sequence(F.lit(1), F.lit(math.ceil(math.log2(len(bounds) + 1)) + 1))
    return F.coalesce(F.aggregate(turns, whole(F.lit(0), F.lit(len(bounds))), halve)["lo"], F.lit(0))


def _merger(root: str, fields: tuple[str, ...], key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as pfs

        files, base = pfs.FileSystem.from_uri(root)

        def side(snap: int, part: int) -> Iterator[pa.Table]:
            import pyarrow.parquet as pq

            found = files.get_file_info(pfs.FileSelector(f"{base}/snap={snap}/range={part}", allow_not_found=True))
            paths = sorted(f.path for f in found if f.path.endswith(".parquet"))
            columns = ["k", *[f"v{i}" for i in range(len(fields))]]
            if len(paths) > 1:  # a snapshot that was added in pieces
                yield pa.concat_tables([pq.read_table(p, filesystem=files, columns=columns) for p in paths]).sort_by("k")
            for path in paths[: len(paths) == 1]:
                with files.open_input_file(path) as source:
                    for batch in pq.ParquetFile(source).iter_batches(MERGE_ROWS, columns=columns):
                        yield pa.Table.from_batches([batch])

        for batch in batches:
            ids = batch.schema.field("a").type
            for r in batch.to_pylist():
                for keys, kinds, differ in merge_sorted(side(r["old"], r["range"]), side(r["new"], r["range"]), fields):
                    ends = [pa.array([r[c]] * len(kinds), ids) for c in ("a", "b")]
                    yield pa.RecordBatch.from_arrays([*ends, keys, pa.array(kinds, pa.string()), pa.array(differ, pa.list_(pa.string()))], ["from_snapshot", "to_snapshot", key, "change_kind", "changed_fields"])

    return run


class _Pointer:
    """A sorted stream of tables ``(k, v0, ...)`` and what of it is in memory."""

    def __init__(self, tables: Iterator[pa.Table]) -> None:
        self.tables, self.rows, self.ended = tables, None, False

    def fill(self) -> None:
        while not self.ended and (self.rows is None or not self.rows.num_rows):
            self.rows = next(self.tables, None)
            self.ended = self.rows is None

    @property
    def left(self) -> int:
        return self.rows.num_rows if self.rows is not None else 0

    def take(self, n: int) -> pa.Table:
        out, self.rows = self.rows.slice(0, n), self.rows.slice(n)
        return out

    def up_to(self, key) -> int:
        """Rows in memory whose key isn't above ``key``; null keys are first."""
        k = self.rows["k"]
        return k.null_count if key is None else k.null_count + (pc.sum(pc.less_equal(k.drop_null(), key)).as_py() or 0)


def merge_sorted(old: Iterator[pa.Table], new: Iterator[pa.Table], fields: tuple[str, ...]) -> Iterator[tuple[pa.Array, list[str], list[list[str]]]]:
    """(keys, kinds, changed fields) of two streams sorted by unique keys, null first.

    In every step both sides advance to the smaller of the last keys in memory, up to which both are complete.
    """
    a, b = _Pointer(old), _Pointer(new)
    while True:
        a.fill()
        b.fill()
        if not a.left and not b.left:
            return
        if not a.left or not b.left:
            rest, kind = (b, "added") if b.left else (a, "removed")
            keys = rest.take(rest.left)["k"].combine_chunks()
            yield keys, [kind] * len(keys), [[]] * len(keys)
            continue
        ends = [p.rows["k"][-1].as_py() for p in (a, b)]
        to = min(ends, key=lambda k: (k is not None, k))
        x, y = (p.take(p.up_to(to)) for p in (a, b))
        at = pc.index_in(y["k"], value_set=x["k"].combine_chunks()).combine_chunks()
        there = pc.is_valid(at).to_numpy(zero_copy_only=False)
        both, place = y.filter(pa.array(there)), at.drop_null()
        gone = np.ones(x.num_rows, bool)
        gone[place.to_numpy()] = False
        other = x.take(place)
        differs = np.stack([_differ(other[f"v{i}"], both[f"v{i}"]) for i in range(len(fields))], 1) if fields else np.zeros((len(place), 0), bool)
        changed = differs.any(1)
        parts = [(x["k"].filter(pa.array(gone)), "removed", None), (y["k"].filter(pa.array(~there)), "added", None), (both["k"].filter(pa.array(changed)), "changed", differs[changed])]
        for keys, kind, which in parts:
            if len(keys):
                names = [[]] * len(keys) if which is None else [[f for f, d in zip(fields, row) if d] for row in which]
                yield keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys, [kind] * len(keys), names


def _differ(x: pa.ChunkedArray, y: pa.ChunkedArray) -> np.ndarray:
    """Whether values differ: null equals null and NaN equals NaN, neither equals anything else."""
    try:
        same = pc.equal(x, y)
    except pa.ArrowNotImplementedError:  # lists and structs
        return np.array([p != q for p, q in zip(x.to_pylist(), y.to_pylist())], bool)
    same = pc.if_else(pc.is_null(same), pc.and_(pc.is_null(x), pc.is_null(y)), same)
    if pa.types.is_floating(x.type):
        same = pc.or_(same, pc.fill_null(pc.and_(pc.is_nan(x), pc.is_nan(y)), False))
    return ~same.to_numpy().astype(bool)


def snapshot_changes(df: DataFrame, snapshot_col: str, key_col: str, compare_cols: list[str], order_col: str, ranges: int | None = None) -> DataFrame:
    """Typed changes ``(from_snapshot, to_snapshot, <key>, change_kind, changed_fields)`` of a table
    that holds all its snapshots, through a store in the shared folder.

    ``change_kind`` is ``added``, ``removed`` or ``changed``; ``changed_fields`` lists the
    compared columns that differ, in the order given, and is empty for the other kinds.
    Per snapshot and key the row with the largest ``order_col`` counts (null sorts
    first; equally late rows that differ: the larger compared values win, so the
    result is deterministic). Null equals null and differs from any value; NaN
    equals NaN. A null key is a key like any other; rows without a snapshot id
    belong to no snapshot and are left out. No snapshot or a single one: no changes.
    Columns not named are neither read nor compared, so they may have any name.
    """
    return SnapshotStore.create(df, Stage(df.sparkSession).place(), snapshot_col, key_col, compare_cols, order_col, ranges).changes()
