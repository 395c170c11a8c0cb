"""Records in clusters around density peaks.

Local density and the distance to the nearest denser record come from blocked
neighbour joins: several layouts of random hyperplanes cut the records into blocks
of bounded size, the distances inside a block are one matrix product, and the best
answer over the layouts counts. The few records that are densest wherever they lie
are compared with all rows, as a query set in blocks. Records far from anything
denser are the peaks; all others follow their denser neighbours' pointers to a peak.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewake.session import Stage

LAYOUTS = 8
BLOCK = 2048
#: Hyperplanes of a layout; what is still together after all of them differs by next to nothing.
PLANES = 48
#: Queries compared with all rows in one pass (a block of the query set), and of these at a time.
QUERIES = 65_536
QUERIES_AT_ONCE = 1024
#: Neighbour whose median distance over all records is the density's radius.
NEIGHBOUR = 16
#: Density that a peak has at least: in neighbours within the radius, and as a part of the
#: densest record's. What is sparser is a lone outlier or a few alike ones.
LEAST_DENSITY = 4.0
LEAST_PART = 0.05
#: Distances to the nearest denser record are told apart in steps of this ratio when the gap is looked for.
GAP_STEP = 1.01


def scaled_vectors(df: DataFrame, record: str, features: list[str], logs: list[str], clip: float = 3.0, weights: dict[str, float] | None = None) -> DataFrame:
    """``(record, vec)``: features on one scale, from statistics over all records.

    Counts named in ``logs`` enter as log(1 + x), skewed as they are; every feature is
    centred, divided by its deviation and clipped, so that an outlier in a single
    feature moves its record a bounded way. An unknown value stands at the mean. Of
    several rows of a record the largest counts (identical ones are one). ``weights`` are
    factors of the scaled features, 1 for those not named.
    """
    value = {f: (F.log1p(F.greatest(F.col(f).cast("double"), F.lit(0.0))) if f in logs else F.col(f).cast("double")) for f in features}
    cells = [F.when(~F.isnan(v), v).alias(f"f{i}") for i, v in enumerate(value.values())]
    rows = df.where(F.col(record).isNotNull()).select(F.col(record).alias("record"), F.struct(*cells).alias("r"))
    rows = rows.groupBy("record").agg(F.max("r").alias("r")).select("record", "r.*")
    stats = rows.agg(*[g(f"f{i}").alias(f"{n}{i}") for i in range(len(features)) for n, g in (("m", F.avg), ("s", F.stddev_pop))]).first()
    scaled = []
    for i, feature in enumerate(features):
        mean, dev = stats[f"m{i}"], stats[f"s{i}"]
        z = (F.col(f"f{i}") - F.lit(mean or 0.0)) / F.lit(dev) if dev else F.lit(0.0)
        bounded = F.coalesce(F.greatest(F.lit(-clip), F.least(F.lit(clip), z)), F.lit(0.0))
        scaled.append((bounded * F.lit(float((weights or {}).get(feature, 1.0)))).cast("float"))
    return rows.select("record", F.array(*scaled).alias("vec"))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    return values.reshape(len(flat), -1) if len(flat) else values.reshape(0, 0)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)


def blocks(stage: Stage, points: DataFrame, dims: int, layouts: int, size: int, seed: int) -> DataFrame:
    """``(block, layout, share, <points' columns>)``: every point once per layout.

    A layout's hyperplanes are random directions through the centre of the (scaled)
    data. A block is a prefix of sides, as long as it takes to hold ``size`` points at
    most. What all planes leave together is dealt into chunks by a hash; ``share`` is
    the chunk's part of it, to scale counts by.
    """
    rng = np.random.default_rng(seed)
    planes = rng.standard_normal((layouts * PLANES, dims)).astype(np.float32)

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            above = (_matrix(batch.column(1)) @ planes.T > 0).astype(np.uint8) + ord("0")
            codes = np.ascontiguousarray(above.reshape(n * layouts, PLANES)).view(f"S{PLANES}").ravel()
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(n), layouts)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(layouts, dtype=np.int32), n)), pa.array(codes).cast(pa.string())], ["id", "layout", "code"])

    kind = points.schema["id"].dataType.simpleString()
    open_ = stage.cut(points.select("id", "vec").mapInArrow(sides, f"id {kind}, layout int, code string"))
    n = open_.count() / layouts
    done: DataFrame | None = None
    bits = max(0, math.ceil(math.log2(max(1, n / size))))
    while True:
        prefixed = stage.cut(open_.withColumn("block", F.concat_ws(":", "layout", F.substring("code", 1, bits))))
        crowd = prefixed.groupBy("block").agg(F.count(F.lit(1)).alias("crowd"))
        counted = prefixed.join(crowd, "block")
        fits = counted.where(F.col("crowd") <= size) if bits < PLANES else counted
        chunks = F.ceil(F.col("crowd") / F.lit(size))
        part = fits.select(
            "id", "layout", F.concat_ws("#", "block", F.when(chunks > 1, F.pmod(F.xxhash64("id"), chunks)).cast("string")).alias("block"), (F.lit(1.0) / chunks).alias("share")
        )
        done = part if done is None else done.unionAll(part)
        if bits >= PLANES:
            break
        open_ = counted.where(F.col("crowd") > size).select("id", "layout", "code")
        if not open_.limit(1).count():
            break
        bits = min(PLANES, bits + 4)  # few rounds; a round costs jobs, a smaller block little
    return done.join(points, "id")


def _by_block(df: DataFrame, columns: list[str], work, schema: str) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        return work(table)

    return df.select("block", *columns).groupBy("block").applyInArrow(run, schema)


def _neighbour_distance(k: int):
    def work(t: pa.Table) -> pa.Table:
        x = _matrix(t["vec"])
        d = _squared(x, x)
        w = t["weight"].to_numpy()
        if (w == 1).all():
            kth = np.partition(d, min(k, len(x) - 1), axis=1)[:, min(k, len(x) - 1)]
        else:  # equal records count as so many neighbours
            order = d.argsort(axis=1)
            reach = (w[order].cumsum(axis=1) > k).argmax(axis=1)
            reach[w.sum() <= k] = len(x) - 1
            kth = d[np.arange(len(x)), order[np.arange(len(x)), reach]]
        return pa.table({"kth": pa.array(np.sqrt(kth).astype(np.float64))})

    return work


def _density(radius: float):
    def work(t: pa.Table) -> pa.Table:
        x, w = _matrix(t["vec"]), t["weight"].to_numpy().astype(np.float64)
        rho = np.exp(-_squared(x, x) / np.float32(radius * radius)) @ w / t["share"].to_numpy()
        return pa.table({"id": t["id"], "rho": pa.array(rho.astype(np.float64))})

    return work


def _denser(t: pa.Table) -> pa.Table:
    """Nearest denser record of the block for each that has one; equally dense: the smaller id is denser."""
    x = _matrix(t["vec"])
    ids = t["id"].to_pylist()
    rho = t["rho"].to_numpy()
    order = sorted(range(len(ids)), key=lambda i: (-rho[i], ids[i]))
    x = x[order]
    d = _squared(x, x)
    d[np.triu_indices(len(x))] = np.inf
    best = d.argmin(axis=1)
    rows = range(1, len(x))
    return pa.table(
        {
            "id": pa.array([ids[order[i]] for i in rows], t.schema.field("id").type),
            "delta": pa.array([float(math.sqrt(d[i, best[i]])) for i in rows], pa.float64()),
            "up": pa.array([ids[order[best[i]]] for i in rows], t.schema.field("id").type),
        }
    )


def _against_all(points: DataFrame, queries: list, kind: str) -> DataFrame:
    """Nearest denser record among all rows for a block of the query set ``(id, rho, vec)``."""
    q_ids = [q["id"] for q in queries]
    q_rho = np.array([q["rho"] for q in queries])
    q_vec = np.array([q["vec"] for q in queries], np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, up = np.full(len(q_ids), np.inf, np.float32), np.empty(len(q_ids), object)
        kind_of_id = None
        for batch in batches:
            kind_of_id = batch.schema.field(0).type
            for at in range(0, batch.num_rows, 2 * QUERIES_AT_ONCE):
                part = batch.slice(at, 2 * QUERIES_AT_ONCE)
                ids, rho, x = np.array(part.column(0).to_pylist(), object), part.column(1).to_numpy(), _matrix(part.column(2))
                for first in range(0, len(q_ids), QUERIES_AT_ONCE):
                    to = slice(first, first + QUERIES_AT_ONCE)
                    d = _squared(q_vec[to], x)
                    d[rho[None, :] < q_rho[to, None]] = np.inf
                    for i, j in zip(*np.nonzero(rho[None, :] == q_rho[to, None])):
                        if ids[j] >= q_ids[first + i]:
                            d[i, j] = np.inf
                    near = d.argmin(axis=1)
                    least = d[np.arange(len(d)), near]
                    better = least < best[to]
                    best[to][better] = least[better]
                    up[to][better] = ids[near[better]]
        if kind_of_id is not None:
            ok = np.flatnonzero(np.isfinite(best))
            yield pa.RecordBatch.from_arrays(
                [pa.array([q_ids[i] for i in ok], kind_of_id), pa.array(np.sqrt(best[ok]).astype(np.float64)), pa.array(list(up[ok]), kind_of_id)], ["id", "delta", "up"]
            )

    found = points.select("id", "rho", "vec").mapInArrow(run, f"id {kind}, delta double, up {kind}")
    return _nearest(found)


def _nearest(found: DataFrame) -> DataFrame:
    return found.groupBy("id").agg(F.min(F.struct("delta", "up")).alias("n")).select("id", "n.delta", "n.up")


def _gap(dense: DataFrame, radius: float) -> float:
    """The distance that parts peaks from other records ``(delta)``: the middle of the widest
    ratio gap above ``radius``, found in a histogram of the distances' logarithms, whose
    size depends on their range alone."""
    step = F.floor(F.log("delta") / F.lit(math.log(GAP_STEP))).cast("bigint").alias("step")
    seen = [r["step"] for r in dense.where(F.col("delta") > radius).select(step).distinct().orderBy("step").collect()]
    steps = [math.floor(math.log(radius) / math.log(GAP_STEP)), *seen]
    if not seen:
        return radius
    # of equally wide gaps the upper one
    low, high = max(zip(steps, steps[1:]), key=lambda g: (g[1] - g[0], g[0]))
    return GAP_STEP ** ((low + 1 + high) / 2)


def _follow(stage: Stage, links: DataFrame) -> DataFrame:
    """``(id, p)``: every record's pointer chain up to a record whose ``up`` is null, by doubling."""
    tree = stage.cut(links.select("id", F.coalesce("up", "id").alias("p")))
    while True:
        up = tree.select(F.col("id").alias("p"), F.col("p").alias("pp"))
        following, moved = stage.cut_counting(tree.join(up, "p").select("id", F.col("pp").alias("p"), (F.col("p") != F.col("pp")).alias("moved")), "moved")
        stage.drop(tree)
        tree = following
        if not moved:
            return tree.select("id", "p")


def density_clusters(
    vectors: DataFrame, layouts: int = LAYOUTS, block: int = BLOCK, seed: int = 11, neighbour: int = NEIGHBOUR, least_density: float = LEAST_DENSITY, least_part: float = LEAST_PART
) -> DataFrame:
    """``(record, cluster, rho, delta)`` for ``(record, vec)``; one row per record.

    ``cluster`` is the peak's record, ``rho`` the local density and ``delta`` the distance
    to the nearest denser record (null for the densest of all). Records with equal
    vectors are one weighted point, so a group of copies costs one. Ties in density
    go to the smaller record. Peaks are all records whose distance lies above the widest
    gap, of those whose density is ``least_density`` neighbours and ``least_part`` of the
    highest density at least; there may be any number of them, of any share of the
    records. No record: no rows; one record: its own cluster.
    """
    stage = Stage(vectors.sparkSession)
    vectors = stage.cut(vectors)
    first = vectors.select("vec").first()
    if first is None:
        return vectors.select("record", F.col("record").alias("cluster"), F.lit(0.0).alias("rho"), F.lit(0.0).alias("delta"))
    kind = vectors.schema["record"].dataType.simpleString()
    points = stage.cut(vectors.groupBy("vec").agg(F.min("record").alias("id"), F.count(F.lit(1)).alias("weight")).select("id", "vec", "weight"))
    placed = stage.cut(blocks(stage, points, len(first[0]), layouts, block, seed))
    kth = _by_block(placed.where("layout = 0"), ["vec", "weight"], _neighbour_distance(neighbour), "kth double")
    radius = kth.select(F.percentile_approx("kth", 0.5, 10_000)).first()[0] or 1.0  # over all points, in bounded memory
    rho = _by_block(placed, ["id", "vec", "weight", "share"], _density(radius), f"id {kind}, rho double").groupBy("id").agg(F.max("rho").alias("rho"))
    rho = stage.cut(rho)
    dense = stage.cut(points.join(rho, "id").select("id", "rho", "vec"))
    found = _by_block(placed.select("block", "id", "vec").join(rho, "id"), ["id", "rho", "vec"], _denser, f"id {kind}, delta double, up {kind}")
    links = stage.cut(_nearest(found))
    tops = stage.cut(dense.join(links, "id", "left_anti"))
    passes = max(1, math.ceil(tops.count() / QUERIES))
    for part in range(passes):
        queries = tops.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == part).collect()
        if queries:
            links = links.unionAll(stage.cut(_against_all(dense, queries, kind)))
    links = stage.cut(dense.select("id", "rho").join(links, "id", "left"))
    enough = F.col("rho") >= max(least_density, least_part * (rho.agg(F.max("rho")).first()[0] or 0.0))
    gap = _gap(links.where(enough & F.col("delta").isNotNull()).select("delta"), radius)
    is_peak = F.col("up").isNull() | (enough & (F.col("delta") > gap))
    tree = _follow(stage, links.select("id", F.when(~is_peak, F.col("up")).alias("up")))
    point = links.join(tree.select("id", F.col("p").alias("cluster")), "id").select("id", "cluster", "rho", "delta")
    same = vectors.join(points.select("vec", "id"), "vec").select("record", "id")
    return same.join(point, "id").select("record", "cluster", "rho", "delta")


def describe(clusters: DataFrame, typical: int = 5) -> DataFrame:
    """``(cluster_id, cluster_size, typical_records)`` per cluster: ids by falling size,
    the most typical members are those of the highest density."""
    by = Window.partitionBy("cluster").orderBy(F.desc("rho"), "record")
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("cluster_size"))
    best = clusters.withColumn("k", F.row_number().over(by)).where(F.col("k") <= typical)
    names = best.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "record"))), lambda s: s["record"]), "|").alias("typical_records"))
    return sizes.join(names, "cluster").select(
        F.row_number().over(Window.orderBy(F.desc("cluster_size"), "cluster")).cast("bigint").alias("cluster_id"), "cluster_size", "typical_records"
    )
