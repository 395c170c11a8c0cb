"""Unsupervised baseline over the feature matrix: clusters, anomalies, a plane to look at."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewake.operators.ranking import numbered
from tidewake.session import Stage

# The model's features in order; the second tuple isn't put on a log scale.
FEATURES = (
    "tweet_count", "retweet_count", "original_count", "quote_count", "retweet_ratio", "first_retweeter_count", "unique_retweeted_tweet_count",
    "unique_retweeted_author_count", "retweets_to_member_count", "retweets_to_member_ratio", "top_amplified_count", "top_amplified_share", "hashtag_count",
    "mention_count", "followers_count", "friends_count", "statuses_count", "account_age_days", "default_profile", "default_profile_image", "is_blue_verified",
    "network_component_size", "network_neighbor_count", "network_weighted_degree", "network_within_15m_weight", "network_within_60m_weight", "network_max_shared_edge",
    "cohort_count", "cohort_max_size", "cohort_max_cascade_count", "role_retail_user", "role_amplifier_suspect", "role_media_business", "role_journalist_public_figure",
    "role_source_hub", "first_retweeter_ratio", "propagation_lead_count",
)
PLAIN = (
    "retweet_ratio", "retweets_to_member_ratio", "top_amplified_share", "default_profile", "default_profile_image", "is_blue_verified", "cohort_count",
    "role_retail_user", "role_amplifier_suspect", "role_media_business", "role_journalist_public_figure", "role_source_hub", "first_retweeter_ratio",
)
#: Rows in a block when distances of all rows to all rows are taken.
BLOCK_ROWS = 1024
#: Tasks over which the groups of two blocks are spread, at most.
MOST_TASKS = 2000
#: k-means runs of which the best counts, and the passes a run may take.
STARTS = 20
K_MEANS_ROUNDS = 300
#: An isolation tree's sample.
TREES, TREE_ROWS = 100, 256


def model_features(matrix: DataFrame) -> DataFrame:
    """``(account_handle, <features>)`` as doubles: unknown is 0, counts on a log scale."""
    value = lambda f: F.coalesce(F.col(f).cast("double"), F.lit(0.0))
    return matrix.select("account_handle", *[(value(f) if f in PLAIN else F.log1p(F.greatest(value(f), F.lit(0.0)))).alias(f) for f in FEATURES])


def standardised(features: DataFrame) -> DataFrame:
    """Each feature centred and divided by its population deviation (constant: 0)."""
    stats = features.agg(*[g(f).alias(f"{n}_{f}") for f in FEATURES for n, g in (("m", F.avg), ("s", F.stddev_pop))]).first()
    scaled = []
    for f in FEATURES:
        dev = stats[f"s_{f}"]
        scaled.append((((F.col(f) - F.lit(stats[f"m_{f}"])) / F.lit(dev)) if dev else F.lit(0.0)).alias(f))
    return features.select("account_handle", *scaled)


def _vectors(scaled: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(scaled).select("account_handle", "features")


def silhouettes(vectors: DataFrame, n: int, models: dict[int, np.ndarray]) -> dict[int, float]:
    """Mean Euclidean silhouette of all ``n`` rows for each model's centres; a cluster of
    one counts 0, a single cluster in all is -1.

    Rows are cut into blocks; a group per two blocks takes their distances once, for all
    models and both sides; a row's sums of distances to each cluster are added up
    afterwards. The work grows with the square of ``n``, as the measure asks for it.
    """
    width = len(FEATURES)
    ks = sorted(models)
    sums = "row bigint, " + ", ".join(f"s{k} array<double>" for k in ks)
    nearest = lambda x, k: ((x[:, None, :] - models[k][None]) ** 2).sum(2).argmin(1)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _rows(batch.column(1), width)
            found = np.stack([nearest(x, k) for k in ks], 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x.tolist()), pa.array(found.tolist(), pa.list_(pa.int64()))], ["row", "x", "labels"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                x, y = np.array(r["x"]).reshape(-1, width), np.array(r["y"]).reshape(-1, width)
                d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0))
                sides = [(r["rows"], d, r["ylabels"])]
                if r["i"] == r["j"]:
                    np.fill_diagonal(d, 0)
                else:
                    sides.append((r["yrows"], d.T, r["labels"]))
                for rows, far, labels in sides:
                    to = np.array(labels).reshape(-1, len(ks))
                    out = [pa.array((far @ (to[:, i, None] == np.arange(len(models[k]))[None])).tolist(), pa.list_(pa.float64())) for i, k in enumerate(ks)]
                    yield pa.RecordBatch.from_arrays([pa.array(rows), *out], ["row", *[f"s{k}" for k in ks]])

    stage = Stage(vectors.sparkSession)
    numbers = numbered(vectors.select("account_handle", vector_to_array("features").alias("x")), [F.col("account_handle")], "row")
    rows = stage.cut(numbers.select("row", "x").mapInArrow(label, "row bigint, x array<double>, labels array<bigint>"))
    sizes = {k: [0] * len(models[k]) for k in ks}
    for r in rows.select(F.posexplode("labels").alias("i", "c")).groupBy("i", "c").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[ks[r["i"]]][r["c"]] = r["n"]
    gather = F.array_sort(F.collect_list(F.struct("row", "x", "labels")))  # BLOCK_ROWS rows
    flat = lambda field: F.flatten(F.transform("g", lambda g: g[field]))
    groups = rows.groupBy(F.floor(F.col("row") / BLOCK_ROWS).cast("int").alias("b")).agg(gather.alias("g"))
    blocks = stage.cut(groups.select("b", F.transform("g", lambda g: g["row"]).alias("rows"), flat("x").alias("x"), flat("labels").alias("labels")))
    last = n // BLOCK_ROWS
    left = blocks.select(F.col("b").alias("i"), F.explode(F.sequence("b", F.lit(last))).alias("j"), "rows", "x", "labels")
    right = blocks.select(F.explode(F.sequence(F.lit(0), "b")).alias("i"), F.col("b").alias("j"), F.col("rows").alias("yrows"), F.col("x").alias("y"), F.col("labels").alias("ylabels"))
    groups_of_two = (last + 1) * (last + 2) // 2
    spread = min(groups_of_two, MOST_TASKS)
    met = left.repartition(spread, "i", "j").join(right.repartition(spread, "i", "j"), ["i", "j"])
    parts = met.mapInArrow(meet, sums)
    total = parts.groupBy("row").agg(*[F.array(*[F.sum(F.col(f"s{k}")[c]) for c in range(len(models[k]))]).alias(f"s{k}") for k in ks]).join(rows.select("row", "labels"), "row")
    each = []
    for i, k in enumerate(ks):
        size, own = F.array(*[F.lit(float(z)) for z in sizes[k]]), F.col("labels")[i]
        a = F.element_at(f"s{k}", (own + 1).cast("int")) / F.greatest(F.element_at(size, (own + 1).cast("int")) - 1, F.lit(1.0))
        means = [F.when(own != c, F.col(f"s{k}")[c] / z) for c, z in enumerate(sizes[k]) if z]
        b = F.array_min(F.array(*means))
        s = F.when(F.element_at(size, (own + 1).cast("int")) > 1, (b - a) / F.greatest(a, b, F.lit(1e-12))).otherwise(0.0)
        each.append(F.avg(s).alias(f"m{k}") if len(means) > 1 else F.lit(-1.0).alias(f"m{k}"))
    found = total.agg(*each).first()
    stage.drop(rows, blocks)
    return {k: found[f"m{k}"] for k in ks}


def _different(vectors: DataFrame, most: int) -> int:
    """Number of different rows, ``most`` at most: k-means can't have more clusters."""
    return vectors.select(vector_to_array("features").alias("x")).distinct().limit(most).count()


def choose_clusters(vectors: DataFrame, n: int, requested: int | None, seed: int) -> tuple[int, str, np.ndarray]:
    """(k, how, centres): the requested number within 1..n, else the best silhouette of 2..8
    (the smaller on a tie) over all rows."""
    if n < 4:
        return 1, "fallback_small_sample", fit_clusters(vectors, 1, seed)
    if requested:
        k = max(1, min(requested, n, _different(vectors, requested)))
        return k, "requested", fit_clusters(vectors, k, seed)
    most = min(8, n - 1, _different(vectors, 8))
    models = k_means(vectors, list(range(1, most + 1)), seed)
    scores = silhouettes(vectors, n, {k: c for k, c in models.items() if k > 1}) if most > 1 else {}
    best = (-1.0, 1)
    for k, score in scores.items():
        if score > best[0] + 1e-12:
            best = (score, k)
    return best[1], "silhouette" if best[1] > 1 else "fallback_single_cluster", models[best[1]]


def fit_clusters(vectors: DataFrame, k: int, seed: int, starts: int = STARTS) -> np.ndarray:
    """Centres of the best of several k-means runs."""
    return k_means(vectors, [k], seed, starts)[k]


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _uniform(ids: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit ids and a salt."""
    with np.errstate(over="ignore"):
        z = ids.view(np.uint64) + np.uint64(salt & (2**64 - 1)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return ((z >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)


def k_means(vectors: DataFrame, ks: list[int], seed: int, starts: int = STARTS, rounds: int = K_MEANS_ROUNDS, tolerance: float = 1e-4) -> dict[int, np.ndarray]:
    """Centres by number of clusters: of ``starts`` k-means++ runs the one of least cost.

    All runs of all numbers share every pass over the rows. A pass of seeding draws one
    row for every start, with a chance that grows with the squared distance to the
    centres it has (the least of exponential races, so tasks reduce to one row
    each); the first k centres of a start seed its run with k clusters. A pass of
    fitting adds up, per run and centre, the rows nearest to it. A run stands still when its
    centres move by less than ``tolerance`` times the mean variance.
    """
    width = len(FEATURES)
    stage = Stage(vectors.sparkSession)
    rows = stage.cut(vectors.select(F.xxhash64("account_handle").alias("id"), vector_to_array("features").alias("x")))
    chosen = np.zeros((starts, 0, width))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple] = {}
        for batch in batches:
            ids, x = batch.column(0).to_numpy(), _rows(batch.column(1), width)
            for s in range(starts):
                race = -np.log(_uniform(ids, seed * 1_000_003 + s * 1009 + chosen.shape[1]))
                if chosen.shape[1]:
                    race = race / np.maximum(_squared(x, chosen[s]).min(1), 1e-12)
                at = int(np.lexsort((ids, race))[0]) if len(race) else -1
                if at >= 0 and (s not in best or (race[at], ids[at]) < best[s][:2]):
                    best[s] = (float(race[at]), int(ids[at]), x[at].tolist())
        found = sorted(best.items())
        yield pa.RecordBatch.from_arrays(
            [pa.array([s for s, _ in found], pa.int32()), pa.array([b[0] for _, b in found], pa.float64()), pa.array([b[1] for _, b in found], pa.int64()),
             pa.array([b[2] for _, b in found], pa.list_(pa.float64()))],
            ["start", "race", "id", "x"],
        )

    for _ in range(max(ks)):
        drawn = rows.mapInArrow(draw, "start int, race double, id bigint, x array<double>").groupBy("start").agg(F.min(F.struct("race", "id", "x")).alias("b")).collect()
        step = np.array([r["b"]["x"] for r in sorted(drawn, key=lambda r: r["start"])])
        chosen = np.concatenate([chosen, step[:, None, :]], 1)
    centres = {(k, s): chosen[s, :k].copy() for k in ks for s in range(starts if k > 1 else 1)}
    spread = float(np.mean(list(rows.agg(*[F.var_pop(F.col("x")[i]).alias(f"v{i}") for i in range(width)]).first())))
    cost: dict[tuple[int, int], float] = {}
    live = sorted(centres)
    for _ in range(rounds):
        found = _partial_sums(rows, [centres[m] for m in live], width)
        moving = []
        for i, m in enumerate(live):
            now = centres[m].copy()
            cost[m] = 0.0
            for c in range(len(now)):
                count, lost, total = found.get((i, c), (0, 0.0, None))
                cost[m] += lost
                if count:
                    now[c] = total / count
            if ((now - centres[m]) ** 2).sum() > tolerance * spread:
                moving.append(m)
            centres[m] = now
        live = moving
        if not live:
            break
    stage.drop(rows)
    return {k: centres[min((m for m in centres if m[0] == k), key=lambda m: (cost[m], m))] for k in ks}


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0)


def _partial_sums(rows: DataFrame, models: list[np.ndarray], width: int) -> dict[tuple[int, int], tuple[int, float, np.ndarray]]:
    """(model, centre) -> (rows, squared distance, sum of the rows) of the rows nearest to it."""
    flat = np.concatenate(models)
    ends = np.cumsum([len(m) for m in models])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, lost, total = np.zeros(len(flat)), np.zeros(len(flat)), np.zeros((len(flat), width))
        for batch in batches:
            x = _rows(batch.column(1), width)
            d = _squared(x, flat)
            near = np.zeros(d.shape, bool)
            at = np.arange(len(x))
            for i, end in enumerate(ends):
                near[at, end - len(models[i]) + d[:, end - len(models[i]) : end].argmin(1)] = True
            count += near.sum(0)
            lost += np.where(near, d, 0).sum(0)
            total += near.T.astype(float) @ x
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array(count[used].astype(np.int64)), pa.array(lost[used]), *[pa.array(total[used, f].copy()) for f in range(width)]],
            ["c", "n", "lost", *[f"f{f}" for f in range(width)]],
        )

    fields = ["n bigint", "lost double", *[f"f{f} double" for f in range(width)]]
    summed = rows.mapInArrow(add, "c int, " + ", ".join(fields)).groupBy("c").agg(*[F.sum(f.split()[0]).alias(f.split()[0]) for f in fields])
    out = {}
    for r in summed.collect():  # one row per model and centre
        i = int(np.searchsorted(ends, r["c"], "right"))
        out[(i, r["c"] - int(ends[i]) + len(models[i]))] = (r["n"], r["lost"], np.array(r[3:]))
    return out


def isolation_trees(x: np.ndarray, seed: int, trees: int = TREES, rows: int = TREE_ROWS) -> tuple[list, int]:
    """Random split trees, each from a bounded sample of rows: the model is fitted on a
    sample, every row is scored. A node is (feature, cut, left, right) or its size."""
    rng = np.random.default_rng(seed)
    rows = min(rows, len(x))
    depth = math.ceil(math.log2(max(2, rows)))

    def grow(part: np.ndarray, left: int):
        low, high = part.min(0), part.max(0)
        can = np.flatnonzero(high > low)
        if left == 0 or len(part) <= 1 or not len(can):
            return len(part)
        f = int(rng.choice(can))
        cut = rng.uniform(low[f], high[f])
        below = part[:, f] < cut
        return (f, cut, grow(part[below], left - 1), grow(part[~below], left - 1))

    return [grow(x[rng.choice(len(x), rows, replace=False)], depth) for _ in range(trees)], rows


def _mean_path(n: float) -> float:
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def isolation_scores(x: np.ndarray, forest: list, rows: int) -> np.ndarray:
    """0 to 1; the easier a row is to separate, the higher."""
    total = np.zeros(len(x))

    def walk(node, at: np.ndarray, depth: int) -> None:
        if not len(at):
            return
        if isinstance(node, int):
            total[at] += depth + _mean_path(node)
            return
        f, cut, left, right = node
        below = x[at, f] < cut
        walk(left, at[below], depth + 1)
        walk(right, at[~below], depth + 1)

    for tree in forest:
        walk(tree, np.arange(len(x)), 0)
    return 2.0 ** (-(total / len(forest)) / max(_mean_path(rows), 1e-12))


RUN = (
    "status string, sample_count bigint, input_feature_count bigint, cluster_count bigint, cluster_selection string, cluster_model string, anomaly_model string, "
    "embedding_model string, feature_names array<string>, note string"
)


def run_record(spark: SparkSession, status: str, samples: int, note: str | None = None, features: tuple[str, ...] = (), selection: str = "disabled") -> DataFrame:
    """The record of a run that fitted nothing."""
    return spark.createDataFrame([(status, samples, len(features), 0, selection, "none", "none", "none", list(features), note)], RUN)


def run_model(matrix: DataFrame, clusters: int | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(run record, accounts, cluster summaries) of the feature matrix.

    Clusters by k-means on standardised features, numbered from 1 by falling size;
    anomalies by an isolation forest (under four rows all 0), ranked from the highest;
    a plane from the first two principal components, signs fixed by the largest
    loading. An empty matrix gives an empty result and the status ``skipped_no_samples``.
    """
    spark = matrix.sparkSession
    n = matrix.count()
    accounts_schema = "account_handle string, cluster_id bigint, anomaly_score double, centroid_distance double, embedding_x double, embedding_y double"
    if n == 0:
        scored = spark.createDataFrame([], accounts_schema)
        return run_record(spark, "skipped_no_samples", 0, features=FEATURES, selection="none"), _accounts(scored, matrix), _summaries(_accounts(scored, matrix))
    vectors = Stage(spark).cut(_vectors(standardised(model_features(matrix))))
    k, how, centres = choose_clusters(vectors, n, clusters, seed)
    forest = None
    if n >= 4:
        sample = vectors.orderBy(F.xxhash64("account_handle", F.lit(seed + 1))).limit(TREES * TREE_ROWS).collect()
        forest, rows = isolation_trees(np.array([r["features"].toArray() for r in sample]), seed)
    axes = np.zeros((len(FEATURES), 2))
    if n > 1:
        pca = PCA(k=min(2, n), inputCol="features", outputCol="p").fit(vectors).pc.toArray()
        for j in range(pca.shape[1]):
            axes[:, j] = pca[:, j] * (1 if pca[np.abs(pca[:, j]).argmax(), j] >= 0 else -1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(batch.num_rows, len(FEATURES))
            d = np.sqrt(((x[:, None, :] - centres[None]) ** 2).sum(2))
            label = d.argmin(1)
            odd = isolation_scores(x, forest, rows) if forest else np.zeros(len(x))
            plane = x @ axes
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(label.astype(np.int64)), pa.array(odd), pa.array(d[np.arange(len(x)), label]), pa.array(plane[:, 0].copy()), pa.array(plane[:, 1].copy())],
                ["account_handle", "cluster_id", "anomaly_score", "centroid_distance", "embedding_x", "embedding_y"],
            )

    scored = vectors.select("account_handle", vector_to_array("features").alias("x")).mapInArrow(score, accounts_schema)
    accounts = _accounts(scored, matrix)
    note = None if forest else "fallback_constant"
    run = [("ready", n, len(FEATURES), k, how, "kmeans", "isolation_forest" if forest else "fallback_constant", "pca", list(FEATURES), note)]
    return spark.createDataFrame(run, RUN), accounts, _summaries(accounts)


def _accounts(scored: DataFrame, matrix: DataFrame) -> DataFrame:
    sizes = scored.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("cluster_size"))
    # the clusters are few
    renumbered = sizes.select("cluster_id", "cluster_size", F.row_number().over(Window.orderBy(F.desc("cluster_size"), "cluster_id")).cast("bigint").alias("new_id"))
    more = matrix.select("account_handle", "coordination_score", "retweet_ratio", "network_weighted_degree")
    scored = scored.withColumns({c: F.round(c, 6) for c in ("anomaly_score", "centroid_distance", "embedding_x", "embedding_y")})
    joined = scored.join(F.broadcast(renumbered), "cluster_id").join(more, "account_handle")
    ranked = numbered(joined, [F.desc("anomaly_score"), F.col("account_handle")], "anomaly_rank")
    return ranked.select(
        "account_handle", F.col("new_id").alias("cluster_id"), "cluster_size", "anomaly_score", "anomaly_rank", "centroid_distance", "embedding_x", "embedding_y",
        "coordination_score", "retweet_ratio", "network_weighted_degree",
    )


def _summaries(accounts: DataFrame) -> DataFrame:
    order = Window.partitionBy("cluster_id").orderBy(F.desc("coordination_score"), F.desc("network_weighted_degree"), "account_handle")
    top = (
        accounts.withColumn("k", F.row_number().over(order))
        .where("k <= 10")
        .groupBy("cluster_id")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "account_handle"))), lambda s: s["account_handle"]).alias("top_accounts"))
    )
    mean = lambda c: F.round(F.avg(c), 4).alias("mean_" + c)
    return accounts.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("account_count"), mean("coordination_score"), mean("retweet_ratio"), mean("network_weighted_degree")).join(top, "cluster_id")
