"""The number of clusters is chosen over all rows, the same way at every size."""

import numpy as np
from pyspark.ml.linalg import Vectors

from tidewake.operators import ml


def brute(x, labels):
    out = []
    for i in range(len(x)):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        own = labels == labels[i]
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = d[own].sum() / (own.sum() - 1)
        b = min(d[labels == k].mean() for k in set(labels) - {labels[i]})
        out.append((b - a) / max(a, b, 1e-12))
    return float(np.mean(out))


def test_silhouette_over_blocks_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(m, 1, (60, len(ml.FEATURES))) for m in (0, 2, 5)] + [np.full((1, len(ml.FEATURES)), 40.0)])
    df = spark.createDataFrame([("a%03d" % i, Vectors.dense(v)) for i, v in enumerate(x)], ["account_handle", "features"])
    models = {2: x[[0, 70]], 4: x[[0, 70, 130, 180]]}
    want = {k: brute(x, ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)) for k, c in models.items()}
    for rows in (50, 1000):
        monkeypatch.setattr(ml, "BLOCK_ROWS", rows)
        got = ml.silhouettes(df, len(x), models)
        assert all(abs(got[k] - want[k]) < 1e-9 for k in models), (rows, got, want)


def test_choice_scores_every_row_and_takes_twenty_starts(spark, monkeypatch):
    df = spark.createDataFrame([("a%04d" % i, Vectors.dense([float(i % 2)] * len(ml.FEATURES))) for i in range(6000)], ["account_handle", "features"])
    counted, runs = [], []
    whole, summed = ml.silhouettes, ml._partial_sums
    monkeypatch.setattr(ml, "silhouettes", lambda vectors, n, models: counted.append((vectors.count(), n)) or whole(vectors, n, models))
    monkeypatch.setattr(ml, "_partial_sums", lambda rows, models, width: runs.append([len(m) for m in models]) or summed(rows, models, width))
    k, how, centres = ml.choose_clusters(df, 6000, None, 42)
    assert (k, how) == (2, "silhouette") and sorted(c[0] for c in centres.tolist()) == [0.0, 1.0]
    assert counted == [(6000, 6000)] and runs[0].count(2) == 20


def lloyd(x, centres):
    for _ in range(300):
        near = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        now = np.array([x[near == c].mean(0) if (near == c).any() else centres[c] for c in range(len(centres))])
        if np.allclose(now, centres):
            break
        centres = now
    return ((x - centres[near]) ** 2).sum()


def test_k_means_is_as_good_as_many_plain_runs(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(m, 1, (80, len(ml.FEATURES))) for m in (0, 1.5, 3, 6, 8)])
    df = spark.createDataFrame([("a%03d" % i, Vectors.dense(v)) for i, v in enumerate(x)], ["account_handle", "features"])
    models = ml.k_means(df, [1, 3, 5], 7)
    for k, centres in models.items():
        got = ((x[:, None] - centres[None]) ** 2).sum(2).min(1).sum()
        best = min(lloyd(x, x[rng.choice(len(x), k, replace=False)]) for _ in range(40))
        assert got <= best * 1.01, (k, got, best)
    again = ml.k_means(df, [5], 7)[5]
    assert np.allclose(again, models[5], atol=1e-6)
