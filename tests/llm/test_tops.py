"""Records densest in their blocks are compared with all rows, however many they are."""

import numpy as np

from tidewake.llm import density_peaks


def test_many_tops_get_their_exact_distance(spark, monkeypatch):
    monkeypatch.setattr(density_peaks, "QUERIES", 2)
    asked, whole = set(), density_peaks._against_all

    def against_all(dense, queries, kind):
        asked.update(q["id"] for q in queries)
        return whole(dense, queries, kind)

    monkeypatch.setattr(density_peaks, "_against_all", against_all)
    x = np.random.default_rng(4).normal(size=(160, 3)).round(4)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "record bigint, vec array<double>")
    got = {r["record"]: r for r in density_peaks.density_clusters(df, layouts=1, block=10).collect()}
    assert len(asked) > 4 * density_peaks.QUERIES
    for i in asked:
        denser = [j for j in got if (got[j]["rho"], -j) > (got[i]["rho"], -i)]
        exact = min((float(np.linalg.norm(x[i] - x[j])) for j in denser), default=None)
        assert (got[i]["delta"] is None) == (exact is None) and (exact is None or abs(got[i]["delta"] - exact) < 1e-4)


def test_many_small_clusters_are_all_found(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(c, 0.3, (60, 12)) for c in rng.normal(0, 6, (80, 12))] + [rng.normal(0, 40, (20, 12))])
    df = spark.createDataFrame([(i, [float(z) for z in v]) for i, v in enumerate(x)], "record bigint, v array<double>").selectExpr("record", "cast(v as array<float>) vec")
    got = {r["record"]: r["cluster"] for r in density_peaks.density_clusters(df).collect()}
    assert len({got[i] for i in range(4800)}) == 80  # outliers found none of their own
    assert all(len({got[i] for i in range(60 * c, 60 * c + 60)}) == 1 for c in range(80)) and len(set(got.values())) == 80


def test_weights_scale_features(spark):
    df = spark.createDataFrame([("a", 0.0, 1.0), ("b", 2.0, None), ("c", 4.0, 3.0)], "h string, x double, y double")
    plain, halved = ({r["record"]: r["vec"] for r in density_peaks.scaled_vectors(df, "h", ["x", "y"], [], weights=w).collect()} for w in (None, {"y": 0.5}))
    assert all(abs(halved[h][1] - plain[h][1] / 2) < 1e-6 and halved[h][0] == plain[h][0] for h in "abc")
