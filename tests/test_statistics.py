import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pixloom.operators import scale, stats
from helpers import pixel_frame


def skew(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    return df.agg(stats.ref_skewness("x").alias("s")).first()["s"]


@pytest.mark.parametrize(
    "values, check",
    [
        (range(1, 10), lambda s: abs(s) < 0.01),
        ([1, 1, 1, 2, 2, 3, 10, 20], lambda s: abs(s - 1.312746) < 1e-6),
        ([1, 5, 10, 10, 11, 11, 11, 12], lambda s: s < -0.5),
        ([5.0] * 5, lambda s: s == 0),
        ([], lambda s: s == 0),
        ([42.0], lambda s: s == 0),
    ],
)
def test_skewness(spark, values, check):
    assert check(skew(spark, values))


@pytest.mark.parametrize(
    "values, flagged",
    [
        ([10, 12, 11, 13, 12.5, 11.5, 10.5, 12], []),
        ([1, 10, 11, 12, 13, 14, 15, 100], [1, 100]),
        ([10, 11, 12, 13, 14, 15, 16, 50], [50]),
        (list(range(1, 11)), []),
        (list(range(1, 11)) + [20], [20]),
        ([7, 7, 7, 7], []),
    ],
)
def test_iqr_outliers(spark, values, flagged):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    out = stats.iqr_outliers(df, "x").where("is_outlier")
    assert sorted(r["x"] for r in out.collect()) == flagged


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(-50, 50)), min_size=1, max_size=60))
def test_percentiles_match_numpy(spark, rows):
    pdf = pd.DataFrame(rows, columns=["k", "x"]).astype({"x": float})
    ranks = [("p0", 0.0), ("q1", 0.25), ("m", 0.5), ("q9", 0.9), ("p1", 1.0)]
    out = scale.exact_percentiles(spark.createDataFrame(pdf), ["k"], {"x": ranks}).toPandas()
    for r in out.to_dict("records"):
        group = pdf[pdf.k == r["k"]].x
        for name, p in ranks:
            assert r[name] == pytest.approx(group.quantile(p), abs=1e-9)


def test_percentiles_of_one_dominant_key(spark):
    """A small limit narrows brackets many times; the answer stays exact."""
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": np.where(rng.random(30_000) < 0.6, 0, rng.integers(1, 9, 30_000)),
                        "x": rng.normal(size=30_000).round(2)})
    out = scale.exact_percentiles(
        spark.createDataFrame(pdf), ["k"], {"x": [("m", 0.5), ("q", 0.99)]}, limit=50, digits=16
    ).toPandas().set_index("k")
    g = pdf.groupby("k").x
    assert (out.m - g.median()).abs().max() < 1e-12
    assert (out.q - g.quantile(0.99)).abs().max() < 1e-12


def test_blocked_rank_and_cumsum(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"k": rng.integers(0, 3, 2000), "o": rng.permutation(2000) * 7,
                        "v": rng.random(2000)})
    df = spark.createDataFrame(pdf)
    ranked = scale.blocked_rank(df, ["k"], [("b", F.floor(F.col("o") / 500))], ["o"]).toPandas()
    ranked = ranked.sort_values(["k", "o"])
    assert (ranked["rank"].to_numpy() == ranked.groupby("k").cumcount().to_numpy() + 1).all()
    summed = scale.blocked_cumsum(df, F.col("v"), "o", ["k"], block=32).toPandas()
    summed = summed.sort_values(["k", "o"])
    assert np.allclose(summed.cum, summed.groupby("k").v.cumsum())


def test_histogram_counts_and_density(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 0, 1, 2, 10]], "x double")
    rows = {r["bin"]: r for r in stats.histogram(df, "x", 5, mode="pdf").collect()}
    assert [rows[i]["n"] for i in range(5)] == [3, 1, 0, 0, 1]
    assert sum(r["density"] for r in rows.values()) * 2.0 == pytest.approx(1.0)


def test_class_area(spark):
    one = np.array([[1.0, 0.0], [0.0, 0.0]])
    zero = np.zeros((2, 2))
    planes = {"p_scar": one, "p_redness": zero, "p_hematoma": zero, "p_necrosis": zero,
              "p_background": 1 - one}
    df = pixel_frame(spark, planes, 1).unionByName(
        pixel_frame(spark, {**planes, "p_scar": one * 0, "p_background": one * 0 + 1}, 2)
    )
    out = {r["class"]: r for r in stats.class_area_stats(df).collect()}
    assert out["scar"]["mean_area"] == 0.5
    assert out["scar"]["std_area"] == pytest.approx(np.std([1, 0], ddof=1))
    assert sum(r["normalised"] for r in out.values()) == pytest.approx(1.0)
    assert out["scar"]["total_pixels"] == 8


def test_masked_stats_without_pixels_are_zero(spark):
    df = pixel_frame(spark, {c: np.ones((2, 2)) for c in "rgb"})
    r = stats.masked_channel_stats(df, F.lit(False)).first()
    assert (r["r_mean"], r["r_std"], r["r_skew"], r["pixel_count"]) == (0, 0, 0, 0)


def test_percentiles_narrow_wide_brackets_and_meet_ties(spark):
    from pixloom.operators.scale import exact_percentiles

    rng = np.random.default_rng(21)
    groups = {
        "normal": rng.normal(size=3000),
        "ties": np.repeat([0.0, 1.0, 1.5], [1500, 20, 480]),
        "zeros and tail": np.concatenate([np.zeros(1800), rng.random(200) * 1e-3, rng.random(5) * 1e9]),
        "few": np.array([3.0, 1.0, 2.0]),
        "one": np.array([7.0]),
        "steps": rng.integers(0, 4, 999).astype(float),
    }
    rows = [(k, float(v), None if i % 7 == 3 else float(v) * 2) for k, vs in groups.items() for i, v in enumerate(vs)]
    rows += [("empty", None, None), (None, 4.0, None), (None, 6.0, None)]
    df = spark.createDataFrame(rows, "k string, v double, w double").repartition(5)
    ps = [("p0", 0.0), ("p25", 0.25), ("p50", 0.5), ("p99", 0.99), ("p100", 1.0)]
    for options in ({}, {"limit": 25, "digits": 5}, {"limit": 2, "digits": 3}):
        got = {r["k"]: r for r in exact_percentiles(df, ["k"], {"v": ps, "w": [("w50", 0.5)]}, **options).collect()}
        assert len(got) == 8
        for k, vs in groups.items():
            want = np.percentile(vs, [p * 100 for _, p in ps])
            assert np.allclose([got[k][n] for n, _ in ps], want, rtol=1e-12, atol=1e-12), (k, options)
            kept = [v * 2 for i, v in enumerate(vs) if i % 7 != 3]
            assert got[k]["w50"] == pytest.approx(np.median(kept)) and got[k]["n_w"] == len(kept)
        assert got["empty"]["p50"] is None and got["empty"]["n_v"] == 0
        assert got[None]["p50"] == 5.0 and got[None]["w50"] is None
        whole = exact_percentiles(df, [], {"v": [("p75", 0.75)]}, **options).first()
        assert whole["p75"] == pytest.approx(np.percentile([r[1] for r in rows if r[1] is not None], 75))
    assert exact_percentiles(df.limit(0), ["k"], {"v": ps}).count() == 0


def test_uniform_rank_over_many_buckets(spark):
    rng = np.random.default_rng(30)
    draws = np.append(rng.random(500), [0.0, 0.0, 0.5, 0.5, 1.0 - 2.0**-53])
    df = spark.createDataFrame(pd.DataFrame({"id": rng.permutation(len(draws)), "u": draws})).repartition(4)
    rows = scale.uniform_rank(df, "u", ["id"], rows=20).collect()
    assert [r["place"] for r in sorted(rows, key=lambda r: (r["u"], r["id"]))] == list(range(1, len(draws) + 1))
    assert scale.uniform_rank(df.limit(0), "u", ["id"]).count() == 0


def test_metrics_by_name_and_own_metrics(spark):
    from pixloom.operators import metrics

    df = spark.createDataFrame([("a", [1.0, 0.0], [1.0, 0.0]), ("a", [0.0, 2.0], [1.0, 0.0])], "k string, logits array<double>, truth array<double>")
    out = metrics.evaluate(df, 2, ["cross_entropy", "quadratic_error"], ["k"]).first()
    p = [np.exp(1) / (np.exp(1) + 1), 1 / (1 + np.exp(2))]
    assert out["cross_entropy"] == pytest.approx(-np.mean(np.log(np.array(p) + 2.0**-23)))
    assert out["quadratic_error"] == pytest.approx(0 + 1 + 4)

    @metrics.metric("worst")
    def worst():
        return metrics.Metric(lambda p, y, z: F.abs(p[0] - y[0]), F.max)

    assert metrics.evaluate(df, 2, ["worst"]).first()["worst"] == pytest.approx(1 - p[1])
    with pytest.raises(ValueError, match="unknown"):
        metrics.evaluate(df, 2, ["no such"])
    with pytest.raises(ValueError, match="weights"):
        metrics.evaluate(df, 2, {"w": metrics.weighted_entropy([1.0])})
