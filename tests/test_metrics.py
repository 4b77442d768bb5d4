import numpy as np
import pytest
from fluxmesh.model import FieldSpec, region_tag
from fluxmesh.operators import ensemble, metrics
from fluxmesh.operators.recovery import validate_mode
from pyspark.sql import functions as F

SPEC = FieldSpec("v", "w", ("g",), ("e",), ("e",))


def table(spark, values, weights):
    return spark.createDataFrame([(1, i, float(v), float(w)) for i, (v, w) in enumerate(zip(values, weights, strict=True))], "g int, e int, v double, w double")


def reference(values, weights, qs):
    order = np.argsort(values, kind="stable")
    v, w = np.asarray(values)[order], np.asarray(weights)[order]
    cw = np.cumsum(w)
    return np.interp(qs, (cw - w / 2) / cw[-1], v)


@pytest.mark.parametrize("buckets", [1, 5])
def test_quantiles_match_interpolation(spark, buckets):
    rng = np.random.default_rng(3)
    values, weights = np.round(rng.normal(size=3000), 2), rng.random(3000) + 0.01
    got = metrics.weighted_quantiles(table(spark, values, weights), SPEC, [0, 1, 25, 50, 99.9, 100], buckets).first()
    want = reference(values, weights, [0, 0.01, 0.25, 0.5, 0.999, 1])
    assert np.allclose([got[f"p{p}"] for p in ("0", "1", "25", "50", "99_9", "100")], want, rtol=1e-12, atol=1e-12)


def test_quantiles_of_one_element_and_zero_weight(spark):
    assert metrics.weighted_quantiles(table(spark, [7], [2]), SPEC, [0, 50, 100]).first()[1:] == (7.0, 7.0, 7.0)
    assert metrics.weighted_quantiles(table(spark, [7, 8], [0, 0]), SPEC, [50]).first().p50 is None


def test_hot_sliver(spark):
    df = table(spark, [1.0] * 999 + [100.0], [1.0] * 1000)
    assert metrics.focality(df, SPEC, (0.5,), anchor=99).first().focality_0_5 == 1000
    assert metrics.focality(df, SPEC, (0.5,), anchor=100).first().focality_0_5 == 1


def test_summary_of_a_small_field(spark):
    df = table(spark, [1, 2, 3, 3], [1, 1, 1, 1])
    r = metrics.region_summary(df, SPEC).first()
    assert (r.peak, r.peak_e, r.volume, r.mean) == (3.0, 2, 4.0, 2.25)
    assert np.isclose(r["std"], np.std([1, 2, 3, 3])) and np.isclose(r.cog_e, (0 + 2 + 6 + 9) / 9)
    assert metrics.region_summary(df.where("false"), SPEC).count() == 0


def test_regions_of_interest(spark):
    cells = spark.createDataFrame([(0, 1.0, 0.0, 0.0, 0.0), (1, 3.0, 2.0, 0.0, 0.0), (2, 1.0, 9.0, 0.0, 0.0)], "e int, vol double, bx double, by double, bz double")
    t = spark.createDataFrame([("one", 1.0, 0.0, 0.0, 0.0), ("ball", 1.0, 0.0, 0.0, 1.5), ("ties", 1.0, 0.0, 0.0, 0.1)], "name string, tx double, ty double, tz double, radius double")
    got = {(r.name, r.e): r.w for r in metrics.resolve_targets(cells, t).collect()}
    assert got == {("one", 0): 1.0, ("ball", 0): 0.25, ("ball", 1): 0.75, ("ties", 0): 0.25, ("ties", 1): 0.75}


def test_moments_use_the_sample_deviation(spark):
    rows = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 5.0), (3, 0.0), (3, 0.0)], "e int, magn double")
    got = {r.e: r for r in ensemble.moments(rows, ["e"], "magn").collect()}
    assert np.isclose(got[1]["std"], np.sqrt(2)) and np.isclose(got[1]["cov"], np.sqrt(2) / 2)
    assert got[2]["std"] == 0 and got[3]["cov"] == 0


def test_draws_do_not_depend_on_their_number(spark):
    tissues = spark.createDataFrame([(2, 0.3, 0.2), (3, 1.5, 0.3)], "tag int, sigma double, cov double")
    few = {(r.k, r.tag): r.sigma for r in ensemble.draws(tissues, 8, 9).collect()}
    many = {(r.k, r.tag): r.sigma for r in ensemble.draws(tissues, 4000, 9).collect()}
    assert all(many[k] == v for k, v in few.items())
    two = np.array([v for (_, t), v in many.items() if t == 2])
    assert abs(two.mean() / 0.3 - 1) < 0.01 and abs(two.std() / two.mean() / 0.2 - 1) < 0.05
    still = ensemble.draws(ensemble.with_cov(tissues, spark.createDataFrame([(2, 0.0), (3, 0.0)], "tag int, cov double")), 3).collect()
    assert {(r.tag, round(r.sigma, 12)) for r in still} == {(2, 0.3), (3, 1.5)}
    assert ensemble.draws(tissues.withColumn("cov", F.lit(5.0)), 500, kind="normal").where("sigma <= 0").count() == 0


def test_sensitivity_by_several_tissues(spark):
    rng = np.random.default_rng(1)
    x = np.exp(rng.normal(size=(400, 2)))
    df = spark.createDataFrame([(float(a * a), float(a), float(b)) for a, b in x], "y double, a double, b double")
    got = ensemble.sensitivity(df, "y", ["a", "b"])
    assert np.isclose(got["a"], 1.0) and got["b"] < 1e-12
    assert ensemble.sensitivity(df.withColumn("y", F.lit(2.0)), "y", ["a"]) == {"a": 0.0}


def test_arguments_are_checked_at_once(spark):
    df = table(spark, [1], [1])
    for bad in (FieldSpec("nope", "w", key=("e",)), FieldSpec("v", "w")):
        with pytest.raises(ValueError):
            metrics.cumulated(df, bad)
    for call in (lambda: region_tag("nothing"), lambda: validate_mode("best"), lambda: ensemble.draws(df, 1, kind="odd")):
        with pytest.raises(ValueError):
            call()
    assert region_tag("gray_matter") == 2
