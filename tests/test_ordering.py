"""Regions in one ordering, the stored index and the result objects against plain NumPy."""

import re

import numpy as np
import pytest
from fluxmesh.model import FieldSpec
from fluxmesh.operators import ensemble, metrics, ordering
from fluxmesh.plans.solve_queries import RATE, _request
from fluxmesh.results import EnsembleResult, FieldResult
from pyspark.sql import functions as F

SPEC = FieldSpec("v", "w", ("g",), ("e",), ("e",))
REGIONS = ["odd", "low", "all"]


def field(spark, n=2000, seed=4):
    """Two groups, one with four fifths of all rows; many ties and some weights of zero; a null value and weight."""
    rng = np.random.default_rng(seed)
    rows = []
    for e in range(n):
        held = (["odd"] if e % 2 else []) + (["low", "low"] if e < n // 5 else []) + ["all", "unasked"]
        rows.append((int(e % 10 < 2), e, float(np.round(rng.normal(), 1)), float(rng.integers(0, 4)), held))
    rows += [(0, n, None, 1.0, ["all"]), (0, n + 1, 3.0, None, ["all"]), (None, n + 2, 1.0, 1.0, ["all"]), (0, n + 3, 1.0, 1.0, None)]
    return rows, spark.createDataFrame(rows, "g int, e int, v double, w double, regions array<string>")


def taken(rows, g, region):
    """Values and weights of a region in the order of value and key."""
    mine = [(r[2], r[1], r[3]) for r in rows if r[0] == g and r[2] is not None and r[3] is not None and r[4] and region in r[4]]
    return np.array([(v, w) for v, _, w in sorted(mine)]).T


def quantile(v, w, q):
    pos = (np.cumsum(w) - w / 2) / w.sum()
    below = np.searchsorted(pos, q, side="right") - 1
    if below < 0:
        return v[0]
    if below == len(v) - 1:
        return v[-1]
    return v[below] + (v[below + 1] - v[below]) * (q - pos[below]) / (pos[below + 1] - pos[below])


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rows, df = field(spark)
    path = f"file://{tmp_path_factory.mktemp('index')}"
    ordering.write_index(df, SPEC, REGIONS, path, buckets=8)
    return rows, ordering.open_index(spark, path, ("g",))


def test_any_quantile_is_the_midpoint_rule(spark, stored):
    rows, index = stored
    qs = [0.0, 1.0, 0.5, 0.999, *np.random.default_rng(1).random(60)]
    targets = spark.createDataFrame([(g, r, float(q)) for g in (0, 1) for r in REGIONS for q in qs], "g int, region string, q double")
    got = index.quantiles(targets).collect()
    assert len(got) == 2 * 3 * len(qs)
    for t in got:
        assert np.isclose(t.value, quantile(*taken(rows, t.g, t.region), t.q), rtol=1e-12, atol=1e-12), t


def test_any_threshold_gives_the_weight_above(spark, stored):
    rows, index = stored
    targets = spark.createDataFrame([(g, r, float(t)) for g in (0, 1) for r in REGIONS for t in (-9, -0.6, 0.0, 0.05, 1.1, 9)], "g int, region string, threshold double")
    for t in index.above(targets).collect():
        v, w = taken(rows, t.g, t.region)
        assert t.volume == w[v >= t.threshold].sum()
    for anchor in (80, 100):
        for t in index.focality(targets.select("g", "region", F.lit(0.3).alias("fraction")).distinct(), anchor).collect():
            v, w = taken(rows, t.g, t.region)
            top = v.max() if anchor == 100 else quantile(v, w, 0.8)
            assert np.isclose(t.anchor, top) and t.volume == w[v >= 0.3 * t.anchor].sum()


def test_a_quantile_reads_one_bucket(spark, stored):
    _, index = stored
    one = spark.createDataFrame([(0, "all", 0.43)], "g int, region string, q double")
    assert len({f.split("bucket=")[1].split("/")[0] for f in index.rows.inputFiles()}) > 4
    plan = index.quantiles(one)._jdf.queryExecution().sparkPlan().toString()
    filters = [f for f in re.findall(r"PartitionFilters: \[([^\]]+)\]", plan) if f]
    assert len(filters) == 1 and re.search(r"bucket#\d+ = \d+", filters[0])


def test_targets_without_rows_and_bad_targets(spark, stored):
    _, index = stored
    odd = spark.createDataFrame([(7, "all", 0.5), (0, "nowhere", 0.5), (0, "all", 0.5), (0, "all", 0.5)], "g int, region string, q double")
    got = index.quantiles(odd).collect()
    assert len(got) == 4 and sum(t.value is None for t in got) == 2
    assert index.quantiles(odd.limit(0)).count() == 0
    assert index.above(odd.withColumnRenamed("q", "threshold")).where("volume = 0").count() == 2
    for q in (1.5, float("nan"), None):
        with pytest.raises(ValueError):
            index.quantiles(spark.createDataFrame([(0, "all", q)], "g int, region string, q double"))
    _, df = field(spark, 30)
    for bad in ([], ["all", "all"]):
        with pytest.raises(ValueError):
            ordering.ranked(df, SPEC, bad)


def test_an_empty_field_has_an_empty_index(spark, tmp_path):
    _, df = field(spark, 30)
    index = ordering.write_index(df.limit(0), SPEC, REGIONS, f"file://{tmp_path}/empty")
    assert index.heads.count() == 0
    assert index.quantiles(spark.createDataFrame([(0, "all", 0.5)], "g int, region string, q double")).first().value is None


@pytest.mark.parametrize("buckets", [1, 8])
def test_regions_of_one_sort_equal_each_region_alone(spark, buckets):
    rows, df = field(spark, 600)
    got = {(r.g, r.region): r.asDict() for r in ordering.regional_summaries(df, SPEC, REGIONS, buckets=buckets).collect()}
    assert set(got) == {(g, r) for g in (0, 1) for r in REGIONS}
    for region in REGIONS:
        alone = df.where(F.array_contains("regions", region)).dropna(subset=["g", "v", "w"]).drop("regions")
        for want in metrics.region_summary(alone, SPEC).collect():
            mine = got[want.g, region]
            for name, value in want.asDict().items():
                assert np.isclose(mine[name], value, rtol=1e-12), (name, want.g, region)


def test_sorts_do_not_grow_with_the_regions(spark):
    _, df = field(spark, 50)
    count = lambda regions: ordering.ranked(df, SPEC, regions)._jdf.queryExecution().sparkPlan().toString().count("Window [")
    assert count(REGIONS) == count(["all"]) > 0


def test_field_result_accessors(spark):
    rows, df = field(spark, 400)
    df = df.dropna(subset=["g", "v", "w", "regions"])
    spec = FieldSpec("v", "w", ("p",), ("e",), ("e",))
    made = df.select(F.col("g").alias("p"), "e", "v")
    result = FieldResult(made, df.select("e", "w", "regions"), spec=spec, regions=REGIONS)
    for region in REGIONS:
        peaks = {r.p: r.peak for r in result.peak_magn(region).collect()}
        assert peaks == {g: taken(rows, g, region)[0].max() for g in (0, 1)}
    v, w = taken(rows, 0, "odd")
    assert np.isclose({r.p: r.value for r in result.percentile(37, "odd").collect()}[0], quantile(v, w, 0.37))
    for fraction in (0.5, 0.31):
        got = {r.p: r.volume for r in result.focality(fraction, "odd").collect()}
        assert got[0] == w[v >= fraction * quantile(v, w, 0.999)].sum()
    for call in (lambda: result.peak_magn("nowhere"), lambda: result.focality(0.31, "nowhere"), lambda: result.nodal_field("gray_matter"), lambda: FieldResult(made, df, mode="best")):
        with pytest.raises(ValueError):
            call()


def test_nodal_field_of_two_values_names_a_tissue(spark):
    slots = spark.createDataFrame([(0, 5, 2), (1, 5, 3)], "slot int, node int, tag int")
    values = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0)], "p int, slot int, ex double")
    result = FieldResult(values, values, slots=slots, slot_field=values)
    assert [(r.node, r.ex) for r in result.nodal_field("csf").collect()] == [(5, 2.0)]
    with pytest.raises(ValueError):
        result.nodal_field("all")
    whole = FieldResult(values, values, slots=slots.drop("tag"), slot_field=values)
    assert whole.nodal_field("all").count() == 2
    with pytest.raises(ValueError):
        whole.nodal_field("csf")


def test_ensemble_result_accessors(spark):
    rng = np.random.default_rng(8)
    sig = np.exp(rng.normal(size=(60, 2)))
    samples = [(p, k, e, float((p + 1) * (e + 1) * sig[k, 0] ** 2)) for p in range(2) for k in range(60) for e in range(5)]
    df = spark.createDataFrame(samples, "p int, k int, e int, magn double")
    elements = spark.createDataFrame([(e, 1.0 + e, 0.0, 0.0, float(e), ["a" if e < 3 else "b", "all"]) for e in range(5)], "e int, vol double, bx double, by double, bz double, regions array<string>")
    sigmas = spark.createDataFrame([(k, t + 1, float(sig[k, t])) for k in range(60) for t in range(2)], "k int, tag int, sigma double")
    rois = spark.createDataFrame([("spot", 1, 0.25), ("spot", 4, 0.75)], "name string, e int, w double")
    r = EnsembleResult(df, elements, sigmas, regions=["a", "b", "all"], rois=rois)
    x = sig[:, 0] ** 2
    got = {(s.p, s.region): s for s in r.summaries().collect()}
    assert len(got) == 6
    assert np.isclose(got[1, "a"].peak, 2 * 3 * x.mean()) and np.isclose(got[0, "b"].max_local_cov, x.std(ddof=1) / x.mean())
    assert np.isclose(r.peak_mean_magn("b").where("p = 0").first().peak, 5 * x.mean())
    assert {s.k: s.peak for s in r.peak_samples("a").where("p = 0").collect()}[7] == 3 * x[7]
    assert np.isclose({s.k: s.mean for s in r.roi_samples("spot").where("p = 0").collect()}[3], x[3] * (0.25 * 2 + 0.75 * 5))
    for output in ("peak", "spot"):
        shares = {(s.p, s.tag): s.share for s in r.tissue_sensitivity(output, "all").collect()}
        assert np.isclose(shares[1, 1], 1.0) and shares[1, 2] < 1e-12
    still = {(s.p, s.tag): s.share for s in r.tissue_sensitivity("focality", "all").collect()}
    assert set(still.values()) == {0.0}
    for call in (lambda: r.tissue_sensitivity("volume"), lambda: r.roi_samples("elsewhere"), lambda: r.peak_samples("c"), lambda: r.summary_for("c")):
        with pytest.raises(ValueError):
            call()


def test_moments_within_placements(spark):
    rows = spark.createDataFrame([(0, 0, 1e-14), (0, 0, 3e-14), (1, 0, 5.0), (1, 0, 7.0)], "p int, e int, magn double")
    apart = {m.p: m["cov"] for m in ensemble.moments(rows, ["p", "e"], "magn", ("p",)).collect()}
    assert apart[0] > 0.5 and {m.p: m["cov"] for m in ensemble.moments(rows, ["p", "e"], "magn").collect()}[0] == 0


def test_results_of_a_subject(spark):
    subject, placements, dipoles = _request(spark, "/root/testdata/sf0.001")
    with subject:
        two = placements.limit(2)
        field = subject.simulate(two, dipoles, RATE, "raw")
        got = {(r.p, r.region): r.peak for r in subject.result(field).summaries().collect()}
        want = {r.p: r.peak for r in subject.summarize(field, "all").collect()}
        assert all(np.isclose(got[p, "all"], v) for p, v in want.items())
        rows = list(subject.iter_simulate_conductivity_uq(two, dipoles, RATE, 3, 1, "all"))
        assert [r.p for r in rows] == sorted(want) and all(r.max_local_cov > 0 for r in rows)
        with pytest.raises(ValueError):
            subject.iter_simulate_conductivity_uq(two, dipoles, RATE, 3, 1, "nowhere")
