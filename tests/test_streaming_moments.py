"""Moments of streamed draws: equal to the batch, once after restarts, complete placements only."""

import numpy as np
import pytest
from fluxmesh.operators import ensemble
from fluxmesh.streaming import moments

SAMPLE = "p int, k int, e int, magn double"


def put(spark, rows, path, name):
    spark.createDataFrame(rows, SAMPLE).coalesce(1).write.parquet(f"{path}/in/{name}")


def run(spark, elements, path, block=4):
    samples = spark.readStream.schema(SAMPLE).parquet(f"{path}/in/*")
    moments.stream_moments(samples, elements, f"{path}/out", f"{path}/state", block).awaitTermination()
    return moments.finished(spark.read.schema("p int, e long, n long, mean double, std double").parquet(f"{path}/out"), elements).collect()


def test_draws_over_restarts_equal_the_batch(spark, tmp_path):
    rng, path = np.random.default_rng(2), str(tmp_path)
    rows = [(p, k, e, float(rng.random())) for p in range(3) for k in range(4) for e in range(10)]
    rows += [(0, 9, 77, 1.0), (0, 9, 1, None)]  # no such element; no value
    rng.shuffle(order := list(range(len(rows))))
    elements = spark.createDataFrame([(e, 4) for e in range(10)] + [(50, 0)], "e int, due int")
    last = [i for i in order if rows[i][0] == 2][:1]
    early = [i for i in order if i not in last]
    put(spark, [rows[i] for i in early[:40]], path, "a")
    assert len(run(spark, elements, path)) < 30
    put(spark, [rows[i] for i in early[40:]], path, "b")
    two = run(spark, elements, path)
    assert [r.p for r in two] == [0] * 10 + [1] * 10
    put(spark, [rows[i] for i in last], path, "c")
    got = run(spark, elements, path)
    assert run(spark, elements, path) == got
    kept = spark.createDataFrame([r for r in rows if r[2] < 10 and r[3] is not None], SAMPLE)
    want = {(m.p, m.e): m for m in ensemble.moments(kept, ["p", "e"], "magn", ("p",)).collect()}
    assert [(r.p, r.e) for r in got] == sorted(want)
    for r in got:
        m = want[r.p, r.e]
        assert r.n == 4 and np.allclose([r["mean"], r["std"], r["cov"]], [m["mean"], m["std"], m["cov"]])


def test_due_draws_by_placement_and_too_many(spark, tmp_path):
    elements = spark.createDataFrame([(0, 1, 2), (1, 1, 1)], "p int, e int, due int")
    put(spark, [(0, 0, 1, 1.0), (0, 1, 1, 3.0), (1, 0, 1, 5.0)], str(tmp_path), "a")
    got = run(spark, elements, str(tmp_path))
    assert [(r.p, r.n, r["mean"]) for r in got] == [(0, 2, 2.0), (1, 1, 5.0)] and np.isclose(got[0]["std"], np.sqrt(2)) and got[1]["std"] == 0
    over = spark.createDataFrame([(1, 1), (2, 9)], "e int, due int")
    put(spark, [(0, 0, 1, 1.0), (0, 1, 1, 3.0)], f"{tmp_path}/over", "a")
    with pytest.raises(Exception, match="more draws"):
        run(spark, over, f"{tmp_path}/over")
