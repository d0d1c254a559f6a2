"""Work that grows with the input: rows made by joins and generators are read from Spark's own metrics."""

import os

import numpy as np
from pyspark.sql import functions as F

from rasterlake.operators import lookup_queries, pyramid_queries, stencil_queries
from rasterlake.plans import catalog


def rows_made(spark, action, kinds=("Join", "Generate")):
    """What ``action()`` returns, and the most rows that one operator of these kinds made in it."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    out = action()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    done, most = store.executionsList(), 0
    for k in range(before, done.size()):
        number = done.apply(k).executionId()
        values, nodes = store.executionMetrics(number), store.planGraph(number).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            if any(k in node.name() for k in kinds):
                for m in (node.metrics().apply(i) for i in range(node.metrics().size())):
                    if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                        most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return out, most


def test_range_match_makes_rows_in_proportion(spark):
    """Before, each shot met each profile of its focal range: 4,000,000 rows here."""
    rng = np.random.default_rng(8)
    shots = [(i, True, 24.0, 70.0, float(a)) for i, a in enumerate(rng.uniform(1, 9, 2000))] + [(2000, True, 24.0, 70.0, None), (2001, True, 200.0, 400.0, 2.8), (2002, True, 24.0, 70.0, 1e17), (2003, True, 24.0, 70.0, float("nan")), (2004, True, 24.0, 70.0, 4.0)]
    at = [*np.round(rng.uniform(1, 9, 1500), 2), *rng.uniform(1, 9, 500), 3.5, 4.5]
    profiles = [(3000 - i, f"p{i}", True, 24.5, 70.5, float(a)) for i, a in enumerate(at)] + [(1, "other", False, 24.0, 70.0, 4.0), (2, "none", True, 24.5, 70.5, None)]
    frames = spark.createDataFrame(shots, "shot_id int, zoom boolean, f0 double, f1 double, aperture double"), spark.createDataFrame(profiles, "idx int, name string, zoom boolean, f0 double, f1 double, aperture double")
    got, most = rows_made(spark, lambda: dict(map(tuple, lookup_queries.range_match(*frames).collect())))
    mine = [p for p in profiles if p[2]]

    def nearest(a):
        far = lambda v: (v is None or a is None, 0.0 if v is None or a is None or a != a else abs(a - v))
        return min(mine, key=lambda p: (*far(p[5]), p[0]))[1]

    assert got == {i: nearest(a) for i, _, f0, _, a in shots if f0 == 24.0}
    assert 0 < most < 20_000


def test_self_ensemble_needs_no_shuffle(spark):
    """Before, each pixel was shuffled and sorted eight times."""
    a = np.random.default_rng(3).random((3, 5))
    images = spark.createDataFrame([(1, a.tolist())], "image_id long, rows array<array<double>>")
    left = lambda rows: F.transform(rows, lambda r: F.transform(r, lambda v, i: 0.25 * v + 0.75 * F.coalesce(F.get(r, i - 1), v)))
    got = stencil_queries.self_ensemble(images, left).collect()[0]["rows"]
    pad = np.pad(a, 1, mode="edge")
    want = 0.25 * a + 0.75 / 4 * (pad[:-2, 1:-1] + pad[2:, 1:-1] + pad[1:-1, :-2] + pad[1:-1, 2:])
    assert np.allclose(got, want)
    plan = catalog.QUERIES["d4_ensemble"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_served_requests_are_dealt_over_tasks(spark):
    """Before, requests met few tiles in few tasks and became pixels there; now tasks are as many as the requests need, and pixels are not shuffled again."""
    px = spark.range(1024).selectExpr("cast(0 as long) AS image_id", "cast(id div 32 as int) AS y", "cast(id % 32 as int) AS x", "double(id) AS v")
    path = pyramid_queries.shared_folder(spark, "rasterlake/pyramid-test-scale")
    levels = pyramid_queries.write_pyramid(px, path, 16, ("v",)) if not os.path.exists(path) else 2
    requests = spark.range(300).selectExpr("id AS request_id", "cast(0 as long) AS image_id", "32 AS height", "32 AS width", "0.25D AS u0", "0.25D AS v0", "0.75D AS u1", "0.75D AS v1", "cast(null as int) AS budget")
    out = pyramid_queries.serve(pyramid_queries.read_pyramid(spark, path, ("v",)), pyramid_queries.planned(requests, levels), 16, ("v",), each=10)
    assert out.rdd.getNumPartitions() == 31
    got = out.where("request_id = 299").toPandas()
    assert len(got) == 256 and (got["v"] == got["y"] * 32 + got["x"]).all() and got["y"].min() == 8
