"""Published values, quirks, metamorphic and edge cases of the raster operators."""

import math
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterlake.functions import color as C
from rasterlake.operators import color_queries, film_queries, lookup_queries, ordered_queries, stats_queries, stencil_queries

#: Published CIEDE2000 pairs (Sharma, Wu and Dalal 2005).
PAIRS = [
    (50, 2.6772, -79.7751, 50, 0, -82.7485, 2.0425), (50, -1.3802, -84.2814, 50, 0, -82.7485, 1.0000), (50, 0, 0, 50, -1, 2, 2.3669),
    (50, 2.49, -0.001, 50, -2.49, 0.0009, 7.1792), (50, 2.49, -0.001, 50, -2.49, 0.0011, 7.2195), (50, 2.5, 0, 50, 0, -2.5, 4.3065),
    (50, 2.5, 0, 73, 25, -18, 27.1492), (60.2574, -34.0099, 36.2677, 60.4626, -34.1751, 39.4387, 1.2644), (2.0776, 0.0795, -1.135, 0.9033, -0.0636, -0.5514, 0.9082),
]


def test_delta_e2000_pairs(spark):
    d = spark.createDataFrame([tuple(map(float, p)) for p in PAIRS], "l1 double, a1 double, b1 double, l2 double, a2 double, b2 double, want double")
    assert all(abs(r["de"] - r["want"]) < 1e-4 for r in C.delta_e2000(d).collect())


def test_percentile_quirk(spark):
    """Samples of 0 or less count in the total but are in no bin: with 1% of them the percentile is never reached."""
    px = spark.range(1000).select(F.when(F.col("id") % 100 == 0, 0.0).otherwise(0.5).alias("v"))
    s = stats_queries.metering(px)
    assert s.first()["top"] == 256.0
    assert stats_queries.auto_exposure_ev(s).first()["ettr_ev"] == -3.0
    assert stats_queries.percentile_of_bins(stats_queries.log2_bins(px.limit(0)), px.limit(0).agg(F.count(F.lit(1)).alias("n_all")), 0.9).first()["value"] == 1.0


def test_weighted_median_is_the_lower_one(spark):
    d = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 1.0), ("b", 5.0, 1.0), ("b", 7.0, 3.0)], "k string, v double, w double")
    assert {r["k"]: r["v"] for r in stats_queries.lower_weighted_median(d, ["k"], "v", "w").collect()} == {"a": 1.0, "b": 7.0}


def test_weighted_median_against_sorting(spark):
    rng = np.random.default_rng(7)
    rows = [("a", float(v), float(w)) for v, w in zip(rng.lognormal(0, 3, 500), rng.integers(0, 5, 500))] + [("b", float(v), 1.0) for v in rng.integers(0, 4, 40)]
    want = {}
    for k in "ab":
        v = sorted((x, w) for c, x, w in rows if c == k)
        total, run = sum(w for _, w in v) / 2, np.cumsum([w for _, w in v])
        want[k] = v[int(np.flatnonzero(run >= total)[0])][0]
    for cells in (1, 7, 1024):
        got = stats_queries.lower_weighted_median(spark.createDataFrame(rows, "k string, v double, w double"), ["k"], "v", "w", cells)
        assert {r["k"]: r["v"] for r in got.collect()} == want


def test_frames_with_a_weak_channel_go(spark):
    bins = [(f, c, b) for f, sizes in enumerate(((4, 4, 4), (9, 9, 3), (5, 5, 0))) for c, n in enumerate(sizes) for b in range(n)]
    kept = stats_queries.whole_frames(spark.createDataFrame(bins, "frame int, ch int, bin int"), "frame", "ch")
    assert {r["frame"] for r in kept.collect()} == {0} and kept.count() == 12


def test_fit_refits_when_negative(spark):
    d = spark.createDataFrame([(1, 0.1, 0.0, 5), (1, 0.2, 1.0, 5), (2, 0.1, 1.0, 5), (2, 0.2, 0.0, 5)], "f int, x double, var double, n int")
    got = {r["f"]: (r["a"], r["b"]) for r in stats_queries.affine_fit(d, ["f"]).collect()}
    assert got[1][0] == 0 and got[1][1] == pytest.approx(0.2 / 0.05) and got[2] == (0.5, 0.0)


def test_bracket(spark):
    """Ends are held; missing keys and nulls give null values; every sample gives one row; knots crowd or stand alone."""
    grid = spark.createDataFrame([("a", 1.0, 10.0), ("a", 2.0, 20.0), ("a", 4.0, 0.0), ("one", 5.0, 7.0), (None, 1.0, 1.0), *(("many", 1e-6 * k, float(k)) for k in range(300)), ("many", 1e6, -1.0)], "k string, gx double, gy double")
    pts = [("a", v) for v in (0.0, 1.0, 1.5, 2.0, 3.0, 4.0, 9.0, None)] + [("none", 1.0), (None, 1.0), ("one", -3.0), ("one", 8.0), ("many", 1.5e-6), ("many", -1.0), ("many", 2e6)]
    want = [10.0, 10.0, 15.0, 20.0, 10.0, 0.0, 0.0, None, None, None, 7.0, 7.0, 1.5, 0.0, -1.0]
    got = {(r["k"], r["x"]): r["value"] for r in lookup_queries.bracket(spark.createDataFrame(pts, "k string, x double"), grid, "x", ["k"]).collect()}
    assert len(got) == len(pts) and [got[p] for p in pts] == [w if w is None else pytest.approx(w, abs=1e-9) for w in want]


def test_range_match_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    shot = [(i, bool(i % 2), float(a), float(a * 2), 2.8) for i, a in enumerate(rng.uniform(10, 90, 80))]
    prof = [(i, f"p{i}", bool(i % 2), float(a), float(a * rng.uniform(1.9, 2.1)), float(rng.choice([2.0, 2.8, 4.0]))) for i, a in enumerate(rng.uniform(10, 90, 60))]
    near = lambda a, b: abs(a - b) <= 0.06 * max(a, b)
    want = {}
    for s in shot:
        hit = [(abs(s[4] - p[5]), p[0], p[1]) for p in prof if p[2] == s[1] and near(s[2], p[3]) and near(s[3], p[4])]
        if hit:
            want[s[0]] = min(hit)[2]
    got = lookup_queries.range_match(spark.createDataFrame(shot, "shot_id int, zoom boolean, f0 double, f1 double, aperture double"), spark.createDataFrame(prof, "idx int, name string, zoom boolean, f0 double, f1 double, aperture double"))
    assert {r["shot_id"]: r["name"] for r in got.collect()} == want


def test_wrap16(spark):
    vals = [0, 32767, 32768, -32768, -32769, 70000, -70000]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in vals], "v long").select(ordered_queries.wrap16(F.col("v"))).collect()]
    assert got == [np.array(v).astype(np.int16).item() for v in vals]


def image(spark, a):
    return spark.createDataFrame([(1, y, x, float(v)) for (y, x), v in np.ndenumerate(a)], "image_id long, y int, x int, v double")


def back(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r["y"], r["x"]] = r["v"]
    return out


def test_stencils_against_numpy(spark):
    a = np.random.default_rng(2).normal(size=(9, 7))
    taps = stencil_queries.GAUSS
    pad = lambda a, axis, d: np.take(a, np.clip(np.arange(a.shape[axis]) + d, 0, a.shape[axis] - 1), axis)
    want = a
    for axis in (1, 0):
        want = sum(t * pad(want, axis, k - 2) for k, t in enumerate(taps))
    got = back(stencil_queries.as_pixels(stencil_queries.convolve(stencil_queries.rows_as_arrays(image(spark, a)), taps)), a.shape)
    assert np.allclose(got, want)
    base, kept = a.copy(), a.copy()
    for k in range(5):
        low = base
        for axis in (0, 1):
            low = sum(t * pad(low, axis, (j - 2) * 2**k) for j, t in enumerate(stencil_queries.B3))
        d, t = base - low, 1.2 * 2.0 * 0.02 * stencil_queries.LEVEL_NORMS[k]
        kept -= d - d * np.maximum(1 - t * t / np.maximum(d * d, 1e-20), 0)
        base = low
    assert np.allclose(back(stencil_queries.atrous(image(spark, a), 5, 2.0), a.shape), kept)
    one = np.array([[3.0]])
    assert back(stencil_queries.atrous(image(spark, one), 2, 1.0), (1, 1)) == 3.0


def test_four_quarter_turns(spark):
    a = np.arange(12.0).reshape(3, 4)
    px, h, w = image(spark, a), 3, 4
    for _ in range(4):
        px, (h, w) = color_queries.rotate(px, 1, h, w), (w, h)
    assert np.array_equal(back(px, a.shape), a)
    assert np.array_equal(back(color_queries.rotate(image(spark, a), -1, 3, 4), (4, 3)), np.rot90(a))


def test_inverse_and_singular(spark):
    m = np.random.default_rng(0).normal(size=(3, 3))
    for k in (m, np.zeros((3, 3))):
        row = spark.range(1).select(*(c.alias(f"m{i}") for i, c in enumerate(C.inverse3([F.lit(float(v)) for v in k.ravel()])))).first()
        assert np.allclose(np.array(row).reshape(3, 3), np.linalg.inv(k) if k.any() else 0)


def test_grain_does_not_depend_on_partitions(spark):
    a = film_queries.grain_hash(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, a.repartition(7).collect())) == sorted(map(tuple, a.collect()))


def test_noise_model_recovers_planted_noise(spark):
    rng = np.random.default_rng(5)
    level = np.repeat(np.geomspace(0.02, 0.8, 40), 25 * 40).reshape(40, 25, 40)
    rows = [(i, y, x, float(v)) for i in range(40) for (y, x), v in np.ndenumerate(level[i] + rng.normal(size=(25, 40)) * math.sqrt(1e-6) + rng.normal(size=(25, 40)) * np.sqrt(4e-4 * level[i]))]
    hp = stats_queries.high_pass(spark.createDataFrame(rows, "image_id long, y int, x int, v double")).withColumn("f", F.lit(1))
    fit = stats_queries.affine_fit(stats_queries.noise_bins(hp, ["f"], 100), ["f"]).first()
    assert fit["b"] == pytest.approx(4e-4, rel=0.2)


def test_rest_works_without_the_llm_folders(tmp_path):
    """Importing the entry and running a query must not need the training-data subpackage."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import sys\nsys.modules['rasterlake.llm'] = None\nimport __spark_entry__ as e\nassert 'noise_profile' in e.queries() and not any(q.startswith('op') for q in e.queries())\nprint('fine')"
    assert "fine" in subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120).stdout


def test_streams_resume(spark, tmp_path):
    """A second start over the same folder takes up new files only and gives what one run over all of them gives."""
    from rasterlake.streaming import requests

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy("ts").toPandas()
    half = len(events) // 2
    for job in (requests.latest_wins, requests.quick_then_full):
        one, two = tmp_path / f"{job.__name__}-one", tmp_path / f"{job.__name__}-two"
        one.mkdir()
        two.mkdir()
        for folder, parts in ((one, [events]), (two, [events[:half], events[half:]])):
            for k, part in enumerate(parts):
                spark.createDataFrame(part).coalesce(1).write.mode("append").parquet(str(folder / "events.parquet"))
                for f in (folder / "events.parquet").glob("*.parquet"):
                    f.rename(folder / f"events-{k}.parquet")
                load, requests.load = requests.load, lambda s, d, n: s.read.parquet(f"{d}/events-0.parquet")
                try:
                    got = job(spark, str(folder))
                finally:
                    requests.load = load
                rows = sorted(map(tuple, got.collect()))
                if len(parts) == 1:
                    want = rows
        assert rows == want and rows
        again = sorted(map(tuple, got.collect()))
        assert again == want
