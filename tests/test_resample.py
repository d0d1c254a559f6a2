"""Area means against dense matrices, comparison and contact sheets at their edges, regions of a pyramid against crops of the whole."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rasterlake.operators import pyramid_queries as P
from rasterlake.operators import resample_queries as R

SCHEMA = "image_id long, y int, x int, v double"


def pixels(spark, a, image=1):
    y, x = np.indices(a.shape)
    pdf = pd.DataFrame({"image_id": image, "y": y.ravel().astype("int32"), "x": x.ravel().astype("int32"), "v": a.ravel()})
    return spark.createDataFrame(pdf, SCHEMA)


def sized(px, a, oh, ow):
    return px.withColumns({n: F.lit(v) for n, v in zip(R.SIZES, (*a.shape, oh, ow))})


def dense(pdf, shape):
    out = np.full(shape, np.nan)
    out[pdf["y"], pdf["x"]] = pdf["v"].astype(float)
    return out


def weights(n, m):
    """Share of each source pixel in each output pixel."""
    k, c = np.arange(m)[:, None], np.arange(n)[None]
    w = np.clip(np.minimum((k + 1) / m, (c + 1) / n) - np.maximum(k / m, c / n), 0, None)
    return w / w.sum(1, keepdims=True)


def area(a, oh, ow):
    return weights(a.shape[0], oh) @ a @ weights(a.shape[1], ow).T


@pytest.mark.parametrize("shape, oh, ow", [((13, 9), 5, 4), ((7, 5), 11, 23), ((6, 8), 3, 2), ((4, 9), 4, 9), ((1, 1), 3, 2), ((5, 3), 1, 1)])
def test_area_against_matrices(spark, shape, oh, ow):
    a = np.random.default_rng(1).random(shape)
    pdf = R.resample(sized(pixels(spark, a), a, oh, ow), ("v",)).toPandas()
    assert len(pdf) == oh * ow
    assert np.allclose(dense(pdf, (oh, ow)), area(a, oh, ow), atol=1e-12)


def test_area_of_nulls_gaps_and_bad_rows(spark):
    rows = [(1, 0, 0, 1.0), (1, 0, 1, None), (1, 1, 0, 3.0), (1, 1, 0, 5.0), (1, 0, 2, None), (1, 0, 3, None), (1, -1, 0, 9.0), (1, 9, 0, 9.0), (1, None, 0, 9.0), (None, 0, 0, 7.0)]
    px = spark.createDataFrame(rows, SCHEMA).withColumn("w", F.lit("clash"))
    big = px.withColumns({n: F.lit(v) for n, v in zip(R.SIZES, (2, 4, 1, 2))})
    got = {(r["image_id"], r["y"], r["x"]): r["v"] for r in R.resample(big, ("v",)).collect()}
    assert got == {(1, 0, 0): 3.0, (1, 0, 1): None, (None, 0, 0): 7.0}
    for sizes in ((0, 4, 1, 2), (2, 4, 0, 2), (2, 4, None, 2)):
        none = px.withColumns({n: F.lit(v).cast("int") for n, v in zip(R.SIZES, sizes)})
        assert R.resample(none, ("v",)).count() == 0
    assert R.resample(big.where("false"), ("v",)).count() == 0
    nan = R.resample(sized(pixels(spark, np.array([[1.0, np.nan, 2.0, 2.0]])), np.zeros((1, 4)), 1, 2), ("v",)).toPandas()
    assert np.array_equal(dense(nan, (1, 2)), [[np.nan, 2.0]], equal_nan=True)


def test_area_of_huge_sizes_stays_exact(spark):
    px = spark.createDataFrame([(1, 2_000_000_000, 0, 4.0)], SCHEMA).withColumns({n: F.lit(v) for n, v in zip(R.SIZES, (2_000_000_001, 1, 1_999_999_999, 1))})
    assert [tuple(r) for r in R.resample(px, ("v",)).collect()] == [(1, 1_999_999_998, 0, 4.0)]


def test_common_size(spark):
    rows = [(3, 4, 9, 12), (4, 3, 12, 9), (5, 5, 12, 12), (1, 1000, 1, 12), (7, 2, 12, 3), (8, 1, 12, 2)]
    df = spark.createDataFrame(rows, "height int, width int, h int, w int")
    h, w = R.common_size(F.col("height"), F.col("width"), 12)
    assert df.where((h != F.col("h")) | (w != F.col("w"))).count() == 0


def test_compare_of_sizes(spark):
    a = np.random.default_rng(2).random((6, 8))
    colour = lambda px, h, w: px.select("image_id", "y", "x", *(F.col("v").alias(c) for c in "rgb"), F.lit(h).alias("height"), F.lit(w).alias("width"))
    twice = np.kron(a, np.ones((2, 2)))
    left = colour(pixels(spark, twice), 12, 16).unionByName(colour(pixels(spark, a, 2), 6, 8))
    right = colour(pixels(spark, a), 6, 8).unionByName(colour(pixels(spark, a, 3), 6, 8))
    got = R.compare(left, right, 8).collect()
    assert [(r["image_id"], r["n"]) for r in got] == [(1, 48)]
    assert got[0]["max_de"] == pytest.approx(0, abs=1e-9)
    lighter = R.compare(left.withColumns({c: F.col(c) + 0.1 for c in "rgb"}), right, 4).collect()[0]
    assert lighter["n"] == 12 and lighter["dl"] > 1 and abs(lighter["da"]) < 0.01 and lighter["mean_de"] <= lighter["rms_de"] <= lighter["max_de"]


def test_contact_sheet_places_each_picture(spark):
    a, b, flat = np.full((4, 8), 0.25), np.full((6, 3), 0.5), np.full((1, 40), 0.75)
    px = pixels(spark, a, 1).unionByName(pixels(spark, b, 2)).unionByName(pixels(spark, flat, 3))
    rows = [("s", 5000, 1, 4, 8), ("s", 7, 2, 6, 3), ("s", 7, 3, 1, 40), ("t", 1, 1, 4, 8), ("t", 1, 1, 4, 8), (None, 1, 1, 4, 8), ("u", None, 1, 4, 8)]
    images = spark.createDataFrame(rows, "sheet string, position long, image_id long, height int, width int")
    got = R.compose(px, images.where("sheet = 's'"), 6, ("v",), gap=2).toPandas()
    want = np.concatenate([np.full((12, 6), 0.5), np.ones((2, 6)), np.ones((2, 6)), np.full((3, 6), 0.25)])
    assert len(got) == want.size and np.allclose(dense(got, want.shape), want)
    everything = R.compose(px, images, 6, ("v",), gap=2).groupBy("sheet").count().toPandas()
    assert set(everything["sheet"]) == {"s", "t"}
    assert R.compose(px, images.where("sheet = 's'"), 6, ("v",), gap=0).toPandas()["y"].max() == 14


@pytest.fixture(scope="module")
def big():
    return np.random.default_rng(3).random((45, 38))


@pytest.fixture(scope="module")
def stored(spark, big, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pyramid") / "p")
    levels = P.write_pyramid(pixels(spark, big).unionByName(pixels(spark, big[:5, :5], 2)), path, 8, ("v",))
    assert levels == 4  # six rows of tiles, three, two, one
    return P.read_pyramid(spark, path, ("v",))


def halved(a):
    return np.array([[a[2 * y : 2 * y + 2, 2 * x : 2 * x + 2].mean() for x in range((a.shape[1] + 1) // 2)] for y in range((a.shape[0] + 1) // 2)])


def test_levels_are_means(stored, big):
    want = big
    for level in range(4):
        got = P.region(stored, level, (0, 0, 64, 64), 8, images=[1], channels=("v",)).toPandas()
        assert len(got) == want.size and np.allclose(dense(got, want.shape), want)
        want = halved(want)


def test_region_with_halo_equals_the_crop_of_the_whole(spark, stored, big):
    def blurred(a):
        p = np.pad(a, 1, mode="edge")
        return sum(p[j : j + a.shape[0], i : i + a.shape[1]] for j in range(3) for i in range(3)) / 9

    top, left, bottom, right = 9, 6, 21, 17
    part = P.region(stored, 0, (top, left, bottom, right), 8, 1, [1], ("v",)).toPandas()
    a = dense(part.assign(y=part["y"] - top + 1, x=part["x"] - left + 1), (bottom - top + 2, right - left + 2))
    assert np.allclose(blurred(a)[1:-1, 1:-1], blurred(big)[top:bottom, left:right])
    corner = P.region(stored, 0, (0, 0, 3, 3), 8, 1, [1], ("v",)).toPandas()
    assert len(corner) == 16  # the halo ends at the raster's edge
    assert P.region(stored, 0, (80, 80, 90, 90), 8, channels=("v",)).count() == 0


def test_region_reads_its_folders_only(spark, stored):
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    part = P.region(stored, 0, (9, 6, 15, 17), 8, images=[1], channels=("v",))
    plan = part._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "ty" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(tx,0)" in plan and "EqualTo(image_id,1)" in plan
    read = {f.split("level=")[1].rsplit("/", 1)[0] for f in part.inputFiles()}
    assert "0/ty=1" in read
    scanned = part.select(F.input_file_name().alias("f")).distinct().collect()
    assert {r["f"].split("level=")[1].rsplit("/", 1)[0] for r in scanned} == {"0/ty=1"}


REQUESTS = "request_id long, image_id long, height int, width int, u0 double, v0 double, u1 double, v1 double, budget int"


def test_requests_equal_crops_of_the_scaled_image(spark, stored, big):
    boxes = [(1, 0.0, 0.0, 1.0, 1.0, 10), (2, 0.2, 0.1, 0.55, 0.9, None), (3, 0.5, 0.5, 2.0, 3.0, 6), (4, 0.0, 0.0, 1.0, 1.0, 40), (5, -1.0, 0.3, 0.4, 0.6, 3), (6, 0.0, 0.0, 1.0, 1.0, 1)]
    requests = spark.createDataFrame([(k, 1, 45, 38, *box) for k, *box in boxes], REQUESTS)
    got = P.serve(stored, P.planned(requests, 4), 8, ("v",)).toPandas()
    for k, u0, v0, u1, v1, budget in boxes:
        longest = max(38 * (u1 - u0), 45 * (v1 - v0))
        s = budget / longest if budget and longest > 1.25 * budget else 1.0
        level = max(n for n in range(4) if n == 0 or (s < 1 and longest >= budget * 2**n))
        a = big
        for _ in range(level):
            a = halved(a)
        oh, ow = max(1, int(45 * s + 0.5)), max(1, int(38 * s + 0.5))
        y0, y1, x0, x1 = max(0, int(np.floor(v0 * oh))), min(oh, int(np.ceil(v1 * oh))), max(0, int(np.floor(u0 * ow))), min(ow, int(np.ceil(u1 * ow)))
        mine = got[got["request_id"] == k]
        assert len(mine) == (y1 - y0) * (x1 - x0)
        out = dense(mine.assign(y=mine["y"] - y0, x=mine["x"] - x0), (y1 - y0, x1 - x0))
        assert np.allclose(out, area(a, oh, ow)[y0:y1, x0:x1], atol=1e-12)


def test_requests_without_a_result(spark, stored):
    rows = [(1, 1, 45, 38, 0.5, 0.0, 0.5, 1.0, None), (2, 1, 45, 38, 1.5, 0.0, 2.0, 1.0, None), (3, None, 45, 38, 0.0, 0.0, 1.0, 1.0, None), (4, 9, 45, 38, 0.0, 0.0, 1.0, 1.0, None), (5, 1, 45, 38, 0.0, 0.0, 1.0, 1.0, 0), (6, 1, 0, 38, 0.0, 0.0, 1.0, 1.0, 5)]
    assert P.serve(stored, P.planned(spark.createDataFrame(rows, REQUESTS), 4), 8, ("v",)).count() == 0


def test_pyramid_edges(spark, tmp_path):
    rows = [(1, 0, 0, 2.0), (1, 0, 0, 4.0), (1, 0, 1, None), (1, 1, 1, 6.0), (1, 3, 3, None), (1, -1, 0, 1.0), (None, 0, 0, 1.0), (1, None, 0, 1.0)]
    path = str(tmp_path / "few")
    assert P.write_pyramid(spark.createDataFrame(rows, SCHEMA), path, 2, ("v",)) == 2
    stored = P.read_pyramid(spark, path, ("v",))
    values = lambda level: sorted(((r["y"], r["x"], r["v"]) for r in P.region(stored, level, (0, 0, 9, 9), 2, channels=("v",)).collect()), key=str)
    assert values(0) == sorted([(0, 0, 2.0), (0, 0, 4.0), (0, 1, None), (1, 1, 6.0), (3, 3, None)], key=str)
    assert values(1) == [(0, 0, 4.0), (1, 1, None)]
    empty = str(tmp_path / "none")
    assert P.write_pyramid(spark.createDataFrame([], SCHEMA), empty, 4, ("v",)) == 1
    assert P.read_pyramid(spark, empty, ("v",)).count() == 0
    with pytest.raises(ValueError):
        P.write_pyramid(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "odd"), 3, ("v",))
    with pytest.raises(Exception, match="(?i)exists"):
        P.write_pyramid(spark.createDataFrame(rows, SCHEMA), path, 2, ("v",))
