"""Tiled denoising and lens correction: tiles do not show, broken samples do not spread, neutral parameters change nothing."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rasterlake.operators import denoise_queries as D


def image(spark, a, **more):
    y, x = np.indices(a.shape[:2])
    pdf = pd.DataFrame({"image_id": 7, "y": y.ravel().astype("int32"), "x": x.ravel().astype("int32"), **{c: a[..., k].ravel() for k, c in enumerate("rgb")}}).assign(**more)
    return spark.createDataFrame(pdf)


def back(df, shape):
    pdf, out = df.toPandas(), np.full(shape, np.nan)
    assert len(pdf) == shape[0] * shape[1]
    out[pdf["y"], pdf["x"]] = pdf[["r", "g", "b"]]
    return out


def test_wavelet_tiles_do_not_show(spark):
    rng = np.random.default_rng(4)
    a = 0.3 + 0.02 * rng.normal(size=(45, 38, 3))
    a[:, 20:] += 0.5
    a[5, 5], a[9, 30], a[20, 3] = np.nan, np.inf, 3.0
    whole = back(D.wavelet(image(spark, a), D.NOISE, 1.5, levels=3, tile=512), a.shape)
    tiled = back(D.wavelet(image(spark, a), D.NOISE, 1.5, levels=3, tile=16), a.shape)
    assert np.isfinite(whole).all() and np.allclose(whole, tiled, atol=1e-12)
    assert whole[20, 3].max() < 0.6  # a hot pixel goes
    assert whole[:, 20:].mean() - np.median(whole[:, :20]) == pytest.approx(0.5, abs=0.03)  # an edge stays
    assert whole[25:40, 2:15].std() < 0.6 * a[25:40, 2:15].std()


def test_wavelet_without_strength_keeps_clean_pixels(spark):
    a = np.tile(np.linspace(0.1, 0.9, 12)[None, :, None], (9, 1, 3))
    assert np.allclose(back(D.wavelet(image(spark, a), D.NOISE, 0.0), a.shape), a)
    one = np.full((1, 1, 3), 0.4)
    assert np.allclose(back(D.wavelet(image(spark, one), D.NOISE, 1.0), one.shape), one)
    assert D.wavelet(image(spark, one).where("false"), D.NOISE, 1.0).count() == 0


def test_lens(spark):
    a = np.random.default_rng(5).random((24, 20, 3))
    px = image(spark, a, height=24, width=20, focal=24.0)
    none = {"green": (0, 0, 0), "red": (1, 0, 0, 0), "blue": (1, 0, 0, 0), "vignette": (0, 0, 0)}
    assert np.allclose(back(D.lens_correct(px, **none, halo=2, tile=8), a.shape), a)
    whole, tiled = (back(D.lens_correct(px, **D.LENS, halo=5, tile=t), a.shape) for t in (512, 8))
    assert np.allclose(whole, tiled) and not np.allclose(whole, a)
    dark = back(D.lens_correct(px, **none | {"vignette": (-99, 0, 0)}, halo=2), a.shape)
    assert np.allclose(dark[0, 0], 4 * a[0, 0])


def test_driver_strength_and_small_rasters(spark):
    a = np.random.default_rng(6).random((7, 11, 3))
    px = image(spark, a)
    sizes = spark.createDataFrame([(7, 7, 11)], "image_id long, height int, width int")
    same = lambda p: p.withColumns({f"o_{c}": F.col(c) + 0.25 for c in "rgb"})
    assert np.allclose(back(D.denoise(px, sizes, same, 1.0, 4, 1), a.shape), a)  # the tile's mean is restored
    assert np.allclose(back(D.denoise(px, sizes, same, 0.5, 64, 16), a.shape), a)
    assert D.denoise(px, sizes, same, 0.001, 4, 1) is px


def test_tiles_go_through_together(spark):
    """Small tiles of one shape come to the function as one stack: a call for each tile took milliseconds each."""
    a = np.random.default_rng(7).random((64, 64, 3))
    px = image(spark, a).unionByName(image(spark, a).withColumn("image_id", F.lit(None).cast("long")))
    stacked = lambda a, top, left, carried: np.broadcast_to(np.asarray([len(a)]), a.shape).astype(float)
    sizes = D.in_tiles(px, stacked, 4, 1).toPandas()
    assert len(sizes) == 2 * 64 * 64 and sizes["image_id"].isna().sum() == 64 * 64 and sizes["r"].max() > 20
    one = D.in_tiles(px, lambda a, top, left, carried: a * 2, 4, 1, most=1).where("image_id = 7")
    assert np.allclose(back(one, a.shape), 2 * a)
