"""Profiles to pixels: XML files, matching, bracketing against plain loops, tiles with each image's own halo against whole rasters."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rasterlake.operators import denoise_queries as D
from rasterlake.operators import lens_queries as L
from rasterlake.sources import profiles

SAMPLES = "profile string, focal double, min_av double, dist array<double>, red struct<scale: double, radial: array<double>>, blue struct<scale: double, radial: array<double>>, vig array<struct<av: double, vig: array<double>>>"
SHOTS = "image_id long, focal double, aperture double, focal_min double, focal_max double, aperture_max double, lens_code int"
ROWS = [
    ("a", 20.0, 3.0, [0.1, 0.0, 0.0], (1.01, [0.0, 0.1, 0.0]), None, [(3.0, [-0.4, 0.0, 0.0]), (5.0, [-0.2, 0.0, 0.0])]),
    ("a", 40.0, 3.0, [0.3, 0.0, 0.0], (1.03, [0.0, 0.3, 0.0]), (0.99, [0.1, 0.0, 0.0]), None),
    ("b", 50.0, 2.0, None, None, None, [(2.0, [-0.1, 0.2, 0.3])]),
]


def test_matching(spark):
    samples = spark.createDataFrame([*ROWS, ("c", 20.5, 1.0, *ROWS[0][3:]), ("c", 41.0, 1.0, *ROWS[0][3:])], SAMPLES)
    shots = [(1, 30.0, 8.0, 20.0, 40.0, 2.8, 9), (2, 30.0, 8.0, 20.0, 40.0, 1.5, 9), (3, 50.0, 8.0, 50.0, 50.0, 2.0, 0), (4, 50.0, 8.0, 50.0, 50.0, 2.0, 9), (5, 50.0, 8.0, 53.0, 53.0, 2.0, 255), (6, 50.0, 8.0, 54.0, 54.0, 2.0, 0),
             (7, 50.0, 8.0, 50.0, 50.0, None, None), (8, 1.0, 1.0, 0.0, 0.0, 2.0, 0), (9, None, None, None, None, None, None)]
    got = {r["image_id"]: r["profile"] for r in L.matched(spark.createDataFrame(shots, SHOTS), samples).collect()}
    assert got == {1: "a", 2: "c", 3: "b", 5: "b", 7: "b"}


def test_coefficients_are_bracketed(spark):
    shots = [(1, 30.0, 2.0**1.5, "a"), (2, 25.0, 4.0, "a"), (3, 10.0, 64.0, "a"), (4, 90.0, 4.0, "a"), (5, 40.0, None, "a"), (6, None, 2.0, "b"), (7, 20.0, 4.0, "z"), (8, 20.0, -1.0, "a")]
    df = spark.createDataFrame(shots, "image_id long, focal double, aperture double, profile string")
    got = {r["image_id"]: [r["focal"], *(r[k] for k in D.OWN)] for r in L.coefficients(df, spark.createDataFrame(ROWS, SAMPLES)).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6, 8]

    def want(focal, av):
        t = min(max((focal - 20) / 20, 0), 1)
        vig = 0.0 if av is None else -0.4 + 0.2 * min(max((av - 3) / 2, 0), 1)
        return [focal, 0.1 + 0.2 * t, 0, 0, 1.01 + 0.02 * t, 0, 0.1 + 0.2 * t, 0, 1 - 0.01 * t, 0.1 * t, 0, 0, vig * (1 - t), 0, 0]

    for k, focal, av in ((1, 30.0, 3.0), (2, 25.0, 4.0), (3, 10.0, 12.0), (4, 90.0, 4.0), (5, 40.0, None), (8, 20.0, None)):
        assert got[k] == pytest.approx(want(focal, av)), k
    assert got[6] == pytest.approx([1.0, 0, 0, 0, 1, 0, 0, 0, 1, 0, 0, 0, -0.1, 0.2, 0.3])


def pixels(spark, a, image_id):
    y, x = np.indices(a.shape[:2])
    pdf = pd.DataFrame({"image_id": image_id, "y": y.ravel().astype("int32"), "x": x.ravel().astype("int32"), **{c: a[..., k].ravel() for k, c in enumerate("rgb")}})
    return spark.createDataFrame(pdf).withColumns({"height": F.lit(a.shape[0]), "width": F.lit(a.shape[1])})


def back(df, image_id, shape):
    pdf, out = df.where(F.col("image_id") == image_id).toPandas(), np.full(shape, np.nan)
    assert len(pdf) == shape[0] * shape[1]
    out[pdf["y"], pdf["x"]] = pdf[["r", "g", "b"]]
    return out


def test_each_image_has_its_own_lens_and_halo(spark):
    rng = np.random.default_rng(8)
    a, b, plain = rng.random((40, 30, 3)), rng.random((24, 33, 3)), rng.random((9, 9, 3))
    k = {1: (12.0, [0.12, -0.03, 0.01, 1.002, 0.004, 0.001, 0.0, 0.997, -0.003, 0.0, 0.001, -0.5, 0.2, -0.05]), 2: (50.0, [0.3, 0.1, 0.0, 1.0, 0.0, 0.0, 0.0, 1.03, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0])}
    lenses = spark.createDataFrame([(i, f, *v) for i, (f, v) in k.items()], "image_id long, focal double, " + ", ".join(f"{c} double" for c in D.OWN))
    px = pixels(spark, a, 1).unionByName(pixels(spark, b, 2)).unionByName(pixels(spark, plain, 3)).withColumn("halo", F.lit("clash"))
    whole, tiled = L.correct(px, lenses, 512), L.correct(px, lenses, 8)
    for i, img in ((1, a), (2, b)):
        f, v = k[i]
        want = D._unwarped(img, 0, 0, *img.shape[:2], f, v[:3], v[3:7], v[7:11], v[11:])
        assert np.allclose(back(whole, i, img.shape), want) and np.allclose(back(tiled, i, img.shape), want) and not np.allclose(want, img)
    assert np.array_equal(back(tiled, 3, plain.shape), plain)
    assert L.correct(px.where("false"), lenses).count() == 0
    margins = {r["image_id"]: r["m"] for r in lenses.withColumn("m", L.margin(F.lit(40.0), F.lit(30.0))).select("image_id", "m").collect()}
    for i, (focal, v) in k.items():
        r2 = (D.HALF_DIAGONAL / focal * np.arange(1, 17) / 16) ** 2
        poly = lambda c: 1 + c[0] * r2 + c[1] * r2**2 + c[2] * r2**3  # noqa: B023, E731
        scales = np.stack([poly(v[:3]), poly(v[:3]) * v[3] * poly(v[4:7]), poly(v[:3]) * v[7] * poly(v[8:11])])
        assert margins[i] == np.ceil((np.abs(scales - 1).max(0) * 25 * np.arange(1, 17) / 16).max()) + 2


XML = """<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description xmlns:stCamera="http://ns.adobe.com/photoshop/1.0/camera-profile"><photoshop:CameraProfiles xmlns:photoshop="http://ns.adobe.com/photoshop/1.0/"><rdf:Seq>%s</rdf:Seq></photoshop:CameraProfiles></rdf:Description></rdf:RDF></x:xmpmeta>"""
ENTRY = '<rdf:li><rdf:Description stCamera:FocalLength="%s" stCamera:ApertureValue="3" stCamera:FocusDistance="10"><stCamera:PerspectiveModel><rdf:Description stCamera:RadialDistortParam1="%s"/></stCamera:PerspectiveModel></rdf:Description></rdf:li>'


def test_from_xml_to_pixels(spark, tmp_path):
    (tmp_path / "lens.xml").write_text(XML % (ENTRY % (20, 0.1) + ENTRY % (40, 0.3)))
    samples = profiles.lens_samples(profiles.lens_models(spark, str(tmp_path)))
    shots = spark.createDataFrame([(1, 25.0, 8.0, 20.0, 40.0, 2.8, 9)], SHOTS)
    a = np.random.default_rng(9).random((20, 26, 3))
    got = back(L.correct(pixels(spark, a, 1), L.coefficients(shots.join(L.matched(shots, samples), "image_id"), samples), 16), 1, a.shape)
    assert np.allclose(got, D._unwarped(a, 0, 0, 20, 26, 25.0, (0.15, 0, 0), (1, 0, 0, 0), (1, 0, 0, 0), (0, 0, 0)))
