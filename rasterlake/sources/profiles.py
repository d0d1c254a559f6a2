"""Lens profiles from XML and measured curves from JSON, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BODY = "rdf:Description"


def _struct(fields: dict[str, str]) -> str:
    return "struct<" + ", ".join(f"`{k}`: {v}" for k, v in fields.items()) + ">"


def _params(name: str) -> dict[str, str]:
    return {f"_stCamera:{name}{k}": "double" for k in (1, 2, 3)}


_SHIFT = _struct({"_stCamera:ScaleFactor": "double", **_params("RadialDistortParam")})
_WARP = _struct({_BODY: _struct({**_params("RadialDistortParam"), "stCamera:ChromaticRedGreenModel": _SHIFT, "stCamera:ChromaticBlueGreenModel": _SHIFT})})
_SHADE = _struct({_BODY: _struct(_params("VignetteModelParam"))})
_MODEL = _struct({"_stCamera:FocalLength": "double", "_stCamera:ApertureValue": "double", "_stCamera:FocusDistance": "double", "stCamera:PerspectiveModel": _WARP, "stCamera:VignetteModel": _SHADE})


def lens_models(spark: SparkSession, path: str) -> DataFrame:
    """``(profile, focal, av, focus, dist, red, blue, vig)``: the measured models of all profile files under a path. Entries without focal length or aperture, or with
    neither a distortion nor a vignetting model, are passed over; missing parameters are 0, a missing scale is 1, a missing model is null."""
    rows = spark.read.format("xml").option("rowTag", "rdf:li").schema(f"`{_BODY}` {_MODEL}").load(path)
    m = rows.select(F.input_file_name().alias("profile"), F.col(f"`{_BODY}`").alias("m"))
    at = lambda *names: ".".join(["m", *(f"`{n}`" for n in names)])
    warp, shade = at("stCamera:PerspectiveModel", _BODY), at("stCamera:VignetteModel", _BODY)
    three = lambda base, name: F.when(F.col(base).isNotNull(), F.array(*(F.coalesce(F.col(f"{base}.`_stCamera:{name}{k}`"), F.lit(0.0)) for k in (1, 2, 3))))

    def shift(name: str):
        base = f"{warp}.`{name}`"
        return F.when(F.col(base).isNotNull(), F.struct(F.coalesce(F.col(f"{base}.`_stCamera:ScaleFactor`"), F.lit(1.0)).alias("scale"), three(base, "RadialDistortParam").alias("radial")))

    focal, av = F.col(at("_stCamera:FocalLength")), F.col(at("_stCamera:ApertureValue"))
    some = focal.isNotNull() & av.isNotNull() & (F.col(at("stCamera:PerspectiveModel")).isNotNull() | F.col(at("stCamera:VignetteModel")).isNotNull())
    return m.where(some).select(
        "profile", focal.alias("focal"), av.alias("av"), F.coalesce(F.col(at("_stCamera:FocusDistance")), F.lit(0.0)).alias("focus"), three(warp, "RadialDistortParam").alias("dist"),
        shift("stCamera:ChromaticRedGreenModel").alias("red"), shift("stCamera:ChromaticBlueGreenModel").alias("blue"), three(shade, "VignetteModelParam").alias("vig"),
    )


def lens_samples(models: DataFrame) -> DataFrame:
    """``(profile, focal, min_av, dist, red, blue, vig)``: a row for each focal length at the farthest focus. Distortion and colour shift are those of the widest
    aperture that has them; vignetting is a series over apertures, each from the farthest focus it was measured at."""
    whole = models.groupBy("profile").agg(F.min("av").alias("min_av"), F.max("focus").alias("far"))
    far = models.join(whole, "profile").where("focus = far")
    pick = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("av"))).alias(c)
    geometry = far.groupBy("profile", "focal", "min_av").agg(pick("dist"), pick("red"), pick("blue"))
    stops = models.where("vig is not null").groupBy("profile", "focal", "av").agg(F.max_by("vig", "focus").alias("vig"))
    series = stops.groupBy("profile", "focal").agg(F.array_sort(F.collect_list(F.struct("av", "vig"))).alias("vig"))
    return geometry.join(series, ["profile", "focal"], "left")


def curves(spark: SparkSession, path: str, schema: str = "log_exposure array<double>, curve array<array<double>>") -> DataFrame:
    """``(profile, place, x, values)``: the knots of all JSON curve files; a null was not measured and becomes NaN."""
    rows = spark.read.option("multiLine", "true").schema(schema).json(path).select(F.input_file_name().alias("profile"), F.posexplode(F.arrays_zip("log_exposure", "curve")).alias("place", "k"))
    return rows.select("profile", "place", F.col("k.log_exposure").alias("x"), F.transform("k.curve", lambda v: F.coalesce(v, F.lit(float("nan")))).alias("values"))
