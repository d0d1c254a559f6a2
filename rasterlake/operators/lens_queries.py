"""From lens profiles to corrected pixels: match a shot's lens, bracket its coefficients by focal length and aperture, correct with a halo of the image's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterlake.operators.denoise_queries import HALF_DIAGONAL, OWN, PX, lens_correct_own
from rasterlake.operators.lookup_queries import range_match
from rasterlake.plans.registry import load, query
from rasterlake.sources import surrogates as S

#: Lens codes that say nothing about the lens, and the focal range from which on a lens is a zoom.
UNKNOWN_CODES, ZOOM_FROM = (0, 255), 0.5


def matched(shots: DataFrame, samples: DataFrame) -> DataFrame:
    """``(image_id, profile)`` of ``(image_id, focal_min, focal_max, aperture_max, lens_code)`` against the profiles of ``lens_samples``: both ends of the focal range within six
    in a hundred, then the nearest largest aperture, then the first name. A prime lens whose code is known is one that no profile is of. Shots without a match have no row."""
    zoom = lambda a, b: F.col(b) > F.col(a) + ZOOM_FROM
    profiles = samples.groupBy(F.col("profile").alias("name")).agg(F.min("focal").alias("f0"), F.max("focal").alias("f1"), F.pow(F.lit(2.0), F.min("min_av") / 2).alias("aperture"))
    asked = shots.select(F.col("image_id").alias("shot_id"), F.col("focal_min").alias("f0"), F.col("focal_max").alias("f1"), F.col("aperture_max").alias("aperture"), zoom("focal_min", "focal_max").alias("zoom"), "lens_code")
    asked = asked.where(F.col("zoom") | F.coalesce(F.col("lens_code").isin(*UNKNOWN_CODES), F.lit(True)))
    found = range_match(asked, profiles.withColumns({"zoom": zoom("f0", "f1"), "idx": F.col("name")}))
    return found.select(F.col("shot_id").alias("image_id"), F.col("name").alias("profile"))


def _around(series: Column, key: str, value: Column) -> Column:
    """The two members of a sorted series next to the value and its place between them, held at both ends."""
    low = F.coalesce(F.try_element_at(F.filter(series, lambda s: s[key] < value), F.lit(-1)), F.get(series, F.lit(0)))
    high = F.coalesce(F.get(F.filter(series, lambda s: s[key] >= value), F.lit(0)), F.try_element_at(series, F.lit(-1)))
    return F.struct(low.alias("lo"), high.alias("hi"))


def _mixed(pair: str, key: str, value: Column, of) -> Column:
    a, b = F.col(f"{pair}.lo"), F.col(f"{pair}.hi")
    span = b[key] - a[key]
    t = F.when(span > 0, F.least(F.greatest((value - a[key]) / span, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return F.zip_with(of(a), of(b), lambda p, q: p + (q - p) * t)


def coefficients(shots: DataFrame, samples: DataFrame) -> DataFrame:
    """``(image_id, focal, k0 .. k13)`` of matched shots ``(image_id, focal, aperture, profile)``: samples linear in the focal length, of each the vignette linear in the aperture value,
    held at the ends. A missing model of a sample is neutral; without an aperture there is no vignette; a focal length of null or under 1 is 1. A profile's samples, a few for a lens, are one array."""
    none = lambda c, n: F.coalesce(c, F.array(*(F.lit(0.0) for _ in range(n))))
    shift = lambda c: F.concat(F.array(F.coalesce(F.col(f"{c}.scale"), F.lit(1.0))), none(F.col(f"{c}.radial"), 3))
    warp = F.concat(none(F.col("dist"), 3), shift("red"), shift("blue")).alias("warp")
    profiles = samples.where("focal is not null").groupBy("profile").agg(F.array_sort(F.collect_list(F.struct("focal", warp, F.coalesce("vig", F.array().cast("array<struct<av: double, vig: array<double>>>")).alias("vig")))).alias("series"))
    s = shots.join(profiles, "profile").withColumns({"focal": F.greatest(F.coalesce("focal", F.lit(1.0)), F.lit(1.0)), "av": F.when(F.col("aperture") > 0, 2 * F.log2("aperture"))})
    s = s.withColumn("at", _around(F.col("series"), "focal", F.col("focal")))
    for end in ("lo", "hi"):
        s = s.withColumn(f"stop_{end}", _around(F.col(f"at.{end}.vig"), "av", F.col("av")))
        s = s.withColumn(f"vig_{end}", none(F.when(F.col("av").isNotNull(), _mixed(f"stop_{end}", "av", F.col("av"), lambda m: m["vig"])), 3))
    vig = _mixed("both", "focal", F.col("focal"), lambda m: m["vig"])
    s = s.withColumn("both", F.struct(*(F.struct(F.col(f"at.{e}.focal").alias("focal"), F.col(f"at.{e}.warp").alias("warp"), F.col(f"vig_{e}").alias("vig")).alias(e) for e in ("lo", "hi"))))
    s = s.withColumn("k", F.concat(_mixed("both", "focal", F.col("focal"), lambda m: m["warp"]), vig))
    return s.select("image_id", "focal", *(F.col("k")[i].alias(c) for i, c in enumerate(OWN)))


def margin(height: Column, width: Column) -> Column:
    """Pixels that the coefficients of a row move a sample at most, over 16 radii and all channels, and two."""
    corner, reach = F.sqrt(height * height + width * width) * 0.5, HALF_DIAGONAL / F.col("focal")
    poly = lambda k, r2: 1 + r2 * (F.col(k[0]) + r2 * (F.col(k[1]) + r2 * F.col(k[2])))

    def shift(f):
        r2 = (reach * f) * (reach * f)
        g = poly(OWN[:3], r2)
        return F.greatest(*(F.abs(v - 1) for v in (g, g * F.col(OWN[3]) * poly(OWN[4:7], r2), g * F.col(OWN[7]) * poly(OWN[8:11], r2)))) * corner * f

    return (F.ceil(F.array_max(F.transform(F.sequence(F.lit(1), F.lit(16)), lambda i: shift(i / 16.0)))) + 2).cast("int")


def correct(px: DataFrame, lenses: DataFrame, tile: int = 512) -> DataFrame:
    """Pixels ``(image_id, y, x, r, g, b, height, width)`` corrected by the rows of ``coefficients``; an image without one comes back as it is. One row for each image is
    joined; tiles reach as far as their own image's lens moves samples."""
    neutral = {c: F.lit(1.0 if c in (OWN[3], OWN[7]) else 0.0) for c in OWN}
    own = px.join(lenses, "image_id", "left").withColumns({c: F.coalesce(F.col(c), v) for c, v in neutral.items()} | {"focal": F.coalesce("focal", F.lit(1.0))})
    return lens_correct_own(own.withColumn("halo", margin(F.col("height").cast("double"), F.col("width").cast("double"))), tile)


def _samples(spark, sf_dir):
    """Profiles for the checks: one a region, a sample for each of its nations."""
    n, f = F.col("n_nationkey").cast("double"), F.lit
    radial = lambda a, b, c: F.array(n / a, -n / b, n / c)
    shift = lambda base, sign: F.struct((f(1.0) + sign * n / 8000).alias("scale"), radial(9000.0 * sign, 12000.0, 15000.0).alias("radial"))
    stop = lambda av, k: F.struct(f(av).alias("av"), F.array(-n / (k * 40), n / (k * 90), -n / (k * 300)).alias("vig"))
    return load(spark, sf_dir, "nation").select(
        F.concat(f("lens "), "n_regionkey").alias("profile"), (18.0 + 2 * n).alias("focal"), (2.0 + F.col("n_regionkey")).cast("double").alias("min_av"), radial(250.0, 900.0, 4000.0).alias("dist"),
        shift("red", 1.0).alias("red"), F.when(F.col("n_nationkey") % 4 > 0, shift("blue", -1.0)).alias("blue"), F.when(F.col("n_nationkey") % 6 > 0, F.array(stop(3.0, 1.0), stop(5.0, 2.0))).alias("vig"),
    )


def _shots(px: DataFrame, samples: DataFrame) -> DataFrame:
    ends = samples.groupBy("profile").agg(F.min("focal").alias("lo"), F.max("focal").alias("hi"))
    k = F.col("image_id")
    shots = px.select("image_id").distinct().withColumn("profile", F.concat(F.lit("lens "), k % 7)).join(F.broadcast(ends), "profile")
    return shots.select("image_id", (F.col("lo") + k % 11 / 10 * (F.col("hi") - F.col("lo"))).alias("focal"), (2.0 + k % 6).alias("aperture"), (F.col("lo") * 1.02).alias("focal_min"), (F.col("hi") * 0.99).alias("focal_max"), F.lit(2.8).alias("aperture_max"), F.lit(5).alias("lens_code"))


_R = lambda a, b, c: f"[n / {a}, -n / {b}, n / {c}]"
_SAMPLES_SQL = f"""s AS (SELECT 'lens ' || n_regionkey AS profile, 18 + 2 * n AS focal, 2.0::DOUBLE + n_regionkey AS min_av, [n / 250, -n / 900, n / 4000, 1 + n / 8000, n / 9000, -n / 12000, n / 15000,
  CASE WHEN n_nationkey % 4 > 0 THEN 1 - n / 8000 ELSE 1 END, CASE WHEN n_nationkey % 4 > 0 THEN -n / 9000 ELSE 0 END, CASE WHEN n_nationkey % 4 > 0 THEN -n / 12000 ELSE 0 END, CASE WHEN n_nationkey % 4 > 0 THEN n / 15000 ELSE 0 END] AS warp,
  n_nationkey % 6 > 0 AS shaded, n FROM (SELECT *, n_nationkey::DOUBLE AS n FROM nation)),
e AS (SELECT profile, min(focal) AS lo, max(focal) AS hi, pow(2.0, min(min_av) / 2) AS widest FROM s GROUP BY 1),
i AS (SELECT DISTINCT image_id FROM ({S.COLOUR})),
h AS (SELECT i.image_id, lo + image_id % 11 / 10.0::DOUBLE * (hi - lo) AS f, 2 * log2(2.0::DOUBLE + image_id % 6) AS av, lo * 1.02::DOUBLE AS f0, hi * 0.99::DOUBLE AS f1 FROM i JOIN e ON e.profile = 'lens ' || (image_id % 7)),
m AS (SELECT h.*, e.profile FROM h JOIN e ON (e.hi > e.lo + 0.5) AND abs(f0 - lo) <= 0.06 * greatest(f0, lo) AND abs(f1 - hi) <= 0.06 * greatest(f1, hi) QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY abs(2.8 - widest), e.profile) = 1),
v AS (SELECT s.*, m.image_id, m.f, least(greatest((av - 3) / 2, 0.0), 1.0) AS u FROM m JOIN s ON s.profile = m.profile),
w AS (SELECT *, warp || CASE WHEN shaded THEN [-n / 40 * (1 - u / 2), n / 90 * (1 - u / 2), -n / 300 * (1 - u / 2)] ELSE [0.0, 0.0, 0.0] END AS k FROM v),
b AS (SELECT image_id, f, arg_max(k, focal) FILTER (WHERE focal < f) AS k_lo, max(focal) FILTER (WHERE focal < f) AS lo, arg_min(k, focal) FILTER (WHERE focal >= f) AS k_hi, min(focal) FILTER (WHERE focal >= f) AS hi FROM w GROUP BY 1, 2),
c AS (SELECT image_id, f AS focal, {', '.join(f'CASE WHEN lo IS NULL THEN k_hi[{i + 1}] WHEN hi IS NULL THEN k_lo[{i + 1}] ELSE k_lo[{i + 1}] + (k_hi[{i + 1}] - k_lo[{i + 1}]) * (f - lo) / (hi - lo) END AS {k}' for i, k in enumerate(OWN))} FROM b)"""
_POLY = lambda k: f"(1 + r2 * ({k[0]} + r2 * ({k[1]} + r2 * {k[2]})))"


def _chain_sql() -> str:
    scale = {"r": f"g_s * k3 * {_POLY(OWN[4:7])}", "g": "g_s", "b": f"g_s * k7 * {_POLY(OWN[8:11])}"}
    place = lambda c, d: f"least(greatest(3.5 + {d} * {scale[c]}, 0.0), 7.0)"
    long = " UNION ALL ".join(f"SELECT image_id, y, x, gain, '{c}' AS c, {place(c, 'dy')} AS sy, {place(c, 'dx')} AS sx FROM q" for c in "rgb")
    own = ", ".join(f"coalesce({k}, {1.0 if k in (OWN[3], OWN[7]) else 0.0}) AS {k}" for k in OWN)
    return f"""WITH {_SAMPLES_SQL}, p AS MATERIALIZED ({S.LINEAR}), o AS MATERIALIZED (SELECT image_id, y, x, unnest(['r', 'g', 'b']) AS c, unnest([r, g, b]) AS v FROM p),
r AS (SELECT image_id, y, x, y - 3.5 AS dy, x - 3.5 AS dx, {own}, (pow(y - 3.5, 2) + pow(x - 3.5, 2)) * pow({HALF_DIAGONAL} / coalesce(focal, 1) / (0.5 * sqrt(128.0::DOUBLE)), 2) AS r2 FROM p LEFT JOIN c USING (image_id)),
q AS (SELECT *, {_POLY(OWN[:3])} AS g_s, 1 / greatest({_POLY(OWN[11:])}, 0.25) AS gain FROM r), t AS ({long}),
z AS (SELECT t.image_id, t.y, t.x, t.c, gain * sum(o.v * (1 - abs(o.y - sy)) * (1 - abs(o.x - sx))) AS v FROM t JOIN o ON o.image_id = t.image_id AND o.c = t.c AND abs(o.y - sy) < 1 AND abs(o.x - sx) < 1 GROUP BY t.image_id, t.y, t.x, t.c, gain)
SELECT image_id, y, x, {', '.join(f"round(max(CASE WHEN c = '{c}' THEN v END), 6) AS {c}" for c in 'rgb')} FROM z GROUP BY 1, 2, 3"""


@query(f"WITH {_SAMPLES_SQL} SELECT image_id, round(focal, 6) AS focal, {', '.join(f'round({k}, 8) AS {k}' for k in OWN)} FROM c")
def lens_coefficients(spark, sf_dir):
    """Matched profile and bracketed coefficients of each image."""
    samples = _samples(spark, sf_dir)
    shots = _shots(S.colour(spark, sf_dir), samples)
    found = coefficients(shots.join(matched(shots, samples), "image_id"), samples)
    return found.select("image_id", F.round("focal", 6).alias("focal"), *(F.round(k, 8).alias(k) for k in OWN))


@query(_chain_sql())
def lens_chain(spark, sf_dir):
    """From profiles to corrected pixels, each image with its own lens and halo; images without a profile stay."""
    px, samples = S.linear(spark, sf_dir), _samples(spark, sf_dir)
    shots = _shots(px, samples)
    found = coefficients(shots.join(matched(shots, samples), "image_id"), samples)
    out = correct(px.withColumns({"height": F.lit(S.SIDE), "width": F.lit(S.SIDE)}), found)
    return out.select(*PX, *(F.round(c, 6).alias(c) for c in "rgb"))
