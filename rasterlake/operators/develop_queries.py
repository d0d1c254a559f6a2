"""From a container to a linear raster: camera matrices, calibration, preparation and development."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterlake.functions import color as C
from rasterlake.operators.calibration_queries import to_decoded
from rasterlake.operators.color_queries import PX, rounded
from rasterlake.plans.registry import load, query
from rasterlake.plans.shared import written
from rasterlake.sources import surrogates as S

#: Chromatic adaptation from D65 to D50 (Bradford), and the balance whose gain stands for D65.
D65_TO_D50 = (1.0478112, 0.0228866, -0.0501270, 0.0295424, 0.9904844, -0.0170491, -0.0092345, 0.0150436, 0.7521316)
D65_BALANCE = "Overcast"


def nine(array: str) -> list[Column]:
    return [F.col(array)[k] for k in range(9)]


def product(a, b) -> list[Column]:
    """Row-major 3 x 3 product; entries may be columns or numbers."""
    return [a[3 * i] * b[j] + a[3 * i + 1] * b[3 + j] + a[3 * i + 2] * b[6 + j] for i in range(3) for j in range(3)]


def neutral_of(m: list[Column]) -> list[Column]:
    """Raw values of the white point under a raw-to-XYZ matrix."""
    inverse = C.inverse3(m)
    return [C.dot(C.WHITE, tuple(inverse[3 * k : 3 * k + 3])) for k in range(3)]


def camera_to_xyz(rows: DataFrame) -> DataFrame:
    """Adds ``legacy`` and ``bmt`` to rows with ``cc`` (newer engines), ``corr`` and ``cam`` (older ones), arrays of nine or null: sRGB to XYZ
    times cc where there is one, else corr x cam with its columns scaled by the neutral. Steps are columns, so nothing is computed twice."""
    rows = rows.withColumn("legacy", F.when(F.col("corr").isNotNull() & F.col("cam").isNotNull(), F.array(*product(nine("corr"), nine("cam")))))
    rows = rows.withColumn("legacy_neutral", F.when(F.col("legacy").isNotNull(), F.array(*neutral_of(nine("legacy")))))
    scaled = F.array(*(F.col("legacy")[3 * i + j] * F.col("legacy_neutral")[j] for i in range(3) for j in range(3)))
    return rows.withColumn("bmt", F.when(F.col("cc").isNotNull(), F.array(*product([F.lit(v) for v in C.SRGB_TO_XYZ], nine("cc")))).when(F.col("legacy").isNotNull(), scaled))


def calibrate(rows: DataFrame) -> DataFrame:
    """Adds the calibration to rows with cc, corr, cam, ``gains`` and ``gains_d65`` (arrays of three or null), ``factors`` (arrays of three), ``capture_iso`` and
    ``sensor_iso``: gain, color_matrix, forward_matrix, neutral, camera_calibration, baseline, error."""
    rows = camera_to_xyz(rows)
    times = lambda c: F.aggregate(F.coalesce("factors", F.array().cast("array<array<double>>")), c, lambda g, f: F.zip_with(g, f, lambda a, b: a * b))
    own = F.coalesce("gains", F.when(F.col("legacy_neutral").isNotNull(), F.transform("legacy_neutral", lambda n: 1 / n)))
    rows = rows.withColumns({"gain": times(own), "gain_d65": times(F.col("gains_d65"))})
    ones = F.array(F.lit(1.0), F.lit(1.0), F.lit(1.0))
    iso = (F.col("capture_iso") > 0) & (F.col("sensor_iso") > 0)
    return rows.withColumns(
        {
            "color_matrix": F.when(F.col("bmt").isNotNull(), F.array(*C.inverse3(nine("bmt")))),
            "forward_matrix": F.when(F.col("bmt").isNotNull(), F.array(*product([F.lit(v) for v in D65_TO_D50], nine("bmt")))),
            "neutral": F.transform("gain", lambda g: 1 / g),
            "camera_calibration": F.transform(F.coalesce("gain_d65", ones), lambda g: 1 / g),
            "baseline": F.when(iso, F.log2(F.col("capture_iso") / F.col("sensor_iso"))).otherwise(0.0),
            "error": F.when(F.col("gain").isNull(), "no white-balance gain").when(F.col("bmt").isNull(), "no colour matrix"),
        }
    ).drop("legacy", "legacy_neutral", "gain_d65")


def develop(px: DataFrame, images: DataFrame, key: str = "image_id") -> DataFrame:
    """Linear sRGB of pixels (key, y, x, c0, c1, c2) inside each image's active ``area`` (top, left, bottom, right, ends excluded; null: all), shifted to its corner:
    samples between ``black`` and ``top`` (arrays of three), matrix XYZ-to-sRGB x inverse(color_matrix) x diag(gain), highlights desaturated. One join by image; calibrations are a row each."""
    m = product([F.lit(v) for v in C.XYZ_TO_SRGB], nine("bmt"))
    side = images.where("error is null").withColumn("bmt", F.array(*C.inverse3(nine("color_matrix")))).select(key, "gain", "black", "top", "area", F.array(*m).alias("m"))
    j = px.join(side, key).where(F.col("area").isNull() | (F.col("y").between(F.col("area")[0], F.col("area")[2] - 1) & F.col("x").between(F.col("area")[1], F.col("area")[3] - 1)))
    raw = tuple((F.col(f"c{k}") - F.col("black")[k]) / (F.col("top")[k] - F.col("black")[k]) for k in range(3))
    rgb = C.develop(raw, 0.0, 1.0, nine("m"), tuple(F.col("gain")[k] for k in range(3)))
    shift = lambda c, k: (F.col(c) - F.coalesce(F.col("area")[k], F.lit(0))).alias(c)
    return j.select(key, shift("y", 0), shift("x", 1), *(c.alias(n) for c, n in zip(rgb, "rgb")))


def prepared(files: DataFrame, balance: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Pixels ``(path, y, x, c0, c1, c2)`` and one calibrated row per file, from ``(path, content)``. The white balance is the given one, else the header's, else the first the
    file has gains for. A file without raw image, metadata, gain or matrix keeps its row, with an error."""
    from rasterlake.sources import x3f

    rows = x3f.sections(files)
    images, found = x3f.image_section(rows), x3f.entries(rows)
    lists = found.where("kind = 'property'").select("path", "name", F.explode("props").alias("p")).select("path", "name", "p.key", "p.value")
    matrices = found.where("kind = 'matrix' and error is null").select("path", "name", F.coalesce("f64", F.col("i32").cast("array<double>"), F.col("u32").cast("array<double>")).alias("v"))
    heads = x3f.headers(files).select("path", "orientation", "white_balance", F.col("error").alias("head_error"))
    plain = lambda name: F.regexp_replace(name, "^DP1_", "")
    gains = lists.where(plain("name") == "WhiteBalanceGains").groupBy("path").agg(F.min("key").alias("first_balance"))
    wanted = heads.join(gains, "path", "left").withColumn("wb", F.coalesce(F.lit(balance), F.nullif("white_balance", F.lit("")), "first_balance"))
    tables = ("WhiteBalanceGains", "WhiteBalanceColorCorrections", "WhiteBalanceCorrections", "WhiteBalanceIlluminants")
    named = lists.where(plain("name").isin(*tables)).select("path", plain("name").alias("table"), "key", F.col("value").alias("name")).join(matrices, ["path", "name"])
    named = named.join(wanted.select("path", "wb"), "path")
    pick = lambda t, k: F.max(F.when((F.col("table") == t) & (F.col("key") == k), F.col("v")))
    wb = F.col("wb")
    cal = named.groupBy("path").agg(pick(tables[0], wb).alias("gains"), pick(tables[0], F.lit(D65_BALANCE)).alias("gains_d65"), pick(tables[1], wb).alias("cc"), pick(tables[2], wb).alias("corr"), pick(tables[3], wb).alias("cam"))
    one = lambda n: F.max(F.when(F.col("name") == n, F.col("v")))
    factors = F.filter(F.array(*(one(f"{n}GainFact") for n in ("SensorAdjustment", "Temp", "FNumber"))), lambda f: F.size(f) == 3)
    single = matrices.groupBy("path").agg(
        one("CaptureISO")[0].alias("capture_iso"), one("SensorISO")[0].alias("sensor_iso"), factors.alias("factors"), one("KeepImageArea").alias("keep"), one("ActiveImageArea").alias("active"),
        *(one(n).alias(n) for n in ("ImageDepth", "RawSaturationLevel", "SaturationLevel", "MaxOutputLevel", "DarkShieldTop", "DarkShieldBottom", "DarkShieldColRange")),
    )
    newer = lists.groupBy("path").agg(*(F.max(plain("name") == t).alias(n) for t, n in ((tables[0], "has_gains"), (tables[1], "has_cc"))))
    has = rows.groupBy("path").agg(F.max(F.coalesce(F.col("identifier") == "SECc", F.lit(False))).alias("has_metadata"))
    out = wanted.join(has, "path").join(images.select("path", "columns", "rows", F.col("error").alias("image_error")), "path").join(cal, "path", "left").join(single, "path", "left")
    # a narrow row for each file, written once for the steps after it
    out = written(calibrate(out).join(newer, "path", "left"), "prepared")
    # saturation: the bit depth, else the levels in the engine's order, else twelve bits
    three = lambda c: F.when(F.size(c) == 3, F.col(c))
    is_newer = F.coalesce(F.col("has_gains") & F.col("has_cc"), F.lit(False))
    raw_level, level = three("RawSaturationLevel"), three("SaturationLevel")
    depth = F.when((F.size("ImageDepth") == 1) & (F.col("ImageDepth")[0] < 32), F.array_repeat(F.pow(F.lit(2.0), F.col("ImageDepth")[0]) - 1, 3))
    top = F.coalesce(depth, F.when(is_newer, raw_level), level, raw_level, three("MaxOutputLevel"), F.array_repeat(F.lit(4095.0), 3))
    keep, size = [F.col("keep")[k] for k in range(4)], (F.col("columns"), F.col("rows"))
    rect = lambda corners: to_decoded(corners, keep, size)
    corners = lambda c: rect([F.col(c)[k] for k in range(4)])
    stripe = lambda k: rect([F.col("DarkShieldColRange")[2 * k], keep[1], F.col("DarkShieldColRange")[2 * k + 1], keep[3]])
    at = corners("active")
    area = F.when(at[0].isNotNull(), F.array(at[1], at[0], at[3] + 1, at[2] + 1))
    dark = F.filter(F.array(*(F.array(*r) for r in (corners("DarkShieldTop"), corners("DarkShieldBottom"), stripe(0), stripe(1)))), lambda r: r[0].isNotNull())
    error = F.coalesce("head_error", "image_error", F.when(~F.col("has_metadata"), "no metadata section"), "error")
    out = out.select("path", "wb", "orientation", "columns", "rows", "gain", "color_matrix", "forward_matrix", "neutral", "camera_calibration", "baseline", top.alias("top"), area.alias("area"), dark.alias("dark"), error.alias("error"))
    px = x3f.decode(images).groupBy("path", "y", "x").agg(*(F.max(F.when(F.col("ch") == k, F.col("s"))).alias(f"c{k}") for k in range(3)))
    # black: the mean over all dark rectangles, a pixel counted in each it lies in
    covered = F.size(F.filter("dark", lambda r: F.col("x").between(r[0], r[2]) & F.col("y").between(r[1], r[3])))
    shaded = px.join(out.select("path", "dark"), "path").withColumn("w", covered).where("w > 0")
    black = shaded.groupBy("path").agg(F.array(*(F.sum(F.col(f"c{k}") * F.col("w")) / F.sum("w") for k in range(3))).alias("black"))
    out = out.join(black, "path", "left").withColumn("black", F.coalesce("black", F.array_repeat(F.lit(0.0), 3)))
    return px, out.drop("dark")


def _matrices(spark, sf_dir):
    """Camera data of each vector: newer or older matrices, gains for some."""
    at = lambda lo: F.transform(F.slice("embedding", lo, 9), lambda v, i: v.cast("double") * 0.5 + F.when(i % 4 == 0, 1.0).otherwise(0.0))
    k = F.col("vec_id")
    three = lambda lo: F.transform(F.slice("embedding", lo, 3), lambda v: 1 + v.cast("double") * 0.5)
    return load(spark, sf_dir, "embeddings").select(
        "vec_id", F.when(k % 3 == 0, at(1)).alias("cc"), F.when(k % 7 != 0, at(10)).alias("corr"), at(19).alias("cam"), F.when(k % 2 == 0, three(28)).alias("gains"), F.when(k % 5 == 0, three(31)).alias("gains_d65"),
        F.when(k % 4 == 0, F.array(three(34))).alias("factors"), F.when(k % 6 > 0, (k % 8).cast("double") * 100).alias("capture_iso"), F.lit(100.0).alias("sensor_iso"),
    )


def _dot(a, b, i, j):
    return f"({a[3 * i]} * {b[j]} + {a[3 * i + 1]} * {b[3 + j]} + {a[3 * i + 2]} * {b[6 + j]})"


_NINE = lambda n: [f"{n}[{k + 1}]" for k in range(9)]


def _inverse(m):
    det = f"({m[0]} * ({m[4]} * {m[8]} - {m[5]} * {m[7]}) - {m[1]} * ({m[3]} * {m[8]} - {m[5]} * {m[6]}) + {m[2]} * ({m[3]} * {m[7]} - {m[4]} * {m[6]}))"
    order = [(4, 8, 5, 7), (2, 7, 1, 8), (1, 5, 2, 4), (5, 6, 3, 8), (0, 8, 2, 6), (2, 3, 0, 5), (3, 7, 4, 6), (1, 6, 0, 7), (0, 4, 1, 3)]
    return [f"(({m[a]} * {m[b]} - {m[c]} * {m[d]}) / {det})" for a, b, c, d in order]


def _sql_list(parts):
    return "[" + ", ".join(parts) + "]"


def _from(lo):
    return _sql_list([f"embedding[{lo + k}]::DOUBLE * 0.5 + {1.0 if k % 4 == 0 else 0.0}" for k in range(9)])


def _three(lo):
    return _sql_list([f"1 + embedding[{lo + k}]::DOUBLE * 0.5" for k in range(3)])


_CAL = f"""a AS (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN {_from(1)} END AS cc, CASE WHEN vec_id % 7 <> 0 THEN {_from(10)} END AS corr, {_from(19)} AS cam, CASE WHEN vec_id % 2 = 0 THEN {_three(28)} END AS gains,
  CASE WHEN vec_id % 5 = 0 THEN {_three(31)} END AS d65, CASE WHEN vec_id % 4 = 0 THEN {_three(34)} ELSE [1.0, 1.0, 1.0] END AS f, CASE WHEN vec_id % 6 > 0 THEN vec_id % 8 * 100.0 END AS iso FROM embeddings),
b AS (SELECT *, CASE WHEN corr IS NOT NULL THEN {_sql_list([_dot(_NINE('corr'), _NINE('cam'), i, j) for i in range(3) for j in range(3)])} END AS legacy FROM a),
c AS (SELECT *, CASE WHEN legacy IS NOT NULL THEN {_sql_list([f"({inv[3 * k]} * 0.95047 + {inv[3 * k + 1]} + {inv[3 * k + 2]} * 1.08883)" for inv in [_inverse(_NINE('legacy'))] for k in range(3)])} END AS n FROM b),
d AS (SELECT *, CASE WHEN cc IS NOT NULL THEN {_sql_list([_dot([str(v) for v in C.SRGB_TO_XYZ], _NINE('cc'), i, j) for i in range(3) for j in range(3)])}
  WHEN legacy IS NOT NULL THEN {_sql_list([f'legacy[{3 * i + j + 1}] * n[{j + 1}]' for i in range(3) for j in range(3)])} END AS bmt, coalesce(gains, CASE WHEN n IS NOT NULL THEN [1 / n[1], 1 / n[2], 1 / n[3]] END) AS g0 FROM c),
e AS (SELECT *, CASE WHEN g0 IS NOT NULL THEN [g0[1] * f[1], g0[2] * f[2], g0[3] * f[3]] END AS gain, CASE WHEN d65 IS NOT NULL THEN [d65[1] * f[1], d65[2] * f[2], d65[3] * f[3]] ELSE [1.0, 1.0, 1.0] END AS g65 FROM d)"""


def near(c: Column, places: int = 4) -> Column:
    """A number by its leading places, whatever its size is."""
    size = F.when(F.abs(c) > 0, F.floor(F.log10(F.abs(c)))).otherwise(0)
    return F.round(c / F.pow(F.lit(10.0), size.cast("double")), places)


def _near_sql(c, places: int = 4):
    return f"round({c} / pow(10.0, CASE WHEN abs({c}) > 0 THEN floor(log10(abs({c}))) ELSE 0 END), {places})"


@query(f"WITH {_CAL} SELECT vec_id, {', '.join(f'{_near_sql(f'bmt[{k + 1}]')} AS m{k}' for k in range(9))} FROM e")
def camera_matrix(spark, sf_dir):
    """Camera to XYZ by the newer or the older engine's matrices, by leading places."""
    return camera_to_xyz(_matrices(spark, sf_dir)).select("vec_id", *(near(F.col("bmt")[k]).alias(f"m{k}") for k in range(9)))


@query(
    f"WITH {_CAL} SELECT vec_id, {', '.join(f'{_near_sql(f'1 / gain[{k + 1}]')} AS n{k}, {_near_sql(f'1 / g65[{k + 1}]')} AS c{k}' for k in range(3))}, "
    f"{', '.join(f'{_near_sql(_dot([str(v) for v in D65_TO_D50], _NINE('bmt'), i, i))} AS f{i}' for i in range(3))}, "
    "round(CASE WHEN iso > 0 THEN log2(iso / 100.0) ELSE 0 END, 6) AS baseline, CASE WHEN gain IS NULL THEN 'no white-balance gain' WHEN bmt IS NULL THEN 'no colour matrix' END AS error FROM e"
)
def build_calibration(spark, sf_dir):
    c = calibrate(_matrices(spark, sf_dir))
    return c.select(
        "vec_id", *(near(F.col("neutral")[k]).alias(f"n{k}") for k in range(3)), *(near(F.col("camera_calibration")[k]).alias(f"c{k}") for k in range(3)),
        *(near(F.col("forward_matrix")[4 * i]).alias(f"f{i}") for i in range(3)), F.round("baseline", 6).alias("baseline"), "error",
    )


_DEV_M = ", ".join(f"{_dot([str(v) for v in C.XYZ_TO_SRGB], _NINE('bmt'), i, j)} AS m{3 * i + j}" for i in range(3) for j in range(3))


@query(f"""WITH a AS (SELECT vec_id AS image_id, {_from(1)} AS bmt, {_three(28)} AS g FROM embeddings), k AS (SELECT image_id, g, {_DEV_M} FROM a),
p AS (SELECT c.image_id, y - 1 AS y, x - 2 AS x, g, (c0 - 64.0) / 2497.0 AS a, (c1 - 64.0) / 2497.0 AS b, (c2 - 64.0) / 2497.0 AS c, {', '.join(f'm{k}' for k in range(9))} FROM ({S.COLOUR}) c JOIN k USING (image_id) WHERE y BETWEEN 1 AND 6 AND x BETWEEN 2 AND 5),
v AS (SELECT *, greatest(a, b, c) AS top, greatest(a * g[1], 0.0) AS p, greatest(b * g[2], 0.0) AS q, greatest(c * g[3], 0.0) AS s FROM p),
m AS (SELECT image_id, y, x, least(greatest((top - 0.88) / 0.12, 0.0), 1.0) AS t, {', '.join(f'm{3 * i} * p + m{3 * i + 1} * q + m{3 * i + 2} * s AS {n}' for i, n in enumerate('rgb'))} FROM v)
SELECT image_id, y, x, {', '.join(f'round({c} + t * (greatest(r, g, b) - {c}), 6) AS {c}' for c in 'rgb')} FROM m""")
def develop_raster(spark, sf_dir):
    """Whole rasters developed with the calibration of their own image, on their active area."""
    at = lambda lo: F.transform(F.slice("embedding", lo, 9), lambda v, i: v.cast("double") * 0.5 + F.when(i % 4 == 0, 1.0).otherwise(0.0))
    images = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), at(1).alias("bmt"), F.transform(F.slice("embedding", 28, 3), lambda v: 1 + v.cast("double") * 0.5).alias("gain"))
    images = images.select("image_id", "gain", F.array(*C.inverse3(nine("bmt"))).alias("color_matrix"), F.array_repeat(F.lit(64.0), 3).alias("black"), F.array_repeat(F.lit(64.0 + 2497.0), 3).alias("top"), F.array(*map(F.lit, (1, 2, 7, 6))).alias("area"), F.lit(None).cast("string").alias("error"))
    out = develop(S.colour(spark, sf_dir), images)
    return out.select(*PX, *rounded(tuple(F.col(c) for c in "rgb")))
