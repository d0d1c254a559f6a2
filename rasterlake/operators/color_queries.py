"""Colour queries over the surrogate rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterlake.functions import color as C
from rasterlake.plans.registry import query
from rasterlake.sources import surrogates as S

PX = ("image_id", "y", "x")


def rgb(prefix: str = ""):
    return tuple(F.col(prefix + c) for c in "rgb")


def rounded(px, names="rgb", places: int = 6):
    return [F.round(c, places).alias(n) for c, n in zip(px, names)]


def sql_mix(m, px="rgb"):
    return [f"({m[3 * k]} * {px[0]} + {m[3 * k + 1]} * {px[1]} + {m[3 * k + 2]} * {px[2]})" for k in range(3)]


@query(f"SELECT image_id, y, x, CAST(round(least(greatest((s - 200.0) / greatest(3600.0 - 200.0, 1.0), 0.0), 1.0) * 65535) AS BIGINT) AS n FROM ({S.RAW12})")
def normalise_raw(spark, sf_dir):
    return S.raw12(spark, sf_dir).select(*PX, C.normalise(F.col("s"), F.lit(200.0), F.lit(3600.0)).cast("long").alias("n"))


@query(f"""WITH n AS (SELECT image_id, y, x, (c0 - 64.0) / 2497.0 AS a, (c1 - 64.0) / 2497.0 AS b, (c2 - 64.0) / 2497.0 AS c FROM ({S.COLOUR})),
v AS (SELECT *, greatest(a, b, c) AS top, greatest(a, 0.0) AS p, greatest(b, 0.0) AS q, greatest(c, 0.0) AS s FROM n),
m AS (SELECT image_id, y, x, least(greatest((top - 0.88) / 0.12, 0.0), 1.0) AS t, {', '.join(f'{e} AS {n}' for e, n in zip(sql_mix(C.XYZ_TO_SRGB, 'pqs'), 'rgb'))} FROM v)
SELECT image_id, y, x, round(r + t * (greatest(r, g, b) - r), 7) AS r, round(g + t * (greatest(r, g, b) - g), 7) AS g, round(b + t * (greatest(r, g, b) - b), 7) AS b FROM m""")
def develop_pixel(spark, sf_dir):
    px = tuple(F.col(f"c{k}") for k in range(3))
    return S.colour(spark, sf_dir).select(*PX, *rounded(C.develop(px, 64.0, 1 / 2497.0, C.XYZ_TO_SRGB), places=7))


@query(f"SELECT image_id, y, x, {', '.join(f'CAST(round(CASE WHEN {c} <= 0.0031308 THEN 12.92 * {c} ELSE 1.055 * pow({c}, 1 / 2.4) - 0.055 END * 255) AS INT) AS {c}' for c in 'rgb')} FROM ({S.LINEAR})")
def srgb_encode(spark, sf_dir):
    return S.linear(spark, sf_dir).select(*PX, *(C.srgb_encode(F.col(c)).cast("int").alias(c) for c in "rgb"))


@query(f"SELECT image_id, y, x, round(0.2126 * r + 0.7152 * g + 0.0722 * b, 6) AS v FROM ({S.LINEAR})")
def mono_mix(spark, sf_dir):
    return S.linear(spark, sf_dir).select(*PX, F.round(C.dot(C.LUMA, rgb()), 6).alias("v"))


@query(f"""WITH u AS (SELECT *, least(greatest((sqrt(least(greatest(0.2126 * r + 0.7152 * g + 0.0722 * b, 0.0), 1.0)) - 0.5) / 0.5, 0.0), 1.0) AS u FROM ({S.LINEAR})),
k AS (SELECT *, pow(2.0, 1.5 * u * u * (3 - 2 * u)) AS k FROM u) SELECT image_id, y, x, round(r * k, 6) AS r, round(g * k, 6) AS g, round(b * k, 6) AS b FROM k""")
def hdr_gain(spark, sf_dir):
    return S.linear(spark, sf_dir).select(*PX, *rounded(C.hdr_extend(rgb(), 1.5)))


@query(f"SELECT image_id, y, x, {', '.join(f'round(least(greatest({c} * 4 - 1.5, -0.6), 1.0), 6) AS {c}' for c in 'rgb')} FROM ({S.LINEAR})")
def sdr_clamp(spark, sf_dir):
    return S.linear(spark, sf_dir).select(*PX, *rounded(C.sdr_clamp(tuple(c * 4 - 1.5 for c in rgb()))))


LAB_SQL = f"""SELECT image_id, y, x, 116 * fy - 16 AS l, 500 * (fx - fy) AS a, 200 * (fy - fz) AS bb FROM (
SELECT image_id, y, x, {', '.join(f'CASE WHEN {c} > 0.008856 THEN cbrt({c}) ELSE 7.787 * {c} + {16 / 116} END AS f{c[-1]}' for c in ('tx', 'ty', 'tz'))} FROM (
SELECT image_id, y, x, {', '.join(f'{e} / {w} AS {n}' for e, w, n in zip(sql_mix(C.SRGB_TO_XYZ), C.WHITE, ('tx', 'ty', 'tz')))} FROM ({S.LINEAR})))"""


@query(f"SELECT image_id, y, x, round(l, 6) AS l, round(a, 6) AS a, round(bb, 6) AS b FROM ({LAB_SQL})")
def lab_convert(spark, sf_dir):
    return S.linear(spark, sf_dir).select(*PX, *rounded(C.lab(rgb()), ("l", "a", "b")))


def _de_sql(source: str) -> str:
    """CIEDE2000 over columns l1 a1 b1 l2 a2 b2, step by step."""
    return f"""
WITH s0 AS ({source}), s1 AS (SELECT *, pow((sqrt(a1 * a1 + b1 * b1) + sqrt(a2 * a2 + b2 * b2)) / 2, 7) AS c7 FROM s0),
s2 AS (SELECT *, a1 * (1.5 - 0.5 * sqrt(c7 / (c7 + pow(25.0, 7)))) AS p1, a2 * (1.5 - 0.5 * sqrt(c7 / (c7 + pow(25.0, 7)))) AS p2 FROM s1),
s3 AS (SELECT *, sqrt(p1 * p1 + b1 * b1) AS c1, sqrt(p2 * p2 + b2 * b2) AS c2,
  CASE WHEN p1 = 0 AND b1 = 0 THEN 0 WHEN atan2(b1, p1) < 0 THEN degrees(atan2(b1, p1)) + 360 ELSE degrees(atan2(b1, p1)) END AS h1,
  CASE WHEN p2 = 0 AND b2 = 0 THEN 0 WHEN atan2(b2, p2) < 0 THEN degrees(atan2(b2, p2)) + 360 ELSE degrees(atan2(b2, p2)) END AS h2 FROM s2),
s4 AS (SELECT *, (l1 + l2) / 2 AS l, (c1 + c2) / 2 AS c, CASE WHEN c1 * c2 = 0 THEN 0 WHEN abs(h2 - h1) <= 180 THEN h2 - h1 WHEN h2 - h1 > 180 THEN h2 - h1 - 360 ELSE h2 - h1 + 360 END AS dh,
  CASE WHEN c1 * c2 = 0 THEN h1 + h2 WHEN abs(h2 - h1) <= 180 THEN (h1 + h2) / 2 WHEN h1 + h2 < 360 THEN (h1 + h2 + 360) / 2 ELSE (h1 + h2 - 360) / 2 END AS h FROM s3),
s5 AS (SELECT *, 1 - 0.17 * cos(radians(h - 30)) + 0.24 * cos(radians(2 * h)) + 0.32 * cos(radians(3 * h + 6)) - 0.20 * cos(radians(4 * h - 63)) AS t, 2 * sqrt(c1 * c2) * sin(radians(dh) / 2) AS bh FROM s4),
s6 AS (SELECT *, (l2 - l1) / (1 + 0.015 * (l - 50) * (l - 50) / sqrt(20 + (l - 50) * (l - 50))) AS u, (c2 - c1) / (1 + 0.045 * c) AS v, bh / (1 + 0.015 * c * t) AS w,
  -2 * sqrt(pow(c, 7) / (pow(c, 7) + pow(25.0, 7))) * sin(radians(60 * exp(-((h - 275) / 25) * ((h - 275) / 25)))) AS rt FROM s5),
de AS (SELECT *, sqrt(greatest(u * u + v * v + w * w + rt * v * w, 0.0)) AS de FROM s6)"""


_PAIR_SQL = f"WITH lab AS ({LAB_SQL}) SELECT p.image_id, p.y, p.x, p.l AS l1, p.a AS a1, p.bb AS b1, q.l AS l2, q.a AS a2, q.bb AS b2 FROM lab p JOIN lab q ON p.image_id = q.image_id AND p.y = q.y AND q.x = (p.x + 1) % 8"


def lab_pairs(spark, sf_dir):
    """Each pixel with its right neighbour (cyclic) in L*a*b*: neighbours are of one image, so arrays shift without a join."""
    px = S.linear(spark, sf_dir).select(*PX, F.struct(*(c.alias(n) for c, n in zip(C.lab(rgb()), "lab"))).alias("p"))
    row = px.groupBy("image_id", "y").agg(F.array_sort(F.collect_list(F.struct("x", "p"))).alias("r"))
    both = row.select("image_id", "y", F.explode(F.transform("r", lambda t, i: F.struct(t["x"].alias("x"), t["p"].alias("p"), F.get("r", (i + 1) % F.size("r"))["p"].alias("q")))).alias("t"))
    return both.select("image_id", "y", "t.x", *(F.col(f"t.{s}.{n}").alias(f"{n}{k}") for k, s in ((1, "p"), (2, "q")) for n in "lab"))


@query(_de_sql(_PAIR_SQL) + " SELECT image_id, y, x, round(de, 5) AS de FROM de")
def delta_e2000(spark, sf_dir):
    return C.delta_e2000(lab_pairs(spark, sf_dir)).select(*PX, F.round("de", 5).alias("de"))


@query(_de_sql(_PAIR_SQL) + " SELECT image_id, round(avg(de), 5) AS mean_de, round(sqrt(avg(de * de)), 5) AS rms_de, round(max(de), 5) AS max_de, round(avg(l1 - l2), 5) AS dl, round(avg(a1 - a2), 5) AS da, round(avg(b1 - b2), 5) AS db FROM de GROUP BY image_id")
def image_diff_stats(spark, sf_dir):
    d = C.delta_e2000(lab_pairs(spark, sf_dir))
    delta = lambda c: F.round(F.avg(F.col(f"{c}1") - F.col(f"{c}2")), 5).alias(f"d{c}")
    return d.groupBy("image_id").agg(F.round(F.avg("de"), 5).alias("mean_de"), F.round(F.sqrt(F.avg(F.col("de") * F.col("de"))), 5).alias("rms_de"), F.round(F.max("de"), 5).alias("max_de"), *map(delta, "lab"))


@query(f"SELECT image_id, y, x, {', '.join(f'round({e}, 6) AS {n}' for e, n in zip(sql_mix(C.REC709_TO_REC2020), 'rgb'))} FROM ({S.LINEAR})")
def wide_gamut(spark, sf_dir):
    return S.linear(spark, sf_dir).select(*PX, *rounded(C.mix(C.REC709_TO_REC2020, rgb())))


def _spaces_sql():
    wide = sql_mix(C.REC709_TO_REC2020)
    names = {"xyz": C.REC2020_TO_XYZ, "back": C.REC2020_TO_REC709}
    px = f"(SELECT image_id, y, x, {', '.join(f'{e} AS {c}' for e, c in zip(wide, 'rgb'))} FROM ({S.LINEAR}))"
    first = ", ".join(f"{e} AS {n}_{c}" for n, m in names.items() for e, c in zip(sql_mix(m), "rgb"))
    home = ", ".join(f"round({e}, 6) AS home_{c}" for e, c in zip(sql_mix(C.XYZ_TO_REC2020, ["xyz_r", "xyz_g", "xyz_b"]), "rgb"))
    return f"SELECT image_id, y, x, {', '.join(f'round({n}_{c}, 6) AS {n}_{c}' for n in names for c in 'rgb')}, {home} FROM (SELECT image_id, y, x, {first} FROM {px})"


@query(_spaces_sql())
def colour_spaces(spark, sf_dir):
    """Wide-gamut pixels to XYZ, to the narrow gamut, and from XYZ home again: one projection."""
    wide = C.mix(C.REC709_TO_REC2020, rgb())
    xyz = C.mix(C.REC2020_TO_XYZ, wide)
    sets = {"xyz": xyz, "back": C.mix(C.REC2020_TO_REC709, wide), "home": C.mix(C.XYZ_TO_REC2020, xyz)}
    return S.linear(spark, sf_dir).select(*PX, *(F.round(v, 6).alias(f"{n}_{c}") for n, m in sets.items() for v, c in zip(m, "rgb")))


def _toe_sql(v):
    out = f"CASE WHEN {v} <= 0 THEN 0.0"
    for (x0, y0), (x1, y1) in zip(C.TOE, C.TOE[1:]):
        out += f" WHEN {v} <= {x1} THEN {y0} + ({v} - {x0}) * {(y1 - y0) / (x1 - x0)}"
    return f"round({out} ELSE 0.99 END, 6)"


@query(f"SELECT image_id, y, x, {', '.join(f'{_toe_sql(c)} AS {c}' for c in 'rgb')} FROM ({S.LINEAR})")
def filmic_toe(spark, sf_dir):
    return S.linear(spark, sf_dir).select(*PX, *rounded([C.piecewise(c, C.TOE) for c in rgb()]))


@query(f"SELECT image_id, y, x, round((v + 1) * pow(2.0, 0.75), 6) AS v FROM ({S.GRAY})")
def exposure_apply(spark, sf_dir):
    return S.gray(spark, sf_dir).select(*PX, F.round((F.col("v") + 1) * F.pow(F.lit(2.0), F.lit(0.75)), 6).alias("v"))


@query(f"SELECT image_id, y, x, CASE WHEN w IS NULL OR isnan(w) THEN 0.0 ELSE least(greatest(w, -16384.0), 16384.0) END AS v FROM (SELECT image_id, y, x, CASE WHEN x = 0 THEN 'NaN'::DOUBLE WHEN x = 1 THEN 'Infinity'::DOUBLE WHEN x = 2 THEN '-Infinity'::DOUBLE ELSE round(v * 60000, 4) END AS w FROM ({S.GRAY}))")
def sanitise_pixels(spark, sf_dir):
    odd = F.when(F.col("x") == 0, float("nan")).when(F.col("x") == 1, float("inf")).when(F.col("x") == 2, float("-inf")).otherwise(F.round(F.col("v") * 60000, 4))
    return S.gray(spark, sf_dir).select(*PX, C.sanitise(odd).alias("v"))


@query(f"SELECT image_id, y, x, round(v * greatest(1 - t * t / greatest(v * v, 1e-20), 0.0), 8) AS v FROM (SELECT *, 1.2 * sqrt(greatest(0.0004 + 0.01 * greatest(v, 0.0), 1e-12)) AS t FROM ({S.GRAY}))")
def garrote_shrink(spark, sf_dir):
    return S.gray(spark, sf_dir).select(*PX, F.round(C.garrote(F.col("v"), 1.2 * C.noise_sigma(F.col("v"), 0.0004, 0.01)), 8).alias("v"))


@query(f"SELECT image_id, y, x, round(0.5 + 0.5 * v * pow(1 + pow(abs(v), 4.5), {-2 / 9}), 8) AS v FROM (SELECT image_id, y, x, v * 4 AS v FROM ({S.GRAY}))")
def contrast_sigmoid(spark, sf_dir):
    return S.gray(spark, sf_dir).select(*PX, F.round(C.contrast(F.col("v") * 4), 8).alias("v"))


@query(f"SELECT image_id, y, x, round(0.5 * pow(1 + pow(abs(v), 4.5), {-11 / 9}), 8) AS v FROM (SELECT image_id, y, x, v * 4 AS v FROM ({S.GRAY}))")
def contrast_slope(spark, sf_dir):
    """Derivative of the contrast curve."""
    return S.gray(spark, sf_dir).select(*PX, F.round(C.contrast_slope(F.col("v") * 4), 8).alias("v"))


def _inverse_sql():
    m = [f"m[{k + 1}]" for k in range(9)]
    minor = lambda a, b, c, d: f"({m[a]} * {m[b]} - {m[c]} * {m[d]}) / det"
    order = [(4, 8, 5, 7), (2, 7, 1, 8), (1, 5, 2, 4), (5, 6, 3, 8), (0, 8, 2, 6), (2, 3, 0, 5), (3, 7, 4, 6), (1, 6, 0, 7), (0, 4, 1, 3)]
    det = f"{m[0]} * ({m[4]} * {m[8]} - {m[5]} * {m[7]}) - {m[1]} * ({m[3]} * {m[8]} - {m[5]} * {m[6]}) + {m[2]} * ({m[3]} * {m[7]} - {m[4]} * {m[6]})"
    rows = "SELECT vec_id, list_transform(embedding[1:9], lambda v: v::DOUBLE) AS m FROM embeddings UNION ALL SELECT -1, [1.0, 2.0, 3.0, 2.0, 4.0, 6.0, 0.0, 1.0, 1.0]::DOUBLE[]"
    top = "greatest(" + ", ".join(f"abs(i{k})" for k in range(9)) + ")"
    inverse = f"SELECT vec_id, {', '.join(f'{minor(*o)} AS i{k}' for k, o in enumerate(order))} FROM (SELECT *, CASE WHEN d = 0 THEN 1.0 ELSE d END AS det FROM (SELECT *, {det} AS d FROM ({rows})))"
    return f"SELECT vec_id, {', '.join(f'round(CASE WHEN top = 0 THEN 0 ELSE i{k} / top END, 6) AS m{k}' for k in range(9))}, round(CASE WHEN top > 0 THEN log10(top) END, 6) AS magnitude FROM (SELECT *, {top} AS top FROM ({inverse}))"


@query(_inverse_sql())
def matrix_inverse(spark, sf_dir):
    """The inverse of every matrix over its largest entry, and that entry's decimal logarithm; one exactly singular matrix is put beside them, its determinant counts as 1."""
    from rasterlake.plans.registry import load

    rows = load(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 9), lambda v: v.cast("double")).alias("m"))
    rows = rows.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("vec_id"), F.array(*map(F.lit, (1.0, 2.0, 3.0, 2.0, 4.0, 6.0, 0.0, 1.0, 1.0))).alias("m")))
    out = rows.select("vec_id", *(c.alias(f"i{k}") for k, c in enumerate(C.inverse3([F.col("m")[k] for k in range(9)]))))
    out = out.withColumn("top", F.greatest(*(F.abs(f"i{k}") for k in range(9))))
    return out.select("vec_id", *(F.round(F.when(F.col("top") == 0, 0.0).otherwise(F.col(f"i{k}") / F.col("top")), 6).alias(f"m{k}") for k in range(9)), F.round(F.when(F.col("top") > 0, F.log10("top")), 6).alias("magnitude"))


@query(f"SELECT image_id, 7 - x AS y, y AS x, round(v, 6) AS v FROM (SELECT image_id, x AS y0, y AS x0, x, y, v FROM ({S.GRAY}))".replace("7 - x AS y, y AS x", "x AS y, 7 - y AS x"))
def rotate_quarter(spark, sf_dir):
    return rotate(S.gray(spark, sf_dir), 1, S.SIDE, S.SIDE).select(*PX, F.round("v", 6).alias("v"))


def rotate(px, turns: int, height: int, width: int):
    """Quarter turns clockwise; negative turns count the other way."""
    turns = turns % 4
    y, x = F.col("y"), F.col("x")
    new = {0: (y, x), 1: (x, height - 1 - y), 2: (height - 1 - y, width - 1 - x), 3: (width - 1 - x, y)}[turns]
    return px.withColumns({"y": new[0], "x": new[1]})
