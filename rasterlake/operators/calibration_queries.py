"""Calibration, geometry and finishing rules, one row per image or pixel."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rasterlake.functions import color as C
from rasterlake.operators.color_queries import PX, rgb, rounded
from rasterlake.plans.registry import load, query
from rasterlake.sources import surrogates as S


def matrix(spark, sf_dir):
    """Nine numbers of each vector as a well-conditioned matrix: a diagonal of 1 is added."""
    e = load(spark, sf_dir, "embeddings")
    return e.select("vec_id", *((F.col("embedding")[k].cast("double") * 0.5 + (1.0 if k % 4 == 0 else 0.0)).alias(f"m{k}") for k in range(9)))


_M = "SELECT vec_id, " + ", ".join(f"CAST(embedding[{k + 1}] AS DOUBLE) * 0.5 + {1.0 if k % 4 == 0 else 0.0} AS m{k}" for k in range(9)) + " FROM embeddings"
_DET = "m0 * (m4 * m8 - m5 * m7) - m1 * (m3 * m8 - m5 * m6) + m2 * (m3 * m7 - m4 * m6)"
_INV = ["m4 * m8 - m5 * m7", "m2 * m7 - m1 * m8", "m1 * m5 - m2 * m4", "m5 * m6 - m3 * m8", "m0 * m8 - m2 * m6", "m2 * m3 - m0 * m5", "m3 * m7 - m4 * m6", "m1 * m6 - m0 * m7", "m0 * m4 - m1 * m3"]
_NEUTRAL = "SELECT vec_id, " + ", ".join(f"(({_INV[3 * k]}) * 0.95047 + ({_INV[3 * k + 1]}) + ({_INV[3 * k + 2]}) * 1.08883) / d AS n{k}" for k in range(3)) + f" FROM (SELECT *, {_DET} AS d FROM ({_M}))"


def neutral(images):
    """Adds n0..n2: the raw values of the white point."""
    inv = C.inverse3([F.col(f"m{k}") for k in range(9)])
    return images.withColumns({f"i{k}": c for k, c in enumerate(inv)}).select("vec_id", *(C.dot(C.WHITE, tuple(F.col(f"i{3 * k + j}") for j in range(3))).alias(f"n{k}") for k in range(3)))


@query(f"SELECT vec_id, round(n0, 7) AS n0, round(n1, 7) AS n1, round(n2, 7) AS n2 FROM ({_NEUTRAL})")
def raw_neutral(spark, sf_dir):
    return neutral(matrix(spark, sf_dir)).select("vec_id", *(F.round(f"n{k}", 7).alias(f"n{k}") for k in range(3)))


@query(f"SELECT e.vec_id, " + ", ".join(f"round(coalesce(CASE WHEN label = 1 THEN 1.5 WHEN label = 2 THEN 2.5 END, 1 / n{k}) * CASE WHEN label % 2 = 0 THEN 1.1 ELSE 1 END, 7) AS g{k}" for k in range(3)) + f" FROM ({_NEUTRAL}) n JOIN embeddings e USING (vec_id)")
def wb_gain(spark, sf_dir):
    """A tabled gain, else the reciprocal of the neutral; times an optional factor."""
    label = load(spark, sf_dir, "embeddings").select("vec_id", "label")
    tabled = F.when(F.col("label") == 1, 1.5).when(F.col("label") == 2, 2.5)
    factor = F.when(F.col("label") % 2 == 0, 1.1).otherwise(1.0)
    return neutral(matrix(spark, sf_dir)).join(label, "vec_id").select("vec_id", *(F.round(F.coalesce(tabled, 1 / F.col(f"n{k}")) * factor, 7).alias(f"g{k}") for k in range(3)))


@query("SELECT p_partkey, CASE WHEN depth < 32 THEN CAST(pow(2, depth) - 1 AS BIGINT) ELSE coalesce(raw_level, level, 4095) END AS top, round(log2(p_retailprice / 100), 6) AS baseline FROM (SELECT *, CASE WHEN p_size % 3 = 0 THEN p_size END AS depth, CASE WHEN p_size % 3 = 1 AND p_size > 25 THEN p_size * 100 END AS raw_level, CASE WHEN p_size % 3 = 1 THEN p_size * 80 END AS level FROM part)")
def saturation_level(spark, sf_dir):
    """Bit depth where it is plausible, else the first level there is, else 4095; and the baseline exposure."""
    size = F.col("p_size")
    depth, third = F.when(size % 3 == 0, size), size % 3 == 1
    top = F.when(depth < 32, F.pow(F.lit(2.0), depth).cast("long") - 1).otherwise(F.coalesce(F.when(third & (size > 25), size * 100), F.when(third, size * 80), F.lit(4095)).cast("long"))
    return load(spark, sf_dir, "part").select("p_partkey", top.alias("top"), F.round(F.log2(F.col("p_retailprice") / 100), 6).alias("baseline"))


def to_decoded(rect, keep, size):
    """A rectangle (left, top, right, bottom; ends included) in the pixels of the decoded image: cut to the kept area, shifted, rescaled by integer
    division and held inside; null where it is empty or the kept area is malformed."""
    x0, y0, x1, y1 = (F.greatest(r, k) if i < 2 else F.least(r, k) for i, (r, k) in enumerate(zip(rect, keep)))
    ok = (keep[2] >= keep[0]) & (keep[3] >= keep[1]) & (x0 <= x1) & (y0 <= y1)
    for r in rect:  # greatest and least pass over nulls
        ok = ok & r.isNotNull()
    scaled = lambda v, i: F.when(ok, F.least(F.floor((v - keep[i]) * size[i] / (keep[2 + i] - keep[i] + 1)), size[i] - 1))
    return scaled(x0, 0), scaled(y0, 1), scaled(x1, 0), scaled(y1, 1)


@query("""SELECT p_partkey, CAST(CASE WHEN ok THEN least(floor((l - 8) * 640 / 40), 639) END AS BIGINT) AS left_px, CAST(CASE WHEN ok THEN least(floor((t - 4) * 480 / kh), 479) END AS BIGINT) AS top_px,
CAST(CASE WHEN ok THEN least(floor((r - 8) * 640 / 40), 639) END AS BIGINT) AS right_px, CAST(CASE WHEN ok THEN least(floor((b - 4) * 480 / kh), 479) END AS BIGINT) AS bottom_px
FROM (SELECT *, l <= r AND t <= b AND kh > 0 AS ok FROM (SELECT p_partkey, greatest(p_size, 8) AS l, least(p_size + p_partkey % 30 - 10, 47) AS r, greatest(p_size // 2, 4) AS t, least(p_size // 2 + p_partkey % 9, 3 + p_partkey % 31) AS b, p_partkey % 31 AS kh FROM part))""")
def rect_transform(spark, sf_dir):
    p, k = F.col("p_size"), F.col("p_partkey")
    half = F.floor(p / 2)
    rect = to_decoded((p, half, p + k % 30 - 10, half + k % 9), (F.lit(8), F.lit(4), F.lit(47), 3 + k % 31), (F.lit(640), F.lit(480)))
    return load(spark, sf_dir, "part").select("p_partkey", *(c.cast("long").alias(n) for c, n in zip(rect, ("left_px", "top_px", "right_px", "bottom_px"))))


@query("SELECT p_partkey, CAST(ceil(max(abs(r * (1 + k1 * r * r + k2 * r * r * r * r) - r)) * 100) + 2 AS BIGINT) AS margin FROM (SELECT p_partkey, i / 16.0 AS r, p_size / 500.0 AS k1, -p_size / 900.0 AS k2 FROM part, range(1, 17) t(i)) GROUP BY 1")
def roi_margin(spark, sf_dir):
    """Largest shift of a radial polynomial over 16 radii, as whole pixels and a guard of 2: an array fold, no explode."""
    k1, k2 = F.col("p_size") / 500.0, -F.col("p_size") / 900.0
    shift = F.transform(F.sequence(F.lit(1), F.lit(16)), lambda i: F.abs(i / 16.0 * (1 + k1 * (i / 16.0) * (i / 16.0) + k2 * (i / 16.0) * (i / 16.0) * (i / 16.0) * (i / 16.0)) - i / 16.0))
    return load(spark, sf_dir, "part").select("p_partkey", (F.ceil(F.array_max(shift) * 100) + 2).cast("long").alias("margin"))


@query(f"SELECT image_id, y, x, round(v / greatest(1 - 0.09 * r2 + 0.001 * r2 * r2, 0.25), 7) AS v FROM (SELECT *, ((y - 3.5) * (y - 3.5) + (x - 3.5) * (x - 3.5)) / 2 AS r2 FROM ({S.GRAY}))")
def vignette_gain(spark, sf_dir):
    dy, dx = F.col("y") - 3.5, F.col("x") - 3.5
    px = S.gray(spark, sf_dir).withColumn("r2", (dy * dy + dx * dx) / 2)
    return px.select(*PX, F.round(F.col("v") / F.greatest(1 - 0.09 * F.col("r2") + 0.001 * F.col("r2") * F.col("r2"), F.lit(0.25)), 7).alias("v"))


@query("SELECT s_suppkey, film, CASE WHEN film BETWEEN 0 AND 19 THEN film % 4 = 0 END AS positive, CAST(CASE WHEN film BETWEEN 0 AND 19 AND film % 4 = 0 THEN 0.09 ELSE 0.25 END AS DOUBLE) AS couplers, CASE WHEN film BETWEEN 0 AND 19 AND film % 4 > 0 THEN n_name END AS paper FROM (SELECT s_suppkey, s_suppkey % 25 AS film FROM supplier) LEFT JOIN nation ON n_nationkey = film")
def film_selection(spark, sf_dir):
    """What choosing a film implies; an index out of range changes nothing."""
    s = load(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 25).alias("film"))
    n = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("film"), "n_name")
    ok, positive = F.col("film").between(0, 19), F.col("film") % 4 == 0
    return s.join(F.broadcast(n), "film", "left").select(
        "s_suppkey", "film", F.when(ok, positive).alias("positive"), F.round(F.when(ok & positive, 0.25 * 0.36).otherwise(0.25), 6).alias("couplers"), F.when(ok & ~positive, F.col("n_name")).alias("paper")
    )


def _finish_sql(c):
    enc = f"CASE WHEN {c} <= 0.0031308 THEN 12.92 * {c} ELSE 1.055 * pow({c}, {1 / 2.4!r}) - 0.055 END"
    con = f"(({enc}) - 0.5) * 1.2 + 0.5"
    return f"round(least(greatest(CASE WHEN ({con}) <= 0.04045 THEN ({con}) / 12.92 ELSE pow((({con}) + 0.055) / 1.055, 2.4) END, -0.6), 1.0), 7) AS {c}"


@query(f"SELECT image_id, y, x, {', '.join(_finish_sql(c) for c in 'rgb')} FROM ({S.LINEAR})")
def finish_chain(spark, sf_dir):
    """Encode, contrast around the middle, back to linear light, clamp: each step a column, so that nothing is computed twice."""
    px = S.linear(spark, sf_dir)
    enc = lambda v: F.when(v <= 0.0031308, 12.92 * v).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)
    px = px.withColumns({c: (enc(F.col(c)) - 0.5) * 1.2 + 0.5 for c in "rgb"})
    dec = lambda v: F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))
    return px.select(*PX, *rounded(C.sdr_clamp(tuple(dec(c) for c in rgb())), places=7))


@query(f"WITH p AS ({S.GRAY}) SELECT f.image_id, round(max(CASE WHEN isnan(f.v - t.v) THEN 'Infinity'::DOUBLE ELSE abs(f.v - t.v) END), 7) AS worst, count(*) AS n FROM p f JOIN (SELECT image_id, y - 2 AS y, x - 3 AS x, v * 1.01 AS v FROM p WHERE y BETWEEN 2 AND 5 AND x BETWEEN 3 AND 6) t ON t.image_id = f.image_id AND t.y + 2 = f.y AND t.x + 3 = f.x GROUP BY 1")
def tile_vs_full(spark, sf_dir):
    """A tile against the whole by shifted coordinates; NaN counts as infinite."""
    from rasterlake.operators.ordered_queries import crop

    full = S.gray(spark, sf_dir)
    tile = crop(full, 0.25, 0.375, 0.5, 0.5, S.SIDE, S.SIDE).select("image_id", (F.col("y") + 2).alias("y"), (F.col("x") + 3).alias("x"), (F.col("v") * 1.01).alias("t"))
    d = F.abs(F.col("v") - F.col("t"))
    return full.join(tile, ["image_id", "y", "x"]).groupBy("image_id").agg(F.round(F.max(F.when(F.isnan(d), float("inf")).otherwise(d)), 7).alias("worst"), F.count(F.lit(1)).alias("n"))


@query(f"WITH p AS (SELECT *, v * 0.8 + 0.1 AS o FROM ({S.GRAY})) SELECT image_id, y, x, round(o + avg(v) OVER (PARTITION BY image_id, y // 4, x // 4) - avg(o) OVER (PARTITION BY image_id, y // 4, x // 4), 7) AS v FROM p")
def dc_match(spark, sf_dir):
    """A model's output moved to the mean of its input, tile by tile."""
    tile = Window.partitionBy("image_id", F.floor(F.col("y") / 4), F.floor(F.col("x") / 4))
    px = S.gray(spark, sf_dir).withColumn("o", F.col("v") * 0.8 + 0.1)
    return px.select(*PX, F.round(F.col("o") + F.avg("v").over(tile) - F.avg("o").over(tile), 7).alias("v"))


@query("SELECT p_partkey, CAST(greatest(round(w * s), 1) AS BIGINT) AS w, CAST(greatest(round(h * s), 1) AS BIGINT) AS h FROM (SELECT *, least(1280 / greatest(w, h), 1.0) AS s FROM (SELECT p_partkey, p_size * 101.0 AS w, p_retailprice AS h FROM part))")
def fitted_size(spark, sf_dir):
    w, h = F.col("p_size") * 101.0, F.col("p_retailprice")
    s = F.least(1280 / F.greatest(w, h), F.lit(1.0))
    return load(spark, sf_dir, "part").select("p_partkey", *(F.greatest(F.round(v * s), F.lit(1)).cast("long").alias(n) for n, v in (("w", w), ("h", h))))


@query("SELECT o_orderkey, o_orderstatus = 'F' AS ok, CASE WHEN o_orderstatus <> 'F' THEN 'not done: ' || o_orderstatus END AS error, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3")
def job_results(spark, sf_dir):
    """Jobs with their results, a status in every row; results are counted before the join."""
    done = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    ok = F.col("o_orderstatus") == "F"
    return load(spark, sf_dir, "orders").join(done, "o_orderkey", "left").select("o_orderkey", ok.alias("ok"), F.when(~ok, F.concat(F.lit("not done: "), "o_orderstatus")).alias("error"), F.coalesce("n", F.lit(0)).alias("n"))
