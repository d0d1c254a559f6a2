"""Film simulation from published formulas over invented curves."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from rasterlake.plans.registry import query
from rasterlake.sources import surrogates as S

WAVES = [380 + 10 * k for k in range(41)]
#: Multi-lobe Gaussian fit of the 1931 observer (amplitude, centre, widths below and above it).
LOBES = {
    "xbar": ((1.056, 599.8, 37.9, 31.0), (0.362, 442.0, 16.0, 26.7), (-0.065, 501.1, 20.4, 26.2)),
    "ybar": ((0.821, 568.8, 46.9, 40.5), (0.286, 530.9, 16.3, 31.1)),
    "zbar": ((1.217, 437.0, 11.8, 36.0), (0.681, 459.0, 26.0, 13.8)),
}


def lobe(w, a, m, s1, s2):
    t = (w - m) / F.when(w < m, F.lit(s1)).otherwise(F.lit(s2))
    return a * F.exp(-0.5 * t * t)


def observer(w):
    return [sum((lobe(w, *p) for p in ps[1:]), lobe(w, *ps[0])).alias(n) for n, ps in LOBES.items()]


def planck(w, kelvin: float):
    """Radiance over that at 560 nm."""
    c2 = 1.438776877e-2
    at = lambda m: F.pow(m, F.lit(-5.0)) / (F.exp(c2 / (m * kelvin)) - 1)
    return at(w * 1e-9) / (560e-9**-5 / (math.exp(c2 / (560e-9 * kelvin)) - 1))


def _lobe_sql(a, m, s1, s2):
    return f"{a} * exp(-0.5 * pow((w - {m}) / CASE WHEN w < {m} THEN {s1} ELSE {s2} END, 2))"


_W = "(SELECT CAST(380 + 10 * i AS DOUBLE) AS w FROM range(41) t(i))"
_OBS = ", ".join(f"round({' + '.join(_lobe_sql(*p) for p in ps)}, 9) AS {n}" for n, ps in LOBES.items())


def waves(spark):
    return spark.range(41).select((380 + 10 * F.col("id")).cast("double").alias("w"))


@query(f"SELECT w, {_OBS}, round(pow(w * 1e-9, -5) / (exp(1.438776877e-2 / (w * 1e-9 * 5500)) - 1) / (pow(560e-9, -5) / (exp(1.438776877e-2 / (560e-9 * 5500)) - 1)), 9) AS light FROM {_W}")
def cmf_table(spark, sf_dir):
    t = waves(spark).select("w", *observer(F.col("w")), planck(F.col("w"), 5500.0).alias("light"))
    return t.select("w", *(F.round(c, 9).alias(c) for c in ("xbar", "ybar", "zbar", "light")))


SENSITIVITY = ((620.0, 40.0), (545.0, 35.0), (450.0, 30.0))


def spectral_weights() -> list[list[float]]:
    """Layer by channel: a smooth spectrum for each primary against each layer's sensitivity, over 41 wavelengths."""
    return [[sum(math.exp(-(((w - c) / s) ** 2) / 2) * math.exp(-(((w - m) / 50.0) ** 2) / 2) for w in WAVES) / 41 for m in (610.0, 540.0, 460.0)] for c, s in SENSITIVITY]


_SPEC = " + ".join(f"{c} * exp(-0.5 * pow((w - {m}) / 50.0, 2))" for c, m in zip("rgb", (610.0, 540.0, 460.0)))
_EXPOSE = f"SELECT image_id, y, x, " + ", ".join(f"log10(greatest(sum(({_SPEC}) * exp(-0.5 * pow((w - {c}) / {s}, 2))) / 41, 0.0005)) AS e{k}" for k, (c, s) in enumerate(SENSITIVITY)) + f" FROM ({S.LINEAR}), {_W} GROUP BY image_id, y, x"


def exposures(px):
    """Adds e0..e2, the log exposure of each layer. Sums over wavelengths do not depend on the pixel, so they are folded into
    nine weights instead of a join of every pixel with 41 rows."""
    m = spectral_weights()
    return px.withColumns({f"e{k}": F.log10(F.greatest(m[k][0] * F.col("r") + m[k][1] * F.col("g") + m[k][2] * F.col("b"), F.lit(5e-4))) for k in range(3)})


@query(f"SELECT image_id, y, x, round(e0, 7) AS e0, round(e1, 7) AS e1, round(e2, 7) AS e2 FROM ({_EXPOSE})")
def film_expose(spark, sf_dir):
    return exposures(S.linear(spark, sf_dir)).select("image_id", "y", "x", *(F.round(f"e{k}", 7).alias(f"e{k}") for k in range(3)))


def curve(x, low: float = 0.1, high: float = 2.2, slope: float = 1.6):
    """An invented characteristic curve."""
    return low + (high - low) / (1 + F.exp(-slope * (x + 0.6)))


@query(f"SELECT image_id, y, x, round(0.1 + (2.2 - 0.1) / (1 + exp(-1.6 * (e0 + 0.6))), 6) AS d0, round(0.1 + (2.2 - 0.1) / (1 + exp(-1.6 * (e1 + 0.6))), 6) AS d1, round(0.1 + (2.2 - 0.1) / (1 + exp(-1.6 * (e2 + 0.6))), 6) AS d2 FROM ({_EXPOSE})")
def film_density(spark, sf_dir):
    return exposures(S.linear(spark, sf_dir)).select("image_id", "y", "x", *(F.round(curve(F.col(f"e{k}")), 6).alias(f"d{k}") for k in range(3)))


_KNOTS = [(k / 4 - 4, 0.1 + 2.1 / (1 + math.exp(-1.6 * (k / 4 - 4 + 0.6)))) for k in range(33)]


@query(f"""WITH k AS (SELECT i, 0.1 + 2.1 / (1 + exp(-1.6 * (i / 4.0 - 4 + 0.6))) AS d FROM range(33) t(i)), p AS (SELECT image_id, y, x, least(greatest((v * 8 + 4) * 4, 0.0), 32.0) AS u FROM ({S.GRAY})),
q AS (SELECT *, CAST(least(floor(u), 31) AS BIGINT) AS i0 FROM p) SELECT q.image_id, q.y, q.x, round(a.d + (u - i0) * (b.d - a.d), 7) AS d FROM q JOIN k a ON a.i = i0 JOIN k b ON b.i = i0 + 1""")
def curve_lookup(spark, sf_dir):
    """A sampled curve with linear interpolation; its 33 values are a literal array, so a lookup is an index and no join."""
    table = F.array(*(F.lit(d) for _, d in _KNOTS))
    u = F.least(F.greatest((F.col("v") * 8 + 4) * 4, F.lit(0.0)), F.lit(32.0))
    px = S.gray(spark, sf_dir).withColumn("u", u).withColumn("i", F.least(F.floor("u"), F.lit(31)).cast("int"))
    a, b = F.get(table, F.col("i")), F.get(table, F.col("i") + 1)
    return px.select("image_id", "y", "x", F.round(a + (F.col("u") - F.col("i")) * (b - a), 7).alias("d"))


COUPLERS = (0.0, 0.15, 0.05, 0.12, 0.0, 0.12, 0.05, 0.15, 0.0)


def _step_sql(prev, src):
    d = [f"(0.1 + 2.1 / (1 + exp(-1.6 * (x{k} + 0.6))))" for k in range(3)]
    new = [f"e{k} - ({COUPLERS[3 * k]} * {d[0]} + {COUPLERS[3 * k + 1]} * {d[1]} + {COUPLERS[3 * k + 2]} * {d[2]})" for k in range(3)]
    return f"SELECT image_id, y, x, e0, e1, e2, " + ", ".join(f"{n} AS x{k}" for k, n in enumerate(new)) + f" FROM ({src})"


def _newton_sql():
    src = f"SELECT *, e0 AS x0, e1 AS x1, e2 AS x2 FROM ({_EXPOSE})"
    for _ in range(5):
        src = _step_sql("", src)
    return f"SELECT image_id, y, x, round(x0, 6) AS x0, round(x1, 6) AS x1, round(x2, 6) AS x2 FROM ({src})"


@query(_newton_sql())
def coupler_steps5(spark, sf_dir):
    """Five fixed-point steps of coupler inhibition, each its own column so that terms are shared."""
    px = exposures(S.linear(spark, sf_dir)).withColumns({f"x{k}": F.col(f"e{k}") for k in range(3)})
    for _ in range(5):
        px = px.withColumns({f"d{k}": curve(F.col(f"x{k}")) for k in range(3)})
        px = px.withColumns({f"x{k}": F.col(f"e{k}") - sum((COUPLERS[3 * k + j] * F.col(f"d{j}") for j in (1, 2)), COUPLERS[3 * k] * F.col("d0")) for k in range(3)})
    return px.select("image_id", "y", "x", *(F.round(f"x{k}", 6).alias(f"x{k}") for k in range(3)))


@query(f"SELECT image_id, y, x, round(sum(pow(2.0, -(v + 1) * (0.5 + 0.4 * exp(-0.5 * pow((w - 550) / 60, 2)))) * exp(-0.5 * pow((w - 540) / 45, 2))) / 41, 7) AS t FROM ({S.GRAY}), {_W} GROUP BY 1, 2, 3")
def scan_integrate(spark, sf_dir):
    """Light through a density, summed over wavelengths: an array fold inside the row."""
    table = F.array(*(F.struct(F.lit(0.5 + 0.4 * math.exp(-(((w - 550) / 60) ** 2) / 2)).alias("d"), F.lit(math.exp(-(((w - 540) / 45) ** 2) / 2)).alias("s")) for w in WAVES))
    total = F.aggregate(table, F.lit(0.0), lambda acc, t: acc + F.pow(F.lit(2.0), -(F.col("v") + 1) * t["d"]) * t["s"])
    return S.gray(spark, sf_dir).select("image_id", "y", "x", F.round(total / 41, 7).alias("t"))


@query()
def grain_hash(spark, sf_dir):
    """Grain from absolute coordinates and a seed alone: the same whatever the partitions are."""
    h = F.pmod(F.xxhash64("image_id", "y", "x", F.lit(7)), F.lit(1 << 20)) / float(1 << 20)
    return S.gray(spark, sf_dir).select("image_id", "y", "x", F.round(F.least(F.greatest(F.col("v") + 1 + 0.1 * (h - 0.5), F.lit(0.0)), F.lit(2.0)), 6).alias("v"))
