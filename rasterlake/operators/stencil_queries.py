"""Stencils, blurs, warps, tiles and image transforms."""

from __future__ import annotations

from functools import reduce
from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rasterlake.plans.registry import query
from rasterlake.sources import surrogates as S

#: The B3 spline taps, and the noise left per level of the undecimated transform.
B3 = (1 / 16, 4 / 16, 6 / 16, 4 / 16, 1 / 16)
LEVEL_NORMS = (0.8907, 0.2007, 0.0855, 0.0412, 0.0203)


def rows_as_arrays(px: DataFrame, value: str = "v") -> DataFrame:
    """``(image_id, rows)``: rows is an array of arrays. One shuffle of pixels; every stencil then
    works inside a row without another one. Large rasters come as tiles with a halo, so an array stays small."""
    line = px.groupBy("image_id", "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", value))), lambda t: t[value]).alias("r"))
    return line.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "r"))), lambda t: t["r"]).alias("rows"))


def as_pixels(images: DataFrame, value: str = "v") -> DataFrame:
    line = images.select("image_id", F.posexplode("rows").alias("y", "r"))
    return line.select("image_id", "y", F.posexplode("r").alias("x", value))


def _tap(row, i, d, n):
    return F.get(row, F.least(F.greatest(i + d, F.lit(0)), n - 1))


def convolve(images: DataFrame, taps: tuple[float, ...], step: int = 1, rows: str = "rows", out: str | None = None) -> DataFrame:
    """Separable odd-length kernel, taps ``step`` apart, edges clamped: along rows, then along columns. Adds the column ``out`` (rows by default)."""
    half = len(taps) // 2

    def weighted(get):
        total = get(0, taps[0])
        for k, t in enumerate(taps[1:], 1):
            total = F.zip_with(total, get(k, t), lambda a, b: a + b)
        return total

    def one_row(r):
        def at(_, i):
            return sum((t * _tap(r, i, (k - half) * step, F.size(r)) for k, t in enumerate(taps[1:], 1)), taps[0] * _tap(r, i, -half * step, F.size(r)))

        return F.transform(r, at)

    across = images.withColumn("_across", F.transform(rows, one_row))
    line = lambda y, k, t: F.transform(_tap(F.col("_across"), y, (k - half) * step, F.size("_across")), lambda v: v * t)
    down = F.transform("_across", lambda _, y: weighted(lambda k, t: line(y, k, t)))
    return across.withColumn(out or rows, down).drop("_across")


def _blur_sql(source: str, taps, step: int = 1) -> str:
    """The same as joins on clamped coordinates, for the checks."""
    half = len(taps) // 2
    k = ", ".join(f"({(i - half) * step}, {t!r})" for i, t in enumerate(taps))
    return f"""(SELECT c.image_id, c.y, c.x, sum(n.v * kx.w * ky.w) AS v FROM ({source}) c, (VALUES {k}) kx(d, w), (VALUES {k}) ky(d, w), ({source}) n
WHERE n.image_id = c.image_id AND n.y = least(greatest(c.y + ky.d, 0), 7) AND n.x = least(greatest(c.x + kx.d, 0), 7) GROUP BY 1, 2, 3)"""


GAUSS = (0.06136, 0.24477, 0.38774, 0.24477, 0.06136)


@query(f"SELECT image_id, y, x, round(v, 7) AS v FROM {_blur_sql(S.GRAY, GAUSS)}")
def gauss_separable(spark, sf_dir):
    return as_pixels(convolve(rows_as_arrays(S.gray(spark, sf_dir)), GAUSS)).select("image_id", "y", "x", F.round("v", 7).alias("v"))


def smooth(a: np.ndarray, step: int) -> np.ndarray:
    """B3 spline taps ``step`` apart along both axes, edges clamped."""
    for axis in (0, 1):
        at = np.arange(a.shape[axis])
        a = sum(t * np.take(a, np.clip(at + (k - 2) * step, 0, len(at) - 1), axis) for k, t in enumerate(B3))
    return a


def atrous(px: DataFrame, levels: int, strength: float, sigma: float = 0.02) -> DataFrame:
    """Undecimated wavelet shrinkage: detail of each level is shrunk by a garrote at 1.2 strengths of the level's noise and taken out.

    Levels are chained stencils, which as joins would multiply the pixels by 25 each; so pixels are shuffled once
    to their image (or tile with a halo of 2^(levels + 1) pixels), and the levels run on its array."""

    def run(batches):
        for pdf in batches:
            out = []
            for rows in pdf["rows"]:
                base = np.stack([np.asarray(r, float) for r in rows])
                kept = base.copy()
                for k in range(levels):
                    low = smooth(base, 2**k)
                    d, t = base - low, 1.2 * strength * sigma * LEVEL_NORMS[k]
                    kept -= d - d * np.maximum(1 - t * t / np.maximum(d * d, 1e-20), 0)
                    base = low
                out.append(kept.tolist())
            yield pdf.assign(rows=out)

    return as_pixels(rows_as_arrays(px).mapInPandas(run, "image_id long, rows array<array<double>>"))


@query(f"SELECT p.image_id, p.y, p.x, round(p.v - (d - d * greatest(1 - t * t / greatest(d * d, 1e-20), 0.0)), 7) AS v FROM (SELECT a.*, a.v - b.v AS d, {1.2 * 2.0 * 0.02 * LEVEL_NORMS[0]!r} AS t FROM ({S.GRAY}) a JOIN {_blur_sql(S.GRAY, B3)} b USING (image_id, y, x)) p")
def atrous_level0(spark, sf_dir):
    return atrous(S.gray(spark, sf_dir), 1, 2.0).select("image_id", "y", "x", F.round("v", 7).alias("v"))


@query()
def atrous_5(spark, sf_dir):
    """Five levels; held against NumPy in the tests."""
    return atrous(S.gray(spark, sf_dir), 5, 2.0).select("image_id", "y", "x", F.round("v", 7).alias("v"))


def _warp_xy():
    """Source coordinates of a small radial warp."""
    dy, dx = F.col("y") - 3.5, F.col("x") - 3.5
    k = 1 + 0.004 * (dx * dx + dy * dy)
    return 3.5 + dy * k, 3.5 + dx * k


@query(f"""WITH p AS ({S.GRAY}), s AS (SELECT image_id, y, x, least(greatest(3.5 + (y - 3.5) * k, 0.0), 7.0) AS sy, least(greatest(3.5 + (x - 3.5) * k, 0.0), 7.0) AS sx FROM (SELECT *, 1 + 0.004 * ((x - 3.5) * (x - 3.5) + (y - 3.5) * (y - 3.5)) AS k FROM p)),
c AS (SELECT *, CAST(least(floor(sy), 6) AS INT) AS y0, CAST(least(floor(sx), 6) AS INT) AS x0 FROM s)
SELECT c.image_id, c.y, c.x, round((a.v * (1 - (sx - x0)) + b.v * (sx - x0)) * (1 - (sy - y0)) + (d.v * (1 - (sx - x0)) + e.v * (sx - x0)) * (sy - y0), 7) AS v FROM c
JOIN p a ON a.image_id = c.image_id AND a.y = y0 AND a.x = x0 JOIN p b ON b.image_id = c.image_id AND b.y = y0 AND b.x = x0 + 1
JOIN p d ON d.image_id = c.image_id AND d.y = y0 + 1 AND d.x = x0 JOIN p e ON e.image_id = c.image_id AND e.y = y0 + 1 AND e.x = x0 + 1""")
def warp_bilinear(spark, sf_dir):
    px = S.gray(spark, sf_dir)
    sy, sx = (F.least(F.greatest(c, F.lit(0.0)), F.lit(7.0)) for c in _warp_xy())
    j = px.withColumns({"sy": sy, "sx": sx}).join(rows_as_arrays(px), "image_id")
    j = j.withColumns({"y0": F.least(F.floor("sy"), F.lit(6)).cast("int"), "x0": F.least(F.floor("sx"), F.lit(6)).cast("int")})
    fx, fy = F.col("sx") - F.col("x0"), F.col("sy") - F.col("y0")
    at = lambda a, b: F.get(F.get("rows", F.col("y0") + a), F.col("x0") + b)
    v = (at(0, 0) * (1 - fx) + at(0, 1) * fx) * (1 - fy) + (at(1, 0) * (1 - fx) + at(1, 1) * fx) * fy
    return j.select("image_id", "y", "x", F.round(v, 7).alias("v"))


def overlap_add(px: DataFrame, tile: int, step: int, width: int) -> DataFrame:
    """Every pixel goes to the tiles over it, each tile's mean is matched, and tiles are blended by ramp weights."""
    starts = sorted({*range(0, max(width - tile, 0) + 1, step), max(width - tile, 0)})
    own = F.array(*(F.struct(F.lit(y).alias("ty"), F.lit(x).alias("tx")) for y in starts for x in starts))
    over = F.filter(own, lambda t: F.col("y").between(t["ty"], t["ty"] + tile - 1) & F.col("x").between(t["tx"], t["tx"] + tile - 1))
    parts = px.withColumn("t", F.explode(over)).select("*", "t.ty", "t.tx")
    ramp = lambda c, s: F.least(F.col(c) - F.col(s) + 1, F.lit(tile) - (F.col(c) - F.col(s))).cast("double")
    w = ramp("y", "ty") * ramp("x", "tx")
    mean = parts.groupBy("image_id", "ty", "tx").agg(F.avg("v").alias("mean"))
    done = parts.join(mean, ["image_id", "ty", "tx"]).withColumn("o", F.col("v") * 0.5 + F.col("mean") * 0.5).withColumn("w", w)
    return done.groupBy("image_id", "y", "x").agg((F.sum(F.col("w") * F.col("o")) / F.greatest(F.sum("w"), F.lit(1e-6))).alias("v"))


@query(f"""WITH p AS ({S.GRAY}), s AS (SELECT unnest([0, 3, 4]) AS s), t AS (SELECT p.*, a.s AS ty, b.s AS tx FROM p, s a, s b WHERE p.y BETWEEN a.s AND a.s + 3 AND p.x BETWEEN b.s AND b.s + 3),
m AS (SELECT *, avg(v) OVER (PARTITION BY image_id, ty, tx) AS mean, least(y - ty + 1, 4 - (y - ty)) * least(x - tx + 1, 4 - (x - tx)) AS w FROM t) SELECT image_id, y, x, round(sum(w * (v * 0.5 + mean * 0.5)) / greatest(sum(w), 1e-6), 7) AS v FROM m GROUP BY 1, 2, 3""")
def tile_overlap_add(spark, sf_dir):
    return overlap_add(S.gray(spark, sf_dir), 4, 3, S.SIDE).select("image_id", "y", "x", F.round("v", 7).alias("v"))


def _once(value, use):
    """``use(value)`` with the value made once, however often ``use`` refers to it inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _transposed(rows):
    return _once(rows, lambda a: F.transform(F.sequence(F.lit(0), F.size(F.get(a, F.lit(0))) - 1), lambda x: F.transform(a, lambda r: F.get(r, x))))


def self_ensemble(images: DataFrame, model) -> DataFrame:
    """``(image_id, rows)``: the mean of ``model`` (rows to rows, as Columns) over the eight symmetric variants of each image, each result turned back.

    The variants of an image are turned inside its row, one after the other, so there is no shuffle, and a task holds one image and its variants
    whatever the table's size is; as pixels they would be eight tables, shuffled and sorted by line. Images are rectangular."""
    def variant(a, transpose, flip, mirror):
        a = _transposed(a) if transpose else a
        a = F.reverse(a) if flip else a
        a = model(F.transform(a, F.reverse) if mirror else a)
        a = F.transform(a, F.reverse) if mirror else a
        a = F.reverse(a) if flip else a
        return _transposed(a) if transpose else a

    add = lambda a, b: F.zip_with(a, b, lambda p, q: F.zip_with(p, q, lambda v, w: v + w))
    total = lambda a: reduce(add, (variant(a, *turn) for turn in product((False, True), repeat=3)))
    return images.select("image_id", F.transform(_once(F.col("rows"), total), lambda r: F.transform(r, lambda v: v / 8)).alias("rows"))


@query(f"""WITH p AS ({S.GRAY}) SELECT c.image_id, c.y, c.x, round(c.v * 0.5 + sum(n.v) * 0.125, 7) AS v FROM p c, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) d(dy, dx), p n
WHERE n.image_id = c.image_id AND n.y = least(greatest(c.y + dy, 0), 7) AND n.x = least(greatest(c.x + dx, 0), 7) GROUP BY c.image_id, c.y, c.x, c.v""")
def d4_ensemble(spark, sf_dir):
    """Mean of a model over the eight symmetric variants of its input, each result turned back. The model mixes a pixel with its left neighbour
    alone, so each variant gives another image, and the mean has all four neighbours alike."""
    left = lambda rows: F.transform(rows, lambda r: F.transform(r, lambda v, i: 0.5 * v + 0.5 * F.coalesce(F.get(r, i - 1), v)))
    return as_pixels(self_ensemble(S.gray_rows(spark, sf_dir), left)).select("image_id", "y", "x", F.round("v", 7).alias("v"))


@query(f"SELECT image_id, y, x, round(v, 7) AS v FROM {_blur_sql(S.GRAY, GAUSS)} WHERE y BETWEEN 3 AND 4 AND x BETWEEN 3 AND 4")
def region_with_halo(spark, sf_dir):
    """A region of a blurred image from the region and its halo of two pixels alone: the filter reaches the scan's pixels
    before the blur, the exact crop comes after it."""
    halo = S.gray(spark, sf_dir).where("y between 1 and 6 and x between 1 and 6")
    part = as_pixels(convolve(rows_as_arrays(halo), GAUSS)).withColumns({"y": F.col("y") + 1, "x": F.col("x") + 1})
    return part.where("y between 3 and 4 and x between 3 and 4").select("image_id", "y", "x", F.round("v", 7).alias("v"))
