"""Denoising and lens correction of colour rasters, in tiles with a halo, so that a task holds one bounded tile of a raster of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rasterlake.operators.stencil_queries import B3, LEVEL_NORMS
from rasterlake.plans.registry import query
from rasterlake.sources import surrogates as S

#: Thresholds of the channels' mean and of their rest, and the edge stop, all in units of the noise; the largest sample.
LUMA, CHROMA, EDGE, LARGEST = 1.2, 2.5, 2.0, 16384.0
#: Fixed value: half the sensor's diagonal in millimetres.
HALF_DIAGONAL = 12.44
PX = ("image_id", "y", "x")


def _tile_keys(rows) -> np.ndarray:
    image = rows.column("image_id")
    return np.stack([np.asarray(pc.fill_null(image, 0)), np.asarray(pc.is_null(image)), np.asarray(rows.column("ty")), np.asarray(rows.column("tx"))], 1)


def _whole_tiles(batches) -> Iterator[pa.Table]:
    """Tables of whole tiles from batches that are sorted by tile."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = _tile_keys(batch)
        change = np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1
        cut = int(change[-1]) if len(change) else 0
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        elif held and (_tile_keys(held[-1].slice(held[-1].num_rows - 1)) != k[0]).any():
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def in_tiles(px: DataFrame, run, tile: int, halo: int | str, channels=("r", "g", "b"), carry: tuple[str, ...] = (), most: int = 1 << 18) -> DataFrame:
    """``run(arrays, top, left, carried)`` on the tiles of ``px`` and their halo; the tiles alone come back, as pixels. Tiles of one shape, up to ``most`` pixels
    of them or one tile, go through together: ``arrays`` is (tiles, height, width, channels), the others have a value for each tile.

    ``halo`` is a number or names a column with each image's own. One shuffle, in which a pixel goes to its tile and to those whose halo holds it: (1 + 2 * halo / tile)^2 copies on the mean.
    At the raster's own edge the halo ends, so clamping there is the function's; where ``height`` and ``width`` are carried, tiles beyond it are spared. Rows without a place go; an absent pixel is NaN;
    of several rows for one pixel the array holds one, and each of them comes back; NaN comes back as null."""

    def near(c, size):
        reach = F.col(halo) if isinstance(halo, str) else F.lit(halo)
        last = F.floor((F.col(c) + reach) / tile)
        return F.explode(F.sequence(F.greatest(F.floor((F.col(c) - reach) / tile), F.lit(0)), F.least(last, F.floor((F.col(size) - 1) / tile)) if size in carry else last))

    own = [F.col("image_id").cast("long").alias("image_id"), *(F.col(c).cast("int").alias(c) for c in PX[1:]), *(F.col(c).cast("double").alias(c) for c in channels)]
    parts = px.select(*own, *(F.col(c).cast("double").alias(c) for c in carry), *([halo] if isinstance(halo, str) else []), near("y", "height").alias("ty")).select("*", near("x", "width").alias("tx"))

    def tiles(batches):
        for table in map(pa.Table.combine_chunks, _whole_tiles(batches)):
            k = _tile_keys(table)
            lo = np.r_[0, np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1]
            of = np.repeat(np.arange(len(lo)), np.diff(np.r_[lo, len(k)]))
            y, x = (np.asarray(table.column(c)).astype(np.int64) for c in "yx")
            mine = (y // tile == k[:, 2]) & (x // tile == k[:, 3])
            top, left = np.minimum.reduceat(y, lo), np.minimum.reduceat(x, lo)
            shape = np.stack([np.maximum.reduceat(y, lo) - top, np.maximum.reduceat(x, lo) - left], 1) + 1
            y, x = y - top[of], x - left[of]
            v = np.stack([pc.fill_null(table.column(c), np.nan).to_numpy() for c in channels], 1)
            carried = {c: pc.fill_null(table.column(c), np.nan).to_numpy()[lo] for c in carry}
            out, some = np.full(v.shape, np.nan), np.flatnonzero(np.bincount(of, mine) > 0)
            for h, w in np.unique(shape[some], axis=0).tolist():
                alike = some[(shape[some] == (h, w)).all(1)]
                step = max(1, most // (h * w))
                for n in range(0, len(alike), step):
                    now = alike[n : n + step]
                    place = np.full(len(lo), -1)
                    place[now] = np.arange(len(now))
                    rows = np.flatnonzero(place[of] >= 0)
                    a = np.full((len(now), h, w, len(channels)), np.nan)
                    a[place[of[rows]], y[rows], x[rows]] = v[rows]
                    rows = rows[mine[rows]]
                    out[rows] = run(a, top[now], left[now], {c: t[now] for c, t in carried.items()})[place[of[rows]], y[rows], x[rows]]
            kept = table.select(PX).filter(pa.array(mine))
            done = [pa.array(c, mask=np.isnan(c)) for c in out[mine].T]
            yield from pa.Table.from_arrays([*kept.columns, *done], names=[*PX, *channels]).to_batches(max_chunksize=1 << 16)

    schema = "image_id long, y int, x int, " + ", ".join(f"{c} double" for c in channels)
    return parts.repartition("image_id", "ty", "tx").sortWithinPartitions("image_id", "ty", "tx").mapInArrow(tiles, schema)


def _shrink(d, t):
    return d * np.maximum(1 - t * t / np.maximum(d * d, 1e-20), 0)


def wavelet(px: DataFrame, noise: tuple[tuple, tuple], strength: float, chroma: float = 1.0, levels: int = 5, tile: int = 512) -> DataFrame:
    """Edge-stopped undecimated wavelet shrinkage of ``(image_id, y, x, r, g, b)``.

    The noise's variance is ``noise[0] + noise[1] * signal`` a channel. Samples are made finite first and a sample outside its four
    neighbours by two sigma becomes the mean of the middle two. A level's taps count less the more they differ from
    the centre over the three channels together; of its detail the mean of the channels and the rest are shrunk apart,
    by thresholds in the sigma of the smoothed signal. Chained levels run on a tile's array, since as joins each would multiply the pixels by 25."""
    base, slope = (np.asarray(n, float) for n in noise)

    def sigma(v):
        return np.sqrt(np.maximum(base + slope * np.maximum(v, 0), 1e-12))

    def around(a, step, reach):
        """The arrays moved by every tap, edges clamped."""
        pad = np.pad(a, ((0, 0), (reach * step,) * 2, (reach * step,) * 2, (0, 0)), mode="edge")
        return lambda j, i: pad[:, (j + reach) * step : (j + reach) * step + a.shape[1], (i + reach) * step : (i + reach) * step + a.shape[2]]

    def run(a, top, left, carried):
        a = np.clip(np.nan_to_num(a, nan=0.0, posinf=LARGEST, neginf=-LARGEST), -LARGEST, LARGEST)
        at = around(a, 1, 1)
        cross = np.stack([at(0, 1), at(0, -1), at(1, 0), at(-1, 0)])
        low, high = cross.min(0), cross.max(0)
        slack = 2 * sigma(a)
        centre = np.where((a >= high + slack) | (a <= low - slack), (cross.sum(0) - low - high) / 2, a)
        kept, source = centre, a
        for level in range(levels):
            at, total, weight = around(source, 2**level, 2), 0.0, 0.0
            softness = EDGE * sigma(centre)
            for j, tj in enumerate(B3):
                for i, ti in enumerate(B3):
                    v = at(j - 2, i - 2)
                    w = tj * ti * np.exp(-0.5 * (((v - centre) / softness) ** 2).sum(-1, keepdims=True))
                    total, weight = total + w * v, weight + w
            coarse = np.where(weight > 0, total / np.maximum(weight, 1e-300), centre)
            detail, noisy = centre - coarse, sigma(coarse)
            mean = detail.mean(-1, keepdims=True)
            t = strength * LEVEL_NORMS[level]
            still = _shrink(mean, LUMA * t * np.sqrt((noisy**2).sum(-1, keepdims=True)) / 3) + _shrink(detail - mean, CHROMA * chroma * t * noisy)
            kept = kept - (detail - still)
            centre = source = coarse
        return kept

    return in_tiles(px, run, tile, 2 * (2**levels - 1) + 1)


NOISE = ((2e-3, 1e-3, 3e-3), (2e-2, 1e-2, 3e-2))


def _sigma_sql(c, v):
    k = "rgb".index(c)
    return f"sqrt(greatest({NOISE[0][k]} + {NOISE[1][k]} * greatest({v}, 0), 1e-12))"


def _shrink_sql(d, t):
    return f"(({d}) * greatest(1 - ({t}) * ({t}) / greatest(({d}) * ({d}), 1e-20), 0))"


def _wavelet_sql(levels: int, strength: float) -> str:
    """The same as one join with 25 taps a level: (c) centre, (s) source of the taps, (k) what is kept."""
    taps = ", ".join(f"({k - 2}, {t!r})" for k, t in enumerate(B3))
    each = lambda f: ", ".join(f(c) for c in "rgb")
    hit = "n.image_id = p.image_id AND n.y = least(greatest(p.y + dy, 0), 7) AND n.x = least(greatest(p.x + dx, 0), 7)"
    ctes = [
        f"p AS MATERIALIZED ({S.LINEAR})",
        f"h AS MATERIALIZED (SELECT p.*, {each(lambda c: f'min(n.{c}) AS {c}_lo, max(n.{c}) AS {c}_hi, sum(n.{c}) AS {c}_all')} FROM p, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) d(dy, dx), p n WHERE {hit} GROUP BY ALL)",
        f"""z0 AS MATERIALIZED (SELECT image_id, y, x, {each(lambda c: f"CASE WHEN {c} >= {c}_hi + 2 * {_sigma_sql(c, c)} OR {c} <= {c}_lo - 2 * {_sigma_sql(c, c)} THEN ({c}_all - {c}_lo - {c}_hi) / 2 ELSE {c} END AS {c}c, {c} AS {c}s")} FROM h)""",
        f"l0 AS MATERIALIZED (SELECT image_id, y, x, {each(lambda c: f'{c}c, {c}s, {c}c AS {c}k')} FROM z0)",
    ]
    for n in range(levels):
        gap = " + ".join(f"pow((n.{c}s - p.{c}c) / ({EDGE} * {_sigma_sql(c, f'p.{c}c')}), 2)" for c in "rgb")
        ctes.append(f"""t{n} AS MATERIALIZED (SELECT image_id, y, x, {each(lambda c: f'max({c}c) AS {c}c, max({c}k) AS {c}k, sum(w * {c}n) / sum(w) AS {c}o')} FROM
(SELECT p.*, {each(lambda c: f'n.{c}s AS {c}n')}, a.w * b.w * exp(-0.5 * ({gap})) AS w FROM l{n} p, (VALUES {taps}) a(dy, w), (VALUES {taps}) b(dx, w), l{n} n
WHERE n.image_id = p.image_id AND n.y = least(greatest(p.y + {2**n} * dy, 0), 7) AND n.x = least(greatest(p.x + {2**n} * dx, 0), 7)) GROUP BY 1, 2, 3)""")
        t = strength * LEVEL_NORMS[n]
        luma = f"{LUMA * t!r} * sqrt({' + '.join(f'pow({_sigma_sql(c, f'{c}o')}, 2)' for c in 'rgb')}) / 3"
        still = lambda c: f"{_shrink_sql('m', luma)} + {_shrink_sql(f'{c}c - {c}o - m', f'{CHROMA * t!r} * {_sigma_sql(c, f'{c}o')}')}"  # noqa: B023, E731
        ctes.append(f"l{n + 1} AS MATERIALIZED (SELECT image_id, y, x, {each(lambda c: f'{c}o AS {c}c, {c}o AS {c}s, {c}k - ({c}c - {c}o - ({still(c)})) AS {c}k')} FROM (SELECT *, ((rc - ro) + (gc - go) + (bc - bo)) / 3 AS m FROM t{n}))")  # noqa: B023
    return f"WITH {', '.join(ctes)} SELECT image_id, y, x, {each(lambda c: f'round({c}k, 6) AS {c}')} FROM l{levels}"


def _rounded(px: DataFrame, places: int = 6) -> DataFrame:
    return px.select(*PX, *(F.round(c, places).alias(c) for c in "rgb"))


@query(_wavelet_sql(1, 1.5))
def wavelet_level0(spark, sf_dir):
    """One level, in tiles of four pixels, so that the check sees the halo."""
    return _rounded(wavelet(S.linear(spark, sf_dir), NOISE, 1.5, levels=1, tile=4))


@query(_wavelet_sql(5, 1.5))
def wavelet_denoise(spark, sf_dir):
    return _rounded(wavelet(S.linear(spark, sf_dir), NOISE, 1.5))


def _unwarped(a, top, left, height, width, focal, green, red, blue, vignette):
    """The corrected samples of arrays whose corners are at (top, left) of their rasters; sizes, focal lengths and coefficients have one value or one for each array."""
    top, left, height, width, focal = (np.asarray(v, float)[..., None, None] for v in (top, left, height, width, focal))
    poly = lambda k, r2: 1 + r2 * (k[0] + r2 * (k[1] + r2 * k[2]))
    dy = top + np.arange(a.shape[1])[:, None] - (height - 1) / 2
    dx = left + np.arange(a.shape[2])[None, :] - (width - 1) / 2
    r2 = (dy * dy + dx * dx) * (HALF_DIAGONAL / focal / (0.5 * np.hypot(height, width))) ** 2
    out, geometric, t = np.empty_like(a), poly(green, r2), np.arange(len(a))[:, None, None]
    for c, s in enumerate((geometric * red[0] * poly(red[1:], r2), geometric, geometric * blue[0] * poly(blue[1:], r2))):
        sy = np.clip(np.clip((height - 1) / 2 + dy * s, 0, height - 1) - top, 0, a.shape[1] - 1)
        sx = np.clip(np.clip((width - 1) / 2 + dx * s, 0, width - 1) - left, 0, a.shape[2] - 1)
        y0, x0 = np.floor(sy).astype(int), np.floor(sx).astype(int)
        y1, x1 = np.minimum(y0 + 1, a.shape[1] - 1), np.minimum(x0 + 1, a.shape[2] - 1)
        fy, fx, v = sy - y0, sx - x0, a[..., c]
        out[..., c] = (v[t, y0, x0] * (1 - fx) + v[t, y0, x1] * fx) * (1 - fy) + (v[t, y1, x0] * (1 - fx) + v[t, y1, x1] * fx) * fy
    return out / np.maximum(poly(vignette, r2), 0.25)[..., None]


def lens_correct(px: DataFrame, green, red, blue, vignette, halo: int, tile: int = 512) -> DataFrame:
    """Distortion, lateral colour and vignette of ``(image_id, y, x, r, g, b, height, width, focal)``, scale polynomials in the squared
    radius: ``green`` three coefficients, ``red`` and ``blue`` a scale and three on top of green. Samples are bilinear and clamped to the
    raster; ``halo`` is the largest shift in pixels and two (``roi_margin``)."""
    def run(a, top, left, carried):
        return _unwarped(a, top, left, *(carried[c] for c in ("height", "width", "focal")), green, red, blue, vignette)

    return in_tiles(px, run, tile, halo, carry=("height", "width", "focal"))


#: Columns of an image's own coefficients: green three, red and blue a scale and three each, vignette three.
OWN = tuple(f"k{i}" for i in range(14))


def lens_correct_own(px: DataFrame, tile: int = 512) -> DataFrame:
    """``lens_correct`` with coefficients ``k0`` to ``k13``, focal length and ``halo`` of each image, which its pixels carry (equal values, so a shuffle's compression takes them)."""
    def run(a, top, left, carried):
        k = [carried[c][:, None, None] for c in OWN]
        return _unwarped(a, top, left, *(carried[c] for c in ("height", "width", "focal")), k[:3], k[3:7], k[7:11], k[11:])

    return in_tiles(px, run, tile, "halo", carry=("height", "width", "focal", *OWN))


LENS = {"green": (0.12, -0.03, 0.01), "red": (1.002, 0.004, 0.001, 0.0), "blue": (0.997, -0.003, 0.0, 0.001), "vignette": (-0.5, 0.2, -0.05)}


def _poly_sql(k):
    return f"(1 + r2 * ({k[0]} + r2 * ({k[1]} + r2 * {k[2]})))"


def _lens_sql() -> str:
    scale = {"r": f"g_s * {LENS['red'][0]} * {_poly_sql(LENS['red'][1:])}", "g": "g_s", "b": f"g_s * {LENS['blue'][0]} * {_poly_sql(LENS['blue'][1:])}"}
    place = lambda c, d: f"least(greatest(3.5 + {d} * {scale[c]}, 0.0), 7.0)"
    long = " UNION ALL ".join(f"SELECT image_id, y, x, gain, '{c}' AS c, {place(c, 'dy')} AS sy, {place(c, 'dx')} AS sx FROM q" for c in "rgb")
    return f"""WITH p AS MATERIALIZED ({S.LINEAR}), v AS MATERIALIZED (SELECT image_id, y, x, unnest(['r', 'g', 'b']) AS c, unnest([r, g, b]) AS v FROM p),
r AS (SELECT *, y - 3.5 AS dy, x - 3.5 AS dx, (pow(y - 3.5, 2) + pow(x - 3.5, 2)) * pow({HALF_DIAGONAL} / (18 + image_id % 50) / (0.5 * sqrt(128.0::DOUBLE)), 2) AS r2 FROM p),
q AS (SELECT *, {_poly_sql(LENS['green'])} AS g_s, 1 / greatest({_poly_sql(LENS['vignette'])}, 0.25) AS gain FROM r), s AS ({long}),
n AS (SELECT s.image_id, s.y, s.x, s.c, gain * sum(v.v * (1 - abs(v.y - sy)) * (1 - abs(v.x - sx))) AS v FROM s JOIN v ON v.image_id = s.image_id AND v.c = s.c AND abs(v.y - sy) < 1 AND abs(v.x - sx) < 1 GROUP BY s.image_id, s.y, s.x, s.c, gain)
SELECT image_id, y, x, {', '.join(f"round(max(CASE WHEN c = '{c}' THEN v END), 6) AS {c}" for c in 'rgb')} FROM n GROUP BY 1, 2, 3"""


@query(_lens_sql())
def lens_correction(spark, sf_dir):
    px = S.linear(spark, sf_dir).withColumns({"height": F.lit(S.SIDE), "width": F.lit(S.SIDE), "focal": 18.0 + F.col("image_id") % 50})
    return _rounded(lens_correct(px, **LENS, halo=3, tile=4))


def denoise(px: DataFrame, sizes: DataFrame, model, strength: float, tile: int, overlap: int) -> DataFrame:
    """A tile model over rasters: overlapping tiles, prediction, mean of each tile restored, blend by flat-topped ramps, cross-fade with the input.

    ``sizes`` is ``(image_id, height, width)``; the last tile is pinned to the edge. ``model`` takes pixels with their tile ``(ty, tx)`` and
    adds ``o_r, o_g, o_b``. A strength of 0.001 or less changes nothing, of 0.999 or more leaves nothing of the input. A tile over
    the edge of a small raster holds the raster's pixels alone."""
    if strength <= 0.001:
        return px
    step = max(1, tile - overlap)

    def over(c, n):
        last = F.greatest(F.col(n) - tile, F.lit(0)).cast("int")
        starts = F.array_union(F.sequence(F.lit(0), last, F.lit(step)), F.array(last))
        return F.explode(F.filter(starts, lambda s: F.col(c).between(s, s + tile - 1)))

    ramp = lambda k: F.greatest(F.lit(1e-3), F.least(F.least(k, tile - 1 - k) + 0.5, F.lit(float(overlap))) / overlap)
    parts = px.join(sizes, "image_id").select(*PX, *"rgb", over("y", "height").alias("ty"), "width").select("*", over("x", "width").alias("tx"))
    each = Window.partitionBy("image_id", "ty", "tx")
    parts = model(parts).withColumns({f"o_{c}": F.col(f"o_{c}") + F.avg(c).over(each) - F.avg(f"o_{c}").over(each) for c in "rgb"})
    parts = parts.withColumn("w", ramp(F.col("y") - F.col("ty")) * ramp(F.col("x") - F.col("tx")))
    clean = lambda c: F.sum(F.col("w") * F.col(f"o_{c}")) / F.greatest(F.sum("w"), F.lit(1e-6))
    s = 1.0 if strength >= 0.999 else strength
    return parts.groupBy(*PX).agg(*((F.max(c) * (1 - s) + clean(c) * s).alias(c) for c in "rgb"))


def _driver_sql() -> str:
    each = lambda f: ", ".join(f(c) for c in "rgb")
    ramp = lambda k: f"greatest(0.001, least(least({k}, 3 - ({k})) + 0.5, 1.0))"
    return f"""WITH p AS ({S.LINEAR}), s AS (SELECT unnest([0, 3, 4]) AS s), t AS (SELECT p.*, a.s AS ty, b.s AS tx FROM p, s a, s b WHERE p.y BETWEEN a.s AND a.s + 3 AND p.x BETWEEN b.s AND b.s + 3),
m AS (SELECT *, {each(lambda c: f'({c} + coalesce(lag({c}) OVER (PARTITION BY image_id, ty, tx, y ORDER BY x), {c})) / 2 AS o_{c}')} FROM t),
d AS (SELECT image_id, y, x, r, g, b, {each(lambda c: f'o_{c} + avg({c}) OVER t - avg(o_{c}) OVER t AS o_{c}')}, {ramp('y - ty')} * {ramp('x - tx')} AS w FROM m WINDOW t AS (PARTITION BY image_id, ty, tx))
SELECT image_id, y, x, {each(lambda c: f'round(max({c}) * 0.3 + 0.7 * sum(w * o_{c}) / greatest(sum(w), 1e-6), 8) AS {c}')} FROM d GROUP BY 1, 2, 3"""


@query(_driver_sql())
def denoise_driver(spark, sf_dir):
    """The chain with a small model: the mean of a pixel and its left neighbour in the tile."""
    px = S.linear(spark, sf_dir)
    line = Window.partitionBy("image_id", "ty", "tx", "y").orderBy("x")
    blur = lambda parts: parts.withColumns({f"o_{c}": (F.col(c) + F.coalesce(F.lag(c).over(line), c)) / 2 for c in "rgb"})
    sizes = px.groupBy("image_id").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))
    return _rounded(denoise(px, sizes, blur, 0.7, 4, 1), 8)
