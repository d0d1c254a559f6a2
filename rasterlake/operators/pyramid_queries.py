"""Rasters stored as tiles of a pyramid, so that a region at any scale reads its tiles only.

``path/level=<k>/ty=<row of tiles>``, inside sorted by image and tile column: the level and the row of tiles are folders that a scan prunes, image and
column are pushed down to Parquet's row groups. A tile is one row: places ``i`` in the tile and an array for each channel, absent pixels are absent.
A level is the mean of two by two pixels of the level below, of those there are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.operators.resample_queries import area_sql, resample
from rasterlake.plans.registry import load, query
from rasterlake.plans.shared import shared_folder
from rasterlake.sources import surrogates as S

TILE = 256


def _tiles(px: DataFrame, channels) -> DataFrame:
    """Pixels ``(image_id, ty, tx, i, *channels)`` as a row for each tile."""
    t = px.groupBy("image_id", "ty", "tx").agg(F.array_sort(F.collect_list(F.struct("i", *channels))).alias("px"))
    return t.select("image_id", "ty", "tx", *(F.col(f"px.{c}").alias(c) for c in ("i", *channels)))


def _pixels(tiles: DataFrame, tile: int, channels, *more: str) -> DataFrame:
    """Tiles as pixels ``(image_id, y, x, *channels, *more)``."""
    p = tiles.select("image_id", "ty", "tx", *more, F.explode(F.arrays_zip("i", *channels)).alias("p"))
    at = lambda t, k: (F.col(t) * tile + k).cast("int")
    return p.select("image_id", at("ty", F.floor(F.col("p.i") / tile)).alias("y"), at("tx", F.col("p.i") % tile).alias("x"), *(F.col(f"p.{c}").alias(c) for c in channels), *more)


def _schema(channels) -> str:
    return "image_id long, tx int, i array<int>, " + ", ".join(f"{c} array<double>" for c in channels) + ", level int, ty int"


def write_pyramid(px: DataFrame, path: str, tile: int = TILE, channels: tuple[str, ...] = ("r", "g", "b")) -> int:
    """Writes ``(image_id, y, x, *channels)`` as a pyramid into the new folder ``path``; gives the number of levels, the last of which has each image in one tile.

    A level is made from the one below as it was written, in one shuffle of whole tiles to the tile they become part of, so a lost executor costs a part
    of one level and a task holds one tile of pixels. Folders are balanced by size (rebalance), however many images share a row of tiles. ``tile`` is even. Pixels without
    image or place, or left or above of 0, go; repeated pixels stay in level 0 and count in the means, as NaN does; null samples do not. A path that holds a pyramid is an error."""
    if tile < 2 or tile % 2:
        raise ValueError("tile must be even")
    at = lambda c, n: F.floor(F.col(c) / n).cast("int")
    px = px.where("image_id is not null and y >= 0 and x >= 0").select(
        F.col("image_id").cast("long").alias("image_id"), at("y", tile).alias("ty"), at("x", tile).alias("tx"), (F.col("y") % tile * tile + F.col("x") % tile).cast("int").alias("i"), *(F.col(c).cast("double").alias(c) for c in channels)
    )
    level, levels, rows = 0, 1, _tiles(px, channels)
    while True:
        rows.hint("rebalance", "ty").sortWithinPartitions("ty", "image_id", "tx").write.mode("error").partitionBy("ty").parquet(f"{path}/level={level}")
        below = read_pyramid(px.sparkSession, path, channels).where(F.col("level") == level)
        if level == 0:
            most = below.agg(F.max(F.greatest("ty", "tx"))).first()[0] or 0
            levels += int(most).bit_length()
        level += 1
        if level == levels:
            return levels
        # both aggregations have the tile above among their keys: they run where the shuffle has put its four tiles
        moved = below.withColumns({"up": at("ty", 2), "left": at("tx", 2)}).repartition("image_id", "up", "left")
        small = _pixels(moved, tile, channels, "up", "left").select("image_id", "up", "left", F.expr(f"cast((y div 2) % {tile} * {tile} + (x div 2) % {tile} as int)").alias("i"), *channels)
        small = small.groupBy("image_id", "up", "left", "i").agg(*(F.avg(c).alias(c) for c in channels))
        rows = _tiles(small.withColumnsRenamed({"up": "ty", "left": "tx"}), channels)


def read_pyramid(spark: SparkSession, path: str, channels: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """The tiles ``(image_id, tx, i, *channels, level, ty)``."""
    return spark.read.schema(_schema(channels)).option("basePath", path).parquet(path)


def region(pyramid: DataFrame, level: int, box: tuple[int, int, int, int], tile: int = TILE, halo: int = 0, images: list[int] | None = None, channels: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """Pixels ``(image_id, y, x, *channels)`` of one rectangle (top, left, bottom, right; ends excluded) of a level and ``halo`` pixels around it, in the coordinates of the level:
    folders and row groups of other tiles are not read. A stencil of that reach over them equals the stencil over the whole, inside the rectangle."""
    top, left, bottom, right = box[0] - halo, box[1] - halo, box[2] + halo, box[3] + halo
    t = pyramid.where((F.col("level") == level) & F.col("ty").between(top // tile, (bottom - 1) // tile) & F.col("tx").between(left // tile, (right - 1) // tile))
    if images is not None:
        t = t.where(F.col("image_id").isin(images))
    return _pixels(t, tile, channels).where(F.col("y").between(top, bottom - 1) & F.col("x").between(left, right - 1))


def _once(df: DataFrame, **columns) -> DataFrame:
    """Adds columns that later steps and pushed filters refer to instead of writing their expressions out again."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def planned(requests: DataFrame, levels: int) -> DataFrame:
    """Adds what a request needs to ``(request_id, image_id, height, width, u0, v0, u1, v1, budget)``, a rectangle in fractions of the image (left, top, right, bottom): its level, that
    level's ``height`` and ``width``, the whole image's ``out_height`` and ``out_width``, and the rectangle ``y0, x0, y1, x1`` of it in whole pixels.

    ``budget`` is the longest edge wanted: within 5/4 of it, and where it is null, the image keeps its own pixels; else it is scaled, from the coarsest level that is not smaller.
    Requests outside the image, empty ones and those of null in any other column go."""
    longest = F.greatest(F.col("width") * (F.col("u1") - F.col("u0")), F.col("height") * (F.col("v1") - F.col("v0")))
    r = requests.dropna(subset=[c for c in requests.columns if c != "budget"]).where("height > 0 and width > 0 and u0 < u1 and v0 < v1 and (budget is null or budget > 0)")
    r = _once(r, s=F.when(longest > F.col("budget") * 1.25, F.col("budget") / longest).otherwise(1.0))
    scaled = lambda c: F.greatest(F.round(F.col(c) * F.col("s")).cast("long"), F.lit(1))
    steps = [F.when((F.col("s") < 1) & (longest >= F.col("budget") * 2.0**k), 1).otherwise(0) for k in range(1, levels)]
    r = _once(r, level=sum(steps, F.lit(0)), out_height=scaled("height"), out_width=scaled("width"))
    low = lambda u, n: F.greatest(F.floor(F.col(u) * F.col(n)), F.lit(0))
    high = lambda u, n: F.least(F.ceil(F.col(u) * F.col(n)), F.col(n))
    halved = {f"level_{c}": F.ceil(F.col(c) / F.pow(F.lit(2.0), F.col("level"))) for c in ("height", "width")}
    r = _once(r, y0=low("v0", "out_height"), y1=high("v1", "out_height"), x0=low("u0", "out_width"), x1=high("u1", "out_width"), **halved)
    r = r.drop("height", "width").withColumnsRenamed({"level_height": "height", "level_width": "width"})
    return r.where("y0 < y1 and x0 < x1").select("request_id", "image_id", "level", "height", "width", "out_height", "out_width", "y0", "x0", "y1", "x1")


def serve(pyramid: DataFrame, plans: DataFrame, tile: int = TILE, channels: tuple[str, ...] = ("r", "g", "b"), each: int = 1000) -> DataFrame:
    """``(request_id, y, x, *channels)`` for requests as ``planned``, places counted in the scaled image: what cropping the whole scaled image gives. Each request
    becomes a row for each tile that it needs and meets the tiles by an equi-join; request_id is unique.

    Requests are small and become many pixels, and many ask for the same tile. So what they have met is dealt by request, about ``each`` requests a task, and
    is exploded and aggregated there: a task's memory does not grow with the number of requests."""
    need = lambda a, n, m: F.expr(f"{a} * {n} div {m}")
    past = lambda b, n, m: F.expr(f"({b} * {n} + {m} - 1) div {m}")
    p = _once(plans, top=need("y0", "height", "out_height"), bottom=past("y1", "height", "out_height"), first=need("x0", "width", "out_width"), past=past("x1", "width", "out_width"))
    over = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / tile).cast("int"), F.floor((F.col(b) - 1) / tile).cast("int")))
    p = p.select("*", over("top", "bottom").alias("ty")).select("*", over("first", "past").alias("tx"))
    carry = ("request_id", "height", "width", "out_height", "out_width", "y0", "x0", "y1", "x1", "top", "bottom", "first", "past")
    met = pyramid.join(p, ["image_id", "level", "ty", "tx"]).repartition(plans.count() // each + 1, "request_id")
    px = _pixels(met, tile, channels, *carry).where("y >= top and y < bottom and x >= first and x < past")
    return resample(px, channels, ("request_id",), ("y0", "x0", "y1", "x1")).select("request_id", "y", "x", *channels)


_UP = lambda t: f"SELECT image_id, y // 2 AS y, x // 2 AS x, avg(v) AS v FROM {t} GROUP BY 1, 2, 3"
_LONGEST = "64.0::DOUBLE * greatest(u1 - u0, v1 - v0)"
_REGION = f"""WITH l0 AS MATERIALIZED ({S.MOSAIC}), l1 AS MATERIALIZED ({_UP('l0')}), l2 AS MATERIALIZED ({_UP('l1')}), l AS (SELECT *, 0 AS level FROM l0 UNION ALL SELECT *, 1 FROM l1 UNION ALL SELECT *, 2 FROM l2),
q AS (SELECT s_suppkey AS request_id, s_suppkey % 8 AS image_id, s_suppkey % 7 / 16.0::DOUBLE AS u0, s_suppkey % 5 / 16.0::DOUBLE AS v0, (s_suppkey % 7 + 2 + s_suppkey % 9) / 16.0::DOUBLE AS u1, (s_suppkey % 5 + 3 + s_suppkey % 8) / 16.0::DOUBLE AS v1, CASE WHEN s_suppkey % 4 > 0 THEN 5 + s_suppkey % 19 END AS budget FROM supplier),
s AS (SELECT *, CASE WHEN {_LONGEST} > budget * 1.25::DOUBLE THEN budget / ({_LONGEST}) ELSE 1.0::DOUBLE END AS s FROM q),
k AS (SELECT *, CASE WHEN s < 1 AND {_LONGEST} >= budget * 4 THEN 2 WHEN s < 1 AND {_LONGEST} >= budget * 2 THEN 1 ELSE 0 END AS level, greatest(CAST(round(64 * s) AS BIGINT), 1) AS n FROM s),
o AS (SELECT request_id, image_id, level, CAST(64 >> level AS BIGINT) AS height, CAST(64 >> level AS BIGINT) AS width, n AS out_height, n AS out_width FROM k)
SELECT request_id, CAST(oy AS INT) AS y, CAST(ox AS INT) AS x, round(v, 7) AS v FROM ({area_sql('l', 'v', ('image_id', 'level')).replace('SELECT s.image_id', 'SELECT s.request_id, s.image_id', 1)}) JOIN k USING (request_id)
WHERE oy >= floor(v0 * n) AND oy < ceil(v1 * n) AND ox >= floor(u0 * n) AND ox < ceil(u1 * n)"""


@query(_REGION)
def pyramid_region(spark, sf_dir):
    """Images as a pyramid of tiles of 16, and a request for each supplier; the SQL crops whole scaled images."""
    path = shared_folder(spark, f"rasterlake/pyramid-{uuid.uuid4().hex}")
    levels = write_pyramid(S.mosaic(spark, sf_dir), path, 16, ("v",))
    k = F.col("s_suppkey")
    unit = lambda c: c / F.lit(16.0)
    requests = load(spark, sf_dir, "supplier").select(
        k.alias("request_id"), (k % 8).alias("image_id"), F.lit(64).alias("height"), F.lit(64).alias("width"), unit(k % 7).alias("u0"), unit(k % 5).alias("v0"),
        unit(k % 7 + 2 + k % 9).alias("u1"), unit(k % 5 + 3 + k % 8).alias("v1"), F.when(k % 4 > 0, 5 + k % 19).alias("budget"),
    )
    return serve(read_pyramid(spark, path, ("v",)), planned(requests, levels), 16, ("v",)).select("request_id", "y", "x", F.round("v", 7).alias("v"))
