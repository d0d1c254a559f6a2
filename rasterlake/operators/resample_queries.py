"""Rasters of any size on a raster of any other size: area means, comparison of unequal rasters, contact sheets.

A source pixel covers [c, c + 1) / n of its axis and an output pixel [k, k + 1) / m; the length they share, in units of 1 / (n * m), is a
whole number, so weights are exact. A pixel knows the few output pixels that it touches, which makes the interval join by axis an explode
and one aggregation: partial sums leave the map side, and a shuffle holds about as many rows as the output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rasterlake.functions import color as C
from rasterlake.operators.color_queries import LAB_SQL, _de_sql
from rasterlake.plans.registry import load, query
from rasterlake.sources import surrogates as S

SIZES = ("height", "width", "out_height", "out_width")
#: Rows between the pictures of a contact sheet, and its ground.
GAP, GROUND = 8, 1.0


def resample(px: DataFrame, channels: tuple[str, ...] = ("r", "g", "b"), keys: tuple[str, ...] = ("image_id",), crop: tuple[str, str, str, str] | None = None) -> DataFrame:
    """``(*keys, y, x, *channels)`` on ``out_height`` x ``out_width``, from pixels that carry these sizes and their own ``height`` and ``width``.

    An output sample is the mean of the source samples under it, weighted by the area they share with it; enlarging repeats samples and blends at
    their borders. Null samples and absent pixels have no weight: null where no sample is left, no row where no pixel is. NaN spreads to the samples it touches.
    Pixels outside the stated size, without a place or with a size of null or under 1 go; repeated rows of a pixel count as often as they occur. ``crop`` names columns (top, left, bottom, right; ends excluded) with the
    rectangle wanted of the output: the rest is not aggregated."""

    def touched(c, n, m):
        return F.explode(F.expr(f"sequence({c} * {m} div {n}, (({c} + 1) * {m} - 1) div {n})"))

    def shared(c, k, n, m):
        return F.least((F.col(k) + 1) * F.col(n), (F.col(c) + 1) * F.col(m)) - F.greatest(F.col(k) * F.col(n), F.col(c) * F.col(m))

    box = crop or ()
    px = px.select(*keys, *box, *channels, *(F.col(c).cast("long").alias(c) for c in ("y", "x", *SIZES)))
    px = px.where("least(height, width, out_height, out_width) > 0 and out_height > 0 and out_width > 0 and y >= 0 and y < height and x >= 0 and x < width")
    cells = px.select("*", touched("y", "height", "out_height").alias("oy")).select("*", touched("x", "width", "out_width").alias("ox"))
    if crop:
        cells = cells.where((F.col("oy") >= F.col(crop[0])) & (F.col("oy") < F.col(crop[2])) & (F.col("ox") >= F.col(crop[1])) & (F.col("ox") < F.col(crop[3])))
    w = shared("y", "oy", "height", "out_height").cast("double") * shared("x", "ox", "width", "out_width")
    cells = cells.select(*keys, "oy", "ox", *channels, w.alias("w"))
    mean = lambda c: (F.sum(F.col("w") * F.col(c)) / F.sum(F.when(F.col(c).isNotNull(), F.col("w")))).alias(c)
    return cells.groupBy(*keys, "oy", "ox").agg(*map(mean, channels)).select(*keys, F.col("oy").cast("int").alias("y"), F.col("ox").cast("int").alias("x"), *channels)


def common_size(height, width, size: int):
    """The raster on which two images are compared: ``size`` on the long edge, the other by the reference's aspect, one at least."""
    other = lambda a, b: F.greatest(F.round(F.lit(float(size)) * a / b).cast("long"), F.lit(1))
    wide, full = width >= height, F.lit(size).cast("long")
    return F.when(wide, other(height, width)).otherwise(full), F.when(wide, full).otherwise(other(width, height))


def compare(candidates: DataFrame, references: DataFrame, size: int) -> DataFrame:
    """Colour differences of each image's candidate and reference, linear rasters ``(image_id, y, x, r, g, b, height, width)`` of any two sizes, on the reference's
    common raster: n, mean_de, rms_de, max_de and the mean of candidate minus reference in L*, a*, b*. Both sides are aggregated by the keys they are joined on, so the join
    shuffles nothing; sizes of the reference come to the candidate as a row for each image. A pixel with a null on either side does not count; an image without its counterpart has no row."""
    h, w = common_size(F.col("height"), F.col("width"), size)
    references = references.withColumns({"out_height": h, "out_width": w})
    sizes = references.groupBy("image_id").agg(F.max("out_height").alias("out_height"), F.max("out_width").alias("out_width"))
    sides = [resample(references), resample(candidates.join(sizes, "image_id"))]
    lab = [s.select("image_id", "y", "x", *(c.alias(f"{n}{k}") for c, n in zip(C.lab(tuple(F.col(c) for c in "rgb")), "lab"))) for k, s in zip((1, 2), sides)]
    d = C.delta_e2000(lab[0].join(lab[1], ["image_id", "y", "x"]))
    delta = lambda c: F.avg(F.col(f"{c}2") - F.col(f"{c}1")).alias(f"d{c}")
    return d.groupBy("image_id").agg(F.count("de").alias("n"), F.avg("de").alias("mean_de"), F.sqrt(F.avg(F.col("de") * F.col("de"))).alias("rms_de"), F.max("de").alias("max_de"), *map(delta, "lab"))


def sheet_places(images: DataFrame, width: int, gap: int = GAP) -> DataFrame:
    """Adds ``out_height``, ``out_width`` and ``top`` to ``(sheet, position, image_id, height, width)``: pictures at one width under each other in order of
    position, then of image_id. Prefix sums go over cells of 2048 positions first, so no window holds all pictures of a large sheet unless they share positions."""
    rows = images.where("height > 0 and width > 0").withColumns({"out_height": F.expr(f"height * {width} div width"), "out_width": F.lit(width).cast("long"), "cell": F.floor(F.col("position") / 2048)})
    step = F.col("out_height") + gap
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    cells = rows.groupBy("sheet", "cell").agg(F.sum(step).alias("s"))
    cells = cells.select("sheet", "cell", F.coalesce(F.sum("s").over(before(Window.partitionBy("sheet").orderBy("cell"))), none).alias("base"))
    inside = before(Window.partitionBy("sheet", "cell").orderBy("position", "image_id"))
    return rows.join(cells, ["sheet", "cell"]).withColumn("top", F.col("base") + F.coalesce(F.sum(step).over(inside), none)).drop("cell", "base")


def compose(px: DataFrame, images: DataFrame, width: int, channels: tuple[str, ...] = ("r", "g", "b"), gap: int = GAP) -> DataFrame:
    """Contact sheets ``(sheet, y, x, *channels)`` of pixels ``(image_id, y, x, *channels)``: pictures of ``images`` scaled to ``width`` and stacked, rows of the ground
    between two. An image that is on several sheets, or twice on one, is placed each time; where an image lacks pixels its sheet does, too; a picture flatter than a row leaves its gap only. Rows without sheet or position go."""
    places = sheet_places(images.where("sheet is not null and position is not null"), width, gap)
    placed = resample(px.join(places, "image_id"), channels, ("sheet", "top", "position", "image_id"))
    pictures = placed.select("sheet", (F.col("top") + F.col("y")).alias("y"), F.col("x").cast("long").alias("x"), *channels)
    if gap == 0:
        return pictures
    rows = places.where("top > 0").select("sheet", F.explode(F.sequence(F.col("top") - gap, F.col("top") - 1)).alias("y"))
    ground = rows.select("sheet", "y", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long"))).alias("x"))
    return pictures.unionByName(ground.select("*", *(F.lit(GROUND).alias(c) for c in channels)))


def area_sql(source: str, channels, keys=("image_id",)) -> str:
    """The same from the side of the output: each output sample looks its source rows and columns up. ``source`` names a CTE of pixels, and ``o`` one of ``(*keys, SIZES)``."""
    span = lambda k, n, m: f"unnest(range({k} * {n} // {m}, (({k} + 1) * {n} + {m} - 1) // {m}))"
    lap = lambda c, k, n, m: f"(least(({k} + 1) * {n}, ({c} + 1) * {m}) - greatest({k} * {n}, {c} * {m}))"
    w = f"{lap('p.y', 'oy', 's.height', 's.out_height')} * {lap('p.x', 'ox', 's.width', 's.out_width')}::DOUBLE"
    same = " AND ".join(f"p.{k} = s.{k}" for k in keys)
    return f"""SELECT {', '.join(f's.{k}' for k in keys)}, oy, ox, {', '.join(f'sum({w} * p.{c}) / sum({w}) AS {c}' for c in channels)} FROM (SELECT *, {span('ox', 'width', 'out_width')} AS sx FROM
(SELECT *, {span('oy', 'height', 'out_height')} AS sy FROM (SELECT *, unnest(range(0, out_width)) AS ox FROM (SELECT *, unnest(range(0, out_height)) AS oy FROM o)))) s JOIN {source} p ON {same} AND p.y = sy AND p.x = sx GROUP BY ALL"""


@query(
    f"WITH p AS MATERIALIZED ({S.MOSAIC}), o AS (SELECT DISTINCT image_id, 64 AS height, 64 AS width, 23 + image_id % 30 AS out_height, 17 + image_id * 13 % 90 AS out_width FROM p) "
    f"SELECT image_id, CAST(oy AS INT) AS y, CAST(ox AS INT) AS x, round(v, 7) AS v FROM ({area_sql('p', 'v')})"
)
def resample_area(spark, sf_dir):
    """Images of 64 x 64 on rasters of their own sizes, smaller and larger."""
    k = F.col("image_id")
    px = S.mosaic(spark, sf_dir).withColumns({"height": F.lit(64), "width": F.lit(64), "out_height": 23 + k % 30, "out_width": 17 + k * 13 % 90})
    return resample(px, ("v",)).select("image_id", "y", "x", F.round("v", 7).alias("v"))


_REF = f"SELECT image_id, y, x, r, g, b, 8 AS height, 4 + image_id % 5 AS width FROM ({S.LINEAR}) WHERE x < 4 + image_id % 5"
_CAND = f"SELECT image_id - 1 AS image_id, y, x, r, g, b, 3 + image_id % 6 AS height, 7 AS width FROM ({S.LINEAR}) WHERE y < 3 + image_id % 6 AND x < 7"
_OUT = "CASE WHEN width >= height THEN greatest(CAST(round(6.0::DOUBLE * height / width) AS BIGINT), 1) ELSE 6 END AS out_height, CASE WHEN width >= height THEN 6 ELSE greatest(CAST(round(6.0::DOUBLE * width / height) AS BIGINT), 1) END AS out_width"
_SIDE = lambda px, sizes: f"WITH p AS ({px}), o AS ({sizes}) SELECT image_id, oy AS y, ox AS x, r, g, b FROM ({area_sql('p', 'rgb')})"
_SIZED_R = f"SELECT DISTINCT image_id, height, width, {_OUT} FROM ({_REF})"
_SIZED_C = f"SELECT DISTINCT c.image_id, c.height, c.width, out_height, out_width FROM ({_CAND}) c JOIN ({_SIZED_R}) r ON c.image_id = r.image_id"
_LAB = lambda side: LAB_SQL.replace(f"({S.LINEAR})", f"({side})")
_SIZED = f"SELECT p.image_id, p.y, p.x, p.l AS l1, p.a AS a1, p.bb AS b1, q.l AS l2, q.a AS a2, q.bb AS b2 FROM ({_LAB(_SIDE(_REF, _SIZED_R))}) p JOIN ({_LAB(_SIDE(_CAND, _SIZED_C))}) q ON p.image_id = q.image_id AND p.y = q.y AND p.x = q.x"


@query(_de_sql(_SIZED) + " SELECT image_id, count(*) AS n, round(avg(de), 5) AS mean_de, round(sqrt(avg(de * de)), 5) AS rms_de, round(max(de), 5) AS max_de, round(avg(l2 - l1), 5) AS dl, round(avg(a2 - a1), 5) AS da, round(avg(b2 - b1), 5) AS db FROM de GROUP BY image_id")
def compare_sizes(spark, sf_dir):
    """Each image against the next one, both cut to different sizes."""
    k = F.col("image_id")
    px = S.linear(spark, sf_dir)
    references = px.withColumns({"height": F.lit(8), "width": 4 + k % 5}).where("x < width")
    candidates = px.withColumns({"height": 3 + k % 6, "width": F.lit(7)}).where("y < height and x < width").withColumn("image_id", k - 1)
    return compare(candidates, references, 6).select("image_id", "n", *(F.round(c, 5).alias(c) for c in ("mean_de", "rms_de", "max_de", "dl", "da", "db")))


@query(f"""WITH p AS (SELECT * FROM ({S.GRAY}) WHERE x < 4 + image_id % 5), o AS (SELECT vec_id AS image_id, label AS sheet, 8 AS height, 4 + vec_id % 5 AS width, 80 // (4 + vec_id % 5) AS out_height, 10 AS out_width FROM embeddings WHERE label IS NOT NULL),
t AS (SELECT image_id, sheet, CAST(sum(out_height + 8) OVER (PARTITION BY sheet ORDER BY image_id) - out_height - 8 AS BIGINT) AS top FROM o)
SELECT CAST(sheet AS BIGINT) AS sheet, top + oy AS y, ox AS x, round(v, 7) AS v FROM ({area_sql('p', 'v')}) JOIN t USING (image_id)
UNION ALL SELECT CAST(sheet AS BIGINT), top - g, x, 1.0 FROM t, range(1, 9) a(g), range(0, 10) b(x) WHERE top > 0""")
def contact_sheet_pixels(spark, sf_dir):
    """A sheet for each label, pictures of different shapes in order of their ids."""
    images = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.col("vec_id").alias("position"), F.col("label").cast("long").alias("sheet"), F.lit(8).alias("height"), (4 + F.col("vec_id") % 5).alias("width"))
    px = S.gray(spark, sf_dir).where("x < 4 + image_id % 5")
    return compose(px, images, 10, ("v",)).select("sheet", "y", "x", F.round("v", 7).alias("v"))
