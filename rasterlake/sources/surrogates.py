"""Rasters and keyed tables derived from the shared input tables.

``embeddings`` holds dense rows of 64 numbers: one 8 x 8 single-channel image each, three of them a
colour image. Colour images are put together with one shuffle of whole rows by image, then
exploded to pixels in place, so no per-pixel shuffle happens before an operator needs one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.plans.registry import load

SIDE = 8


def gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(image_id, y, x, v)``: one image for each vector."""
    px = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("i", "v"))
    return px.select("image_id", F.floor(F.col("i") / SIDE).cast("int").alias("y"), (F.col("i") % SIDE).alias("x"), F.col("v").cast("double").alias("v"))


def gray_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(image_id, rows)``: the images of ``gray`` as arrays of rows. A vector holds its whole image, so nothing is shuffled."""
    v = load(spark, sf_dir, "embeddings").where(F.size("embedding") > 0).select(F.col("vec_id").alias("image_id"), F.col("embedding").cast("array<double>").alias("v"))
    return v.select("image_id", F.transform(F.sequence(F.lit(0), F.floor((F.size("v") - 1) / SIDE).cast("int")), lambda y: F.slice("v", y * SIDE + 1, SIDE)).alias("rows"))


def mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(image_id, y, x, v)``: images of 64 x 64, eight by eight vectors each; the last image may lack pixels."""
    k = F.col("image_id") % 64
    px = gray(spark, sf_dir).withColumns({"y": (F.floor(k / SIDE) * SIDE + F.col("y")).cast("int"), "x": (k % SIDE * SIDE + F.col("x")).cast("int")})
    return px.withColumn("image_id", F.floor(F.col("image_id") / 64))


def raw12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(image_id, y, x, s)``: 12-bit samples."""
    return gray(spark, sf_dir).select("image_id", "y", "x", F.floor((F.col("v") + 1) * 2047.5).cast("int").alias("s"))


def colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(image_id, y, x, c0, c1, c2)``: 12-bit samples of three vectors; incomplete triples go."""
    v = load(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 3).alias("image_id"), (F.col("vec_id") % 3).alias("ch"), "embedding")
    rows = v.groupBy("image_id").agg(*(F.max(F.when(F.col("ch") == c, F.col("embedding"))).alias(f"e{c}") for c in range(3)))
    rows = rows.where("e0 is not null and e1 is not null and e2 is not null")
    px = rows.select("image_id", F.posexplode(F.arrays_zip("e0", "e1", "e2")).alias("i", "e"))
    sample = lambda c: F.floor((F.col(f"e.e{c}").cast("double") + 1) * 2047.5).cast("int").alias(f"c{c}")
    return px.select("image_id", F.floor(F.col("i") / SIDE).cast("int").alias("y"), (F.col("i") % SIDE).alias("x"), *map(sample, range(3)))


def linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(image_id, y, x, r, g, b)``: samples over 4095."""
    return colour(spark, sf_dir).select("image_id", "y", "x", *((F.col(f"c{k}") / 4095.0).alias(c) for k, c in enumerate("rgb")))


def scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(v)``: positive samples with a wide range."""
    return load(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") / 100000).alias("v"))


#: The same tables as SQL, for the checks.
GRAY = "SELECT vec_id AS image_id, CAST(floor((i - 1) / 8) AS INT) AS y, CAST((i - 1) % 8 AS INT) AS x, CAST(v AS DOUBLE) AS v FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)"
MOSAIC = f"SELECT image_id // 64 AS image_id, CAST(image_id % 64 // 8 * 8 + y AS INT) AS y, CAST(image_id % 8 * 8 + x AS INT) AS x, v FROM ({GRAY})"
RAW12 = f"SELECT image_id, y, x, CAST(floor((v + 1) * 2047.5) AS INT) AS s FROM ({GRAY})"
COLOUR = f"SELECT CAST(floor(image_id / 3) AS BIGINT) AS image_id, y, x, max(CASE WHEN image_id % 3 = 0 THEN s END) AS c0, max(CASE WHEN image_id % 3 = 1 THEN s END) AS c1, max(CASE WHEN image_id % 3 = 2 THEN s END) AS c2 FROM ({RAW12}) GROUP BY 1, 2, 3 HAVING count(*) = 3"
LINEAR = f"SELECT image_id, y, x, c0 / 4095.0 AS r, c1 / 4095.0 AS g, c2 / 4095.0 AS b FROM ({COLOUR})"
SCENE = "SELECT l_extendedprice / 100000 AS v FROM lineitem"
