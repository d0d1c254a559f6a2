"""Naming, settings and catalog rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterlake.plans.registry import load, query


@query("SELECT page_id, lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) AS ext, CASE WHEN lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) = 'x3f' THEN 'x3f' WHEN lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) IN ('dng', 'nef', 'cr2', 'arw') THEN 'raw' WHEN lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) IN ('jpg', 'jpeg', 'png', 'tif', 'heic') THEN 'image' END AS kind FROM (SELECT page_id, url || CASE page_id % 4 WHEN 0 THEN '.X3F' WHEN 1 THEN '.jpg' WHEN 2 THEN '.Nef' ELSE '' END AS url FROM pages)")
def extension_filter(spark, sf_dir):
    tail = F.when(F.col("page_id") % 4 == 0, ".X3F").when(F.col("page_id") % 4 == 1, ".jpg").when(F.col("page_id") % 4 == 2, ".Nef").otherwise("")
    ext = F.lower(F.regexp_extract(F.concat("url", tail), r"\.([A-Za-z0-9]+)$", 1))
    kind = F.when(F.col("ext") == "x3f", "x3f").when(F.col("ext").isin("dng", "nef", "cr2", "arw"), "raw").when(F.col("ext").isin("jpg", "jpeg", "png", "tif", "heic"), "image")
    return load(spark, sf_dir, "pages").select("page_id", ext.alias("ext")).withColumn("kind", kind)


@query("SELECT p_partkey, try_cast(trim(split_part(s, 'to', 1)) AS DOUBLE) AS lo, coalesce(try_cast(trim(nullif(split_part(s, 'to', 2), '')) AS DOUBLE), try_cast(trim(split_part(s, 'to', 1)) AS DOUBLE)) AS hi FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN p_size || ' to ' || p_size * 3 ELSE 'bad to ' || p_size END AS s FROM part)")
def focal_range(spark, sf_dir):
    """``30`` or ``70 to 300``; what is no number is dropped."""
    size = F.col("p_size").cast("string")
    s = F.when(F.col("p_partkey") % 3 == 0, size).when(F.col("p_partkey") % 3 == 1, F.concat(size, F.lit(" to "), (F.col("p_size") * 3).cast("string"))).otherwise(F.concat(F.lit("bad to "), size))
    part = lambda k: F.trim(F.get(F.split(s, "to"), F.lit(k))).try_cast("double")
    return load(spark, sf_dir, "part").select("p_partkey", part(0).alias("lo"), F.coalesce(part(1), part(0)).alias("hi"))


@query("SELECT s_suppkey, CASE WHEN starts_with(upper(model), upper(maker)) THEN model ELSE maker || ' ' || model END AS camera FROM (SELECT s_suppkey, trim(split_part(s_name, '#', 1)) AS maker, CASE WHEN s_suppkey % 2 = 0 THEN lower(s_name) ELSE 'SD' || s_suppkey END AS model FROM supplier)")
def camera_name(spark, sf_dir):
    """Maker and model, the maker once."""
    maker = F.trim(F.get(F.split("s_name", "#"), F.lit(0)))
    model = F.when(F.col("s_suppkey") % 2 == 0, F.lower("s_name")).otherwise(F.concat(F.lit("SD"), F.col("s_suppkey").cast("string")))
    return load(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.startswith(F.upper(model), F.upper(maker)), model).otherwise(F.concat(maker, F.lit(" "), model)).alias("camera"))


@query("SELECT o_orderkey, hdr, tone OR hdr AS tone, kind = 'x3f' AND denoise AS denoise, CASE WHEN kind = 'x3f' THEN lens END AS lens FROM (SELECT o_orderkey, o_orderkey % 3 = 0 AS hdr, o_orderkey % 2 = 0 AS tone, o_orderkey % 7 < 4 AS denoise, CASE WHEN o_orderkey % 5 = 0 THEN 'x3f' ELSE 'raw' END AS kind, o_orderpriority AS lens FROM orders)")
def settings_invariants(spark, sf_dir):
    """HDR implies automatic tone; denoising and lens settings hold for one kind of file only."""
    k = F.col("o_orderkey")
    x3f = k % 5 == 0
    return load(spark, sf_dir, "orders").select("o_orderkey", (k % 3 == 0).alias("hdr"), ((k % 2 == 0) | (k % 3 == 0)).alias("tone"), (x3f & (k % 7 < 4)).alias("denoise"), F.when(x3f, F.col("o_orderpriority")).alias("lens"))


def tile_decision(zoom, applied_px, shown_px, padded_px, base_px, most_px):
    """What to do about a zoom tile: none is needed up to a zoom of 1.02; an applied one stays if it has 95 % of the pixels shown; a new one
    is asked for only if it has 5 % more pixels than the base image gives to the region."""
    capped = F.least(F.ceil(padded_px), most_px)
    return F.when(zoom <= 1.02, "rescind").when(applied_px >= shown_px * 0.95, "keep").when(capped > base_px * 1.05, "request").otherwise("rescind"), capped


@query("SELECT p_partkey, CASE WHEN zoom <= 1.02 THEN 'rescind' WHEN applied >= shown * 0.95 THEN 'keep' WHEN least(ceil(padded), 4096) > base * 1.05 THEN 'request' ELSE 'rescind' END AS decision, CAST(least(ceil(padded), 4096) AS BIGINT) AS pixels, CAST(greatest(ceil(p_retailprice * 2 / 256) * 256, 1280) AS BIGINT) AS preview FROM (SELECT *, p_size / 12.0 AS zoom, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice END AS applied, p_size * 40.0 AS shown, p_size * 48.5 AS padded, p_retailprice AS base FROM part)")
def tile_policy(spark, sf_dir):
    size, price = F.col("p_size"), F.col("p_retailprice")
    what, pixels = tile_decision(size / 12.0, F.when(F.col("p_partkey") % 3 == 0, price), size * 40.0, size * 48.5, price, F.lit(4096))
    return load(spark, sf_dir, "part").select("p_partkey", what.alias("decision"), pixels.cast("long").alias("pixels"), F.greatest(F.ceil(price * 2 / 256) * 256, F.lit(1280)).cast("long").alias("preview"))


@query("SELECT p_partkey, pow(0.5, greatest(0, floor(log2(longest / 1600.0)))) AS scale FROM (SELECT p_partkey, p_size * 300.5 AS longest FROM part)")
def proxy_scale(spark, sf_dir):
    """Halve while the longest side stays above the cap, in closed form."""
    return load(spark, sf_dir, "part").select("p_partkey", F.pow(F.lit(0.5), F.greatest(F.lit(0), F.floor(F.log2(F.col("p_size") * 300.5 / 1600.0))).cast("double")).alias("scale"))


@query("SELECT p_partkey, CASE WHEN l < r AND t < b THEN l END AS l, CASE WHEN l < r AND t < b THEN t END AS t, CASE WHEN l < r AND t < b THEN r END AS r, CASE WHEN l < r AND t < b THEN b END AS b FROM (SELECT p_partkey, greatest(p_size, 10) AS l, greatest(p_size // 2, 4) AS t, least(p_size + 20, 50) AS r, least(p_size + 5, 30) AS b FROM part)")
def rect_intersection(spark, sf_dir):
    p = load(spark, sf_dir, "part").select(
        "p_partkey", F.greatest("p_size", F.lit(10)).alias("l"), F.greatest(F.floor(F.col("p_size") / 2).cast("int"), F.lit(4)).alias("t"), F.least(F.col("p_size") + 20, F.lit(50)).alias("r"), F.least(F.col("p_size") + 5, F.lit(30)).alias("b")
    )
    ok = (F.col("l") < F.col("r")) & (F.col("t") < F.col("b"))
    return p.select("p_partkey", *(F.when(ok, F.col(c)).alias(c) for c in "ltrb"))


@query("SELECT user_id, event_type, arg_max(event_id, struct_pack(a := rev, b := event_id)) AS written, max(rev) AS revision FROM (SELECT *, event_id % 10 AS rev FROM events) GROUP BY 1, 2")
def revision_cache(spark, sf_dir):
    """A cache write counts only if its revision is not older than what is stored."""
    rev = F.col("event_id") % 10
    return load(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct(rev, "event_id")).alias("written"), F.max(rev).alias("revision"))


@query("SELECT '{\"total\":' || count(*) || ',\"late\":' || count(*) FILTER (WHERE l_linestatus = 'F') || '}' AS line FROM lineitem")
def json_metric_line(spark, sf_dir):
    s = load(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("l_linestatus") == "F").alias("late"))
    return s.select(F.to_json(F.struct("total", "late")).alias("line"))
