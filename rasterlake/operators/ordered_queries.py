"""Ordered recurrences, caches and layout plans as windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rasterlake.plans.registry import load, query
from rasterlake.sources import surrogates as S


def wrap16(v: Column) -> Column:
    """A sum as a signed 16-bit number: wrapping once after a prefix sum is the same as wrapping each step."""
    return F.pmod(v + 32768, F.lit(65536)) - 32768


_ROW = "PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice"


def _running():
    return Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, Window.currentRow)



@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ((s + 32768) % 65536 + 65536) % 65536 - 32768 AS sample FROM (SELECT *, CAST(sum(CAST(floor(l_extendedprice) AS BIGINT) * CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END) OVER ({_ROW} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS s FROM lineitem)")
def delta_decode_wrap(spark, sf_dir):
    d = F.floor("l_extendedprice") * F.when(F.col("l_linenumber") % 2 == 0, -1).otherwise(1)
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", wrap16(F.sum(d).over(_running())).alias("sample"))


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN s % 65536 >= 32768 OR s % 65536 <= 0 THEN 0 ELSE s % 65536 END AS sample FROM (SELECT *, CAST(sum(CAST(floor(l_quantity * 1000) AS BIGINT)) OVER ({_ROW} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS s FROM lineitem)")
def packed_decode_clamp(spark, sf_dir):
    """A running unsigned 16-bit sum; only the output is clamped, the running sum is not."""
    s = F.pmod(F.sum(F.floor(F.col("l_quantity") * 1000)).over(_running()), F.lit(65536))
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when((s >= 32768) | (s <= 0), 0).otherwise(s).alias("sample"))


@query("SELECT user_id, last_touch FROM (SELECT user_id, max(ts) AS last_touch FROM events GROUP BY 1) ORDER BY last_touch DESC, user_id LIMIT 64")
def lru_keep64(spark, sf_dir):
    """The 64 keys touched last: a top-k over partial maxima, no global sort."""
    return load(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last_touch")).orderBy(F.desc("last_touch"), "user_id").limit(64)


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS slot FROM events QUALIFY slot <= 3")
def mru_keep3(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"))
    return load(spark, sf_dir, "events").select("user_id", "event_id", F.row_number().over(w).cast("long").alias("slot")).where("slot <= 3")


@query("SELECT event_id FROM (SELECT event_id, value, max(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events) WHERE before IS NULL OR value > before")
def monotone_progress(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    return load(spark, sf_dir, "events").withColumn("before", F.max("value").over(w)).where("before is null or value > before").select("event_id")


@query("SELECT page_id, strlen(html) AS size, CAST(sum(strlen(html) + strlen(html) % 2) OVER (ORDER BY page_id) - strlen(html) - strlen(html) % 2 + 8 AS BIGINT) AS at FROM pages".replace(" AS at", " AS pos"))
def ifd_offsets(spark, sf_dir):
    """Offsets of even-aligned blocks. The running sum goes over cells of ids at two levels: sums of cells of cells, of cells, then
    inside each, so the one window over everything sees a row for each four million ids."""
    size = F.octet_length("html").cast("long")
    rows = load(spark, sf_dir, "pages").select("page_id", size.alias("size"), (size + size % 2).alias("even"))
    cells = rows.withColumn("cell", F.floor(F.col("page_id") / 2048))
    before = lambda w, order: w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    running = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    sums = cells.groupBy("cell").agg(F.sum("even").alias("s")).withColumn("big", F.floor(F.col("cell") / 2048))
    big = sums.groupBy("big").agg(F.sum("s").alias("s")).select("big", running("s", before(Window.partitionBy(F.lit(0)), "big")).alias("far"))
    base = sums.join(big, "big").select("cell", (F.col("far") + running("s", before(Window.partitionBy("big"), "cell"))).alias("base"))
    inside = Window.partitionBy("cell").orderBy("page_id").rowsBetween(Window.unboundedPreceding, -1)
    return cells.join(base, "cell").select("page_id", "size", (F.lit(8) + F.col("base") + F.coalesce(F.sum("even").over(inside), F.lit(0))).alias("pos"))


@query("SELECT l_orderkey, list(l_partkey ORDER BY l_partkey, l_linenumber)[1] AS first_tag, list(l_partkey ORDER BY l_partkey, l_linenumber)[-1] AS last_tag, count(*) AS n FROM lineitem GROUP BY 1")
def ifd_sort(spark, sf_dir):
    """Fields of a directory in order of their tags."""
    f = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_partkey", "l_linenumber"))).alias("f"))
    return f.select("l_orderkey", F.col("f")[0]["l_partkey"].alias("first_tag"), F.element_at("f", -1)["l_partkey"].alias("last_tag"), F.size("f").cast("long").alias("n"))


def tile_positions(size: Column, tile: int, step: int) -> Column:
    """Starts of tiles that cover ``size``; the last one is pinned to the end."""
    last = F.greatest(size - tile, F.lit(0))
    return F.array_union(F.sequence(F.lit(0), last, F.lit(step)), F.array(last))


@query("SELECT p_partkey, t AS start FROM (SELECT p_partkey, unnest(list_distinct(list_concat(range(0, greatest(p_size - 16, 0) + 1, 12), [greatest(p_size - 16, 0)]))) AS t FROM part)")
def tile_starts(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", F.explode(tile_positions(F.col("p_size").cast("int"), 16, 12)).alias("start")).withColumn("start", F.col("start").cast("long"))


@query("SELECT user_id, event_id AS final_id, generation FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r, count(*) OVER (PARTITION BY user_id) AS generation FROM events) WHERE r = 1")
def latest_wins_batch(spark, sf_dir):
    """The newest request of each session: a max with its row, one partial aggregate."""
    return load(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_id", "ts").alias("final_id"), F.count(F.lit(1)).alias("generation"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice IS NULL THEN NULL ELSE struct_pack(k := o_custkey, h := CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END) END::VARCHAR IS NOT NULL AS has_key, md5(concat_ws('|', o_custkey, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE '' END)) AS render_key FROM orders")
def settings_key(spark, sf_dir):
    """A cache key over the settings that matter: those that cannot change the pixels are blanked before hashing."""
    key = F.md5(F.concat_ws("|", F.col("o_custkey").cast("string"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).otherwise("")))
    return load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").isNotNull().alias("has_key"), key.alias("render_key"))


@query(f"SELECT image_id, y - 2 AS y, x - 3 AS x, round(v, 6) AS v FROM ({S.GRAY}) WHERE y BETWEEN 2 AND 6 AND x BETWEEN 3 AND 7")
def region_crop(spark, sf_dir):
    """A rectangle of the unit square, snapped to whole pixels."""
    px = S.gray(spark, sf_dir)
    return crop(px, 0.25, 0.375, 0.625, 0.625, S.SIDE, S.SIDE).select("image_id", "y", "x", F.round("v", 6).alias("v"))


def crop(px, top: float, left: float, height: float, width: float, h: int, w: int):
    y0, x0 = min(max(round(top * h), 0), h - 1), min(max(round(left * w), 0), w - 1)
    y1, x1 = max(y0 + 1, min(h, round((top + height) * h))), max(x0 + 1, min(w, round((left + width) * w)))
    inside = px.where(F.col("y").between(y0, y1 - 1) & F.col("x").between(x0, x1 - 1))
    return inside.withColumns({"y": F.col("y") - y0, "x": F.col("x") - x0})
