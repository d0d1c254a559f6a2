"""Application rules over catalogs, jobs and caches: what is picked, skipped, listed, leased and laid out."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rasterlake.plans.registry import load, query


@query("SELECT p_brand, arg_max(version, struct_pack(r := rank, k := p_partkey)) AS version, max(rank) AS rank FROM (SELECT *, coalesce(try_cast(regexp_extract(version, '([0-9]+)$', 1) AS BIGINT), -1) AS rank FROM (SELECT p_brand, p_partkey, CASE WHEN p_size % 4 = 0 THEN 'none' ELSE 'v' || p_size END AS version FROM part)) GROUP BY 1")
def decoder_rank(spark, sf_dir):
    """The decoder with the highest number; those without one rank below all. A maximum with its row, no sort."""
    p = load(spark, sf_dir, "part").select("p_brand", "p_partkey", F.when(F.col("p_size") % 4 == 0, "none").otherwise(F.concat(F.lit("v"), F.col("p_size").cast("string"))).alias("version"))
    p = p.withColumn("rank", F.coalesce(F.regexp_extract("version", "([0-9]+)$", 1).try_cast("long"), F.lit(-1)))
    return p.groupBy("p_brand").agg(F.max_by("version", F.struct("rank", "p_partkey")).alias("version"), F.max("rank").alias("rank"))


#: Colour temperatures of the white-balance presets; those of the picture itself have none.
PRESETS = {"as_shot": None, "auto": None, "incandescent": 2850, "fluorescent": 3800, "sunlight": 5500, "flash": 5600, "cloudy": 6000, "overcast": 6500, "shade": 7500}
_PRESET_SQL = "(VALUES " + ", ".join(f"('{n}', {'NULL' if k is None else k})" for n, k in PRESETS.items()) + ") t(preset, kelvin)"


@query(f"SELECT preset, kelvin::BIGINT AS kelvin, kelvin || 'K' AS label, row_number() OVER (ORDER BY kelvin) AS place FROM {_PRESET_SQL} WHERE kelvin IS NOT NULL")
def wb_presets(spark, sf_dir):
    """The presets with a temperature, by temperature: a catalog of nine rows."""
    rows = spark.createDataFrame([(n, k) for n, k in PRESETS.items()], "preset string, kelvin long").where("kelvin is not null")
    return rows.select("preset", "kelvin", F.concat(F.col("kelvin").cast("string"), F.lit("K")).alias("label"), F.row_number().over(Window.orderBy("kelvin")).cast("long").alias("place"))


@query("SELECT p_partkey, p_size FROM (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey DESC) AS r FROM part) WHERE r <= 4")
def pool_cap(spark, sf_dir):
    """At most four pooled buffers of each size, the newest ones."""
    w = Window.partitionBy("p_size").orderBy(F.desc("p_partkey"))
    return load(spark, sf_dir, "part").select("p_partkey", "p_size", F.row_number().over(w).alias("r")).where("r <= 4").drop("r")


def is_lens(focal_min, focal_max, aperture, lens):
    """The 30 mm f/1.4: a prime of 29 to 31 mm and f/1.2 to 1.6 whose code is unknown or missing; anything missing else is no match."""
    unknown = lens.isNull() | (lens == 255)
    return F.coalesce(unknown & (F.abs(focal_max - focal_min) < 0.5) & (F.abs(focal_min - 30.0) <= 1.0) & aperture.between(1.2, 1.6), F.lit(False))


@query("""SELECT s_nationkey, bool_or(s_suppkey % 3 = 0) AND bool_or(s_suppkey % 5 = 0) AS newer_engine,
count(*) FILTER (WHERE coalesce((lens IS NULL OR lens = 255) AND abs(hi - lo) < 0.5 AND abs(lo - 30) <= 1 AND ap BETWEEN 1.2 AND 1.6, false)) AS lenses
FROM (SELECT *, 28.5 + s_suppkey % 5 * 0.75 AS lo, CASE WHEN s_suppkey % 7 > 0 THEN 28.5 + s_suppkey % 5 * 0.75 + s_suppkey % 2 * 20 END AS hi, 1 + s_suppkey % 8 / 10.0 AS ap, CASE WHEN s_suppkey % 3 > 0 THEN 254 + s_suppkey % 2 END AS lens FROM supplier) GROUP BY 1""")
def engine_predicates(spark, sf_dir):
    """Whether a camera has both lists of the newer engine, and how many shots are of a certain lens."""
    k = F.col("s_suppkey")
    lo = 28.5 + k % 5 * 0.75
    hit = is_lens(lo, F.when(k % 7 > 0, lo + k % 2 * 20), 1 + k % 8 / 10.0, F.when(k % 3 > 0, 254 + k % 2))
    return load(spark, sf_dir, "supplier").groupBy("s_nationkey").agg((F.bool_or(k % 3 == 0) & F.bool_or(k % 5 == 0)).alias("newer_engine"), F.count_if(hit).alias("lenses"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority ELSE coalesce(c_mktsegment, o_orderpriority) END AS setting FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def customised_update(spark, sf_dir):
    """New defaults reach only the rows that nobody has customised."""
    custom = F.col("o_orderkey") % 4 == 0
    defaults = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    rows = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return rows.join(defaults, "o_custkey", "left").select("o_orderkey", F.when(custom, F.col("o_orderpriority")).otherwise(F.coalesce("c_mktsegment", "o_orderpriority")).alias("setting"))


@query("""SELECT page_id, CASE WHEN x3f THEN 'heic,jpeg,png,dng,tiff' ELSE 'heic,jpeg,png' END AS formats, CASE WHEN x3f OR wanted NOT IN ('dng', 'tiff') THEN wanted ELSE 'heic' END AS used
FROM (SELECT page_id, page_id % 3 = 0 AS x3f, CASE page_id % 5 WHEN 0 THEN 'dng' WHEN 1 THEN 'tiff' WHEN 2 THEN 'jpeg' ELSE 'png' END AS wanted FROM pages)""")
def available_formats(spark, sf_dir):
    """Linear formats need a container; what is preferred but not available becomes HEIC."""
    formats = ["heic", "jpeg", "png", "dng", "tiff"]
    k = F.col("page_id")
    wanted = F.when(k % 5 == 0, "dng").when(k % 5 == 1, "tiff").when(k % 5 == 2, "jpeg").otherwise("png")
    able = F.filter(F.array(*map(F.lit, formats)), lambda f: (k % 3 == 0) | ~f.isin("dng", "tiff"))
    return load(spark, sf_dir, "pages").select("page_id", F.array_join(able, ",").alias("formats"), F.when(F.array_contains(able, wanted), wanted).otherwise("heic").alias("used"))


@query("SELECT o_orderkey, o_totalprice / 1000 AS exposure, CASE WHEN film THEN o_custkey % 20 END AS film, CASE WHEN film THEN o_orderpriority END AS paper, NOT film AND o_orderstatus = 'F' AS filmic FROM (SELECT *, o_orderkey % 4 = 1 AS film FROM orders)")
def settings_projection(spark, sf_dir):
    """Settings as the developer's options: film options only where film is on."""
    film = F.col("o_orderkey") % 4 == 1
    return load(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_totalprice") / 1000).alias("exposure"), F.when(film, F.col("o_custkey") % 20).alias("film"),
        F.when(film, F.col("o_orderpriority")).alias("paper"), (~film & (F.col("o_orderstatus") == "F")).alias("filmic"),
    )


@query("SELECT folder, string_agg(name, '|' ORDER BY name) AS files, count(*) AS n FROM (SELECT CASE WHEN page_id % 10 = 0 THEN 'explicit' ELSE 'folder' || page_id % 7 END AS folder, reverse(split_part(reverse(url || '.' || lpad(page_id::VARCHAR, 9, '0')), '/', 1)) AS name FROM pages WHERE page_id % 10 = 0 OR page_id % 3 > 0) GROUP BY 1")
def sorted_inputs(spark, sf_dir):
    """Inputs of each folder by their last path component; of a folder only known kinds count, a file named by itself always does."""
    k = F.col("page_id")
    named = F.concat("url", F.lit("."), F.lpad(k.cast("string"), 9, "0"))
    rows = load(spark, sf_dir, "pages").where((k % 10 == 0) | (k % 3 > 0)).select(F.when(k % 10 == 0, "explicit").otherwise(F.concat(F.lit("folder"), (k % 7).cast("string"))).alias("folder"), F.substring_index(named, "/", -1).alias("name"))
    return rows.groupBy("folder").agg(F.array_join(F.array_sort(F.collect_list("name")), "|").alias("files"), F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM events WHERE value > 0.1")
def ordered_import(spark, sf_dir):
    """Copies finish in any order and some fail; what arrived stands in the order of its source."""
    done = load(spark, sf_dir, "events").where("value > 0.1")
    return done.select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long").alias("place"))


@query("""WITH s AS (SELECT page_id, page_id * 31 % 11 AS kind, CASE WHEN page_id % 4 = 0 THEN 'clone' WHEN page_id % 4 = 1 AND page_id % 3 > 0 THEN 'copy' WHEN page_id % 4 < 3 THEN 'read' END AS how FROM pages)
SELECT page_id, CASE WHEN kind < 6 THEN 'x3f' WHEN kind < 9 THEN 'raw' END AS kind, how, row_number() OVER (ORDER BY page_id) AS place FROM s WHERE kind < 9 AND how IS NOT NULL""".replace(", row_number() OVER (ORDER BY page_id) AS place", ""))
def import_sources(spark, sf_dir):
    """An import takes files of known kinds and the first way to copy them that works: clone, copy, read; files that no way brings are left out."""
    k = F.col("page_id")
    kind = k * 31 % 11
    how = F.coalesce(F.when(k % 4 == 0, "clone"), F.when((k % 4 == 1) & (k % 3 > 0), "copy"), F.when(k % 4 < 3, "read"))
    rows = load(spark, sf_dir, "pages").select("page_id", F.when(kind < 6, "x3f").when(kind < 9, "raw").alias("kind"), how.alias("how"))
    return rows.where("kind is not null and how is not null")


@query("SELECT user_id, max(event_id) AS shown, count(*) AS revisions FROM events WHERE event_type <> 'purchase' GROUP BY 1")
def render_until_stable(spark, sf_dir):
    """Settings that change while a picture is rendered ask for another round; the last revision is what is shown in the end."""
    edits = load(spark, sf_dir, "events").where("event_type <> 'purchase'")
    return edits.groupBy("user_id").agg(F.max("event_id").alias("shown"), F.count(F.lit(1)).alias("revisions"))


@query("""WITH e AS (SELECT event_id, user_id, event_id % 3 < 2 AS begins FROM events), w AS (SELECT *, lag(begins) OVER (PARTITION BY user_id ORDER BY event_id) AS held FROM e)
SELECT event_id, NOT coalesce(held, false) AS granted FROM w WHERE begins""")
def single_writer_lease(spark, sf_dir):
    """A second editor of the same item is refused until the first one ends. A refused begin leaves the lease as it was, so
    the event before it tells whether the lease is held."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = load(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_id") % 3 < 2).alias("begins")).withColumn("held", F.lag("begins").over(w))
    return e.where("begins").select("event_id", (~F.coalesce("held", F.lit(False))).alias("granted"))


@query("SELECT v.vec_id, coalesce(s.bal, v.first) AS value, CASE WHEN s.bal IS NOT NULL THEN 'decoded' ELSE 'container' END AS source FROM (SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings) v LEFT JOIN (SELECT s_suppkey, s_acctbal AS bal FROM supplier) s ON s.s_suppkey = v.vec_id")
def frame_scan_cache(spark, sf_dir):
    """A frame that was decoded before is read from there, any other from its container."""
    done = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("vec_id"), F.col("s_acctbal").alias("bal"))
    raw = load(spark, sf_dir, "embeddings").select("vec_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))
    return raw.join(done, "vec_id", "left").select("vec_id", F.coalesce("bal", "first").alias("value"), F.when(F.col("bal").isNotNull(), "decoded").otherwise("container").alias("source"))


@query("""SELECT c_custkey, CASE WHEN m.k IS NOT NULL THEN 'memory' WHEN d.k IS NOT NULL AND d.rev >= c_custkey % 5 THEN 'disk' ELSE 'render' END AS source FROM customer
LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P') m ON m.k = c_custkey LEFT JOIN (SELECT o_custkey AS k, count(*) AS rev FROM orders GROUP BY 1) d ON d.k = c_custkey""")
def thumbnail_chain(spark, sf_dir):
    """A thumbnail comes from memory, else from disk unless its revision is too old, else it is rendered; one row an item, so nothing renders twice."""
    o = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("rev"), F.bool_or(F.col("o_orderstatus") == "P").alias("held"))
    source = F.when(F.coalesce("held", F.lit(False)), "memory").when(F.col("rev") >= F.col("c_custkey") % 5, "disk").otherwise("render")
    return load(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", source.alias("source"))


@query("SELECT n_name AS name, CASE WHEN n_nationkey % 4 = 0 THEN 'positive' ELSE 'negative' END AS kind, r_name AS paper FROM nation LEFT JOIN region ON r_regionkey = n_regionkey AND n_nationkey % 4 > 0")
def print_stocks(spark, sf_dir):
    """The catalog as it is listed: kind of each stock, and the paper of negatives."""
    n, r = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    positive = F.col("n_nationkey") % 4 == 0
    return n.join(F.broadcast(r), (F.col("r_regionkey") == F.col("n_regionkey")) & ~positive, "left").select(F.col("n_name").alias("name"), F.when(positive, "positive").otherwise("negative").alias("kind"), F.col("r_name").alias("paper"))


@query("""WITH s AS (SELECT p_brand, p_partkey, CAST(round((p_size + 3) * 640.0 / (p_size % 7 + 4)) AS BIGINT) AS h FROM part)
SELECT p_partkey, h AS height, CAST(sum(h + 8) OVER (PARTITION BY p_brand ORDER BY p_partkey) - h - 8 AS BIGINT) AS top FROM s""")
def contact_sheet(spark, sf_dir):
    """Pictures scaled to one width and stacked with gaps of 8: tops are prefix sums of heights, a sheet a brand."""
    h = F.round((F.col("p_size") + 3) * 640.0 / (F.col("p_size") % 7 + 4)).cast("long")
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    rows = load(spark, sf_dir, "part").select("p_brand", "p_partkey", h.alias("height"))
    return rows.select("p_partkey", "height", (F.sum(F.col("height") + 8).over(w) - F.col("height") - 8).alias("top"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'empty input' WHEN NOT x3f AND fmt IN ('dng', 'tiff') THEN 'format needs a container' END AS error,
CASE WHEN o_orderkey % 11 = 0 OR (NOT x3f AND fmt IN ('dng', 'tiff')) THEN NULL WHEN fmt IN ('dng', 'tiff') THEN 'decoder' WHEN x3f THEN 'cached develop' ELSE 'develop again' END AS route
FROM (SELECT o_orderkey, o_orderkey % 2 = 0 AS x3f, CASE o_orderkey % 5 WHEN 0 THEN 'dng' WHEN 1 THEN 'tiff' WHEN 2 THEN 'jpeg' WHEN 3 THEN 'png' ELSE 'heic' END AS fmt FROM orders)""")
def export_routes(spark, sf_dir):
    """Which way an export takes: linear formats come from the decoder, containers reuse their developed picture, others are developed again
    at full size; a job that cannot be done is a row with its error."""
    k = F.col("o_orderkey")
    x3f, linear = k % 2 == 0, (k % 5).isin(0, 1)
    error = F.when(k % 11 == 0, "empty input").when(~x3f & linear, "format needs a container")
    return load(spark, sf_dir, "orders").select("o_orderkey", error.alias("error"), F.when(error.isNull(), F.when(linear, "decoder").when(x3f, "cached develop").otherwise("develop again")).alias("route"))
