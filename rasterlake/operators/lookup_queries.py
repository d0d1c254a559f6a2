"""Keyed, nearest, range and bracketing lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rasterlake.plans.registry import load, query
from rasterlake.plans.shared import written
from rasterlake.sources import surrogates as S


def between(samples: DataFrame, grid: DataFrame, x: str, keys: list[str]) -> DataFrame:
    """Adds the two knots ``gx, gy`` and ``hx, hy`` of the same keys around x, the first two alone before the first knot and from the last one on; all null
    where x or a key is null, or where the grid has no knot of the keys. Every sample gives one row; a grid has each knot once.

    The grid becomes half-open intervals [gx, hx), the first and the last open-ended; every x lies in exactly one. The range of a key is cut
    into as many cells as it has knots, and an interval stands in each cell it touches: intervals are disjoint, so these are at most
    two rows a knot. A sample then finds its interval by (keys, cell), an equi-join at any size, and no key sits in one task."""
    w = Window.partitionBy(*keys).orderBy("gx")
    every = Window.partitionBy(*keys)
    knots = grid.where(F.col("gx").isNotNull()).select(
        *(F.col(k).alias(f"_{k}") for k in keys), "gx", "gy", F.lead("gx").over(w).alias("hx"), F.lead("gy").over(w).alias("hy"),
        (F.row_number().over(w) == 1).alias("_first"), F.min("gx").over(every).alias("_lo"), F.max("gx").over(every).alias("_hi"), F.count(F.lit(1)).over(every).alias("_cells"),
    )
    cell = lambda v, lo, hi, n: F.when(hi > lo, F.least(F.greatest(F.floor((v - lo) / (hi - lo) * n), F.lit(0)), n - 1)).otherwise(0).cast("long")
    of = lambda v: cell(v, F.col("_lo"), F.col("_hi"), F.col("_cells"))
    cells = knots.withColumn("_cell", F.explode(F.sequence(of(F.col("gx")), F.coalesce(of(F.col("hx")), F.col("_cells") - 1))))
    ranges = knots.where("_first").select(*(F.col(f"_{k}").alias(f"_r_{k}") for k in keys), "_lo", "_hi", "_cells")
    placed = samples.join(ranges, [F.col(k) == F.col(f"_r_{k}") for k in keys], "left").withColumn("_at", F.when(F.col(x).isNotNull(), of(F.col(x)))).drop("_lo", "_hi", "_cells", *(f"_r_{k}" for k in keys))
    inside = ((F.col(x) >= F.col("gx")) | F.col("_first")) & (F.col("hx").isNull() | (F.col(x) < F.col("hx")))
    joined = placed.join(cells.drop("_lo", "_hi", "_cells"), [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col("_at") == F.col("_cell"), inside], "left")
    return joined.drop("_first", "_cell", "_at", *(f"_{k}" for k in keys))


def bracket(samples: DataFrame, grid: DataFrame, x: str, keys: list[str]) -> DataFrame:
    """Adds ``value``: the grid's y at x, linear between the two nearest knots of the same keys, held at both ends; null where ``between`` finds no knot."""
    t = F.when(F.col("hx").isNull() | (F.col(x) <= F.col("gx")), F.lit(0.0)).otherwise((F.col(x) - F.col("gx")) / (F.col("hx") - F.col("gx")))
    return between(samples, grid, x, keys).withColumn("value", F.col("gy") + t * (F.coalesce("hy", "gy") - F.col("gy"))).drop("gx", "gy", "hx", "hy")


@query("SELECT c_custkey, coalesce(r.r_name, d.r_name) AS region FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey AND n.n_nationkey % 5 <> 0 LEFT JOIN region r ON r.r_regionkey = n.n_regionkey, (SELECT r_name FROM region WHERE r_regionkey = 0) d")
def wb_two_hop(spark, sf_dir):
    """Name to matrix name to matrix, with a fallback where a hop is missing; both dimensions have fixed sizes."""
    nation, region = load(spark, sf_dir, "nation").where("n_nationkey % 5 <> 0"), load(spark, sf_dir, "region")
    chain = nation.join(F.broadcast(region), F.col("r_regionkey") == F.col("n_regionkey"), "left").select("n_nationkey", "r_name")
    fall = region.where("r_regionkey = 0").select(F.col("r_name").alias("fallback"))
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return c.join(F.broadcast(chain), F.col("c_nationkey") == F.col("n_nationkey"), "left").crossJoin(F.broadcast(fall)).select("c_custkey", F.coalesce("r_name", "fallback").alias("region"))


_PRIORITY = {"click": 1, "view": 2, "purchase": 3}


@query("SELECT user_id, arg_min(event_type, p * 10000000 + event_id) AS name FROM (SELECT *, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 ELSE 9 END AS p FROM events) GROUP BY user_id")
def wb_resolve(spark, sf_dir):
    """The first available name in priority order for each key."""
    p = F.lit(9)
    for name, k in reversed(_PRIORITY.items()):
        p = F.when(F.col("event_type") == name, k).otherwise(p)
    return load(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by("event_type", F.struct(p, "event_id")).alias("name"))


@query("SELECT vec_id, coalesce(s.v, g.v) AS gain FROM embeddings e LEFT JOIN (SELECT s_nationkey AS k, round(max(s_acctbal), 2) AS v FROM supplier WHERE s_nationkey < 5 GROUP BY 1) s ON s.k = e.label, (SELECT round(max(s_acctbal), 2) AS v FROM supplier) g")
def gain_default(spark, sf_dir):
    """A gain of the own key, or the global one."""
    sup = load(spark, sf_dir, "supplier")
    own = sup.where("s_nationkey < 5").groupBy(F.col("s_nationkey").alias("label")).agg(F.round(F.max("s_acctbal"), 2).alias("own"))
    return load(spark, sf_dir, "embeddings").select("vec_id", "label").join(own, "label", "left").crossJoin(F.broadcast(sup.agg(F.round(F.max("s_acctbal"), 2).alias("all")))).select("vec_id", F.coalesce("own", "all").alias("gain"))


def range_match(shots: DataFrame, profiles: DataFrame, rel: float = 0.06) -> DataFrame:
    """``(shot_id, name)``: the profile with both focal ends within ``rel`` of the larger and the nearest aperture, first index on ties; a distance of null comes last.

    Logarithmic cells of both ends turn the range condition into an equi-join: ends within rel of each
    other are in the same or neighbouring cells, so a focal range asks 3 x 3 cells whatever the tables' sizes are. Focal ranges meet, not
    rows: of a range's profiles with one aperture the first index is the only one that can be asked for, so what a range of shots may choose from is a
    row for each aperture, and a shot finds the two around its own by ``between``. No shot meets more than these two, whatever the number of profiles."""
    import math

    step = math.log(1 / (1 - rel))
    cell = lambda c: F.floor(F.log(c) / step)
    ends = ("zoom", "f0", "f1")
    asked = shots.select(*ends).distinct().select("*", cell("f0").alias("c0"), cell("f1").alias("c1"))
    around = F.explode(F.flatten(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda i: F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda j: F.struct((F.col("c0") + i).alias("k0"), (F.col("c1") + j).alias("k1"))))))
    asked = asked.select(*ends, around.alias("k"))
    first = F.min(F.struct("idx", "name")).alias("gy")
    side = profiles.groupBy(F.col("zoom").alias("pz"), F.col("f0").alias("p0"), F.col("f1").alias("p1"), F.col("aperture").alias("gx")).agg(first)
    side = side.select("*", cell("p0").alias("k0"), cell("p1").alias("k1"))
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= rel * F.greatest(a, b)
    hit = asked.join(side, (F.col("k.k0") == F.col("k0")) & (F.col("k.k1") == F.col("k1")) & (F.col("zoom") == F.col("pz"))).where(near("f0", "p0") & near("f1", "p1"))
    choice = written(hit.groupBy(*ends, "gx").agg(F.min("gy").alias("gy")), "range-match")

    # apertures so close that two distances round to one may hold the tie's first index beyond the nearest two, and a shot without an aperture has no nearest: these see the whole choice of their range
    fine = choice.where("gx is not null and not isnan(double(gx))")
    w = Window.partitionBy(*ends).orderBy("gx")
    fine = fine.select(*ends, "gx", F.struct("gy.idx", "gy.name", F.lag("gx").over(w).alias("below"), F.lead("gx").over(w).alias("above")).alias("gy"))
    found = between(shots.select("shot_id", *ends, "aperture"), fine, "aperture", list(ends))
    low, high, a = F.col("gy"), F.col("hy"), F.col("aperture")
    d_low, d_high = F.abs(a - F.col("gx")), F.abs(a - F.col("hx"))
    d = F.coalesce(F.least(d_low, d_high), d_low)
    even = lambda other: F.coalesce(F.abs(a - other) <= d, F.lit(False))
    open_ = low.isNull() | F.isnan(a.cast("double")) | even(low["below"]) | even(high["above"])
    pick = F.when(high.isNotNull() & ((d_high < d_low) | ((d_high == d_low) & (high["idx"] < low["idx"]))), F.struct(d_high.alias("d"), high["idx"].alias("idx"), high["name"].alias("name")))
    pick = pick.otherwise(F.struct(d_low.alias("d"), low["idx"].alias("idx"), low["name"].alias("name")))
    found = found.select("shot_id", *ends, "aperture", open_.alias("open"), pick.alias("hit"))
    gap = F.abs(F.col("aperture") - F.col("gx"))
    rest = found.where("open").select("shot_id", *ends, "aperture").join(choice, list(ends)).select("shot_id", F.struct(gap.alias("d"), "gy.idx", "gy.name").alias("hit"))
    all_ = found.where("not open").select("shot_id", "hit").unionByName(rest)
    return all_.groupBy("shot_id").agg(F.min_by("hit.name", F.struct(F.col("hit.d").isNull(), "hit.d", "hit.idx")).alias("name"))


@query("""WITH s AS (SELECT p_partkey AS shot_id, p_size % 2 = 0 AS zoom, p_size::DOUBLE AS f0, p_size * 2.0 AS f1, p_retailprice / 500 AS a FROM part),
p AS (SELECT s_suppkey AS idx, s_name AS name, s_suppkey % 2 = 0 AS zoom, 1 + (s_suppkey * 7) % 50 * 1.02 AS f0, 2 + (s_suppkey * 7) % 50 * 2.04 AS f1, 1.2 + s_suppkey % 9 / 10.0 AS a FROM supplier),
m AS (SELECT shot_id, name, row_number() OVER (PARTITION BY shot_id ORDER BY abs(s.a - p.a), idx) AS r FROM s JOIN p ON s.zoom = p.zoom AND abs(s.f0 - p.f0) <= 0.06 * greatest(s.f0, p.f0) AND abs(s.f1 - p.f1) <= 0.06 * greatest(s.f1, p.f1))
SELECT s.shot_id, m.name FROM s LEFT JOIN m ON m.shot_id = s.shot_id AND r = 1""")
def lens_range_match(spark, sf_dir):
    shots = load(spark, sf_dir, "part").selectExpr("p_partkey AS shot_id", "p_size % 2 = 0 AS zoom", "double(p_size) AS f0", "p_size * 2.0D AS f1", "p_retailprice / 500 AS aperture")
    prof = load(spark, sf_dir, "supplier").selectExpr("s_suppkey AS idx", "s_name AS name", "s_suppkey % 2 = 0 AS zoom", "1 + (s_suppkey * 7) % 50 * 1.02D AS f0", "2 + (s_suppkey * 7) % 50 * 2.04D AS f1", "1.2D + s_suppkey % 9 / 10.0D AS aperture")
    return shots.select("shot_id").join(range_match(shots, prof), "shot_id", "left").select("shot_id", "name")


_GRID = "SELECT s_nationkey % 3 AS k, floor(s_acctbal / 100) AS gx, avg(s_acctbal * 2 + s_suppkey) AS gy FROM supplier GROUP BY 1, 2"


@query(f"""WITH g AS (SELECT k, gx, gy, lead(gx) OVER w AS hx, lead(gy) OVER w AS hy, row_number() OVER w AS n FROM ({_GRID}) WINDOW w AS (PARTITION BY k ORDER BY gx)),
c AS (SELECT c_custkey, c_nationkey % 3 AS k, c_acctbal / 97.3 AS x FROM customer)
SELECT c_custkey, round(gy + CASE WHEN hx IS NULL OR x <= gx THEN 0 ELSE (x - gx) / (hx - gx) END * (coalesce(hy, gy) - gy), 5) AS value FROM c JOIN g ON g.k = c.k AND (x >= gx OR n = 1) AND (hx IS NULL OR x < hx)""")
def bracket_interp(spark, sf_dir):
    grid = load(spark, sf_dir, "supplier").groupBy((F.col("s_nationkey") % 3).alias("k"), F.floor(F.col("s_acctbal") / 100).cast("double").alias("gx")).agg(F.avg(F.col("s_acctbal") * 2 + F.col("s_suppkey")).alias("gy"))
    rows = load(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") % 3).alias("k"), (F.col("c_acctbal") / 97.3).alias("x"))
    return bracket(rows, grid, "x", ["k"]).select("c_custkey", F.round("value", 5).alias("value"))


def bilinear(points: DataFrame, grid: DataFrame, keys: list[str], rows: int, cols: int) -> DataFrame:
    """Adds ``value``: the grid (keys, gr, gc, g) at fractional (u, v), clamped. The grid is folded to one array per key, so a point needs one join instead of four."""
    folded = grid.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("gr", "gc", "g"))), lambda t: t["g"]).alias("_g"))
    j = points.join(folded, keys)
    r0, c0 = (F.least(F.greatest(F.floor(v), F.lit(0)), F.lit(n - 2)) for v, n in ((F.col("v"), rows), (F.col("u"), cols)))
    j = j.withColumn("_r", r0.cast("int")).withColumn("_c", c0.cast("int"))
    fy, fx = F.least(F.col("v") - F.col("_r"), F.lit(1.0)), F.least(F.col("u") - F.col("_c"), F.lit(1.0))
    at = lambda dr, dc: F.get("_g", (F.col("_r") + dr) * cols + F.col("_c") + dc)
    top, low = at(0, 0) * (1 - fx) + at(0, 1) * fx, at(1, 0) * (1 - fx) + at(1, 1) * fx
    return j.withColumn("value", top * (1 - fy) + low * fy).drop("_g", "_r", "_c")


@query(f"""WITH p AS ({S.GRAY}), g AS (SELECT image_id % 7 AS k, y AS gr, x AS gc, avg(v) AS g FROM p WHERE y < 4 AND x < 4 GROUP BY 1, 2, 3),
q AS (SELECT image_id, y, x, image_id % 7 AS k, x * 3 / 7.0 AS u, y * 3 / 7.0 AS v FROM p), r AS (SELECT *, least(floor(v), 2) AS r0, least(floor(u), 2) AS c0 FROM q)
SELECT image_id, y, x, round((a.g * (1 - (u - c0)) + b.g * (u - c0)) * (1 - (v - r0)) + (c.g * (1 - (u - c0)) + d.g * (u - c0)) * (v - r0), 7) AS gain FROM r
JOIN g a ON a.k = r.k AND a.gr = r0 AND a.gc = c0 JOIN g b ON b.k = r.k AND b.gr = r0 AND b.gc = c0 + 1 JOIN g c ON c.k = r.k AND c.gr = r0 + 1 AND c.gc = c0 JOIN g d ON d.k = r.k AND d.gr = r0 + 1 AND d.gc = c0 + 1""")
def bilinear_gain(spark, sf_dir):
    px = S.gray(spark, sf_dir).withColumn("k", F.col("image_id") % 7)
    grid = px.where("y < 4 and x < 4").groupBy("k", F.col("y").alias("gr"), F.col("x").alias("gc")).agg(F.avg("v").alias("g"))
    pts = px.select("image_id", "y", "x", "k", (F.col("x") * 3 / 7.0).alias("u"), (F.col("y") * 3 / 7.0).alias("v"))
    return bilinear(pts, grid, ["k"], 4, 4).select("image_id", "y", "x", F.round("value", 7).alias("gain"))


@query("SELECT q, CASE WHEN n_exact > 0 THEN 'exact' WHEN n_part = 0 THEN 'none' WHEN n_part = 1 THEN 'unique' ELSE 'ambiguous' END AS status, CASE WHEN n_exact > 0 OR n_part = 1 THEN hit END AS name FROM (SELECT q, count(DISTINCT CASE WHEN lower(p_name) = q THEN p_name END) AS n_exact, count(DISTINCT CASE WHEN contains(lower(p_name), q) THEN p_name END) AS n_part, coalesce(min(CASE WHEN lower(p_name) = q THEN p_name END), min(CASE WHEN contains(lower(p_name), q) THEN p_name END)) AS hit FROM part, (SELECT unnest(['red', 'zzz', (SELECT lower(min(p_name)) FROM part), (SELECT lower(max(p_name)) FROM part)]) AS q) GROUP BY q)")
def catalog_search(spark, sf_dir):
    """Exact name, else a unique part of a name; no hit and several hits are told apart."""
    part = load(spark, sf_dir, "part").select("p_name").distinct()
    ends = part.agg(F.array(F.lit("red"), F.lit("zzz"), F.lower(F.min("p_name")), F.lower(F.max("p_name"))).alias("a")).select(F.explode("a").alias("q"))
    low, q = F.lower("p_name"), F.col("q")
    c = part.crossJoin(F.broadcast(ends)).groupBy("q").agg(
        F.count_if(low == q).alias("exact"), F.count_if(low.contains(q)).alias("some"), F.coalesce(F.min(F.when(low == q, F.col("p_name"))), F.min(F.when(low.contains(q), F.col("p_name")))).alias("hit")
    )
    status = F.when(F.col("exact") > 0, "exact").when(F.col("some") == 0, "none").when(F.col("some") == 1, "unique").otherwise("ambiguous")
    return c.select("q", status.alias("status"), F.when(status.isin("exact", "unique"), F.col("hit")).alias("name"))


@query("SELECT s_suppkey, s_name, n_name AS paper, round(s_acctbal * coalesce(n_nationkey, 0), 2) AS balance FROM supplier LEFT JOIN nation ON n_nationkey = CASE WHEN s_suppkey % 4 > 0 THEN s_nationkey END")
def film_paper_left(spark, sf_dir):
    """A nullable key to a small catalog: rows without one stay."""
    s = load(spark, sf_dir, "supplier").withColumn("k", F.when(F.col("s_suppkey") % 4 > 0, F.col("s_nationkey")))
    n = load(spark, sf_dir, "nation")
    return s.join(F.broadcast(n), F.col("k") == F.col("n_nationkey"), "left").select("s_suppkey", "s_name", F.col("n_name").alias("paper"), F.round(F.col("s_acctbal") * F.coalesce("n_nationkey", F.lit(0)), 2).alias("balance"))


@query("SELECT l_partkey, l_linenumber, l_orderkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_linenumber ORDER BY l_quantity DESC, l_orderkey, l_suppkey, l_extendedprice) AS r FROM lineitem) WHERE r = 1")
def farthest_focus_argmax(spark, sf_dir):
    """The row with the largest value per key, the first on ties: one partial aggregate, no sort per group."""
    best = F.max_by(F.struct("l_orderkey", "l_quantity"), F.struct(F.col("l_quantity"), -F.col("l_orderkey"), -F.col("l_suppkey"), -F.col("l_extendedprice"))).alias("b")
    return load(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_linenumber").agg(best).select("l_partkey", "l_linenumber", "b.l_orderkey", "b.l_quantity")


@query("WITH d AS (SELECT user_id, event_type, arg_max(event_id, ts) AS donor, max(ts) AS seen FROM events WHERE event_id % 3 = 0 GROUP BY 1, 2), u AS (SELECT user_id, arg_max(donor, seen) AS any_donor FROM d GROUP BY 1) SELECT e.event_id, coalesce(d.donor, u.any_donor) AS donor FROM events e LEFT JOIN d USING (user_id, event_type) LEFT JOIN u USING (user_id) WHERE e.event_id % 3 = 1")
def donor_lookup(spark, sf_dir):
    """The entry of the exact key, else the newest of the same path."""
    e = load(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    d = e.where("event_id % 3 = 0").groupBy("user_id", "event_type").agg(F.max_by("event_id", "ts").alias("donor"), F.max("ts").alias("at"))
    u = d.groupBy("user_id").agg(F.max_by("donor", "at").alias("any_donor"))
    return e.where("event_id % 3 = 1").join(d, ["user_id", "event_type"], "left").join(u, "user_id", "left").select("event_id", F.coalesce("donor", "any_donor").alias("donor"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def except_missing(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id").join(load(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal < 0)")
def anti_bad(spark, sf_dir):
    """Known bad keys are skipped; a null key is not known to be bad."""
    bad = load(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(bad, "o_custkey", "left_anti").select("o_orderkey")


@query("SELECT n_name, ext, concat(lower(replace(n_name, ' ', '_')), '.', ext) AS out, count(*) OVER (PARTITION BY concat(lower(replace(n_name, ' ', '_')), '.', ext)) > 1 AS collides FROM nation, (SELECT unnest(['dng', 'tiff', 'jpg', 'jpg']) AS ext)")
def cross_jobs(spark, sf_dir):
    """Jobs times formats, with colliding output names marked; both sides are catalogs of fixed size."""
    n = load(spark, sf_dir, "nation").select("n_name", F.explode(F.array(*map(F.lit, ("dng", "tiff", "jpg", "jpg")))).alias("ext"))
    n = n.withColumn("out", F.concat(F.lower(F.replace("n_name", F.lit(" "), F.lit("_"))), F.lit("."), "ext"))
    return n.withColumn("collides", F.count(F.lit(1)).over(Window.partitionBy("out")) > 1)


@query("SELECT p_brand, p_type, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS r FROM part) WHERE r = 1")
def distinct_keep_first(spark, sf_dir):
    return load(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("p_partkey"))
