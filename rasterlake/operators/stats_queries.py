"""Metering, histograms and robust statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rasterlake.plans.registry import load, query
from rasterlake.plans.shared import written
from rasterlake.sources import surrogates as S

BINS, LO, HI = 256, -16.0, 8.0


def log2_bins(samples: DataFrame, v: str = "v") -> DataFrame:
    """``(bin, n)`` over log2 from -16 to 8; samples of 0 or less are in no bin, ends are clamped."""
    at = F.floor((F.log2(v) - LO) / (HI - LO) * BINS)
    return samples.where(F.col(v) > 0).groupBy(F.least(F.greatest(at, F.lit(0)), F.lit(BINS - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def percentile_of_bins(bins: DataFrame, total: DataFrame, p: float) -> DataFrame:
    """``(value)``: 2 to the centre of the first bin whose running count reaches p of all samples (total has one
    row ``n_all``), 1 without samples, 2^8 if no bin reaches it. At most 256 rows meet in one task."""
    run = bins.crossJoin(F.broadcast(total)).withColumn("cum", F.sum("n").over(Window.orderBy("bin")))
    centre = LO + (F.col("bin") + 0.5) * ((HI - LO) / BINS)
    hit = run.agg(F.min(F.when(F.col("cum") >= F.ceil(F.lit(p) * F.col("n_all")), centre)).alias("centre"))
    return hit.crossJoin(total).select(F.when(F.col("n_all") == 0, 1.0).otherwise(F.pow(F.lit(2.0), F.coalesce("centre", F.lit(HI)))).alias("value"))


def metering(samples: DataFrame, p: float = 0.995) -> DataFrame:
    """``(key, top, n)``: log-average and upper percentile. Partial sums and 256 counters are all that is shuffled."""
    mean = samples.agg(F.greatest(F.exp(F.avg(F.log(F.greatest("v", F.lit(1e-4))))), F.lit(1e-4)).alias("key"), F.count(F.lit(1)).alias("n_all"))
    top = percentile_of_bins(log2_bins(samples), mean.select("n_all"), p)
    return mean.crossJoin(top).select("key", F.col("value").alias("top"), F.col("n_all").alias("n"))


def auto_exposure_ev(stats: DataFrame, target: float = 0.18) -> DataFrame:
    """``(ettr_ev, key_ev, film_ev)``, clamped to [-3, 4]; film wants its key 0.85 stops above the target."""
    held = lambda c: F.round(F.least(F.greatest(c, F.lit(-3.0)), F.lit(4.0)), 6)
    return stats.select(held(F.log2(0.9 / F.greatest("top", F.lit(1e-4)))).alias("ettr_ev"), held(F.log2(target / F.col("key"))).alias("key_ev"), held(F.log2(target * 2**0.85 / F.col("key"))).alias("film_ev"))


_KEY = f"SELECT greatest(exp(avg(ln(greatest(v, 1e-4)))), 1e-4) AS key, count(*) AS n FROM ({S.SCENE})"
_BINS = f"SELECT CAST(least(greatest(floor((log2(v) + 16) / 24 * 256), 0), 255) AS BIGINT) AS bin, count(*) AS n FROM ({S.SCENE}) WHERE v > 0 GROUP BY 1"
_TOP = f"SELECT pow(2.0, coalesce(min(CASE WHEN cum >= ceil(0.995 * n_all) THEN -16 + (bin + 0.5) * 24 / 256 END), 8)) AS top FROM (SELECT bin, sum(n) OVER (ORDER BY bin) AS cum FROM ({_BINS})), (SELECT count(*) AS n_all FROM ({S.SCENE}))"


@query(f"SELECT round(key, 9) AS key, round(top, 9) AS top, n FROM ({_KEY}), ({_TOP})")
def scene_stats_key(spark, sf_dir):
    return metering(S.scene(spark, sf_dir)).select(F.round("key", 9).alias("key"), F.round("top", 9).alias("top"), "n")


@query(_BINS)
def log2_histogram(spark, sf_dir):
    return log2_bins(S.scene(spark, sf_dir))


@query(f"SELECT round(top, 9) AS value FROM ({_TOP})")
def ettr_percentile(spark, sf_dir):
    px = S.scene(spark, sf_dir)
    return percentile_of_bins(log2_bins(px), px.agg(F.count(F.lit(1)).alias("n_all")), 0.995).select(F.round("value", 9).alias("value"))


@query(f"SELECT round(least(greatest(log2(0.9 / greatest(top, 1e-4)), -3.0), 4.0), 6) AS ettr_ev, round(least(greatest(log2(0.18 / key), -3.0), 4.0), 6) AS key_ev, round(least(greatest(log2(0.18 * pow(2, 0.85) / key), -3.0), 4.0), 6) AS film_ev FROM ({_KEY}), ({_TOP})")
def auto_exposure(spark, sf_dir):
    return auto_exposure_ev(metering(S.scene(spark, sf_dir)))


@query(f"WITH p AS ({S.RAW12}), u AS (SELECT image_id, s FROM p WHERE y BETWEEN 0 AND 1 UNION ALL SELECT image_id, s FROM p WHERE y BETWEEN 6 AND 7 UNION ALL SELECT image_id, s FROM p WHERE x BETWEEN 0 AND 1 UNION ALL SELECT image_id, s FROM p WHERE x BETWEEN 6 AND 7) SELECT image_id, round(avg(s), 6) AS black, count(*) AS n FROM u GROUP BY image_id")
def dark_level_bag(spark, sf_dir):
    """Mean over the bag union of four rectangles, overlaps counted as often as they occur: one scan, each
    pixel weighted by the number of rectangles it lies in."""
    inside = [F.col(c).between(a, b).cast("int") for c, a, b in (("y", 0, 1), ("y", 6, 7), ("x", 0, 1), ("x", 6, 7))]
    w = inside[0] + inside[1] + inside[2] + inside[3]
    px = S.raw12(spark, sf_dir).withColumn("w", w)
    return px.groupBy("image_id").agg(F.round(F.coalesce(F.sum(F.col("s") * F.col("w")) / F.nullif(F.sum("w"), F.lit(0)), F.lit(0.0)), 6).alias("black"), F.sum("w").cast("long").alias("n"))


@query(f"WITH m AS (SELECT min(s) AS low FROM (SELECT s - 2048 AS s FROM ({S.RAW12}))) SELECT image_id, y, x, greatest(s - 2048 - least(low, 0), 0) AS s FROM ({S.RAW12}), m")
def global_min_offset(spark, sf_dir):
    px = S.raw12(spark, sf_dir).withColumn("s", F.col("s") - 2048)
    low = px.agg(F.min("s").alias("low"))
    return px.crossJoin(F.broadcast(low)).select("image_id", "y", "x", F.greatest(F.col("s") - F.least("low", F.lit(0)), F.lit(0)).alias("s"))


@query(f"SELECT image_id, CAST(floor(y / 3) AS INT) AS ty, CAST(floor(x / 3) AS INT) AS tx, round(avg(s), 6) AS mean FROM ({S.RAW12}) GROUP BY 1, 2, 3")
def box_downsample(spark, sf_dir):
    return S.raw12(spark, sf_dir).groupBy("image_id", F.floor(F.col("y") / 3).cast("int").alias("ty"), F.floor(F.col("x") / 3).cast("int").alias("tx")).agg(F.round(F.avg("s"), 6).alias("mean"))


@query(f"SELECT image_id, CAST(floor(y / 2) AS INT) AS ty, CAST(floor(x / 2) AS INT) AS tx, CAST(floor(sum(s) / 4.0) AS BIGINT) AS mean FROM ({S.RAW12}) GROUP BY 1, 2, 3")
def proxy_2x2(spark, sf_dir):
    return S.raw12(spark, sf_dir).groupBy("image_id", F.floor(F.col("y") / 2).cast("int").alias("ty"), F.floor(F.col("x") / 2).cast("int").alias("tx")).agg(F.floor(F.sum("s") / 4).alias("mean"))


@query(f"""WITH p AS (SELECT *, greatest(r, g, b) AS mx, least(r, g, b) AS mn, 0.2126 * r + 0.7152 * g + 0.0722 * b AS l FROM ({S.LINEAR})),
w AS (SELECT *, CASE WHEN l > 0.004 AND mx < 1 AND mx > 0 THEN pow(greatest(1 - (mx - mn) / mx / 0.55, 0.0), 2) ELSE 0 END AS w FROM p),
s AS (SELECT image_id, sum(w) AS sw, sum(w * r) AS sr, sum(w * g) AS sg, sum(w * b) AS sb, count(*) AS n FROM w GROUP BY image_id)
SELECT image_id, CASE WHEN sw >= 0.01 * n AND sr > 0 AND sg > 0 AND sb > 0 THEN round(least(greatest(sg / sr, 0.5), 2.0), 6) END AS gain_r, CASE WHEN sw >= 0.01 * n AND sr > 0 AND sg > 0 AND sb > 0 THEN round(least(greatest(sg / sb, 0.5), 2.0), 6) END AS gain_b FROM s""")
def grey_vote_wb(spark, sf_dir):
    px = S.linear(spark, sf_dir)
    mx, mn = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    luma = 0.2126 * F.col("r") + 0.7152 * F.col("g") + 0.0722 * F.col("b")
    w = F.when((luma > 0.004) & (mx < 1) & (mx > 0), F.pow(F.greatest(1 - (mx - mn) / mx / 0.55, F.lit(0.0)), F.lit(2.0))).otherwise(0.0)
    s = px.withColumn("w", w).groupBy("image_id").agg(F.sum("w").alias("sw"), *(F.sum(F.col("w") * F.col(c)).alias(f"s{c}") for c in "rgb"), F.count(F.lit(1)).alias("n"))
    ok = (F.col("sw") >= 0.01 * F.col("n")) & (F.col("sr") > 0) & (F.col("sg") > 0) & (F.col("sb") > 0)
    gain = lambda c: F.when(ok, F.round(F.least(F.greatest(F.col("sg") / F.col(c), F.lit(0.5)), F.lit(2.0)), 6))
    return s.select("image_id", gain("sr").alias("gain_r"), gain("sb").alias("gain_b"))


@query(f"WITH p AS ({S.GRAY}) SELECT a.image_id, round(max(abs(a.v - b.v)), 6) AS delta FROM p a JOIN p b ON a.image_id = b.image_id AND a.y = b.y AND b.x = least(a.x + 1, 7) GROUP BY 1")
def max_delta(spark, sf_dir):
    """Largest difference to the right neighbour (clamped at the edge); NaN counts as infinite."""
    w = Window.partitionBy("image_id", "y").orderBy("x")
    d = F.abs(F.col("v") - F.coalesce(F.lead("v").over(w), F.col("v")))
    return S.gray(spark, sf_dir).withColumn("d", F.when(F.isnan(d), float("inf")).otherwise(d)).groupBy("image_id").agg(F.round(F.max("d"), 6).alias("delta"))


@query("SELECT event_type, count(*) AS total, count(*) FILTER (WHERE value > 0.5) AS ok, round(sum(value), 4) AS seconds, round(CASE WHEN sum(value) > 0 THEN count(*) / sum(value) END, 6) AS per_second FROM events GROUP BY event_type")
def batch_summary(spark, sf_dir):
    e = load(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("value") > 0.5).alias("ok"), F.sum("value").alias("s"))
    return e.select("event_type", "total", "ok", F.round("s", 4).alias("seconds"), F.round(F.when(F.col("s") > 0, F.col("total") / F.col("s")), 6).alias("per_second"))


EDGES = [8e-4 * (1.2 / 8e-4) ** (k / 40) for k in range(41)]
CLIP, LEAST = 0.92, 12


def high_pass(px: DataFrame) -> DataFrame:
    """``(image_id, y, x, m, d)`` on the valid crop: mean of the 3 x 3 neighbours and the separable second difference over 6.

    Two window passes over (image, row) and (image, column) instead of nine joins; the second
    reuses only rows of the same image."""
    row, col = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    h = px.select("image_id", "y", "x", (F.lag("v").over(row) + F.col("v") + F.lead("v").over(row)).alias("s"), (F.lag("v").over(row) - 2 * F.col("v") + F.lead("v").over(row)).alias("t"))
    out = h.select("image_id", "y", "x", ((F.lag("s").over(col) + F.col("s") + F.lead("s").over(col)) / 9).alias("m"), ((F.lag("t").over(col) - 2 * F.col("t") + F.lead("t").over(col)) / 6).alias("d"))
    return out.where("m is not null and d is not null")


def noise_bins(samples: DataFrame, keys: list[str], least: int = LEAST) -> DataFrame:
    """``(*keys, bin, x, var, n)``: median level and squared 1.4826 median absolute deviation per level bin."""
    at = F.lit(None).cast("int")
    for k in reversed(range(len(EDGES) - 1)):
        at = F.when((F.col("m") >= EDGES[k]) & (F.col("m") < EDGES[k + 1]), k).otherwise(at)
    ok = samples.where((F.col("m") > 0) & (F.col("m") < CLIP) & ~F.isnan("d")).withColumn("bin", at).where("bin is not null")
    bins = ok.groupBy(*keys, "bin").agg(F.percentile("m", F.lit(0.5)).alias("x"), F.pow(1.4826 * F.percentile(F.abs("d"), F.lit(0.5)), F.lit(2.0)).alias("var"), F.count(F.lit(1)).alias("n"))
    return bins.where(F.col("n") >= least)


def whole_frames(bins: DataFrame, frame: str, channel: str, channels: int = 3, least: int = 4) -> DataFrame:
    """The bins of frames that have ``least`` bins in each of their ``channels``; a frame with a weaker channel goes as a whole."""
    strong = bins.groupBy(frame, channel).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    whole = strong.groupBy(frame).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= channels).select(frame)
    return bins.join(whole, frame, "left_semi")


def affine_fit(bins: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, a, b, weight)``: least squares var = a + b x weighted by n; a negative coefficient is set to 0 and the other refitted."""
    w, x, v = F.col("n").cast("double"), F.col("x"), F.col("var")
    s = bins.groupBy(*keys).agg(F.sum(w).alias("w"), F.sum(w * x).alias("wx"), F.sum(w * v).alias("wv"), F.sum(w * x * x).alias("wxx"), F.sum(w * x * v).alias("wxv"), F.count(F.lit(1)).alias("k"))
    det = F.col("w") * F.col("wxx") - F.col("wx") * F.col("wx")
    s = s.where((F.col("k") >= 2) & (det > 1e-12)).withColumn("b0", (F.col("w") * F.col("wxv") - F.col("wx") * F.col("wv")) / det)
    s = s.withColumn("a0", (F.col("wv") - F.col("b0") * F.col("wx")) / F.col("w"))
    a = F.when(F.col("a0") < 0, 0.0).when(F.col("b0") < 0, F.col("wv") / F.col("w")).otherwise(F.col("a0"))
    b = F.when(F.col("a0") < 0, F.col("wxv") / F.col("wxx")).when(F.col("b0") < 0, 0.0).otherwise(F.col("b0"))
    return s.select(*keys, a.alias("a"), b.alias("b"), F.col("w").alias("weight"))


def lower_weighted_median(rows: DataFrame, keys: list[str], value: str, weight: str, cells: int = 1024) -> DataFrame:
    """``(*keys, value)``: the first value whose running weight reaches half the total; values are summed up first.

    The range of a key is cut into ``cells`` equal parts. Their sums tell in which part half the weight is reached; only that part's values are
    sorted, from the sum before it on. So a task sees ``cells`` rows and one part of the values (all of them only where nearly all lie together)."""
    summed = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    ends = summed.groupBy(*keys).agg(F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi"), F.sum("_w").alias("_t"))
    cell = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col(value).cast("double") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * cells), F.lit(cells - 1))).otherwise(0)
    placed = summed.join(ends, keys).withColumn("_cell", cell)
    parts = placed.groupBy(*keys, "_cell", "_t").agg(F.sum("_w").alias("_s"))
    run = parts.withColumn("_c", F.sum("_s").over(Window.partitionBy(*keys).orderBy("_cell")))
    hit = run.where(F.col("_c") >= F.col("_t") / 2).groupBy(*keys).agg(F.min_by(F.struct("_cell", (F.col("_c") - F.col("_s")).alias("_before")), "_cell").alias("_h"))
    last = placed.join(hit.select(*keys, F.col("_h._cell").alias("_cell"), F.col("_h._before").alias("_before")), [*keys, "_cell"])
    last = last.withColumn("_c", F.col("_before") + F.sum("_w").over(Window.partitionBy(*keys).orderBy(value)))
    return last.where(F.col("_c") >= F.col("_t") / 2).groupBy(*keys).agg(F.min(value).alias(value))


_HP = f"""WITH p AS (SELECT image_id, y, x, (v + 0.6) / 1.2 * (1 + image_id % 5) / 5 AS v FROM ({S.GRAY})),
hp AS (SELECT c.image_id, c.y, c.x, sum(n.v) / 9 AS m, sum(n.v * CASE WHEN n.x = c.x THEN -2 ELSE 1 END * CASE WHEN n.y = c.y THEN -2 ELSE 1 END) / 6 AS d
FROM p c JOIN p n ON n.image_id = c.image_id AND n.y BETWEEN c.y - 1 AND c.y + 1 AND n.x BETWEEN c.x - 1 AND c.x + 1 WHERE c.x BETWEEN 1 AND 6 AND c.y BETWEEN 1 AND 6 GROUP BY 1, 2, 3)"""
_BIN_OF = "CASE " + " ".join(f"WHEN m >= {EDGES[k]!r} AND m < {EDGES[k + 1]!r} THEN {k}" for k in range(40)) + " END"
_NB = _HP + f""", nb AS (SELECT frame, ch, bin, quantile_cont(m, 0.5) AS x, pow(1.4826 * quantile_cont(abs(d), 0.5), 2) AS var, count(*) AS n
FROM (SELECT CAST(floor(image_id / 30) AS BIGINT) AS frame, image_id % 3 AS ch, m, d, {_BIN_OF} AS bin FROM hp WHERE m > 0 AND m < {CLIP}) WHERE bin IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= {LEAST})"""
_FIT = _NB + """, whole AS (SELECT frame FROM (SELECT frame, ch FROM nb GROUP BY 1, 2 HAVING count(*) >= 4) GROUP BY 1 HAVING count(*) >= 3),
sm AS (SELECT frame, ch, sum(n)::DOUBLE AS w, sum(n * x) AS wx, sum(n * var) AS wv, sum(n * x * x) AS wxx, sum(n * x * var) AS wxv, count(*) AS k FROM nb WHERE frame IN (SELECT frame FROM whole) GROUP BY 1, 2),
f0 AS (SELECT *, (w * wxv - wx * wv) / (w * wxx - wx * wx) AS b0 FROM sm WHERE k >= 2 AND w * wxx - wx * wx > 1e-12), f1 AS (SELECT *, (wv - b0 * wx) / w AS a0 FROM f0),
fit AS (SELECT frame, ch, CASE WHEN a0 < 0 THEN 0 WHEN b0 < 0 THEN wv / w ELSE a0 END AS a, CASE WHEN a0 < 0 THEN wxv / wxx WHEN b0 < 0 THEN 0 ELSE b0 END AS b, w AS weight FROM f1)"""


def _frames(spark, sf_dir):
    px = S.gray(spark, sf_dir).withColumn("v", (F.col("v") + 0.6) / 1.2 * (1 + F.col("image_id") % 5) / 5)
    return high_pass(px).select(F.floor(F.col("image_id") / 30).alias("frame"), (F.col("image_id") % 3).alias("ch"), "m", "d", "image_id", "y", "x")


@query(_HP + " SELECT image_id, y, x, round(m, 8) AS m, round(d, 8) AS d FROM hp")
def noise_highpass(spark, sf_dir):
    return _frames(spark, sf_dir).select("image_id", "y", "x", F.round("m", 8).alias("m"), F.round("d", 8).alias("d"))


@query(_NB + " SELECT frame, ch, bin, round(x, 8) AS x, round(var, 8) AS var, n FROM nb")
def noise_bins_mad(spark, sf_dir):
    return noise_bins(_frames(spark, sf_dir), ["frame", "ch"]).select("frame", "ch", "bin", F.round("x", 8).alias("x"), F.round("var", 8).alias("var"), "n")


def _fits(spark, sf_dir):
    """Fits of whole frames. The bins, 40 rows a frame and channel at most, are written once: stencil and medians run once although the bins are used twice."""
    bins = written(noise_bins(_frames(spark, sf_dir), ["frame", "ch"]), "noise-bins")
    return affine_fit(whole_frames(bins, "frame", "ch"), ["frame", "ch"])


@query(_FIT + " SELECT frame, ch, round(a, 7) AS a, round(b, 7) AS b, weight FROM fit")
def noise_affine_fit(spark, sf_dir):
    fit = _fits(spark, sf_dir)
    return fit.select("frame", "ch", F.round("a", 7).alias("a"), F.round("b", 7).alias("b"), "weight")


def _median_sql(c):
    return f"(SELECT ch, min({c}) AS {c} FROM (SELECT ch, {c}, sum(weight) OVER (PARTITION BY ch ORDER BY {c}) AS c, sum(weight) OVER (PARTITION BY ch) AS t FROM fit) WHERE c >= t / 2 GROUP BY ch)"


@query(_FIT + f" SELECT ch, round(greatest(a, pow(1.0 / 1024, 2) / 12), 7) AS a, round(b, 7) AS b FROM {_median_sql('a')} JOIN {_median_sql('b')} USING (ch)")
def noise_profile(spark, sf_dir):
    """Stencil, filter, robust bins, weighted fit and weighted median: the whole noise job."""
    fit = written(_fits(spark, sf_dir), "noise-fits")
    both = fit.select("ch", "weight", F.explode(F.array(F.struct(F.lit("a").alias("of"), F.col("a").alias("v")), F.struct(F.lit("b").alias("of"), F.col("b").alias("v")))).alias("p"))
    found = lower_weighted_median(both.select("ch", "weight", "p.of", "p.v"), ["ch", "of"], "v", "weight")
    found = found.groupBy("ch").agg(*(F.max(F.when(F.col("of") == c, F.col("v"))).alias(c) for c in ("a", "b")))
    return found.select("ch", F.round(F.greatest("a", F.lit((1 / 1024) ** 2 / 12)), 7).alias("a"), F.round("b", 7).alias("b"))


@query("SELECT l_returnflag, min(l_extendedprice) AS value FROM (SELECT l_returnflag, l_extendedprice, sum(l_quantity) OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS c, sum(l_quantity) OVER (PARTITION BY l_returnflag) AS t FROM lineitem) WHERE c >= t / 2 GROUP BY 1")
def weighted_median(spark, sf_dir):
    out = lower_weighted_median(load(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice", "l_quantity"), ["l_returnflag"], "l_extendedprice", "l_quantity")
    return out.withColumnRenamed("l_extendedprice", "value")


@query("SELECT ev, round(0.00001 * pow(pow(2.0, ev), 2), 12) AS a, round(0.0005 * pow(2.0, ev), 12) AS b FROM (SELECT DISTINCT CAST(l_linenumber - 4 AS DOUBLE) AS ev FROM lineitem)")
def noise_push(spark, sf_dir):
    g = F.pow(F.lit(2.0), F.col("ev"))
    return load(spark, sf_dir, "lineitem").select((F.col("l_linenumber") - 4).cast("double").alias("ev")).distinct().select("ev", F.round(1e-5 * g * g, 12).alias("a"), F.round(5e-4 * g, 12).alias("b"))
