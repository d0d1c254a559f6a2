"""Embedding near-duplicates by collision counting on one-dimensional projections.

Unit vectors are projected on ``n_projections`` fixed random directions. Vectors with a
cosine of at least c differ by at most r = sqrt(2 - 2c), so a projection's values of such
a pair differ by about r / sqrt(dim); the window around a query is a multiple of that.

* The vectors of a label are dealt by their place on the first projection into cells one window wide; a
  vector meets its own cell and, as a query, the next one. So every pair whose first
  projections lie within the window of each other meets exactly once.
* In a cell the vectors are sorted by that projection, and a query walks the window centred on it. For each pair so
  met, the collisions of the remaining projections with windows centred on the query are counted, and the pair goes as soon as
  it cannot reach the calibrated count any more; pairs that reach it are verified by
  cosine in double precision. Window and count come from the Gaussian law of the differences: the
  first window is 4 deviations, the others 2.5, and the count is what a pair at the threshold
  reaches with probability ``recall``. Nearer pairs reach it more surely.
* A cell with more than ``chunk`` rows is split into chunks that meet pairwise in
  different tasks, so no task holds more than 2 chunks whatever a label's share is. Pairs exist in slices of
  bounded size only; a slice's links are summed up per vector and united into local components.
* Equal vectors are one row with a multiplicity. A task reports for each vector the number of its
  links and the smallest vector of its local component, not the pairs.

A single window holds about a fifth to a third of a label's rows in 64 dimensions (that is what one
projection can tell), so the comparisons inside a label grow with its square at
a small constant, and rows are copied once for each chunk of their cell.

Defined results: null labels and vectors that are null, empty, zero
or hold null or non-finite components link with nothing (their component is their own vec_id, kept is
true); vectors of different lengths are not compared; finite components of any size are (they are scaled first); repeated rows each get
their row and count as other vectors; a null vec_id takes
part in links and never names a component with other ids; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlake.llm._common import components, join_hot, materialise

MIN_COSINE = 0.98
FIRST, OTHERS = 4.0, 2.5


def directions(dim: int, n: int, seed: int = 11) -> np.ndarray:
    x = np.random.default_rng(seed).standard_normal((n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def least_count(n: int, inside: float, recall: float) -> int:
    """The largest count that a pair at the threshold reaches with the given probability."""
    tail, k = 0.0, n + 1
    while tail < recall and k > 0:
        k -= 1
        tail += comb(n, k) * inside**k * (1 - inside) ** (n - k)
    return k


def met(one: np.ndarray, two: np.ndarray, width: float, most: int):
    """Pairs (i, j) with two[j] in the window around the query one[i], in slices of at most about ``most``: ``two`` is sorted once, a
    query's window is a range of it."""
    order = np.argsort(two, kind="stable")
    lo, hi = np.searchsorted(two[order], one - width, "left"), np.searchsorted(two[order], one + width, "right")
    ends = np.cumsum(hi - lo)
    at = 0
    while at < len(one):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        n = (hi - lo)[at:to]
        i = np.repeat(np.arange(at, to), n)
        j = order[np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[at:to], n)]
        yield i, j
        at = to


def linked(unit: np.ndarray, shadow: np.ndarray, a: np.ndarray, b: np.ndarray, widths: tuple[float, float], least: int, min_cosine: float, most: int = 1 << 20):
    """Slices of linked pairs (i in a, j in b): collisions counted projection by projection, then the cosine."""
    step = max(1, (1 << 21) // unit.shape[1])
    for i, j in met(shadow[a, 0], shadow[b, 0], widths[0], most):
        i, j = a[i], b[j]
        count = np.zeros(len(i), np.int16)
        for p in range(1, shadow.shape[1]):
            column = np.ascontiguousarray(shadow[:, p])
            count += np.abs(column[i] - column[j]) <= widths[1]
            ok = count >= least - (shadow.shape[1] - 1 - p)
            i, j, count = i[ok], j[ok], count[ok]
        near = [np.einsum("nd,nd->n", unit[i[k : k + step]], unit[j[k : k + step]]) >= min_cosine for k in range(0, len(i), step)]
        near = np.concatenate(near) if near else np.zeros(0, bool)
        yield i[near], j[near]


def unite(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the trees of all pairs; a root is the smallest place of its tree."""
    while len(i):
        i, j = parent[i], parent[j]
        apart = i != j
        i, j = i[apart], j[apart]
        np.minimum.at(parent, np.maximum(i, j), np.minimum(i, j))
        while not np.array_equal(up := parent[parent], parent):
            parent[:] = up


def near_duplicates(
    vectors: DataFrame, min_cosine: float = MIN_COSINE, n_projections: int = 24, recall: float = 0.999, chunk: int = 4000,
    vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for each row."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"), F.col(label).cast("string").alias("label"))
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(F.col("label").isNotNull() & (F.size("v") > 0) & finite, F.lit(False)))
    rows = rows.withColumn("v", F.when(F.col("ok"), F.transform("v", lambda x: x + F.lit(0.0))))  # -0.0 becomes 0.0
    # one row for equal vectors of a label; its number is given once, by the table written here
    classes = rows.where("ok").groupBy("label", "v").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first_id"))
    classes = materialise(classes.withColumn("key", F.monotonically_increasing_id()), "embedding-classes")
    least = least_count(n_projections - 1, 0.98758, recall)  # share of a Gaussian within 2.5 deviations
    reach = np.sqrt(2 - 2 * min_cosine)

    def placed(batches):
        for batch in batches:
            v = batch.column(1)
            sizes = np.asarray(v.value_lengths())
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            flat = np.array(v.flatten(), np.float64)
            top = np.maximum.reduceat(np.abs(flat), offsets[:-1]) if len(sizes) else flat
            flat /= np.repeat(top, sizes)
            flat /= np.repeat(np.sqrt(np.add.reduceat(flat * flat, offsets[:-1])), sizes) if len(sizes) else 1
            cell = np.zeros(len(sizes), np.int64)
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                first = flat[offsets[at, None] + np.arange(dim)] @ directions(dim, 1)[0]
                cell[at] = np.floor(first / (FIRST * reach / np.sqrt(dim)))
            unit = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), unit, batch.column(2), batch.column(3), pa.array(sizes.astype(np.int64)), pa.array(cell)], names=["label", "v", "n", "key", "dim", "cell"])

    units = materialise(classes.select("label", "v", "n", "key").mapInArrow(placed, "label string, v array<double>, n long, key long, dim long, cell long"), "embedding-units")
    guests = units.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("guest")).withColumn("cell", F.col("cell") + F.col("guest"))
    parts = guests.groupBy("label", "dim", "cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(chunk)).cast("long").alias("parts"))
    many = parts.where("parts > 1")
    guests = guests.join(many, ["label", "dim", "cell"], "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long"))).withColumn("own", F.pmod(F.xxhash64("key"), "parts"))
    lists = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda j: F.least("own", j) * F.col("parts") + F.greatest("own", j))
    blocks = guests.select("label", "dim", "cell", F.explode(lists).alias("block"), "parts", "own", "guest", "key", "n", "v")

    def in_block(table: pa.Table) -> pa.Table:
        block, size, dim = table.column("block")[0].as_py(), table.column("parts")[0].as_py(), table.column("dim")[0].as_py()
        one, two = divmod(block, size)
        table = table.sort_by("key")  # the smallest place of a tree is its smallest key
        own, guest, key, n = (table.column(c).to_numpy() for c in ("own", "guest", "key", "n"))
        unit = np.asarray(table.column("v").combine_chunks().flatten()).reshape(-1, dim)
        shadow = unit @ directions(dim, n_projections).T
        widths = FIRST * reach / np.sqrt(dim), OTHERS * reach / np.sqrt(dim)
        home = guest == 0
        links, parent = np.zeros(len(key)), np.arange(len(key))
        # a guest comes from the cell before and meets the residents; residents meet each other once
        sides = [(~home & (own == p), home & (own == q), False) for p, q in {(one, two), (two, one)}] + [(home & (own == one), home & (own == two), one == two)]
        for a, b, same in sides:
            for i, j in linked(unit, shadow, np.flatnonzero(a), np.flatnonzero(b), widths, least, min_cosine):
                if same:
                    i, j = i[i < j], j[i < j]
                links += np.bincount(i, n[j], len(key)) + np.bincount(j, n[i], len(key))
                unite(parent, i, j)
        hit = np.flatnonzero(links > 0)
        return pa.table({"key": key[hit], "links": links[hit].astype(np.int64), "root": key[parent[hit]]})

    found = materialise(blocks.groupBy("label", "dim", "cell", "block").applyInArrow(in_block, "key long, links long, root long"), "embedding-found")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("key").alias("a"), F.col("root").alias("b")), "embedding-links")
    named = classes.join(links, "key", "left").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    named = materialise(named.select("label", "v", "n", "links", "root", "first_id"), "embedding-named")
    low = materialise(named.groupBy("root").agg(F.count(F.lit(1)).alias("classes"), F.min("first_id").alias("c")), "embedding-components")
    final = join_hot(named.drop("first_id"), low, "root", "classes").select("label", "v", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "c")
    # equal vectors find their class by the vector itself, hashed first so that one long key decides the place
    final = materialise(final.withColumn("h", F.xxhash64("label", "v")), "embedding-final")
    rows = rows.withColumn("h", F.when(F.col("ok"), F.xxhash64("label", "v")))
    hot = F.broadcast(final.where(F.col("n") * 1000 > rows.count()))  # fewer than 1000 classes
    rest = final.where(F.col("n") * 1000 <= rows.count())
    same = lambda side: (rows["h"] == side["h"]) & (rows["label"] == side["label"]) & (rows["v"] == side["v"])
    out = rows.join(hot, same(hot), "left").select(rows["vec_id"], rows["h"], rows["label"], rows["v"], F.col("n_links").alias("hot_links"), F.col("c").alias("hot_c"))
    out = out.withColumn("h", F.when(F.col("hot_links").isNull(), F.col("h")))
    same = (out["h"] == rest["h"]) & (out["label"] == rest["label"]) & (out["v"] == rest["v"])
    out = out.join(rest, same, "left").select(out["vec_id"], F.coalesce("hot_links", "n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("hot_c", "c", out["vec_id"]).alias("component_id"))
    return out.select("*", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
