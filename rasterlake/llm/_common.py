"""Small helpers shared by the training-data operators.

Nothing here holds a corpus in one place: tables that cut lineage are written as
Parquet in the shared checkpoint folder, texts are read from Arrow buffers in
byte-bounded groups.
"""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir. Only a session on one machine may go without
    it (it gets an own folder then); on a cluster its absence is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="rasterlake-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rasterlake/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a materialised table that nothing reads any more."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/rasterlake/" in name:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def join_hot(rows: DataFrame, side: DataFrame, key: str, size: str, share: int = 1000) -> DataFrame:
    """Inner join of ``rows`` with ``side``, which has each key once and in ``size`` how many rows have it.

    Keys that hold more than 1/``share`` of all rows are fewer than ``share``: that bounds what is broadcast, so a key that
    holds a third of the rows stays where its rows are. All others meet in a shuffled join."""
    total = side.agg(F.sum(size)).first()[0] or 0
    hot = side.where(F.col(size) * share > total)
    names = hot.select(F.col(key).alias("_hot"))
    rest = rows.join(F.broadcast(names), rows[key] == F.col("_hot"), "left_anti").join(side.where(F.col(size) * share <= total), key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_of(column: str, n: int):
    """crc32(column as text) mod n, as a Column."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


def crc_mod(value, n: int) -> int:
    """The same remainder for one Python value; None is treated as the empty text."""
    return zlib.crc32(b"" if value is None else str(value).encode()) % n


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null rows have length 0. No copy is made unless nulls hold bytes."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_groups(offsets: np.ndarray, max_rows: int, max_bytes: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold at most ``max_bytes`` together, or one row that alone holds more."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + max_bytes, side="right")) - 1
        hi = max(lo + 1, min(hi, lo + max_rows, n))
        yield lo, hi
        lo = hi


def _with_least(rows: DataFrame, least: DataFrame, total: int, share: int = 1000, salts: int = 64) -> DataFrame:
    """``rows`` (u, v and others) joined with ``least`` (u, m, n) on u; rows of a u with more than 1/``share`` of all are dealt over ``salts`` tasks.
    Such u are fewer than ``share``, which bounds the broadcast."""
    heavy = F.broadcast(least.where(F.col("n") * share > total).select("u", F.lit(True).alias("heavy")))
    dealt = rows.join(heavy, "u", "left").withColumn("salt", F.when(F.col("heavy"), F.pmod(F.xxhash64("v"), F.lit(salts))).otherwise(F.lit(0).cast("long")))
    copies = F.when(F.col("n") * share > total, F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    return dealt.join(least.select("u", "m", F.explode(copies).alias("salt")), ["u", "salt"]).select(*rows.columns, "m")


def complete_runs(batches, keys: int) -> Iterator[pa.Table]:
    """Tables of whole runs from batches that are sorted by their first ``keys`` columns: rows with equal keys come together in one table."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([np.asarray(c) for c in batch.columns[:keys]], 1)
        if held and tuple(k[0]) == tuple(c[held[-1].num_rows - 1].as_py() for c in held[-1].columns[:keys]):
            change = np.flatnonzero((k != k[0]).any(1))
            if not len(change):
                held.append(batch)
                continue
            held.append(batch.slice(0, int(change[0])))
            batch, k = batch.slice(int(change[0])), k[change[0] :]
        if held:
            yield pa.Table.from_batches(held)
        last = int(np.flatnonzero((k != k[-1]).any(1))[-1]) + 1 if (k != k[-1]).any() else 0
        if last:
            yield pa.Table.from_batches([batch.slice(0, last)])
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held)


def components(edges: DataFrame, tag: str, max_rounds: int = 60) -> DataFrame:
    """Connected components of links ``(a, b)`` by alternating large-star and small-star rounds.

    Returns ``(node, root)`` for each node that has a link to another, root being the
    smallest node reachable. Every round is one Spark job over a Parquet table in the
    shared folder, which replaces that of the round before; only two numbers (count and checksum) come to the driver."""
    links = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links, state = materialise(links, tag), None
    for _ in range(max_rounds):
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or now[0] == 0:
            break
        state = now
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = _with_least(both.where("v > u"), low, 2 * now[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = _with_least(large, low, now[0]).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        # a node whose smallest neighbour is the only one keeps (u, m); otherwise (u, m) comes from the row v == m
        before, links = links, materialise(small.where(F.col("u") != F.col("v")).distinct(), tag)
        discard(before)
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
