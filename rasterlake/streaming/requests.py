"""Request streams where the latest wins, with Structured Streaming.

Both jobs read the folder as a file stream, keep keyed state, run all that is there (``availableNow``) and
leave their output as Parquet in the shared checkpoint folder, beside the stream's own checkpoint. Both stand in a folder
named after the job and its input, so a restarted job goes on where it stopped: new files are taken up, old ones are not read again.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.plans.registry import load, query
from rasterlake.plans.shared import shared_folder
from rasterlake.streaming.sessions import Delivery, follow, run, stream_session

LATE = "(SELECT *, max(generation) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest, count(CASE WHEN kind = 'full' THEN 1 END) OVER (PARTITION BY user_id, generation ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS fulls FROM (SELECT event_id, user_id, ts, event_id * 7919 % 10 AS generation, CASE WHEN event_id % 3 = 0 THEN 'full' ELSE 'quick' END AS kind FROM events))"


def _folder(spark: SparkSession, tag: str, source: str) -> str:
    """The folder of a job over a source: the same one at every start."""
    return shared_folder(spark, f"{tag}-{hashlib.sha256(source.encode()).hexdigest()[:16]}")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = load(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events*").parquet(sf_dir)


def deliver(requests: DataFrame) -> DataFrame:
    """Results that may be shown: of the newest generation seen, and no quick one after that generation's full one."""
    return follow(requests, "user_id", Delivery())


@query(f"SELECT user_id, event_id FROM {LATE} WHERE (newest IS NULL OR generation >= newest) AND fulls = 0")
def quick_then_full(spark, sf_dir):
    e = event_stream(stream_session(spark), sf_dir)
    requests = e.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") * 7919 % 10).alias("generation"), F.when(F.col("event_id") % 3 == 0, "full").otherwise("quick").alias("kind"))
    return run(spark, "quick-full", sf_dir, deliver(requests))


@query("SELECT user_id, arg_max(event_id, ts) AS event_id, count(*) AS seen FROM events GROUP BY 1")
def latest_wins(spark, sf_dir):
    """The newest request of each session, kept as streaming state. A batch writes the sessions it changed, under its number (again, should it
    be repeated); the last batch of a session tells its request."""
    out = _folder(spark, "latest-wins", sf_dir)
    newest = event_stream(spark, sf_dir).groupBy("user_id").agg(F.max_by("event_id", "ts").alias("event_id"), F.count(F.lit(1)).alias("seen"))

    def merge(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/data/batch={number}")

    newest.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    changes = spark.read.schema("user_id long, event_id long, seen long, batch int").parquet(f"{out}/data")
    return changes.groupBy("user_id").agg(F.max_by(F.struct("event_id", "seen"), "batch").alias("r")).select("user_id", "r.event_id", "r.seen")
