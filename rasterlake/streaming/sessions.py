"""Sessions with typed keyed state: leases, progress, results of the newest generation, and a render loop.

A session is a state and three plain functions: ``step`` takes the next row, ``expire`` does what is due by a time, ``deadline`` tells when
something will be due. ``transformWithStateInPandas`` keeps the state as one typed value for each key and sets an event-time timer at the
deadline, so that what is due comes out although no row follows. Rows of a key are taken by time (whole milliseconds), then event_id, inside a
micro-batch; micro-batches come in the order of their files. Before each row all that is due by its time is done, so with files in the order of time results do not depend
on how rows fall into micro-batches. A row behind the watermark (older than the newest row of the batches before) is late: Spark leaves it out
of sessions with timers. A deadline comes out when the watermark has passed it. Null keys are a session of their own; rows with a null time,
kind or generation do nothing, and ties are rows in the order of event_id. An empty source gives no rows.

A task holds one key's rows of one micro-batch: ``BATCH_BYTES`` bounds a micro-batch, whatever the size of the stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rasterlake.plans.registry import query
from rasterlake.plans.shared import shared_folder

#: Files taken by one micro-batch end at this size (at least one file).
BATCH_BYTES = 256 << 20
HOUR = 3_600_000


class Session(StatefulProcessor):
    """Keyed state as one tuple. ``STATE`` and ``OUT`` are schemas, ``START`` is the state of a key that was never seen or is at rest."""

    STATE: str
    OUT: str
    START: tuple
    TIMERS = False

    def step(self, state: tuple, row: Any) -> tuple[tuple, list[tuple]]:
        raise NotImplementedError

    def expire(self, state: tuple, now: int) -> tuple[tuple, list[tuple]]:
        return state, []

    def deadline(self, state: tuple) -> int | None:
        return None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", self.STATE)

    def _read(self) -> tuple:
        return tuple(self.kept.get()) if self.kept.exists() else self.START

    def _write(self, before: tuple, after: tuple) -> None:
        if after == self.START:
            self.kept.clear()
        elif after != before:
            self.kept.update(after)
        old, new = self.deadline(before), self.deadline(after)
        if old != new:
            if old is not None:
                self.handle.deleteTimer(old)
            if new is not None:
                self.handle.registerTimer(new)

    def _frame(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        names = [c.split()[0] for c in self.OUT.split(", ")]
        return pd.DataFrame([(key[0], *r) for r in rows], columns=["key", *names])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = state = self._read()
        out: list[tuple] = []
        batch = pd.concat(list(rows)).dropna(subset=["ms"]).sort_values(["ms", "event_id"])
        for row in batch.itertuples(index=False):
            state, due = self.expire(state, int(row.ms))
            state, new = self.step(state, row)
            out += due + new
        self._write(before, state)
        yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        before = self._read()
        state, out = self.expire(before, timerValues.getCurrentWatermarkInMs())
        self._write(before, state)
        yield self._frame(key, out)

    def close(self) -> None:
        pass


class Lease(Session):
    """One editor of an item at a time. A begin is granted if nobody holds the item, else refused, the holder's own too; an end counts from the
    holder alone; a lease lapses ``hold`` after its begin. Rows: event_id, ms, editor, ends. A lapse bears the event that was granted."""

    STATE = "holder long, until long, since long"
    OUT = "event_id long, editor long, outcome string, at long"
    START = (None, None, None)
    TIMERS = True

    def __init__(self, hold: int = 12 * HOUR):
        self.hold = hold

    def step(self, state, row):
        holder = state[0]
        if pd.isna(row.editor) or pd.isna(row.ends):
            return state, []
        seen = (int(row.event_id), int(row.editor))
        if row.ends:
            ended = holder == seen[1]
            return (self.START if ended else state), [(*seen, "ended" if ended else "ignored", int(row.ms))]
        if holder is not None:
            return state, [(*seen, "refused", int(row.ms))]
        return (seen[1], int(row.ms) + self.hold, seen[0]), [(*seen, "granted", int(row.ms))]

    def expire(self, state, now):
        holder, until, since = state
        return (self.START, [(since, holder, "lapsed", until)]) if until is not None and until <= now else (state, [])

    def deadline(self, state):
        return state[1]


class Progress(Session):
    """Reports that move the newest generation on: older generations, and what does not increase, are dropped. Rows: event_id, ms, generation, done."""

    STATE = "generation long, done double"
    OUT = "event_id long, generation long, done double"
    START = (None, None)

    def step(self, state, row):
        if pd.isna(row.generation) or pd.isna(row.done):
            return state, []
        at, to = int(row.generation), float(row.done)
        if state[0] is not None and (at < state[0] or (at == state[0] and to <= state[1])):
            return state, []
        return (at, to), [(int(row.event_id), at, to)]


class Delivery(Session):
    """Results that may be shown: of the newest generation seen, and no quick one after its full one. Rows: event_id, ms, generation, kind."""

    STATE = "generation long, full boolean"
    OUT = "event_id long"
    START = (None, None)

    def step(self, state, row):
        if pd.isna(row.generation) or pd.isna(row.kind):
            return state, []
        newest, full = state
        if newest is None or row.generation > newest:
            newest, full = int(row.generation), False
        elif row.generation < newest or full:
            return state, []
        return (newest, full or row.kind == "full"), [(int(row.event_id),)]


class RenderLoop(Session):
    """An item is rendered with its settings until they are stable. A request starts a render unless one is under way; it takes ``cost``; if the settings
    are others by then, it is rendered again, else its result comes out with the number of rounds. A picture that is adopted comes out at once and the
    render under way is dropped. Rows: event_id, ms, kind (edit, request, adopt; others do nothing), value (settings of an edit; null: no edit)."""

    STATE = "settings double, rendered double, due long, rounds long"
    OUT = "outcome string, settings double, at long, rounds long"
    START = (0.0, None, None, None)
    TIMERS = True

    def __init__(self, cost: int = 8 * HOUR):
        self.cost = cost

    def step(self, state, row):
        settings, due = state[0], state[2]
        if row.kind == "edit" and not pd.isna(row.value):
            return (float(row.value), *state[1:]), []
        if row.kind == "request" and due is None:
            return (settings, settings, int(row.ms) + self.cost, 1), []
        if row.kind == "adopt":
            return (settings, None, None, None), [("adopted", settings, int(row.ms), 0)]
        return state, []

    def expire(self, state, now):
        settings, rendered, due, rounds = state
        while due is not None and due <= now:
            if rendered == settings:
                return (settings, None, None, None), [("rendered", settings, due, rounds)]
            rendered, due, rounds = settings, due + self.cost, rounds + 1
        return (settings, rendered, due, rounds), []

    def deadline(self, state):
        return state[2]


def stream_session(spark: SparkSession) -> SparkSession:
    """A session for streams on the same cluster: state in RocksDB (which typed state needs), times in UTC, the caller's settings untouched."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.session.timeZone", "UTC")
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    return own


def follow(rows: DataFrame, key: str, session: Session) -> DataFrame:
    """The session over a stream with ``key``, ``event_id``, ``ts`` (a timestamp) and the columns that it names."""
    if session.TIMERS:
        rows = rows.withWatermark("ts", "0 seconds")
    rows = rows.withColumn("ms", F.unix_millis("ts"))
    schema = f"key {rows.schema[key].dataType.simpleString()}, {session.OUT}"
    out = rows.groupBy(key).transformWithStateInPandas(session, schema, "Append", "EventTime" if session.TIMERS else "None")
    return out.withColumnRenamed("key", key)


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of a folder as they arrive: one file, several, or a folder of files."""
    path = f"{sf_dir}/events*.parquet"
    rows = spark.readStream.schema(spark.read.parquet(path).schema).option("maxBytesPerTrigger", BATCH_BYTES).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def run(spark: SparkSession, tag: str, source: str, result: DataFrame) -> DataFrame:
    """What the stream has put out so far, all files that are there taken in. The job stands in a folder named after itself and its source and goes
    on where it stopped; output and state are committed together by Spark's file sink."""
    out = shared_folder(spark, f"{tag}-{hashlib.sha256(source.encode()).hexdigest()[:16]}")
    writer = result.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{out}/data")


_EVENTS = """e AS (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) % 3 AS editor, event_type IN ('purchase', 'error') AS ends,
CASE WHEN event_type IN ('purchase', 'signup') THEN 'edit' WHEN event_type = 'view' THEN 'request' WHEN event_type = 'click' THEN 'adopt' END AS kind,
row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS n FROM (SELECT *, CAST(epoch_us(ts) // 1000 AS BIGINT) AS ms FROM events)), mark AS (SELECT max(ms) AS w FROM e)"""


@query(f"""WITH RECURSIVE {_EVENTS}, s AS (
SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS n, NULL::BIGINT AS event_id, NULL::BIGINT AS ms, NULL::BIGINT AS editor, NULL::VARCHAR AS outcome, NULL::BIGINT AS gone, NULL::BIGINT AS gone_editor, NULL::BIGINT AS gone_at, NULL::BIGINT AS holder, NULL::BIGINT AS until, NULL::BIGINT AS since FROM e
UNION ALL SELECT user_id, n, event_id, ms, editor, outcome, CASE WHEN lapsed THEN since END, CASE WHEN lapsed THEN holder END, CASE WHEN lapsed THEN until END,
CASE outcome WHEN 'granted' THEN editor WHEN 'ended' THEN NULL ELSE held END, CASE outcome WHEN 'granted' THEN ms + {12 * HOUR} WHEN 'ended' THEN NULL ELSE CASE WHEN held IS NOT NULL THEN until END END,
CASE outcome WHEN 'granted' THEN event_id WHEN 'ended' THEN NULL ELSE CASE WHEN held IS NOT NULL THEN since END END
FROM (SELECT *, CASE WHEN ends THEN CASE WHEN held = editor THEN 'ended' ELSE 'ignored' END WHEN held IS NOT NULL THEN 'refused' ELSE 'granted' END AS outcome
FROM (SELECT e.user_id, e.n, e.event_id, e.ms, e.editor, e.ends, s.holder, s.until, s.since, coalesce(s.until <= e.ms, false) AS lapsed, CASE WHEN s.until > e.ms THEN s.holder END AS held FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)))
SELECT user_id, event_id, editor, outcome, ms AS at_ms FROM s WHERE n > 0
UNION ALL SELECT user_id, gone, gone_editor, 'lapsed', gone_at FROM s WHERE gone_at IS NOT NULL
UNION ALL SELECT user_id, since, holder, 'lapsed', until FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC) AS back FROM s), mark WHERE back = 1 AND until < w""")
def lease_stream(spark, sf_dir):
    """Editors that begin and end on items: granted, refused, ended, ignored or lapsed, each with its time."""
    e = event_stream(stream_session(spark), sf_dir)
    rows = e.select("user_id", "event_id", "ts", (F.get_json_object("props", "$.k").cast("long") % 3).alias("editor"), F.col("event_type").isin("purchase", "error").alias("ends"))
    return run(spark, "lease", sf_dir, follow(rows, "user_id", Lease()).withColumnRenamed("at", "at_ms"))


@query("""WITH p AS (SELECT *, max(generation) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest,
max(value) OVER (PARTITION BY user_id, generation ORDER BY ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
FROM (SELECT *, CAST(epoch_us(ts) // 1000 AS BIGINT) AS ms, CAST(epoch_us(ts) // 259200000000 AS BIGINT) - CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS generation FROM events))
SELECT user_id, event_id, generation, value AS done FROM p WHERE newest IS NULL OR generation > newest OR (generation = newest AND value > before)""")
def progress_stream(spark, sf_dir):
    """Reports of exports, a generation each three days; errors still speak of the generation before."""
    e = event_stream(stream_session(spark), sf_dir)
    days = F.floor(F.unix_millis("ts") / (72 * HOUR)).cast("long")
    rows = e.select("user_id", "event_id", "ts", (days - F.when(F.col("event_type") == "error", 1).otherwise(0)).alias("generation"), F.col("value").alias("done"))
    return run(spark, "progress", sf_dir, follow(rows, "user_id", Progress()))


@query(f"""WITH RECURSIVE {_EVENTS}, s AS (
SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS n, NULL::VARCHAR AS kind, NULL::BIGINT AS ms, CAST(0 AS DOUBLE) AS old, NULL::BIGINT AS out_at, NULL::BIGINT AS out_rounds, CAST(0 AS DOUBLE) AS settings, NULL::DOUBLE AS rendered, NULL::BIGINT AS due, NULL::BIGINT AS rounds FROM e
UNION ALL SELECT user_id, n, kind, ms, settings, out_at, CASE WHEN out_at IS NOT NULL THEN rounds + again END,
CASE WHEN kind = 'edit' AND value IS NOT NULL THEN value ELSE settings END,
CASE WHEN kind = 'adopt' THEN NULL WHEN idle THEN CASE WHEN kind = 'request' THEN settings END WHEN over THEN settings ELSE rendered END,
CASE WHEN kind = 'adopt' THEN NULL WHEN idle THEN CASE WHEN kind = 'request' THEN ms + {8 * HOUR} END WHEN over THEN due + {8 * HOUR} ELSE due END,
CASE WHEN kind = 'adopt' THEN NULL WHEN idle THEN CASE WHEN kind = 'request' THEN 1 END WHEN over THEN rounds + 1 ELSE rounds END
FROM (SELECT *, due IS NULL OR out_at IS NOT NULL AS idle FROM (SELECT *, CASE WHEN over AND again = 0 THEN due WHEN over AND due + {8 * HOUR} <= ms THEN due + {8 * HOUR} END AS out_at
FROM (SELECT e.user_id, e.n, e.kind, e.ms, e.value, s.settings, s.rendered, s.due, s.rounds, coalesce(s.due <= e.ms, false) AS over, CASE WHEN s.rendered = s.settings THEN 0 ELSE 1 END AS again FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1))))
SELECT user_id, 'rendered' AS outcome, old AS settings, out_at AS at_ms, out_rounds AS rounds FROM s WHERE out_at IS NOT NULL
UNION ALL SELECT user_id, 'adopted', old, ms, 0 FROM s WHERE kind = 'adopt'
UNION ALL SELECT user_id, 'rendered', settings, last_at, last_rounds FROM (SELECT *, CASE WHEN rendered = settings THEN due ELSE due + {8 * HOUR} END AS last_at, CASE WHEN rendered = settings THEN rounds ELSE rounds + 1 END AS last_rounds FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC) AS back FROM s)), mark WHERE back = 1 AND last_at < w""")
def render_loop_stream(spark, sf_dir):
    """Edits, requests and adopted pictures of items: what is shown, with which settings, when, after how many rounds."""
    e = event_stream(stream_session(spark), sf_dir)
    kind = F.when(F.col("event_type").isin("purchase", "signup"), "edit").when(F.col("event_type") == "view", "request").when(F.col("event_type") == "click", "adopt")
    rows = e.select("user_id", "event_id", "ts", kind.alias("kind"), "value")
    return run(spark, "render-loop", sf_dir, follow(rows, "user_id", RenderLoop()).withColumnRenamed("at", "at_ms"))
