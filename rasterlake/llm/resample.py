"""Importance resampling towards a target distribution, with hashed runs of words as features.

A feature is a run of 1 to ``n`` words joined by a space; its bucket is the CRC-32 of its bytes modulo ``buckets``. One scan
of a text keeps a ring of zlib states, one for each of the last ``n`` starts: every word starts a state of its own and extends
the others by a space and itself, so each state passes through all runs from its start and no run is ever built as text.
The buckets of each text are written once (two bytes a feature); the counts of corpus and target, which are ``buckets`` numbers each, and the weights are made from them.

weight is the floored mean of the gains of a text's features; gain is floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets)))) for s of S
features of the corpus and t of T of the target in the bucket. score adds Gumbel noise that depends on the id alone, so that the
highest scores are a draw without replacement in proportion to exp(weight/1000). Ranks come from Spark's distributed sort: each row's place in its
range, plus the rows in the ranges before.

Defined results: null and empty texts have no features, weight 0 and cannot be drawn; a null id has the noise of an empty id and
comes after all others in a tie; rows that share id and score are ranked in any order; each row is a document; other columns are ignored; with
an empty table of documents the result is empty, with an empty target all t are 0.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlake.llm._common import materialise

#: Bytes of words in lower-cased UTF-8: digits, letters a-z and all of other scripts.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
PERCENT, LEAST_WORDS, SEED = 25, 20, 7


def scan(text: bytes, n: int, buckets: int) -> tuple[int, np.ndarray]:
    """(words, bucket of every run of 1 to ``n`` words) of one text."""
    words, ring, out, parts = 0, [], [], []
    for word in _WORD.findall(text.lower()):  # bytes: lowers A-Z only
        step = b" " + word
        ring = [crc32(word), *[crc32(step, state) for state in ring[: n - 1]]]
        out += ring
        words += 1
        if len(out) > 1 << 16:
            parts.append(np.array(out, np.int64) % buckets)
            out = []
    return words, np.concatenate([*parts, np.array(out, np.int64) % buckets])


def features(rows: DataFrame, n: int, buckets: int) -> DataFrame:
    """``(id, n_words, at)`` of ``(id, text)`` rows; at holds the buckets, as little-endian numbers."""
    kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                found = [scan(t or b"", n, buckets) for t in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([k for k, _ in found], pa.int64()), pa.array([b.astype(kind).tobytes() for _, b in found], pa.binary())], names=["id", "n_words", "at"]
                )

    return rows.mapInArrow(run, f"id {rows.schema[0].dataType.simpleString()}, n_words long, at binary")


def _counts(found: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket: ``buckets`` numbers a task, and as many for the driver."""
    kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for value in batch.column(0):
                total += np.bincount(np.frombuffer(value.as_buffer(), kind), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in found.select("at").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Gain of each bucket from the counts of corpus and target."""
    s, t, n = s.astype(float), t.astype(float), len(s)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weigh(docs: DataFrame, target: DataFrame, n: int = 2, buckets: int = 10_000, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, n_words, n_features, weight)`` for each row of ``docs``; ``target`` needs its text only."""
    found = materialise(features(docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text")), n, buckets), "resample-features")
    wanted = features(target.select(F.lit(0).alias("id"), F.col(text).cast("string").alias("text")), n, buckets)
    gain = docs.sparkSession.sparkContext.broadcast(gains(_counts(found, buckets), _counts(wanted, buckets)))  # ``buckets`` numbers
    kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")

    def run(batches):
        for batch in batches:
            held = [np.frombuffer(v.as_buffer(), kind) for v in batch.column(2)]
            weight = [int(gain.value[b].sum()) // len(b) if len(b) else 0 for b in held]  # // floors
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(b) for b in held], pa.int64()), pa.array(weight, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    return found.mapInArrow(run, f"doc_id {found.schema['id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, *order) -> DataFrame:
    """``rows`` with ``rank``, their place (from 1) in the whole order; the last column of the order should spread ties."""
    placed = materialise(rows.sort(*order).withColumn("at", F.monotonically_increasing_id()), "resample-sorted")
    # the id counts rows within a range (lower 33 bits) of the sort; ranges are as many as shuffle partitions
    sizes = sorted((r["part"], r["n"]) for r in placed.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, start = [], 0
    for part, n in sizes:
        before.append((part, start))
        start += n
    offsets = placed.sparkSession.createDataFrame(before, "part long, start long")
    inside = F.col("at").bitwiseAND(F.lit((1 << 33) - 1).cast("long"))
    out = placed.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(offsets), "part")
    return out.withColumn("rank", F.col("start") + inside + 1).drop("part", "start", "at")


def draw(
    docs: DataFrame, target: DataFrame, n: int = 2, buckets: int = 10_000, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """``(doc_id, n_words, n_features, weight, score, rank)`` for each row; rank is null for rows that are not drawn."""
    weighed = weigh(docs, target, n, buckets, text, doc_id)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
    scored = materialise(weighed.withColumn("score", F.col("weight") + noise), "resample-scores")
    able = scored.where(F.col("n_words") >= least_words)
    most = able.count() * percent // 100
    spread = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1024)).alias("tie")
    placed = ranked(able.select("*", spread), F.desc("score"), F.asc_nulls_last("doc_id"), "tie").drop("tie")
    drawn = placed.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    return drawn.unionByName(scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that are drawn, with all their columns; rows with an id that is drawn stay together."""
    drawn = draw(docs, target, text=text, doc_id=doc_id, **options).where(F.col("rank").isNotNull()).select(F.col("doc_id").alias("drawn_id")).distinct()
    return docs.join(drawn.hint("merge"), docs[doc_id].eqNullSafe(drawn["drawn_id"]), "left_semi")


#: CRC-32 is a fold over the bytes of each different feature, with the usual table of the reflected polynomial 0xEDB88320.
ORACLE = r"""
WITH RECURSIVE shifts AS (SELECT range AS byte, range AS c, 0 AS k FROM range(256)
  UNION ALL SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM shifts WHERE k < 8),
crc AS (SELECT list(c ORDER BY byte) AS step FROM shifts WHERE k = 8),
texts AS (SELECT row_number() OVER () AS row, doc_id, text, 1 AS corpus FROM documents UNION ALL SELECT -row_number() OVER (), NULL, text, 0 FROM benchmark),
words AS (SELECT row, corpus, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
runs AS (SELECT row, corpus, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM words),
hexed AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM runs)),
bucketed AS (SELECT f, xor(list_reduce(list_transform(range(1, len(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT), lambda acc, b: xor(acc >> 8, step[(xor(acc, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket
  FROM hexed, crc),
placed AS (SELECT r.row, r.corpus, b.bucket FROM runs r JOIN bucketed b ON r.f = b.f),
counts AS (SELECT bucket, count(*) FILTER (WHERE corpus = 1) AS s, count(*) FILTER (WHERE corpus = 0) AS t FROM placed GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0)::DOUBLE AS big_s, coalesce(sum(t), 0)::DOUBLE AS big_t FROM counts),
gains AS (SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (big_s + 10000)) / ((s + 1)::DOUBLE * (big_t + 10000)))) AS gain FROM counts, totals),
weights AS (SELECT p.row, count(*) AS n_features, floor(sum(gain) / count(*))::BIGINT AS weight FROM placed p JOIN gains g ON p.bucket = g.bucket WHERE p.corpus = 1 GROUP BY p.row),
scored AS (SELECT w.row, w.doc_id, len(w.w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(w.doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM words w LEFT JOIN weights x ON w.row = x.row WHERE w.corpus = 1),
able AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id ASC NULLS LAST) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT s.doc_id, s.n_features, s.weight, s.score, CASE WHEN place <= 25 * n // 100 THEN place END AS rank FROM scored s LEFT JOIN able a ON s.row = a.row
"""
