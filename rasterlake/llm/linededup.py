"""Line deduplication: lines that stand in many documents are dropped everywhere.

Lines are exploded as hashes only: (document, position, hash of the key). A key is the line stripped of white space at
both ends with A-Z lower-cased. A document counts once for each different key it holds: its first line of a key says so, and so the
number of documents per hash is a plain count that Spark combines before the shuffle. The positions of
lines whose hash reaches the threshold go back to their document, which drops them and joins the other lines in order;
the text itself is shuffled once, there.

A key's hash is 128 bits, so that at any number of lines no two keys fall together. A common line is in many documents: positions meet the
common hashes through ``join_hot``, which leaves the rows of the commonest where they are.

Defined results: each row is a document of its own, also with a repeated or null id; null and empty texts are one empty line;
empty keys (and those under ``least_length`` code points) are never dropped; a document that loses all lines is empty text; \\r before \\n belongs to the
white space of its line; other columns are ignored by ``scan`` and kept by ``clean``; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterlake.llm._common import join_hot, materialise

SPACE = b" \t\n\x0b\x0c\r"
MIN_DOCS = 10


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keys_of(text: bytes, least_length: int) -> list[tuple[int, bytes]]:
    """(position, key) of the lines whose key is long enough."""
    found = [(at, line.strip(SPACE)) for at, line in enumerate(text.lower().split(b"\n"))]  # bytes: lowers A-Z only
    return [(at, key) for at, key in found if key and (least_length <= 1 or len(key.decode("utf-8", "replace")) >= least_length)]


def exploded(docs: DataFrame, least_length: int = 1, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(id, h, at, code, new)`` of each line with a key: its document (id, and h of its text), position, hash, and whether it is the first of its
    document with this key."""
    content = F.col(text).cast("string")
    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(content).alias("h"), content.alias("text"))

    def run(batches):
        for batch in batches:
            of, places, codes, new = [], [], [], []
            for k, t in enumerate(batch.column(2).cast(pa.binary())):
                own = keys_of(t.as_buffer().to_pybytes(), least_length) if t.is_valid else []
                seen = set()
                for at, key in own:
                    code = xxhash.xxh3_128_digest(key)
                    of.append(k)
                    places.append(at)
                    codes.append(code)
                    new.append(code not in seen)
                    seen.add(code)
            two = np.frombuffer(b"".join(codes), np.int64).reshape(-1, 2)
            code = pa.StructArray.from_arrays([pa.array(two[:, c].copy()) for c in (0, 1)], names=["h1", "h2"])
            at = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(places, pa.int32()), code, pa.array(new, pa.bool_())], names=["id", "h", "at", "code", "new"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, h long, at int, code struct<h1: long, h2: long>, new boolean")


def common(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``(code, docs, n)`` of the keys that stand in at least ``min_docs`` documents: how many documents and lines have them."""
    counted = lines.groupBy("code").agg(F.count_if("new").alias("docs"), F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("docs") >= min_docs)


def _dropped(docs: DataFrame, min_docs: int, least_length: int, text: str, doc_id: str) -> DataFrame:
    """``(id, h, drop)``: the positions of the lines that each document loses, for documents that lose any. A document is told by its id and its text's hash:
    rows that share both lose the same lines."""
    lines = materialise(exploded(docs, least_length, text, doc_id), "linededup-lines")
    often = materialise(common(lines, min_docs).select("code", "n"), "linededup-common")
    met = join_hot(lines.select("id", "h", "at", "code"), often, "code", "n")
    return met.groupBy("id", "h").agg(F.collect_set("at").alias("drop"))


def _with_kept(docs: DataFrame, min_docs: int, least_length: int, text: str, doc_id: str) -> DataFrame:
    """All rows and columns of ``docs`` in a struct ``row``, with ``lines``, ``kept`` (positions that stay, in order)."""
    drop = _dropped(docs, min_docs, least_length, text, doc_id)
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs[doc_id].alias("r_id"), F.xxhash64(docs[text].cast("string")).alias("r_h"))
    both = rows.join(drop.hint("merge"), rows["r_id"].eqNullSafe(drop["id"]) & (rows["r_h"] == drop["h"]), "left")
    lines = both.select("row", lines_of(F.col("row").getField(text).cast("string")).alias("lines"), "drop")
    # array_except keeps order, and costs the sum of both lengths
    every = F.sequence(F.lit(0), F.size("lines") - 1)
    return lines.select("row", "lines", F.when(F.col("drop").isNull(), every).otherwise(F.array_except(every, "drop")).alias("kept"))


def _joined() -> Column:
    return F.array_join(F.transform("kept", lambda k: F.get("lines", k)), "\n")


def scan(docs: DataFrame, min_docs: int = MIN_DOCS, least_length: int = 1, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, n_lines, n_dropped, text)`` for each row: its lines before dropping, the lines it loses, and the text of the others."""
    kept = _with_kept(docs.select(doc_id, text), min_docs, least_length, text, doc_id)
    n = F.size("lines").cast("long")
    return kept.select(F.col("row").getField(doc_id).alias("doc_id"), n.alias("n_lines"), (n - F.size("kept")).alias("n_dropped"), _joined().alias("text"))


def clean(docs: DataFrame, min_docs: int = MIN_DOCS, least_length: int = 1, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with all their columns, common lines dropped from the text; rows that lose nothing keep theirs as it was (null stays null)."""
    kept = _with_kept(docs, min_docs, least_length, text, doc_id)
    out = F.when(F.size("kept") == F.size("lines"), F.col("row").getField(text)).otherwise(_joined())
    return kept.select(*((out if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns))


ORACLE = r"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT row, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM docs),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
often AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT row) >= 10),
marked AS (SELECT k.*, o.key IS NOT NULL AS gone FROM keyed k LEFT JOIN often o ON k.key = o.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY row
"""
