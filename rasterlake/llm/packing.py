"""Best-fit packing planned on the histogram of piece lengths.

1. One pass tokenises whole texts and cuts documents longer than a sequence into
   pieces; only (doc_id, piece, start, length, crc) is written.
2. The histogram has at most ``max_len`` lengths, so it may go to the driver. Best-fit
   decreasing runs over (length, count) and open sequences grouped by equal fill: a
   step places a whole run of equal pieces at once.
3. A plan row says: pieces of this length with rank in [first, first + n) go into
   sequences seq, seq + 1, ..., ``per`` to a sequence, from position ``fill`` on.
   Each length opens at most three groups, and a group's room at least halves each
   time it is used, so the plan has under 12 * 4 * max_len rows whatever the input is;
   that bound is what allows the broadcast.
4. Pieces get their rank within their length from counts per (length, bucket) and a
   row number inside the bucket, so a length that a third of all rows share is spread
   over all buckets, and look up their slot by a hash join on length with a rank range.

Defined results: null text counts as empty (one piece, the separator alone); repeated
rows are packed as rows of their own; a null doc_id is packed and returned as null;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from rasterlake.llm._common import materialise

MAX_LEN = 2048
SEPARATOR = 0
#: The tokenizer's own normaliser turns white space into one space and lowers letters, its splitter drops white space,
#: and no rule spans it: so a text's ids are those of its chunks between ASCII white space, one after the other.
#: Texts with combining marks are encoded whole: composing and lowering A-Z first need not commute there.
COMBINING = re.compile(rb"\xcc|\xcd[\x80-\xaf]")
#: Letters of Latin-1, which the normaliser only lowers, then signs: the splitter always cuts between the two.
LETTERS_AND_SIGNS = re.compile(rb"([a-z]*+(?:\xc3[\x80-\x96\x98-\xb6\xb8-\xbf][a-z]*+)*+)([!-&(-/:-@\[-`{-~]*+)")


def byte_letters() -> dict[int, str]:
    """The printable character for each byte in the vocabularies of byte-level tokenizers."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(others)}


class ChunkTokenizer(dict):
    """Ids of whole texts from a tokenizer file's contents. The dictionary itself is the bounded cache: chunk (UTF-8,
    A-Z lowered) to its ids as little-endian unsigned 32-bit numbers; a chunk is learnt when it is first looked up."""

    def __init__(self, content: str, most: int = 800_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.most = Tokenizer.from_str(content), most
        self.tokens, self.letters = self.tokenizer.model.tokenize, byte_letters()
        self.id_bytes = [k.to_bytes(4, "little") for k in range(self.tokenizer.get_vocab_size())]

    def __missing__(self, chunk: bytes) -> bytes:
        if len(self) >= self.most:
            self.clear()
        m = LETTERS_AND_SIGNS.fullmatch(chunk)
        if not m or not m[1]:
            ids = self.whole(chunk)
        elif m[2]:
            ids = self[m[1]] + self[m[2]]
        else:  # one piece for the splitter
            word = chunk.decode("ascii") if chunk.isascii() else chunk.decode().lower().encode().decode("latin-1").translate(self.letters)
            ids = b"".join([self.id_bytes[t.id] for t in self.tokens(word)])
        self[chunk] = ids
        return ids

    def whole(self, text: bytes) -> bytes:
        return b"".join(map(self.id_bytes.__getitem__, self.tokenizer.encode(text.decode(), add_special_tokens=False).ids))

    def ids(self, text: bytes) -> bytes:
        if not text.isascii() and COMBINING.search(text):
            return self.whole(text)
        return b"".join(map(self.__getitem__, text.lower().split()))


_READY: dict[str, ChunkTokenizer] = {}


def ready(content: str) -> ChunkTokenizer:
    """The tokenizer of this Python worker, with what earlier tasks learnt."""
    if content not in _READY:
        _READY.clear()
        _READY[content] = ChunkTokenizer(content)
    return _READY[content]


def pieces(docs: DataFrame, tokenizer_path: str, max_len: int = MAX_LEN, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``. The tokenizer file is read on the driver and sent along:
    its size is fixed by the vocabulary, and executors need not have it."""
    with open(tokenizer_path, encoding="utf-8") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        tokenizer, end = ready(content.value), SEPARATOR.to_bytes(4, "little")
        size = 4 * max_len
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                sizes, crcs, count = [], [], []
                for text in part.column(1).cast(pa.binary()).to_pylist():
                    ids = tokenizer.ids(text or b"") + end
                    cuts = [ids[at : at + size] for at in range(0, len(ids), size)] if len(ids) > size else [ids]
                    count.append(len(cuts))
                    sizes += map(len, cuts)
                    crcs += map(zlib.crc32, cuts)
                count = np.array(count)
                first = np.repeat(np.cumsum(count) - count, count)
                piece = np.arange(len(sizes)) - first
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(np.repeat(np.arange(len(count)), count))), pa.array(piece.astype(np.int32)), pa.array(piece * max_len), pa.array(np.array(sizes) // 4), pa.array(np.array(crcs, np.int64))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], max_len: int = MAX_LEN) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows (length, first rank, n, first sequence, fill, per sequence)."""
    out, opened = [], 0
    rooms: list[int] = []  # sorted rooms that have open sequences
    groups: dict[int, list[tuple[int, int]]] = {}  # room -> [(first sequence, sequences)]

    def add(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in groups:
                bisect.insort(rooms, room)
                groups[room] = []
            groups[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(at)
            else:
                room, first, n = max_len, opened, -(-left // (max_len // length))
                opened += n
            per = room // length
            placed = min(left, n * per)
            full, rest = divmod(placed, per)
            out.append((length, rank, placed, first, max_len - room, per))
            add(room - per * length, first, full)
            if rest:
                add(room - rest * length, first + full, 1)
            add(room, first + full + (rest > 0), n - full - (rest > 0))
            left, rank = left - placed, rank + placed
    return out


def pack(docs: DataFrame, tokenizer_path: str, max_len: int = MAX_LEN, rows_per_bucket: int = 20_000, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)`` for each piece."""
    spark = docs.sparkSession
    cut = materialise(pieces(docs, tokenizer_path, max_len, text, doc_id), "packing-pieces")
    histogram = {r.length: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # max_len rows at most
    slots = plan(histogram, max_len)
    kind = T.StructType([T.StructField(c, T.LongType(), False) for c in ("length", "first", "n", "seq", "fill", "per")])
    slots = spark.createDataFrame(slots, kind)
    buckets = max(64, -(-sum(histogram.values()) // rows_per_bucket))
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("k")).select("length", "bucket", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = dealt.withColumn("inner", F.row_number().over(inside) - 1).join(base, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("inner"))
    placed = ranked.alias("p").join(F.broadcast(slots).alias("s"), (F.col("p.length") == F.col("s.length")) & (F.col("p.rank") >= F.col("s.first")) & (F.col("p.rank") < F.col("s.first") + F.col("s.n")))
    k = F.col("p.rank") - F.col("s.first")
    return placed.select(
        "doc_id", "piece", "start", F.col("p.length").alias("length"), "ids_crc32",
        (F.col("s.seq") + F.floor(k / F.col("s.per")).cast("long")).alias("sequence_id"),
        (F.col("s.fill") + F.pmod(k, F.col("s.per")) * F.col("p.length")).alias("offset"),
    )
