"""RAW containers as tables.

``binaryFile`` lists the files; a small parser turns one file's bytes into section rows (a malformed file
becomes one row with an error text and never fails a batch); packed and Huffman-coded rasters become
ranges of rows, which different tasks decode: every row of a raster starts anew, so sums run inside a row, 16-bit
wrapping comes once after the sum, and the global minimum is a partial aggregate.
"""

from __future__ import annotations

import functools
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.plans.registry import query
from rasterlake.plans.shared import written
from rasterlake.sources import surrogates as S

#: Fixed values of the format.
MAGIC, DIRECTORY, MOST_SECTIONS, MOST_PAIRS, TABLE, MOST_SIDE = b"FOVb", b"SECd", 1024, 4096, 1024, 20000
HEADER = {"SECp": 24, "SECi": 28, "SEC2": 28, "SECc": 28}
SECTIONS = "path string, pos int, identifier string, kind long, format long, columns long, rows long, stride long, n long, data binary, error string"


def _sections(path: str, blob: bytes) -> list[tuple]:
    bad = lambda why: [(path, *(None,) * 9, why)]
    if len(blob) < 16 or blob[:4] != MAGIC:
        return bad("bad magic")
    (at,) = struct.unpack_from("<I", blob, len(blob) - 4)
    if at + 12 > len(blob) or blob[at : at + 4] != DIRECTORY:
        return bad("no directory")
    (n,) = struct.unpack_from("<I", blob, at + 8)
    if n > MOST_SECTIONS or at + 12 + 12 * n > len(blob):
        return bad("directory out of range")
    out = []
    for k in range(n):
        start, size = struct.unpack_from("<II", blob, at + 12 + 12 * k)
        body = blob[start : start + size]
        if len(body) < size or size < 8:
            return bad("truncated section")
        name = body[:4].decode("latin-1")
        head = HEADER.get(name, 8)
        five = struct.unpack_from("<5I", body, 8) if head == 28 and size >= 28 else (None,) * 5
        count, form = struct.unpack_from("<II", body, 8) if name == "SECp" and size >= 24 else (None, None)
        n = count if count is not None and count <= MOST_PAIRS and form == 0 else None  # lists of UTF-16 pairs only
        out.append((path, k, name, *five, n, body[head:], None))
    return out


def sections(files: DataFrame) -> DataFrame:
    """Section rows of ``(path, content)``, as ``binaryFile`` gives them."""

    def run(batches):
        for pdf in batches:
            rows = [r for p, b in zip(pdf["path"], pdf["content"]) for r in _sections(p, b)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SECTIONS.split(", ")]).astype(object)

    return files.select("path", "content").mapInPandas(run, SECTIONS)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Section rows of all files under a folder."""
    return sections(spark.read.format("binaryFile").option("pathGlobFilter", "*.[xX]3[fF]").option("recursiveFileLookup", "true").load(path))


HEADERS = "path string, version long, rotation long, orientation int, white_balance string, error string"
#: Fixed values of the format: from this version on the header has no rotation; from that one on it has a white balance.
NO_ROTATION, HAS_BALANCE = 0x40000, 0x20001


def headers(files: DataFrame) -> DataFrame:
    """Version, rotation (with its TIFF orientation) and white balance of each file."""

    def one(path: str, blob: bytes) -> tuple:
        if len(blob) < 8 or blob[:4] != MAGIC:
            return path, None, None, None, None, "bad magic"
        (version,) = struct.unpack_from("<I", blob, 4)
        rotation, balance = 0, ""
        if version < NO_ROTATION:
            if len(blob) < 72:
                return path, version, None, None, None, "short header"
            (rotation,) = struct.unpack_from("<I", blob, 36)
            balance = _text(blob[40:72], 0) if version >= HAS_BALANCE else ""
        return path, version, rotation, {90: 6, 180: 3, 270: 8}.get(rotation, 1), balance, None

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([one(p, b) for p, b in zip(pdf["path"], pdf["content"])], columns=[c.split()[0] for c in HEADERS.split(", ")]).astype(object)

    return files.select("path", F.substring("content", 1, 72).alias("content")).mapInPandas(run, HEADERS)


#: Fixed values of the format: type and formats of raw images.
RAW_KIND, RAW_FORMATS = 3, (5, 6)


def image_section(rows: DataFrame) -> DataFrame:
    """The first raw image section of each file (previews are image sections of other formats); a file without one, or with one that is too
    short for what it announces, gets a row with an error."""
    image, raw = F.col("identifier") == "SECi", (F.col("kind") == RAW_KIND) & F.col("format").isin(*RAW_FORMATS)
    best = rows.groupBy("path").agg(
        F.min_by(F.struct("format", "columns", "rows", "stride", "data"), F.when(image & raw, F.col("pos"))).alias("s"), F.max(image).alias("some"), F.first("error", ignorenulls=True).alias("error")
    )
    size = F.length("s.data")
    side = F.col("s.columns").between(1, MOST_SIDE) & F.col("s.rows").between(1, MOST_SIDE)
    wrong = (
        F.when(~F.coalesce("some", F.lit(False)), "no image section")
        .when(F.col("s").isNull(), "no image section of a raw format")
        .when(~side, "implausible image size")
        .when(size < 2 * TABLE, "mapping table out of range")
        .when((F.col("s.stride") == 0) & (size < 6 * TABLE + 4 * F.col("s.rows")), "code table or row offsets out of range")
        .when((F.col("s.stride") > 0) & (size < 2 * TABLE + F.col("s.stride") * (F.col("s.rows") - 1) + 4 * F.col("s.columns")), "image out of range")
    )
    return best.select("path", "s.*", F.coalesce("error", wrong).alias("error"))


def huffman(table: np.ndarray) -> dict[tuple[int, int], int]:
    """(length, code) to entry; a word holds 5 bits of length over 27 bits of code, words wider than their length go."""
    return {(w >> 27, w & 0x7FFFFFF): k for k, w in reversed(list(enumerate(table.tolist()))) if w and w >> 27 and (w & 0x7FFFFFF) < 1 << (w >> 27)}


class Codes:
    """The codes as ranges of left-aligned bit patterns, so that the code at every bit of a row is one search in NumPy."""

    def __init__(self, codes: dict[tuple[int, int], int], mapping: np.ndarray):
        self.longest = max((length for length, _ in codes), default=0)
        spans: list[tuple[int, int, int, int]] = []
        for (length, code), k in sorted(codes.items()):  # a code behind a shorter one that begins it is never reached
            lo, hi = code << (self.longest - length), (code + 1) << (self.longest - length)
            if not any(a <= lo < b for a, b, _, _ in spans if b - a > hi - lo):
                spans.append((lo, hi, length, int(mapping[k])))
        spans.sort()
        self.lo, self.hi, self.length, self.value = (np.array([s[i] for s in spans], np.int64) for i in range(4))

    def row(self, data: bytes, n: int) -> list[int]:
        """n mapped symbols of a row, most significant bit first; zeros follow the end, a code that leads nowhere is 0."""
        if not self.longest or not len(self.lo):
            return [0] * n
        bits = np.concatenate([np.unpackbits(np.frombuffer(data, np.uint8)), np.zeros(self.longest + 1, np.uint8)]).astype(np.int64)
        size = len(bits) - self.longest
        window = np.zeros(size, np.int64)
        for k in range(self.longest):
            window = window << 1 | bits[k : k + size]
        at = np.searchsorted(self.lo, window, "right") - 1
        known = (at >= 0) & (window < self.hi[at])
        step = np.where(known, self.length[at], self.longest).tolist()
        value, last = np.where(known, self.value[at], 0).tolist(), size - 1
        out, place = [], 0
        for _ in range(n):
            out.append(value[place])
            place = min(place + step[place], last)
        return out


#: Raster rows that a task decodes at a time.
RANGE = 64
SLICES = "path string, coded boolean, columns int, y int, tables binary, starts array<long>, body binary"


def slices(images: DataFrame, rows_per_range: int = RANGE) -> DataFrame:
    """Ranges of rows of image sections: the tables (2 or 6 KB), where each row starts in the range's bytes, and these bytes. Every row starts anew, so the
    offsets that a coded section ends with (a packed one's stride) are restart points."""

    def cut(columns: int, rows: int, stride: int, data: bytes):
        head = 2 * TABLE if stride else 6 * TABLE
        end = len(data) if stride else len(data) - 4 * rows
        starts = head + (stride * np.arange(rows) if stride else np.frombuffer(data, "<u4", rows, end).astype(np.int64))
        for y in range(0, rows, rows_per_range):
            own = starts[y : y + rows_per_range]
            # a row's bytes end where the next one's start, so the range has that place, too
            after = int(starts[y + len(own)]) if y + len(own) < rows else end
            lo, hi = int(own.min()), max(after, int(own.max()))
            yield y, data[:head], [*(own - lo).tolist(), max(after - lo, 0)], data[lo : min(hi + 4 * columns if stride else hi, end)]

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                for y, tables, starts, body in cut(int(r.columns), int(r.rows), int(r.stride), r.data):
                    yield pd.DataFrame([(r.path, r.stride == 0, int(r.columns), y, tables, starts, body)], columns=[c.split()[0] for c in SLICES.split(", ")])

    return images.where("error is null").select("path", "columns", "rows", "stride", "data").mapInPandas(run, SLICES)


def _rows(coded: bool, columns: int, tables: bytes, starts, body: bytes) -> np.ndarray:
    """Samples (rows, columns, 3) of a range: differences summed along each row and channel, wrapped to 16 bits."""
    mapping, n = np.frombuffer(tables, "<u2", TABLE).astype(np.int64), len(starts) - 1
    if coded:
        codes = Codes(huffman(np.frombuffer(tables, "<u4", TABLE, 2 * TABLE)), mapping)
        d = np.array([codes.row(body[lo:hi], 3 * columns) for lo, hi in zip(starts[:-1], starts[1:])], np.int64).reshape(n, columns, 3)
    else:
        words = np.stack([np.frombuffer(body, "<u4", columns, int(lo)) for lo in starts[:-1]])
        d = mapping[np.stack([(words >> (10 * c)) & 1023 for c in range(3)], -1)]
    return (np.cumsum(d, 1) + 32768 & 0xFFFF) - 32768


def raster_rows(images: DataFrame, rows_per_range: int = RANGE) -> DataFrame:
    """``(path, coded, y, ch, v)``: the samples of each row and channel as an array, ranges of a file being decoded in different tasks. A task holds one
    range at a time, ``rows_per_range`` x columns x 3 numbers and its bytes."""

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                v = _rows(r.coded, int(r.columns), r.tables, r.starts, r.body).astype(np.int32)
                rows = [(r.path, r.coded, r.y + k, c, v[k, :, c]) for k in range(len(v)) for c in range(3)]
                yield pd.DataFrame(rows, columns=["path", "coded", "y", "ch", "v"])

    # a stated number of partitions: coded bytes are few, and joining small partitions would put a whole file into one task
    n = int(images.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = slices(images, rows_per_range).repartition(n, "path", "y")
    return dealt.mapInPandas(run, "path string, coded boolean, y int, ch int, v array<int>")


def decode(images: DataFrame, rows_per_range: int = RANGE) -> DataFrame:
    """``(path, y, x, ch, s)`` of image sections: packed ones clamp at 0, coded ones are lifted by their smallest sample. Rows are decoded once, and written
    for the two uses of them."""
    rows = written(raster_rows(images, rows_per_range), "x3f-rows")
    low = rows.where("coded").groupBy("path").agg(F.least(F.min(F.array_min("v")), F.lit(0)).alias("low"))
    px = rows.join(low, "path", "left").select("path", "y", "ch", "coded", "low", F.posexplode("v").alias("x", "v"))
    return px.select("path", "y", "x", "ch", F.when(F.col("coded"), F.col("v") - F.col("low")).otherwise(F.greatest("v", F.lit(0))).cast("long").alias("s"))


@functools.cache
def _cycle() -> tuple[np.ndarray, np.ndarray]:
    """The states of the cipher's linear congruence in the order it runs through them all, and each state's place."""
    states, key = np.zeros(244944, np.int64), 0
    for k in range(len(states)):
        states[k] = key
        key = (key * 1597 + 51749) % 244944
    place = np.zeros_like(states)
    place[states] = np.arange(len(states))
    return states, place


def keystream(key: int, n: int) -> np.ndarray:
    """The cipher's bytes: a linear congruence scaled to one byte."""
    states, place = _cycle()
    first = (key * 1597 + 51749) % 244944
    return ((states[(place[first] + np.arange(n)) % len(states)] << 8) // 244944).astype(np.uint8)


def decrypt(data: bytes, key: int) -> bytes:
    return (np.frombuffer(data, np.uint8) ^ keystream(key, len(data))).tobytes()


def properties(rows: DataFrame) -> DataFrame:
    """``(path, key, value)`` of property sections, the first of equal keys: UTF-16 pairs behind a table of offsets."""

    def text(heap: bytes, at: int) -> str:
        raw = heap[2 * at :]
        units = np.frombuffer(raw[: len(raw) // 2 * 2], "<u2")
        end = np.flatnonzero(units == 0)
        return raw[: 2 * (end[0] if len(end) else len(units))].decode("utf-16-le", "replace")

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                count = min(int(r.n), len(r.data) // 8)
                table = np.frombuffer(r.data[: 8 * count], "<u4").reshape(-1, 2)
                heap = r.data[8 * count :]
                out += [(r.path, k, text(heap, int(a)), text(heap, int(b))) for k, (a, b) in enumerate(table[:count])]
            yield pd.DataFrame(out, columns=["path", "pos", "key", "value"])

    named = rows.where("identifier = 'SECp' and n is not null").select("path", "n", "data")
    return named.mapInPandas(run, "path string, pos int, key string, value string").groupBy("path", "key").agg(F.min_by("value", "pos").alias("value"))


def container(bodies: list[bytes], rotation: int = 0, balance: str = "") -> bytes:
    """A file of the given sections, for round trips."""
    head = MAGIC + struct.pack("<I", 0x00020003) + bytes(28) + struct.pack("<I", rotation) + balance.encode()[:31].ljust(32, b"\0")
    at, places = len(head), []
    for b in bodies:
        places.append((at, len(b), b[:4]))
        at += len(b)
    return head + b"".join(bodies) + DIRECTORY + struct.pack("<II", 0x00020000, len(bodies)) + b"".join(struct.pack("<II", o, n) + t for o, n, t in places) + struct.pack("<I", at)


def packed_section(image: np.ndarray, mapping: np.ndarray, index: dict[int, int]) -> bytes:
    """An image section of (rows, columns, 3) samples whose differences are in the mapping."""
    d = np.diff(image.astype(np.int64), axis=1, prepend=0)
    idx = np.vectorize(index.__getitem__)(d)
    words = (idx[..., 0] | idx[..., 1] << 10 | idx[..., 2] << 20).astype("<u4")
    return b"SECi" + struct.pack("<6I", 0x20000, RAW_KIND, 5, image.shape[1], image.shape[0], 4 * image.shape[1]) + mapping.astype("<u2").tobytes() + words.tobytes()


def coded_section(image: np.ndarray) -> bytes:
    """An image section of (rows, columns, 3) samples in prefix codes, for round trips: three bits for the seven smallest differences, thirteen for the others (1,024 in all)."""
    d = np.diff(image.astype(np.int64), axis=1, prepend=0)
    values = sorted(set(d.ravel().tolist()), key=lambda v: (abs(v), v))
    words = {v: (3, k) if k < 7 else (13, 7 << 10 | k) for k, v in enumerate(values)}
    mapping = np.zeros(TABLE, "<u2")
    mapping[: len(values)] = np.array(values) & 0xFFFF
    table = np.zeros(TABLE, "<u4")
    table[: len(values)] = [n << 27 | code for n, code in words.values()]
    body, offsets = b"", []
    for row in d.reshape(len(d), -1).tolist():
        offsets.append(len(body))
        bits = "".join(f"{code:0{n}b}" for n, code in map(words.__getitem__, row))
        body += int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    head = b"SECi" + struct.pack("<6I", 0x20000, RAW_KIND, 6, image.shape[1], image.shape[0], 0)
    return head + mapping.tobytes() + table.tobytes() + body + np.array(offsets, "<u4").tobytes()


def _containers(spark, sf_dir, section, shift: int) -> DataFrame:
    """Every colour image, a sixteenth of its samples less ``shift``, as ``(path, content)`` of a container with one ``section`` of it."""
    px = S.colour(spark, sf_dir)
    cells = px.select("image_id", F.struct("y", "x", *((F.floor(F.col(f"c{k}") / 16) - shift).alias(f"c{k}") for k in range(3))).alias("p"))
    images = cells.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: F.array(p["c0"], p["c1"], p["c2"])).alias("px"))

    def write(batches):
        for pdf in batches:
            blobs = [container([section(np.stack([np.asarray(v) for v in p]).reshape(S.SIDE, S.SIDE, 3))]) for p in pdf["px"]]
            yield pd.DataFrame({"path": pdf["image_id"].astype(str), "content": blobs})

    return images.mapInPandas(write, "path string, content binary")


@query(f"SELECT image_id, y, x, unnest([0, 1, 2]) AS ch, unnest([CAST(floor(c0 / 16) AS BIGINT), CAST(floor(c1 / 16) AS BIGINT), CAST(floor(c2 / 16) AS BIGINT)]) AS s FROM ({S.COLOUR})")
def x3f_round_trip(spark, sf_dir):
    """Every colour image written as a packed container and read back."""

    def section(image):
        return packed_section(image, (np.arange(TABLE) - 512) & 0xFFFF, {k - 512: k for k in range(TABLE)})

    files = _containers(spark, sf_dir, section, 0)
    return decode(image_section(sections(files))).select(F.col("path").cast("long").alias("image_id"), "y", "x", "ch", "s")


@query(
    f"WITH p AS (SELECT image_id, y, x, unnest([0, 1, 2]) AS ch, unnest([CAST(floor(c0 / 16) AS BIGINT), CAST(floor(c1 / 16) AS BIGINT), CAST(floor(c2 / 16) AS BIGINT)]) - 100 AS v FROM ({S.COLOUR})) "
    "SELECT image_id, y, x, ch, v - least(min(v) OVER (PARTITION BY image_id), 0) AS s FROM p"
)
def x3f_coded_round_trip(spark, sf_dir):
    """Every colour image, shifted below zero, written as a coded container and decoded by ranges of three rows; the smallest sample becomes 0."""
    files = _containers(spark, sf_dir, coded_section, 100)
    return decode(image_section(sections(files)), rows_per_range=3).select(F.col("path").cast("long").alias("image_id"), "y", "x", "ch", "s")


#: Fixed values of the format: entry tags and element types of matrices.
TAGS = {b"CMbP": "property", b"CMbM": "matrix", b"CMbT": "text"}
ELEMENTS = {0: "<i2", 1: "<u4", 2: "<u4", 3: "<f4", 5: "u1", 6: "<u2"}
MOST_ELEMENTS = 1 << 24
ENTRIES = "path string, pos int, name string, kind string, dims array<int>, f64 array<double>, i32 array<int>, u32 array<long>, props array<struct<key: string, value: string>>, error string"


def _text(blob: bytes, at: int) -> str:
    return blob[at : blob.index(b"\0", at)].decode("utf-8", "replace") if 0 <= at < len(blob) and b"\0" in blob[at:] else blob[at:].decode("utf-8", "replace")


def _value(kind: str, entry: bytes, at: int) -> dict:
    if kind == "property":
        n, base = struct.unpack_from("<II", entry, at)
        pairs = np.frombuffer(entry, "<u4", 2 * n, at + 8).reshape(-1, 2) + base
        return {"props": [{"key": _text(entry, int(a)), "value": _text(entry, int(b))} for a, b in pairs]}
    element, rank, base = struct.unpack_from("<III", entry, at)
    if rank > 3 or element not in ELEMENTS:
        return {"error": "more than three dimensions" if rank > 3 else f"unknown element type {element}"}
    dims = [struct.unpack_from("<I", entry, at + 12 + 12 * k)[0] for k in range(rank)]
    n = int(np.prod(dims, dtype=object)) if dims else 1
    dtype = np.dtype(ELEMENTS[element])
    if n > MOST_ELEMENTS or base + n * dtype.itemsize > len(entry):
        return {"error": "matrix out of bounds"}
    column = {"f": "f64", "i": "i32", "u": "u32"}[dtype.kind]
    return {"dims": dims, column: np.frombuffer(entry, dtype, n, base).tolist()}


def _entries(blob: bytes):
    """Name, kind and value of each entry; text entries are passed over, an unknown tag ends the list."""
    at = 0
    while at + 20 <= len(blob) and (kind := TAGS.get(blob[at : at + 4])):
        size, name, value = struct.unpack_from("<3I", blob, at + 8)
        if size < 20 or at + size > len(blob):
            return
        entry = blob[at : at + size]
        if kind != "text":
            try:
                yield {"name": _text(entry, name), "kind": kind, **_value(kind, entry, value)}
            except (struct.error, ValueError) as e:
                yield {"name": _text(entry, name), "kind": kind, "error": str(e)}
        at += size


def entries(rows: DataFrame) -> DataFrame:
    """Metadata entries of enciphered sections, in file order: typed arrays for matrices, pairs for property
    lists. A malformed entry is a row with an error. The key is the last number of the section's header."""
    names = [c.split()[0] for c in ("path", "pos", "name", "kind", "dims", "f64", "i32", "u32", "props", "error")]

    def run(batches):
        for pdf in batches:
            out = [{"path": r.path, "pos": k, **e} for r in pdf.itertuples() for k, e in enumerate(_entries(decrypt(r.data, int(r.stride))))]
            yield pd.DataFrame(out, columns=names).astype(object).where(lambda d: d.notna(), None)

    return rows.where("identifier = 'SECc' and kind = 2").select("path", "stride", "data").mapInPandas(run, ENTRIES)
