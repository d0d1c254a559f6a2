"""TIFF and DNG files: sinks that make one row of bytes of each image (written by ``save``), a scan of their directories as rows,
and the replacement of a file's metadata packet. Layout is planned in one pass: every reference has four bytes, so all sizes are known before any place is."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlake.plans.registry import query
from rasterlake.sources import surrogates as S


def tiff_bytes(image: np.ndarray) -> bytes:
    """(rows, columns, 3) to a little-endian TIFF of half floats; values beyond the range are the largest finite ones."""
    h, w, _ = image.shape
    data = np.clip(np.nan_to_num(image, nan=0.0), -65504, 65504).astype("<f2").tobytes()
    heap = 8 + 2 + 12 * 11 + 4
    tags = [
        (256, 4, 1, w), (257, 4, 1, h), (258, 3, 3, heap), (259, 3, 1, 1), (262, 3, 1, 2), (273, 4, 1, heap + 12),
        (277, 3, 1, 3), (278, 4, 1, h), (279, 4, 1, len(data)), (284, 3, 1, 1), (339, 3, 3, heap + 6),
    ]
    ifd = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in sorted(tags)) + struct.pack("<I", 0)
    return b"II*\0" + struct.pack("<I", 8) + ifd + struct.pack("<3H", 16, 16, 16) + struct.pack("<3H", 3, 3, 3) + data


def encode(px: DataFrame) -> DataFrame:
    """``(image_id, content)`` from linear pixels; one shuffle by image, one array per image."""
    cells = px.select("image_id", F.struct("y", "x", "r", "g", "b").alias("p"))
    shape = [F.max(F.col(f"p.{c}")).alias(f"m{c}") for c in "yx"]
    images = cells.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: F.array(p["r"], p["g"], p["b"])).alias("px"), *shape)

    def run(batches):
        for pdf in batches:
            blobs = [tiff_bytes(np.stack([np.asarray(v) for v in p]).reshape(y + 1, x + 1, 3)) for p, y, x in zip(pdf["px"], pdf["my"], pdf["mx"])]
            yield pd.DataFrame({"image_id": pdf["image_id"], "content": blobs})

    return images.mapInPandas(run, "image_id long, content binary")


@query(f"SELECT image_id, CAST(158 + count(*) * 6 AS BIGINT) AS size FROM ({S.LINEAR}) GROUP BY 1")
def tiff_sizes(spark, sf_dir):
    return encode(S.linear(spark, sf_dir)).select("image_id", F.length("content").cast("long").alias("size"))


#: Fixed values of the format: bytes of a value by type; unsigned, signed and text types.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
BYTE, ASCII, SHORT, LONG, RATIONAL, UNDEFINED, SRATIONAL = 1, 2, 3, 4, 5, 7, 10
STRIP, STRIP_SIZE, SUBDIRECTORY, XMP, MOST_FIELDS = 273, 279, 330, 700, 4096


def numbers(kind: int, values) -> tuple[int, int, bytes]:
    """Type, count and bytes of a field; fractions are stored over 1,000,000, unsigned ones from 0 on."""
    values = list(values)
    if kind in (RATIONAL, SRATIONAL):
        parts = [x for v in values for x in (round((max(v, 0.0) if kind == RATIONAL else v) * 1_000_000), 1_000_000)]
        return kind, len(values), struct.pack(f"<{len(parts)}{'I' if kind == RATIONAL else 'i'}", *parts)
    return kind, len(values), struct.pack(f"<{len(values)}{ {SHORT: 'H', LONG: 'I'}.get(kind, 'B')}", *values)


def assemble(directories: list[dict[int, tuple[int, int, bytes]]], strips: list[bytes]) -> bytes:
    """A little-endian TIFF of these directories (fields by tag); the k-th has the k-th strip. The first refers to the second as its subdirectory.
    Directories come first, then values that do not fit their entry, then strips, the first directory's last; all start at even places."""
    directories = [d | {STRIP: (LONG, 1, bytes(4))} | ({SUBDIRECTORY: (LONG, 1, bytes(4))} if k == 0 and len(directories) > 1 else {}) for k, d in enumerate(directories)]
    starts, at = [], 8
    for d in directories:
        starts.append(at)
        at += 2 + 12 * len(d) + 4
    heap, places = bytearray(), {}
    for k, d in enumerate(directories):
        for tag in sorted(d):
            if len(d[tag][2]) > 4:
                places[k, tag] = at + len(heap)
                heap += d[tag][2] + bytes(len(d[tag][2]) % 2)
    at += len(heap)
    for k in reversed(range(len(directories))):
        at += at % 2
        places[k, STRIP] = at
        at += len(strips[k])
    if len(directories) > 1:
        places[0, SUBDIRECTORY] = starts[1]
    out = bytearray(b"II*\0" + struct.pack("<I", 8))
    for k, d in enumerate(directories):
        out += struct.pack("<H", len(d))
        for tag in sorted(d):
            kind, count, data = d[tag]
            out += struct.pack("<HHI", tag, kind, count) + (struct.pack("<I", places[k, tag]) if (k, tag) in places else data.ljust(4, b"\0"))
        out += bytes(4)
    out += heap
    for k in reversed(range(len(directories))):
        out += bytes(places[k, STRIP] - len(out)) + strips[k]
    return bytes(out)


#: Settings that the metadata packet carries.
SETTINGS = {"Version": "18.3", "ProcessVersion": "15.4", "HasSettings": "True", "WhiteBalance": "Auto", "Sharpness": "49", "ShadowTint": "+26", "HDREditMode": "1", "HDRMaxValue": "2.3", "AutoLateralCA": "1"}


def xmp_packet(settings: dict[str, str]) -> bytes:
    from xml.sax.saxutils import quoteattr

    attributes = "\n".join(f"    crs:{k}={quoteattr(v)}" for k, v in settings.items())
    return (
        '<?xpacket begin="\ufeff" id="W5M0MpCehiHzreSzNTczkc9d"?>\n<x:xmpmeta xmlns:x="adobe:ns:meta/">\n <rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">\n'
        f'  <rdf:Description rdf:about=""\n    xmlns:crs="http://ns.adobe.com/camera-raw-settings/1.0/"\n{attributes}>\n  </rdf:Description>\n </rdf:RDF>\n</x:xmpmeta>\n<?xpacket end="w"?>'
    ).encode()


def gain_map(rows: int, columns: int, area: list[int], gain: np.ndarray) -> bytes | None:
    """The opcode list with one gain map of (rows, columns, channels): big-endian, spacing and origin in units of the active area; None if area or map are degenerate."""
    height, width = area[2] - area[0], area[3] - area[1]
    if height <= 0 or width <= 0 or gain.ndim != 3 or min(gain.shape[:2]) < 2 or gain.shape[2] < 1:
        return None
    down, across, channels = gain.shape
    body = struct.pack(">10I", 0, 0, height, width, 0, channels, 1, 1, down, across)
    body += struct.pack(">4d", rows / height / (down - 1), columns / width / (across - 1), -area[0] / height, -area[1] / width)
    body += struct.pack(">I", channels) + gain.astype(">f4").tobytes()
    return struct.pack(">5I", 1, 9, 0x01030000, 0, len(body)) + body


def dng_bytes(samples: np.ndarray, preview: np.ndarray, calibration: dict, orientation: int = 1, model: str = "", settings: dict[str, str] = SETTINGS, area=None, opcodes: bytes | None = None) -> bytes:
    """Normalised samples (rows, columns, 3; 16 bits) as a linear DNG: the raster with its colour profile in the first directory, an 8-bit preview in its subdirectory."""
    h, w, _ = samples.shape
    packet, name = xmp_packet(settings), model.encode() + b"\0"
    raw = {
        254: numbers(LONG, [0]), 256: numbers(LONG, [w]), 257: numbers(LONG, [h]), 258: numbers(SHORT, [16] * 3), 259: numbers(SHORT, [1]), 262: numbers(SHORT, [34892]), 274: numbers(SHORT, [orientation]),
        277: numbers(SHORT, [3]), 278: numbers(LONG, [h]), STRIP_SIZE: numbers(LONG, [samples.size * 2]), 284: numbers(SHORT, [1]), 339: numbers(SHORT, [1]), XMP: (BYTE, len(packet), packet),
        50706: numbers(BYTE, [1, 4, 0, 0]), 50707: numbers(BYTE, [1, 3, 0, 0]), 50708: (ASCII, len(name), name), 50714: numbers(LONG, [0] * 3), 50717: numbers(LONG, [65535] * 3),
        50721: numbers(SRATIONAL, calibration["color_matrix"]), 50964: numbers(SRATIONAL, calibration["forward_matrix"]), 50723: numbers(SRATIONAL, np.diag(calibration["camera_calibration"]).ravel()),
        50728: numbers(RATIONAL, calibration["neutral"]), 50730: numbers(SRATIONAL, [calibration["baseline"]]), 50778: numbers(SHORT, [21]),
    }
    if area is not None:
        raw[50829] = numbers(LONG, area)
    if opcodes:
        raw[51009] = (UNDEFINED, len(opcodes), opcodes)
    ph, pw, _ = preview.shape
    small = {
        254: numbers(LONG, [1]), 256: numbers(LONG, [pw]), 257: numbers(LONG, [ph]), 258: numbers(SHORT, [8] * 3), 259: numbers(SHORT, [1]), 262: numbers(SHORT, [2]),
        277: numbers(SHORT, [3]), 278: numbers(LONG, [ph]), STRIP_SIZE: numbers(LONG, [preview.size]), 284: numbers(SHORT, [1]),
    }
    return assemble([raw, small], [samples.astype("<u2").tobytes(), preview.astype("u1").tobytes()])


def _fields(blob: bytes, at: int) -> dict[int, tuple[int, int, bytes]]:
    """The fields of the directory at a place; raises ValueError where it leaves the file."""
    if at + 2 > len(blob):
        raise ValueError("directory out of range")
    (n,) = struct.unpack_from("<H", blob, at)
    if n > MOST_FIELDS or at + 2 + 12 * n > len(blob):
        raise ValueError("directory out of range")
    out = {}
    for k in range(n):
        tag, kind, count, value = struct.unpack_from("<HHII", blob, at + 2 + 12 * k)
        size = SIZES.get(kind, 1) * count
        start = at + 10 + 12 * k if size <= 4 else value
        if start + size > len(blob):
            raise ValueError(f"field {tag} out of range")
        out.setdefault(tag, (kind, count, blob[start : start + size]))
    return out


def parse(blob: bytes) -> list[dict[int, tuple[int, int, bytes]]]:
    """The first directory and the one it refers to, if any."""
    if len(blob) < 8 or blob[:4] != b"II*\0":
        raise ValueError("not a little-endian TIFF")
    first = _fields(blob, struct.unpack_from("<I", blob, 4)[0])
    return [first, _fields(blob, struct.unpack("<I", first[SUBDIRECTORY][2])[0])] if SUBDIRECTORY in first else [first]


def replace_packet(blob: bytes, packet: bytes) -> bytes:
    """The same file laid out anew with another metadata packet."""
    found = parse(blob)
    strips = []
    for d in found:
        at, size = (struct.unpack("<I", d[t][2])[0] if t in d else 0 for t in (STRIP, STRIP_SIZE))
        strips.append(blob[at : at + size])
    found[0][XMP] = (BYTE, len(packet), packet)
    return assemble(found, strips)


def directories(files: DataFrame) -> DataFrame:
    """``(path, directory, tag, kind, count, first, data, error)`` of ``(path, content)``: a row for each field, first being the first number of integer types; a file
    that is none, or leaves its bounds, is one row with an error."""

    def run(batches):
        for pdf in batches:
            rows = []
            for path, blob in zip(pdf["path"], pdf["content"]):
                try:
                    for k, d in enumerate(parse(blob)):
                        for tag, (kind, count, data) in sorted(d.items()):
                            code = {1: "<B", 3: "<H", 4: "<I"}.get(kind)
                            rows.append((path, k, tag, kind, count, struct.unpack_from(code, data)[0] if code and data else None, data, None))
                except (ValueError, struct.error) as e:
                    rows.append((path, *(None,) * 6, str(e)))
            yield pd.DataFrame(rows, columns=["path", "directory", "tag", "kind", "count", "first", "data", "error"]).astype(object)

    return files.select("path", "content").mapInPandas(run, "path string, directory int, tag int, kind int, count long, first long, data binary, error string")


MODES = ("dng", "tiff", "xmp", "preview")
#: Width that a preview has at most, and the least number of pixels a side of its squares.
PREVIEW_WIDTH, LEAST_REDUCTION = 1024, 2


def plain_calibration() -> dict:
    """The calibration of a raster that is linear sRGB already."""
    from rasterlake.functions import color as C

    return {"color_matrix": C.XYZ_TO_SRGB, "forward_matrix": C.SRGB_TO_XYZ, "camera_calibration": [1.0] * 3, "neutral": [1.0] * 3, "baseline": 0.0}


def samples_of(image: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(image, 0, 1) * 65535 + 0.5).astype(np.uint16)


def preview_of(image: np.ndarray, width: int = PREVIEW_WIDTH, matrix: np.ndarray | None = None, area: list[int] | None = None) -> np.ndarray:
    """A small 8-bit sRGB picture of the ``area`` (top, left, bottom, right): means of whole squares of the stored samples, the linear ``matrix`` to sRGB if there is one, the sRGB curve."""
    top, left, bottom, right = area or (0, 0, *image.shape[:2])
    image = samples_of(image[top:bottom, left:right]) / 65535
    h, w, _ = image.shape
    n = min(max(-(-w // width), LEAST_REDUCTION), h, w)
    rows, columns = h // n, w // n
    small = image[: rows * n, : columns * n].reshape(rows, n, columns, n, 3).mean((1, 3))
    if matrix is not None:
        small = small @ np.asarray(matrix, float).reshape(3, 3).T
    small = np.clip(small, 0, 1)
    return np.floor(np.where(small <= 0.0031308, 12.92 * small, 1.055 * small ** (1 / 2.4) - 0.055) * 255 + 0.5).astype(np.uint8)


def emit(images: DataFrame, modes: tuple[str, ...] = MODES) -> DataFrame:
    """``(image_id, mode, content, error)``: every wanted output of an image from one decoded row ``(image_id, px, my, mx)`` of pixels (r, g, b in 0..1, row by row)
    and its last row and column. An unknown mode is a row with an error, whatever the others give."""
    plain = plain_calibration()

    def run(batches):
        for pdf in batches:
            rows = []
            for key, px, y, x in zip(pdf["image_id"], pdf["px"], pdf["my"], pdf["mx"]):
                image = np.stack([np.asarray(v, float) for v in px]).reshape(y + 1, x + 1, 3)
                samples, small = samples_of(image), preview_of(image)
                for mode in modes:
                    made = {"dng": lambda: dng_bytes(samples, small, plain, model="raster"), "tiff": lambda: tiff_bytes(image), "xmp": lambda: xmp_packet(SETTINGS), "preview": lambda: small.tobytes()}.get(mode)
                    rows.append((key, mode, made() if made else None, None if made else f"unknown mode {mode}"))
            yield pd.DataFrame(rows, columns=["image_id", "mode", "content", "error"])

    return images.mapInPandas(run, "image_id long, mode string, content binary, error string")


def rows_of(px: DataFrame) -> DataFrame:
    """``(image_id, px, my, mx)`` from linear pixels: one shuffle by image, one array an image."""
    cells = px.select("image_id", F.struct("y", "x", "r", "g", "b").alias("p"))
    shape = [F.max(F.col(f"p.{c}")).alias(f"m{c}") for c in "yx"]
    return cells.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: F.array(p["r"], p["g"], p["b"])).alias("px"), *shape)


_TAGS = [(0, t, k, n, f) for t, k, n, f in (
    (254, 4, 1, 0), (256, 4, 1, 8), (257, 4, 1, 8), (258, 3, 3, 16), (259, 3, 1, 1), (262, 3, 1, 34892), (274, 3, 1, 1), (277, 3, 1, 3), (278, 4, 1, 8), (279, 4, 1, 384), (284, 3, 1, 1), (339, 3, 1, 1),
    (50706, 1, 4, 1), (50707, 1, 4, 1), (50708, 2, 7, None), (50714, 4, 3, 0), (50717, 4, 3, 65535), (50721, 10, 9, None), (50964, 10, 9, None), (50723, 10, 9, None), (50728, 5, 3, None), (50730, 10, 1, None), (50778, 3, 1, 21))]
_TAGS += [(1, t, k, n, f) for t, k, n, f in ((254, 4, 1, 1), (256, 4, 1, 4), (257, 4, 1, 4), (258, 3, 3, 8), (259, 3, 1, 1), (262, 3, 1, 2), (277, 3, 1, 3), (278, 4, 1, 4), (279, 4, 1, 48), (284, 3, 1, 1))]


@query(f"SELECT image_id, directory, tag, kind, count, first FROM (SELECT DISTINCT image_id FROM ({S.LINEAR})), (VALUES {', '.join(str(t).replace('None', 'NULL') for t in _TAGS)}) t(directory, tag, kind, count, first)")
def dng_tags(spark, sf_dir):
    """Every colour image written as a DNG and its directories read back: the fields that do not depend on places or texts."""
    files = emit(rows_of(S.linear(spark, sf_dir)), ("dng",)).select(F.col("image_id").cast("string").alias("path"), "content")
    found = directories(files).where(~F.col("tag").isin(STRIP, SUBDIRECTORY, XMP))
    return found.select(F.col("path").cast("long").alias("image_id"), "directory", "tag", "kind", "count", "first")


@query(f"SELECT image_id, y, x, {', '.join(f'CAST(floor(least(greatest({c}, 0.0), 1.0) * 65535 + 0.5) AS BIGINT) AS {c}' for c in 'rgb')} FROM ({S.LINEAR})")
def dng_round_trip(spark, sf_dir):
    """Samples of every colour image written as a DNG, given another metadata packet, and read back from its strip."""
    files = emit(rows_of(S.linear(spark, sf_dir)), ("dng",))

    def run(batches):
        for pdf in batches:
            out = []
            for key, blob in zip(pdf["image_id"], pdf["content"]):
                blob = replace_packet(blob, xmp_packet({"Sharpness": "1"}))
                d = parse(blob)[0]
                h, w, at = (struct.unpack("<I", d[t][2])[0] for t in (257, 256, STRIP))
                a = np.frombuffer(blob, "<u2", h * w * 3, at).reshape(-1, 3).astype(np.int64)
                out.append(pd.DataFrame({"image_id": key, "y": np.repeat(np.arange(h), w), "x": np.tile(np.arange(w), h), "r": a[:, 0], "g": a[:, 1], "b": a[:, 2]}))
            yield pd.concat(out) if out else pd.DataFrame(columns=["image_id", "y", "x", "r", "g", "b"])

    return files.select("image_id", "content").mapInPandas(run, "image_id long, y int, x int, r long, g long, b long")


@query(f"SELECT image_id, mode, CASE mode WHEN 'tiff' THEN 158 + 384 WHEN 'preview' THEN 48 WHEN 'xmp' THEN {len(xmp_packet(SETTINGS))} END::BIGINT AS size, CASE WHEN mode = 'gif' THEN 'unknown mode gif' END AS error FROM (SELECT DISTINCT image_id FROM ({S.LINEAR})), (SELECT unnest(['tiff', 'preview', 'xmp', 'gif']) AS mode)")
def multi_format_emit(spark, sf_dir):
    """Several outputs of one decoded image; a format that cannot be made is a row with its error beside the others."""
    return emit(rows_of(S.linear(spark, sf_dir)), ("tiff", "preview", "xmp", "gif")).select("image_id", "mode", F.length("content").cast("long").alias("size"), "error")
