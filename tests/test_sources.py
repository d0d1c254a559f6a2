"""Containers: round trips, Huffman rows, the cipher, properties, malformed files; TIFF bytes."""

import struct

import numpy as np

from pyspark.sql import functions as F

from rasterlake.sources import formats, tiff, x3f


def coded_section(image):
    """An image section in Huffman form: short codes for small differences, long ones for the rest."""
    rows, cols, _ = image.shape
    d = np.diff(image.astype(np.int64), axis=1, prepend=0)
    values = sorted(set(d.ravel().tolist()), key=lambda v: (abs(v), v))
    words = {}
    for k, v in enumerate(values):  # a unary-like prefix code
        words[v] = (min(k, 10) + 1, (1 << (min(k, 10) + 1)) - 2) if k < 10 else (17, (1023 << 7) | (k - 10))
    mapping, table = np.zeros(1024, "<u2"), np.zeros(1024, "<u4")
    for k, v in enumerate(values):
        mapping[k], table[k] = v & 0xFFFF, words[v][0] << 27 | words[v][1]
    body, offsets = b"", []
    for y in range(rows):
        bits = "".join(f"{words[v][1]:0{words[v][0]}b}" for v in d[y].ravel().tolist())
        offsets.append(len(body))
        body += int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    head = b"SECi" + struct.pack("<6I", 0x20000, 3, 6, cols, rows, 0)
    return head + mapping.tobytes() + table.tobytes() + body + struct.pack(f"<{rows}I", *offsets)


def property_section(pairs):
    text, table = "", []
    for k, v in pairs:
        table.append(len(text))
        text += k + "\0"
        table.append(len(text))
        text += v + "\0"
    return b"SECp" + struct.pack("<5I", 0x20000, len(pairs), 0, 0, len(text)) + struct.pack(f"<{len(table)}I", *table) + text.encode("utf-16-le")


def test_coded_image_and_properties(spark, tmp_path):
    rng = np.random.default_rng(0)
    image = rng.integers(-40, 60, (5, 7, 3))
    pairs = [("ISO", "100"), ("LENSMODEL", "späte Linse"), ("ISO", "200")]
    (tmp_path / "a.X3F").write_bytes(x3f.container([b"SECx1234", property_section(pairs), coded_section(image)]))
    (tmp_path / "bad.x3f").write_bytes(b"nothing of the kind")
    (tmp_path / "cut.x3f").write_bytes(x3f.container([coded_section(image)])[:-3])
    (tmp_path / "none.x3f").write_bytes(x3f.container([b"SECx1234"]))
    (tmp_path / "other.txt").write_bytes(b"x")
    rows = x3f.read(spark, str(tmp_path)).cache()
    assert {r["error"] for r in rows.collect()} == {None, "bad magic", "no directory"}
    images = x3f.image_section(rows)
    assert sorted(str(r["error"]) for r in images.collect()) == ["None", "bad magic", "no directory", "no image section"]
    got = np.zeros(image.shape, int)
    for r in x3f.decode(images).collect():
        got[r["y"], r["x"], r["ch"]] = r["s"]
    assert np.array_equal(got, image - image.min())
    assert {(r["key"], r["value"]) for r in x3f.properties(rows).collect()} == {("ISO", "100"), ("LENSMODEL", "späte Linse")}


def test_raw_section_behind_a_preview(spark, tmp_path):
    """The raw image is told by its format; broken files are rows with an error beside good ones."""
    image = np.arange(60).reshape(4, 5, 3) % 23
    preview = b"SECi" + struct.pack("<6I", 0x20000, 2, 11, 5, 4, 20) + bytes(4000)
    good = coded_section(image)
    (tmp_path / "good.x3f").write_bytes(x3f.container([preview, good], 90, "Sunlight"))
    (tmp_path / "preview.x3f").write_bytes(x3f.container([preview]))
    (tmp_path / "short.x3f").write_bytes(x3f.container([good[: 28 + 6000]]))
    (tmp_path / "tiny.x3f").write_bytes(x3f.container([good[: 28 + 100]]))
    (tmp_path / "packed.x3f").write_bytes(x3f.container([x3f.packed_section(image, (np.arange(1024) - 512) & 0xFFFF, {k - 512: k for k in range(1024)})[:-9]]))
    (tmp_path / "wide.x3f").write_bytes(x3f.container([b"SECi" + struct.pack("<6I", 0x20000, 3, 6, 30000, 1, 0)]))
    files = spark.read.format("binaryFile").load(str(tmp_path))
    images = x3f.image_section(x3f.sections(files)).collect()
    name = lambda r: r["path"].rsplit("/", 1)[1].split(".")[0]
    assert {name(r): r["error"] for r in images} == {
        "good": None, "preview": "no image section of a raw format", "short": "code table or row offsets out of range", "tiny": "mapping table out of range",
        "packed": "image out of range", "wide": "implausible image size",
    }
    got = np.zeros(image.shape, int)
    for r in x3f.decode(x3f.image_section(x3f.sections(files))).collect():
        assert name(r) == "good"
        got[r["y"], r["x"], r["ch"]] = r["s"]
    assert np.array_equal(got, image - image.min())
    (head,) = [r for r in x3f.headers(files).collect() if name(r) == "good"]
    assert (head["version"], head["rotation"], head["orientation"], head["white_balance"], head["error"]) == (0x20003, 90, 6, "Sunlight", None)


def test_codes_against_bit_by_bit():
    rng = np.random.default_rng(3)
    for _ in range(30):
        table = np.zeros(1024, np.uint32)
        for k in range(12):
            length = int(rng.integers(1, 7))
            table[k] = length << 27 | int(rng.integers(0, 1 << length))
        codes, mapping = x3f.huffman(table), rng.integers(0, 65536, 1024)
        data = rng.integers(0, 256, 20, dtype=np.uint8).tobytes()
        bits, longest, want, at = np.unpackbits(np.frombuffer(data, np.uint8)), max(k[0] for k in codes), [], 0
        for _ in range(60):
            hit = next(((n, codes[n, c]) for n in range(1, longest + 1) if (n, c := int("".join(str(bits[at + j]) if at + j < len(bits) else "0" for j in range(n)), 2)) in codes), None)
            want.append(int(mapping[hit[1]]) if hit else 0)
            at += hit[0] if hit else longest
        assert x3f.Codes(codes, mapping).row(data, 60) == want


def test_keystream_against_steps():
    for start in (0, 1, 4242, 244943, 300000):
        key, want = start, []
        for _ in range(50):
            key = (key * 1597 + 51749) % 244944
            want.append((key << 8) // 244944)
        assert x3f.keystream(start, 50).tolist() == want


def test_cipher_is_its_own_inverse():
    data = bytes(range(256)) * 3
    assert x3f.decrypt(x3f.decrypt(data, 77), 77) == data and x3f.decrypt(data, 77) != data


def test_wide_codes_are_dropped():
    assert x3f.huffman(np.array([3 << 27 | 5, 2 << 27 | 7, 0, 3 << 27 | 5], np.uint32)) == {(3, 5): 0}


def test_tiff_bytes():
    image = np.linspace(-2, 9e4, 36).reshape(3, 4, 3)
    blob = tiff.tiff_bytes(image)
    (n,) = struct.unpack_from("<H", blob, 8)
    tags = {t[0]: t[3] for t in (struct.unpack_from("<HHII", blob, 10 + 12 * k) for k in range(n))}
    assert (tags[256], tags[257], tags[279]) == (4, 3, 72) and list(tags) == sorted(tags)
    back = np.frombuffer(blob, "<f2", 36, tags[273]).reshape(3, 4, 3)
    assert np.array_equal(back, np.minimum(image, 65504).astype(np.float16))


def matrix_entry(name, element, dims, payload):
    body = struct.pack("<III", element, len(dims), 20 + 12 + 12 * len(dims)) + b"".join(struct.pack("<III", d, 0, 0) for d in dims) + payload
    size = 20 + len(body) + len(name) + 1
    return b"CMbM" + struct.pack("<IIII", 0, size, 20 + len(body), 20) + body + name.encode() + b"\0"


def test_metadata_entries(spark, tmp_path):
    props = b"k1\0v1\0k2\0v2\0"
    body = struct.pack("<II", 2, 20 + 8 + 16) + struct.pack("<4I", 0, 3, 6, 9) + props
    prop = b"CMbP" + struct.pack("<IIII", 0, 20 + len(body) + 5, 20 + len(body), 20) + body + b"List\0"
    text = b"CMbT" + struct.pack("<IIII", 0, 24, 0, 0) + b"abcd"
    blob = (
        matrix_entry("F", 3, [2, 2], struct.pack("<4f", 1.5, 2, 3, 4)) + text + prop + matrix_entry("I", 0, [3], struct.pack("<3h", -1, 2, 3))
        + matrix_entry("U", 6, [2], struct.pack("<2H", 7, 65535)) + matrix_entry("odd", 9, [1], b"1234") + matrix_entry("long", 1, [1000], b"1234") + b"\0" * 24
    )
    section = b"SECc" + struct.pack("<6I", 0x20000, 2, 0, 0, 0, 4242) + x3f.decrypt(blob, 4242)
    (tmp_path / "m.x3f").write_bytes(x3f.container([section]))
    got = {r["name"]: r for r in x3f.entries(x3f.read(spark, str(tmp_path))).collect()}
    assert (got["F"]["dims"], got["F"]["f64"]) == ([2, 2], [1.5, 2.0, 3.0, 4.0])
    assert got["I"]["i32"] == [-1, 2, 3] and got["U"]["u32"] == [7, 65535]
    assert [(p["key"], p["value"]) for p in got["List"]["props"]] == [("k1", "v1"), ("k2", "v2")]
    assert got["odd"]["error"] and got["long"]["error"] and len(got) == 6


def list_entry(name, pairs):
    text, table = b"", []
    for p in pairs:
        for part in p:
            table.append(len(text))
            text += part.encode() + b"\0"
    body = struct.pack("<II", len(pairs), 20 + 8 + 4 * len(table)) + struct.pack(f"<{len(table)}I", *table) + text
    return b"CMbP" + struct.pack("<IIII", 0, 20 + len(body) + len(name) + 1, 20 + len(body), 20) + body + name.encode() + b"\0"


def test_prepare_and_develop(spark, tmp_path):
    """A whole file: section choice, metadata, calibration, black level, active area and development against NumPy."""
    from rasterlake.functions import color as C
    from rasterlake.operators import develop_queries as D

    rng = np.random.default_rng(5)
    image = rng.integers(100, 900, (6, 8, 3))
    image -= image.min() - 1  # coded images are lifted by their smallest sample, here none
    image[0] = image[0] % 40
    f32 = lambda *v: struct.pack(f"<{len(v)}f", *v)
    u32 = lambda *v: struct.pack(f"<{len(v)}I", *v)
    cc, gain = rng.uniform(0.2, 1, 9) + np.eye(3).ravel(), [1.5, 1.0, 2.0]
    blob = (
        list_entry("WhiteBalanceGains", [("Sunlight", "GainSun"), ("Overcast", "GainCloud")]) + list_entry("WhiteBalanceColorCorrections", [("Sunlight", "MatrixSun")])
        + matrix_entry("GainSun", 3, [3], f32(*gain)) + matrix_entry("GainCloud", 3, [3], f32(2, 1, 4)) + matrix_entry("MatrixSun", 3, [3, 3], f32(*cc))
        + matrix_entry("TempGainFact", 3, [3], f32(1, 2, 1)) + matrix_entry("CaptureISO", 3, [1], f32(400)) + matrix_entry("SensorISO", 3, [1], f32(100))
        + matrix_entry("KeepImageArea", 1, [4], u32(10, 20, 17, 25)) + matrix_entry("ActiveImageArea", 1, [4], u32(11, 21, 16, 24)) + matrix_entry("DarkShieldTop", 1, [4], u32(10, 20, 17, 20))
        + matrix_entry("ImageDepth", 1, [1], u32(10)) + b"\0" * 24
    )
    meta = b"SECc" + struct.pack("<6I", 0x20000, 2, 0, 0, 0, 99) + x3f.decrypt(blob, 99)
    (tmp_path / "a.x3f").write_bytes(x3f.container([coded_section(image), meta], 270, "Sunlight"))
    (tmp_path / "b.x3f").write_bytes(x3f.container([coded_section(image)]))
    px, images = D.prepared(spark.read.format("binaryFile").load(str(tmp_path)))
    rows = {r["path"].rsplit("/", 1)[1]: r for r in images.collect()}
    a = rows["a.x3f"]
    assert rows["b.x3f"]["error"] == "no metadata section" and a["error"] is None and (a["orientation"], a["wb"], a["baseline"]) == (8, "Sunlight", 2.0)
    decoded = image - min(image.min(), 0)
    bmt = np.array(C.SRGB_TO_XYZ).reshape(3, 3) @ np.float32(cc).astype(float).reshape(3, 3)
    g = np.array(gain) * [1, 2, 1]
    assert np.allclose(a["gain"], g) and np.allclose(a["neutral"], 1 / g) and np.allclose(a["camera_calibration"], 1 / (np.array([2, 1, 4]) * [1, 2, 1]))
    assert np.allclose(np.array(a["color_matrix"]).reshape(3, 3), np.linalg.inv(bmt)) and np.allclose(np.array(a["forward_matrix"]).reshape(3, 3), np.array(D.D65_TO_D50).reshape(3, 3) @ bmt)
    assert a["top"] == [1023.0] * 3 and np.allclose(a["black"], decoded[0].mean(0)) and a["area"] == [1, 1, 5, 7]
    n = (decoded - decoded[0].mean(0)) / (1023 - decoded[0].mean(0))
    rgb = np.maximum(n * g, 0) @ (np.array(C.XYZ_TO_SRGB).reshape(3, 3) @ bmt).T
    t = np.clip((n.max(-1) - 0.88) / 0.12, 0, 1)[..., None]
    want = (rgb + t * (rgb.max(-1, keepdims=True) - rgb))[1:5, 1:7]
    got = np.zeros(want.shape)
    for r in D.develop(px.withColumnRenamed("path", "image_id"), images.withColumnRenamed("path", "image_id")).collect():
        got[r["y"], r["x"]] = r["r"], r["g"], r["b"]
    assert np.allclose(got, want, atol=1e-6)


def test_dng_layout():
    """Places are even, values and strips stand where the directories say, tags are in order; broken files raise in a defined way."""
    rng = np.random.default_rng(1)
    samples, preview = rng.integers(0, 65536, (5, 7, 3)), rng.integers(0, 256, (3, 3, 3))
    cal = {"color_matrix": rng.normal(size=9), "forward_matrix": rng.normal(size=9), "camera_calibration": [0.5, 1.0, 0.25], "neutral": [0.5, 1, 0.7], "baseline": -1.5}
    gain = rng.uniform(1, 2, (3, 4, 3))
    opcodes = tiff.gain_map(5, 7, [1, 1, 5, 6], gain)
    blob = tiff.dng_bytes(samples, preview, cal, 6, "Model X", {"A": '<"&'}, [1, 1, 5, 6], opcodes)
    raw, small = tiff.parse(blob)
    one = lambda d, t: struct.unpack("<I", d[t][2])[0]
    assert list(raw) == sorted(raw) and one(raw, 273) % 2 == 0 and one(small, 273) % 2 == 0 and one(raw, 273) > one(small, 273)
    assert np.array_equal(np.frombuffer(blob, "<u2", samples.size, one(raw, 273)).reshape(samples.shape), samples)
    assert np.array_equal(np.frombuffer(blob, "u1", preview.size, one(small, 273)).reshape(preview.shape), preview)
    back = np.frombuffer(raw[50721][2], "<i4").reshape(-1, 2)
    assert np.allclose(back[:, 0] / back[:, 1], cal["color_matrix"], atol=1e-4) and raw[50708][2] == b"Model X\0" and raw[51009][2] == opcodes
    assert struct.unpack(">5I", opcodes[:20]) == (1, 9, 0x01030000, 0, 76 + gain.size * 4) and len(opcodes) == 20 + 76 + gain.size * 4
    assert np.allclose(struct.unpack(">4d", opcodes[60:92]), (5 / 4 / 2, 7 / 5 / 3, -1 / 4, -1 / 5)) and np.allclose(np.frombuffer(opcodes[96:], ">f4"), gain.ravel())
    assert tiff.gain_map(5, 7, [1, 1, 1, 6], gain) is None and tiff.gain_map(5, 7, [0, 0, 5, 7], gain[:1]) is None
    import xml.dom.minidom

    packet = raw[700][2].decode()
    assert xml.dom.minidom.parseString(packet[packet.index("<x:") : packet.index("<?xpacket end")]).getElementsByTagName("rdf:Description")[0].getAttribute("crs:A") == '<"&'
    other = tiff.replace_packet(blob, b"other packet!")
    again = tiff.parse(other)
    assert again[0][700][2] == b"other packet!" and np.array_equal(np.frombuffer(other, "<u2", samples.size, one(again[0], 273)).reshape(samples.shape), samples)


def test_directories_of_broken_files(spark):
    good = tiff.tiff_bytes(np.zeros((2, 2, 3)))
    files = [("good", good), ("empty", b""), ("text", b"hello world, this is no image"), ("cut", good[:40]), ("far", b"II*\0" + struct.pack("<I", 10**6))]
    got = tiff.directories(spark.createDataFrame(files, "path string, content binary")).collect()
    assert {r["path"] for r in got if r["error"]} == {"empty", "text", "cut", "far"} and sum(r["path"] == "good" for r in got) == 11


def test_lens_profiles(spark, tmp_path):
    from rasterlake.sources import profiles

    warp = '<stCamera:PerspectiveModel><rdf:Description stCamera:RadialDistortParam1="{0}" stCamera:RadialDistortParam2="0.5"><stCamera:ChromaticRedGreenModel stCamera:ScaleFactor="1.25" stCamera:RadialDistortParam1="0.1"/></rdf:Description></stCamera:PerspectiveModel>'
    shade = '<stCamera:VignetteModel><rdf:Description stCamera:VignetteModelParam1="{0}"/></stCamera:VignetteModel>'
    models = [("30", "1", "2", warp.format(1)), ("30", "1", "100", warp.format(2) + shade.format(7)), ("30", "2", "2", shade.format(8)), ("30", "2", "100", warp.format(3)), (None, "1", "5", warp.format(9)), ("30", "4", "100", "")]
    rows = "".join(f'<rdf:li><rdf:Description {"" if f is None else f"stCamera:FocalLength=\"{f}\""} stCamera:ApertureValue="{a}" stCamera:FocusDistance="{d}">{inner}</rdf:Description></rdf:li>' for f, a, d, inner in models)
    text = f'<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:stCamera="http://ns.adobe.com/photoshop/1.0/camera-profile"><rdf:Description><list><rdf:Seq>{rows}</rdf:Seq></list></rdf:Description></rdf:RDF></x:xmpmeta>'
    (tmp_path / "a.lcp").write_text(text)
    got = profiles.lens_models(spark, str(tmp_path))
    assert sorted((r["av"], r["focus"], r["dist"], r["vig"]) for r in got.collect() if r["dist"] and r["vig"]) == [(1.0, 100.0, [2.0, 0.5, 0.0], [7.0, 0.0, 0.0])] and got.count() == 4
    (one,) = profiles.lens_samples(got).collect()
    assert (one["focal"], one["min_av"], one["dist"]) == (30.0, 1.0, [2.0, 0.5, 0.0]) and (one["red"]["scale"], one["red"]["radial"], one["blue"]) == (1.25, [0.1, 0.0, 0.0], None)
    assert [(s["av"], s["vig"][0]) for s in one["vig"]] == [(1.0, 7.0), (2.0, 8.0)]
    (tmp_path / "c.json").write_text('{"log_exposure": [-1, 0],\n "curve": [[0.1, null], [0.2, 0.3]]}')
    knots = sorted((r["x"], r["values"]) for r in profiles.curves(spark, str(tmp_path / "c.json")).collect())
    assert knots[1] == (0.0, [0.2, 0.3]) and knots[0][1][0] == 0.1 and np.isnan(knots[0][1][1])


def test_coded_rows_in_several_tasks(spark):
    """A coded raster 2,640 pixels wide: ranges of rows in different tasks equal the whole."""
    rng = np.random.default_rng(4)
    image = np.cumsum(rng.integers(-3, 4, (50, 2640, 3)), 1) - 5
    body = x3f.coded_section(image)
    head, data = struct.unpack_from("<5I", body, 8), body[28:]
    images = spark.createDataFrame([("a", head[2], head[3], head[4], data, None)], "path string, columns long, rows long, stride long, data binary, error string")
    cut = x3f.slices(images, 8)
    assert cut.count() == 7 and max(len(r["body"]) for r in cut.collect()) < len(data) / 4
    for n in (1, 8, 64):
        rows = x3f.raster_rows(images, n).collect()
        got = np.zeros(image.shape, int)
        for r in rows:
            got[r["y"], :, r["ch"]] = r["v"]
        assert np.array_equal(got, image) and len(rows) == 150
    tasks = x3f.raster_rows(images, 8).select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 1


def test_container_source(spark, tmp_path):
    formats.register(spark)
    rng = np.random.default_rng(1)
    for k in range(5):
        (tmp_path / f"{k}.x3f").write_bytes(x3f.container([coded_section(rng.integers(-9, 9, (3, 4, 3))), property_section([("ISO", str(k))])]))
    (tmp_path / "bad.X3F").write_bytes(b"no")
    (tmp_path / ".hidden.x3f").write_bytes(b"no")
    rows = spark.read.format("x3f").option("partitionBytes", 20_000).load(str(tmp_path))
    assert rows.rdd.getNumPartitions() > 1
    want = x3f.read(spark, str(tmp_path)).where("path not like '%hidden%'")
    bare = lambda df: sorted(str((r["path"].rsplit("/", 1)[1], *r[1:])) for r in df.collect())
    assert bare(rows) == bare(want) and len(bare(rows)) == 11
    (tmp_path / "none").mkdir()
    assert spark.read.format("x3f").load(str(tmp_path / "none")).count() == 0


def image_rows(spark, names, height=6, width=5):
    rng = np.random.default_rng(3)
    data = [(n, rng.random((height * width, 3)).tolist(), height - 1, width - 1) for n in names]
    return spark.createDataFrame(data, "name string, px array<array<double>>, my int, mx int"), {n: np.array(p).reshape(height, width, 3) for n, p, _, _ in data}


def test_raster_files_round_trip(spark, tmp_path):
    formats.register(spark)
    rows, images = image_rows(spark, ["a", "b", "c"])
    for mode, tolerance in (("dng", 0.51), ("tiff", 1e-3)):
        path = str(tmp_path / mode)
        rows.repartition(3).write.format("raster").option("mode", mode).mode("append").save(path)
        assert sorted(p.name for p in (tmp_path / mode).iterdir()) == [n + formats.SUFFIX[mode] for n in "abc"]
        for cut in (64, 100, 1 << 20):  # ranges shorter than the directory, than a file, and longer
            found = spark.read.format("raster").option("partitionBytes", cut).load(path)
            got = {n: np.full((6, 5, 3), -1.0) for n in images}
            for r in found.collect():
                got[r["path"].rsplit("/", 1)[1].split(".")[0]][r["y"]] = np.stack([r["r"], r["g"], r["b"]], -1)
            assert found.count() == 18
            for n, image in images.items():
                assert np.abs(got[n] - image * (65535 if mode == "dng" else 1)).max() <= tolerance
        assert formats.pixels(spark.read.format("raster").load(path)).count() == 3 * 30


def test_failed_write_leaves_no_file(spark, tmp_path):
    formats.register(spark)
    path = tmp_path / "out"
    rows, _ = image_rows(spark, ["a", "b"])
    rows.write.format("raster").mode("append").save(str(path))
    before = {p.name: p.read_bytes() for p in path.iterdir()}
    bad = [image_rows(spark, ["c", "d", None])[0], image_rows(spark, ["c", "e", "c"])[0], image_rows(spark, ["c", "../d"])[0], rows.withColumn("mx", F.lit(7)).withColumn("name", F.concat("name", F.lit("x")))]
    for k, df in enumerate(bad):
        for mode in ("append", "overwrite"):
            try:
                df.repartition(2, "name").write.format("raster").mode(mode).save(str(path))
            except Exception:
                pass
            else:
                raise AssertionError(f"write {k} did not fail")
            assert {p.name: p.read_bytes() for p in path.iterdir()} == before
    try:
        rows.write.format("raster").mode("append").save(str(path))  # the names exist
    except Exception:
        pass
    else:
        raise AssertionError("an existing name was overwritten")
    assert {p.name: p.read_bytes() for p in path.iterdir()} == before
    image_rows(spark, ["z"])[0].write.format("raster").mode("overwrite").save(str(path))
    assert [p.name for p in path.iterdir()] == ["z.dng"]
    rows.limit(0).write.format("raster").mode("overwrite").save(str(path))
    assert list(path.iterdir()) == [] and spark.read.format("raster").load(str(path)).count() == 0


def test_broken_rasters_are_rows(spark, tmp_path):
    formats.register(spark)
    image = np.random.default_rng(0).random((4, 4, 3))
    (tmp_path / "a.tif").write_bytes(tiff.tiff_bytes(image))
    (tmp_path / "cut.tif").write_bytes(tiff.tiff_bytes(image)[:-30])
    (tmp_path / "no.dng").write_bytes(b"II*")
    (tmp_path / "empty.tiff").write_bytes(b"")
    rows = spark.read.format("raster").load(str(tmp_path)).collect()
    assert {r["path"].rsplit("/", 1)[1] for r in rows if r["error"]} == {"cut.tif", "no.dng", "empty.tiff"}
    assert sum(r["error"] is None for r in rows) == 4


def test_fractions_and_preview():
    kind, n, data = tiff.numbers(tiff.RATIONAL, [0.1234567, -1.0])
    assert struct.unpack("<4I", data) == (123457, 1_000_000, 0, 1_000_000)
    assert struct.unpack("<2i", tiff.numbers(tiff.SRATIONAL, [-0.5])[2]) == (-500_000, 1_000_000)
    image = np.random.default_rng(2).random((9, 2100, 3))
    small = tiff.preview_of(image)
    assert small.shape == (3, 700, 3)
    mean = (np.floor(image[3:6, 30:33] * 65535 + 0.5) / 65535).mean((0, 1))
    assert np.array_equal(small[1, 10], np.floor((1.055 * mean ** (1 / 2.4) - 0.055) * 255 + 0.5))
    assert tiff.preview_of(image, area=[1, 2, 5, 12]).shape == (2, 5, 3)
    assert np.array_equal(tiff.preview_of(image, matrix=np.eye(3)), small) and tiff.preview_of(np.ones((1, 1, 3))).tolist() == [[[255] * 3]]
