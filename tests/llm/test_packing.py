"""Packing: ids against the tokenizer itself, places gapless, few sequences, edge cases."""

import bisect
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from rasterlake.llm import packing
from rasterlake.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, length string, rank string"


def test_against_tokenizer(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary())
    rng = random.Random(2)
    odd = ["Größe İstanbul ΣΑΣ", "it's 1234 we're", "a\x1cb \x85 c d e", "<|endoftext|> x <|startoftext|>", "é ́x", "日本語 テスト", "J̌ H̱ e\u0301 E\u0301", "word.\"' it's. don't?! x_y_ a--b c…"]
    texts = [None, "", "  ", *odd, *[" ".join(rng.choices(["alpha", "beta,", "Gamma!!", *odd], k=rng.randint(1, 900))) for _ in range(60)]]
    rows = [(i, t, None, None) for i, t in enumerate(texts)] + [(4, texts[4], "x", "x"), (None, "no id", "x", "x")]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA), vocabulary(), max_len=64, rows_per_bucket=10).collect()
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t, *_ in rows}
    pieces, places = defaultdict(list), defaultdict(list)
    for r in got:
        assert zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for key, all_ids in ids.items():
        want = [(k, at, min(64, len(all_ids) - at)) for k, at in enumerate(range(0, len(all_ids), 64))]
        assert sorted(pieces[key]) == sorted(want * (2 if key == 4 else 1))
    for items in places.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r["length"] for r in got)
    assert len(places) <= total / 64 * 1.15 + 1


def test_ids_of_documents():
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    content = open(vocabulary()).read()
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
    whole = Tokenizer.from_str(content)
    for most in (50, 800_000):  # a cache that starts anew all the time gives the same ids
        chunks = packing.ChunkTokenizer(content, most)
        for t in texts:
            assert np.frombuffer(chunks.ids(t.encode()), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids
        assert len(chunks) <= max(most, 1) + 3 or most > 50


def test_fuzz_against_tokenizer():
    from tokenizers import Tokenizer

    content = open(vocabulary()).read()
    whole, chunks = Tokenizer.from_str(content), packing.ChunkTokenizer(content, 5000)
    odd = "é ñ ß ÿ × ÷ É Ÿ Å İ ſ K Å \u0301 \u0307 \u00a0 \u2003 \x1c \x85 ’ 中 한 🙂 \u200d µ ª Σ ς 's 'll \u0345 \u1100 \u1161 ² ½ <|endoftext|> </w>".split(" ")
    rng = random.Random(3)
    for _ in range(20_000):
        t = "".join(rng.choices([*"abcXYZ  '.,-_!09 \n\t", *odd], k=rng.randint(0, 14)))
        assert np.frombuffer(chunks.ids(t.encode()), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_cut_at_the_real_length(spark):
    from tokenizers import Tokenizer

    text = " ".join(f"word{k % 977} é{k % 31}," for k in range(3000))
    ids = np.array([*Tokenizer.from_file(vocabulary()).encode(text, add_special_tokens=False).ids, 0], "<u4")
    got = sorted(packing.pack(spark.createDataFrame([(1, text)], "doc_id long, text string"), vocabulary()).collect(), key=lambda r: r["piece"])
    assert [(r["piece"], r["start"], r["length"]) for r in got] == [(k, at, min(2048, len(ids) - at)) for k, at in enumerate(range(0, len(ids), 2048))]
    assert [r["ids_crc32"] for r in got] == [zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in got]


def slow_best_fit(histogram, max_len):
    """Best-fit decreasing, document by document."""
    rooms = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            k = bisect.bisect_left(rooms, length)
            room = rooms.pop(k) if k < len(rooms) else max_len
            bisect.insort(rooms, room - length)
    return len(rooms)


@pytest.mark.parametrize("seed", range(4))
def test_plan(seed):
    rng = random.Random(seed)
    histogram = {n: rng.randint(1, 300) for n in rng.sample(range(1, 257), 60)}
    rows, used, seen = packing.plan(histogram, 256), defaultdict(int), defaultdict(int)
    for length, first, n, seq, fill, per in rows:
        assert seen[length] == first
        seen[length] += n
        for k in range(n):
            assert used[seq + k // per] == fill + k % per * length
            used[seq + k // per] += length
    assert dict(seen) == histogram and max(used.values()) <= 256
    assert len(rows) < 48 * 256
    assert len(used) == slow_best_fit(histogram, 256)


def test_rows_of_one_id_are_ranked_in_several_tasks(spark):
    """Rows of null or repeated ids and one length: gapless places, whatever the buckets."""
    texts = [f"word number {a} of {b}" for a in "abcdefghij" for b in "klmnopqrst"]
    docs = spark.createDataFrame([(None if k % 2 else 7, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = packing.pack(docs, vocabulary(), rows_per_bucket=1).collect()
    assert len(got) == 100 and len({(r["sequence_id"], r["offset"]) for r in got}) == 100
    ends = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert len(ends) == 1


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), vocabulary()).count() == 0
