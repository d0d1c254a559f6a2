"""Importance resampling against a plain form that builds every run as text."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np

from rasterlake.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text, n):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i : i + k]) for i in range(len(words)) for k in range(1, n + 1) if i + k <= len(words)]


def slow(docs, target, n=2, buckets=10_000, percent=25, least=20, seed=7):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    held = [(i, *runs(t, n)) for i, t in docs]
    s = collections.Counter(bucket(f) for _, _, fs in held for f in fs)
    t = collections.Counter(bucket(f) for x in target for f in runs(x, n)[1])
    big_s, big_t = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    out = []
    for i, words, fs in held:
        weight = math.floor(sum(gain(bucket(f)) for f in fs) / len(fs)) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(words), len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[5] = k + 1
    return [tuple(r) for r in out]


def some_docs(k=150, seed=2):
    rng = random.Random(seed)
    pool = [f"wort{i}" for i in range(60)] + ["Über", "ÄRGER", "naïve", "日本", "x1", "7"]
    return [(i, " ".join(rng.choice(pool) + rng.choice(["", ",", "-", "\n"]) for _ in range(rng.choice([0, 1, 2, 19, 20, 21, 60])))) for i in range(k)]


def test_ring_passes_through_every_run():
    for n in (1, 2, 3, 5):
        for text in ("", "one", "One two, THREE\nfour; five-six", "ÄB äb İx", "..."):
            words, found = resample.scan(text.encode(), n, 10_000)
            own, want = runs(text, n)
            assert words == len(own)
            assert sorted(found.tolist()) == sorted(zlib.crc32(f.encode()) % 10_000 for f in want)
    words, found = resample.scan(b"w " * 100_000, 2, 10_000)  # over several parts
    assert words == 100_000 and len(found) == 199_999 and len(np.unique(found)) == 2


def test_against_slow_form(spark):
    docs, target = [*some_docs(), (900, None), (901, "")], ["wort1 wort2 über", None, "x1 7 wort3"]
    left = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    right = spark.createDataFrame([(t,) for t in target], "text string")
    for options in ({}, {"n": 3, "buckets": 100_000, "percent": 50, "seed": 11}):
        got = sorted(map(tuple, resample.draw(left, right, **{k: v for k, v in options.items()}).select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()))
        assert got == sorted(slow(docs, target, **options), key=lambda r: r[0])


def test_edges(spark):
    text = " ".join(f"a{k}" for k in range(25))
    docs = [(None, text)] * 6 + [(3, text)] * 6
    left = spark.createDataFrame([(i, t, 1, "z") for i, t in docs], "doc_id long, text string, rank int, weight string")
    none = spark.createDataFrame([], "text string")
    got = resample.draw(left, none).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3] and len(got) == 12
    assert sorted((str(r["doc_id"]), r["weight"], r["score"]) for r in got) == sorted((str(r[0]), r[3], r[4]) for r in slow(docs, []))
    assert resample.draw(left.limit(0), none).count() == 0
    kept = resample.resample(left, none)
    assert kept.columns == left.columns and kept.count() == 6


def test_target_is_preferred(spark):
    """Documents that read like the target are drawn more often than the others."""
    rng = random.Random(0)
    old, new = [f"o{k}" for k in range(50)], [f"n{k}" for k in range(50)]
    docs = [(k, " ".join(rng.choices(new if k % 4 == 0 else old, k=40))) for k in range(400)]
    target = spark.createDataFrame([(" ".join(rng.choices(new, k=40)),) for _ in range(20)], "text string")
    drawn = [r["doc_id"] for r in resample.draw(spark.createDataFrame(docs, "doc_id long, text string"), target).where("rank is not null").collect()]
    assert len(drawn) == 100 and sum(d % 4 == 0 for d in drawn) > 60


def test_query_against_sql(spark):
    from rasterlake.llm.queries import ORACLE, QUERIES

    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    got = QUERIES["op13_resample"](spark, data).toPandas().astype("Int64")
    want = con.execute(ORACLE["op13_resample"]).df()[list(got.columns)].astype("Int64")
    assert sorted(map(str, got.itertuples(index=False, name=None))) == sorted(map(str, want.itertuples(index=False, name=None)))
