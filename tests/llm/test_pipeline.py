"""The pipeline's stages one by one against slow forms on the smallest data."""

import numpy as np
import pytest

import corpus_pipeline
from rasterlake.llm import lines_crf, pii, simhash
from rasterlake.llm._common import table

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = table(spark, DATA, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, DATA).cache()
        out.append((docs, after))
        docs = after
    return out


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "benchmark decontamination", "PII", "best-fit packing"]


def test_columns(steps):
    for before, after in steps[:-1]:
        assert after.dtypes == before.dtypes


def test_quality(spark, steps):
    docs, after = steps[0]
    model = lines_crf.train(docs, table(spark, DATA, "labels"))
    rows = docs.select("doc_id", "text").toPandas()
    import pyarrow as pa

    want = set(rows.doc_id[lines_crf.scores(model, pa.array(rows.text)) >= 0.3])
    assert {r["doc_id"] for r in after.collect()} == want
    bad = {r["doc_id"] for r in table(spark, DATA, "labels").where("quality = 0").collect()}
    good = {r["doc_id"] for r in table(spark, DATA, "labels").where("quality = 1").collect()}
    assert len(bad & want) <= len(bad) / 3 and len(good & want) >= 0.9 * len(good)


def test_deduplication(steps):
    """Survivors against all pairs of shingle sets: components of similarity 0.8 and more, one document each."""
    before, after = steps[1]
    rows = before.select("doc_id", "text").toPandas()
    sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for t in rows.text]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    want = {min(rows.doc_id[k] for k in range(len(rows)) if find(k) == r) for r in {find(k) for k in range(len(rows))}}
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(want)


def test_decontamination(spark, steps):
    before, after = steps[2]
    flat = lambda t: " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split())
    items = [flat(r["text"]) for r in table(spark, DATA, "benchmark").collect()]
    rows = {r["doc_id"]: flat(r["text"]) for r in before.collect()}
    leaking = {d for d, t in rows.items() if any(i in t for i in items)}
    kept = {r["doc_id"] for r in after.collect()}
    assert not kept & leaking and set(rows) - leaking == kept


def test_redaction(steps):
    before, after = steps[3]
    want = {r["doc_id"]: pii.masked(r["text"]) for r in before.collect()}
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in after.collect()}
    assert got == {d: (t, len(t)) for d, t in want.items()}
    assert all(not any(pii.base_spans(t).values()) for t, _ in got.values())


def test_packing(steps):
    before, after = steps[4]
    rows = after.collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in before.collect()}
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for items in by.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 2048


def test_keep_first_edges(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "w"), (2, "A b c d e f", "x"), (None, "g h i j k", "x"), (None, "g h i j k", "x"), (3, None, "x"), (4, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, first_id string")
    for plan in (simhash.EXACT, simhash.WIDE):
        kept = simhash.keep_first(docs, plan=plan).collect()
        assert sorted((str(r["doc_id"]), r["first_id"]) for r in kept) == [("1", "w"), ("3", "x"), ("None", "x")] and kept[0].__fields__ == docs.columns
        assert simhash.keep_first(docs.limit(0), plan=plan).count() == 0


def test_repeated_ids_lose_no_text(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(5, a), (5, b), (6, b), (None, a), (None, "quite another text of seven words here")], "doc_id long, text string")
    for plan in (simhash.EXACT, simhash.WIDE):
        kept = sorted((str(r["doc_id"]), r["text"]) for r in simhash.keep_first(docs, plan=plan).collect())
        assert kept == sorted([("5", a), ("5", b), ("None", "quite another text of seven words here")])


def test_run(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
