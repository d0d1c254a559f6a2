"""Line deduplication against a plain form."""

import collections
import random

import duckdb

from rasterlake.llm import linededup

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def slow(texts, min_docs, least=1):
    lines = [(t or "").split("\n") for t in texts]
    docs = collections.Counter(k for ls in lines for k in {key(x) for x in ls})
    gone = {k for k, n in docs.items() if n >= min_docs and len(k) >= max(least, 1)}
    return [(len(ls), sum(key(x) in gone for x in ls), "\n".join(x for x in ls if key(x) not in gone)) for ls in lines]


def test_against_slow_form(spark):
    rng = random.Random(1)
    pool = ["Common line", " common LINE\t", "İstanbul", "istanbul", "Éa", "éa", "", "  ", "a\rb", "x\r", "x", " x"] + [f"only {k}" for k in range(40)]
    texts = [None, "", "\n", "\n\n"] + ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 9))) for _ in range(120)]
    ids = [None if k % 7 == 0 else k // 2 for k in range(len(texts))]  # null and repeated ids
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(3)
    for min_docs, least in ((10, 1), (2, 5)):
        got = sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["text"]) for r in linededup.scan(docs, min_docs, least).collect())
        assert got == sorted((str(i), *r) for i, r in zip(ids, slow(texts, min_docs, least)))


def test_a_line_repeated_in_one_document_is_one_document(spark):
    docs = spark.createDataFrame([(1, "a\n" * 50), (2, "b\na")], "doc_id long, text string")
    assert [r["n_dropped"] for r in linededup.scan(docs, 3).collect()] == [0, 0]
    assert sorted(r["n_dropped"] for r in linededup.scan(docs, 2).collect()) == [1, 50]


def test_repeated_rows_each_count(spark):
    docs = spark.createDataFrame([(1, "a\nb")] * 10, "doc_id long, text string")
    assert [tuple(r) for r in linededup.scan(docs).collect()] == [(1, 2, 2, "")] * 10


def test_clean_keeps_columns_and_nulls(spark):
    docs = spark.createDataFrame([(1, None, 1, "p"), (2, "a\nb\na", 2, "q"), (3, "c\na", 3, None)], "doc_id long, text string, h long, lines string")
    out = linededup.clean(docs, 2)
    assert out.schema.simpleString() == docs.schema.simpleString()
    assert sorted(map(tuple, out.collect()), key=lambda r: r[0]) == [(1, None, 1, "p"), (2, "b", 2, "q"), (3, "c", 3, None)]
    assert linededup.clean(docs.limit(0)).count() == 0 and linededup.scan(docs.limit(0)).count() == 0


def test_very_long_text(spark):
    """Linear in lines: 200,000 lines, half of them common."""
    text = "\n".join(f"{k % 2 and 'same'}{k // 2 if k % 2 == 0 else ''}" for k in range(200_000))
    docs = spark.createDataFrame([(1, text), (2, "same")], "doc_id long, text string")
    assert sorted(r["n_dropped"] for r in linededup.scan(docs, 2).collect()) == [1, 100_000]


def test_query_against_sql(spark):
    from rasterlake.llm.queries import ORACLE, QUERIES

    data = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{data}/documents.parquet')")
    got = QUERIES["op12_linededup"](spark, data).toPandas()
    want = con.execute(ORACLE["op12_linededup"]).df()[list(got.columns)]
    assert sorted(got.itertuples(index=False, name=None)) == sorted(want.itertuples(index=False, name=None))
    assert got.n_dropped.sum() > 0
