"""Line features and chain marginals against slow forms, held-out accuracy, edge cases."""

from itertools import product

import numpy as np
import pyarrow as pa

from rasterlake.llm import lines_crf
from rasterlake.llm._common import crc_mod, table, text_bytes

DATA = "/root/testdata/sf0.01"


def test_lines_and_echo():
    texts = ["a\nbb\n", "", None, "\n", "Ab Ab Ab x\nÉ é é", "z"]
    x, chars, lines = lines_crf.line_features(*text_bytes(pa.array(texts)))
    split = [line for t in texts for line in (t or "").split("\n")]
    assert lines.tolist() == [len((t or "").split("\n")) for t in texts]
    assert chars.tolist() == [len(s) for s in split]
    names = lines_crf.NAMES
    echo = x[:, len(names) + 2]
    want = [sum(a == b for a, b in zip(s.split(" "), s.split(" ")[1:])) / (s.count(" ") + 1) for s in split]
    assert np.allclose(echo, want)
    assert np.allclose(x[:, names.index("upper")], [sum("A" <= c <= "Z" for c in s) / max(1, len(s.encode())) for s in split])


def test_marginals_against_enumeration():
    rng = np.random.default_rng(0)
    good, move = rng.normal(size=5) * 2, rng.normal(size=(2, 2))
    p, pair, log_z = lines_crf.marginals(good[None], np.ones((1, 5), bool), move)
    weights = {y: np.exp(sum(g for g, k in zip(good, y) if k) + sum(move[a, b] for a, b in zip(y, y[1:]))) for y in product((0, 1), repeat=5)}
    z = sum(weights.values())
    assert np.allclose(p[0], [sum(w for y, w in weights.items() if y[k]) / z for k in range(5)])
    assert np.isclose(log_z[0], np.log(z))
    assert np.isclose(pair[1, 1], sum(w * sum(a & b for a, b in zip(y, y[1:])) for y, w in weights.items()) / z)


def test_scores_against_enumeration():
    """Whole scores of a fitted model: marginals by enumeration of all labellings, weighted by line lengths."""
    rng = np.random.default_rng(2)
    texts = ["Good plain words here.\nAnother fine line." if k % 2 else "!!! ||| $$$\nBUY BUY BUY\n@@@" for k in range(40)] + ["", "one\n\nTHREE!!!\nfour four"]
    x, chars, lines = lines_crf.line_features(*text_bytes(pa.array(texts)))
    model = lines_crf.fit(x, chars, lines, np.array([k % 2 for k in range(40)] + [1, 0]), np.ones(42))
    got, first = model.score(x, chars, lines), np.concatenate([[0], np.cumsum(lines)])
    for i in rng.choice(42, 12, replace=False).tolist() + [40, 41]:
        z = ((x[first[i] : first[i + 1]] - model.mean) / model.scale) @ model.weight
        c = chars[first[i] : first[i + 1]] + 1
        weight = {y: np.exp(sum(g for g, k in zip(z, y) if k) + sum(model.move[a, b] for a, b in zip(y, y[1:]))) for y in product((0, 1), repeat=len(z))}
        p = np.array([sum(w for y, w in weight.items() if y[k]) for k in range(len(z))]) / sum(weight.values())
        share = np.clip((p * c).sum() / c.sum(), 1e-6, 1 - 1e-6)
        assert np.isclose(got[i], 1 / (1 + np.exp(-(model.slope * np.log(share / (1 - share)) + model.shift))))


def test_long_documents_are_learnt_from(spark):
    docs = [(k, "\n".join(("Plain words stand here." if k % 2 else "!!! BUY $$$ NOW") for _ in range(200))) for k in range(60)]
    labels = [(k, k % 2) for k in range(60)]
    model = lines_crf.train(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"))
    got = lines_crf.scores(model, pa.array([t for _, t in docs]))
    assert (got[1::2] > 0.9).all() and (got[::2] < 0.1).all()


def test_held_out_accuracy_and_edges(spark):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    model = lines_crf.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in lines_crf.score(docs, model).collect()}
    held = [(got[r["doc_id"]] >= 0.3, r["quality"] == 1) for r in labels.collect() if crc_mod(r["doc_id"], 5) == 0]
    assert np.mean([a == b for a, b in held]) > 0.95
    odd = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (None, "\n\n", None), (2, "word " * 200_000, None)], "doc_id long, text string, score string")
    rows = lines_crf.score(odd, model).collect()
    assert len(rows) == 4 and all(0 <= r["score"] <= 1 for r in rows)
    assert lines_crf.score(odd.limit(0), model).count() == 0
    kept = lines_crf.keep(docs, model, 0.3)
    assert kept.columns == docs.columns and kept.count() == sum(s >= 0.3 for s in got.values())
    plain = lines_crf.train(docs, labels.limit(0))
    assert {r["score"] for r in lines_crf.score(docs.limit(3), plain).collect()} == {0.5}
