"""Toxicity and language: folding, exceptions, held-out accuracy, edge cases."""

import numpy as np
import pyarrow as pa

from rasterlake.llm import langid, toxicity
from rasterlake.llm._common import crc_mod, table, text_bytes

DATA = "/root/testdata/sf0.1"
ODD = [(1, None, "x"), (1, "", "x"), (None, "123 !? ...", None), (2, "word " * 200_000, None), (3, "żółw", None)]
SCHEMA = "doc_id long, text string, score string"


def test_folding():
    assert toxicity.fold("1D1OT, Ídìöt id​iot іdіоt m0r@n!!").split() == ["idiot", "idiot", "idiot", "idiot", "moran"]


def test_hits_and_exceptions():
    lexicon = toxicity.Lexicon({" clown ": 2.0, " lowei": 3.0, " loweir ": 1.0}, (" clown fish ", " circus clown "))
    text = toxicity.fold("Clown! clown fish, circus clown clown loweir xlowei cl0wn")
    assert [(p, w) for _, p, w in lexicon.hits(text)] == [(" clown ", 2.0), (" clown ", 2.0), (" lowei", 3.0), (" clown ", 2.0)]
    plain = [(text.find(" clown", k), " clown ") for k in range(len(text)) if text.startswith(" clown ", k)]
    assert len(plain) == 5  # two of them are spared


def test_scores_against_a_plain_search():
    """Every score and hit count against substring searches, no automaton: long, empty, folded and exempt texts."""
    lexicon = toxicity.Lexicon({" clown ": 2.0, " lowei": 3.0, " loweir ": 1.0, " scum ": 4.0}, (" clown fish ", " pond scum "))
    texts = [None, "", "a clown", "Cl0wn fish and ponD sсum, clown", "loweir loweix " * 30, "x " * 5000 + "scum", "clown fish clown fish scum scum"]
    got = lexicon.features(texts)
    for t, x in zip(texts, got):
        folded = toxicity.fold(t or "")
        spared = [(k, k + len(e) - 1) for e in lexicon.exceptions for k in range(len(folded)) if folded.startswith(e, k)]
        total = n = 0
        for k in range(len(folded)):
            best = max(((w, p) for p, w in lexicon.terms.items() if folded.startswith(p, k)), default=None)
            if best and not any(lo <= k and k + len(best[1]) - 1 <= hi for lo, hi in spared):
                total, n = total + best[0], n + 1
        assert np.allclose(x, [np.log1p(total), np.log1p(1000 * total / len(folded)) if n else 0, n])
        assert np.isclose(lexicon.scores(x[None])[0], 1 / (1 + np.exp(-(1.5 * x[0] + 0.5 * x[1] - 3.0))))


def test_exceptions_are_learnt(spark):
    """A term that is harmless beside a certain word in clean texts is exempt there, and nowhere else."""
    rng = np.random.default_rng(0)
    filler = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(400)]
    some = lambda n: " ".join(rng.choice(filler, n))
    docs, labels = [], []
    for i in range(600):
        toxic = i % 3 == 0
        text = f"{some(15)} blarg {some(4)} {some(2)} blarg" if toxic else f"{some(20)} circus blarg {some(3)}" if i % 20 == 1 else some(25)
        docs.append((i, text))
        labels.append((i, int(toxic)))
    lexicon = toxicity.learn(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert " blarg " in lexicon.terms and " circus blarg " in lexicon.exceptions
    got = toxicity.score(spark.createDataFrame([(1, "you blarg"), (2, "the circus blarg here")], "doc_id long, text string"), lexicon).collect()
    assert {r["doc_id"]: r["n_hits"] for r in got} == {1: 1, 2: 0}


def test_toxicity_held_out(spark):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    lexicon = toxicity.learn(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, lexicon).collect()}
    held = [(got[r["doc_id"]] >= 0.5, r["toxic"] == 1) for r in labels.collect() if crc_mod(r["doc_id"], 5) == 0]
    assert np.mean([a == b for a, b in held]) > 0.95
    odd = spark.createDataFrame(ODD, SCHEMA)
    assert len({r["score"] for r in toxicity.score(odd, lexicon).collect()}) == 1
    assert toxicity.score(odd.limit(0), lexicon).count() == 0
    assert " idiot " in toxicity.learn(docs, labels.limit(0)).terms


def test_trigram_counts_against_slow_form():
    texts = ["abc abd", "", None, "Xé!", "ab"]
    got = langid.counts(*text_bytes(pa.array(texts)))
    for row, t in zip(got, texts):
        low = bytes(c | 32 if 65 <= c <= 90 else c if c >= 97 and c <= 122 or c >= 128 else 32 for c in (t or "").encode())
        want = np.zeros(langid.DIM)
        for a, b, c in zip(low, low[1:], low[2:]):
            if a != 32 or b != 32:
                want[((((a << 16) + (b << 8) + c) * 2654435761) % 2**32) >> 20] += 1
        assert np.array_equal(row, want)


def test_share_of_any_number_of_rows():
    """The drawn share stays right where it is tiny."""
    for n in (10, 10**6, 7 * 10**8, 10**9, 10**12):
        ((_, cut),) = langid.shares({"en": n}, 2400)
        assert abs((cut + 2**63) / 2**64 * n - min(n, 2400)) < 1e-2 * min(n, 2400)
    assert len(langid.shares({str(k): 10**9 for k in range(5000)}, 2400)) == 5000


def test_predictions_against_plain_cosines(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    model = langid.train(docs)
    texts = [r["text"] for r in docs.limit(40).collect()]
    lang, score, rejected = model.predict(pa.array(texts))
    for t, got, s, r in zip(texts, lang, score, rejected):
        v = np.log1p(langid.counts(*text_bytes(pa.array([t])))[0]) * model.idf
        cos = [float(v @ c / np.linalg.norm(v)) for c in model.centroids]
        k = int(np.argmax(cos))
        assert got == model.langs[model.lang_of[k]] and r == (cos[k] < model.least[k]) and (s < 0.5 or not r)


def test_unknown_language_is_rejected(spark):
    model = langid.train(table(spark, "/root/testdata/sf0.01", "documents"))
    rng = np.random.default_rng(1)
    greek = [" ".join("".join(rng.choice(list("αβγδεζηθικλμνξοπρστυφχψω"), 7)) for _ in range(150)) for _ in range(20)]
    _, score, rejected = model.predict(pa.array(greek))
    assert rejected.all() and (score < 0.5).all()


def test_rows_without_an_id_do_not_crowd_out_others(spark):
    rows = [(None, f"alpha beta gamma {k} delta epsilon", "xx") for k in range(3000)] + [(k, f"uno dos tres {k} cuatro cinco", "yy") for k in range(3000)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_docs=200)
    assert model.langs == ["xx", "yy"]
    assert model.predict(pa.array(["alpha gamma delta", "dos cuatro cinco"]))[0] == ["xx", "yy"]


def test_language_held_out(spark):
    docs = table(spark, DATA, "documents")
    model = langid.train(docs)
    got = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r["lang"] == r["lang_pred"] for r in got if crc_mod(r["doc_id"], 4) == 2]
    assert np.mean(held) > 0.98 and np.mean([r["rejected"] for r in got]) < 0.1
    odd = sorted(langid.identify(spark.createDataFrame(ODD, SCHEMA), model).collect(), key=lambda r: str(r["doc_id"]))
    assert [r["lang_pred"] == "und" for r in odd] == [True, True, False, False, True]
    assert langid.identify(docs.limit(0), model).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs.limit(5), langid.train(docs.limit(0))).collect()} == {"und"}
