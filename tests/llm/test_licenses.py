"""License scans against a slow form, and the defined edge cases."""

import random
import re
import textwrap

from rasterlake.llm import licenses

SCHEMA = "doc_id long, text string, labels string, key string"


def slow(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    starts, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        hits = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        starts += hits
        labels |= {label} if hits else set()
    best, more = 0.0, set()
    lines = lower.split("\n")
    for k in range(len(lines)):
        seen = set(re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "\n".join(lines[k : k + licenses.RUN])))
        for label, t in licenses.TEMPLATES:
            share = len(seen & set(t.split())) / len(set(t.split()))
            if share >= licenses.THRESHOLD - 1e-9:
                more.add(label)
                best = max(best, share)
    score = max(best, 1.0 if starts else 0.0)
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | more)), round(score, 9))


def corpus():
    rng = random.Random(8)
    vocab = sorted({w for _, t in licenses.TEMPLATES for w in t.split()} | set("gnu mit cc by CC-BY Apache-License GNU\tGeneral Public License, é 😀 x1 K İ".split(" ")))
    texts = [" ".join(rng.choice(vocab + ["\n"]) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    for label, t in licenses.TEMPLATES:
        w = t.split()
        for drop in range(5):
            keep = rng.sample(w, max(1, len(w) - drop))
            texts.append("before\n" + " ".join(keep) + "\nafter " + " ".join(rng.sample(w, 2)))
        texts.append("code\n" + textwrap.fill(t.capitalize() + ".", 60) + "\n\nmore code")
    texts += [None, "", "\n\n", "MIT License mit license", "cc by " * 50_000, "(C)CC--BY!"]
    return [(i, t, "x", "y") for i, t in enumerate(texts)] + [(0, texts[0], None, None), (None, "Released under the MIT License.", None, None), (None, None, None, None)]


def test_against_slow_form(spark):
    rows = corpus()
    got = licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()
    as_row = lambda r: (r["doc_id"], *(r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels")), round(r["score"], 9))
    assert sorted(map(as_row, got), key=str) == sorted(((r[0], *slow(r[1])) for r in rows), key=str)


def test_wrapped_notices_are_found(spark):
    """Notices wrapped at 60 to 80 characters, behind comment signs."""
    rows = []
    for k, (label, t) in enumerate(licenses.TEMPLATES):
        for width in (60, 72, 80):
            rows.append((k * 100 + width, "x = 1\n" + "\n".join("# " + line for line in textwrap.wrap(t.capitalize() + ".", width)) + "\ny = 2"))
    got = {r["doc_id"]: r["labels"].split(",") for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(licenses.TEMPLATES[d // 100][0] in labels for d, labels in got.items())


def test_templates_from_a_table(spark):
    docs = spark.createDataFrame([(1, "This Work is\nPLACED in the public domain."), (2, "something else")], "doc_id long, text string")
    table = spark.createDataFrame([("pd", "this work is placed in the public domain"), ("none", ""), (None, None)], "label string, notice string")
    assert {r["doc_id"]: r["labels"] for r in licenses.scan(docs, templates=table).collect()} == {1: "pd", 2: ""}
    assert {r["labels"] for r in licenses.scan(docs, templates=table.limit(0)).collect()} == {""}


def test_empty(spark):
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).count() == 0
