"""Base spans against the plain patterns, disguised identifiers, offsets, edge cases."""

import random
import re

import pytest

from rasterlake.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


@pytest.mark.parametrize("seed", range(3))
def test_base_against_plain_patterns(seed):
    rng = random.Random(seed)
    for _ in range(4000):
        text = "".join(rng.choice("ab.@-1 9+%é") for _ in range(rng.randint(0, 40)))
        got = pii.base_spans(text)
        assert got["email"] == [m.span() for m in EMAIL.finditer(text)]
        digits = "".join(rng.choice("12.. 5") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(digits)["ip"] == [m.span() for m in IP.finditer(digits) if all(int(p) <= 255 for p in m[0].split("."))]
        card = "".join(rng.choice("0123456789 -x") for _ in range(60))
        want = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", card) if 13 <= len(re.sub(r"\D", "", m[0])) <= 19 and pii.luhn(re.sub(r"\D", "", m[0]))]
        assert pii.base_spans(card)["card"] == want


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("write to john.doe [at] mail dot example (dot) com today", "email", "john.doe [at] mail dot example (dot) com"),
        ("sam at mail8.example.com yes", "email", "sam at mail8.example.com"),
        ("m@exаmple.com", "email", "m@exаmple.com"),
        ("call plus one five five five one two three four five six seven ok", "phone", "plus one five five five one two three four five six seven"),
        ("+１ (152) 555-8590", "phone", "+１ (152) 555-8590"),
        ("ip 10 dot 0 dot 0 dot 1 x", "ip", "10 dot 0 dot 0 dot 1"),
        ("192 dot one six eight dot one dot one", "ip", "192 dot one six eight dot one dot one"),
        ("te​st@ex​ample.com", "email", "te​st@ex​ample.com"),
    ],
)
def test_disguises(text, kind, found):
    base, every = pii.spans(text)
    extra = [s for s in every[kind] if s not in base[kind]]
    assert [text[a:b] for a, b in extra] == [found]
    assert pii.masked(text) == text.replace(found, f"[{kind.upper()}]")


def test_prose_is_left_alone():
    for text in ("one two buckle", "he looked at me. dot", "look at this.that now", "fünf und eins zwei drei", "at a dot on the map"):
        assert not any(pii.spans(text)[1].values())


def test_rows(spark):
    rows = [(1, None, 9), (1, "", 0), (None, "a@b.cc", 6), (2, "x " * 300_000 + "a@b.cc", None), (2, "1." * 200_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").withColumn("spans", docs_lit())
    got = pii.detect(docs).collect()
    assert len(got) == 5 and "email:600000:600006" in {r["spans"] for r in got}
    clean = pii.redact(docs)
    assert clean.columns == docs.columns
    assert {(r["text"], r["n_chars"]) for r in clean.where("doc_id is null").collect()} == {("[EMAIL]", 7)}
    assert pii.detect(docs.limit(0)).count() == 0 == pii.redact(docs.limit(0)).count()


def docs_lit():
    from pyspark.sql import functions as F

    return F.lit("clash")


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("write anna.berg @ example.com now", "email", "anna.berg @ example.com"),
        ("write anna@ example.com now", "email", "anna@ example.com"),
        *((f"write anna.berg at firma.{end} now", "email", f"anna.berg at firma.{end}") for end in ("ch", "it", "nl", "at", "co", "ru")),
        ("ask sam_8\tat\tfirma.museum now", "email", "sam_8\tat\tfirma.museum"),
        ("call +1 555 one 23 four 567 now", "phone", "+1 555 one 23 four 567"),
        ("call +4 55 12 345 seven now", "phone", "+4 55 12 345 seven"),
    ],
)
def test_disguises_without_other_signs(text, kind, found):
    base, every = pii.spans(text)
    assert [text[a:b] for a, b in every[kind] if (a, b) not in base[kind]] == [found]
    assert pii.masked(text) == text.replace(found, f"[{kind.upper()}]")


def test_prose_beside_signs_is_left_alone():
    for text in ("meet at main.street today", "he was 5 at that.time", "look @ this", "in 2019 one of 10", "a @ b"):
        assert not any(pii.spans(text)[1].values())


@pytest.mark.parametrize("seed", range(3))
def test_phones_against_the_plain_pattern(seed):
    """Phone base spans and the digest of all base spans against plain searches."""
    rng = random.Random(seed)
    plain = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    for _ in range(4000):
        text = "".join(rng.choice("+0123456789 ().-ax") for _ in range(rng.randint(0, 60)))
        want = [m.span() for m in plain.finditer(text) if 9 <= len(re.sub(r"\D", "", m[0])) <= 15]
        assert pii.base_spans(text)["phone"] == want


def slow_found(text):
    """Added spans without sites or blocks: the transducers on the whole text, mapped back."""
    r = pii._at_and_dot(pii._spelled(pii._lettered(pii._look_alikes(pii.Rewritten(text)))))
    out = set()
    for kind, spans in pii.base_spans(r.text).items():
        for a, b in spans:
            lo, hi = r.source(a, b)
            if text[lo:hi] != r.text[a:b]:
                out.add((kind, lo, hi))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_added_spans_against_the_whole_text(seed):
    """What the neighbourhoods of disguises give is what rewriting whole texts gives, far from and near to any cut."""
    rng = random.Random(seed)
    parts = "anna.berg [at] firma dot ch|sam at mail8.example.com|m@exаmple.com|plus one five five five one two three four five six|10 dot 0 dot 0 dot 1|1O.0.0.1|john @ example.com|+1 555 one 23 four 567|te​st@ex​ample.com|+4 55 12 345 seven|john at example.co.jp|x_at_y_dot_org|bob (at) x (dot) org".split("|")
    fill = ["word", "42", "one", "dot", "at", "(", "+", "3.14", "a@b.cc", "un", "é", "12", "l", "x" * 300, "7 " * 90, "(1) " * 40, "\n", "  "]
    for _ in range(150):
        text = " ".join(rng.choice(parts) if rng.random() < 0.15 else rng.choice(fill) for _ in range(rng.randint(1, 80)))
        got = {(k, a, b) for k, v in pii.found_spans(text).items() for a, b in v}
        assert got == slow_found(text), text


def test_spans_do_not_depend_on_cuts():
    name = "a" * 700
    for text in (f"{name} [at] x [dot] org", f"so {name} [at] x [dot] org.", f"{name}@x [dot] {'b' * 900} [dot] org"):
        at = text.index("a" * 700)
        (span,) = pii.spans(text)[1]["email"]
        assert span == (at, len(text.rstrip(".")))
    digits = "4" * 200 + " seven"
    assert not any(pii.spans(digits)[1].values())


def test_letters_for_digits_and_national_endings():
    assert pii.spans("on 1O.0.0.1 now")[1]["ip"] == [(3, 11)] and pii.spans("l92.168.O.1")[1]["ip"] == [(0, 11)]
    assert pii.spans("john at example.co.jp")[1]["email"] == [(0, 21)]
    assert not any(pii.spans("Ol.Ol.Il.lO and v1.O.2")[1].values())
