"""Decontamination: re-parameterised questions, slot consistency, brute force, edge cases."""

import random
import re

import pytest

from rasterlake.llm import decontam

ITEM = "In the market Peter sells 12 apples for 3 euros each morning. How much does Peter earn when 12 apples are sold?"
DOCS = "doc_id long, text string, item_id string, code string"
ITEMS = "item_id long, text string, doc_id string"


def run(spark, docs, items, **options):
    docs = spark.createDataFrame([(i, t, "x", "x") for i, t in docs], DOCS)
    items = spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS)
    return {(r["doc_id"], r["item_id"]): r for r in decontam.leaks(docs, items, **options).collect()}


@pytest.mark.parametrize("most", [2_000_000, 0])
def test_parameters_and_consistency(spark, most):
    docs = [
        (1, "Some words before. " + ITEM + " and after"),
        (2, ITEM.replace("Peter", "Maria").replace("12", "57").replace("3 euros", "9 dollars")),
        (3, ITEM.replace("12 apples for", "40 apples for").replace("when 12", "when 77").replace("Peter earn", "Anna earn")),
        (4, ITEM.upper()),
        (5, "In the market nobody sells anything today and that is all there is to say about it."),
        (6, None),
        (7, ""),
        (None, ITEM),
        (1, "repeated row with the same id"),
    ]
    got = run(spark, docs, [(9, ITEM), (9, ITEM), (10, "too short"), (11, None)], most_windows=most)
    kinds = {k: r["kind"] for k, r in got.items()}
    assert kinds == {(1, 9): "verbatim", (2, 9): "reparameterised", (4, 9): "verbatim", (None, 9): "verbatim"}
    assert got[1, 9]["coverage"] == 1.0 and got[2, 9]["n_changed"] > 0


def test_empty_tables(spark):
    assert run(spark, [], [(1, ITEM)]) == {} == run(spark, [(1, ITEM)], [])


def test_clean(spark):
    docs = spark.createDataFrame([(1, ITEM, "a"), (2, "nothing here", "b"), (None, "nothing", "c")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(9, ITEM)], "item_id long, text string")
    kept = decontam.clean(docs, items)
    assert kept.columns == docs.columns and {r["item_id"] for r in kept.collect()} == {"b", "c"}


def slow_words(text):
    """(canonical word, plain word) of a text, word by word."""
    out, opens, number = [], True, False
    for line in (text or "").split("\n"):
        opens = True
        for chunk in line.split():
            for k, w in enumerate(decontam._WORD.findall(chunk)):
                low = w.lower()
                if w[0].isdigit():
                    out.append(("<n>", low))
                elif (low in decontam.UNITS or w in "%€$£°") and number:
                    out.append(("<u>", low))
                elif len(w) > 1 and w[0].isupper() and not w.isupper() and not (opens and k == 0) and low not in decontam.UNITS:
                    out.append(("<c>", low))
                else:
                    out.append((low, low))
                number = w[0].isdigit()
            if decontam._WORD.search(chunk) or decontam._ENDS.search(chunk):
                opens = bool(decontam._ENDS.search(chunk))
    return out


def test_windows_against_slow_form():
    rng = random.Random(4)
    vocab = ["Anna", "Berlin", "runs", "the", "5", "12.5", "km", "km.", "apples", "sold!", "it's", "well-known", "A", "EUR", "--", "two\nthree", "Zoë.", "…"]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    word, kind, sizes = (canon := decontam.Canon()).words(texts)
    at = 0
    for t, n in zip(texts, sizes):
        got = [("<nuc>"[0] + "nuc"[k - 1] + ">" if k else canon.surface[w], canon.surface[w]) for w, k in zip(word[at : at + n], kind[at : at + n])]
        assert got == slow_words(t), t
        at += n
    text, place, template, plain, _, _ = canon.windows(texts)
    seen = {}
    for i, p, a, b in zip(text, place, template, plain):
        words = slow_words(texts[i])[p : p + decontam.WINDOW]
        assert seen.setdefault(int(b), tuple(w for _, w in words)) == tuple(w for _, w in words)
        if a:
            assert seen.setdefault(("t", int(a)), tuple(c for c, _ in words)) == tuple(c for c, _ in words)


def test_planted_passages(spark):
    import pyarrow.parquet as pq

    docs = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    items = pq.read_table("/root/testdata/sf0.001/benchmark.parquet", columns=["item_id", "text"]).to_pydict()
    flat = lambda t: re.sub(r"\W+", " ", t.lower())
    want = {(d, i) for d, t in zip(*docs.values()) for i, q in zip(*items.values()) if flat(q) in flat(t)}
    assert want <= set(run(spark, list(zip(*docs.values())), list(zip(*items.values()))))


@pytest.mark.parametrize("most", [2_000_000, 0])
def test_openers_slots_and_short_items(spark, most):
    """Names that open sentences, windows rich in slots and items under five words."""
    tom = "Tom buys 5 pens. Tom sells 2 pens. Tom finds 3 pens. How many pens does Tom have now?"
    items = [(1, tom), (2, "Solve 3x + 5 = 20 for x."), (3, "What is 12 + 35?"), (4, "Add 3 and 3 now"), (5, "yes"), (6, None)]
    new = {"Tom": "Anna", "5": "8", "2": "6", "3": "4"}
    docs = [
        (1, re.sub("Tom|[523]", lambda m: new[m[0]], tom)),
        (2, "Please solve 7x + 9 = 44 for x. Thanks"),
        (3, "Quiz: what is 99 + 1? Well"),
        (4, "We add 5 and 7 now"),
        (5, "We add 8 and 8 now"),
        (6, "yes, this says nothing about 7 or 9 of them"),
        (7, tom.replace("How", "So how").lower()),
        (8, tom.replace("Tom sells", "Eva sells")),
    ]
    got = run(spark, docs, items, most_windows=most)
    kinds = {k: r["kind"] for k, r in got.items()}
    new = "reparameterised"
    assert kinds == {(1, 1): new, (2, 2): new, (3, 3): new, (5, 4): new, (7, 1): "verbatim", (8, 1): "verbatim"}
    assert got[1, 1]["coverage"] == 1.0


def test_one_number_in_two_roles(spark):
    """Equal numbers that count different things may change apart; those that count the same thing may not."""
    item = "each day the old baker trades 5 loaves for 5 coins at the market and keeps 2 loaves at home"
    docs = [(1, item.replace("5 loaves", "7 loaves").replace("5 coins", "9 coins")), (2, item.replace("5 coins", "8 coins"))]
    assert {k: r["kind"] for k, r in run(spark, docs, [(1, item)]).items()} == {(1, 1): "reparameterised", (2, 1): "reparameterised"}
    twice = "first 5 loaves are sold then the other 5 loaves are sold to the neighbours"
    assert run(spark, [(1, twice.replace("5", "7")), (2, twice.replace("first 5", "first 7").replace("other 5", "other 9"))], [(1, twice)]).keys() == {(1, 1)}


LONG = (
    "every autumn the people of the little harbour bring what they grew to the long hall beside the water where a woman sells 12 apples to each child "
    "who asks for them and keeps the rest for her own kitchen because she says that 12 apples are enough for one winter and that nobody needs any more fruit than this"
)


@pytest.mark.parametrize("most", [2_000_000, 0])
def test_near_verbatim_copies_with_a_torn_number(spark, most):
    """One changed number that stands elsewhere, too, takes its own windows and leaves the verbatim rest."""
    docs = [(1, LONG), (2, LONG.replace("sells 12", "sells 11")), (3, LONG.replace("little", "quiet")), (4, LONG.replace("12 apples", "11 apples"))]
    got = run(spark, docs, [(9, LONG)], most_windows=most)
    assert got.keys() == {(k, 9) for k in (1, 2, 3, 4)}
    assert got[1, 9]["coverage"] == 1.0 and got[2, 9]["coverage"] > 0.85 and got[3, 9]["coverage"] > 0.85
    assert {k: r["kind"] for (k, _), r in got.items()} == {1: "verbatim", 2: "verbatim", 3: "verbatim", 4: "reparameterised"}


NAMES, UNITS = ["Anna", "Berlin", "Carlos", "Dora", "Emil", "Fatima", "Goran", "Hanoi"], ["km", "kg", "euros", "hours"]


def question(rng, vocab):
    """A text of plain words, numbers, names and units (words, slots), opening in lower case."""
    out = [rng.choice(vocab)]
    for _ in range(rng.randint(7, 28)):
        draw = rng.random()
        out.append(str(rng.randint(2, 99)) if draw < 0.12 else rng.choice(NAMES) if draw < 0.2 else rng.choice(UNITS) if draw < 0.25 and out[-1].isdigit() else rng.choice(vocab))
    return out


def renamed(rng, words):
    """The same with every number and name replaced, consistently."""
    new = {}
    return [new.setdefault(w, str(rng.randint(100, 999))) if w.isdigit() else new.setdefault(w, rng.choice(["Ivo", "Jana", "Kolja", "Lima"]) + w.lower()) if w in NAMES else w for w in words]


def slow_leaks(docs, items, least=0.5):
    """The whole result for texts without sentence openers and whole-item windows, window by window and alignment by alignment."""
    width, kinds, out = decontam.WINDOW, {"<n>", "<u>", "<c>"}, {}

    def can(window):
        return sum(c not in kinds for c, _ in window) >= decontam.LEAST_PLAIN

    for d, t in docs:
        doc = slow_words(t)
        for i, q in items:
            item = slow_words(q)
            n = len(item) - width + 1
            found, opened, best = set(), set(), (0, 0, 0)
            n_open = sum(can(item[k : k + width]) for k in range(n))
            for shift in range(-len(item), len(doc)):
                hits, slots = [], {}
                for k in range(n):
                    a, b = item[k : k + width], doc[k + shift : k + shift + width] if k + shift >= 0 else []
                    if len(b) < width:
                        continue
                    plain = [w for _, w in a] == [w for _, w in b]
                    template = [c for c, _ in a] == [c for c, _ in b] and can(a) and any(c in kinds for c, _ in a)
                    if plain or template:
                        hits.append((k, plain, template))
                    if template:
                        for j in range(width):
                            if a[j][0] in kinds:
                                role = item[k + j + 1][1] if a[j][0] == "<n>" and len(item) >= decontam.LEAST_ROLES and k + j + 1 < len(item) and item[k + j + 1][0] != "<n>" else None
                                slots.setdefault((a[j], role), {}).setdefault(b[j][1], set()).add(k + j)
                torn = {a for a, v in slots.items() if len(v) > 1}
                role_of = lambda k: item[k + 1][1] if item[k][0] == "<n>" and len(item) >= decontam.LEAST_ROLES and k + 1 < len(item) and item[k + 1][0] != "<n>" else None
                # verbatim windows count by themselves, template windows without torn values
                places = {k for k, plain, _ in hits if plain} | {k for k, _, template in hits if template and not any((item[j], role_of(j)) in torn for j in range(k, k + width))}
                slots = {a: v for a, v in slots.items() if a not in torn}
                found |= places
                opened |= {k for k in places if can(item[k : k + width])}
                n_slots = sum(len(at) for v in slots.values() for at in v.values())
                changed = sum(len(at) for (a, _), v in slots.items() for b, at in v.items() if a[1] != b)
                best = max(best, (len(places), n_slots, changed))
            by_open = 2 * n_open >= n and len(opened) * n > len(found) * n_open
            asked, got = (n_open, len(opened)) if by_open else (n, len(found))
            if got and got >= least * asked:
                out[d, i] = (asked, got, "reparameterised" if best[2] else "verbatim")
    return out


def test_whole_result_against_slow_form(spark):
    rng = random.Random(12)
    vocab = "the shop sells red green apples and pears for some people who live near a river in winter when it snows".split()
    items = [(k, " ".join(question(rng, vocab))) for k in range(25)]
    items = [(k, q) for k, q in items if 2 * sum(sum(c[0] != "<" for c, _ in slow_words(q)[j : j + 5]) >= 3 for j in range(len(slow_words(q)) - 4)) >= len(slow_words(q)) - 4]
    docs = []
    for k in range(60):
        _, q = rng.choice(items)
        words = q.split()
        some = renamed(rng, words) if k % 3 else words
        cut = some[rng.randint(0, 4) : len(some) - rng.randint(0, 6)]
        if k % 5 == 0:  # change single values only
            cut = [str(rng.randint(2, 99)) if w.isdigit() and rng.random() < 0.5 else w for w in cut]
        docs.append((k, " ".join([*rng.choices(vocab, k=rng.randint(1, 12)), *cut, *rng.choices(vocab, k=rng.randint(0, 12))])))
    got = {k: (r["n_windows"], r["n_found"], r["kind"]) for k, r in run(spark, docs, items).items()}
    assert got == slow_leaks(docs, items) and len(got) > 30


def test_recall_on_reparameterised_questions(spark):
    """At least 0.95 of generated questions are found with all their numbers and names replaced, none in other texts."""
    rng = random.Random(21)
    vocab = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 8))) for _ in range(800)]
    items = [(k, " ".join(question(rng, vocab)).capitalize() + ".") for k in range(300)]
    docs = [(k, " ".join(rng.choices(vocab, k=80)) + ". " + " ".join(renamed(rng, q.rstrip(".").split())).capitalize() + ". " + " ".join(rng.choices(vocab, k=80))) for k, q in items]
    docs += [(1000 + k, " ".join(question(rng, vocab))) for k in range(300)]
    got = set(run(spark, docs, items))
    assert {d for d, _ in got if d < 1000} <= {k for k, _ in items} and all(d == i for d, i in got)
    assert len(got) >= 0.95 * len(items)


def test_very_long_text(spark):
    text = "filler words without end " * 100_000 + ITEM.replace("12", "57") + " more of it" * 1000
    assert run(spark, [(1, text)], [(9, ITEM)])[1, 9]["kind"] == "reparameterised"
