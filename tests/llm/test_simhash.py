"""SimHash near-duplicates against all pairs, and the defined edge cases."""

import random
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import functions as F

from rasterlake.llm import simhash
from rasterlake.llm._common import components

SCHEMA = "doc_id long, text string, fp string, component_id string"


def slow_fingerprint(text, width):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, fps):
    root = {i: i for i in range(len(ids))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(ids)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= simhash.MAX_BITS:
            root[find(i)] = find(j)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(i)
    low = {r: min((ids[i] for i in g if ids[i] is not None), default=None) for r, g in groups.items()}
    return [low[find(i)] for i in range(len(ids))]


def corpus():
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefgé") for _ in range(5)) for _ in range(400)]
    rows = []
    for base in range(12):
        words = [rng.choice(vocab) for _ in range(120)]
        for _ in range(rng.randint(1, 9)):
            copy = list(words)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append(" ".join(copy))
    rows += [None, "", "  \t\n", "one two", "One\tTWO", "x " * 3, "İK straße\x1cz a b c d"]
    return [(i, t, "clash", "clash") for i, t in enumerate(rows)] + [(3, rows[3], None, None), (None, rows[5], None, None), (None, "alone " * 9, None, None)]


def test_against_all_pairs(spark):
    rows = corpus()
    for width, chunk in ((4, 2048), (5, 2048)):
        got = sorted(simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), width).collect(), key=str)
        fps = [slow_fingerprint(r[1], width) for r in rows]
        roots = slow_components([r[0] for r in rows], fps)
        want = sorted([(r[0], int(np.uint64(f).view(np.int64)), c) for r, f, c in zip(rows, fps, roots)], key=lambda r: str(r))
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_long_lists_are_split_without_losing_links(spark):
    rng = random.Random(1)
    base = rng.getrandbits(64)
    fps = {base}
    while len(fps) < 150:
        fps.add(rng.choice(sorted(fps)) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))))
    fps = sorted(fps)
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    frame = spark.createDataFrame([(s, s) for s in signed], "id long, f0 long")
    for chunk in (7, 2048):
        roots = {r["node"]: r["root"] for r in components(simhash.links(frame, chunk=chunk), "test").collect()}
        assert [roots.get(s, s) for s in signed] == slow_components(signed, fps)


def test_wide_plan_finds_similar_texts(spark):
    """Texts with a few words changed are linked, texts that only share a passage are not; every link found is within the bits."""
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    shared, rows, group = rng.choices(vocab, k=60), [], []
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    similar = 0
    for base in range(60):
        words = rng.choices(vocab, k=240) + shared
        for _ in range(3):
            copy = list(words)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(240)] = rng.choice(vocab)
            rows.append((len(rows), " ".join(copy)))
            group.append((base, shingles(copy)))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, simhash.WIDE).collect()}
    assert all(group[d][0] == group[c][0] for d, c in got.items())
    near = {i: {j for j in range(len(rows)) if len(group[i][1] & group[j][1]) >= 0.8 * len(group[i][1] | group[j][1])} for i in range(len(rows))}
    for i in range(len(rows)):  # every link is exact: a document that is not first has another of its component at 0.8 or more
        assert got[i] == i or any(j != i and got[j] == got[i] for j in near[i])
    linked = [got[i] == got[j] for i in range(len(rows)) for j in range(i) if group[i][0] == group[j][0] and len(group[i][1] & group[j][1]) >= 0.8 * len(group[i][1] | group[j][1])]
    assert len(linked) > 50 and np.mean(linked) > 0.95
    fps = np.array([simhash.fingerprint(t.encode(), 5, 4) for _, t in rows], np.uint64)
    assert [int(f) for f in fps[:, 0]] == [slow_fingerprint(t, 5) for _, t in rows]


def test_triples_cover_all_fours():
    triples = [set(t) for t in simhash.position_triples()]
    assert len(triples) == 20
    assert all(any(t <= set(four) for t in triples) for four in combinations(range(8), 4))


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_lone_pairs_around_the_threshold(spark):
    """Pairs without a third copy to chain through: at 0.8 and more they are links, under 0.8 they never are."""
    rng = random.Random(11)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(5000)]
    rows, alike = [], []
    for k in range(300):
        words = rng.choices(vocab, k=rng.randint(120, 400))
        copy, shingles = list(words), lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        goal = rng.uniform(0.7, 0.9)
        while (j := len(shingles(words) & shingles(copy)) / len(shingles(words) | shingles(copy))) > goal:
            copy[rng.randrange(len(copy))] = rng.choice(vocab)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
        alike.append(j)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, simhash.WIDE).collect()}
    linked = np.array([got[2 * k + 1] == 2 * k for k in range(300)])
    alike = np.array(alike)
    assert all(got[2 * k] == 2 * k for k in range(300)) and not linked[alike < 0.8].any()
    assert linked[alike >= 0.8].mean() >= 0.97


def test_forest_is_minimal():
    rng = np.random.default_rng(4)
    v = rng.integers(0, 1 << 62, (90, 4)).astype(np.uint64)
    v[30:] = v[rng.integers(0, 30, 60)] ^ (np.uint64(1) << rng.integers(0, 62, (60, 4)).astype(np.uint64))
    key = np.zeros((90, 2), np.int64)
    plan = simhash.WIDE
    bits = lambda e: sorted(int(np.bitwise_count(v[i] ^ v[j]).sum()) for i, j in e)
    assert bits(simhash.forests(key, v, plan, most=100)) == bits(simhash.grown(v, plan)) and len(simhash.grown(v, plan)) > 40


def near_threshold(rng, groups, size, words=100, changed=(1, 2, 2, 3, 3)):
    """Groups in which each text is an earlier one with a few words changed: two changed words of 100 leave similarity 0.81, three 0.73."""
    out = []
    for g in range(groups):
        own = [[f"g{g}w{k}" for k in range(words)]]
        while len(own) < size:
            text = list(rng.choice(own))
            for at in rng.sample(range(words), rng.choice(changed)):
                text[at] = f"x{rng.randint(0, 10**9)}"
            own.append(text)
        out += [" ".join(t) for t in own]
    return out


def test_no_link_is_lost_to_a_forest(spark):
    """Groups around similarity 0.8: components are those of all pairs that are candidates and similar, and all but those of all similar pairs."""
    rng = random.Random(8)
    texts = near_threshold(rng, 8, 25) + near_threshold(rng, 1, 100) + near_threshold(rng, 1, 60, 60, (1, 2))
    sets = [np.unique(simhash.shingle_hashes(t.encode(), 5)) for t in texts]
    prints = np.array([simhash.fingerprint(t.encode(), 5, 4) for t in texts], np.uint64)

    def kept(ok):
        root = list(range(len(texts)))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        n = 0
        for i in range(len(texts)):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) and ok(i, j):
                    n += 1
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
        return {i for i in range(len(texts)) if find(i) == i}, n

    def candidate(i, j):
        x = np.bitwise_xor(prints[i], prints[j])
        same = x.view(np.uint8) == 0
        return np.bitwise_count(x).sum() <= 54 and same.sum() >= 3 and any(all(same[p] for p in at) for at in simhash.WIDE.positions)

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"] for r in simhash.keep_first(docs, width=5, plan=simhash.WIDE).collect()}
    exact, n_exact = kept(candidate)
    every, n_every = kept(lambda i, j: True)
    assert got == exact
    assert 0.97 * n_every <= n_exact and len(got) <= len(every) + 5 and 1 < len(every) < len(texts) - 50, (len(got), len(every), n_exact, n_every)


def test_runs_stay_whole():
    from rasterlake.llm._common import complete_runs
    import pyarrow as pa

    keys = [1, 1, 1, 2, 3, 3, 3, 3, 3, 4, 5, 5]
    for size in (1, 2, 3, 5, 100):
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[k : k + size]), pa.array(range(k, min(k + size, len(keys))))], names=["k", "v"]) for k in range(0, len(keys), size)]
        tables = [t.column(0).to_pylist() for t in complete_runs(batches, 1)]
        assert sum(tables, []) == keys and all(a[-1] != b[0] for a, b in zip(tables, tables[1:]))


def test_groups_by_chunks_and_by_postings(spark, monkeypatch):
    """One group of texts around the threshold: looked at again by pairs of chunks, by chunks of a few texts and by postings, it leaves the same documents."""
    rng = random.Random(9)
    texts = near_threshold(rng, 1, 160) + near_threshold(rng, 5, 12)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    of = simhash.settled
    kept = []
    for more in ({}, {"few": 16}, {"most": 1}):
        monkeypatch.setattr(simhash, "settled", lambda *a, m=more: of(*a, **m))
        kept.append({r["doc_id"] for r in simhash.keep_first(docs, width=5, plan=simhash.WIDE).collect()})
    assert kept[0] == kept[1] == kept[2] and 1 < len(kept[0]) < len(texts)


def test_large_group_makes_few_rows(spark):
    """Texts of one large group travel with their sets once for each chunk of the group; by their postings it was 96 rows a text."""
    from tests.test_scale import rows_made

    rng = random.Random(10)
    base = [f"w{k}" for k in range(100)]
    texts = []
    for _ in range(300):  # each pair is a candidate at most, and no link
        text = list(base)
        for at in rng.sample(range(100), 2):
            text[at] = f"x{rng.randint(0, 10**9)}"
        texts.append(" ".join(text))
    docs = simhash.materialise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "test-docs")
    plan = simhash.WIDE
    rows = simhash.fingerprints(docs, 5, plan).withColumn("id", F.xxhash64(*(f"f{k}" for k in range(4)), "s"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("first")
    classes = simhash.materialise(rows.groupBy("id", *(f"f{k}" for k in range(4))).agg(first, F.count(F.lit(1)).alias("n")), "test-classes")
    pairs, known = simhash.verified(simhash.links(classes, plan), classes, docs, 5, plan, "text", "doc_id")
    roots = components(pairs.where("ok").select("a", "b"), "test-links")
    _, most = rows_made(spark, lambda: simhash.settled(pairs, known, classes, roots, plan).collect(), ("Join",))
    assert 0 < most <= 2 * pairs.count()
