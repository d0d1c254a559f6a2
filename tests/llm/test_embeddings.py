"""Collision counting against all pairs, and the defined edge cases."""

import numpy as np

from rasterlake.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, component_id string, key string"


def brute(rows):
    """n_links and component of each row by all pairs in double precision."""
    n = len(rows)
    ok, unit = [], []
    for _, v, label, *_ in rows:
        good = label is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)
        v = np.array(v, np.float32).astype(float) if good else None
        ok.append(good)
        v = v / np.abs(v).max() if good else None
        unit.append(v / np.linalg.norm(v) if good else None)
    links, root = np.zeros(n, int), list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = 0
    for i in range(n):
        for j in range(i + 1, n):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
                pairs += 1
    low = {}
    for i in range(n):
        if rows[i][0] is not None:
            low[find(i)] = min(low.get(find(i), rows[i][0]), rows[i][0])
    return links, [low.get(find(i)) for i in range(n)], pairs


def corpus(seed, dim=64):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(60):
        base = rng.standard_normal(dim)
        base /= np.linalg.norm(base)
        for _ in range(int(rng.integers(1, 8))):
            noise = rng.standard_normal(dim)
            noise *= rng.uniform(0, 0.16) / np.linalg.norm(noise)
            rows.append(([float(np.float32(x)) for x in (base + noise) * rng.uniform(0.1, 9)], int(k % 3)))
    rows += [rows[0]] * 5 + [([0.0] * dim, 1), (None, 1), ([], 1), ([float("nan")] + [1.0] * (dim - 1), 1), ([None] + [1.0] * (dim - 1), 1), (rows[3][0], None), ([-x if x == 0 else x for x in rows[5][0]], rows[5][1])]
    rows = [(100 + i, v, label, "x", "y") for i, (v, label) in enumerate(rows)]
    short = rng.standard_normal((4, 7))
    rows += [(900 + i, [float(x) for x in v], 1, "x", "y") for i, v in enumerate([*short, *(short + 0.001), *(short * 1e30), *(short * 1e-30)])]
    return rows + [rows[7], (None, *rows[9][1:]), (None, [1.0] * dim, 2, None, None)]


def test_against_all_pairs(spark):
    for seed, chunk in ((0, 4000), (1, 7)):
        rows = corpus(seed)
        links, roots, _ = brute(rows)
        got = {}
        for r in embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA), chunk=chunk).collect():
            got.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"], r["kept"]))
        want = {}
        for (i, *_), k, c in zip(rows, links, roots):
            want.setdefault(i, []).append((int(k), c, c == i if i is not None and c is not None else c is None))
        total = sum(k for v in want.values() for k, _, _ in v)
        assert sum(k for v in got.values() for k, _, _ in v) >= 0.999 * total
        same = sum(sorted(got[i], key=str) == sorted(want[i], key=str) for i in want if i is not None)
        assert same >= 0.999 * (len(want) - 1)
        assert all(a <= b for i in want for a, b in zip(sorted(k for k, _, _ in got[i]), sorted(k for k, _, _ in want[i])))


def test_count_is_calibrated():
    assert embeddings.least_count(10, 0.5, 1e-9) == 10
    rng = np.random.default_rng(3)
    least = embeddings.least_count(23, 0.98758, 0.999)
    assert np.mean(rng.binomial(23, 0.98758, 200_000) >= least) >= 0.999


def test_extreme_components(spark):
    """Finite vectors whose squares overflow or vanish link like any others."""
    base = [1.0, 2.0, -3.0]
    rows = [(i, [x * scale for x in base], 1) for i, scale in enumerate((1.0, 1e200, 1e-200, 1e305))] + [(9, [1e200, -2e200, 3e200], 1)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {0: (3, 0), 1: (3, 0), 2: (3, 0), 3: (3, 0), 9: (0, 9)}


def test_memory_of_a_group_of_near_copies():
    """5,000 near copies in 256 dimensions stay under 1 GB and are all linked."""
    import resource

    rng = np.random.default_rng(0)
    unit = rng.standard_normal(256) + 0.05 * rng.standard_normal((5000, 256))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    shadow = unit @ embeddings.directions(256, 24).T
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    spread, n, parent = np.sqrt(0.04) / 16, np.zeros(5000, int), np.arange(5000)
    for i, j in embeddings.linked(unit, shadow, np.arange(5000), np.arange(5000), (4 * spread, 2.5 * spread), embeddings.least_count(23, 0.98758, 0.999), 0.98):
        n += np.bincount(i, minlength=5000)
        embeddings.unite(parent, i, j)
    assert (n == 5000).all() and not parent.any()
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1 << 20  # KB


def test_empty(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
