"""SimHash near-duplicates through an inverted index on byte positions.

Two 64-bit fingerprints with at most 4 differing bits agree in at least 4 of their 8
bytes: that is the guaranteed minimum of shared positional bytes. A posting list per
single (position, byte) would hold 1/256 of all fingerprints, and its pairs would grow
with the square of the corpus. So the postings are keyed by three positional bytes at
once, for the 20 position triples of a Turan system: any 4 positions contain one of
these triples, so no pair with 4 shared bytes is lost, and a list holds 1/2^24 of the
fingerprints. For each pair of a list the shared positional bytes are tallied, pairs
under the minimum of 4 are dropped, the rest is verified by the differing bits.

``WIDE`` finds texts of similar shingle sets. 64 bits are too few for similarity 0.8, so it takes 256 (a pair of
Jaccard similarity 0.8 differs in 39 on average, by 5.7), postings for 96 pairs of byte positions (measured: such a pair
shares none with probability 0.03, one of similarity 0.83 with 0.01) and candidates up to 54 differing bits. So many bits can touch every byte, so the
minimum of 3 shared bytes is calibrated there, not guaranteed. Each candidate is then verified on the texts' own
shingle sets: only pairs of Jaccard similarity ``similarity`` or more are links. Bits and similarity do not order alike, so a
failed step of a forest may stand between texts that are linked: components of verified links that failed candidates connect
are looked at again, all their pairs across components, with the shingle sets at hand (``settled``). So no
pair that meets in a list within ``max_bits`` is lost to the forest.

Copies are one row of the index. A list longer than ``chunk`` is split into chunks and compared chunk
pair by chunk pair in different tasks. A task reports a minimum spanning forest of the pairs it found, by differing bits (a row
per fingerprint at most), never all pairs, so groups of near copies cost rows in proportion to their size; any two
texts of a list are joined there by steps that differ in no more bits than they do themselves.

Defined results: null, empty or blank text has fingerprint 0 and is linked like any
other; repeated rows each get their row; a null doc_id takes part in links but never
names a component unless the whole component has none (then component_id is null);
other columns of the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlake.llm._common import complete_runs, components, join_hot, materialise

MAX_BITS = 4
SEED = 42


@dataclass(frozen=True)
class Plan:
    """Fingerprint of ``words`` 64-bit words, candidates at ``max_bits`` or fewer differing bits, at least ``min_shared``
    equal bytes, and postings keyed by the bytes at each of ``positions``. Links are all candidates, or those of
    Jaccard similarity ``similarity`` or more."""

    words: int
    max_bits: int
    min_shared: int
    positions: tuple[tuple[int, ...], ...]
    similarity: float | None = None


def mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th independent word for each hash: the hash itself, then its mix with k (splitmix64 finaliser)."""
    if k == 0:
        return hashes
    x = hashes + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of all shingles of ``width`` words, repeats included; of the whole sequence if it is shorter; none without words."""
    words = text.lower().split()  # bytes: lowers A-Z only and splits at 0x20, 0x09-0x0D only
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - width + 1)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    return np.fromiter((digest(s, SEED) for s in shingles), np.uint64, n)


def majority(hashes: np.ndarray, n_words: int = 1) -> list[int]:
    """Majority bits of the hashes; 0 without any."""
    out = []
    for k in range(n_words):
        ones = np.zeros(64, np.int64)
        for lo in range(0, len(hashes), 1 << 15):
            part = mixed(hashes[lo : lo + (1 << 15)], k)
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").view(np.uint64)[0]))
    return out


def fingerprint(text: bytes, width: int, n_words: int = 1) -> list[int]:
    return majority(shingle_hashes(text, width), n_words)


def fingerprints(docs: DataFrame, width: int, plan: Plan, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, h, f0, ..., s)`` for each row as longs: h is a hash of the text, the f are the fingerprint's words, s is
    a hash of the set of shingles (0 where links need bits alone)."""
    names = ["doc_id", "h", *(f"f{k}" for k in range(plan.words)), "s"]

    def one(t: bytes | None) -> list[int]:
        hashes = shingle_hashes(t or b"", width)
        return majority(hashes, plan.words) + [xxhash.xxh64_intdigest(np.unique(hashes).tobytes()) if plan.similarity else 0]

    def run(batches):
        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            fps = np.array([one(t) for t in texts], np.uint64).reshape(len(texts), plan.words + 1).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c.copy(), pa.int64()) for c in fps.T)], names=names)

    content = F.col(text).cast("string")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(content).alias("h"), content.alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def position_triples() -> list[tuple[int, int, int]]:
    """20 triples of byte positions, one of them inside any 4 positions: parts of 3, 3 and 2 positions in a
    circle; a triple lies in one part, or has two positions in a part and one in the next."""
    parts = [{0, 1, 2}, {3, 4, 5}, {6, 7}]
    inside = [t for p in parts for t in combinations(sorted(p), 3)]
    across = [(*two, one) for k in range(3) for two in combinations(sorted(parts[k]), 2) for one in sorted(parts[(k + 1) % 3])]
    return inside + across


EXACT = Plan(1, MAX_BITS, 8 - MAX_BITS, tuple(position_triples()))
#: Pairs of byte positions 1, 16, 2, 8, 4 and 5 apart, no position more than seven times.
WIDE = Plan(4, 54, 3, tuple([(i, i + d) for d in (1, 16, 2, 8, 4) for i in range(32) if i // d % 2 == 0] + [(i, i + 5) for i in range(16)]), 0.8)


def _byte(position: int):
    return F.shiftrightunsigned(f"f{position // 8}", 8 * (position % 8)).bitwiseAND(F.lit(255).cast("long"))


def _postings(classes: DataFrame, plan: Plan, *others: str) -> DataFrame:
    keys = []
    for k, at in enumerate(plan.positions):
        code = F.lit(k << 8 * len(at)).cast("long")
        for j, position in enumerate(at):
            code = code + F.shiftleft(_byte(position), 8 * (len(at) - 1 - j))
        keys.append(code)
    return classes.select("id", *others, *(f"f{k}" for k in range(plan.words)), F.explode(F.array(*keys)).alias("key"))


def _bits(one: np.ndarray, many: np.ndarray, plan: Plan) -> np.ndarray:
    """Differing bits, or more than any where too few positional bytes are shared."""
    x = np.ascontiguousarray(np.bitwise_xor(one, many))
    few = (x.view(np.uint8).reshape(len(x), 8 * plan.words) == 0).sum(1) < plan.min_shared
    return np.where(few, 1 << 20, np.bitwise_count(x).sum(1, dtype=np.int64))


def grown(v: np.ndarray, plan: Plan) -> list[tuple[int, int]]:
    """Minimum spanning forest (pairs of places) of one long list: trees grow by the nearest fingerprint."""
    out, now, left = [], 0, np.arange(1, len(v))
    best, parent = np.full(len(v), 1 << 20), np.zeros(len(v), np.int64)
    while len(left):
        d = _bits(v[now], v[left], plan)
        near = d < best[left]
        best[left[near]], parent[left[near]] = d[near], now
        k = int(best[left].argmin())
        now, left = int(left[k]), np.delete(left, k)
        if best[now] <= plan.max_bits:
            out.append((now, int(parent[now])))
    return out


def forests(key: np.ndarray, v: np.ndarray, plan: Plan, most: int = 64) -> np.ndarray:
    """Spanning pairs (places) of all lists, rows of a list being neighbours with equal ``key``. Lists of up to ``most`` rows go
    through together, all rows d places apart at a time; close pairs are few, and join from the nearest on."""
    edge = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
    lo, hi = np.r_[0, edge], np.r_[edge, len(v)]
    short = hi - lo <= most
    out = [(s + i, s + j) for s, t in zip(lo[~short].tolist(), hi[~short].tolist()) for i, j in grown(v[s:t], plan)]
    end = np.repeat(hi, hi - lo)
    at, found = np.flatnonzero(np.repeat(short, hi - lo)), []
    for d in range(1, most):
        at = at[at + d < end[at]]
        if not len(at):
            break
        bits = _bits(v[at], v[at + d], plan)
        ok = bits <= plan.max_bits
        found.append(np.c_[bits[ok], at[ok], at[ok] + d])
    found = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    root: dict[int, int] = {}

    def find(i: int) -> int:
        while (r := root.get(i, i)) != i:
            root[i] = i = root.get(r, r)
        return i

    for _, i, j in found[found[:, 0].argsort(kind="stable")].tolist():
        a, b = find(i), find(j)
        if a != b:
            root[a] = b
            out.append((i, j))
    return np.array(out, np.int64).reshape(-1, 2)


def _matcher(plan: Plan):
    """Batches sorted by (key, block): handle each run of equal keys once it is complete."""

    def runs(k, v):
        pairs = forests(k, np.ascontiguousarray(v[:, 1:]).view(np.uint64), plan)
        return pa.RecordBatch.from_arrays([pa.array(v[pairs[:, c], 0], pa.int64()) for c in (0, 1)], names=["a", "b"])

    def run(batches):
        keep_k, keep_v = np.zeros((0, 2), np.int64), np.zeros((0, plan.words + 1), np.int64)
        for batch in batches:
            cols = [np.asarray(c) for c in batch.columns]
            k, v = np.concatenate([keep_k, np.stack(cols[:2], 1)]), np.concatenate([keep_v, np.stack(cols[2:], 1)])
            last = np.flatnonzero((k != k[-1]).any(1)) if len(k) else []
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield runs(k[:cut], v[:cut])
            keep_k, keep_v = k[cut:], v[cut:]
        if len(keep_v):
            yield runs(keep_k, keep_v)

    return run


def _dealt(post: DataFrame, chunk: int, tag: str, part: bool = False) -> DataFrame:
    """Posting rows with ``block``: lists longer than ``chunk`` are split, and each pair of chunks has a block; shuffled and sorted by (key, block), which come first.
    With ``part`` the row's own chunk comes last."""
    # written first: its size is then known (a row for each ``chunk`` postings at most), and a small one costs the postings no shuffle
    long_lists = materialise(post.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > chunk), tag)
    split = post.join(long_lists, "key", "left").withColumn("parts", F.ceil(F.coalesce("n", F.lit(1)) / F.lit(chunk)).cast("long"))
    own = F.pmod(F.xxhash64("id", "key"), F.col("parts"))
    blocks = F.when(F.col("parts") == 1, F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda j: F.least(own, j) * F.col("parts") + F.greatest(own, j))
    )
    spread = split.select("key", F.explode(blocks).alias("block"), *(c for c in post.columns if c != "key"), *([own.alias("part")] if part else []))
    return spread.repartition("key", "block").sortWithinPartitions("key", "block")


def links(classes: DataFrame, plan: Plan = EXACT, chunk: int = 2048) -> DataFrame:
    """Spanning candidates ``(a, b)`` between the ids of classes: same components as all pairs that meet in a list."""
    post = _postings(classes, plan).select("key", "id", *(f"f{k}" for k in range(plan.words)))
    return _dealt(post, chunk, "simhash-long").mapInArrow(_matcher(plan), "a long, b long")


def similar(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    """Whether two sorted sets of hashes have Jaccard similarity ``least`` or more."""
    if not len(x) or not len(y) or min(len(x), len(y)) < least * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= least * (len(x) + len(y) - both)


def verified(candidates: DataFrame, classes: DataFrame, docs: DataFrame, width: int, plan: Plan, text: str, doc_id: str) -> tuple[DataFrame, DataFrame]:
    """The candidates as ``(a, b, ok)``, ok where their classes have shingle sets of Jaccard similarity ``plan.similarity`` or more, and the sets ``(id, w)`` of
    classes that have a candidate. Sets travel to pairs; those of hubs are dealt over several tasks."""
    pairs = materialise(candidates.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "simhash-candidates")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(classes, "id").select("id", F.col("first.doc_id").alias("d"), F.col("first.h").alias("h"))
    content = F.col(text).cast("string")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), content.alias("text"), F.xxhash64(content).alias("text_hash"))
    # the side of asked classes grows with the input: a shuffled join at every size
    side = asked.hint("merge")
    texts = rows.join(side, rows["doc_id"].eqNullSafe(side["d"]) & (rows["text_hash"] == side["h"])).select("id", "text")

    def sets(batches):
        for batch in batches:
            found = [np.unique(shingle_hashes(t or b"", width)).tobytes() for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["id", "w"])

    known = materialise(texts.mapInArrow(sets, "id long, w binary").groupBy("id").agg(F.first("w").alias("w")), "simhash-sets")

    def compare(batches):
        for batch in batches:
            ok = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), plan.similarity) for x, y in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])

    total = pairs.count()

    def with_set(rows: DataFrame, end: str, other: str, share: int = 1000, salts: int = 64) -> DataFrame:
        """``rows`` with the set of one end; hubs, which have more than 1/``share`` of all pairs and are fewer than ``share``, are dealt over ``salts`` tasks."""
        hubs = [r[end] for r in pairs.groupBy(end).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * share > total).select(end).collect()]
        hub = F.col(end).isin(hubs)
        copies = F.when(hub, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
        side = known.select(F.col("id").alias(end), F.col("w").alias(f"w{end}")).withColumn("salt", F.explode(copies))
        return rows.withColumn("salt", F.when(hub, F.pmod(F.hash(other), F.lit(salts))).otherwise(F.lit(0))).join(side.hint("merge"), [end, "salt"]).drop("salt")

    both = with_set(with_set(pairs, "a", "b"), "b", "a").select("a", "b", "wa", "wb")
    return materialise(both.mapInArrow(compare, "a long, b long, ok boolean"), "simhash-verified"), known


def _crossing(v: np.ndarray, root: np.ndarray, plan: Plan, k: int | None = None, part: np.ndarray | None = None) -> np.ndarray:
    """(bits, place, place) of the pairs that are candidates, of different components, and meet in a list: in none before the k-th, where that is given.
    Of two chunks only pairs across count, since each chunk has a block of its own."""
    at, found = np.array(plan.positions), [np.zeros((0, 3), np.int64)]
    across = part is not None and bool((part != part[0]).any())
    for i in range(len(v) - 1):
        ok = (_bits(v[i], v[i + 1 :], plan) <= plan.max_bits) & (root[i + 1 :] != root[i])
        j = np.flatnonzero(ok & (part[i + 1 :] != part[i]) if across else ok)
        if len(j):
            x = np.bitwise_xor(v[i], v[i + 1 + j])
            meets = (x.view(np.uint8).reshape(len(j), -1) == 0)[:, at].all(2)
            met = meets.any(1) if k is None else meets.argmax(1) == k
            found.append(np.c_[np.bitwise_count(x[met]).sum(1, dtype=np.int64), np.full(met.sum(), i), i + 1 + j[met]])
    return np.concatenate(found)


def settled(pairs: DataFrame, known: DataFrame, classes: DataFrame, roots: DataFrame, plan: Plan, chunk: int = 2048, few: int = 256, most: int | None = None) -> DataFrame:
    """``(root, into)``: components of verified links that are linked to others by pairs that no forest held, and the one they become.

    Such a pair is joined in its list by a path of the forest, whose steps between components are failed candidates: so components that these connect
    are a group, and no pair leaves its group. A group's texts are met again with their sets, each pair once, in blocks of two chunks of ``few``: a row
    for each chunk of the group, where their postings would be ``len(plan.positions)`` rows whatever the group's size. Groups in which chunks are more than that (of over
    ``most`` texts) go by their postings: without sets these tell who has a candidate across, and those alone are met again with their sets, in lists of ``few``."""
    fields = [f"f{k}" for k in range(plan.words)]
    named = classes.join(roots, classes["id"] == roots["node"], "left").select("id", *fields, F.coalesce("root", "id").alias("root"))
    end = lambda c: named.select(F.col("id").alias(c), F.col("root").alias(f"root_{c}"))
    failed = pairs.where(~F.col("ok")).join(end("a"), "a").join(end("b"), "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    groups = components(failed, "simhash-groups").select("node", F.col("root").alias("group"))
    rows = materialise(named.join(groups, named["root"] == groups["node"]).select("id", "root", "group", *fields), "simhash-touched")
    wide = materialise(rows.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > (most or len(plan.positions) * few)).select("group"), "simhash-wide")

    def runs(table, whole: bool):
        key = np.stack([np.asarray(table.column(c)) for c in (0, 1)], 1)
        edge = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
        ids, root = (np.asarray(table.column(c)) for c in (2, 3))
        v = np.stack([np.asarray(table.column(c)) for c in range(4, 4 + plan.words)], 1).view(np.uint64)
        part = np.asarray(table.column("part")) if whole else None
        for lo, hi in zip(np.r_[0, edge].tolist(), np.r_[edge, len(key)].tolist()):
            if hi - lo > 1 and (root[lo:hi] != root[lo]).any():
                code = int(key[lo, 0])
                yield code, lo, ids[lo:hi], root[lo:hi], _crossing(v[lo:hi], root[lo:hi], plan, *((None, part[lo:hi]) if whole else (code >> 8 * len(plan.positions[0]),)))

    def across(batches):
        for table in complete_runs(batches, 2):
            for code, _, ids, _, found in runs(table, False):
                some = ids[np.unique(found[:, 1:])]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), code), pa.int64()), pa.array(some, pa.int64())], names=["key", "id"])

    def settle(whole: bool):
        def run(batches):
            for table in complete_runs(batches, 2):
                sets = table.column("w")
                for _, lo, _, root, found in runs(table, whole):
                    into: dict[int, int] = {}

                    def find(i: int) -> int:
                        while (r := into.get(i, i)) != i:
                            into[i] = i = into.get(r, r)
                        return i

                    for _, i, j in found[found[:, 0].argsort(kind="stable")].tolist():
                        a, b = find(int(root[i])), find(int(root[j]))
                        if a != b and similar(*(np.frombuffer(sets[lo + k].as_buffer(), np.uint64) for k in (i, j)), plan.similarity):
                            into[a] = b
                    out = [(r, into[r]) for r in into if into[r] != r]
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in (0, 1)], names=["a", "b"])

        return run

    texts = materialise(rows.join(known, "id"), "simhash-touched-sets")
    post = texts.join(wide, "group", "left_anti").select(F.col("group").alias("key"), "id", "root", *fields, "w")
    more = _dealt(post, few, "simhash-long", part=True).mapInArrow(settle(True), "a long, b long")
    if wide.limit(1).count():
        post = _postings(rows.join(wide, "group", "left_semi"), plan, "root").select("key", "id", "root", *fields)
        met = materialise(_dealt(post, chunk, "simhash-long").mapInArrow(across, "key long, id long").distinct(), "simhash-across")
        again = met.join(texts, "id").select("key", "id", "root", *fields, "w")
        more = more.unionByName(_dealt(again, few, "simhash-long").mapInArrow(settle(False), "a long, b long"))
    return components(more, "simhash-more").select(F.col("node").alias("root"), F.col("root").alias("into"))


def classified(docs: DataFrame, width: int, plan: Plan, text: str, doc_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows ``(doc_id, h, f0, ..., id)``, classes ``(id, n, root)`` and components ``(root, classes, first)``; first is the row (doc_id, h) with the
    smallest doc_id, then the smallest text hash, one with a doc_id before one without."""
    names = [f"f{k}" for k in range(plan.words)]
    one = F.xxhash64(*names, "s") if plan.similarity else F.col("f0")  # a class's number
    rows = materialise(fingerprints(docs, width, plan, text, doc_id).withColumn("id", one), "simhash-rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("first")
    classes = materialise(rows.groupBy("id", *names).agg(first, F.count(F.lit(1)).alias("n")), "simhash-classes")
    found = links(classes, plan)
    if plan.similarity:
        pairs, known = verified(found, classes, docs, width, plan, text, doc_id)
        found = pairs.where("ok").select("a", "b")
    roots = components(found, "simhash-links")
    named = classes.join(roots, classes["id"] == roots["node"], "left").select("id", "n", "first", F.coalesce("root", "id").alias("root"))
    if plan.similarity:
        more = settled(pairs, known, classes, roots, plan)
        named = named.join(more, "root", "left").select("id", "n", "first", F.coalesce("into", "root").alias("root"))
    named = materialise(named, "simhash-named")
    return rows, named, named.groupBy("root").agg(F.count(F.lit(1)).alias("classes"), F.min("first").alias("first"))


def near_duplicates(docs: DataFrame, width: int = 5, plan: Plan = EXACT, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, fp, component_id)`` for each row; fp is the first fingerprint word, component_id the smallest doc_id reachable by links."""
    rows, named, smallest = classified(docs, width, plan, text, doc_id)
    smallest = materialise(smallest.select("root", "classes", F.col("first.doc_id").alias("component_id")), "simhash-components")
    final = materialise(join_hot(named.select("id", "n", "root"), smallest, "root", "classes").select("id", "n", "component_id"), "simhash-final")
    return join_hot(rows.select("doc_id", "f0", "id"), final, "id", "n").select("doc_id", F.col("f0").alias("fp"), "component_id")


def keep_first(docs: DataFrame, width: int = 5, plan: Plan = EXACT, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` with all their columns that stay, one of each component: the one with the smallest doc_id (a row without one
    stays only where the whole component has none), then with the smallest hash of its text, then the smallest in
    all its columns, in their order. Rows of one doc_id with texts that are no copies are documents of their own."""
    rows, _, smallest = classified(docs, width, plan, text, doc_id)
    first = materialise(smallest.select(F.col("first.doc_id").alias("first_id"), F.col("first.h").alias("first_h")), "simhash-first")
    same = rows.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("r_id"), F.col("h").alias("r_h"))
    again = lambda how: first.join(same, F.col("first_id").eqNullSafe(F.col("r_id")) & (F.col("first_h") == F.col("r_h")), how)
    repeated = materialise(again("left_semi"), "simhash-repeated")

    def of(keys: DataFrame) -> DataFrame:
        # the side of kept rows grows with the input: a shuffled join at every size
        keys = keys.hint("merge")
        return docs.join(keys, docs[doc_id].cast("long").eqNullSafe(keys["first_id"]) & (F.xxhash64(docs[text].cast("string")) == keys["first_h"]), "left_semi")

    if not repeated.limit(1).count():
        return of(first)
    row = F.struct(*(docs[c] for c in docs.columns))
    chosen = of(repeated).groupBy(docs[doc_id].alias("_id"), F.xxhash64(docs[text].cast("string")).alias("_h")).agg(F.min(row).alias("_row"))
    return of(again("left_anti")).unionByName(chosen.select("_row.*"))
