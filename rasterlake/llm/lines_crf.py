"""Document quality from a linear-chain conditional random field over lines.

Every line gets the label good or bad from features of itself and of its neighbours;
forward-backward marginals of "good", weighted by line length, aggregate into the
document's score. Line features come from byte-class counts of the Arrow buffer.

Fitting uses at most ``max_docs`` labelled documents of each class, and of one with more than
``max_lines`` lines a run of that many (documented bounds; rows are drawn by a hash of doc_id, runs by their
text's size; scores always take all lines).
Documents carry labels, lines do not: all lines of a good document count as good; of a
bad one those that a line-wise logistic model finds worse than even, and its worst line
in any case. The last step is a logistic map from the aggregate to the score.

Defined results: null, empty and blank texts are one empty line and get a score like
any other; repeated rows each get their row; null labels are not learnt from; other
columns are ignored; an empty table gives an empty result; without labelled rows of
both classes every score is the share of good labels (0.5 if there are none).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlake.llm._common import bucket_of, row_groups, text_bytes

#: Byte classes whose shares are line features.
CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "space": b" \t\r\v\f",
    "stop": b".,;:?'\"()-",
    "shout": b"!",
    "bar": b"|",
    "mark": b"*#$%&@~^+=<>{}[]\\/_`",
}
NAMES = [*CLASSES, "lead", "tail"]  # lead, tail: first and other bytes of non-ASCII characters
_CLASS = np.full(256, len(NAMES), np.int64)
for _k, _bytes in enumerate(CLASSES.values()):
    _CLASS[np.frombuffer(_bytes, np.uint8)] = _k
_CLASS[0xC0:], _CLASS[0x80:0xC0] = len(CLASSES), len(CLASSES) + 1
N_OWN, N_NEAR = 17, 7
#: Odd multipliers for the hash of a word, by place in it; longer words repeat them.
_MULT = np.random.default_rng(7).integers(1, 1 << 62, 64).astype(np.uint64) | np.uint64(1)
N_FEATURES = N_OWN + 2 * N_NEAR + 2


def echoes(data: np.ndarray, cls: np.ndarray, line_of: np.ndarray, n: int) -> np.ndarray:
    """How many words of each line equal the word before them in the line."""
    inside = (cls != 3) & (data != 10)
    cut = np.concatenate([[True], ~inside[:-1] | (line_of[1:] != line_of[:-1])]) if len(data) else inside  # documents touch
    begin = np.flatnonzero(inside & cut)
    if not len(begin):
        return np.zeros(n)
    own_begin = np.concatenate([np.zeros(begin[0], np.int64), np.repeat(begin, np.diff(np.concatenate([begin, [len(data)]])))])
    place = np.arange(len(data)) - own_begin
    value = np.where(inside, (data.astype(np.uint64) + np.uint64(1)) * _MULT[place % 64], np.uint64(0))
    code = np.add.reduceat(value, begin)
    same = (code[1:] == code[:-1]) & (line_of[begin[1:]] == line_of[begin[:-1]])
    return np.bincount(line_of[begin[1:]][same], minlength=n).astype(np.float64)


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of some documents, characters of each line, and lines of each document."""
    n_docs, newline = len(offsets) - 1, np.flatnonzero(data == 10)
    # a document's first line starts at its offset, the others after a newline
    start = np.sort(np.concatenate([offsets[:-1], newline + 1]))
    is_doc = np.zeros(len(start), bool)
    doc_of_newline = np.searchsorted(offsets, newline, side="right") - 1
    lines = np.bincount(doc_of_newline, minlength=n_docs) + 1
    first = np.concatenate([[0], np.cumsum(lines)])[:-1]
    is_doc[first] = True
    # equal offsets (empty documents, newline at a document's end) sort in any order: starts are equal too
    n = len(start)
    line_of = np.cumsum(np.bincount(start, minlength=len(data) + 1)[: len(data)]) - 1
    w = len(NAMES) + 1
    body = data != 10
    cls = _CLASS[data]
    counts = np.bincount(line_of[body] * w + cls[body], minlength=n * w).reshape(n, w).astype(np.float64)
    size = counts.sum(1)
    chars = size - counts[:, NAMES.index("tail")]
    some = np.maximum(size, 1)
    share = counts / some[:, None]
    letters = np.maximum(counts[:, 0] + counts[:, 1] + counts[:, len(CLASSES)], 1)
    words = counts[:, 3] + 1
    end = np.zeros(n, np.int64)
    stop = start + size.astype(np.int64)
    full = size > 0
    end[full] = data[stop[full] - 1]
    begin = np.zeros(n, np.int64)
    begin[full] = data[start[full]]
    echo = echoes(data, cls, line_of, n) / words
    own = np.c_[
        share[:, : len(NAMES) + 1],
        counts[:, 1] / letters,
        echo,
        np.minimum(chars / words, 40) / 10,
        np.log1p(chars) / 5,
        np.isin(end, np.frombuffer(b".?!", np.uint8)),
        (begin >= 65) & (begin <= 90),
    ]
    near = np.c_[share[:, 1], share[:, NAMES.index("shout")], share[:, NAMES.index("bar")], share[:, NAMES.index("mark")], counts[:, 1] / letters, own[:, -3], echo]
    last = np.concatenate([first[1:], [n]]) - 1
    prev, nxt = np.vstack([np.zeros((1, N_NEAR)), near[:-1]]), np.vstack([near[1:], np.zeros((1, N_NEAR))])
    prev[first], nxt[last] = 0, 0
    edge = np.zeros(n)
    edge[first] += 1
    edge[last] += 1
    return np.c_[own, prev, nxt, edge, np.ones(n)], chars, lines


def padded(x: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents, longest, ...) with a mask."""
    mask = np.arange(lines.max())[None] < lines[:, None]
    out = np.zeros((*mask.shape, *x.shape[1:]))
    out[mask] = x
    return out, mask


def marginals(good: np.ndarray, mask: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward for two labels. good: log-odds of good per line; move: 2 x 2 log-weights.
    Returns marginals of good, expected moves per document summed to 2 x 2, and log Z per document."""
    d, t = good.shape
    e = np.stack([np.exp(-np.maximum(good, 0)), np.exp(np.minimum(good, 0))], -1)  # bad, good; scaled
    a, b = np.zeros((d, t, 2)), np.ones((d, t, 2))
    m, log_z = np.exp(move), np.zeros(d)
    for k in range(t):
        now = e[:, k] if k == 0 else (a[:, k - 1] @ m) * e[:, k]
        s = now.sum(-1)
        a[:, k] = np.where(mask[:, k, None], now / s[:, None], a[:, k - 1] if k else now)
        log_z += np.where(mask[:, k], np.log(s) + np.maximum(good[:, k], 0), 0)
    for k in range(t - 2, -1, -1):
        now = (b[:, k + 1] * e[:, k + 1]) @ m.T
        b[:, k] = np.where(mask[:, k + 1, None], now / now.sum(-1, keepdims=True), 1.0)
    p = a * b
    p = p[..., 1] / p.sum(-1)
    pair = a[:, :-1, :, None] * m * (e[:, 1:] * b[:, 1:])[:, :, None, :]
    pair = pair / np.maximum(pair.sum((-1, -2), keepdims=True), 1e-300)
    return p, (pair * mask[:, 1:, None, None]).sum((0, 1)), log_z


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    move: np.ndarray
    slope: float
    shift: float
    prior: float

    def aggregate(self, x: np.ndarray, chars: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """Length-weighted marginal of good per document, as log-odds."""
        good = ((x - self.mean) / self.scale) @ self.weight
        first, out = np.concatenate([[0], np.cumsum(lines)]), np.zeros(len(lines))
        order = np.argsort(lines, kind="stable")
        lo = 0
        while lo < len(order):  # documents with like numbers of lines go together
            longest = max(8, 2 * int(lines[order[lo]]))
            hi = int(np.searchsorted(lines[order], longest, side="right"))
            hi = max(lo + 1, min(hi, lo + max(1, 200_000 // longest)))
            part = order[lo:hi]
            take = np.concatenate([np.arange(first[i], first[i + 1]) for i in part])
            g, mask = padded(good[take], lines[part])
            p = marginals(g, mask, self.move)[0]
            c = padded(chars[take] + 1, lines[part])[0]
            out[part] = (p * c * mask).sum(1) / (c * mask).sum(1)
            lo = hi
        out = np.clip(out, 1e-6, 1 - 1e-6)
        return np.log(out / (1 - out))

    def score(self, x, chars, lines) -> np.ndarray:
        if not len(self.weight):
            return np.full(len(lines), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.aggregate(x, chars, lines) + self.shift, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float, rounds: int = 25) -> np.ndarray:
    """Newton's method."""
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (w * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + ridge * np.eye(len(b))
        step = np.linalg.solve(h, x.T @ (w * (y - p)) - ridge * b)
        b += step
        if np.abs(step).max() < 1e-6:
            break
    return b


def fit(x: np.ndarray, chars: np.ndarray, lines: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 100) -> Model:
    """x: raw line features of all documents one after the other; y: 1 for good documents; weight: of each document."""
    prior = float((weight * y).sum() / weight.sum()) if len(y) else 0.5
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(0), np.ones(0), np.zeros(0), np.zeros((2, 2)), 1.0, 0.0, prior)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    mean[-1], scale[-1] = 0, 1
    z = (x - mean) / scale
    doc = np.repeat(np.arange(len(lines)), lines)
    # lines that stand for their document's label
    share = chars + 1
    w = share / np.bincount(doc, share)[doc]
    b = _logistic(z, y[doc].astype(float), w * weight[doc], ridge)
    odds = z @ b
    worst = np.full(len(lines), np.inf)
    np.minimum.at(worst, doc, odds)
    label = np.where(y[doc] == 1, 1, ((odds > 0) & (odds > worst[doc])).astype(int))
    b = _logistic(z, label.astype(float), np.ones(len(z)), ridge)
    # conditional likelihood of the chains, by gradient steps with momentum (Adam)
    zs, mask = padded(z, lines)
    ls = padded(label.astype(float), lines)[0]
    true_x = np.einsum("dtf,dt->f", zs, ls)
    hard = ls.astype(int)
    seen = np.zeros((2, 2))
    both = mask[:, 1:]
    np.add.at(seen, (hard[:, :-1][both], hard[:, 1:][both]), 1.0)
    theta = np.concatenate([b, np.zeros(4)])
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    n = len(lines)
    for k in range(1, rounds + 1):
        p, moves, _ = marginals(zs @ theta[:-4], mask, theta[-4:].reshape(2, 2))
        grad = np.concatenate([true_x - np.einsum("dtf,dt->f", zs, p * mask), (seen - moves).ravel()]) / n - ridge * theta / n
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        theta += 0.05 * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.99**k)) + 1e-8)
    model = Model(mean, scale, theta[:-4], theta[-4:].reshape(2, 2), 1.0, 0.0, prior)
    g = model.aggregate(x, chars, lines)
    c = _logistic(np.c_[g, np.ones(n)], y.astype(float), weight, 0.1)
    model.slope, model.shift = float(c[0]), float(c[1])
    return model


def _sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, max_docs: int, max_lines: int) -> list:
    """At most max_docs rows per class as (y, rows of that class, line features, characters)."""
    known = labels.where(F.col(label).isin(0, 1)).select(F.col("doc_id").alias("id"), F.col(label).alias("y")).where(bucket_of("id", folds) != held)
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(max_docs) for y in sorted(counts)]
    if not picked:
        return []
    chosen = picked[0] if len(picked) == 1 else picked[0].unionByName(picked[1])
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "id")  # 2 * max_docs rows at most

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            got = {"y": [], "lines": [], "x": [], "chars": []}
            for lo, hi in row_groups(offsets, 2000, 1 << 21):
                x, chars, lines = line_features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                first = np.concatenate([[0], np.cumsum(lines)])
                for i in range(hi - lo):
                    # a run of lines of a long document, its place told by the document's size
                    n = min(int(lines[i]), max_lines)
                    at = first[i] + int(offsets[lo + i + 1] - offsets[lo + i]) % (int(lines[i]) - n + 1)
                    got["y"].append(batch.column(1)[lo + i].as_py())
                    got["lines"].append(n)
                    got["x"].append(x[at : at + n].astype(np.float32).tobytes())
                    got["chars"].append(chars[at : at + n].astype(np.float32).tobytes())
            kinds = {"y": pa.int32(), "lines": pa.int32(), "x": pa.binary(), "chars": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array(got[k], t) for k, t in kinds.items()], names=list(kinds))

    fitted = rows.select("text", F.col("y").cast("int").alias("y")).mapInArrow(run, "y int, lines int, x binary, chars binary").orderBy(F.xxhash64("x"), "x").limit(2 * max_docs).collect()
    return [(r["y"], counts[r["y"]], r["lines"], r["x"], r["chars"]) for r in fitted]


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held: int = 0, max_docs: int = 1500, max_lines: int = 60) -> Model:
    """Fit on labelled rows outside the held-out fold (crc32(doc_id as text) mod folds == held)."""
    got = _sample(docs, labels, label, folds, held, max_docs, max_lines)
    if not got:
        return fit(np.zeros((0, N_FEATURES)), np.zeros(0), np.zeros(0, int), np.zeros(0), np.zeros(0))
    y = np.array([g[0] for g in got])
    size = {k: (y == k).sum() for k in (0, 1)}
    weight = np.array([g[1] / size[g[0]] for g in got])
    weight *= len(y) / weight.sum()
    x = np.concatenate([np.frombuffer(g[3], np.float32).reshape(-1, N_FEATURES) for g in got]).astype(np.float64)
    chars = np.concatenate([np.frombuffer(g[4], np.float32) for g in got]).astype(np.float64)
    return fit(x, chars, np.array([g[2] for g in got]), y, weight)


def scores(model: Model, texts: pa.Array) -> np.ndarray:
    """Scores of whole texts, in groups of bounded size."""
    data, offsets = text_bytes(texts)
    out = np.zeros(len(texts))
    for lo, hi in row_groups(offsets, 4000, 1 << 21):
        out[lo:hi] = model.score(*line_features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]))
    return out


def score(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, score)`` for each row."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(model, batch.column(1)), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def keep(docs: DataFrame, model: Model, at_least: float, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with all their columns whose score reaches ``at_least``; a stream over batches, no join."""
    k = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(scores(model, batch.column(k)) >= at_least))

    return docs.mapInArrow(run, docs.schema)
