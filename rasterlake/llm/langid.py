"""Language identification by nearest centroid.

A text is a vector of hashed byte trigrams (ASCII letters lowered, runs of other ASCII
bytes as spaces), weighted by TF-IDF and normalised. Each language has several
centroids from spherical k-means; the nearest one by cosine names the language.
Distance-based rejection: texts that are farther from their centroid than all but
a small share of what its language was learnt from keep the nearest language's name, but their score falls with the
distance, from half at the rejecting distance to 0 at a cosine of 0.

Fitting uses about ``max_docs`` labelled documents in all, dealt evenly over the
languages (documented bound, drawn by a 64-bit hash of doc_id and text, so that the share is exact at any number of rows and rows
without a doc_id are drawn like others; equal rows count once).

Defined results: a null text, or one without any letter, is ``und`` with score 0;
repeated rows each get their row; rows with null lang are not learnt from; other columns
are ignored; an empty table gives an empty result; without learnt languages all are ``und``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlake.llm._common import bucket_of, row_groups, text_bytes

UNKNOWN = "und"
DIM = 4096
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[:128] = 32
_LOWER[65:91] = _LOWER[97:123] = np.arange(97, 123)


def counts(data: np.ndarray, offsets: np.ndarray, dim: int = DIM) -> np.ndarray:
    """(texts, dim) trigram counts; long texts go through in slices."""
    n = len(offsets) - 1
    out = np.zeros((n, dim), np.float32)
    for lo in range(0, len(data), 1 << 20):
        b = _LOWER[data[lo : lo + (1 << 20) + 2]]
        if len(b) < 3:
            continue
        code = (b[:-2] << 16) + (b[1:-1] << 8) + b[2:]
        word = (b[:-2] != 32) | (b[1:-1] != 32)
        text = np.searchsorted(offsets, np.arange(lo, lo + len(code)), side="right") - 1
        inside = word & (np.arange(lo + 2, lo + 2 + len(code)) < offsets[text + 1])
        slot = ((code * np.uint32(2654435761)) >> np.uint32(32 - dim.bit_length() + 1)).astype(np.int64)
        out += np.bincount(text[inside] * dim + slot[inside], minlength=n * dim).reshape(n, dim)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # (centroids, dim), unit length
    lang_of: np.ndarray  # language of each centroid
    least: np.ndarray  # smallest accepted cosine of each centroid

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether the distance rejects it."""
        data, offsets = text_bytes(texts)
        lang, score, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        if not self.langs:
            return lang, score, rejected
        for lo, hi in row_groups(offsets, 256, 1 << 20):
            part = data[offsets[lo] : offsets[hi]]
            ends = offsets[lo : hi + 1] - offsets[lo]
            cos = _unit(np.log1p(counts(part, ends, len(self.idf))) * self.idf) @ self.centroids.T
            per = np.stack([cos[:, self.lang_of == k].max(1) for k in range(len(self.langs))], 1)
            near, best = cos.argmax(1), per.argmax(1)
            soft = np.exp(30 * (per - per.max(1, keepdims=True)))
            soft = soft.max(1) / soft.sum(1)
            ascii_letter = ((part | 32) >= 97) & ((part | 32) <= 122)
            seen = np.concatenate([[0], np.cumsum(ascii_letter)])
            has = seen[ends[1:]] > seen[ends[:-1]]
            for i in range(hi - lo):
                if has[i] or (ends[i] < ends[i + 1] and any(c.isalpha() for c in texts[lo + i].as_py())):
                    far = cos[i, near[i]] < self.least[near[i]]
                    close = 0.5 * max(0.0, cos[i, near[i]]) / max(self.least[near[i]], 1e-9) if far else 1.0
                    lang[lo + i], score[lo + i], rejected[lo + i] = self.langs[best[i]], soft[i] * close, far
        return lang, score, rejected


def _clusters(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from farthest-first seeds."""
    seeds = [0]
    far = x @ x[0]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(far.argmin()))
        far = np.maximum(far, x @ x[seeds[-1]])
    c = x[seeds]
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        c = np.stack([_unit(x[own == j].sum(0)) if (own == j).any() else c[j] for j in range(len(c))])
    return c


def fit(x: np.ndarray, lang: list[str], per_lang: int = 4, reject: float = 0.001) -> Model:
    langs = sorted(set(lang))
    if not langs:
        return Model([], np.ones(DIM), np.zeros((0, DIM)), np.zeros(0, int), np.zeros(0))
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 1
    z, own = _unit(np.log1p(x) * idf), np.array([langs.index(v) for v in lang])
    groups = [_clusters(z[own == k], per_lang) for k in range(len(langs))]
    centroids = np.concatenate(groups)
    lang_of = np.repeat(np.arange(len(langs)), [len(g) for g in groups])
    least = np.zeros(len(centroids))
    for k in range(len(langs)):
        cos = z[own == k] @ centroids[lang_of == k].T
        least[lang_of == k] = np.quantile(cos.max(1), reject)
    return Model(langs, idf.astype(np.float32), centroids.astype(np.float32), lang_of, least)


def shares(sizes: dict[str, int], max_docs: int) -> list[tuple[str, int]]:
    """For each language the largest signed 64-bit hash that is drawn, for about max_docs documents in all."""
    each = max(1, max_docs // len(sizes))
    return [(k, min(2**63 - 1, each * 2**64 // n - 2**63)) for k, n in sorted(sizes.items())]


def train(docs: DataFrame, folds: int = 4, held: int = 2, max_docs: int = 2400, text: str = "text", lang: str = "lang") -> Model:
    """Fit on rows with a lang outside the held-out fold (crc32(doc_id as text) mod folds == held)."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).where(F.coalesce(bucket_of("doc_id", folds), F.lit(-1)) != held)
    known = known.select(F.col("doc_id").alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    if not sizes:
        return fit(np.zeros((0, DIM)), [])
    cut = docs.sparkSession.createDataFrame(shares(sizes, max_docs), "lang string, cut long")
    drawn = known.withColumn("h", F.xxhash64("id", "text")).join(F.broadcast(cut), "lang").where(F.col("h") <= F.col("cut"))
    drawn = drawn.groupBy("lang", "h").agg(F.first("text").alias("text")).select("lang", "text")

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for lo, hi in row_groups(offsets, 256, 1 << 20):
                x = counts(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([v.tobytes() for v in x], pa.binary())], names=["lang", "x"])

    got = drawn.mapInArrow(run, "lang string, x binary").orderBy(F.xxhash64("x"), "x").limit(2 * max_docs).collect()
    return fit(np.stack([np.frombuffer(r["x"], np.float32) for r in got]) if got else np.zeros((0, DIM)), [r["lang"] for r in got])


def identify(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, lang_pred, score, rejected)`` for each row; lang_pred stays the nearest language where rejected is true."""

    def run(batches):
        for batch in batches:
            lang, score, rejected = model.predict(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
