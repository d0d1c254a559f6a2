"""Toxicity from a weighted lexicon matched by Aho-Corasick.

Texts are folded first: lower case, accents and look-alike letters to plain Latin,
digits (and @ $ ! | between letters) to the letters they stand for, invisible characters
out, everything else to spaces. One automaton holds the lexicon (whole words, and stems
that start a word) and the exception phrases; a hit inside an exception phrase does
not count. The weights of the hits are summed and normalised by text length, and a
logistic map turns both into the score.

The lexicon is learnt from at most ``max_toxic`` toxic and ``max_clean`` clean labelled
documents (documented bounds, drawn by a hash of doc_id; they bound everything that fitting holds). A term's support is the number
of different words it follows in toxic documents, so that groups of copies do not make
ordinary words look toxic; a term needs a support of an eighth of the toxic documents of the sample, at least 5 and at most 12.
Its weight is its log-odds against clean documents, at least ``min_weight``. Exception phrases are learnt, too: two neighbouring
words, one of them hit by a term, that stand in at least ``min_clean`` clean documents and, by share, less than half as often in toxic ones.

Defined results: null, empty and blank texts have no hits and get the score of a text
without hits; repeated rows each get their row; null labels are not learnt from; other
columns are ignored; an empty table gives an empty result; without labelled rows of
both classes only ``SEED_LEXICON`` is matched.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlake.llm._common import bucket_of, materialise

#: Letters of other scripts that look like Latin ones; accents come from Unicode's own decompositions.
LOOK_ALIKES = dict(zip("авсԁеһіјкӏмнорѕтухѵαβεικνορτυχɑıƖ", "abcdehijklmhopstuxvabeikvoptuxail"))
DIGITS = dict(zip("0134578", "oieastb"))
BETWEEN = dict(zip("@$!|", "asil"))
INVISIBLE = [0xAD, *range(0x200B, 0x2010), *range(0x2060, 0x2065), 0xFEFF, *range(0x300, 0x370)]
#: English insults that are matched even if no labels are there.
SEED_LEXICON = {"idiot": 3.0, "moron": 3.0, "stupid": 2.0, "scum": 3.0, "pathetic": 2.0, "worthless": 2.0, "disgusting": 2.0}


def _fold_table() -> dict[int, str | None]:
    table: dict[int, str | None] = {}
    for c in [*range(0xA0, 0x530), *range(0x1E00, 0x2000), *range(0x2000, 0x2100), *range(0x2460, 0x2500), *range(0x3000, 0x3040), *range(0xFF00, 0xFF66)]:
        base = unicodedata.normalize("NFKD", chr(c)).lower()
        base = "".join(x for x in base if not unicodedata.combining(x))
        base = LOOK_ALIKES.get(base, base)
        if len(base) == 1 and base.isalnum():
            table[c] = DIGITS.get(base, base if base.isalpha() else " ")
        elif not chr(c).isalpha():
            table[c] = " "
    table |= {ord(a): b for a, b in LOOK_ALIKES.items()} | {ord("ß"): "s", ord("æ"): "a", ord("œ"): "o", ord("ø"): "o"}
    table |= {c: " " for c in range(128) if not chr(c).isalpha()} | {ord(a): b for a, b in DIGITS.items()}
    return table | {c: None for c in INVISIBLE}


_TABLE = _fold_table()
_LEET = re.compile(r"(?<=\w)[@$!|](?=\w)")


def fold(text: str) -> str:
    """Folded text with a space at either end; words are runs without spaces."""
    text = text.lower()
    if _LEET.search(text):
        text = _LEET.sub(lambda m: BETWEEN[m[0]], text)
    return f" {text.translate(_TABLE)} "


@dataclass
class Lexicon:
    """terms: pattern -> weight; a pattern begins with a space, and ends with one if it is a whole word."""

    terms: dict[str, float]
    exceptions: tuple[str, ...] = ()
    coef: tuple[float, float, float] = (1.5, 0.5, -3.0)
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    def hits(self, folded: str) -> list[tuple[int, str, float]]:
        """(place, pattern, weight): the heaviest hit at each place that no exception phrase covers."""
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for t, w in self.terms.items():
                self._automaton.add_word(t, (t, w))
            for e in self.exceptions:
                self._automaton.add_word(e, (e, None))
            self._automaton.make_automaton()
        if not len(self._automaton):
            return []
        best: dict[int, tuple[str, float]] = {}
        spared: list[tuple[int, int]] = []
        for end, (pattern, weight) in self._automaton.iter(folded):
            start = end - len(pattern) + 1
            if weight is None:
                spared.append((start, end))
            elif start not in best or weight > best[start][1]:
                best[start] = (pattern, weight)
        out, k, reach = [], 0, -1
        spared.sort()
        for start in sorted(best):
            while k < len(spared) and spared[k][0] <= start:
                reach, k = max(reach, spared[k][1]), k + 1
            if start + len(best[start][0]) - 1 > reach:
                out.append((start, *best[start]))
        return out

    def features(self, texts: list[str | None]) -> np.ndarray:
        """(log of the summed weight, log of the weight per 1000 characters, hits) of each text."""
        out = np.zeros((len(texts), 3))
        for k, t in enumerate(texts):
            if t and (got := self.hits(folded := fold(t))):
                total = sum(h[2] for h in got)
                out[k] = np.log1p(total), np.log1p(1000 * total / len(folded)), len(got)
        return out

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features[:, :2] @ self.coef[:2] + self.coef[2], -30, 30)))

    def phrases(self, text: str) -> set[str]:
        """The pairs of neighbouring words of which one is hit."""
        folded, out = fold(text), set()
        for start, _, _ in self.hits(folded):
            end = folded.find(" ", start + 1)
            before, after = folded[max(0, start - 60) : start].rsplit(None, 1)[-1:], folded[end : end + 60].split(None, 1)[:1]
            word = folded[start + 1 : end]
            out |= {f" {b} {word} " for b in before} | {f" {word} {a} " for a in after}
        return out


def _terms(word: str) -> list[str]:
    return [f" {word} ", *(f" {word[:k]}" for k in (4, 5, 6) if len(word) > k)]


def _toxic_terms(batches):
    """(term, crc of the word before it), once for each partition."""
    seen: set[tuple[str, int]] = set()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            words = fold(text).split()
            seen.update((t, zlib.crc32(a.encode())) for a, w in zip(["", *words], words) if len(w) > 3 for t in _terms(w))
            if len(seen) > 300_000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*seen)], names=["term", "before"])
                seen.clear()
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*seen)], names=["term", "before"])


def learn(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held: int = 0,
    max_toxic: int = 1500, max_clean: int = 6000, min_support: tuple[int, int] = (5, 12), min_weight: float = 3.0, min_clean: int = 3,
) -> Lexicon:
    """Learn weights from labelled rows outside the held-out fold."""
    known = labels.where(F.col(label).isin(0, 1)).select(F.col("doc_id").alias("id"), F.col(label).alias("y")).where(bucket_of("id", folds) != held)
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    seed = {f" {w} ": x for w, x in SEED_LEXICON.items()}
    if len(counts) < 2:
        return Lexicon(seed)
    drawn = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(n) for y, n in ((1, max_toxic), (0, max_clean))]
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text")).where("text is not null")
    sample = materialise(rows.join(F.broadcast(drawn[0].unionByName(drawn[1])), "id").select("text", F.col("y").cast("int").alias("y")), "toxicity-sample")
    toxic, clean = sample.where("y = 1").select("text"), sample.where("y = 0").select("text")
    support = toxic.mapInArrow(_toxic_terms, "term string, before long").groupBy("term").agg(F.count_distinct("before").alias("support"))
    low, high = min_support  # 12, but fewer where there are under 100 toxic documents
    needed = max(low, min(high, min(counts[1], max_toxic) // 8))
    candidates = support.where(F.col("support") >= needed).collect()  # a ``needed``-th of the terms of max_toxic documents at most
    chosen = {r["term"]: r["support"] for r in candidates}

    def with_term(batches):
        n = Counter()
        for batch in batches:
            for text, y in zip(*(c.to_pylist() for c in batch.columns)):
                n.update((t, y) for t in {t for w in set(fold(text).split()) for t in _terms(w) if t in chosen})
        rows = [(t, y, k) for (t, y), k in n.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int64()))], names=["term", "y", "n"])

    found = sample.select("text", "y").mapInArrow(with_term, "term string, y int, n long").groupBy("term").agg(F.sum(F.expr("if(y = 1, n, 0)")).alias("a"), F.sum(F.expr("if(y = 0, n, 0)")).alias("b"))
    size = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    weight = F.log((F.col("a") + 0.5) / (n1 + 1)) - F.log((F.col("b") + 0.5) / (n0 + 1))
    best = found.withColumn("w", weight).where(F.col("w") >= min_weight).orderBy("term").collect()
    lexicon = Lexicon(seed | {r["term"]: float(r["w"]) for r in best})

    def around(batches):
        n = Counter()
        for batch in batches:
            for text, y in zip(*(c.to_pylist() for c in batch.columns)):
                n.update((p, y) for p in lexicon.phrases(text))
        rows = [(p, y, k) for (p, y), k in n.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int64()))], names=["phrase", "y", "n"])

    pairs = sample.select("text", "y").mapInArrow(around, "phrase string, y int, n long").groupBy("phrase").agg(F.sum(F.expr("if(y = 0, n, 0)")).alias("b"), F.sum(F.expr("if(y = 1, n, 0)")).alias("a"))
    harmless = pairs.where((F.col("b") >= min_clean) & (2 * F.col("a") * (n0 + 1) < F.col("b") * (n1 + 1))).orderBy("phrase").collect()  # bounded by the clean sample
    lexicon.exceptions = tuple(r["phrase"] for r in harmless)
    lexicon._automaton = None

    def measured(batches):
        for batch in batches:
            x = lexicon.features(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), batch.column(1)], names=["x0", "x1", "y"])

    got = np.array([tuple(r) for r in sample.select("text", "y").mapInArrow(measured, "x0 double, x1 double, y int").collect()], float)  # max_toxic + max_clean rows at most
    from rasterlake.llm.lines_crf import _logistic

    y = got[:, 2]
    w = np.where(y == 1, counts[1] / max(n1, 1), counts[0] / max(n0, 1))
    lexicon.coef = tuple(float(c) for c in _logistic(np.c_[got[:, :2], np.ones(len(got))], y, w * len(y) / w.sum(), 0.1))
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, score, n_hits)`` for each row; n_hits are the hits that no exception phrase covers."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                x = lexicon.features(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lexicon.scores(x)), pa.array(x[:, 2].astype(np.int64))], names=["doc_id", "score", "n_hits"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, n_hits long")
