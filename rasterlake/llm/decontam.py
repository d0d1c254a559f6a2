"""Benchmark decontamination by template windows.

A text becomes words; numbers, units after numbers and capitalised words inside
sentences become typed placeholders. Windows of five canonical words are hash-joined
with those of the benchmark (a second hash of the plain lower-cased words keeps copies
whose letter case was changed). On each alignment of a document with an item, the
placeholders' values must be consistent: one value of the item always stands against
the same value in the document. Numbers are told apart by what they count, the word after them: in "5 loaves for 5 coins"
the two may change apart, in "12 apples ... 12 apples" they may not (whole-item windows and items under ten words tell no numbers apart). A value that stands against
two takes the template windows that hold it from its alignment, and no others: windows of the same plain words have no placeholders and always count. An item is
found in a document when at least ``least`` of its windows are, or of those of its windows
that can match as a template if these are at least half of all.

A capitalised word that opens a sentence may be a name or not: a window is emitted in both
readings, on either side. The reading as a name is optional: where its values are not consistent,
it does not count, but takes nothing from windows in which the value is read otherwise.

Items under five words, and items of which less than half of the windows can match as a template, are
hashed as one whole-item window, too (openers all plain, or all names; at least two plain words in a
template, at least three words in all). It stands for the whole item.

The windows of the benchmark are counted first. Up to ``most_windows`` their hashes are
sent to the tasks, which then emit matching windows only, and the join broadcasts them;
beyond that nothing is sent: all windows are emitted and Spark shuffles both sides.

Defined results: null and empty texts and items of one or two words have no windows and match nothing; rows with the same doc_id are one document; a null doc_id is a document of
its own id null; repeated benchmark items are one item; other columns are ignored; an
empty table on either side gives an empty result.
"""

from __future__ import annotations

import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlake.llm._common import materialise
from rasterlake.llm.simhash import mixed

WINDOW = 5
#: Fewer plain words than this, and a window of placeholders says too little.
LEAST_PLAIN = 3
#: The same for a window that is a whole item, and the words it has at least.
LEAST_PLAIN_WHOLE, LEAST_WHOLE = 2, 3
#: In shorter items equal numbers are not told apart by what they count: consistency is most of what shows them.
LEAST_ROLES = 10
UNITS = frozenset(
    "mm cm m km in inch inches ft feet yard yards mile miles mg g gram grams kg kilogram kilograms ton tons tonne tonnes lb lbs oz ml cl l liter liters litre litres "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years percent pct usd eur dollar dollars euro euros cent cents "
    "hz khz mhz ghz w kw kwh v a n j kj cal kcal pa bar kb mb gb tb c f k degree degrees mph kmh rpm".split()
)
_WORD = re.compile(r"\d+(?:[.,:/]\d+)*|[^\W\d_]+(?:['’][^\W\d_]+)*|[%€$£°]")
_MARKS = ".,;:!?"
_ENDS = re.compile(r"[.!?:;…][\"'”’)\]]*$")
NEWLINE = "⏎"
PLAIN, NUMBER, UNIT, CAPITAL, OPENER = 0, 1, 2, 3, 4
_HOLDER = {k: np.uint64(xxhash.xxh64_intdigest(f"\x00{k}")) for k in (NUMBER, UNIT, CAPITAL)}
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)


class Canon:
    """Words of chunks between white space, looked up once; the tables start anew when they get large."""

    def __init__(self, most: int = 300_000):
        self.most = most
        self.reset()

    def reset(self) -> None:
        self.chunk: dict[str, int] = {}
        self.word: dict[str, int] = {}
        self.surface: list[str] = []
        self.hash, self.kind, self.first, self.size, self.ends, self.flat = (array(code) for code in "QqqqBq")  # copied to NumPy as they are

    @staticmethod
    def _parts(chunk: str) -> tuple:
        """The words of a chunk; most chunks are one word, or one word and a mark."""
        if chunk.isalpha():
            return (chunk,)
        if chunk[-1] in _MARKS and chunk[:-1].isalpha():
            return (chunk[:-1],)
        return tuple(_WORD.findall(chunk)) if chunk != NEWLINE else ()

    def _learn(self, chunks: list[str]) -> None:
        """Add chunks that are not known, all at once."""
        parts = list(map(self._parts, chunks))
        flat = list(chain.from_iterable(parts))
        new = list(set(flat).difference(self.word))
        self.word.update(zip(new, range(len(self.surface), len(self.surface) + len(new))))
        low = [w.lower() for w in new]
        self.surface += low
        self.hash.extend(map(xxhash.xxh64_intdigest, low))
        self.kind.extend(
            [NUMBER if w[0].isdigit() else UNIT if k in UNITS or w in "%€$£°" else CAPITAL if len(w) > 1 and w[0].isupper() and not w.isupper() else PLAIN for w, k in zip(new, low)]
        )
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        self.first.frombytes((len(self.flat) + np.cumsum(size) - size).tobytes())
        self.size.frombytes(size.tobytes())
        self.ends.extend([not c[-1].isalpha() and (c == NEWLINE or _ENDS.search(c) is not None) for c in chunks])
        self.flat.extend(map(self.word.__getitem__, flat))
        self.chunk.update(zip(chunks, range(len(self.chunk), len(self.chunk) + len(chunks))))

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word numbers, kinds in context, words of each text)."""
        word, kind, sizes = self.read(texts)
        return word, np.where(kind == OPENER, PLAIN, kind), sizes

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same, with OPENER for capitalised words that open a sentence."""
        if len(self.chunk) > self.most:
            self.reset()
        split = [t.replace("\n", f" {NEWLINE} ").split() for t in texts]
        self._learn(list(set(chain.from_iterable(split)).difference(self.chunk)))
        chunks = np.fromiter(map(self.chunk.__getitem__, chain.from_iterable(split)), np.int64)
        of_text = np.repeat(np.arange(len(texts)), [len(words) for words in split])
        first, size, ends = np.array(self.first, np.int64), np.array(self.size, np.int64), np.array(self.ends, bool)
        n = size[chunks]
        total = int(n.sum())
        begin = np.cumsum(n) - n
        at = np.arange(total) - np.repeat(begin - first[chunks], n)
        word = np.array(self.flat, np.int64)[at] if total else np.zeros(0, np.int64)
        # the first word after a sentence's end, a new line or a text's start opens a sentence
        opens = np.zeros(total, bool)
        # chunks without words, as dashes, change nothing
        told = np.maximum.accumulate(np.concatenate([[-1], np.where((n > 0) | ends[chunks], np.arange(len(chunks)), -1)])[:-1]) if len(chunks) else chunks
        fresh = (told < np.searchsorted(of_text, of_text)) | ends[chunks[told]]
        opens[begin[fresh & (n > 0)]] = True
        text = np.repeat(of_text, n)
        kind = np.array(self.kind, np.int64)[word] if total else np.zeros(0, np.int64)
        before = np.concatenate([[PLAIN], np.where(text[1:] == text[:-1], kind[:-1], PLAIN)]) if total else kind
        kind = np.where((kind == UNIT) & (before != NUMBER), PLAIN, kind)
        kind = np.where((kind == CAPITAL) & opens, OPENER, kind)
        return word, kind, np.bincount(text, minlength=len(texts))

    def windows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, place in it, template hash, plain hash, word numbers, kinds) with openers read as plain; hash 0 stands for no window."""
        word, kind, sizes = self.read(texts)
        text, place, at, template, plain, _, _ = self.codes(word, kind, sizes)
        around = at[:, None] + np.arange(WINDOW)
        return text, place, template, plain, word[around], np.where(kind == OPENER, PLAIN, kind)[around]

    def codes(self, word: np.ndarray, kind: np.ndarray, sizes: np.ndarray):
        """(text, place in it, first word, template hash, plain hash) of all windows with openers read as plain, whether
        a window has a template hash in every reading, then [(windows, template hashes, places of openers read as names)] for each set of openers."""
        starts = np.cumsum(sizes) - sizes
        n = np.maximum(sizes - WINDOW + 1, 0)
        text = np.repeat(np.arange(len(sizes)), n)
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        at = starts[text] + place
        plain, held = self._values(word, kind)
        is_plain, opener = (kind == PLAIN) | (kind == OPENER), (kind == OPENER).astype(np.uint8)
        # windows of the whole batch side by side; those that cross texts are not taken
        every = max(len(word) - WINDOW + 1, 0)
        few, open_at = np.zeros(every, np.uint8), np.zeros(every, np.uint8)
        codes = [np.zeros(every, np.uint64), np.zeros(every, np.uint64)]
        for j in range(WINDOW):
            few += is_plain[j : j + every]
            open_at |= opener[j : j + every] << np.uint8(j)
            for c, v in zip(codes, (held, plain)):
                c += v[j : j + every]
                c *= _STEP
                c ^= c >> np.uint64(29)
        few, open_at, codes = few[at].astype(np.int64), open_at[at], [c[at] for c in codes]
        codes[0][few < LEAST_PLAIN] = 0
        readings = []
        some = np.flatnonzero((open_at > 0) & (few > LEAST_PLAIN))
        some_open, some_few = open_at[some], few[some]
        masks = np.flatnonzero(np.bincount(some_open, minlength=1 << WINDOW))
        for names in range(1, 1 << WINDOW):
            if not (masks & names == names).any():
                continue
            i = some[(some_open & names == names) & (some_few - names.bit_count() >= LEAST_PLAIN)]
            code = np.zeros(len(i), np.uint64)
            for j in range(WINDOW):
                code = (code + (_HOLDER[CAPITAL] if names >> j & 1 else held[at[i] + j])) * _STEP
                code ^= code >> np.uint64(29)
            readings.append((i, code, names))
        return text, place, at, codes[0], codes[1], few - np.bitwise_count(open_at) >= LEAST_PLAIN, readings

    def _values(self, word: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Plain and template value of each word, openers read as plain."""
        plain = np.array(self.hash, np.uint64)[word] if len(word) else np.zeros(0, np.uint64)
        held = plain.copy()
        for k, h in _HOLDER.items():
            held[kind == k] = h
        return plain, held

    def whole(self, word: np.ndarray, kind: np.ndarray, sizes: np.ndarray, lengths):
        """(first word, length, hash, reading) of all windows of the given lengths: plain, template, template with openers as names."""
        text_end = np.repeat(np.cumsum(sizes), sizes)
        plain, held = self._values(word, kind)
        named = np.where(kind == OPENER, _HOLDER[CAPITAL], held)
        sums = lambda mask: np.concatenate([[0], np.cumsum(mask)])
        # a polynomial over the window's values, the same whatever comes before it; _BASE is odd and so has an inverse
        power, back = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(word), x, np.uint64)])) for x in (_BASE, np.uint64(pow(int(_BASE), -1, 1 << 64))))
        totals = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(v * power[:-1])]) for v in (plain, held, named)]
        opener, holder = sums(kind == OPENER), sums((kind != PLAIN) & (kind != OPENER))
        for length in lengths:
            at = np.flatnonzero(np.arange(len(word)) + length <= text_end) if len(word) else np.zeros(0, np.int64)
            if length < LEAST_WHOLE or not len(at):
                continue
            n_open, n_held = opener[at + length] - opener[at], holder[at + length] - holder[at]
            for reading, (total, ok) in enumerate((
                (totals[0], n_open >= 0),
                (totals[1], (n_held > 0) & (length - n_held >= LEAST_PLAIN_WHOLE)),
                (totals[2], (n_open > 0) & (length - n_held - n_open >= LEAST_PLAIN_WHOLE)),
            )):
                i = at[ok]
                yield i, length, mixed((total[i + length] - total[i]) * back[i] + np.uint64(length), 1), reading


SCHEMA = "id long, size long, open long, place long, can boolean, whole long, code long, slots array<string>"


def windows(rows: DataFrame, wanted=None, lengths: tuple[int, ...] | None = None, roles: bool = False) -> DataFrame:
    """``(id, size, open, place, can, whole, code, slots)`` of ``(id, text)`` rows, for all windows or for those in the sorted hashes ``wanted``.

    size: windows of the text, open: those that can match as a template in every reading, can: whether this one does. whole: 0, or the words of a window
    that is a whole item; these have one of ``lengths``, or without lengths are whole texts that need one. slots: kind (O: an opener read as a name), place in the window and value of each placeholder, empty for plain hashes; with ``roles``, a number's value is followed by | and the word after it."""

    def run(batches):
        canon = Canon()
        if wanted is not None:
            known = wanted.value
            maybe = np.zeros(1 << 22, bool)
            maybe[known >> np.uint64(42)] = True

        def hits(ok, code):
            if wanted is None:
                return np.flatnonzero(ok)
            hit = np.flatnonzero(ok & maybe[code >> np.uint64(42)])
            at = np.searchsorted(known, code[hit])
            return hit[(at < len(known)) & (known[np.minimum(at, len(known) - 1)] == code[hit])] if len(known) else hit[:0]

        def role(word, kind, at):
            return f"|{canon.surface[word[at + 1]]}" if kind[at] == NUMBER and counted[at] and kind[at + 1] != NUMBER else ""

        def slots(word, kind, at, length, named, roles=roles):
            """Placeholders of the window at a word; ``named`` tells whether its opener at a place is one."""
            return [
                f"{'_NUCO'[kind[at + j]]}{j:05d}{canon.surface[word[at + j]]}{role(word, kind, at + j) if roles else ''}"
                for j in range(length)
                if kind[at + j] != PLAIN and (kind[at + j] != OPENER or named(j))
            ]

        for batch in batches:
            for lo in range(0, batch.num_rows, 400):
                part = batch.slice(lo, 400)
                ids, texts = part.column(0), [t or "" for t in part.column(1).to_pylist()]
                word, kind, n_words = canon.read(texts)
                counted = np.repeat(n_words >= LEAST_ROLES, n_words)  # whether a word can have a role: not the last of its text
                counted[(np.cumsum(n_words) - 1)[n_words > 0]] = False
                text, place, at, template, plain, can, readings = canon.codes(word, kind, n_words)
                sizes = np.bincount(text, minlength=len(texts))
                opens = np.bincount(text[can], minlength=len(texts))
                out = []  # (text, place, can match as a template, words of a whole item, hashes, slots)
                h = hits((template != 0) & (template != plain), template)  # without placeholders both are one
                out.append((text[h], place[h], can[h], 0, template[h], [slots(word, kind, at[i], WINDOW, lambda j: False) for i in h]))
                h = hits(plain != 0, plain)
                out.append((text[h], place[h], can[h], 0, plain[h], [[]] * len(h)))
                for i, code, names in readings:
                    h = hits(code != 0, code)
                    out.append((text[i[h]], place[i[h]], can[i[h]], 0, code[h], [slots(word, kind, at[k], WINDOW, lambda j: names >> j & 1) for k in i[h]]))
                begin = np.cumsum(n_words) - n_words
                own = np.flatnonzero((sizes == 0) | (2 * opens < sizes))  # items that need a whole window
                for i, length, code, reading in canon.whole(word, kind, n_words, np.unique(n_words[own]).tolist() if lengths is None else lengths):
                    of = np.searchsorted(np.cumsum(n_words), i, side="right")
                    h = hits(code != 0, code)
                    if lengths is None:
                        h = h[(n_words[of[h]] == length) & np.isin(of[h], own)]
                    out.append((of[h], (i - begin[of])[h], np.ones(len(h), bool), length, code[h], [slots(word, kind, k, length, lambda j: reading == 2, False) if reading else [] for k in i[h]]))
                texts_of = np.concatenate([o[0] for o in out])
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(texts_of)),
                        pa.array(sizes[texts_of], pa.int64()),
                        pa.array(opens[texts_of], pa.int64()),
                        pa.array(np.concatenate([o[1] for o in out]), pa.int64()),
                        pa.array(np.concatenate([o[2] for o in out]), pa.bool_()),
                        pa.array(np.repeat([o[3] for o in out], [len(o[0]) for o in out]), pa.int64()),
                        pa.array(np.concatenate([o[4] for o in out]).view(np.int64), pa.int64()),
                        pa.array([x for o in out for x in o[5]], pa.list_(pa.string())),
                    ],
                    names=["id", "size", "open", "place", "can", "whole", "code", "slots"],
                )

    return rows.mapInArrow(run, SCHEMA)


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, most_windows: int = 2_000_000, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """``(doc_id, item_id, n_windows, n_found, coverage, n_slots, n_changed, kind)`` for each item found in a document.

    n_windows are all windows of the item, or only those that can match as a template where that gives the higher coverage.
    kind is ``reparameterised`` if a placeholder's value differs from the item's, else ``verbatim``."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    asked = materialise(windows(items, roles=True).dropDuplicates(["id", "place", "whole", "code"]), "decontam-items")
    n = asked.count()
    lengths = tuple(sorted(r["whole"] for r in asked.where("whole > 0").select("whole").distinct().collect()))
    wanted = None
    if n <= most_windows:
        codes = np.unique(asked.select("code").distinct().toArrow().column("code").to_numpy().view(np.uint64))  # 8 bytes each, at most most_windows
        wanted = spark.sparkContext.broadcast(codes)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    got = windows(rows, wanted, lengths).select(F.col("id").alias("doc_id"), F.col("place").alias("doc_place"), "whole", "code", F.col("slots").alias("doc_slots"))
    side = asked.select(F.col("id").alias("item_id"), F.col("size").alias("n_windows"), F.col("open").alias("n_open"), F.col("place").alias("item_place"), "can", "whole", "code", F.col("slots").alias("item_slots"))
    pairs = got.join(F.broadcast(side) if wanted is not None else side, ["code", "whole"]).withColumn("shift", F.col("doc_place") - F.col("item_place"))
    pairs = materialise(pairs.select("doc_id", "item_id", "n_windows", "n_open", "item_place", "can", "whole", "shift", "doc_slots", "item_slots"), "decontam-pairs")
    # one value of the item stands against one value of the document on an alignment; names that open a sentence and whole items are optional there
    name = lambda c: F.concat(F.translate(F.substring(c, 1, 1), "O", "C"), F.substring(c, 7, 1 << 20))
    opener = lambda s: s["item_slots"].startswith("O") | s["doc_slots"].startswith("O")
    both = pairs.where(F.size("item_slots") > 0).select("doc_id", "item_id", "shift", "item_place", "whole", F.explode(F.arrays_zip("item_slots", "doc_slots")).alias("s"))
    place = F.col("item_place") + F.substring("s.item_slots", 2, 5).cast("long")
    slots = both.groupBy("doc_id", "item_id", "shift", place.alias("at"), name(F.col("s.item_slots")).alias("a"), name(F.col("s.doc_slots")).alias("b")).agg(
        F.min(opener(F.col("s")) | (F.col("whole") > 0)).alias("optional"), F.min(opener(F.col("s"))).alias("opener")
    )
    changed = F.substring_index("a", "|", 1) != F.col("b")
    counts = (~F.col("opener") | changed).cast("long")
    judged = slots.groupBy("doc_id", "item_id", "shift", "a").agg(
        F.count_distinct(F.when(~F.col("optional"), F.col("b"))).alias("values"), F.count_distinct("b").alias("every"),
        *(F.sum(F.when(of, n_of).otherwise(0)).alias(f"{tag}_{k}") for tag, of in (("must", ~F.col("optional")), ("may", F.col("optional"))) for k, n_of in (("places", counts), ("changed", changed.cast("long")))),
    )
    # must: values stand apart without the optional ones, which takes all windows of the value; may: only with them, which takes the optional ones
    must, may = F.col("values") > 1, F.col("every") > 1
    summed = lambda k: F.sum(F.when(must, 0).otherwise(F.col(f"must_{k}")) + F.when(may, 0).otherwise(F.col(f"may_{k}")))
    judged = judged.groupBy(F.col("doc_id").alias("j_doc"), F.col("item_id").alias("j_item"), F.col("shift").alias("j_shift")).agg(
        F.collect_set(F.when(must, F.col("a"))).alias("torn"), F.collect_set(F.when(may, F.col("a"))).alias("torn_optional"), summed("places").alias("n_slots"), summed("changed").alias("n_changed")
    )
    keys = [F.col("doc_id").eqNullSafe(F.col("j_doc")), F.col("item_id").eqNullSafe(F.col("j_item")), F.col("shift") == F.col("j_shift")]
    optional = lambda s: opener(s) | (F.col("whole") > 0)
    torn = F.exists(F.arrays_zip("item_slots", "doc_slots"), lambda s: F.array_contains("torn", name(s["item_slots"])) | (optional(s) & F.array_contains("torn_optional", name(s["item_slots"]))))
    found = pairs.join(judged, keys, "left").where(~F.coalesce(torn, F.lit(False)))
    at_least = lambda of: F.collect_set(F.when(of, F.col("item_place")))
    by_shift = found.groupBy("doc_id", "item_id", "shift").agg(
        F.max("n_windows").alias("n_windows"), F.max("n_open").alias("n_open"), F.max("whole").alias("whole"),
        at_least(F.col("whole") == 0).alias("places"), at_least((F.col("whole") == 0) & F.col("can")).alias("open_places"), F.max("n_slots").alias("n_slots"), F.max("n_changed").alias("n_changed"),
    )
    best = F.max(F.struct((F.col("whole") > 0).alias("whole"), F.size("places").alias("n"), "n_slots", "n_changed"))
    union = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c)))).cast("long")
    whole = by_shift.groupBy("doc_id", "item_id").agg(
        F.greatest(F.max("n_windows"), F.lit(1)).alias("n_all"), F.max("n_open").alias("n_open"), F.max("whole").alias("whole"), union("places").alias("found_all"), union("open_places").alias("found_open"),
        F.coalesce(best.getField("n_slots"), F.lit(0)).alias("n_slots"), F.coalesce(best.getField("n_changed"), F.lit(0)).alias("n_changed"),
    )
    by_open = (2 * F.col("n_open") >= F.col("n_all")) & (F.col("found_open") * F.col("n_all") > F.col("found_all") * F.col("n_open"))
    whole = whole.withColumn("n_windows", F.when((F.col("whole") == 0) & by_open, F.col("n_open")).otherwise(F.col("n_all")))
    whole = whole.withColumn("n_found", F.when(F.col("whole") > 0, F.col("n_all")).when(by_open, F.col("found_open")).otherwise(F.col("found_all")))
    whole = whole.withColumn("coverage", F.col("n_found") / F.col("n_windows")).where(F.col("coverage") >= least)
    return whole.select("doc_id", "item_id", "n_windows", "n_found", "coverage", "n_slots", "n_changed", F.when(F.col("n_changed") > 0, "reparameterised").otherwise("verbatim").alias("kind"))


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` in which no item was found, with all their columns. Rows with a null id stay unless a null-id row leaks."""
    found = leaks(docs, benchmark, doc_id=doc_id, **options).select(F.col("doc_id").alias("leaking")).distinct()
    return docs.join(found, docs[doc_id].eqNullSafe(found["leaking"]), "left_anti")
