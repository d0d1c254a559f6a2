"""Personal data with offset-preserving deobfuscation.

Base spans come from four fixed patterns on the text itself. Then small transducers
rewrite what is disguised (look-alike characters and digits of other scripts, digits
spelled in words, "at" and "dot" in words or brackets, invisible characters) and keep
for each character of the rewritten text the source characters it stands for. The same
patterns run on the rewritten text; spans map back through that table. A found span is
added if a transducer changed something in it and it overlaps no base span.

Only the neighbourhood of a disguise is rewritten, so a whole text is scanned by plain
searches and costs linear time. A neighbourhood reaches at least ``REACH`` characters to either side and from there on to
a place that no pattern can cross, however far that is: spans never depend on where a text is cut.

Defined results: null and empty texts have no spans; offsets are code points of the
source, end exclusive; repeated rows each get their row; a null doc_id stays null; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only begin at the start of a run of digits: one that fails there fails at the run's other digits too.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """All leftmost, non-overlapping matches of EMAIL, found from the @ signs in linear time."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := EMAIL.match(text, start)):
            out.append(m.span())
            end = m.end()
        at = text.find("@", max(at + 1, end))
        end = max(end, 0) if at < 0 else max(end, text.rfind("@", end, at) + 1)
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind on the text as it stands; failing matches are dropped, not retried."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = emails(text)
    if not re.search("[0-9]", text):
        return out
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out["ip"].append(m.span())
    for m in CARD.finditer(text):
        d = _digits(m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out["card"].append(m.span())
    if "+" in text:
        out["phone"] = [m.span() for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


#: Digits in words, in the languages of the corpus.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
LOOK_ALIKES = dict(zip("авсԁеһіјкӏмнорѕтухАВСЕНІЈКМОРЅТХαοερυＡ", "abcdehijklmhopstyxABCEHIJKMOPSTXaoepuA"))
#: Characters that look like @ . + - without having them as Unicode decomposition.
SIGNS = dict(zip("。․‧∙‐‑‒–—−⁃", "....-------"))
INVISIBLE = "​‌‍⁠﻿­"

_WORD = "|".join(sorted(SPELLED, key=len, reverse=True))
#: Runs of spelled digits, each after white space, a hyphen, a comma or a dot, or a single one after a numeral.
_SPELLED_RUN = re.compile(rf"(?<!\w)(?:plus[ \t]{{1,3}})?(?:{_WORD})(?:[ \t,.-]{{1,3}}(?:{_WORD}|dot|point|punkt|punto|plus|dash|[0-9]{{1,3}}))+(?!\w)|(?<=[0-9)][ \t,.-])(?:{_WORD})(?!\w)", re.I)
_SPELLED_ONE = re.compile(rf"(?<!\w)(?:({_WORD})|(dot|point|punkt|punto)|(plus)|(dash))(?!\w)", re.I)
_SPELLED_SET = frozenset(SPELLED)
_GAP = re.compile(r"[ \t,-]{1,3}(?=[0-9])")
_OPEN, _CLOSE = r"[ \t]{0,2}[\[({<]{1,2}[ \t]{0,2}", r"[ \t]{0,2}[\])}>]{1,2}[ \t]{0,2}"
_AT = rf"{_OPEN}(?:at|ät|arroba|@){_CLOSE}|[ \t]{{1,3}}(?:at|arroba)[ \t]{{1,3}}|[ \t]{{1,2}}@[ \t]{{0,2}}|@[ \t]{{1,2}}|[_-](?:at)[_-]|@"
_DOT = rf"{_OPEN}(?:dot|punkt|point|punto|\.){_CLOSE}|[ \t]{{1,3}}(?:dot|punkt|punto)[ \t]{{1,3}}|[_-](?:dot)[_-]|\."
_NAME = r"[A-Za-z0-9-]+"
#: An address whose @ or dots may be disguised; its last name has letters only.
_ADDRESS = re.compile(rf"(?<![A-Za-z0-9._%+-])([A-Za-z0-9_%+-]+(?:(?:{_DOT})[A-Za-z0-9_%+-]+){{0,3}}?)({_AT})({_NAME}(?:(?:{_DOT}){_NAME}){{1,5}})", re.I)
_DOT_ONE = re.compile(_DOT, re.I)
_DOT_WORD = re.compile(r"(?:dot|punkt|punto|point)|[\[({<][ \t]{0,2}\.", re.I)
#: Dotted numbers whose dots are disguised.
_QUAD = re.compile(rf"(?<![0-9.])[0-9]{{1,3}}(?:(?:{_DOT})[0-9]{{1,3}}){{3}}(?![0-9])", re.I)


def _sign_table() -> dict[int, str]:
    table = {ord(a): b for a, b in LOOK_ALIKES.items()} | {ord(a): b for a, b in SIGNS.items()}
    spans = ((0x660, 0x66A), (0x6F0, 0x6FA), (0x966, 0x970), (0xFF01, 0xFF5F), (0x2070, 0x208A), (0x2460, 0x2469), (0x1D400, 0x1D800), (0xFE52, 0xFE70))
    for lo, hi in spans:
        for c in range(lo, hi):
            base = unicodedata.normalize("NFKD", chr(c))
            digit = unicodedata.digit(chr(c), None)
            if digit is not None:
                table[c] = str(digit)
            elif len(base) == 1 and " " < base < "\x7f":
                table[c] = base
    return table


_SIGNS = _sign_table()
#: The same characters as two sets: one set over both planes would be searched member by member.
_ODD = re.compile("[" + re.escape("".join(chr(c) for c in sorted(_SIGNS) if c < 0x10000)) + INVISIBLE + "]")
_ODD_BEYOND = re.compile("[\U0001d400-\U0001d7ff]")


def _odd(text: str) -> list[tuple[int, int]]:
    """Places of characters that are read as another one or as none."""
    if text.isascii():
        return []
    try:
        text.encode("latin-1")
        return [m.span() for m in re.finditer("\u00ad", text)]
    except UnicodeEncodeError:
        return sorted([m.span() for m in _ODD.finditer(text)] + [m.span() for m in _ODD_BEYOND.finditer(text)])


class Rewritten:
    """A rewritten text with the source range of every character; each step composes with the ones before."""

    def __init__(self, text: str, start: int = 0):
        self.text, self.lo, self.hi = text, list(range(start, start + len(text))), list(range(start + 1, start + len(text) + 1))

    def replace(self, edits: list[tuple[int, int, str]]) -> Rewritten:
        """Non-overlapping (start, end, new text) in order; new characters all stand for the whole replaced range."""
        text, lo, hi, at = [], [], [], 0
        for s, e, new in edits:
            text += (self.text[at:s], new)
            lo += self.lo[at:s] + [self.lo[s]] * len(new)
            hi += self.hi[at:s] + [self.hi[e - 1]] * len(new)
            at = e
        self.text, self.lo, self.hi = "".join(text) + self.text[at:], lo + self.lo[at:], hi + self.hi[at:]
        return self

    def source(self, start: int, end: int) -> tuple[int, int]:
        return self.lo[start], self.hi[end - 1]


def _look_alikes(r: Rewritten) -> Rewritten:
    return r.replace([(a, b, _SIGNS.get(ord(r.text[a]), "" if r.text[a] in INVISIBLE else r.text[a])) for a, b in _odd(r.text)])


def _lettered(r: Rewritten) -> Rewritten:
    edits = []
    for m in _LETTERED.finditer(r.text):
        edits += [(k, k + 1, "0" if r.text[k] in "Oo" else "1") for k in range(m.start(), m.end()) if r.text[k] in "OoIl"]
    return r.replace(edits)


def _spelled(r: Rewritten) -> Rewritten:
    """Spelled digits become digits; what stands between two of them goes, a spelled dot, plus or dash becomes its sign."""
    edits = []
    for run in _SPELLED_RUN.finditer(r.text):
        last = None
        for m in _SPELLED_ONE.finditer(r.text, run.start(), run.end()):
            if last is not None and last < m.start() and not r.text[last : m.start()].strip(" \t,.-"):
                edits.append((last, m.start(), ""))
            new = SPELLED[m[1].lower()] if m[1] else "." if m[2] else "+" if m[3] else "-"
            edits.append((m.start(), m.end(), new))
            last = m.end()
            if m[2] and (gap := _GAP.match(r.text, last)):  # "dot 10"
                edits.append((last, gap.end(), ""))
                last = None
    return r.replace(edits)


def _at_and_dot(r: Rewritten) -> Rewritten:
    edits = []
    for m in _ADDRESS.finditer(r.text):
        plain_at = m[2] == "@"
        words = _DOT_WORD.search(m[1] + " " + m[3])
        bracket_at = any(c in m[2] for c in "[({<_-")
        ending = _ENDING.search(m[3])
        spaced_at = m[2].strip(" \t") == "@" and ending
        if plain_at and not words:
            continue
        # "x at y.z" with nothing else disguised reads as prose, unless x looks like the name in an address
        if not (bracket_at or words or spaced_at or _TLD.match(r.text, m.start(2)) or (ending and _MARKED.match(m[1]))):
            continue
        edits += [(d.start(), d.end(), ".") for d in _DOT_ONE.finditer(r.text, m.start(1), m.end(1)) if d[0] != "."]
        edits.append((m.start(2), m.end(2), "@"))
        edits += [(d.start(), d.end(), ".") for d in _DOT_ONE.finditer(r.text, m.start(3), m.end(3)) if d[0] != "."]
    r.replace([e for e in edits if e[1] > e[0]])
    return r.replace([(d.start(), d.end(), ".") for m in _QUAD.finditer(r.text) for d in _DOT_ONE.finditer(r.text, m.start(), m.end()) if d[0] != "."])


_BRACKET = re.compile(r"[\[({<]{1,2}[ \t]{0,2}(?:at|ät|arroba|@|dot|punkt|point|punto|\.)[ \t]{0,2}[\])}>]", re.I)
_DOTS = frozenset(("dot", "punkt", "punto", "arroba"))
_TLD = re.compile(r"(?<=[A-Za-z0-9])[ \t]{1,3}at[ \t]{1,3}(?=[A-Za-z0-9-]{1,64}(?:\.[A-Za-z0-9-]{1,64}){0,4}\.(?:com|org|net|edu|gov|info|io|de|fr|es|eu|uk|(?:ac|co|com|edu|gov|ne|net|or|org)\.[a-z]{2})(?![A-Za-z0-9.-]))", re.I)
#: A dotted quad with letters for 0 and 1.
_LETTERED = re.compile(r"(?<![\w.])(?=[0-9.]*[OoIl])(?=[OoIl.]*[0-9])[0-9OoIl]{1,3}(?:\.[0-9OoIl]{1,3}){3}(?![\w]|\.[\w])")
_LETTER_AND_DOT = re.compile(r"[OoIl]\.[0-9OoIl]|\.[OoIl]+[0-9]")
_RUN_OF_TWO = re.compile(rf"(?<!\w)(?:{_WORD})[ \t,.-]{{1,3}}(?:{_WORD})(?!\w)", re.I)
_DOT_ALONE = re.compile(r"(?<!\w)(?:dot|punkt|punto|arroba)(?!\w)", re.I)
_JOINED = re.compile(r"[_-](?:at|dot)[_-]", re.I)
#: A last name of letters only, and a name that hardly is a word of prose: a dot, digit or underscore after a letter.
_ENDING = re.compile(r"\.[A-Za-z]{2,}$")
_MARKED = re.compile(r"[A-Za-z][A-Za-z%+-]*[._0-9]")
_AT_WORD = re.compile(r"[ \t][aA][tT][ \t]")
_NAME_AFTER = re.compile(r"[ \t]{1,3}(?=[A-Za-z0-9-]{1,64}\.[A-Za-z0-9-])")
_AT_SPACED = re.compile(r"(?<=[A-Za-z0-9_%+-])(?:[ \t]{1,2}@[ \t]{0,2}|@[ \t]{1,2})(?=[A-Za-z0-9-]{1,64}\.[A-Za-z0-9-])")
_BEFORE_NUMERAL = re.compile(rf"(?<!\w)(?:{_WORD})[ \t,.()-]{{1,3}}[0-9]", re.I)
_ONE_SPELLED = re.compile(rf"(?:{_WORD})(?!\w)", re.I)
_DOT_IN_NUMERAL = re.compile(r"\.[0-9OoIl]")
_NUMERAL = re.compile("[0-9]")
REACH = 120
#: White space that a pattern may cross: between the signs of a number.
_NUMERIC = frozenset("0123456789().+-")


def _edge(text: str, at: int, step: int) -> int:
    """The first place from ``at`` on in a direction where no match of a pattern can pass: white space that does not
    stand between signs of numbers."""
    while 0 < at < len(text):
        here, there = text[at - 1], text[at]
        if here.isspace() or there.isspace():
            lo, hi = at, at
            while lo > 0 and text[lo - 1].isspace():
                lo -= 1
            while hi < len(text) and text[hi].isspace():
                hi += 1
            if lo == 0 or hi == len(text) or text[lo - 1] not in _NUMERIC or text[hi] not in _NUMERIC:
                return at
            at = lo if step < 0 else hi
        at += step
    return at


def _places(text: str, low: str, words) -> list[int]:
    """Where one of the words stands, also inside others."""
    if len(low) != len(text):  # lower-casing moved something
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    out = []
    for w in words:
        at = low.find(w)
        while at >= 0:
            out.append(at)
            at = low.find(w, at + 1)
    return out


def _spelled_sites(text: str, places: list[int]) -> list[tuple[int, int]]:
    """Spelled digits beside another one or beside a numeral; patterns are tried at these places only."""
    out = []
    for at in places:
        m = _RUN_OF_TWO.match(text, at) or _BEFORE_NUMERAL.match(text, at)
        if m:
            out.append(m.span())
        lo = at
        while at - lo < 3 and lo > 0 and text[lo - 1] in " \t,.()-":
            lo -= 1
        if 0 < lo < at and text[lo - 1] in "0123456789" and (m := _ONE_SPELLED.match(text, at)):
            out.append((lo, m.end()))
    return out


def _sites(text: str) -> list[tuple[int, int]]:
    """Places where something may be disguised. Plain word and substring tests come first, patterns only where these hit."""
    out, low = [], text.lower()
    words = low.replace("-", " ").replace(",", " ").replace(".", " ").split()
    if not _SPELLED_SET.isdisjoint(words):
        out += _spelled_sites(text, _places(text, low, _SPELLED_SET.intersection(words)))
    if "dot" in low or "pun" in low or "arroba" in low:
        out += [m.span() for at in _places(text, low, _DOTS) if (m := _DOT_ALONE.match(text, at))]
    if "[" in low or "(" in low or "{" in low or "<" in low:
        out += [m.span() for m in _BRACKET.finditer(text)]
    if "_at_" in low or "-at-" in low or "_dot_" in low or "-dot-" in low:
        out += [m.span() for m in _JOINED.finditer(text)]
    if " at " in low or "\tat" in low or "at\t" in low:
        for m in _AT_WORD.finditer(text):
            lo = m.start()
            while m.start() - lo < 2 and lo > 0 and text[lo - 1] in " \t":
                lo -= 1
            if lo > 0 and text[lo - 1] in LOCAL and text[lo - 1] != "." and (name := _NAME_AFTER.match(text, m.end() - 1)):
                out.append((lo, name.end()))
    if " @" in low or "@ " in low or "\t@" in low or "@\t" in low:
        out += [m.span() for m in _AT_SPACED.finditer(text)]
    if "." in text and _DOT_IN_NUMERAL.search(text) and _NUMERAL.search(text) and _LETTER_AND_DOT.search(text):
        out += [m.span() for m in _LETTERED.finditer(text)]
    return sorted(out + _odd(text))


def found_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans that only the rewritten text shows."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    blocks: list[list[int]] = []
    for s, e in _sites(text):  # neighbourhoods that meet are one block
        if blocks and s - REACH <= blocks[-1][1]:
            if e + REACH > blocks[-1][1]:
                blocks[-1][1] = _edge(text, min(len(text), e + REACH), 1)
            continue
        s, e = _edge(text, max(0, s - REACH), -1), _edge(text, min(len(text), e + REACH), 1)
        if blocks and s <= blocks[-1][1]:
            blocks[-1][1] = max(blocks[-1][1], e)
        else:
            blocks.append([s, e])
    for s, e in blocks:
        r = _at_and_dot(_spelled(_lettered(_look_alikes(Rewritten(text[s:e], s)))))
        for kind, spans in base_spans(r.text).items():
            for a, b in spans:
                lo, hi = r.source(a, b)
                if text[lo:hi] != r.text[a:b]:
                    out[kind].append((lo, hi))
    return out


def spans(text: str | None) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """(base spans, all spans) by kind, sorted by start; added spans overlap no other span."""
    base = base_spans(text or "")
    every = {k: list(v) for k, v in base.items()}
    extra = sorted((lo, hi, k) for k, v in found_spans(text).items() for lo, hi in v) if text else []
    if extra:
        taken: list[list[int]] = []  # union of the base spans
        for lo, hi in sorted(s for v in base.values() for s in v):
            if taken and lo < taken[-1][1]:
                taken[-1][1] = max(taken[-1][1], hi)
            else:
                taken.append([lo, hi])
        end = 0
        for lo, hi, kind in extra:
            k = bisect.bisect_left(taken, [hi]) - 1  # the last one that starts before hi
            if lo >= end and (k < 0 or taken[k][1] <= lo):
                every[kind].append((lo, hi))
                end = hi
        every = {k: sorted(v) for k, v in every.items()}
    return base, every


def listed(found: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in found[k])


def detect(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)`` for each row; counts are of the base spans."""
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                got = [spans(t) for t in part.column(1).to_pylist()]
                cols = [part.column(0), *(pa.array([len(b[k]) for b, _ in got], pa.int64()) for k in KINDS)]
                cols += [pa.array([hashlib.sha256(listed(b).encode()).hexdigest() for b, _ in got]), pa.array([listed(e) for _, e in got], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def masked(text: str) -> str:
    """The text with every span replaced by its kind in brackets."""
    out, at = [], 0
    for lo, hi, kind in sorted((s, e, k) for k, v in spans(text)[1].items() for s, e in v):
        if hi <= at:
            continue
        out += (text[at:max(at, lo)], f"[{kind.upper()}]")
        at = hi
    return "".join(out) + text[at:] if out else text


def redact(docs: DataFrame, text: str = "text", size: str | None = "n_chars") -> DataFrame:
    """All rows and columns of ``docs`` with the spans masked; the column ``size`` is brought up to date if it is there."""
    k = docs.columns.index(text)
    n = docs.columns.index(size) if size in docs.columns else None

    def run(batches):
        for batch in batches:
            texts = [t if t is None else masked(t) for t in batch.column(k).to_pylist()]
            cols = list(batch.columns)
            if n is not None:
                old = cols[n].to_pylist()
                cols[n] = pa.array([v if t is None or v is None else len(t) for t, v in zip(texts, old)], batch.schema.field(n).type)
            cols[k] = pa.array(texts, batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
