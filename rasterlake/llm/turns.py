"""Repair of conversation structure by a forward Viterbi search over a grammar of roles.

A conversation is right if the initials of its roles read ``(s?(ua)+)?``: nothing, or an optional system turn and then pairs of
user and assistant. Four states say what the grammar has seen: nothing, a system turn, a user turn, an assistant turn; nothing
and assistant may end it. Each turn is kept (cost 0), given another role (1) or deleted (2); an empty user or assistant turn
may be inserted anywhere (5). Blank turns and duplicates must be deleted; a truncated turn that stays costs 5 more. The repair is the
cheapest edit, ties going to the ASCII-least string of edit initials (the audit): K, R, D, I.

The search reads a conversation's turns in order and carries for every state the least (cost, audit). The audit is not carried
as text, whose copies would cost the square of a conversation's length, but as its rank among the audits of the four states and
a byte of where it came from. That is enough to compare: before a layer is closed by insertions (two in a row at most, as a third leads back), audits of
different states end in an edit of the same turn, so none is the start of another, and their order holds whatever follows.
An audit tells its repair, as from every state one role only can be inserted or given.

Rows are shuffled by conversation and sorted; the search and the repair are streams over them that hold four bytes a turn and the audit,
never the texts. A conversation is read in one task, because its order is its meaning; the repair shuffles the texts again, with
the audit before each conversation's turns.

Defined results: null ids, turns, roles and texts read as one space (so null text is blank); null turns come first; turns of
one number are in order of role, then text; repeated rows are duplicates; rows of null conv_id are one conversation with a null id;
conversations without turns have zeros and an empty audit; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rasterlake.llm._common import materialise

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Where a role's initial leads from each state.
KEPT = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: Where a role that can be chosen leads: user, but assistant after user.
CHOSEN = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: (state before, state after, insertions) of closing a layer.
CLOSING = [(p, p, 0) for p in range(4)] + [(p, CHOSEN[p], 1) for p in range(4)] + [(p, CHOSEN[CHOSEN[p]], 2) for p in (NOTHING, SYSTEM)]


def _moves(initial: str, must_delete: bool, truncated: bool) -> list[tuple[int, int, int, str]]:
    """(state before closing, state after the turn, cost, edits) of one turn of this kind."""
    out = []
    for p, s, k in CLOSING:
        out.append((p, s, INSERT * k + DELETE, "I" * k + "D"))
        if must_delete:
            continue
        more = INSERT * k + (TRUNCATED if truncated else 0)
        if s in KEPT.get(initial, {}):
            out.append((p, KEPT[initial][s], more + KEEP, "I" * k + "K"))
        out.append((p, CHOSEN[s], more + REROLE, "I" * k + "R"))
    return out


#: Edits of one turn, numbered.
EDITS = ["I" * k + e for k in range(3) for e in "DKR"]
KINDS = {(i, d, t): _moves(i, d, t) for i in ("s", "u", "a", "") for d in (False, True) for t in (False, True)}


class Search:
    """The search over one conversation: ``turn`` for each of its turns in order, then ``end``."""

    def __init__(self):
        self.best = [(0, 0), None, None, None]  # (cost, rank of the audit) of each state
        self.came = bytearray()  # for each turn and state: 9 x the state before + edits

    def turn(self, initial: str, must_delete: bool, truncated: bool) -> None:
        found: list = [None] * 4
        for p, s, cost, edits in KINDS[initial if initial in KEPT else "", must_delete, truncated]:
            if self.best[p]:
                made = (self.best[p][0] + cost, self.best[p][1], edits, p)
                if found[s] is None or made < found[s]:
                    found[s] = made
        order = sorted(f[1:3] for f in found if f)
        self.best = [f and (f[0], order.index(f[1:3])) for f in found]
        self.came += bytes(0 if f is None else 9 * f[3] + EDITS.index(f[2]) for f in found)

    def end(self) -> tuple[int, str]:
        """The least cost and its audit."""
        cost, _, last, state = min((self.best[p][0] + INSERT * k, self.best[p][1], "I" * k, p) for p, s, k in CLOSING if self.best[p] and s in (NOTHING, ASSISTANT))
        parts = [last]
        for at in range(len(self.came) - 4, -1, -4):
            state, edits = divmod(self.came[at + state], 9)
            parts.append(EDITS[edits])
        return cost, "".join(reversed(parts))


def applied(audit: str, turns):
    """``(edit, role, text)`` of the repaired turns, from an audit and the (role, text) of the turns as they come."""
    state, turns = NOTHING, iter(turns)
    for edit in audit:
        role, text = next(turns) if edit != "I" else ("", "")
        if edit == "D":
            continue
        state = KEPT[role[0]][state] if edit == "K" else CHOSEN[state]
        yield edit, role if edit == "K" else NAMES[state], text


def _text(column) -> F.Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with a fault in some, by the CRC-32 of ``conv_id:turn`` modulo 20, and ``copy``, which is null for dropped
    rows, else 0, or 1 for the second of a repeated row."""
    kind = F.pmod(F.crc32(F.concat(_text("conv_id"), F.lit(":"), _text("turn")).cast("binary")), F.lit(20))
    rows = rows.select("conv_id", "turn", _text("role").alias("role"), _text("text").alias("text"), kind.alias("kind"))
    copies = F.when(F.col("kind") == 0, F.array(F.lit(None).cast("int"))).when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


ORDER = ["conv_id", "turn", "role", "text", "copy"]


def reports(rows: DataFrame) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit)`` of each conversation of ``(conv_id, turn, role, text, copy)`` rows; a row
    without copy names its conversation only."""
    body = F.btrim("text", F.lit(" \t\n\x0b\x0c\r"))
    marked = rows.repartition("conv_id").select(
        *ORDER, F.substring("role", 1, 1).alias("initial"), (body == "").alias("blank"), (~F.substring(body, -1, 1).isin(".", "!", "?")).alias("open"),
        F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.col("copy").isNull(), "turn", "copy")).alias("seen"),
    )
    fields = marked.sortWithinPartitions(*ORDER, "seen").select("conv_id", "turn", "copy", "initial", "blank", "open", "seen")
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]

    def run(batches):
        now, out = None, []

        def close():
            conv_id, counts, turns, search, _ = now
            low, high, n = turns
            cost, audit = search.end()
            out.append((conv_id, high - low + 1 - n if n else 0, *counts, cost, audit))

        def full():
            done, out[:] = out[:], []
            return pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in done], schema)

        schema = None
        for batch in batches:
            schema = schema or pa.schema([("conv_id", batch.schema.field(0).type), *((c, pa.int64()) for c in names[1:-1]), ("audit", pa.string())])
            for conv_id, turn, copy, initial, blank, cut, seen in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now[0] != conv_id:
                    if now:
                        close()
                    now = [conv_id, [0, 0, 0, 0], (None, None, 0), Search(), None]
                if copy is None:
                    continue
                counts, (low, high, n), search, before = now[1:]
                if turn is not None and turn != high:
                    now[2] = (turn if low is None else low, turn, n + 1)  # turns come in order
                fault = 0 if blank else 1 if seen > 1 else 2 if cut else None
                if fault is not None:
                    counts[fault] += 1
                if before is not None and before + initial not in ("su", "ua", "au"):
                    counts[3] += 1
                now[4] = initial
                search.turn(initial, fault in (0, 1), fault == 2)
            if len(out) > 1000:
                yield full()
        if now:
            close()
            yield full()

    return fields.mapInArrow(run, f"conv_id {kind}, " + ", ".join(f"{c} long" for c in names[1:-1]) + ", audit string")


def repaired(rows: DataFrame, report: DataFrame) -> DataFrame:
    """``(conv_id, at, edit, role, text)``: the turns of each repaired conversation, in order and in one partition. One that has none left has
    one row with a null ``at``."""
    turns = rows.where(F.col("copy").isNotNull()).select(*ORDER, F.lit(1).alias("kind"))
    audits = report.select("conv_id", F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(0).alias("copy"), F.lit(0).alias("kind"))
    mixed = turns.unionByName(audits).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *ORDER[1:]).select("conv_id", "role", "text", "kind")

    def run(batches):
        kind = pa.int64()

        def rows_of():
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field(0).type
                yield from zip(*(c.to_pylist() for c in batch.columns))

        def conversations():
            source = rows_of()
            held = next(source, None)
            while held is not None:  # held is the row of an audit
                conv_id, _, audit, _ = held
                held = None

                def own():
                    nonlocal held
                    for row in source:
                        if row[3] == 0:
                            held = row
                            return
                        yield row[1], row[2]

                theirs = own()
                at = -1
                for at, (edit, role, text) in enumerate(applied(audit, theirs)):
                    yield conv_id, at, edit, role, text
                if at < 0:
                    yield conv_id, None, None, None, None
                for _ in theirs:  # none is left but for the next audit
                    raise ValueError("an audit is shorter than its conversation")

        part, size = [], 0
        for row in conversations():
            part.append(row)
            size += len(row[4] or "")
            if len(part) >= 1000 or size > 1 << 22:
                yield batch_of(part, kind)
                part, size = [], 0
        if part:
            yield batch_of(part, kind)

    def batch_of(part, kind):
        types = [kind, pa.int64(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), types)], names=["conv_id", "at", "edit", "role", "text"])

    return mixed.mapInArrow(run, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, at long, edit string, role string, text string")


def digests(turns: DataFrame) -> DataFrame:
    """``(conv_id, repaired_sha256)`` of repaired turns: SHA-256 of ``role:text`` joined by newlines, as a stream over ``repaired``'s order."""

    def run(batches):
        now, out, schema = None, [], None

        def full():
            done, out[:] = out[:], []
            return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], schema), pa.array([d[1].hexdigest() for d in done])], names=["conv_id", "repaired_sha256"])

        for batch in batches:
            schema = batch.schema.field(0).type
            for conv_id, at, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if not at:  # the first, or none
                    if now:
                        out.append(now)
                    now = (conv_id, hashlib.sha256())
                if at is not None:
                    now[1].update((("\n" if at else "") + f"{role}:{text}").encode())
            if len(out) > 1000:
                yield full()
        if now:
            out.append(now)
            yield full()

    return turns.select("conv_id", "at", "role", "text").mapInArrow(run, f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(reports, repaired turns)`` of conversations."""
    if "copy" not in rows.columns:
        rows = rows.select("conv_id", "turn", _text("role").alias("role"), _text("text").alias("text"), F.lit(0).alias("copy"))
    report = materialise(reports(rows), "turns-reports")
    return report, repaired(rows, report)


#: The search with whole audits as text, layer by layer; CRC-32 is a fold over bytes with the usual table of the reflected polynomial 0xEDB88320.
ORACLE = r"""
WITH RECURSIVE shifts AS (SELECT range AS byte, range AS c, 0 AS k FROM range(256)
  UNION ALL SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM shifts WHERE k < 8),
crc AS (SELECT list(c ORDER BY byte) AS step FROM shifts WHERE k = 8),
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))) AS h FROM conversations),
kinds AS (SELECT h, xor(list_reduce(list_transform(range(1, len(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT), lambda acc, b: xor(acc >> 8, step[(xor(acc, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 20 AS kind
  FROM (SELECT DISTINCT h FROM src), crc),
hurt AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(CASE kind WHEN 0 THEN []::INTEGER[] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM src JOIN kinds USING (h)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS before, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM hurt),
judged AS (SELECT *, left(role, 1) AS ini, CASE WHEN body = '' THEN 0 WHEN seen > 1 THEN 1 WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 2 ELSE 3 END AS fault FROM placed),
edges AS (SELECT unnest([0, 1, 2, 3]) AS s, NULL AS ini, 'D' AS op, 2 AS cost, unnest([0, 1, 2, 3]) AS s2
  UNION ALL SELECT unnest([0, 0, 1, 3, 2]), unnest(['s', 'u', 'u', 'u', 'a']), 'K', 0, unnest([1, 2, 2, 2, 3])
  UNION ALL SELECT unnest([0, 1, 2, 3]), NULL, 'R', 1, unnest([2, 2, 3, 2])),
closing AS (SELECT unnest([0, 1, 2, 3, 0, 1, 2, 3, 0, 1]) AS p, unnest([0, 1, 2, 3, 2, 2, 3, 2, 3, 3]) AS s, unnest([0, 0, 0, 0, 1, 1, 1, 1, 2, 2]) AS k),
convs AS (SELECT DISTINCT conv_id FROM src),
layers AS (SELECT conv_id, 0::BIGINT AS i, s, (5 * k)::BIGINT AS cost, repeat('I', k) AS audit FROM convs, closing WHERE p = 0
  UNION ALL SELECT conv_id, i + 1, s, best.cost, best.audit FROM (
    SELECT l.conv_id, l.i, c.s, min({'cost': (l.cost + e.cost + 5 * c.k + CASE WHEN j.fault = 2 AND e.op <> 'D' THEN 5 ELSE 0 END)::BIGINT, 'audit': l.audit || e.op || repeat('I', c.k)}) AS best
    FROM layers l JOIN judged j ON j.conv_id IS NOT DISTINCT FROM l.conv_id AND j.i = l.i + 1
    JOIN edges e ON e.s = l.s AND (e.ini IS NULL OR e.ini = j.ini) AND (e.op = 'D' OR j.fault >= 2) JOIN closing c ON c.p = e.s2 GROUP BY l.conv_id, l.i, c.s)),
stats AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 0) AS blank, count(*) FILTER (WHERE fault = 1) AS duplicate,
  count(*) FILTER (WHERE fault = 2) AS truncated, count(*) FILTER (WHERE before || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id),
ends AS (SELECT c.conv_id, s.gaps, s.blank, s.duplicate, s.truncated, s.illegal, min({'cost': l.cost, 'audit': l.audit}) AS best
  FROM convs c LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM c.conv_id JOIN layers l ON l.conv_id IS NOT DISTINCT FROM c.conv_id AND l.i = coalesce(s.n, 0) AND l.s IN (0, 3) GROUP BY ALL),
edits AS (SELECT conv_id, unnest(string_split(best.audit, '')) AS op, unnest(range(1, len(best.audit) + 1)) AS pos FROM ends WHERE best.audit <> ''),
used AS (SELECT *, count(*) FILTER (WHERE op <> 'I') OVER (PARTITION BY conv_id ORDER BY pos) AS i FROM edits),
stay AS (SELECT u.conv_id, u.op, u.pos, CASE WHEN u.op = 'I' THEN '' ELSE j.text END AS text, j.role, j.ini, row_number() OVER (PARTITION BY u.conv_id ORDER BY u.pos) AS nth
  FROM used u LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM u.conv_id AND j.i = u.i AND u.op <> 'I' WHERE u.op <> 'D'),
system AS (SELECT *, max(CASE WHEN nth = 1 AND op = 'K' AND ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS has FROM stay),
repaired AS (SELECT conv_id, string_agg(CASE WHEN op = 'K' THEN role WHEN (nth - has) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY pos) AS body FROM system GROUP BY conv_id)
SELECT e.conv_id, coalesce(e.gaps, 0) AS gaps, coalesce(e.blank, 0) AS blank, coalesce(e.duplicate, 0) AS duplicate, coalesce(e.truncated, 0) AS truncated, coalesce(e.illegal, 0) AS illegal,
  e.best.cost AS cost, e.best.audit AS audit, sha256(coalesce(r.body, '')) AS repaired_sha256
FROM ends e LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM e.conv_id
"""
