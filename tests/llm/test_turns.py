"""Conversation repair against a search over all edits."""

import hashlib
import heapq
import random
import re
import zlib

import duckdb
import pytest

from rasterlake.llm import turns

GRAMMAR = re.compile(r"(s?(ua)+)?")


def cheapest(rows):
    """Least (cost, audit, repaired) by best-first search over whole edit strings and repaired roles, the grammar checked at the end only.

    ``rows``: (initial, must_delete, truncated)."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, roles = heapq.heappop(heap)
        if i == len(rows) and GRAMMAR.fullmatch(roles):
            return cost, audit, roles
        if (i, roles) in done or not re.fullmatch(r"s?(ua)*u?", roles):
            continue  # the first to come here with these roles had the least cost and audit
        done.add((i, roles))
        for r in "ua":
            heapq.heappush(heap, (cost + 5, audit + "I", i, roles + r))
        if i < len(rows):
            initial, must, cut = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, roles))
            if not must:
                heapq.heappush(heap, (cost + 5 * cut, audit + "K", i + 1, roles + (initial or "?")))
                for r in "ua":
                    heapq.heappush(heap, (cost + 1 + 5 * cut, audit + "R", i + 1, roles + r))


def test_search_is_the_cheapest_and_ascii_least():
    rng = random.Random(3)
    for _ in range(400):
        rows = [(rng.choice("suaux"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(0, 6))]
        search = turns.Search()
        for row in rows:
            search.turn(*row)
        cost, audit, roles = cheapest(rows)
        assert search.end() == (cost, audit), rows
        names = {"s": "system", "u": "user", "a": "assistant", "x": "x"}
        fixed = list(turns.applied(audit, [(names[r], "t") for r, _, _ in rows]))
        assert "".join(role[0] for _, role, _ in fixed) == roles


def slow(rows):
    """Everything op11 returns, for rows of (conv_id, turn, role, text), one conversation at a time."""
    text = lambda v: " " if v is None else str(v)
    by = {}
    for conv, turn, role, said in rows:
        own = by.setdefault(conv, [])
        kind = zlib.crc32(f"{text(conv)}:{text(turn)}".encode()) % 20
        role, said = text(role), text(said)
        said = {1: "", 2: re.sub("[.!?]", "", said)}.get(kind, said)
        own += [(turn, "user" if kind == 4 else role, said)] * {0: 0, 3: 2}.get(kind, 1)
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, kinds, counts = set(), [], [0, 0, 0]
        for _, role, said in own:
            body = said.strip(" \t\n\x0b\x0c\r")
            fault = 0 if not body else 1 if (role, said) in seen else 2 if body[-1] not in ".!?" else None
            seen.add((role, said))
            if fault is not None:
                counts[fault] += 1
            kinds.append((role[:1], fault in (0, 1), fault == 2))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:]))
        numbers = {t for t, _, _ in own if t is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        cost, audit, roles = cheapest(kinds)
        out, left = [], iter(own)
        at = iter(roles)
        for edit in audit:
            row = next(left) if edit != "I" else None
            if edit != "D":
                r = next(at)
                out.append((row[1] if edit == "K" else {"u": "user", "a": "assistant"}[r]) + ":" + (row[2] if row else ""))
        yield conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def result(spark, rows):
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    report, fixed = turns.repair(turns.damaged(docs))
    digest = {r["conv_id"]: r["repaired_sha256"] for r in turns.digests(fixed).collect()}
    return [(*r, digest[r["conv_id"]]) for r in report.collect()]


def test_against_slow_form(spark):
    rng = random.Random(5)
    rows = []
    for conv in [None, *range(60)]:
        for _ in range(rng.randint(1, 6)):
            said = rng.choice(["Yes.", "No", "  ", "", "Why?", "ok!\n", None, "So it is. "])
            rows.append((conv, rng.choice([None, 0, 1, 2, 3, 5, 9]), rng.choice(["system", "user", "assistant", "tool", "", None]), said))
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted(result(spark, rows), key=key) == sorted(slow(rows), key=key)


def test_all_rows_dropped_and_empty(spark):
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert result(spark, [(dropped, 0, "user", "Hi.")]) == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert result(spark, []) == []


def test_long_conversation_of_unknown_roles():
    """Audits that never fall together cost no copies: linear in the turns."""
    search = turns.Search()
    for _ in range(60_001):
        search.turn("x", False, False)
    cost, audit = search.end()
    assert cost == 60_002 and audit == "D" + "R" * 60_000


def test_general_interface(spark):
    rows = spark.createDataFrame([(1, 0, "assistant", "Hello.", 5), (1, 1, "user", "Hi.", 5), (1, 2, "user", "Hi.", 6)], "conv_id long, turn long, role string, text string, at int")
    report, fixed = turns.repair(rows)
    assert [tuple(r) for r in report.collect()] == [(1, 0, 0, 1, 0, 1, 4, "RRD")]
    assert [tuple(r) for r in fixed.collect()] == [(1, 0, "R", "user", "Hello."), (1, 1, "R", "assistant", "Hi.")]


def test_query_against_sql(spark):
    from rasterlake.llm.queries import ORACLE, QUERIES

    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{data}/conversations.parquet')")
    got = QUERIES["op11_turns"](spark, data).toPandas()
    want = con.execute(ORACLE["op11_turns"]).df()[list(got.columns)]
    assert sorted(got.itertuples(index=False, name=None)) == sorted(want.itertuples(index=False, name=None))
    assert len(got) == con.execute("SELECT count(DISTINCT conv_id) FROM conversations").fetchone()[0]
    assert pytest.approx(len(got)) == got.conv_id.nunique()
