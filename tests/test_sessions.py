"""Sessions over streams against plain loops, over restarts, micro-batches and odd rows."""

import numpy as np
import pandas as pd
import pytest

from rasterlake.streaming import sessions as S

SCHEMA = "event_id long, user_id long, ts timestamp_ntz, editor long, ends boolean, generation long, done double, kind string, value double"
BASE = 1_700_000_000_000


def events(n, seed, users=5):
    r = np.random.default_rng(seed)
    at = BASE + np.sort(r.integers(0, 400, n)) * 900_000  # ties are common
    kinds = np.array(["edit", "edit", "request", "request", "adopt", "other", None], dtype=object)
    rows = [
        (i, int(u), pd.Timestamp(int(t), unit="ms").to_pydatetime(), *x)
        for i, (u, t, x) in enumerate(
            zip(r.integers(0, users, n), at, zip(r.integers(0, 3, n).tolist(), (r.random(n) < 0.4).tolist(), r.integers(0, 4, n).tolist(), r.integers(0, 9, n).astype(float).tolist(), r.choice(kinds, n).tolist(), r.integers(0, 3, n).astype(float).tolist()))
        )
    ]
    return [list(x) for x in rows]


def ms(row):
    return int(pd.Timestamp(row[2]).value // 1_000_000)


def lease_loop(rows, hold, mark):
    out, held = [], {}
    for t in sorted({ms(r) for r in rows}) + [None]:
        for user in list(held):
            who, since, until = held[user]
            if until < mark if t is None else until <= t:
                out.append((user, since, who, "lapsed", until))
                del held[user]
        for r in sorted((r for r in rows if ms(r) == t), key=lambda r: r[0]):
            user, free = r[1], r[1] not in held
            mine = not free and held[user][0] == r[3]
            what = ("ended" if mine else "ignored") if r[4] else ("granted" if free else "refused")
            if what == "granted":
                held[user] = (r[3], r[0], t + hold)
            if what == "ended":
                del held[user]
            out.append((user, r[0], r[3], what, t))
    return out


def render_loop(rows, cost, mark):
    """By ticks: at each time of a row or of a due render, renders end first."""
    out = []
    for user in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == user), key=lambda r: (ms(r), r[0]))
        settings, work = 0.0, None
        while True:
            t = ms(mine[0]) if mine else None
            if work and (work[1] <= t if t is not None else work[1] < mark):
                shown, at, rounds = work
                work = None if shown == settings else (settings, at + cost, rounds + 1)
                if work is None:
                    out.append((user, "rendered", settings, at, rounds))
                continue
            if t is None:
                break
            r = mine.pop(0)
            if r[7] == "edit":
                settings = r[8]
            elif r[7] == "request":
                work = work or (settings, t + cost, 1)
            elif r[7] == "adopt":
                work = None
                out.append((user, "adopted", settings, t, 0))
    return out


def progress_loop(rows):
    best, out = {}, []
    for r in sorted(rows, key=lambda r: (ms(r), r[0])):
        if r[1] not in best or (r[5], r[6]) > best[r[1]]:
            best[r[1]] = (r[5], r[6])
            out.append((r[1], r[0], r[5], r[6]))
    return out


def put(spark, folder, k, rows):
    tmp = folder / f"part-{k}"
    spark.createDataFrame([tuple(r) for r in rows], SCHEMA).coalesce(1).write.parquet(str(tmp))
    (next(tmp.glob("*.parquet"))).rename(folder / f"events-{k}.parquet")


def job(spark, folder, session, tag):
    stream = S.event_stream(S.stream_session(spark), str(folder))
    return sorted(map(tuple, S.run(spark, tag, str(folder), S.follow(stream, "user_id", session)).collect()), key=str)


CASES = [("lease", lambda: S.Lease(3_600_000), lambda rows, mark: lease_loop(rows, 3_600_000, mark)), ("render", lambda: S.RenderLoop(2_000_000), lambda rows, mark: render_loop(rows, 2_000_000, mark)), ("progress", S.Progress, lambda rows, mark: progress_loop(rows))]


@pytest.mark.parametrize("tag,session,loop", CASES, ids=[c[0] for c in CASES])
def test_sessions_against_loops_and_restarts(spark, tmp_path, tag, session, loop):
    rows = events(600, 3)
    for r in rows:
        r[1] = 0 if r[0] % 3 == 0 else r[1]  # one hot key
    mark = max(map(ms, rows))
    want = sorted(loop(rows, mark), key=str)
    one, two = tmp_path / "one", tmp_path / "two"
    one.mkdir()
    two.mkdir()
    put(spark, one, 0, rows)
    assert job(spark, one, session(), tag) == want and want
    cut = next(k for k in range(300, 600) if ms(rows[k]) > ms(rows[k - 1]))
    put(spark, two, 0, rows[:cut])
    first = job(spark, two, session(), tag)
    assert first == sorted(loop(rows[:cut], ms(rows[cut - 1])), key=str)
    assert job(spark, two, session(), tag) == first  # nothing new
    put(spark, two, 1, rows[cut:])
    assert job(spark, two, session(), tag) == want


def test_micro_batches_and_late_rows(spark, tmp_path, monkeypatch):
    """Files in micro-batches of their own give what one batch gives; a row behind the watermark is left out of sessions with timers."""
    monkeypatch.setattr(S, "BATCH_BYTES", 1)
    rows = events(200, 5)
    cut = next(k for k in range(100, 200) if ms(rows[k]) > ms(rows[k - 1]))
    put(spark, tmp_path, 0, rows[:cut])
    put(spark, tmp_path, 1, rows[cut:])
    want = sorted(lease_loop(rows, 3_600_000, max(map(ms, rows))), key=str)
    assert job(spark, tmp_path, S.Lease(3_600_000), "lease") == want
    put(spark, tmp_path, 2, [[999, 1, rows[0][2], 1, False, 9, 9.0, "request", 1.0]])
    assert job(spark, tmp_path, S.Lease(3_600_000), "lease") == want


def test_odd_rows(spark, tmp_path):
    """Null kinds, editors, generations, values and times do nothing; a null key is a key; an empty source gives no rows."""
    t = pd.Timestamp(BASE, unit="ms").to_pydatetime()
    put(spark, tmp_path, 0, [[1, None, t, None, False, None, 1.0, None, 1.0], [2, None, t, 1, None, 1, None, "edit", None], [3, None, None, 1, False, 1, 1.0, "adopt", 1.0], [4, None, t, 2, False, 7, 5.0, "adopt", 1.0], [4, None, t, 2, False, 7, 5.0, "adopt", 1.0]])
    assert job(spark, tmp_path, S.Lease(), "lease") == [(None, 4, 2, "granted", BASE), (None, 4, 2, "refused", BASE)]
    assert job(spark, tmp_path, S.Progress(), "progress") == [(None, 4, 7, 5.0)]
    assert job(spark, tmp_path, S.RenderLoop(), "render") == [(None, "adopted", 0.0, BASE, 0)] * 2
    empty = tmp_path / "empty"
    empty.mkdir()
    put(spark, empty, 0, [])
    assert job(spark, empty, S.Lease(), "lease") == []
