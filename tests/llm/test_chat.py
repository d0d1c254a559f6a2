"""Chat windows: exact round trip, budgets, masks, edge cases."""

import hashlib
import re

from rasterlake.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, window string, seg string"


def rows():
    odd = ["\\### Assistant: </turn> ok", "#<\\>\\\\", "</turn>\n### user:\nhi", "", None, "Ünïcode 😀\n\n", "a" * 4000, "\\"]
    out = [(1, k, ("system", "user", "assistant")[min(k, 2) if k < 3 else 1 + k % 2], odd[k % len(odd)]) for k in range(40)]
    out += [(2, 5, "assistant", "only"), (3, 0, "system", "only system"), (4, 0, None, "x"), (4, 0, None, "x"), (4, None, "assistant", "first")]
    out += [(None, 0, "user", "no id"), (5, 0, "ro:le\n#\\", "t"), (5, 1, "system", "late system"), (5, 2, "assistant", None)]
    out += [(6, k, "assistant" if k % 2 else "user", "word " * (k % 60)) for k in range(300)]
    out += [(7, 0, "system", "word " * 900)] + [(7, k, "assistant" if k % 2 else "user", "word " * 20) for k in range(1, 30)]
    return [(*r, "x", "y") for r in out]


def ordered(all_rows):
    by = {}
    for c, turn, role, text, *_ in all_rows:
        by.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: sorted(v) for c, v in by.items()}


def test_round_trip(spark):
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_windows(spark.createDataFrame(rows(), SCHEMA))).collect()}
    want = ordered(rows())
    assert set(got) == set(want)
    for c, turns in want.items():
        learnt = "".join(t for _, _, r, t in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())


def count(text):
    return len(re.findall(chat.TOKEN, text))


def test_budget_history_and_system(spark):
    """Only a window whose own single turn exceeds the budget does; repeated history stays within its share; whole turns, in order."""
    for budget, history in ((200, 50), (150, 0)):
        frames = chat.format_windows(spark.createDataFrame(rows(), SCHEMA), budget=budget, history=history).collect()
        for r in frames:
            turns = r["formatted"].split(chat.END)[:-1]
            assert len(turns) == r["n_turns"]
            sizes = [count(t + chat.END) for t in turns]
            own = sizes[r["n_repeated"] :]
            assert sum(sizes) <= budget or (r["n_repeated"] == 0 and len(own) == 1)
            system = r["formatted"].startswith("### system:\n")
            assert sum(sizes[int(system) : r["n_repeated"]]) <= history
            assert all(p["start"] >= sum(len(t + chat.END) for t in turns[: r["n_repeated"]]) for p in r["loss"])
        for c in (1, 3):  # a short system turn opens every window that has room for it
            assert all(r["formatted"].startswith("### system:\n") or (r["n_turns"] == 1 and count(r["formatted"]) > budget - 60) for r in frames if r["conv_id"] == c)
        long_system = [r for r in frames if r["conv_id"] == 7]
        assert sum(r["formatted"].startswith("### system:\n") for r in long_system) == 1 and len(long_system) > 1


def test_very_long_turn(spark):
    text = "wörd <x> " * 300_000
    got = chat.read_back(chat.format_windows(spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", text)], "conv_id long, turn long, role string, text string"))).first()
    assert got["n_turns"] == 3 and got["loss_chars"] == len(text) and got["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_long_runs_of_letters_are_many_tokens(spark):
    """A window's budget bounds its characters: runs of letters count as one token for each four."""
    talk = [(1, k, "user" if k % 2 == 0 else "assistant", "x" * 700) for k in range(40)]
    frames = chat.format_windows(spark.createDataFrame(talk, "conv_id long, turn long, role string, text string"), budget=512, history=128).collect()
    assert sum(r["n_turns"] - r["n_repeated"] for r in frames) == 40
    assert all(len(r["formatted"]) <= 4 * 512 for r in frames)


def test_empty(spark):
    assert chat.read_back(chat.format_windows(spark.createDataFrame([], SCHEMA))).count() == 0
