"""Chat formatting into budgeted windows, with DataFrame functions only.

Each turn becomes ``### role:`` newline, text, newline, ``</turn>`` newline. Backslash, # and < inside texts (colon
and newline too inside roles) get a backslash before them, so no text can contain a
marker, and removing one backslash before each escaped character gives it back.

Prefix sums of turn tokens choose spans: with r tokens of room, a turn that starts and ends inside the k-th stretch of r tokens
belongs to span k, and a turn that crosses a stretch's end is a span of its own. So spans are whole
turns and hold at most r tokens, except a single turn that alone holds more. A window is a
span after the leading system turn and as many turns before the span as fit into ``history``
tokens; room is what these leave of ``budget``. No window exceeds the budget but one whose new turn alone does: a system turn
that leaves less than ``LEAST_ROOM`` is a window of its own and not repeated, and before a turn that is too long for them
the history goes first, then the system turn. Repeated turns are never under the loss mask,
which covers the text of every assistant turn exactly once.

Tokens are counted exactly by ``count_tokens``: runs of at most four ASCII letters, single digits, and single other characters that are
no white space (a column function; another one can be given).

One shuffle by conv_id serves the prefix sums, the windows and the read-back. A conversation is
read in one task because its order is its meaning; its history per turn is bounded by ``history``.

Defined results: null text and null role are empty; turns are ordered by turn, then by
their formatted text (null turn first); repeated rows are repeated turns; rows with null conv_id are one
conversation with a null id; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUDGET, HISTORY, LEAST_ROOM = 512, 128, 64
TOKEN = r"[A-Za-z]{1,4}|[0-9]|[^\x20\x09-\x0D0-9A-Za-z]"
#: Inside an escaped text a backslash stands before every <, so a newline never does.
END = "\n</turn>\n"


def count_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN)).cast("long")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\<#])", r"\\$1")


def escape_role(role: Column) -> Column:
    return F.regexp_replace(role, r"([\\<#:\n])", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens=count_tokens) -> DataFrame:
    """``(conv_id, window, formatted, n_turns, n_repeated, loss)``: loss is an array of (start, length) in code
    points of formatted; the first n_repeated turns of a window are repeated from earlier ones."""
    head = F.concat(F.lit("### "), escape_role(F.coalesce(F.col("role").cast("string"), F.lit(""))), F.lit(":\n"))
    body = escape(F.coalesce(F.col("text").cast("string"), F.lit("")))
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").alias("role"), head.alias("head"), body.alias("body"))
    turns = turns.select("conv_id", "turn", "role", F.length("head").alias("skip"), F.length("body").alias("size"), F.concat("head", "body", F.lit(END)).alias("seg"))
    order = Window.partitionBy("conv_id").orderBy("turn", "seg")
    whole, so_far = Window.partitionBy("conv_id"), order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = turns.withColumn("tokens", tokens(F.col("seg"))).withColumn("idx", F.row_number().over(order))
    turns = turns.withColumn("sys", F.coalesce((F.col("idx") == 1) & (F.col("role") == "system"), F.lit(False)))
    turns = turns.withColumn("at", F.sum(F.when(F.col("sys"), 0).otherwise(F.col("tokens"))).over(so_far) - F.col("tokens"))
    turns = turns.withColumn("chars", F.sum(F.length("seg")).over(so_far) - F.length("seg"))
    turns = turns.withColumn("at", F.when(F.col("sys"), F.lit(-(10**15))).otherwise(F.col("at")))
    again = F.col("sys") & (F.col("tokens") <= budget - history - LEAST_ROOM)  # a system turn that windows can repeat
    turns = turns.withColumn("sys_seg", F.max(F.when(again, F.col("seg"))).over(whole)).withColumn("sys_tokens", F.coalesce(F.max(F.when(again, F.col("tokens"))).over(whole), F.lit(0)))
    turns = turns.withColumn("second", F.coalesce(F.max(F.when(F.col("idx") == 2, F.col("tokens"))).over(whole), F.lit(0)))
    turns = turns.withColumn("room", F.lit(budget - history) - F.col("sys_tokens"))
    cell = F.floor(F.col("at") / F.col("room")).cast("long")
    turns = turns.withColumn("span", F.when(~F.col("sys"), 2 * cell + F.when(F.col("at") + F.col("tokens") > (cell + 1) * F.col("room"), 1).otherwise(0)))
    # the system turn goes with the first span if both fit
    turns = turns.withColumn("span", F.coalesce("span", F.when(again & (F.col("tokens") + F.col("second") <= budget), F.min("span").over(whole)), F.lit(-1)))
    near = Window.partitionBy("conv_id").orderBy("at").rangeBetween(-history, -1)
    turns = turns.withColumn("past", F.collect_list("seg").over(near)).withColumn("past_tokens", F.coalesce(F.sum("tokens").over(near), F.lit(0)))
    spans = turns.groupBy("conv_id", "span").agg(
        F.array_sort(F.collect_list(F.struct("idx", "chars", "skip", "size", "seg", (F.col("role") == "assistant").alias("learn")))).alias("new"),
        F.min_by(F.struct("past", "past_tokens", "sys_seg", "sys_tokens"), "idx").alias("old"),
        F.max("sys").alias("has_sys"),
        F.sum("tokens").alias("own"),
    )
    with_sys = ~F.col("has_sys") & F.col("old.sys_seg").isNotNull() & (F.col("old.sys_tokens") + F.col("own") <= budget)
    with_past = ~F.col("has_sys") & (F.col("old.sys_tokens") + F.col("old.past_tokens") + F.col("own") <= budget)
    none = F.array().cast("array<string>")
    repeated = F.concat(F.when(with_sys, F.array("old.sys_seg")).otherwise(none), F.when(with_past, F.col("old.past")).otherwise(none))
    spans = spans.withColumn("old", repeated).withColumn("before", F.array_join("old", "")).withColumn("n_repeated", F.size("old").cast("long"))
    base = F.length("before").cast("long") - F.col("new")[0]["chars"]
    loss = F.transform(F.filter("new", lambda t: F.coalesce(t["learn"], F.lit(False))), lambda t: F.struct((base + t["chars"] + t["skip"]).cast("long").alias("start"), t["size"].cast("long").alias("length")))
    return spans.select(
        "conv_id",
        F.row_number().over(Window.partitionBy("conv_id").orderBy("span")).alias("window"),
        F.concat("before", F.array_join(F.transform("new", lambda t: t["seg"]), "")).alias("formatted"),
        (F.col("n_repeated") + F.size("new")).alias("n_turns"),
        "n_repeated",
        loss.alias("loss"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)`` from formatted windows alone."""
    segs = F.slice(F.split("formatted", END), F.col("n_repeated") + 1, F.col("n_turns") - F.col("n_repeated"))
    role = lambda s: F.regexp_extract(s, r"(?s)^### ((?:[^\\:]++|\\.)*+):\n", 1)
    parsed = F.transform(F.transform(segs, lambda s: F.struct(s.alias("s"), role(s).alias("r"))), lambda x: F.concat(
        unescape(x["r"]), F.lit("\n"), unescape(F.substring(x["s"], F.length(x["r"]) + 7, F.length(x["s"]) - F.length(x["r"]) - 6)), F.lit("\n")
    ))
    learnt = F.transform("loss", lambda p: unescape(F.substring(F.col("formatted"), (p["start"] + 1).cast("int"), p["length"].cast("int"))))
    rows = windows.select("conv_id", "window", F.size(segs).cast("long").alias("n"), F.array_join(parsed, "").alias("turns"), F.array_join(learnt, "").alias("learnt"), F.length("formatted").cast("long").alias("chars"))
    got = rows.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.array_sort(F.collect_list(F.struct("window", "turns", "learnt"))).alias("w"), F.sum("chars").alias("formatted_chars"))
    text = lambda c: F.array_join(F.transform("w", lambda x: x[c]), "")
    return got.select(
        "conv_id", "n_turns", F.sha2(text("turns"), 256).alias("turns_sha256"),
        F.length(text("learnt")).cast("long").alias("loss_chars"), F.sha2(text("learnt"), 256).alias("loss_sha256"), "formatted_chars",
    )


#: The same contract in DuckDB SQL: the digests from the conversations themselves, the sizes from the window rule.
ORACLE = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), s AS (
  SELECT *, '### ' || regexp_replace(role, '([\\<#:\n])', '\\\1', 'g') || ':' || chr(10) || regexp_replace(text, '([\\<#])', '\\\1', 'g') || chr(10) || '</turn>' || chr(10) AS seg FROM c
), t AS (
  SELECT *, row_number() OVER w AS idx, CAST(len(regexp_extract_all(seg, '{TOKEN}')) AS BIGINT) AS tokens FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, seg)
), u AS (SELECT *, idx = 1 AND role = 'system' AS sys, idx = 1 AND role = 'system' AND tokens <= {BUDGET - HISTORY - LEAST_ROOM} AS again FROM t
), v AS (
  SELECT *, CASE WHEN sys THEN -1000000000000000 ELSE sum(CASE WHEN sys THEN 0 ELSE tokens END) OVER (PARTITION BY conv_id ORDER BY idx) - tokens END AS pos,
    coalesce(max(CASE WHEN again THEN length(seg) END) OVER (PARTITION BY conv_id), 0) AS sys_chars,
    coalesce(max(CASE WHEN again THEN tokens END) OVER (PARTITION BY conv_id), 0) AS sys_tokens,
    coalesce(max(CASE WHEN idx = 2 THEN tokens END) OVER (PARTITION BY conv_id), 0) AS second
  FROM u
), r AS (SELECT *, {BUDGET - HISTORY} - sys_tokens AS room FROM v
), x AS (
  SELECT *, coalesce(sum(length(seg)) OVER near, 0) AS past, coalesce(sum(tokens) OVER near, 0) AS past_tokens,
    CASE WHEN NOT sys THEN 2 * CAST(floor(pos / room) AS BIGINT) + CASE WHEN pos + tokens > (floor(pos / room) + 1) * room THEN 1 ELSE 0 END END AS span0
  FROM r WINDOW near AS (PARTITION BY conv_id ORDER BY pos RANGE BETWEEN {HISTORY} PRECEDING AND 1 PRECEDING)
), y AS (SELECT *, coalesce(span0, CASE WHEN again AND tokens + second <= {BUDGET} THEN min(span0) OVER (PARTITION BY conv_id) END, -1) AS span FROM x
), w AS (
  SELECT conv_id, span, sum(length(seg)) AS chars, sum(tokens) AS own, bool_or(sys) AS has_sys, max(sys_chars) AS sys_chars, max(sys_tokens) AS sys_tokens,
    arg_min(past, idx) AS past, arg_min(past_tokens, idx) AS past_tokens FROM y GROUP BY conv_id, span
), f AS (
  SELECT conv_id, CAST(sum(chars + CASE WHEN has_sys THEN 0 ELSE CASE WHEN sys_tokens + own <= {BUDGET} THEN sys_chars ELSE 0 END
    + CASE WHEN sys_tokens + past_tokens + own <= {BUDGET} THEN past ELSE 0 END END) AS BIGINT) AS formatted_chars FROM w GROUP BY conv_id
), d AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY idx)) AS turns_sha256,
    CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY idx) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256
  FROM y GROUP BY conv_id
)
SELECT d.conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars FROM d JOIN f USING (conv_id)
"""
