"""History windows, topic changes, sequence numbers and replay of event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import cut, topic_tokens
from quarry.operators.ranking import HOT_ROWS, group_position, next_marker, previous_rows, top_n

# Window sizes and the topic-change rule.
HISTORY_MESSAGES = 6
HISTORY_AFTER_CHANGE = 2
TOPIC_LOOKBACK = 3
TOPIC_MIN_TOKENS = 2
TOPIC_MIN_OVERLAP = 0.25
TRANSCRIPT_MESSAGES = 8

BLOCK_ROWS = 100_000
# Pages that reach further than this are not cut before the shuffle; Spark's limit for such cuts, see `session.py`.
DEEP_ROWS = 5000


def sequence_block(order: Column) -> Column:
    """Blocks of consecutive sequence numbers, so that a long session is split."""
    return F.floor(order / BLOCK_ROWS)


def topic_change(messages: DataFrame) -> DataFrame:
    """User messages with `changed`: few of their words occur in the three before.

    Earlier messages with the same text are ignored. A long session is cut into
    blocks, so no window ever holds a whole session.
    """
    users = messages.filter(F.col("role") == "user").select(
        "session_id", "num_order", "text", topic_tokens(F.col("text")).alias("tokens")
    )
    said = F.struct("text", "tokens")
    block = sequence_block(F.col("num_order"))
    known = previous_rows(users, ["session_id"], "num_order", block, TOPIC_LOOKBACK, said, "before")
    others = F.filter("before", lambda m: m["text"] != F.col("text"))
    recent = known.withColumn("old_tokens", F.flatten(F.transform(others, lambda m: m["tokens"])))
    size = F.size("tokens")
    overlap = F.size(F.array_intersect("tokens", "old_tokens")) / F.greatest(size, F.lit(1))
    changed = (size >= TOPIC_MIN_TOKENS) & (F.size("old_tokens") > 0) & (overlap < TOPIC_MIN_OVERLAP)
    return recent.select("session_id", "num_order", changed.alias("changed"))


def chat_history(messages: DataFrame, current: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """Messages to show the model: the last 6 of a session, oldest first.

    `current` holds `(session_id, text)` of the message being answered; it is
    left out when it is the last one. Sessions whose topic changed keep their
    last 2 messages, the current one included.
    """
    spoken = messages.filter(F.col("role").isin("user", "assistant"))
    recent = top_n(spoken, ["session_id"], [F.col("num_order").desc()], HISTORY_MESSAGES, rank="__back")
    marked = recent.join(current.select("session_id", F.col("text").alias("__current")), "session_id", "left")
    if changed is None:
        marked = marked.withColumn("__changed", F.lit(False))
    else:
        flags = changed.select("session_id", F.col("changed").alias("__changed"))
        marked = marked.join(flags, "session_id", "left").fillna({"__changed": False})
    is_current = F.coalesce((F.col("__back") == 1) & (F.col("text") == F.col("__current")), F.lit(False))
    keep = F.when(F.col("__changed"), F.col("__back") <= HISTORY_AFTER_CHANGE).otherwise(~is_current)
    return marked.filter(keep).drop("__back", "__current", "__changed")


def transcript(messages: DataFrame, turns: int = TRANSCRIPT_MESSAGES, chars: int | None = None) -> DataFrame:
    """One `role: text` block per session from its last messages, whole or cut to `chars` each."""
    recent = top_n(messages, ["session_id"], [F.col("num_order").desc()], turns)
    said = cut(F.coalesce("text", F.lit("")), chars)
    line = F.when(F.length(said) > 0, F.concat(F.coalesce("role", F.lit("user")), F.lit(": "), said))
    lines = F.array_sort(F.collect_list(F.struct("num_order", line.alias("line"))))
    return recent.groupBy("session_id").agg(
        F.concat_ws("\n", F.transform(lines, lambda entry: entry["line"])).alias("block")
    )


def next_order(events: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """The next free sequence number per session; 1 for a session without events."""
    top = events.groupBy("session_id").agg(F.max("num_order").alias("__last"))
    if sessions is not None:
        top = sessions.select("session_id").distinct().join(top, "session_id", "left")
    return top.select("session_id", F.coalesce(F.col("__last") + 1, F.lit(1)).cast("long").alias("next_order"))


def assign_order(new_events: DataFrame, last: DataFrame, order: Column, block: Column) -> DataFrame:
    """Number new events behind the last number of their session.

    `last` holds `(session_id, last_order)`. A session with very many new events
    is numbered in blocks; the join adds one small row per session.
    """
    placed = group_position(new_events, ["session_id"], [order], block, "__nth")
    return (
        placed.join(last, "session_id", "left")
        .withColumn("num_order", F.coalesce("last_order", F.lit(0)) + F.col("__nth"))
        .drop("__nth", "last_order")
    )


def session_activity(events: DataFrame) -> DataFrame:
    """Turns and last sequence number per session."""
    return events.groupBy("session_id").agg(F.count(F.lit(1)).alias("turns"), F.max("num_order").alias("last_order"))


def page(events: DataFrame, limit: int = 100, offset: int = 0, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One page of every session in sequence order; at least one row.

    Pages near the start are cut in the tasks before the shuffle. For deep ones every row gets its place, long sessions in blocks of numbers.
    """
    limit, offset = max(1, int(limit)), max(0, int(offset))
    if offset + limit > DEEP_ROWS:
        block = F.coalesce(F.floor(F.col("num_order") / DEEP_ROWS), F.lit(-(1 << 62)))
        placed = group_position(events, ["session_id"], [F.col("num_order").asc()], block, "position", hot_rows)
        return placed.filter((F.col("position") > offset) & (F.col("position") <= offset + limit))
    wanted = top_n(events, ["session_id"], [F.col("num_order").asc()], offset + limit, rank="position")
    return wanted.filter(F.col("position") > offset)


def replay(events: DataFrame, order: str, block: Column, is_message: Column, is_source: Column) -> DataFrame:
    """Attach tool events and source lists to the assistant message that follows them.

    One row per attached event with `message_order`. All tool events before a
    message belong to it, of the source lists only the latest. Events that no
    message follows are left out, as they are never shown.
    """
    placed = next_marker(
        events, ["session_id"], order, block, {"message_order": is_message, "__next_source": is_source}
    )
    replaced = is_source & F.coalesce(F.col("__next_source") < F.col("message_order"), F.lit(False))
    return placed.filter(~is_message & F.col("message_order").isNotNull() & ~replaced).drop("__next_source")


def running_usage(messages: DataFrame) -> DataFrame:
    """Token sums per agent run."""
    return messages.agg(*[F.sum(c).alias(c) for c in ("input", "output", "total", "calls")])


def trace_rollup(calls: DataFrame) -> DataFrame:
    """Per run: calls, successful calls, distinct tools in first-use order, last good tool.

    `calls` holds `(run_id, pos, tool, ok)`. Calls are first summed per tool, so
    what is collected per run is bounded by the number of tools.
    """
    by_tool = calls.groupBy("run_id", "tool").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("ok").alias("n_ok"),
        F.min("pos").alias("first_pos"),
        F.max(F.when(F.col("ok"), F.col("pos"))).alias("ok_pos"),
    )
    used = F.array_sort(F.collect_list(F.when(F.col("tool") != "", F.struct("first_pos", "tool"))))
    return by_tool.groupBy("run_id").agg(
        F.sum("n").alias("n_calls"),
        F.sum("n_ok").alias("n_ok"),
        F.array_join(F.transform(used, lambda e: e["tool"]), ",").alias("tools_used"),
        F.max_by("tool", "ok_pos").alias("last_tool"),
    )


def needs_clarification(n_calls: Column, n_ok: Column, answer_chars: Column, hit_limit: Column) -> Column:
    """A run that called nothing and said little, whose calls all failed, or that ran out short."""
    short = answer_chars < 40
    return ((n_calls == 0) & short) | ((n_calls > 0) & (n_ok == 0)) | (hit_limit & short)


def latest_user_message(messages: DataFrame) -> DataFrame:
    """The newest user message per session."""
    users = messages.filter(F.col("role") == "user")
    return top_n(users, ["session_id"], [F.col("num_order").desc()], 1)


