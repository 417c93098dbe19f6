"""Queries over conversations, agent runs and model-output records."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import arrays, records
from quarry.functions.text import TOPIC_STOP_WORDS
from quarry.operators import conversation, tokens
from quarry.plans.registry import query
from quarry.plans.tables import CHAT, pick

_STOP_LIST = ", ".join(f"'{w}'" for w in TOPIC_STOP_WORDS)

TOPICS = f"""{CHAT},
users AS (
  SELECT session_id, num_order, text,
         list_filter(list_distinct(regexp_extract_all(lower(text), '[a-zA-ZÀ-ỹ]+')),
                     lambda w: length(w) > 3 AND NOT list_contains([{_STOP_LIST}], w)) AS tokens,
         row_number() OVER (PARTITION BY session_id ORDER BY num_order) AS nth
  FROM chat WHERE role = 'user'),
before AS (
  SELECT a.session_id, a.nth, list_distinct(flatten(list(b.tokens))) AS old
  FROM users a JOIN users b ON a.session_id = b.session_id AND b.nth BETWEEN a.nth - 3 AND a.nth - 1 AND b.text <> a.text
  GROUP BY 1, 2),
topics AS (
  SELECT u.session_id, u.num_order, u.text,
         len(tokens) >= 2 AND coalesce(len(old), 0) > 0
           AND len(list_intersect(tokens, coalesce(old, []))) / greatest(len(tokens), 1) < 0.25 AS changed
  FROM users u LEFT JOIN before b USING (session_id, nth)),
newest AS (
  SELECT session_id, arg_max(text, num_order) AS current, arg_max(changed, num_order) AS changed
  FROM topics GROUP BY 1)
"""

RECENT = """
recent AS (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY num_order DESC) AS back
  FROM chat WHERE role IN ('user', 'assistant'))
"""


@query("topic_change", f"WITH {TOPICS} SELECT session_id, num_order, changed FROM topics")
def _topic_change(data):
    return conversation.topic_change(data.chat())


@query(
    "chat_history",
    f"""
    WITH {TOPICS}, {RECENT}
    SELECT session_id, num_order, role, md5(text) AS text_md5 FROM recent LEFT JOIN newest USING (session_id)
    WHERE back <= 6 AND NOT coalesce(back = 1 AND text = current, false)
    """,
)
def _chat_history(data):
    chat = data.chat()
    history = conversation.chat_history(chat, conversation.latest_user_message(chat))
    return history.select("session_id", "num_order", "role", F.md5("text").alias("text_md5"))


@query(
    "chat_history_topic",
    f"""
    WITH {TOPICS}, {RECENT}
    SELECT session_id, num_order, role FROM recent LEFT JOIN newest USING (session_id)
    WHERE back <= 6 AND CASE WHEN coalesce(changed, false) THEN back <= 2
                             ELSE NOT coalesce(back = 1 AND text = current, false) END
    """,
)
def _chat_history_topic(data):
    chat = data.chat()
    current = conversation.latest_user_message(chat)
    changed = conversation.topic_change(chat).join(current.select("session_id", "num_order"), ["session_id", "num_order"], "left_semi")
    return conversation.chat_history(chat, current, changed).select("session_id", "num_order", "role")


@query(
    "history_block",
    f"""
    WITH {CHAT}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY num_order DESC) AS back FROM chat)
    SELECT session_id, md5(string_agg(role || ': ' || text, chr(10) ORDER BY num_order)
             FILTER (WHERE length(text) > 0)) AS block_md5
    FROM r WHERE back <= 8 GROUP BY 1
    """,
)
def _history_block(data):
    return conversation.transcript(data.chat()).select("session_id", F.md5("block").alias("block_md5"))


@query("next_order", f"WITH {CHAT} SELECT session_id, max(num_order) + 1 AS next_order FROM chat GROUP BY 1")
def _next_order(data):
    return conversation.next_order(data.chat())


@query(
    "session_activity",
    f"WITH {CHAT} SELECT session_id, count(*) AS turns, max(num_order) AS last_order FROM chat GROUP BY 1",
)
def _session_activity(data):
    return conversation.session_activity(data.chat())


@query(
    "paginate",
    f"""
    WITH {CHAT}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY num_order) AS position FROM chat)
    SELECT session_id, num_order, position FROM r WHERE position > 2 AND position <= 5
    """,
)
def _paginate(data):
    return conversation.page(data.chat(), limit=3, offset=2).select("session_id", "num_order", "position")


@query(
    "event_replay",
    """
    WITH n AS (
      SELECT user_id AS session_id, event_id, event_type,
             min(CASE WHEN event_type = 'purchase' THEN event_id END)
               OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS message_order
      FROM events),
    r AS (SELECT *, row_number() OVER (PARTITION BY session_id, message_order, event_type = 'signup' ORDER BY event_id DESC) AS back
          FROM n WHERE event_type <> 'purchase' AND message_order IS NOT NULL)
    SELECT session_id, message_order, event_id, event_type FROM r WHERE event_type <> 'signup' OR back = 1
    """,
)
def _event_replay(data):
    """Purchases stand for assistant messages, sign-ups for source lists."""
    events = data.table("events").select(F.col("user_id").alias("session_id"), "event_id", "event_type")
    attached = conversation.replay(
        events,
        "event_id",
        conversation.sequence_block(F.col("event_id")),
        F.col("event_type") == "purchase",
        F.col("event_type") == "signup",
    )
    return attached.select("session_id", "message_order", "event_id", "event_type")


TRACES = """
calls AS (SELECT user_id AS run_id, event_id AS pos, event_type AS tool, value > 20 AS ok FROM events),
first_use AS (SELECT run_id, tool, min(pos) AS pos FROM calls GROUP BY 1, 2),
used AS (SELECT run_id, string_agg(tool, ',' ORDER BY pos) AS tools_used FROM first_use GROUP BY 1),
traces AS (
  SELECT run_id, count(*) AS n_calls, count(*) FILTER (WHERE ok) AS n_ok, tools_used,
         arg_max(tool, pos) FILTER (WHERE ok) AS last_tool FROM calls JOIN used USING (run_id) GROUP BY run_id, tools_used)
"""


def _traces(data):
    calls = data.table("events").select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("pos"), F.col("event_type").alias("tool"), (F.col("value") > 20).alias("ok")
    )
    return conversation.trace_rollup(calls)


@query("trace_rollup", f"WITH {TRACES} SELECT run_id, n_calls, n_ok, tools_used, last_tool FROM traces")
def _trace_rollup(data):
    return _traces(data).select("run_id", "n_calls", "n_ok", "tools_used", "last_tool")


@query(
    "needs_clarification",
    f"""
    WITH {TRACES}, a AS (
      SELECT conv_id AS run_id, min(length(text)) AS chars FROM conversations WHERE role = 'assistant' GROUP BY 1)
    SELECT run_id, (coalesce(n_calls, 0) = 0 AND coalesce(chars, 0) < 40) OR (coalesce(n_calls, 0) > 0 AND coalesce(n_ok, 0) = 0)
                   OR (coalesce(n_calls, 0) >= 70 AND coalesce(chars, 0) < 40) AS unclear
    FROM traces FULL JOIN a USING (run_id)
    """,
)
def _needs_clarification(data):
    answers = data.table("conversations").filter("role = 'assistant'").groupBy(F.col("conv_id").alias("run_id")).agg(
        F.min(F.length("text")).alias("chars")
    )
    runs = _traces(data).join(answers, "run_id", "full_outer").fillna({"n_calls": 0, "n_ok": 0, "chars": 0})
    unclear = conversation.needs_clarification(F.col("n_calls"), F.col("n_ok"), F.col("chars"), F.col("n_calls") >= 70)
    return runs.select("run_id", unclear.alias("unclear"))


@query(
    "usage_rollup",
    """
    SELECT CAST(sum(length(text) // 3) AS BIGINT) AS input, CAST(sum(length(text) - length(text) // 3) AS BIGINT) AS output,
           CAST(sum(length(text)) AS BIGINT) AS total, count(*) AS calls FROM conversations
    """,
)
def _usage_rollup(data):
    size = F.length("text").cast("long")
    third = F.floor(size / 3)
    usage = data.table("conversations").select(
        third.alias("input"), (size - third).alias("output"), size.alias("total"), F.lit(1).cast("long").alias("calls")
    )
    return conversation.running_usage(usage)


@query(
    "usage_normalise",
    """
    WITH u AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id % 50 WHEN 1 THEN event_id % 30 ELSE 0 END AS pt,
                      CASE event_id % 4 WHEN 0 THEN event_id % 20 WHEN 2 THEN 5 ELSE 0 END AS ct,
                      CASE event_id % 3 WHEN 0 THEN 99 ELSE 0 END AS tt FROM events)
    SELECT event_id, pt AS input_tokens, ct AS output_tokens, CAST(CASE WHEN tt > 0 THEN tt ELSE pt + ct END AS BIGINT) AS total_tokens
    FROM u WHERE pt <> 0 OR ct <> 0 OR tt <> 0
    """,
)
def _usage_normalise(data):
    n = F.col("event_id")
    raw = data.table("events").select(
        "event_id",
        F.when(n % 4 == 0, n % 50).alias("prompt_tokens"),
        F.when(n % 4 == 1, n % 30).alias("input_tokens"),
        F.when(n % 4 == 0, n % 20).alias("completion_tokens"),
        F.when(n % 4 == 2, F.lit(5)).alias("output_tokens"),
        F.when(n % 3 == 0, F.lit(99)).otherwise(0).alias("total_tokens"),
    )
    usage = tokens.normalize_usage(
        tokens.first_nonzero(F.col("prompt_tokens"), F.col("input_tokens")),
        tokens.first_nonzero(F.col("completion_tokens"), F.col("output_tokens")),
        F.col("total_tokens"),
    )
    used = raw.select("event_id", usage.alias("usage")).filter(F.col("usage").isNotNull())
    return used.select("event_id", "usage.input_tokens", "usage.output_tokens", "usage.total_tokens")


@query(
    "query_list",
    """
    WITH q AS (
      SELECT conv_id, turn, turn % 4 = 3 AS unclear, 'original ' || CAST(conv_id AS VARCHAR) AS original,
             CASE WHEN turn % 3 = 0 THEN '' ELSE trim(text, E' \\n') END AS rewritten,
             list_transform(string_split(text, '.'), lambda x: trim(x, E' \\n')) AS passages FROM conversations),
    b AS (SELECT *, CASE WHEN unclear OR rewritten = '' THEN original ELSE rewritten END AS base FROM q),
    e AS (SELECT conv_id, turn, unnest(list_concat([base], CASE WHEN unclear THEN [] ELSE passages END)) AS t,
                 generate_subscripts(list_concat([base], CASE WHEN unclear THEN [] ELSE passages END), 1) AS pos FROM b),
    f AS (SELECT conv_id, turn, t, min(pos) AS pos FROM e WHERE length(t) > 0 GROUP BY 1, 2, 3),
    g AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) AS rn FROM f)
    SELECT conv_id, turn, count(*) AS n, md5(string_agg(t, '|' ORDER BY rn)) AS queries_md5 FROM g GROUP BY 1, 2
    """,
)
def _query_list(data):
    queries = arrays.query_list(
        F.concat(F.lit("original "), F.col("conv_id").cast("string")),
        F.when(F.col("turn") % 3 == 0, "").otherwise(F.col("text")),
        F.split("text", r"\."),
        F.col("turn") % 4 == 3,
    )
    rows = data.table("conversations").select("conv_id", "turn", queries.alias("q"))
    return rows.select("conv_id", "turn", F.size("q").cast("long").alias("n"), F.md5(F.array_join("q", "|")).alias("queries_md5"))


@query(
    "rewrite_normalise",
    f"""
    WITH r AS (
      SELECT conv_id, turn, text, turn % 4 = 1 AS unclear,
             CASE WHEN turn % 3 = 0 THEN '' ELSE trim(text, E' \\n') END AS given,
             CASE WHEN turn = 5 THEN '' ELSE trim(text, E' \\n') END AS asked,
             lower(trim(['Company', ' sector ', 'galaxy', ''][turn % 4 + 1])) AS scope,
             list_filter(list_transform(string_split(text, ' '), lambda x: trim(x, E' \\n')), lambda x: length(x) > 0) AS entities,
             list_filter(list_transform(string_split(text, '.'), lambda x: trim(x, E' \\n')), lambda x: length(x) > 0) AS parts
      FROM conversations),
    s AS (SELECT *, CASE WHEN NOT unclear AND given = '' THEN text ELSE given END AS rewritten,
                 CASE WHEN unclear AND asked = '' THEN '{records.CLARIFICATION_FALLBACK}' ELSE asked END AS clarification,
                 CASE WHEN scope IN ('company', 'sector', 'macro', 'general') THEN scope ELSE '' END AS known FROM r)
    SELECT conv_id, turn, md5(rewritten) AS rewritten_md5, md5(clarification) AS clarification_md5,
           CASE WHEN NOT unclear AND rewritten <> '' AND known = '' THEN CASE WHEN len(entities) > 0 THEN 'company' ELSE 'general' END
                ELSE known END AS scope_type,
           array_to_string(entities, '|') AS entities,
           md5(CASE WHEN unclear THEN '' ELSE array_to_string(parts, '|') END) AS passages_md5,
           md5(CASE WHEN unclear THEN array_to_string(parts, '|') ELSE '' END) AS suggestions_md5
    FROM s
    """,
)
def _rewrite_normalise(data):
    turn = F.col("turn")
    parts = F.split("text", r"\.")
    raw = data.table("conversations").select(
        "conv_id",
        "turn",
        F.col("text").alias("user_text"),
        F.when(turn % 3 != 0, F.col("text")).alias("rewritten"),
        (turn % 4 == 1).alias("needs_clarification"),
        F.when(turn != 5, F.col("text")).otherwise(" ").alias("clarification"),
        pick(("Company", " sector ", "galaxy", ""), turn % 4).alias("scope_type"),
        F.split("text", " ").alias("preserved_entities"),
        parts.alias("hypothetical_passages"),
        parts.alias("clarification_suggestions"),
    )
    clean = records.normalize_rewrites(raw)
    return clean.select(
        "conv_id",
        "turn",
        F.md5("rewritten").alias("rewritten_md5"),
        F.md5("clarification").alias("clarification_md5"),
        "scope_type",
        F.array_join("preserved_entities", "|").alias("entities"),
        F.md5(F.array_join("hypothetical_passages", "|")).alias("passages_md5"),
        F.md5(F.array_join("clarification_suggestions", "|")).alias("suggestions_md5"),
    )


@query(
    "plan_filter",
    """
    WITH t AS (
      SELECT event_id, CASE event_id % 2 WHEN 0 THEN ['web_search', 'database_query'] ELSE ['visualize'] END AS enabled,
             unnest(['Database', ' web_search', 'visualize', 'magic', event_type]) AS tool,
             generate_subscripts([1, 2, 3, 4, 5], 1) AS pos FROM events)
    SELECT event_id, string_agg(lower(trim(tool)), ',' ORDER BY pos) AS kept FROM t
    WHERE list_contains(enabled, CASE lower(trim(tool)) WHEN 'database' THEN 'database_query' WHEN 'web_search' THEN 'web_search'
                                      WHEN 'visualize' THEN 'visualize' END)
    GROUP BY 1
    """,
)
def _plan_filter(data):
    enabled = F.when(F.col("event_id") % 2 == 0, F.array(F.lit("web_search"), F.lit("database_query"))).otherwise(F.array(F.lit("visualize")))
    names = [F.lit("Database"), F.lit(" web_search"), F.lit("visualize"), F.lit("magic"), F.col("event_type")]
    tasks = F.array(*[F.struct(n.alias("tool_type"), F.lit("goal").alias("goal")) for n in names])
    kept = records.plan_tasks(tasks, enabled)
    return data.table("events").select(
        "event_id", F.array_join(F.transform(kept, lambda t: F.lower(F.trim(t["tool_type"]))), ",").alias("kept")
    )


@query(
    "verdict_normalise",
    """
    WITH v AS (
      SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'sufficient' WHEN 1 THEN 'insufficient' WHEN 2 THEN 'maybe' END AS decision,
             CASE WHEN quality = 1 THEN ['2', 'x', '9', '2', '1'] ELSE ['0'] END AS raw, doc_id % 4 AS n FROM labels),
    p AS (SELECT doc_id, TRY_CAST(u AS INTEGER) AS i, pos, n FROM (
            SELECT doc_id, n, unnest(raw) AS u, generate_subscripts(raw, 1) AS pos FROM v)),
    f AS (SELECT doc_id, i, min(pos) AS pos FROM p WHERE i BETWEEN 1 AND n GROUP BY 1, 2),
    l AS (SELECT doc_id, string_agg(CAST(i AS VARCHAR), ',' ORDER BY pos) AS useful FROM f GROUP BY 1)
    SELECT doc_id, CASE WHEN n = 0 THEN 'insufficient'
                        WHEN decision = 'sufficient' AND useful IS NULL THEN 'partial'
                        WHEN decision IN ('sufficient', 'insufficient') THEN decision ELSE 'partial' END AS decision,
           coalesce(useful, '') AS useful
    FROM v LEFT JOIN l USING (doc_id)
    """,
)
def _verdict_normalise(data):
    doc = F.col("doc_id")
    decision = F.when(doc % 4 == 0, "sufficient").when(doc % 4 == 1, "insufficient").when(doc % 4 == 2, "maybe")
    raw = F.when(F.col("quality") == 1, F.array(*[F.lit(x) for x in ("2", "x", "9", "2", "1")])).otherwise(F.array(F.lit("0")))
    chunks = (doc % 4).cast("int")
    useful = arrays.useful_positions(raw, chunks)
    return data.table("labels").select(
        "doc_id", arrays.verdict(decision, useful, chunks).alias("decision"), F.array_join(useful, ",").alias("useful")
    )


@query(
    "sparse_clean",
    """
    SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '0' ELSE CAST(event_id % 7 AS VARCHAR) END AS keys,
           CASE WHEN event_id % 3 = 0 THEN 1e-9 ELSE value END AS weight FROM events
    """,
)
def _sparse_clean(data):
    n = F.col("event_id")
    key = F.when(n % 3 == 0, "token").otherwise((n % 7).cast("string"))
    weights = F.create_map(key, F.col("value").cast("string"), F.lit("99"), F.lit("heavy"))
    clean = arrays.clean_sparse(weights)
    rows = data.table("events").select("event_id", clean.alias("w"))
    return rows.select(
        "event_id",
        F.array_join(F.transform(F.map_keys("w"), lambda k: k.cast("string")), ",").alias("keys"),
        F.get(F.map_values("w"), 0).alias("weight"),
    )
