"""Queries for token statistics, scores, metrics and test sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import evaluation, tokens
from quarry.plans.registry import query
from quarry.plans.tables import CASES, LOGS, pick, sql_bround, sql_round

ROLES = ("system", "user", "assistant")
_KINDS = ("input", "output", "total")


def _sql_stats(source: str = "") -> str:
    return ", ".join(
        f"CAST(coalesce(min({k}{source}), 0) AS DOUBLE) AS {k}_min, CAST(coalesce(max({k}{source}), 0) AS DOUBLE) AS {k}_max, "
        + sql_bround(f"coalesce(avg({k}{source}), 0)", 2)
        + f" AS {k}_avg, CAST(coalesce(sum({k}{source}), 0) AS DOUBLE) AS {k}_sum"
        for k in _KINDS
    )


TURNS = f"""{LOGS},
turns AS (
  SELECT test_id, arg_min(category, line) AS category, {", ".join(f"coalesce(sum({k}_tokens), 0) AS {k}" for k in _KINDS)}
  FROM logs GROUP BY 1)
"""


def _rows(data):
    return tokens.usage_rows(data.logs(), ROLES)


@query(
    "tokens_by_component",
    f"""
    WITH {LOGS} SELECT component, count(*) AS count, count(total_tokens) AS with_usage, {_sql_stats("_tokens")}
    FROM logs GROUP BY 1
    """,
)
def _tokens_by_component(data):
    return tokens.by_component(_rows(data))


@query(
    "tokens_per_turn",
    f"WITH {TURNS} SELECT test_id, category, {', '.join(f'CAST({k} AS BIGINT) AS {k}' for k in _KINDS)} FROM turns",
)
def _tokens_per_turn(data):
    return tokens.per_turn(_rows(data))


@query("tokens_overall", f"WITH {TURNS} SELECT count(*) AS turns, {_sql_stats()} FROM turns")
def _tokens_overall(data):
    return tokens.overall(tokens.per_turn(_rows(data)))


@query("tokens_by_category", f"WITH {TURNS} SELECT category, count(*) AS turns, {_sql_stats()} FROM turns GROUP BY 1")
def _tokens_by_category(data):
    return tokens.by_category(tokens.per_turn(_rows(data)))


@query(
    "tokens_rollup",
    f"""
    WITH {TURNS} SELECT coalesce(category, 'all') AS category, count(*) AS turns, {_sql_stats()} FROM turns
    GROUP BY GROUPING SETS ((), (category))
    """,
)
def _tokens_rollup(data):
    both = tokens.overall_and_by_category(tokens.per_turn(_rows(data)))
    return both.fillna({"category": "all"})


@query(
    "tokens_component_avg",
    f"""
    WITH {LOGS}, t AS (SELECT count(DISTINCT test_id) AS n FROM logs)
    SELECT {", ".join(sql_bround(f"coalesce(sum(total_tokens) FILTER (WHERE component = '{r}'), 0) / any_value(n)", 2) + f" AS {r}" for r in ROLES)}
    FROM logs, t
    """,
)
def _tokens_component_avg(data):
    return tokens.component_average(_rows(data), ROLES)


SCORES = """
scores AS (
  SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'e2e' WHEN 1 THEN 'rag' ELSE 'agent' END AS layer,
         'run' || CAST(doc_id % 2 AS VARCHAR) AS run, quality, toxic FROM labels),
long AS (
  SELECT run, layer || '.quality' AS metric, CAST(quality AS DOUBLE) AS value FROM scores
  UNION ALL SELECT run, layer || '.toxic', toxic / 3.0 FROM scores
  UNION ALL SELECT run, layer || '.none', NULL FROM scores)
"""


def _scores(data):
    """Score maps of all three layers."""
    doc = F.col("doc_id")
    metrics = F.create_map(
        F.lit("quality"), F.col("quality").cast("double"), F.lit("toxic"), F.col("toxic") / 3.0, F.lit("none"), F.lit(None).cast("double")
    )
    return data.table("labels").select(
        doc.alias("id"),
        pick(evaluation.LAYERS, doc % 3).alias("layer"),
        F.concat(F.lit("run"), (doc % 2).cast("string")).alias("run"),
        metrics.alias("metrics"),
    )


@query(
    "score_summary",
    f"WITH {SCORES} SELECT metric, {sql_bround('coalesce(avg(value), 0)', 4)} AS mean FROM long GROUP BY 1",
)
def _score_summary(data):
    return evaluation.score_summary(_scores(data))


@query(
    "score_layers",
    f"""
    WITH {SCORES}, m AS (SELECT split_part(metric, '.', 1) AS layer, {sql_bround('coalesce(avg(value), 0)', 4)} AS mean FROM long GROUP BY 1, metric)
    SELECT layer, {sql_round("coalesce(avg(mean), 0)", 6)} AS mean FROM (VALUES ('e2e'), ('rag'), ('agent')) v(layer)
    LEFT JOIN m USING (layer) GROUP BY 1
    """,
)
def _score_layers(data):
    layers = evaluation.layer_averages(evaluation.score_summary(_scores(data)))
    return layers.withColumn("mean", F.round("mean", 6))


@query(
    "score_compare",
    f"""
    WITH {SCORES}, m AS (SELECT run, metric, {sql_bround('coalesce(avg(value), 0)', 4)} AS mean FROM long
                         WHERE NOT (run = 'run1' AND metric = 'rag.toxic') GROUP BY 1, 2)
    SELECT metric, coalesce(max(mean) FILTER (WHERE run = 'run0'), 0) AS run0, coalesce(max(mean) FILTER (WHERE run = 'run1'), 0) AS run1
    FROM m GROUP BY 1
    """,
)
def _score_compare(data):
    runs = ("run0", "run1")
    scores = _scores(data)
    summaries = [evaluation.score_summary(scores.filter(F.col("run") == r)).withColumn("run", F.lit(r)) for r in runs]
    both = summaries[0].unionByName(summaries[1]).filter("NOT (run = 'run1' AND metric = 'rag.toxic')")
    return evaluation.compare_runs(both, runs)


# Captured turns -----------------------------------------------------------------
@query(
    "last_attempt",
    """
    SELECT 'T' || CAST(conv_id % 40 AS VARCHAR) AS id, arg_max(md5(text), conv_id * 100 + turn) AS text_md5
    FROM conversations WHERE role <> 'system' GROUP BY 1
    """,
)
def _last_attempt(data):
    n = F.col("conv_id") % 40
    attempts = data.table("conversations").select(
        F.when(F.col("role") != "system", F.concat(F.lit("T"), n.cast("string"))).alias("id"), "conv_id", "turn", "text"
    )
    return evaluation.last_attempt(attempts, [F.col("conv_id"), F.col("turn")]).select("id", F.md5("text").alias("text_md5"))


CALLS = """
calls AS (
  SELECT event_id, user_id AS case_id, event_id AS pos, CASE event_id % 3 WHEN 0 THEN 'database' ELSE 'visualize' END AS tool_type,
         ['bar', 'line', 'describe', 'chart_from_data'][event_id % 4 + 1] AS tool, ['stocks', 'news'][event_id % 2 + 1] AS tbl,
         [event_type, 'Value '] AS ys, value > 20 AS ok FROM events)
"""


def _calls(data):
    n = F.col("event_id")
    return data.table("events").select(
        n.alias("run_id"),
        F.col("user_id").alias("case_id"),
        n.alias("pos"),
        F.when(n % 3 == 0, "database").otherwise("visualize").alias("tool_type"),
        pick(("bar", "line", "describe", "chart_from_data"), n % 4).alias("tool"),
        pick(("stocks", "news"), n % 2).alias("table"),
        F.array("event_type", F.lit("Value ")).alias("y_columns"),
        (F.col("value") > 20).alias("ok"),
        F.when(n % 5 == 0, "no link").otherwise("see HTTP://x/y.png").alias("result"),
        F.when(n % 11 == 0, "timeout").alias("error"),
        "event_type",
    )


@query(
    "tool_selection",
    f"""
    WITH t AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN ['database', 'web_search'] WHEN 1 THEN ['visualize'] WHEN 2 THEN []
                                ELSE [event_type] END AS e,
                      CASE event_id % 3 WHEN 0 THEN ['database', 'visualize'] WHEN 1 THEN [] ELSE ['visualize', event_type] END AS a FROM events)
    SELECT event_id, CASE WHEN len(e) = 0 AND len(a) = 0 THEN 1.0 WHEN len(e) = 0 OR len(a) = 0 THEN 0.0
      ELSE {sql_round("len(list_intersect(e, a)) / len(list_distinct(list_concat(e, a)))", 6)} END AS score FROM t
    """,
)
def _tool_selection(data):
    n = F.col("event_id")
    none = F.array().cast("array<string>")
    lit = lambda *xs: F.array(*[F.lit(x) for x in xs])
    expected = F.when(n % 4 == 0, lit("DB", "web")).when(n % 4 == 1, lit("chart", " ")).when(n % 4 == 2, none).otherwise(F.array("event_type"))
    actual = F.when(n % 3 == 0, lit("database", "viz", "db")).when(n % 3 == 1, none).otherwise(F.array(F.lit("visualize"), F.col("event_type")))
    return data.table("events").select("event_id", F.round(evaluation.tool_selection(expected, actual), 6).alias("score"))


@query(
    "chart_metrics",
    f"""
    WITH {CALLS},
    last AS (SELECT case_id, max(pos) AS pos FROM calls
             WHERE tool_type = 'visualize' AND tool IN ('bar', 'line', 'pie', 'chart_from_data') GROUP BY 1),
    l AS (SELECT c.case_id, c.tool, c.tbl, c.ys[1] AS y FROM calls c JOIN last USING (case_id, pos))
    SELECT c_custkey AS case_id, CASE WHEN l.tool IN ('bar', 'line') THEN 1.0 ELSE 0.0 END AS chart_type_acc,
      CASE WHEN c_custkey % 5 = 0 THEN 1.0 WHEN l.tbl = 'news' THEN 1.0 ELSE 0.0 END AS table_acc,
      CASE WHEN l.tool IS NULL THEN 0.0 ELSE {sql_round("CASE WHEN y = 'click' THEN 2 ELSE 1 END / CASE WHEN y = 'click' THEN 2 ELSE 3 END", 6)} END AS column_acc
    FROM customer LEFT JOIN l ON case_id = c_custkey
    """,
)
def _chart_metrics(data):
    cases = data.table("customer").select(
        F.col("c_custkey").alias("case_id"),
        F.array(F.lit("bar"), F.lit("line")).alias("chart_type"),
        F.when(F.col("c_custkey") % 5 != 0, "news").alias("table"),
        F.array(F.lit("value"), F.lit("click")).alias("y_columns"),
    )
    metrics = evaluation.chart_metrics(cases, _calls(data))
    return metrics.withColumn("column_acc", F.round("column_acc", 6))


@query(
    "viz_ok",
    f"""
    WITH {CALLS}
    SELECT case_id, {sql_round("coalesce(avg(CASE WHEN ok AND event_id % 5 <> 0 AND event_id % 11 <> 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE tool_type = 'visualize'), 0)", 6)} AS tool_result_ok
    FROM calls GROUP BY 1
    """,
)
def _viz_ok(data):
    calls = _calls(data)
    scored = evaluation.chart_success(calls.select("case_id", "run_id", "tool_type", "error"), calls.select("run_id", "ok", "result"))
    return scored.withColumn("tool_result_ok", F.round("tool_result_ok", 6))


@query(
    "context_diversity",
    f"""
    SELECT lang, {sql_round("coalesce(count(DISTINCT nullif(source, 'src3')) / nullif(count(nullif(source, 'src3')), 0), 0)", 6)} AS context_diversity
    FROM documents GROUP BY 1
    """,
)
def _context_diversity(data):
    chunks = data.table("documents").select("lang", F.when(F.col("source") == "src3", " ").otherwise(F.col("source")).alias("file_name"))
    return evaluation.context_diversity(chunks, ["lang"]).withColumn("context_diversity", F.round("context_diversity", 6))


@query(
    "citation_validity",
    f"""
    SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 1.0 WHEN turn % 3 = 1 THEN {sql_round("2 / 3", 6)} ELSE 0.0 END AS score FROM conversations
    """,
)
def _citation_validity(data):
    turn = F.col("turn")
    answer = F.when(turn % 3 == 0, F.col("text")).otherwise(F.concat("text", F.lit(" [1][7] and [2]")))
    sources = F.when(turn % 3 == 2, F.array().cast("array<int>")).otherwise(F.array(F.lit(1), F.lit(2)))
    return data.table("conversations").select(
        "conv_id", "turn", F.round(evaluation.citation_validity(answer, sources), 6).alias("score")
    )


@query(
    "language_clean",
    """
    SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 0.4 WHEN 1 THEN 0.6
      ELSE CASE WHEN regexp_matches(text, '[\\x{3040}-\\x{30FF}\\x{3400}-\\x{9FFF}\\x{0400}-\\x{04FF}]') THEN 0.0 ELSE 0.6 END
         + CASE WHEN regexp_matches(text, '(?m)^\\s*#{1,3}\\s+\\S') THEN 0.0 ELSE 0.4 END END AS score
    FROM documents
    """,
)
def _language_clean(data):
    kinds = F.array(F.concat(F.lit("Да. "), "text"), F.concat(F.lit("## Head\n"), "text"), F.col("text"))
    answer = F.get(kinds, (F.col("doc_id") % 3).cast("int"))
    return data.table("documents").select("doc_id", evaluation.language_clean(answer).alias("score"))


@query(
    "correctness",
    """
    SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 0.0 WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 1.0 ELSE 0.0 END
                        ELSE CAST(quality AS DOUBLE) END AS score FROM labels
    """,
)
def _correctness(data):
    doc = F.col("doc_id")
    answer = F.when(doc % 5 == 0, " ").when(doc % 2 == 0, "Rất tiếc, Chưa có dữ liệu cho câu hỏi.").otherwise("42")
    reference = F.when(doc % 3 != 0, "answer")
    return data.table("labels").select("doc_id", evaluation.correctness(answer, reference, F.col("quality")).alias("score"))


VERDICTS = """
v AS (
  SELECT l_orderkey AS case_id, l_linenumber AS item_no,
         ['context_precision', 'context_recall', 'answer_faithfulness', 'faithfulness'][l_partkey % 4 + 1] AS metric,
         CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.0 END AS score FROM lineitem),
m AS (
  SELECT case_id, avg(score) FILTER (WHERE metric = 'context_precision' AND item_no < 5) AS p,
         avg(score) FILTER (WHERE metric = 'context_recall') AS r, avg(score) FILTER (WHERE metric = 'answer_faithfulness') AS a,
         avg(score) FILTER (WHERE metric = 'faithfulness') AS f FROM v GROUP BY 1)
"""


def _verdicts(data):
    metrics = ("context_precision", "context_recall", "answer_faithfulness", "faithfulness")
    return data.table("lineitem").select(
        F.col("l_orderkey").alias("case_id"),
        F.col("l_linenumber").alias("item_no"),
        pick(metrics, F.col("l_partkey") % 4).alias("metric"),
        F.when(F.col("l_quantity") > 25, 1.0).otherwise(0.0).alias("score"),
    )


def _judged_cases(data):
    key = F.col("o_orderkey")
    return data.table("orders").select(
        key.alias("case_id"),
        F.when(key % 7 != 0, "answer").otherwise(" ").alias("answer"),
        F.when(key % 3 != 0, "reference").alias("reference_answer"),
        (key % 4).alias("n_chunks"),
        (key % 4 != 0).alias("has_context"),
    )


@query(
    "claim_metrics",
    f"""
    WITH {VERDICTS}
    SELECT o_orderkey AS case_id, {sql_round("CASE WHEN o_orderkey % 4 = 0 THEN 0.0 ELSE coalesce(p, 0) END", 6)} AS context_precision,
      {sql_round("CASE WHEN o_orderkey % 3 = 0 OR r IS NULL THEN 1.0 WHEN o_orderkey % 4 = 0 THEN 0.0 ELSE r END", 6)} AS context_recall,
      {sql_round("CASE WHEN o_orderkey % 7 = 0 THEN CASE WHEN o_orderkey % 4 = 0 THEN 1.0 ELSE 0.0 END WHEN a IS NULL THEN 1.0 WHEN o_orderkey % 4 = 0 THEN 0.0 ELSE a END", 6)} AS answer_faithfulness,
      {sql_round("CASE WHEN f IS NULL THEN CASE WHEN o_orderkey % 7 = 0 THEN 1.0 ELSE 0.0 END WHEN o_orderkey % 4 = 0 THEN 0.0 ELSE f END", 6)} AS faithfulness
    FROM orders LEFT JOIN m ON case_id = o_orderkey
    """,
)
def _claim_metrics(data):
    scored = evaluation.claim_metrics(_judged_cases(data), _verdicts(data))
    return scored.select("case_id", *[F.round(c, 6).alias(c) for c in scored.columns if c != "case_id"])


@query(
    "no_hallucination",
    f"""
    WITH {VERDICTS}, w AS (SELECT case_id, max(score) AS worst FROM v GROUP BY 1)
    SELECT o_orderkey AS case_id, CASE WHEN o_orderkey % 7 <> 0 AND coalesce(worst, 0) >= 0.5 THEN 0.0 ELSE 1.0 END AS no_hallucination
    FROM orders LEFT JOIN w ON case_id = o_orderkey
    """,
)
def _no_hallucination(data):
    return evaluation.no_hallucination(_judged_cases(data), _verdicts(data))


@query(
    "agent_result_ok",
    f"""
    SELECT user_id AS case_id, {sql_round("avg(CASE WHEN event_id % 11 = 0 OR event_id % 4 = 0 THEN 0.0 ELSE least(greatest(event_id % 8 - 1, 0), 5) / 5.0 END)", 6)} AS tool_result_ok
    FROM events GROUP BY 1
    """,
)
def _agent_result_ok(data):
    n = F.col("event_id")
    runs = data.table("events").select(
        F.col("user_id").alias("case_id"),
        F.when(n % 11 == 0, "boom").alias("error"),
        F.when(n % 4 != 0, "fine").alias("answer"),
        evaluation.likert(n % 8 - 1).alias("verdict"),
    )
    scored = evaluation.agent_result_ok(runs)
    return scored.withColumn("tool_result_ok", F.round("tool_result_ok", 6))


# Test sets --------------------------------------------------------------------------
_LAYERS = """
layers AS (
  SELECT id, 'e2e' AS layer FROM cases WHERE category[1] <> 'G'
  UNION ALL SELECT id, 'rag' FROM cases WHERE category[1] IN ('A', 'B', 'C', 'E') AND reference_answer IS NOT NULL
  UNION ALL SELECT id, 'agent' FROM cases WHERE category[1] IN ('B', 'C', 'D', 'E', 'F', 'G'))
"""


@query("split_layers", f"WITH {CASES}, {_LAYERS} SELECT layer, id FROM layers")
def _split_layers(data):
    return evaluation.tagged_layers(data.cases()).select("layer", "id")


@query(
    "split_layer_counts",
    f"""
    WITH {CASES}, {_LAYERS}
    SELECT layer, category[1] AS bucket, count(*) AS n FROM layers JOIN cases USING (id) GROUP BY 1, 2
    """,
)
def _split_layer_counts(data):
    tagged = evaluation.tagged_layers(data.cases())
    return tagged.groupBy("layer", evaluation.bucket(F.col("category")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "split_agent_fields",
    f"""
    WITH {CASES} SELECT id, category, reference_answer, 0 AS n_tools, CASE WHEN category[1] = 'G' THEN persona END AS expected_chart
    FROM cases WHERE category[1] IN ('B', 'C', 'D', 'E', 'F', 'G')
    """,
)
def _split_agent_fields(data):
    cases = data.cases().withColumns({"expected_tools": F.lit(None).cast("array<string>"), "expected_chart": F.col("persona")})
    agent = evaluation.split_layers(cases)["agent"]
    return agent.select("id", "category", "reference_answer", F.size("expected_tools").alias("n_tools"), "expected_chart")


@query(
    "split_all_fields",
    f"""
    WITH {CASES}, {_LAYERS}
    SELECT layer, id, coalesce(persona, '') AS persona, 0 AS n_history, 0 AS n_tools, 0 AS n_sources, false AS unanswerable, 'none' AS timeframe
    FROM layers JOIN cases USING (id)
    """,
)
def _split_all_fields(data):
    """Every layer with its own fields, from cases that lack most of them."""
    layers = evaluation.split_layers(data.cases())
    rows = None
    for layer, found in layers.items():
        fields = evaluation.LAYER_FIELDS[layer]
        # A field the layer does not have counts like an absent one.
        part = evaluation.complete_cases(found).join(data.cases().select("id", F.col("persona").alias("own")), "id").select(
            F.lit(layer).alias("layer"), "id", F.coalesce("persona" if "persona" in fields else "own", F.lit("")).alias("persona"),
            F.size("history").alias("n_history"), F.greatest(F.size("expected_tools"), F.lit(0)).alias("n_tools"),
            F.greatest(F.size("sources"), F.lit(0)).alias("n_sources"), F.coalesce("unanswerable", F.lit(False)).alias("unanswerable"),
            F.when(F.col("expected_timeframe") == "", "none").otherwise(F.col("expected_timeframe")).alias("timeframe"),
        )
        rows = part if rows is None else rows.unionByName(part)
    return rows


@query(
    "layer_lookup",
    f"""
    WITH {CASES}, {_LAYERS}
    SELECT id, arg_min(layer, CASE layer WHEN 'e2e' THEN 1 WHEN 'agent' THEN 2 ELSE 3 END) AS layer FROM layers GROUP BY 1
    """,
)
def _layer_lookup(data):
    return evaluation.first_layer(evaluation.tagged_layers(data.cases())).select("id", "layer")


@query(
    "merge_batches",
    """
    SELECT doc_id AS id, CASE WHEN lang <> 'en' THEN 'done' ELSE 'raw' END AS origin FROM documents
    """,
)
def _merge_batches(data):
    raw = data.table("documents").select(F.col("doc_id").alias("id"), "lang", F.lit("raw").alias("origin"))
    done = raw.filter("lang <> 'en'").withColumn("origin", F.lit("done"))
    return evaluation.merge_batches(raw, done).drop("lang")


@query(
    "spread_sample",
    f"""
    WITH {CASES}, r AS (
      SELECT id, category[1] AS bucket, row_number() OVER (PARTITION BY category[1] ORDER BY id) - 1 AS position,
             count(*) OVER (PARTITION BY category[1]) AS n FROM cases),
    q AS (SELECT DISTINCT bucket, n, CASE WHEN bucket <= 'E' THEN 7 ELSE 6 END AS k FROM r),
    i AS (SELECT bucket, n, k, unnest(generate_series(0, k - 1)) AS i FROM q),
    t AS (SELECT DISTINCT bucket, CAST(CASE WHEN abs(x - trunc(x)) = 0.5 AND trunc(x) % 2 = 0 THEN trunc(x) ELSE round(x) END AS BIGINT) AS position
          FROM (SELECT bucket, i * (n - 1) / (k - 1) AS x FROM i))
    SELECT bucket, position, id FROM r JOIN t USING (bucket, position)
    """,
)
def _spread_sample(data):
    """59 cases over 9 buckets; ids are cut into blocks of 256 for the ranking."""
    picked = evaluation.spread_sample(data.cases(), 59, F.floor(F.col("seq") / 256))
    return picked.select("bucket", F.col("position").cast("long").alias("position"), "id")
