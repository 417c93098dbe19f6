"""Scores, test-set splits and samples. Model verdicts arrive as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.arrays import jaccard
from quarry.functions.numeric import even_positions
from quarry.functions.text import bucket, category_prefix, strip
from quarry.operators.ranking import pick_positions, top_n

# Layers, buckets, tool names and text rules.
LAYERS = ("e2e", "rag", "agent")
LOOKUP_ORDER = ("e2e", "agent", "rag")
RAG_CATEGORIES = ("A.", "B.", "C.", "E.")
AGENT_CATEGORIES = ("B.", "C.", "D.", "E.", "F.", "G.")
CHART_CATEGORY = "G."
BUCKETS = ("A", "B", "C", "D", "E", "F", "G", "H", "I")
TOOL_ALIASES = {"db": "database", "web": "web_search", "viz": "visualize", "chart": "visualize"}
CHART_TOOLS = ("bar", "line", "pie", "chart_from_data")
ADMITS_NOT_KNOWING = "(?iu)không tìm thấy|chưa thu thập|chưa có dữ|không có thông tin"
FOREIGN_SCRIPT = "[぀-ヿㇰ-ㇿ㐀-䶿一-鿿Ѐ-ӿ]"
HEADER_LINE = r"(?m)^\s*#{1,3}\s+\S"
PRECISION_CHUNKS = 5

COMMON_FIELDS = ("id", "question", "history", "category", "reference_answer", "key_facts", "expected_entities", "expected_timeframe")
LAYER_FIELDS = {
    "e2e": (*COMMON_FIELDS, "persona", "scope", "style", "complexity", "expected_tools", "needs_clarification", "negative_facts", "unanswerable"),
    "rag": (*COMMON_FIELDS, "sources", "unanswerable"),
    "agent": (*COMMON_FIELDS, "expected_tools", "expected_chart", "expected_data_facts", "expected_caption_facts"),
}
CHART_FIELDS = ("expected_chart", "expected_data_facts", "expected_caption_facts")
# Types of the case fields that are neither text nor boolean nor a list of texts.
FIELD_TYPES = {
    "history": "array<struct<role: string, content: string>>",
    "expected_chart": (
        "struct<chart_type: array<string>, table: string, x_column: string, y_columns: array<string>,"
        " filters: map<string, string>, order_by: array<array<string>>>"
    ),
    "expected_data_facts": "array<string>",
    "expected_caption_facts": "array<string>",
}
FIELD_DEFAULTS = {
    "category": "", "persona": "", "scope": "", "style": "", "complexity": "", "expected_timeframe": "",
    "needs_clarification": False, "unanswerable": False,
}
LIST_FIELDS = ("key_facts", "negative_facts", "expected_tools", "expected_entities", "sources")


# Test sets ---------------------------------------------------------------------
def complete_cases(cases: DataFrame) -> DataFrame:
    """The cases with every field of every layer; absent ones are null."""

    def kind(name: str) -> str:
        if name in FIELD_TYPES:
            return FIELD_TYPES[name]
        if name in LIST_FIELDS:
            return "array<string>"
        return "boolean" if isinstance(FIELD_DEFAULTS.get(name), bool) else "string"

    names = dict.fromkeys(name for fields in LAYER_FIELDS.values() for name in fields)
    return cases.withColumns({n: F.lit(None).cast(kind(n)) for n in names if n not in cases.columns})


def layer_filter(layer: str) -> Column:
    prefix = category_prefix(F.col("category"))
    if layer == "e2e":
        return prefix != CHART_CATEGORY
    if layer == "rag":
        return prefix.isin(*RAG_CATEGORIES) & F.col("reference_answer").isNotNull()
    return prefix.isin(*AGENT_CATEGORIES)


def _layer_field(cases: DataFrame, layer: str, name: str) -> Column:
    value = F.col(name)
    if name in FIELD_DEFAULTS:
        value = F.coalesce(value, F.lit(FIELD_DEFAULTS[name]))
    elif name in LIST_FIELDS:
        value = F.coalesce(value, F.array().cast("array<string>"))
    elif name == "history":
        value = F.coalesce(value, F.array().cast(cases.schema[name].dataType))
    elif layer == "agent" and name in CHART_FIELDS:
        value = F.when(category_prefix(F.col("category")) == CHART_CATEGORY, value)
    return value.alias(name)


def split_layers(cases: DataFrame) -> dict[str, DataFrame]:
    """The cases of each layer with all of the layer's fields; absent lists and texts are empty."""
    cases = complete_cases(cases)
    return {
        layer: cases.filter(layer_filter(layer)).select(*[_layer_field(cases, layer, f) for f in LAYER_FIELDS[layer]])
        for layer in LAYERS
    }


def tagged_layers(cases: DataFrame) -> DataFrame:
    """One row per case and layer it belongs to, from a single scan."""
    cases = cases if "reference_answer" in cases.columns else cases.withColumn("reference_answer", F.lit(None).cast("string"))
    belongs = F.array(*[F.when(layer_filter(layer), F.lit(layer)) for layer in LAYERS])
    return cases.withColumn("layer", F.explode(F.array_compact(belongs)))


def first_layer(tagged: DataFrame, order: Sequence[str] = LOOKUP_ORDER) -> DataFrame:
    """The case found first when the layers are searched in order."""
    priority = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("layer"))
    return top_n(tagged, ["id"], [priority.asc()], 1)


def union_keep_first(master: DataFrame, extra: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All master cases and those extra ones whose key the master does not have."""
    return master.unionByName(extra.join(master.select(*keys), list(keys), "left_anti"))


def with_cases(results: DataFrame, cases: DataFrame, key: str = "id") -> DataFrame:
    """Captured results beside their test case; ids without a case are skipped."""
    return results.join(cases, key)


def merge_batches(raw: DataFrame, done: DataFrame) -> DataFrame:
    """Enriched records replace the raw ones with the same id."""
    both = raw.withColumn("__done", F.lit(0)).unionByName(done.withColumn("__done", F.lit(1)))
    return top_n(both, ["id"], [F.col("__done").desc()], 1).drop("__done")


def bucket_quota(total: int, buckets: Sequence[str] = BUCKETS) -> dict[str, int]:
    """`total` spread over the buckets; the first ones take the remainder."""
    return {b: (total + len(buckets) - 1 - i) // len(buckets) for i, b in enumerate(buckets)}


def spread_sample(cases: DataFrame, total: int, block: Column, order: str = "id") -> DataFrame:
    """An even pick over the sorted ids of every bucket."""
    quota = F.create_map(*[F.lit(x) for item in bucket_quota(total).items() for x in item])
    grouped = cases.withColumn("bucket", bucket(F.col("category"))).filter(F.col("bucket").isin(*BUCKETS))
    return pick_positions(
        grouped, ["bucket"], [F.col(order)], block, lambda n: even_positions(n, quota[F.col("bucket")]), "position"
    )


def last_attempt(attempts: DataFrame, order: Sequence[Column]) -> DataFrame:
    """The last captured record per test id."""
    return top_n(attempts.filter(F.coalesce("id", F.lit("")) != ""), ["id"], [c.desc() for c in order], 1)


# Scores ------------------------------------------------------------------------
def score_summary(scores: DataFrame) -> DataFrame:
    """Mean per layer and metric, 4 decimals, 0 where nothing is numeric.

    `scores` has `layer` and the map `metrics`.
    """
    long = scores.select("layer", F.explode("metrics").alias("metric", "value"))
    return long.groupBy(F.concat_ws(".", "layer", "metric").alias("metric")).agg(
        F.bround(F.coalesce(F.avg("value"), F.lit(0.0)), 4).alias("mean")
    )


def layer_averages(summary: DataFrame, layers: Sequence[str] = LAYERS) -> DataFrame:
    """Mean of the metric means per layer; 0 for a layer without metrics."""
    layer = F.substring_index("metric", ".", 1)
    means = summary.agg(*[F.coalesce(F.avg(F.when(layer == x, F.col("mean"))), F.lit(0.0)).alias(x) for x in layers])
    pairs = F.explode(F.array(*[F.struct(F.lit(x).alias("layer"), F.col(x).alias("mean")) for x in layers]))
    return means.select(pairs.alias("p")).select("p.layer", "p.mean")


def compare_runs(summaries: DataFrame, runs: Sequence[str]) -> DataFrame:
    """Metric by run, missing values 0, sorted by layer then metric."""
    wide = summaries.groupBy("metric").pivot("run", list(runs)).agg(F.max("mean")).fillna(0.0)
    return wide.orderBy(F.substring_index("metric", ".", 1), "metric")


def mean_or_zero(value: Column | str) -> Column:
    """Null-skipping mean, 0 without values."""
    return F.coalesce(F.avg(value), F.lit(0.0))


# Metrics -----------------------------------------------------------------------
def tool_names(tools: Column) -> Column:
    aliases = F.create_map(*[F.lit(x) for item in TOOL_ALIASES.items() for x in item])
    folded = F.filter(F.transform(tools, lambda t: F.lower(strip(t))), lambda t: F.length(t) > 0)
    return F.transform(folded, lambda t: F.coalesce(F.element_at(aliases, t), t))


def tool_selection(expected: Column, actual: Column) -> Column:
    """Overlap of expected and used tools after resolving aliases."""
    return jaccard(tool_names(expected), tool_names(actual))


def last_chart_call(calls: DataFrame) -> DataFrame:
    """The last chart call of a visualize run per case.

    `calls` holds `(case_id, pos, tool_type, tool, table, y_columns)`.
    """
    charts = calls.filter((F.col("tool_type") == "visualize") & F.col("tool").isin(*CHART_TOOLS))
    return top_n(charts, ["case_id"], [F.col("pos").desc()], 1)


def chart_metrics(cases: DataFrame, calls: DataFrame) -> DataFrame:
    """Accuracy of chart type, table and value columns per case.

    Without a call all are 0, but a case that expects no table scores 1 on it.
    """
    call = last_chart_call(calls).select(
        "case_id", "tool", F.col("table").alias("actual_table"), F.col("y_columns").alias("actual_y")
    )
    none = F.array().cast("array<string>")
    no_call = F.col("tool").isNull()
    type_ok = F.array_contains(F.coalesce("chart_type", none), F.coalesce("tool", F.lit("")))
    table_ok = F.coalesce(F.col("actual_table") == F.col("table"), F.lit(False))
    no_table = F.coalesce("table", F.lit("")) == ""
    overlap = jaccard(F.coalesce("y_columns", none), F.coalesce("actual_y", none))
    return cases.join(call, "case_id", "left").select(
        "case_id",
        type_ok.cast("double").alias("chart_type_acc"),
        F.when(no_table, 1.0).otherwise(table_ok.cast("double")).alias("table_acc"),
        F.when(no_call, 0.0).otherwise(overlap).alias("column_acc"),
    )


def chart_success(runs: DataFrame, calls: DataFrame) -> DataFrame:
    """Share of visualize runs per case with a good call that returned a link."""
    result = F.lower(F.coalesce("result", F.lit("")))
    linked = F.col("ok") & (F.contains(result, F.lit("http")) | F.contains(result, F.lit("minio")))
    good = calls.groupBy("run_id").agg(F.max(F.coalesce(linked, F.lit(False))).alias("linked"))
    judged = runs.join(good, "run_id", "left")
    passed = F.coalesce("linked", F.lit(False)) & (F.coalesce("error", F.lit("")) == "")
    share = F.avg(F.when(F.col("tool_type") == "visualize", passed.cast("double")))
    return judged.groupBy("case_id").agg(F.coalesce(share, F.lit(0.0)).alias("tool_result_ok"))


def context_diversity(chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct over all non-blank file names; 0 without any.

    Files are counted per name first, so a name with very many chunks is
    already one row when the distinct names are counted.
    """
    name = F.nullif(strip(F.coalesce("file_name", F.lit(""))), F.lit(""))
    by_name = chunks.groupBy(*keys, name.alias("__name")).agg(F.count(F.lit(1)).alias("__n"))
    filled = F.col("__name").isNotNull()
    share = F.try_divide(F.count_if(filled), F.sum(F.when(filled, F.col("__n"))))
    return by_name.groupBy(*keys).agg(F.coalesce(share, F.lit(0.0)).alias("context_diversity"))


def citation_validity(answer: Column, sources: Column) -> Column:
    """Share of `[n]` marks that name a source; 1 without marks, 0 without sources."""
    marks = F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1))
    valid = F.filter(marks, lambda m: F.coalesce(F.array_contains(sources, m.try_cast("int")), F.lit(False)))
    return (
        F.when(F.size(marks) == 0, 1.0)
        .when(F.size(sources) == 0, 0.0)
        .otherwise(F.size(valid) / F.greatest(F.size(marks), F.lit(1)))
    )


def language_clean(answer: Column) -> Column:
    """0.6 without foreign script plus 0.4 without header lines; 0 for an empty answer."""
    clean = F.when(~answer.rlike(FOREIGN_SCRIPT), 0.6).otherwise(0.0)
    plain = F.when(~answer.rlike(HEADER_LINE), 0.4).otherwise(0.0)
    return F.when(F.coalesce(F.length(answer), F.lit(0)) == 0, 0.0).otherwise(F.round(clean + plain, 2))


def correctness(answer: Column, reference: Column, verdict: Column) -> Column:
    """Blank answers fail; without a reference only admitting ignorance passes."""
    blank = F.coalesce(strip(answer), F.lit("")) == ""
    return (
        F.when(blank, 0.0)
        .when(reference.isNull(), answer.rlike(ADMITS_NOT_KNOWING).cast("double"))
        .otherwise(verdict.cast("double"))
    )


def claim_means(verdicts: DataFrame) -> DataFrame:
    """Mean verdict and number of items per case and metric; precision uses its first 5 items."""
    counted = (F.col("metric") != "context_precision") | (F.col("item_no") < PRECISION_CHUNKS)
    return verdicts.filter(counted).groupBy("case_id", "metric").agg(
        F.avg("score").alias("mean"), F.count(F.lit(1)).alias("items")
    )


def claim_metrics(cases: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Precision, recall and both faithfulness scores per case, with their empty-input rules.

    `cases` holds `case_id, answer, reference_answer, n_chunks, has_context`.
    """
    means = claim_means(verdicts).groupBy("case_id").pivot(
        "metric", ["context_precision", "context_recall", "answer_faithfulness", "faithfulness"]
    ).agg(F.max("mean"))
    joined = cases.join(means, "case_id", "left")
    blank = F.coalesce(strip(F.col("answer")), F.lit("")) == ""
    no_chunks = F.col("n_chunks") == 0
    precision = F.when(no_chunks, 0.0).otherwise(F.coalesce("context_precision", F.lit(0.0)))
    recall = (
        F.when(F.coalesce("reference_answer", F.lit("")) == "", 1.0)
        .when(F.col("context_recall").isNull(), 1.0)
        .when(no_chunks, 0.0)
        .otherwise(F.col("context_recall"))
    )
    rag_faith = (
        F.when(blank, F.when(no_chunks, 1.0).otherwise(0.0))
        .when(F.col("answer_faithfulness").isNull(), 1.0)
        .when(~F.col("has_context"), 0.0)
        .otherwise(F.col("answer_faithfulness"))
    )
    e2e_faith = (
        F.when(F.col("faithfulness").isNull(), F.when(blank, 1.0).otherwise(0.0))
        .when(~F.col("has_context"), 0.0)
        .otherwise(F.col("faithfulness"))
    )
    return joined.select(
        "case_id",
        precision.alias("context_precision"),
        recall.alias("context_recall"),
        rag_faith.alias("answer_faithfulness"),
        e2e_faith.alias("faithfulness"),
    )


def no_hallucination(cases: DataFrame, verdicts: DataFrame) -> DataFrame:
    """0 when any negative fact was endorsed; blank answers and cases without facts score 1."""
    worst = verdicts.groupBy("case_id").agg(F.max("score").alias("__worst"))
    blank = F.coalesce(strip(F.col("answer")), F.lit("")) == ""
    endorsed = ~blank & (F.coalesce("__worst", F.lit(0.0)) >= 0.5)
    return cases.join(worst, "case_id", "left").select(
        "case_id", F.when(endorsed, 0.0).otherwise(1.0).alias("no_hallucination")
    )


def likert(score: Column) -> Column:
    """A 0 to 5 grade as a share; unreadable grades are 0."""
    grade = F.coalesce(score.cast("string").try_cast("int"), F.lit(0))
    return F.least(F.greatest(grade, F.lit(0)), F.lit(5)) / F.lit(5.0)


def agent_result_ok(runs: DataFrame) -> DataFrame:
    """Mean verdict per case; failed runs and blank answers count as 0."""
    failed = (F.coalesce("error", F.lit("")) != "") | (F.coalesce(strip(F.col("answer")), F.lit("")) == "")
    score = F.when(failed, 0.0).otherwise(F.col("verdict").cast("double"))
    return runs.groupBy("case_id").agg(mean_or_zero(score).alias("tool_result_ok"))
