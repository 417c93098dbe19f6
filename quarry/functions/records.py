"""Clean-up of model outputs that arrive as table rows: rewrites and plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import coerce_list, strip
from quarry.operators.ranking import top_n

# Accepted names and the fallback question.
SCOPES = ("company", "sector", "macro", "general")
CLARIFICATION_FALLBACK = (
    "Bạn có thể nói rõ hơn về đối tượng (công ty, ngành hay vĩ mô) mà bạn đang muốn hỏi không ạ?"
)
TOOL_SWITCH = {"web_search": "web_search", "database": "database_query", "visualize": "visualize"}


def normalize_rewrites(records: DataFrame, passages: int | None = None) -> DataFrame:
    """Repair rewrite records: known scope, clean lists and texts, consistent flags.

    Passages only make sense for a clear question, suggestions only for an
    unclear one. `passages` keeps the first of them, 0 switches them off.
    """
    none = F.array().cast("array<string>")
    unclear = F.coalesce("needs_clarification", F.lit(False))
    given = strip(F.coalesce("rewritten", F.lit("")))
    rewritten = F.when(~unclear & (given == ""), F.col("user_text")).otherwise(given)
    asked = strip(F.coalesce("clarification", F.lit("")))
    clarification = F.when(unclear & (asked == ""), CLARIFICATION_FALLBACK).otherwise(asked)
    scope = F.lower(strip(F.coalesce("scope_type", F.lit(""))))
    known = F.when(scope.isin(*SCOPES), scope).otherwise("")
    entities = coerce_list(F.coalesce("preserved_entities", none))
    guess = F.when(F.size(entities) > 0, "company").otherwise("general")
    kept_passages = coerce_list(F.coalesce("hypothetical_passages", none), passages)
    suggestions = coerce_list(F.coalesce("clarification_suggestions", none))
    return records.withColumns(
        {
            "rewritten": rewritten,
            "needs_clarification": unclear,
            "clarification": clarification,
            "scope_type": F.when(~unclear & (rewritten != "") & (known == ""), guess).otherwise(known),
            "preserved_entities": entities,
            "hypothetical_passages": F.when(unclear, none).otherwise(kept_passages),
            "clarification_suggestions": F.when(unclear, suggestions).otherwise(none),
        }
    )


def distinct_matches(matches: DataFrame) -> DataFrame:
    """Looked-up companies per record, first one of each symbol."""
    named = matches.filter(F.coalesce("symbol", F.lit("")) != "")
    return top_n(named, ["record_id", "symbol"], [F.col("pos").asc()], 1)


def plan_tasks(tasks: Column, enabled: Column) -> Column:
    """Tasks of a known tool type that the session has switched on.

    `tasks` is an array of structs with `tool_type`, `enabled` an array of names.
    """
    switch = F.create_map(*[F.lit(x) for item in TOOL_SWITCH.items() for x in item])
    return F.filter(
        tasks, lambda t: F.coalesce(F.array_contains(enabled, switch[F.lower(strip(t["tool_type"]))]), F.lit(False))
    )
