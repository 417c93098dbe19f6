"""Set similarity and clean-up of lists and maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import first_of, strip, unique_by


def string_set(values: Column) -> Column:
    """Trimmed, lower case, non-blank, distinct."""
    return F.array_distinct(F.filter(F.transform(values, lambda v: F.lower(strip(v))), lambda v: F.length(v) > 0))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two string lists taken as sets: both empty 1, one empty 0."""
    left, right = string_set(a), string_set(b)
    shared = F.size(F.array_intersect(left, right))
    union = F.size(F.array_union(left, right))
    return F.when(union == 0, F.lit(1.0)).otherwise(shared / F.greatest(union, F.lit(1)))


def first_spellings(words: Column) -> Column:
    """Words without those that came before in any case, in order. Takes sorting, no comparison of all pairs."""
    placed = F.array_sort(F.transform(words, lambda w, at: F.struct(F.lower(w).alias("k"), at.alias("pos"), w.alias("word"))))
    # Inside a list of one, so that the sorted words are a variable and are sorted once.
    new = F.transform(F.array(placed), lambda own: F.filter(own, lambda e, i: (i == 0) | (F.get(own, i - 1)["k"] != e["k"])))[0]
    return F.transform(F.array_sort(F.transform(new, lambda e: F.struct(e["pos"], e["word"]))), lambda e: e["word"])


def clean_sparse(weights: Column) -> Column:
    """Sparse vector with integer keys; bad entries dropped, never empty.

    `weights` maps text to text. An empty vector becomes one negligible entry,
    because a sparse index cannot hold an empty one.
    """
    entries = F.transform(
        F.map_entries(weights),
        lambda e: F.struct(
            e["key"].try_cast("int").alias("key"), e["value"].cast("string").try_cast("double").alias("value")
        ),
    )
    good = F.filter(entries, lambda e: e["key"].isNotNull() & e["value"].isNotNull())
    # Of keys that become equal as integers ("1", "01") the last one counts.
    good = unique_by(F.reverse(good), lambda e: e["key"])
    return F.when(F.size(good) > 0, F.map_from_entries(good)).otherwise(
        F.create_map(F.lit(0), F.lit(1e-9))
    )


def query_list(original: Column, rewritten: Column, passages: Column, clarify: Column, cap: int | None = None) -> Column:
    """Texts to search with: the rewrite, then distinct passages; only the original when unclear."""
    base = F.when(clarify | (F.coalesce(rewritten, F.lit("")) == ""), original).otherwise(rewritten)
    extra = F.when(clarify, F.array().cast("array<string>")).otherwise(
        F.transform(F.coalesce(passages, F.array().cast("array<string>")), strip)
    )
    texts = F.array_distinct(F.concat(F.array(base), extra))
    filled = F.filter(texts, lambda t: F.length(F.coalesce(t, F.lit(""))) > 0)
    none = F.array().cast("array<string>")
    return F.when(F.length(F.coalesce(base, F.lit(""))) > 0, first_of(filled, cap)).otherwise(none)


def useful_positions(raw: Column, chunks: Column) -> Column:
    """Integers 1..chunks out of a list of texts, distinct, in order."""
    numbers = F.transform(raw, lambda v: v.try_cast("int"))
    return F.array_distinct(F.filter(numbers, lambda n: (n >= 1) & (n <= chunks)))


def verdict(decision: Column, useful: Column, chunks: Column) -> Column:
    """Known decision or `partial`; support without chunks or positions is downgraded."""
    known = F.when(decision.isin("sufficient", "partial", "insufficient"), decision).otherwise("partial")
    return (
        F.when(chunks == 0, "insufficient")
        .when((known == "sufficient") & (F.size(useful) == 0), "partial")
        .otherwise(known)
    )
