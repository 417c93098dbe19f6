"""Ordered-group operators that never put a whole hot group into one task.

A plain window over `partitionBy(key)` sorts all rows of a key in one task,
which breaks when one key holds a large share of the table. The operators here
use one of two exact ways round that:

* *first n per group* keeps `row_number() <= n` directly above the window, so
  Spark cuts each map task's rows to n per group before the shuffle;
* *positions* cut every hot group into blocks that follow the sort order. One
  counting pass sums the rows of every block (map-side); which groups are hot and
  where their blocks begin follows from that small table, and rows are only ever
  sorted inside their own block. Groups of ordinary size are one block each.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Groups with more rows than this are cut into blocks.
HOT_ROWS = 1_000_000
# The largest hot groups, which every task is told. A group that is not among them has at
# most this fraction of all rows, so it needs no cutting.
MAX_HOT_GROUPS = 100_000

_BLOCK = "__block"
_GROUP = "__group"


def top_n(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    n: int,
    rank: str | None = None,
) -> DataFrame:
    """The first `n` rows of every group; `order` should be a total order."""
    name = rank or "__rank"
    position = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    kept = df.withColumn(name, position).filter(F.col(name) <= n)
    return kept.withColumn(name, F.col(name).cast("long")) if rank else kept.drop(name)


def _grouped(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    # One struct key: a window and a join on it share the same shuffle, and
    # structs with null fields still compare equal.
    return df.withColumn(_GROUP, F.struct(*keys))


def _block_counts(grouped: DataFrame, block: Column, *more: Column) -> DataFrame:
    """Rows, and `more` sums, of every block of every group: the one counting pass."""
    return grouped.groupBy(_GROUP, block.alias("__b")).agg(F.count(F.lit(1)).alias("__rows"), *more)


def _hot_groups(counts: DataFrame, hot_rows: int) -> DataFrame:
    totals = counts.groupBy(_GROUP).agg(F.sum("__rows").alias("__rows")).filter(F.col("__rows") > hot_rows)
    largest = totals.orderBy(F.col("__rows").desc(), _GROUP).limit(MAX_HOT_GROUPS)
    return largest.select(_GROUP, F.lit(True).alias("__hot"))


def _with_block(rows: DataFrame, hot: DataFrame, block: Column) -> DataFrame:
    """Add the block of every row; a group that is not hot is one block."""
    is_hot = F.coalesce("__hot", F.lit(False))
    cut = F.struct(F.col(_GROUP).alias("group"), is_hot.alias("hot"), F.when(is_hot, block).alias("block"))
    return rows.join(F.broadcast(hot), _GROUP, "left").withColumn(_BLOCK, cut).drop("__hot")


def _in_hot_groups(blocked: DataFrame) -> DataFrame:
    """Rows that have other blocks of their group beside them."""
    return blocked.filter(F.col(f"{_BLOCK}.hot"))


def _block_sizes(counted: DataFrame) -> DataFrame:
    """One row per block: its size, the rows before it, the rows in the group."""
    in_order = Window.partitionBy(_GROUP).orderBy(f"{_BLOCK}.block")
    whole = Window.partitionBy(_GROUP)
    return (
        counted.groupBy(_GROUP, _BLOCK)
        .agg(F.sum("__rows").alias("__rows"))
        .withColumn("__before", F.sum("__rows").over(in_order) - F.col("__rows"))
        .withColumn("__total", F.sum("__rows").over(whole))
    )


def group_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], block: Column, name: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Add the 1-based position of every row inside its group.

    `block` must never decrease along `order` and should hold a bounded number
    of rows, for instance `floor(sequence / 100000)` or the day of a timestamp.
    It only matters for groups of more than `hot_rows` rows.
    """
    grouped = _grouped(df, keys)
    counts = _block_counts(grouped, block)
    hot = _hot_groups(counts, hot_rows)
    blocked = _with_block(grouped, hot, block)
    before = _block_sizes(_in_hot_groups(_with_block(counts, hot, F.col("__b")))).select(_BLOCK, "__before")
    local = F.row_number().over(Window.partitionBy(_BLOCK).orderBy(*order))
    return (
        blocked.withColumn("__local", local)
        .join(before, _BLOCK, "left")
        .withColumn(name, F.coalesce("__before", F.lit(0).cast("long")) + F.col("__local"))
        .drop(_BLOCK, _GROUP, "__before", "__local")
    )


def pick_positions(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    block: Column,
    wanted: Callable[[Column], Column],
    name: str,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Rows at chosen 0-based positions of every group.

    `wanted` maps the group size to an array of positions and may also use the
    key columns. Only blocks that hold a chosen position are ever sorted.
    """
    grouped = _grouped(df, keys)
    counts = _block_counts(grouped, block)
    hot = _hot_groups(counts, hot_rows)
    blocked = _with_block(grouped, hot, block)
    key_columns = [F.col(f"{_GROUP}.{k}").alias(k) for k in keys]
    targets = (
        _block_sizes(_with_block(counts, hot, F.col("__b")))
        .select("*", *key_columns)
        .withColumn("__want", wanted(F.col("__total")))
        .withColumn(
            "__want",
            F.filter(
                F.array_distinct("__want"),
                lambda p: (p >= F.col("__before")) & (p < F.col("__before") + F.col("__rows")),
            ),
        )
        .select(_BLOCK, "__before", F.explode("__want").alias(name))
        .select(_BLOCK, name, (F.col(name) - F.col("__before") + 1).cast("int").alias("__local"))
    )
    local = F.row_number().over(Window.partitionBy(_BLOCK).orderBy(*order))
    return (
        blocked.join(targets.select(_BLOCK).distinct(), _BLOCK, "left_semi")
        .withColumn("__local", local)
        .join(targets, [_BLOCK, "__local"])
        .drop(_BLOCK, _GROUP, "__local")
    )


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, share: float, accuracy: int = 10_000, small: int = 100_000) -> DataFrame:
    """The value at 0-based position floor(share * (n - 1)) of every group, exactly; nulls do not count.

    Mergeable sketches give two bounds per group between which the position lies for
    certain. Rows below the bounds are only counted; those between them, about
    4 / `accuracy` of the group, are summed per value before they are shuffled, and the value is
    selected on the running counts. A value that very many rows have is one weighted row.
    """
    grouped = _grouped(df, keys).filter(F.col(value).isNotNull()).select(_GROUP, F.col(value).alias("__value"))
    margin = 2.0 / accuracy
    shares = F.lit([max(0.0, share - margin), min(1.0, share + margin)])
    bounds = grouped.groupBy(_GROUP).agg(F.count(F.lit(1)).alias("__n"), F.approx_percentile("__value", shares, accuracy).alias("__ends"))
    # In a small group the margin is less than a row, so it is taken whole.
    large = F.col("__n") > small
    low = F.when(large & F.lit(share > margin), F.get("__ends", 0))
    high = F.when(large & F.lit(share < 1 - margin), F.get("__ends", 1))
    bounded = grouped.join(bounds.select(_GROUP, "__n", low.alias("__low"), high.alias("__high")), _GROUP)
    below = F.coalesce(F.col("__value") < F.col("__low"), F.lit(False))
    # What lies below is one weighted row without a value, which comes first.
    at = F.when(~below, F.col("__value"))
    near = bounded.filter(below | F.coalesce(F.col("__value") <= F.col("__high"), F.lit(True)))
    weights = near.groupBy(_GROUP, at.alias("__value")).agg(F.count(F.lit(1)).alias("__weight"), F.first("__n").alias("__n"))
    upto = F.sum("__weight").over(Window.partitionBy(_GROUP).orderBy(F.col("__value").asc_nulls_first()))
    target = F.floor(F.lit(share) * (F.col("__n") - 1))
    found = weights.withColumn("__upto", upto).filter((F.col("__upto") > target) & (F.col("__upto") - F.col("__weight") <= target))
    return found.select(*[F.col(f"{_GROUP}.{k}").alias(k) for k in keys], F.col("__value").alias(value))


def next_marker(
    df: DataFrame, keys: Sequence[str], order: str, block: Column, markers: Mapping[str, Column], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Add, per marker, the `order` value of the first such row after each row of a group."""
    grouped = _grouped(df, keys)
    for name, marker in markers.items():
        grouped = grouped.withColumn(f"__mark_{name}", F.when(marker, F.col(order)))
    firsts = [F.min(f"__mark_{name}").alias(f"__first_{name}") for name in markers]
    counts = _block_counts(grouped, block, *firsts)
    hot = _hot_groups(counts, hot_rows)
    blocked = _with_block(grouped, hot, block)
    later = (
        Window.partitionBy(_GROUP)
        .orderBy(F.col(f"{_BLOCK}.block").desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    following = (
        _in_hot_groups(_with_block(counts, hot, F.col("__b")))
        .select(_BLOCK, *[F.min(f"__first_{name}").over(later).alias(f"__later_{name}") for name in markers])
    )
    # Descending order with a growing frame: linear, unlike a shrinking frame.
    after = (
        Window.partitionBy(_BLOCK)
        .orderBy(F.col(order).desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    near = {f"__near_{name}": F.min(f"__mark_{name}").over(after) for name in markers}
    found = {name: F.coalesce(f"__near_{name}", f"__later_{name}") for name in markers}
    helpers = [f"__{kind}_{name}" for kind in ("mark", "near", "later") for name in markers]
    return blocked.withColumns(near).join(following, _BLOCK, "left").withColumns(found).drop(_BLOCK, _GROUP, *helpers)


def previous_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    block: Column,
    n: int,
    value: Column,
    name: str,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add `value` of the up to `n` rows before each row of a group, oldest first.

    Rows are only windowed inside their block; blocks of hot groups also receive
    the last `n` values before them, from a table of at most `n` rows a block.
    """
    grouped = _grouped(df, keys)
    blocked = _with_block(grouped, _hot_groups(_block_counts(grouped, block), hot_rows), block).withColumn("__value", value)
    hot = _in_hot_groups(blocked).select(_GROUP, _BLOCK, F.col(order).alias("__at"), "__value")
    tails = (
        top_n(hot, [_BLOCK], [F.col("__at").desc()], n)
        .groupBy(_GROUP, _BLOCK)
        .agg(F.array_sort(F.collect_list(F.struct("__at", "__value"))).alias("__tail"))
    )
    # Every block has a row, so n blocks hold the n values wanted.
    blocks_before = Window.partitionBy(_GROUP).orderBy(f"{_BLOCK}.block").rowsBetween(-n, -1)
    earlier = F.transform(F.flatten(F.collect_list("__tail").over(blocks_before)), lambda e: e["__value"])
    carried = tails.select(_BLOCK, earlier.alias("__earlier"))
    near = F.collect_list("__value").over(Window.partitionBy(_BLOCK).orderBy(order).rowsBetween(-n, -1))
    both = F.when(F.col("__earlier").isNull(), F.col("__near")).otherwise(F.concat("__earlier", "__near"))
    return (
        blocked.withColumn("__near", near)
        .join(carried, _BLOCK, "left")
        .withColumn(name, F.slice(both, F.greatest(F.size(both) - n + 1, F.lit(1)), n))
        .drop(_BLOCK, _GROUP, "__value", "__near", "__earlier")
    )
