"""Latest-version reads over append-only tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.ranking import top_n


def latest_version(
    df: DataFrame,
    keys: Sequence[str],
    version: str | None = None,
    tie: Sequence[str | Column] = (),
    partitions: int = 0,
) -> DataFrame:
    """The newest row per key.

    Highest `version` wins; equal versions are settled by `tie`, highest first
    (normally the load sequence, so that the last row inserted wins). Filters on
    the keys are pushed below this by Catalyst, filters on other columns are
    not, so an old version can never come back.

    The reading tasks cut their rows to one per key before the shuffle, for which each sorts all it reads. With
    `partitions` rows are shuffled by key first and sorted once, in so many partitions or those of the session if these
    are more: for wide rows, of which a task reads more than it can hold, and keys of few versions.
    """
    columns = ([F.col(version)] if version else []) + [F.col(t) if isinstance(t, str) else t for t in tie]
    if not columns:
        raise ValueError("latest_version needs a version or a tie column")
    if partitions:
        usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        df = df.repartition(*([partitions] if partitions > usual else []), *keys)
    return top_n(df, keys, [c.desc_nulls_last() for c in columns], 1)


@dataclass(frozen=True)
class Table:
    """A table and, where rows replace each other, its key and version columns."""

    df: DataFrame
    keys: tuple[str, ...] = ()
    version: str | None = None
    tie: tuple[str, ...] = field(default=())
    partitions: int = 0

    def read(self, final: bool = True) -> DataFrame:
        if final and self.keys:
            return latest_version(self.df, self.keys, self.version, self.tie, self.partitions)
        return self.df
