"""The newest row of each key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heronlake.operators.schema import EVENT_COLUMNS, identity


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row of each key, the largest by ``order``: an aggregate, so that each task sends one row for each key."""
    best = rows.groupBy(*keys).agg(F.max(F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)], F.struct(*rows.columns).alias("row"))).alias("best"))
    return best.select("best.row.*")


def newest(rows: DataFrame, keys: Sequence[str], time: str = "created_at", tie: str = "id") -> DataFrame:
    """One row of each key: the latest, ties to the smallest id."""
    columns = rows.columns
    best = rows.groupBy(*keys).agg(F.max(time).alias("_time"), F.min_by(F.struct(*columns), F.struct((-F.col(time)).alias("t"), F.col(tie).alias("i"))).alias("_row"))
    return best.select(*[F.col("_row")[c].alias(c) for c in columns])


def per_key(rows: DataFrame, keys: Sequence[str], n: int, time: str = "created_at", tie: str = "id") -> DataFrame:
    """The newest ``n`` rows of each key."""
    w = W.partitionBy(*keys).orderBy(F.col(time).desc(), tie)
    return rows.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def surviving(events: DataFrame, arrival: str = "_arrival") -> DataFrame:
    """What a store holds after saving events in their order of arrival.

    Equal ids count once, the first.  Of replaceable and addressable events the
    newest stays and an equal time doesn't replace.
    """
    keys = identity(events)
    rank = F.struct((-F.col("created_at")).alias("t"), F.col(arrival).alias("a"), F.col("id").alias("i"))
    columns = [*[c for c in EVENT_COLUMNS if c in events.columns], arrival]
    best = events.select(*keys, F.struct(*columns).alias("_row"), rank.alias("_rank")).groupBy("_id", "_pubkey", "_kind", "_d").agg(F.min_by("_row", "_rank").alias("_row"))
    return best.select(*[F.col("_row")[c].alias(c) for c in columns])
