"""The event table: schema, kind classes and derived columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heronlake.functions.scalars import tag_value

TAGS = T.ArrayType(T.ArrayType(T.StringType()))
EVENT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("pubkey", T.StringType()),
        T.StructField("kind", T.IntegerType()),
        T.StructField("created_at", T.LongType()),
        T.StructField("sig", T.StringType()),
        T.StructField("tags", TAGS),
        T.StructField("content", T.StringType()),
        T.StructField("seen_on", T.ArrayType(T.StringType())),
    ]
)
EVENT_COLUMNS = [f.name for f in EVENT_SCHEMA]
MAX_KIND, MAX_TIME = 0xFFFF, 0xFFFFFFFF


def is_replaceable(kind: Column) -> Column:
    """One event for each author and kind."""
    return kind.isin(0, 3) | kind.between(10000, 19999)


def is_addressable(kind: Column) -> Column:
    """One event for each author, kind and identifier."""
    return kind.between(30000, 39999)


def kind_is_replaceable(kind: int) -> bool:
    return kind in (0, 3) or 10000 <= kind <= 19999


def kind_is_addressable(kind: int) -> bool:
    return 30000 <= kind <= 39999


def identifier(tags: Column) -> Column:
    """The first ``d`` tag's value; empty without one."""
    return F.coalesce(tag_value(tags, "d"), F.lit(""))


def identity(events: DataFrame) -> list[Column]:
    """Columns of which a stored event is unique: the id, or the author and kind, with the identifier for addressable kinds."""
    one = is_replaceable(F.col("kind"))
    many = is_addressable(F.col("kind"))
    return [
        F.when(~one & ~many, F.col("id")).alias("_id"),
        F.when(one | many, F.col("pubkey")).alias("_pubkey"),
        F.when(one | many, F.col("kind")).alias("_kind"),
        F.when(many, identifier(F.col("tags"))).alias("_d"),
    ]


def with_derived(events: DataFrame) -> DataFrame:
    """Add what the layout on disk uses: ``d`` and the day of creation."""
    return events.withColumns({"d": F.when(is_addressable(F.col("kind")), identifier(F.col("tags"))), "created_day": (F.col("created_at") / 86400).cast("int")})


def valid(events: DataFrame) -> DataFrame:
    """Events with a kind and a time within their bounds and an id that is not all zeros."""
    return events.where(F.col("kind").between(0, MAX_KIND) & F.col("created_at").between(0, MAX_TIME) & (F.col("id") != "0" * 64))
