"""The filter language: a conjunction of value lists and a time range, newest first, with a limit."""

from __future__ import annotations

import operator
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronlake.functions.scalars import decode_pointer
from heronlake.operators.schema import identifier, kind_is_addressable, kind_is_replaceable

MAX_LIMIT = 2500
#: Above so many values a list becomes a semi join.
MANY = 1000


@dataclass(frozen=True)
class Filter:
    """None is no condition; an empty list matches nothing.  Tag conditions are by letter: all letters must match, any value does."""

    ids: Sequence[str] | None = None
    authors: Sequence[str] | None = None
    kinds: Sequence[int] | None = None
    tags: Mapping[str, Sequence[str]] = field(default_factory=dict)
    since: int | None = None
    until: int | None = None
    limit: int | None = None

    @classmethod
    def of(cls, raw: Mapping) -> Filter:
        """From a plain mapping with ``#x`` keys; unknown keys are ignored and only the first letter of a tag key counts."""
        tags = {k[1]: v for k, v in raw.items() if len(k) > 1 and k[0] == "#" and v is not None}
        return cls(**{k: raw.get(k) for k in ("ids", "authors", "kinds", "since", "until", "limit")}, tags=tags)

    def capped(self, most: int = MAX_LIMIT) -> int:
        """The rows to return: the limit, at most ``most``; 0 and None stand for ``most``."""
        return min(self.limit or most, most)

    def tightened(self, most: int = MAX_LIMIT) -> int:
        """The limit after uniqueness: replaceable kinds have a row for each author and kind, addressable ones for each identifier too."""
        n = self.capped(most)
        if self.authors is not None and self.kinds:
            pairs = len(set(self.authors)) * len(set(self.kinds))
            if all(map(kind_is_replaceable, self.kinds)):
                n = min(n, pairs)
            elif "d" in self.tags and all(map(kind_is_addressable, self.kinds)):
                n = min(n, pairs * len(set(self.tags["d"])))
        return n


def _has_tag(letter: str, values: Sequence[str]) -> Column:
    if letter == "d":
        # The first d tag identifies an addressable event.
        found = identifier(F.col("tags")).isin(list(values))
        return found & F.exists("tags", lambda t: F.get(t, F.lit(0)) == "d")
    return F.exists("tags", lambda t: (F.get(t, F.lit(0)) == letter) & F.get(t, F.lit(1)).isin(list(values)))


def predicate(f: Filter) -> Column:
    """The filter as one condition; simple comparisons reach the Parquet scan.  With ids, nothing else counts."""
    if f.ids is not None:
        return F.col("id").isin(list(f.ids)) if f.ids else F.lit(False)
    parts = [F.lit(True)]
    for name, values in (("pubkey", f.authors), ("kind", f.kinds)):
        if values is not None:
            parts.append(F.col(name).isin(list(values)) if len(values) else F.lit(False))
    parts += [_has_tag(k, v) if len(v) else F.lit(False) for k, v in f.tags.items()]
    if f.since is not None:
        parts.append(F.col("created_at") >= f.since)
    if f.until is not None:
        parts.append(F.col("created_at") <= f.until)
    return reduce(operator.and_, parts[1:], parts[0]) if len(parts) > 1 else parts[0]


def matching(events: DataFrame, f: Filter) -> DataFrame:
    """All events that a filter matches, in no order.  Long lists of ids or authors become semi joins; Spark broadcasts them by their size."""
    spark = events.sparkSession
    for name, column in (("ids", "id"), ("authors", "pubkey")):
        values = getattr(f, name)
        if values is not None and len(values) > MANY and (name == "ids" or f.ids is None):
            listed = spark.createDataFrame([(v,) for v in dict.fromkeys(values)], f"{column} string")
            rest = Filter() if name == "ids" else replace(f, authors=None)
            return matching(events, rest).join(listed, column, "left_semi") if name != "ids" else events.join(listed, column, "left_semi")
    if "created_day" in events.columns and f.ids is None:
        if f.since is not None:
            events = events.where(F.col("created_day") >= f.since // 86400)
        if f.until is not None:
            events = events.where(F.col("created_day") <= f.until // 86400)
    return events.where(predicate(f))


def query(events: DataFrame, f: Filter, most: int = MAX_LIMIT) -> DataFrame:
    """The newest matching events, ties by id.  A lookup by ids returns all of them in the order given."""
    if f.ids is not None:
        listed = events.sparkSession.createDataFrame([(v, i) for i, v in enumerate(dict.fromkeys(f.ids))], "id string, _at int")
        return events.join(listed, "id").orderBy("_at").drop("_at")
    return matching(events, f).orderBy(F.col("created_at").desc(), "id").limit(f.tightened(most))


def query_any(events: DataFrame, filters: Sequence[Filter], most: int = MAX_LIMIT) -> DataFrame:
    """Events of any of several filters, each once."""
    found = [query(events, f, most) for f in filters]
    return reduce(DataFrame.unionByName, found).dropDuplicates(["id"])


def pointer_filter(code: str) -> tuple[Filter, list[str], str | None]:
    """The filter of a hex id or a bech32 pointer to an event, with its relays and its author; an error for other codes."""
    found = decode_pointer(code)
    if found is None or not ("id" in found or "identifier" in found):
        raise ValueError(f"{code} points to no event")
    relays = found.get("relays", [])
    if "id" in found:
        return Filter(ids=[found["id"]]), relays, found.get("author")
    tags = {"d": [found["identifier"]]} if found["identifier"] else {}
    return Filter(authors=[found["pubkey"]], kinds=[found["kind"]], tags=tags, limit=1), relays, found["pubkey"]
