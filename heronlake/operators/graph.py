"""Two-hop trust over follow edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edges(follow_lists: DataFrame) -> DataFrame:
    """(src, dst) of follow lists (pubkey, items)."""
    return follow_lists.select(F.col("pubkey").alias("src"), F.explode("items").alias("i")).select("src", F.col("i.value").alias("dst"))


def web_of_trust(follows: DataFrame, root, mutes: DataFrame | None = None, include_direct: bool = False) -> DataFrame:
    """Whom the follows of ``root`` follow, less ``mutes`` (one column ``dst``): a column ``dst``.

    The root's own edges are filtered at the scan; the join's small side is
    whatever Spark measures it to be.
    """
    first = follows.where(F.col("src") == root).select(F.col("dst").alias("via")).distinct()
    found = follows.join(first, F.col("src") == F.col("via")).select("dst")
    if include_direct:
        found = found.unionByName(first.select(F.col("via").alias("dst")))
    found = found.distinct()
    return found if mutes is None else found.join(mutes.select("dst").distinct(), "dst", "left_anti")


def needs_refresh(members: int, last_attempt: int | None, now: int, ttl: int = 5 * 86400, few: int = 5, retry: int = 43200) -> bool:
    """A cached set is rebuilt after ``ttl``, or after ``retry`` where it has fewer than ``few`` members."""
    return last_attempt is None or last_attempt < now - ttl or (members < few and last_attempt < now - retry)
