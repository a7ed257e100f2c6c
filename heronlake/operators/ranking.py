"""Weighted popularity and time-decayed relay hints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The keys of relay hints in order, and their base points.
HINT_POINTS = {
    "last_fetch_attempt": -500,
    "most_recent_event_fetched": 700,
    "last_in_relay_list": 350,
    "last_in_tag": 5,
    "last_in_nprofile": 22,
    "last_in_nevent": 8,
    "last_in_nip05": 7,
}
HINT_KEYS = list(HINT_POINTS)


def popularity(items: DataFrame, owner: str = "pubkey", url: str = "url", points: float = 20.0, blocked: DataFrame | None = None) -> DataFrame:
    """(url, score): each owner shares ``points`` among its urls.

    Urls of ``blocked`` (url) are left out; their part of an owner's points is
    lost.  Two aggregations and a join on the owner, no window over it.
    """
    shares = items.groupBy(owner).agg((F.lit(points) / F.count(F.lit(1))).alias("_share"))
    counted = items if blocked is None else items.join(blocked.select(F.col("url").alias(url)), url, "left_anti")
    return counted.join(shares, owner).groupBy(url).agg(F.sum("_share").alias("score"))


def famous(scores: DataFrame, url: str = "url") -> DataFrame:
    """Scores with the most popular first, ties by name."""
    return scores.orderBy(F.col("score").desc(), url)


def export_hints(hints: DataFrame, folder: str) -> None:
    """Write the state of hints as JSON lines."""
    hints.select("pubkey", "relay", "hint_key", "ts").write.mode("overwrite").json(folder)


def import_hints(spark: SparkSession, folder: str) -> DataFrame:
    """Hints as they were exported."""
    return spark.read.schema("pubkey string, relay string, hint_key int, ts long").json(folder)


def save_hints(old: DataFrame, new: DataFrame) -> DataFrame:
    """Hints (pubkey, relay, hint_key, ts): the latest time of each."""
    return old.unionByName(new).groupBy("pubkey", "relay", "hint_key").agg(F.max("ts").alias("ts"))


def decay(points: Column, ts: Column, now: Column | int) -> Column:
    """points * 1e10 / age ** 1.3, the age from a day after now and at least a second."""
    now = F.lit(now) if isinstance(now, int) else now
    return points * F.lit(1e10) / F.pow(F.greatest(now + 86400 - ts, F.lit(1)), 1.3)


def hint_scores(hints: DataFrame, now: int) -> DataFrame:
    """(pubkey, relay, score) of hints (pubkey, relay, hint_key, ts), the key by its number; a time of 0 counts nothing."""
    points = F.get(F.array(*[F.lit(p) for p in HINT_POINTS.values()]), F.col("hint_key"))
    return hints.where("ts <> 0").groupBy("pubkey", "relay").agg(F.sum(decay(points, F.col("ts"), now)).alias("score"))


def top_relays(scores: DataFrame, n: int) -> DataFrame:
    """(pubkey, relay, score, rank) of the best ``n`` relays of each author, ties by name."""
    w = W.partitionBy("pubkey").orderBy(F.col("score").desc(), "relay")
    return scores.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n)


def with_relay_list(hints: DataFrame, relay_lists: DataFrame) -> DataFrame:
    """Fold write relays of lists (pubkey, created_at, items) into hints as ``last_in_relay_list``."""
    key = HINT_KEYS.index("last_in_relay_list")
    new = relay_lists.select("pubkey", "created_at", F.explode("items").alias("i")).where("i.write").select("pubkey", F.col("i.value").alias("relay"), F.lit(key).alias("hint_key"), F.col("created_at").cast("long").alias("ts"))
    return save_hints(hints.select("pubkey", "relay", F.col("hint_key").cast("int").alias("hint_key"), "ts"), new)
