"""Incremental synchronisation by the oldest and newest time known of each author and kind."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OVERLAP = 7200
PAGE = 200


def bounds_of(events: DataFrame) -> DataFrame:
    """(pubkey, kind, oldest, newest) of events."""
    return events.groupBy("pubkey", "kind").agg(F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"))


def raise_bounds(bounds: DataFrame, fetched: DataFrame, asked: DataFrame, now: int) -> DataFrame:
    """Bounds after a catch-up: of every asked (pubkey, kind) the newest is now; the oldest falls to what was fetched."""
    new = asked.join(bounds_of(fetched).drop("newest"), ["pubkey", "kind"], "left").withColumn("newest", F.lit(now).cast("long")).withColumn("oldest", F.coalesce("oldest", F.lit(now).cast("long")))
    return bounds.unionByName(new.select(*bounds.columns)).groupBy("pubkey", "kind").agg(F.min("oldest").alias("oldest"), F.max("newest").alias("newest"))


def lower_bounds(bounds: DataFrame, fetched: DataFrame) -> DataFrame:
    """Bounds after a page of older events."""
    return bounds.unionByName(bounds_of(fetched).select(*bounds.columns)).groupBy("pubkey", "kind").agg(F.min("oldest").alias("oldest"), F.max("newest").alias("newest"))


def _asked(bounds: DataFrame, kinds: Sequence) -> DataFrame:
    return bounds.where(F.col("kind").isin(list(kinds)))


def synced_up_to(bounds: DataFrame, kinds: Sequence) -> DataFrame:
    """(pubkey, synced): the least newest time of all kinds; null where a kind is missing."""
    n = len(set(kinds))
    held = F.when(F.col("kind").isin(list(kinds)), F.col("newest"))
    return bounds.groupBy("pubkey").agg(F.when(F.count(held) == n, F.min(held)).alias("synced"))


def is_synced(bounds: DataFrame, kinds: Sequence, now: int, overlap: int = OVERLAP) -> DataFrame:
    """(pubkey, is_synced): all kinds known to within ``overlap`` seconds of now."""
    return synced_up_to(bounds, kinds).select("pubkey", F.coalesce(F.col("synced") > now - overlap, F.lit(False)).alias("is_synced"))


def backfill_plan(bounds: DataFrame, kinds: Sequence, ts: int) -> DataFrame:
    """(pubkey, need, until): whether events before ``ts`` may be missing, and from where to page back."""
    n = len(set(kinds))
    asked = F.col("kind").isin(list(kinds))
    late = F.when(asked & (F.col("oldest") >= ts), F.col("oldest"))
    plan = bounds.groupBy("pubkey").agg(F.count(F.when(asked, 1)).alias("_n"), F.max(late).alias("until"))
    return plan.select("pubkey", ((F.col("_n") < n) | F.col("until").isNotNull()).alias("need"), "until")


def page_before(events: DataFrame, plan: DataFrame, kinds: Sequence, page: int = PAGE) -> DataFrame:
    """The newest ``page`` events of each author at or before its ``until``."""
    w = W.partitionBy("pubkey").orderBy(F.col("created_at").desc(), "id")
    due = events.where(F.col("kind").isin(list(kinds))).join(plan.where("need").select("pubkey", "until"), "pubkey")
    return due.where("until is null or created_at <= until").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= page).drop("_r", "until")


def due_authors(bounds: DataFrame, authors: DataFrame, kinds: Sequence, now: int, overlap: int = OVERLAP) -> DataFrame:
    """(pubkey, synced) of the authors that are not in sync; ``synced`` is null where all is to be fetched."""
    state = authors.select("pubkey").distinct().join(synced_up_to(bounds, kinds), "pubkey", "left")
    return state.where(F.col("synced").isNull() | (F.col("synced") <= now - overlap))


def catch_up(source: DataFrame, bounds: DataFrame, authors: DataFrame, kinds: Sequence, now: int, page: int | None = PAGE, overlap: int = OVERLAP) -> DataFrame:
    """New events of authors that are not in sync: since what is known, at most the newest ``page`` each, or all.

    After a full page the bounds may not be raised to now: what lies between is not fetched.
    """
    due = due_authors(bounds, authors, kinds, now, overlap)
    found = source.where(F.col("kind").isin(list(kinds))).join(due, "pubkey").where("synced is null or created_at >= synced")
    if page is None:
        return found.drop("synced")
    w = W.partitionBy("pubkey").orderBy(F.col("created_at").desc(), "id")
    return found.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= page).drop("_r", "synced")


def not_yet_live(authors: DataFrame, live: DataFrame) -> DataFrame:
    """Authors without a running tail."""
    return authors.join(live.select("pubkey"), "pubkey", "left_anti")


def _take(store, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Save fetched events and what they delete; the events as they were fetched, and (pubkey, n_stored)."""
    fetched = store.stage(found)
    answer = store.save(fetched)
    store.apply_deletions(batch=fetched)
    stored = answer.where("stored").join(fetched.select("id", "pubkey").distinct(), "id")
    return fetched, stored.groupBy("pubkey").agg(F.count(F.lit(1)).alias("n_stored"))


def run_sync(store, source: DataFrame, authors: DataFrame, kinds: Sequence, now: int, overlap: int = OVERLAP) -> DataFrame:
    """Bring a store up to now: (pubkey, n_stored).

    Of every author that is not in sync all events since what is known are
    fetched, however many, saved, and their deletions applied; then the bounds
    of every asked author and kind are raised to now.  There is no page and so
    no gap.
    """
    bounds = store.stage(store.bounds())
    due = store.stage(due_authors(bounds, authors, kinds, now, overlap))
    fetched, stored = _take(store, catch_up(source, bounds, due, kinds, now, None, overlap))
    asked = due.select("pubkey", F.explode(F.array(*[F.lit(int(k)) for k in kinds])).alias("kind"))
    held = bounds.join(due.select("pubkey"), "pubkey", "left_semi")
    store.set_bounds(raise_bounds(held, fetched, asked, now))
    return stored


def run_backfill(store, source: DataFrame, kinds: Sequence, ts: int) -> DataFrame:
    """Fill a store with older events back to ``ts``: (pubkey, n_stored).

    For every known author with a gap, all events from ``ts`` up to what is
    known are fetched and saved, and the bounds fall to ``ts``.
    """
    bounds = store.stage(store.bounds())
    plan = store.stage(backfill_plan(bounds, kinds, ts).where("need"))
    older = source.where(F.col("kind").isin(list(kinds)) & (F.col("created_at") >= ts)).join(plan.select("pubkey", "until"), "pubkey").where("until is null or created_at <= until").drop("until")
    fetched, stored = _take(store, older)
    reached = plan.select("pubkey", F.explode(F.array(*[F.lit(int(k)) for k in kinds])).alias("kind"), F.lit(ts).cast("long").alias("oldest"), F.lit(ts).cast("long").alias("newest"))
    held = bounds.join(plan.select("pubkey"), "pubkey", "left_semi")
    store.set_bounds(lower_bounds(held.unionByName(reached), fetched))
    return stored
