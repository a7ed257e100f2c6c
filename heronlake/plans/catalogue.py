"""The queries that run on the driver's tables, and DuckDB SQL for each."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heronlake.functions import scalars as S
from heronlake.operators import filters, graph, latest, lists, profiles, ranking, routing, store, sync
from heronlake.operators.filters import Filter
from heronlake.operators.schema import is_addressable, is_replaceable
from heronlake.plans.tables import FOLLOWS_SQL, LIST_SPAN, NOTES_SQL, NOW, RELAYS_SQL, TAGS_SQL, follows, list_events, notes, relay_items, set_events, shared_dir, table, tag, tag_rows
from heronlake.sources import events as raw_events
from heronlake.streaming import tail

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _add(name: str, run: Query, sql: str | None) -> None:
    _QUERIES[name] = run
    if sql:
        _SQL[name] = sql


def _notes_query(name: str, f: Filter, where: str, order: bool = True) -> None:
    """A filter over the notes; its SQL has the condition, the order and the limit the filter ends up with."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return filters.query(notes(spark, d), f).select("id", "pubkey", "kind", "created_at")

    _add(name, run, f"WITH {NOTES_SQL} SELECT id, pubkey, kind, created_at FROM notes WHERE {where} ORDER BY created_at DESC, id LIMIT {f.tightened()}")


_notes_query("filter_topk", Filter(authors=["8", "46", "3"], kinds=[1, 7], limit=40), "pubkey IN ('8', '46', '3') AND kind IN (1, 7)")
_notes_query("author_scan", Filter(authors=["5", "9"]), "pubkey IN ('5', '9')")
_notes_query("kind_scan", Filter(kinds=[0, 5], limit=500), "kind IN (0, 5)")
_notes_query("author_kind_scan", Filter(authors=["5", "9", "11"], kinds=[7]), "pubkey IN ('5', '9', '11') AND kind = 7")
_notes_query("time_scan", Filter(limit=100), "true")
_notes_query("tag_scan", Filter(tags={"t": ["click", "error"]}, limit=300), "event_type IN ('click', 'error')")
_notes_query("tag_and_or", Filter(tags={"t": ["click", "view"], "k": ["1", "2", "3"]}), "event_type IN ('click', 'view') AND k IN ('1', '2', '3')")
_notes_query("dtag_scan", Filter(tags={"d": ["7", "8", "9"]}), "kind = 30023 AND k IN ('7', '8', '9')")
_notes_query("dtag_kind_scan", Filter(kinds=[30023], tags={"d": ["7", "8"]}), "kind = 30023 AND k IN ('7', '8')")
_notes_query("dtag_author_scan", Filter(authors=["5", "9"], kinds=[30023], tags={"d": ["7", "8", "9", "10"]}), "kind = 30023 AND pubkey IN ('5', '9') AND k IN ('7', '8', '9', '10')")
_notes_query("dtag_and_tag", Filter(tags={"d": ["7", "8", "9"], "t": ["purchase"]}), "kind = 30023 AND k IN ('7', '8', '9')")
_notes_query("empty_kinds", Filter(kinds=[], tags={"t": ["click"]}), "false")
_notes_query("semantic_limit", Filter(authors=["1", "2", "3", "4", "5"], kinds=[0]), "pubkey IN ('1', '2', '3', '4', '5') AND kind = 0")

_SPAN = "(SELECT (min(created_at) + max(created_at)) // 2 AS mid FROM notes)"


def _since_until(spark: SparkSession, d: str) -> DataFrame:
    n = notes(spark, d)
    mid = n.agg(F.floor((F.min("created_at") + F.max("created_at")) / 2).alias("m")).first()["m"] or 0
    return filters.matching(n, Filter(since=mid - 36000, until=mid + 36000)).select("id", "created_at")


_add("since_until", _since_until, f"WITH {NOTES_SQL} SELECT id, created_at FROM notes, {_SPAN} WHERE created_at BETWEEN mid - 36000 AND mid + 36000")


def _ids(spark: SparkSession, d: str) -> DataFrame:
    return filters.query(notes(spark, d), Filter(ids=["17", "3", "17", "999", "-1"])).select("id", "kind")


_add("ids_lookup", _ids, f"WITH {NOTES_SQL} SELECT id, kind FROM notes WHERE id IN ('17', '3', '999', '-1')")


def _many_authors(spark: SparkSession, d: str) -> DataFrame:
    n = notes(spark, d)
    return filters.matching(n, Filter(kinds=[1])).join(n.where("kind = 30023").select("pubkey"), "pubkey", "left_semi").groupBy("pubkey").agg(F.count(F.lit(1)).alias("n"))


_add("many_authors", _many_authors, f"WITH {NOTES_SQL} SELECT pubkey, count(*) AS n FROM notes WHERE kind = 1 AND pubkey IN (SELECT pubkey FROM notes WHERE kind = 30023) GROUP BY pubkey")


def _any_filter(spark: SparkSession, d: str) -> DataFrame:
    return filters.query_any(notes(spark, d), [Filter(kinds=[1], limit=50), Filter(authors=["5"], limit=50), Filter(tags={"k": ["4"]}, limit=50)]).select("id")


_add("union_filters", _any_filter, f"WITH {NOTES_SQL} " + " UNION ".join(f"SELECT id FROM (SELECT id FROM notes WHERE {w} ORDER BY created_at DESC, id LIMIT 50)" for w in ("kind = 1", "pubkey = '5'", "k = '4'")))

# The newest of each key

_add("replaceable_latest", lambda s, d: latest.newest(notes(s, d), ["pubkey", "kind"]).select("pubkey", "kind", "id", "created_at"), f"WITH {NOTES_SQL} SELECT pubkey, kind, id, created_at FROM notes QUALIFY row_number() OVER (PARTITION BY pubkey, kind ORDER BY created_at DESC, id) = 1")
_add("addressable_latest", lambda s, d: latest.newest(notes(s, d).where("kind = 30023"), ["pubkey", "k"]).select("pubkey", "k", "id"), f"WITH {NOTES_SQL} SELECT pubkey, k, id FROM notes WHERE kind = 30023 QUALIFY row_number() OVER (PARTITION BY pubkey, k ORDER BY created_at DESC, id) = 1")
_add("bundle_top", lambda s, d: latest.per_key(notes(s, d), ["pubkey", "kind"], 5).select("pubkey", "kind", "id"), f"WITH {NOTES_SQL} SELECT pubkey, kind, id FROM notes QUALIFY row_number() OVER (PARTITION BY pubkey, kind ORDER BY created_at DESC, id) <= 5")


def _saved(spark: SparkSession, d: str) -> DataFrame:
    n = notes(spark, d)
    return latest.surviving(n.withColumn("_arrival", F.col("id").cast("long"))).select("id", "pubkey", "kind")


_add("save_survivors", _saved, f"WITH {NOTES_SQL} SELECT id, pubkey, kind FROM notes QUALIFY kind NOT IN (0, 30023) OR row_number() OVER (PARTITION BY pubkey, kind, CASE WHEN kind = 30023 THEN k END ORDER BY created_at DESC, CAST(id AS BIGINT)) = 1")


def _dedupe(spark: SparkSession, d: str) -> DataFrame:
    n = notes(spark, d).select("id", "pubkey", "kind")
    return n.unionByName(n.where("kind = 1")).dropDuplicates(["id"])


_add("dedupe_ids", _dedupe, f"WITH {NOTES_SQL} SELECT DISTINCT id, pubkey, kind FROM notes")


def _load_all(spark: SparkSession, d: str) -> DataFrame:
    """A lookup of every (author, k) that any event names."""
    n = notes(spark, d)
    specs = n.where("k is not null").groupBy("pubkey", F.col("k").alias("d")).agg(F.min(F.col("id").cast("long")).alias("pos")).select("pos", F.lit(30023).alias("kind"), "pubkey", "d")
    attempts = n.where("kind = 7").groupBy(F.lit(30023).alias("kind"), "pubkey", F.col("k").alias("d")).agg(F.max("created_at").alias("last_attempt"))
    return store.load_replaceables(specs, n, attempts).select("pos", "last_attempt", F.get("events", F.lit(0))["id"].alias("id"))


_add("load_replaceables", _load_all, f"""WITH {NOTES_SQL}, specs AS (SELECT min(CAST(id AS BIGINT)) AS pos, pubkey, k FROM notes WHERE k IS NOT NULL GROUP BY pubkey, k),
newest AS (SELECT pubkey, k, id FROM notes WHERE kind = 30023 QUALIFY row_number() OVER (PARTITION BY pubkey, k ORDER BY created_at DESC, id) = 1),
tried AS (SELECT pubkey, k, max(created_at) AS last_attempt FROM notes WHERE kind = 7 GROUP BY ALL)
SELECT s.pos, t.last_attempt, n.id FROM specs s LEFT JOIN newest n USING (pubkey, k) LEFT JOIN tried t USING (pubkey, k)""")


def _all_bundles(spark: SparkSession, d: str) -> DataFrame:
    """The newest three of every author."""
    n = notes(spark, d)
    specs = n.select("pubkey").distinct().select(F.col("pubkey").cast("long").alias("pos"), F.lit(30023).alias("kind"), "pubkey", F.lit(None).cast("string").alias("d"))
    found = store.load_replaceables(specs, n, spark.createDataFrame([], store.ATTEMPTS), most=3)
    return found.select("pos", F.array_join(F.transform("events", lambda e: e["id"]), ",").alias("ids"))


_add("load_bundles", _all_bundles, f"""WITH {NOTES_SQL}, newest AS (SELECT pubkey, k, id, created_at FROM notes WHERE kind = 30023 QUALIFY row_number() OVER (PARTITION BY pubkey, k ORDER BY created_at DESC, id) = 1),
top AS (SELECT * FROM newest QUALIFY row_number() OVER (PARTITION BY pubkey ORDER BY created_at DESC, id) <= 3)
SELECT CAST(a.pubkey AS BIGINT) AS pos, string_agg(id, ',' ORDER BY created_at DESC, id) AS ids FROM (SELECT DISTINCT pubkey FROM notes) a LEFT JOIN top USING (pubkey) GROUP BY a.pubkey""")

# Deletions

_DELETED = f"""WITH {NOTES_SQL} SELECT e.id FROM notes e WHERE e.kind = 30023 AND EXISTS (SELECT 1 FROM notes x WHERE x.kind = 5 AND x.pubkey = e.pubkey AND x.k = e.k"""
_add("delete_by_event", lambda s, d: store.deleted_by(notes(s, d)), _DELETED + " AND x.created_at >= e.created_at)")
_add("delete_by_event_loose", lambda s, d: store.deleted_by(notes(s, d), strict=False), _DELETED + ")")


def _after_delete(spark: SparkSession, d: str) -> DataFrame:
    n = notes(spark, d)
    gone = filters.matching(n, Filter(kinds=[1], authors=["1", "2", "3"])).select("id")
    return n.join(gone, "id", "left_anti").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


_add("delete_by_filter", _after_delete, f"WITH {NOTES_SQL} SELECT kind, count(*) AS n FROM notes WHERE NOT (kind = 1 AND pubkey IN ('1', '2', '3')) GROUP BY kind")

# Graph and ranking

_WOT = f"WITH {FOLLOWS_SQL} SELECT DISTINCT b.dst FROM follows a JOIN follows b ON b.src = a.dst WHERE a.src = 1"
_add("wot_two_hop", lambda s, d: graph.web_of_trust(follows(s, d), 1, follows(s, d).where("src = 7").select("dst")), _WOT + " AND b.dst NOT IN (SELECT dst FROM follows WHERE src = 7)")
_add("wot_with_direct", lambda s, d: graph.web_of_trust(follows(s, d), 1, None, include_direct=True), _WOT + " UNION SELECT dst FROM follows WHERE src = 1")

_add("globalism", lambda s, d: ranking.popularity(relay_items(s, d)).select("url", F.round("score", 6).alias("score")), f"WITH {RELAYS_SQL} SELECT url, round(sum(share), 6) AS score FROM (SELECT url, 20.0 / count(*) OVER (PARTITION BY pubkey) AS share FROM relays) GROUP BY url")
def _resting(spark: SparkSession, d: str) -> DataFrame:
    """Event types as relays that rest: as many failures as the type's first user has errors, the last attempt at the last event."""
    n = notes(spark, d)
    state = n.groupBy(F.col("event_type").alias("url")).agg(F.max(F.when(F.col("k").cast("int") % 3 == 0, 2).otherwise(0)).alias("failures"), F.max("created_at").alias("last_attempt"))
    return routing.resting(state.where("url in ('click', 'error')").unionByName(state.where("url not in ('click', 'error')").withColumn("last_attempt", F.col("last_attempt") - 900)), _now(spark, d))


#: Only these types can rest: the others' last attempts are long enough ago.
_RESTING_SQL = "resting AS (SELECT event_type AS url FROM notes GROUP BY event_type HAVING max(CASE WHEN CAST(k AS INT) % 3 = 0 THEN 2 ELSE 0 END) > 0 AND max(created_at) - CASE WHEN event_type IN ('click', 'error') THEN 0 ELSE 900 END + 240 >= (SELECT max(created_at) FROM notes))"
_add("globalism_allowed", lambda s, d: ranking.famous(ranking.popularity(relay_items(s, d), blocked=_resting(s, d))).select("url", F.round("score", 6).alias("score")), f"WITH {RELAYS_SQL}, {_RESTING_SQL} SELECT url, round(sum(share), 6) AS score FROM (SELECT url, 20.0 / count(*) OVER (PARTITION BY pubkey) AS share FROM relays) WHERE url NOT IN (SELECT url FROM resting) GROUP BY url")
_add("relay_pick_allowed", lambda s, d: routing.pick_allowed(relay_items(s, d), _resting(s, d)), f"WITH {RELAYS_SQL}, {_RESTING_SQL} SELECT pubkey, url FROM relays WHERE url NOT IN (SELECT url FROM resting) QUALIFY row_number() OVER (PARTITION BY pubkey ORDER BY pos) <= 2")
_add("relay_popularity", lambda s, d: routing.batch_sizes(relay_items(s, d)), f"WITH {RELAYS_SQL} SELECT url, count(DISTINCT pubkey) AS n_authors FROM relays GROUP BY url")

_HINT_SQL = f"""WITH {NOTES_SQL}, hints AS (SELECT pubkey, event_type AS relay, CAST(k AS INT) % 7 AS hint_key, max(created_at) AS ts FROM notes GROUP BY ALL),
scores AS (SELECT pubkey, relay, sum([-500, 700, 350, 5, 22, 8, 7][hint_key + 1] * 1e10 / power(greatest({NOW} + 86400 - ts, 1), 1.3)) AS score FROM hints WHERE ts <> 0 GROUP BY ALL)"""


def _hints(spark: SparkSession, d: str) -> DataFrame:
    n = notes(spark, d).select("pubkey", F.col("event_type").alias("relay"), (F.col("k").cast("int") % 7).alias("hint_key"), F.col("created_at").alias("ts"))
    return ranking.save_hints(n.limit(0), n)


_add("hint_state", _hints, f"WITH {NOTES_SQL} SELECT pubkey, event_type AS relay, CAST(k AS INT) % 7 AS hint_key, max(created_at) AS ts FROM notes GROUP BY ALL")


def _hint_export(spark: SparkSession, d: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/hints-{uuid.uuid4().hex}"
    ranking.export_hints(_hints(spark, d), folder)
    return ranking.import_hints(spark, folder)


_add("hint_export", _hint_export, _SQL["hint_state"])
_add("hint_scores", lambda s, d: ranking.hint_scores(_hints(s, d), NOW).select("pubkey", "relay", F.round("score", 3).alias("score")), _HINT_SQL + " SELECT pubkey, relay, round(score, 3) AS score FROM scores")
_add("hint_topn", lambda s, d: ranking.top_relays(ranking.hint_scores(_hints(s, d), NOW).withColumn("score", F.round("score", 3)), 2), _HINT_SQL + " SELECT pubkey, relay, s AS score, row_number() OVER (PARTITION BY pubkey ORDER BY s DESC, relay) AS rank FROM (SELECT pubkey, relay, round(score, 3) AS s FROM scores) QUALIFY rank <= 2")

# Routing


def _picked(spark: SparkSession, d: str) -> DataFrame:
    item = F.struct(F.col("url").alias("value"), F.lit(True).alias("write"))
    rows = relay_items(spark, d).groupBy("pubkey").agg(F.array_sort(F.collect_list(F.struct("pos", item.alias("i")))).alias("l"))
    return routing.pick(rows.select("pubkey", F.transform("l", lambda x: x["i"]).alias("items")))


_add("relay_pick", _picked, f"WITH {RELAYS_SQL} SELECT pubkey, url FROM relays WHERE pos <= 2")
_add("outbox_batch", lambda s, d: routing.outbox_batch(_picked(s, d), (0, 1)).select("url", F.col("filter_idx").cast("long").alias("filter_idx"), "request", F.array_join("authors", ",").alias("authors"), "n_authors"), f"""WITH {RELAYS_SQL}, picked AS (SELECT DISTINCT pubkey, url FROM relays WHERE pos <= 2), n AS (SELECT url, ceil(count(*) / {routing.REQUEST}.0) AS k FROM picked GROUP BY url),
dealt AS (SELECT url, pubkey, CAST(('0x' || substring(sha256(pubkey), 1, 8))::BIGINT % k AS BIGINT) AS request FROM picked JOIN n USING (url))
SELECT url, range AS filter_idx, request, string_agg(pubkey, ',' ORDER BY pubkey) AS authors, count(*) AS n_authors FROM dealt, range(2) GROUP BY url, range, request""")
_add("outbox_popular_first", lambda s, d: routing.outbox_batch(_picked(s, d), (0,), per_author=1).groupBy("url").agg(F.sum("n_authors").alias("n_authors")), f"WITH {RELAYS_SQL}, picked AS (SELECT pubkey, url, count(*) OVER (PARTITION BY url) AS n FROM relays WHERE pos <= 2), best AS (SELECT pubkey, url FROM picked QUALIFY row_number() OVER (PARTITION BY pubkey ORDER BY n DESC, url) = 1) SELECT url, count(*) AS n_authors FROM best GROUP BY url")


def _tiers(spark: SparkSession, d: str) -> DataFrame:
    n = notes(spark, d)
    tier = lambda kind: latest.newest(n.where(F.col("kind") == kind), ["pubkey"]).select("pubkey", "id")
    return routing.first_tier([tier(0), tier(30023), tier(1)], "pubkey").select("pubkey", "id", F.col("tier").cast("long").alias("tier"))


_add("tiered_lookup", _tiers, f"""WITH {NOTES_SQL}, tiers AS (SELECT pubkey, id, CASE kind WHEN 0 THEN 0 WHEN 30023 THEN 1 ELSE 2 END AS tier FROM notes WHERE kind IN (0, 30023, 1)
  QUALIFY row_number() OVER (PARTITION BY pubkey, kind ORDER BY created_at DESC, id) = 1) SELECT pubkey, id, tier FROM tiers QUALIFY row_number() OVER (PARTITION BY pubkey ORDER BY tier) = 1""")
_add("pointer_requests", lambda s, d: routing.pointer_requests(notes(s, d).select("kind", "pubkey", F.col("k").alias("identifier"))).select("kind", "pubkey", "request", F.array_join("identifiers", ",").alias("identifiers")), f"""WITH {NOTES_SQL}, named AS (SELECT DISTINCT kind, pubkey, k FROM notes), n AS (SELECT kind, pubkey, ceil(count(*) / {routing.REQUEST}.0) AS c FROM named GROUP BY kind, pubkey)
SELECT kind, pubkey, CAST(('0x' || substring(sha256(k), 1, 8))::BIGINT % c AS BIGINT) AS request, string_agg(k, ',' ORDER BY k) AS identifiers FROM named JOIN n USING (kind, pubkey) GROUP BY ALL""")
_add("relay_since", lambda s, d: routing.relay_since(notes(s, d).select(F.col("event_type").alias("url"), F.when(F.col("kind") != 5, F.col("created_at")).alias("last_attempt"))), f"WITH {NOTES_SQL} SELECT event_type AS url, CASE WHEN event_type = 'error' THEN NULL ELSE min(created_at) END AS since FROM notes GROUP BY event_type")

# Synchronisation


def _bounds(spark: SparkSession, d: str) -> DataFrame:
    return sync.bounds_of(notes(spark, d))


_BOUNDS_SQL = f"WITH {NOTES_SQL}, bounds AS (SELECT pubkey, kind, min(created_at) AS oldest, max(created_at) AS newest FROM notes GROUP BY pubkey, kind), t AS (SELECT max(created_at) AS now FROM notes)"


def _now(spark: SparkSession, d: str) -> int:
    return notes(spark, d).agg(F.max("created_at")).first()[0] or 0


_add("outbox_bounds", _bounds, _BOUNDS_SQL + " SELECT * FROM bounds")
_add("outbox_bounds_map", lambda s, d: store.bounds_map(_bounds(s, d)).select("pubkey", F.array_join(F.array_sort(F.transform(F.map_entries("kinds"), lambda e: F.concat_ws(":", e["key"], e["value"][0], e["value"][1]))), ",").alias("kinds")), _BOUNDS_SQL + " SELECT pubkey, string_agg(concat_ws(':', kind, oldest, newest), ',' ORDER BY concat_ws(':', kind, oldest, newest)) AS kinds FROM bounds GROUP BY pubkey")
_add("synced_up_to", lambda s, d: sync.synced_up_to(_bounds(s, d), [0, 1, 30023]), _BOUNDS_SQL + " SELECT pubkey, CASE WHEN count(*) FILTER (kind IN (0, 1, 30023)) = 3 THEN min(newest) FILTER (kind IN (0, 1, 30023)) END AS synced FROM bounds GROUP BY pubkey")
_add("is_synced", lambda s, d: sync.is_synced(_bounds(s, d), [1, 7], _now(s, d), 5 * 86400), _BOUNDS_SQL + " SELECT pubkey, coalesce(count(*) FILTER (kind IN (1, 7)) = 2 AND min(newest) FILTER (kind IN (1, 7)) > any_value(now) - 432000, false) AS is_synced FROM bounds, t GROUP BY pubkey")
_add("backfill_plan", lambda s, d: sync.backfill_plan(_bounds(s, d), [0, 1], _now(s, d) - 25 * 86400), _BOUNDS_SQL + " SELECT pubkey, count(*) FILTER (kind IN (0, 1)) < 2 OR max(oldest) FILTER (kind IN (0, 1) AND oldest >= now - 2160000) IS NOT NULL AS need, max(oldest) FILTER (kind IN (0, 1) AND oldest >= now - 2160000) AS until FROM bounds, t GROUP BY pubkey")


def _page(spark: SparkSession, d: str) -> DataFrame:
    plan = _bounds(spark, d).groupBy("pubkey").agg(F.lit(True).alias("need"), F.max("oldest").alias("until"))
    return sync.page_before(notes(spark, d), plan, [1, 7], 4).select("pubkey", "id")


_add("backfill_page", _page, _BOUNDS_SQL + ", plan AS (SELECT pubkey, max(oldest) AS until FROM bounds GROUP BY pubkey) SELECT pubkey, id FROM notes JOIN plan USING (pubkey) WHERE kind IN (1, 7) AND created_at <= until QUALIFY row_number() OVER (PARTITION BY pubkey ORDER BY created_at DESC, id) <= 4")


def _catch_up(spark: SparkSession, d: str) -> DataFrame:
    n = notes(spark, d)
    now = _now(spark, d)
    known = sync.bounds_of(n.where(F.col("created_at") < now - 10 * 86400))
    return sync.catch_up(n, known, n.select("pubkey").distinct(), [1, 7], now, 6).select("pubkey", "id")


_add("catch_up", _catch_up, _BOUNDS_SQL + """, known AS (SELECT pubkey, kind, max(created_at) AS newest FROM notes, t WHERE created_at < now - 864000 AND kind IN (1, 7) GROUP BY pubkey, kind),
s AS (SELECT pubkey, CASE WHEN count(*) = 2 THEN min(newest) END AS synced FROM known GROUP BY pubkey)
SELECT n.pubkey, n.id FROM notes n LEFT JOIN s ON s.pubkey = n.pubkey WHERE kind IN (1, 7) AND (synced IS NULL OR created_at >= synced) QUALIFY row_number() OVER (PARTITION BY n.pubkey ORDER BY created_at DESC, id) <= 6""")
_add("bounds_raise", lambda s, d: sync.raise_bounds(_bounds(s, d).where("kind = 1"), notes(s, d).where("kind = 7"), notes(s, d).select("pubkey", "kind").where("kind in (1, 7)").distinct(), NOW), _BOUNDS_SQL + f" SELECT pubkey, kind, oldest, {NOW} AS newest FROM bounds WHERE kind IN (1, 7)")


# A whole store


def _store(spark: SparkSession) -> store.EventStore:
    out = store.EventStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", buckets=8)
    out.create()
    return out


_ALL = [0, 1, 5, 7, 30023]
_KEPT_SQL = f"""WITH {NOTES_SQL}, kept AS (SELECT * FROM notes QUALIFY kind NOT IN (0, 30023) OR row_number() OVER (PARTITION BY pubkey, kind, CASE WHEN kind = 30023 THEN k END ORDER BY created_at DESC, id) = 1)
SELECT id, pubkey, kind FROM kept e"""
_ALIVE_SQL = _KEPT_SQL + " WHERE NOT (kind = 30023 AND EXISTS (SELECT 1 FROM notes x WHERE x.kind = 5 AND x.pubkey = e.pubkey AND x.k = e.k AND x.created_at >= e.created_at))"


def _store_save(spark: SparkSession, d: str) -> DataFrame:
    """Two halves saved one after the other, the second with all rows of the first again."""
    own, n = _store(spark), notes(spark, d)
    own.save(n.where("created_at % 2 = 0"))
    own.save(n)
    return own.events().select("id", "pubkey", "kind")


def _store_delete(spark: SparkSession, d: str) -> DataFrame:
    own = _store(spark)
    own.save(notes(spark, d))
    own.delete([Filter(kinds=[1], authors=["1", "2", "3"]), Filter(tags={"k": ["4"]})])
    own.apply_deletions()
    return own.events().select("id", "pubkey", "kind")


def _store_scan(spark: SparkSession, d: str) -> DataFrame:
    """A filter on the stored files: its conditions reach the Parquet scan."""
    own = _store(spark)
    own.save(notes(spark, d))
    return filters.matching(own.events(), Filter(authors=["8", "46", "3"], kinds=[1, 7], since=NOW - 10 * 365 * 86400)).select("id", "pubkey", "kind")


def _store_attempts(spark: SparkSession, d: str) -> DataFrame:
    own, n = _store(spark), notes(spark, d)
    own.save(n, last_attempt=NOW)
    own.attempt(n.where("kind = 0"), NOW - 5)
    specs = n.where("kind in (0, 30023)").groupBy("kind", "pubkey", F.when(F.col("kind") == 30023, F.col("k")).otherwise(F.lit("")).alias("d")).agg(F.min(F.col("id").cast("long")).alias("pos"))
    return own.load_replaceables(specs).select("pos", "last_attempt", F.get("events", F.lit(0))["id"].alias("id"))


def _sync_run(spark: SparkSession, d: str) -> DataFrame:
    """A store that knows what is older than ten days is brought up to now."""
    own, n, now = _store(spark), notes(spark, d), _now(spark, d)
    old = n.where(F.col("created_at") < now - 10 * 86400)
    own.save(old)
    own.apply_deletions()
    own.set_bounds(sync.bounds_of(old))
    sync.run_sync(own, n, n.select("pubkey").distinct(), _ALL, now)
    return own.events().select("id", "pubkey", "kind")


def _sync_bounds(spark: SparkSession, d: str) -> DataFrame:
    own, n, now = _store(spark), notes(spark, d), _now(spark, d)
    own.set_bounds(sync.bounds_of(n.where(F.col("created_at") < now - 10 * 86400)))
    sync.run_sync(own, n, n.select("pubkey").distinct(), [1, 7], now, 0)
    return own.bounds()


def _backfill_run(spark: SparkSession, d: str) -> DataFrame:
    """A store that knows the last ten days only is filled back to the first event."""
    own, n, now = _store(spark), notes(spark, d), _now(spark, d)
    new = n.where(F.col("created_at") >= now - 10 * 86400)
    own.save(new)
    own.set_bounds(sync.bounds_of(n.withColumn("created_at", F.greatest("created_at", F.lit(now - 10 * 86400)))))
    sync.run_backfill(own, n, _ALL, 0)
    own.apply_deletions()
    return own.events().select("id", "pubkey", "kind")


_add("store_save", _store_save, _KEPT_SQL)
_add("store_delete", _store_delete, _ALIVE_SQL + " AND NOT (kind = 1 AND pubkey IN ('1', '2', '3')) AND k <> '4'")
_add("store_scan", _store_scan, _KEPT_SQL + f" WHERE pubkey IN ('8', '46', '3') AND kind IN (1, 7) AND created_at >= {NOW - 10 * 365 * 86400}")
_add("store_attempts", _store_attempts, f"""WITH {NOTES_SQL}, specs AS (SELECT kind, pubkey, CASE kind WHEN 30023 THEN k ELSE '' END AS d, min(CAST(id AS BIGINT)) AS pos FROM notes WHERE kind IN (0, 30023) GROUP BY ALL),
newest AS (SELECT kind, pubkey, CASE kind WHEN 30023 THEN k ELSE '' END AS d, id FROM notes WHERE kind IN (0, 30023) QUALIFY row_number() OVER (PARTITION BY kind, pubkey, CASE kind WHEN 30023 THEN k ELSE '' END ORDER BY created_at DESC, id) = 1)
SELECT pos, {NOW}::BIGINT AS last_attempt, id FROM specs LEFT JOIN newest USING (kind, pubkey, d)""")
_add("sync_run", _sync_run, _ALIVE_SQL)
_add("sync_bounds", _sync_bounds, _BOUNDS_SQL + """, known AS (SELECT pubkey, kind, min(created_at) AS oldest, max(created_at) AS newest FROM notes, t WHERE created_at < now - 864000 GROUP BY pubkey, kind),
s AS (SELECT pubkey, CASE WHEN count(*) FILTER (kind IN (1, 7)) = 2 THEN min(newest) FILTER (kind IN (1, 7)) END AS synced FROM known GROUP BY pubkey),
f AS (SELECT n.pubkey, n.kind, min(created_at) AS oldest FROM notes n LEFT JOIN s ON s.pubkey = n.pubkey WHERE kind IN (1, 7) AND (synced IS NULL OR created_at >= synced) GROUP BY n.pubkey, n.kind),
a AS (SELECT pubkey, kind FROM (SELECT DISTINCT pubkey FROM notes), (VALUES (1), (7)) v(kind))
SELECT coalesce(a.pubkey, k.pubkey) AS pubkey, coalesce(a.kind, k.kind) AS kind, CASE WHEN a.pubkey IS NULL THEN k.oldest ELSE least(coalesce(k.oldest, now), coalesce(f.oldest, now)) END AS oldest, CASE WHEN a.pubkey IS NULL THEN k.newest ELSE now END AS newest
FROM a FULL JOIN known k ON k.pubkey = a.pubkey AND k.kind = a.kind LEFT JOIN f ON f.pubkey = a.pubkey AND f.kind = a.kind, t""")
_add("backfill_run", _backfill_run, _ALIVE_SQL)


def _backoff(spark: SparkSession, d: str) -> DataFrame:
    n = notes(spark, d)
    what = F.when(F.col("kind") == 5, "failure").when(F.col("kind") == 0, "success").otherwise("ask")
    return tail.backoff_latest(n.select("pubkey", F.col("created_at").alias("ts"), F.col("id").cast("long").alias("i"), what.alias("what")), "pubkey", ("ts", "i"))


_add("backoff_fold", _backoff, f"""WITH RECURSIVE {NOTES_SQL}, steps AS (SELECT pubkey, created_at AS ts, CASE kind WHEN 5 THEN 'failure' WHEN 0 THEN 'success' ELSE 'ask' END AS what,
  row_number() OVER (PARTITION BY pubkey ORDER BY created_at, CAST(id AS BIGINT)) AS i FROM notes),
run(pubkey, i, failures, last_attempt, allowed) AS (SELECT DISTINCT pubkey, 0::BIGINT, 0::BIGINT, 0::BIGINT, NULL::BOOLEAN FROM steps UNION ALL
  SELECT r.pubkey, s.i,
    CASE s.what WHEN 'failure' THEN r.failures + 1 WHEN 'success' THEN 0 ELSE CASE WHEN r.failures > 0 AND r.last_attempt + least(r.failures * 120, 600) < s.ts THEN r.failures - 1 ELSE r.failures END END,
    CASE s.what WHEN 'failure' THEN s.ts WHEN 'success' THEN 0 ELSE CASE WHEN r.failures = 0 OR (r.failures = 1 AND r.last_attempt + 120 < s.ts) THEN 0 WHEN r.last_attempt + least(r.failures * 120, 600) < s.ts THEN s.ts ELSE r.last_attempt END END,
    CASE WHEN s.what = 'ask' THEN r.failures = 0 OR r.last_attempt + least(r.failures * 120, 600) < s.ts END
  FROM run r JOIN steps s ON s.pubkey = r.pubkey AND s.i = r.i + 1)
SELECT pubkey, failures, last_attempt, allowed FROM run QUALIFY row_number() OVER (PARTITION BY pubkey ORDER BY i DESC) = 1""")

# Lists and sets


def _text(i: Column) -> Column:
    fields = ["item_type", "value", "kind", "pubkey", "identifier"]
    return F.concat_ws("|", *[i[f].cast("string") for f in fields], F.array_join(i["relays"], ";"), *[i[f].cast("string") for f in ("read", "write", "name", "url")])


#: SQL of the item text that each of the sixteen tag forms gives in each list.
_PUBKEY = {0: "'pubkey|' || h"}
_RELAY = {2: "'relay|wss://host' || k || '.example.com/'"}
_ADDRESSES = {3: "'address|30000:' || h || ':d' || k", 4: "'address|30002:' || h || ':x:' || k", 15: "'address|30030:' || h || ':e' || k"}
_POINTERS = {3: "'pointer|30000|' || h || '|d' || k", 4: "'pointer|30002|' || h || '|x:' || k || '|wss://r.example'", 15: "'pointer|30030|' || h || '|e' || k"}
_EVENT = {8: "'event|' || h"}
_EMOJI = {11: "'emoji|s' || k || '|http://e/' || k"}
_ITEM_SQL: dict[str, dict[int, str]] = {
    "follows": _PUBKEY, "wiki_authors": _PUBKEY, "wiki_relays": _RELAY, "favorite_follow_sets": {3: _POINTERS[3]}, "favorite_relays": _RELAY | {4: _POINTERS[4]},
    "relay_list": {5: "'relay|wss://r' || k || '.example.com/|true|true'", 6: "'relay|wss://r' || k || '.example.com/|true|false'"},
    "favorite_scrolls": {8: "'event|' || h || '|1227|' || h || '|wss://rr.example/x'"},
    "mutes": _PUBKEY | {8: "'thread|' || h", 9: "'hashtag|tag' || k", 10: "'word|w' || k"}, "bookmarks": _EVENT | _ADDRESSES,
    "blossom_servers": {13: "'server|https://m' || k || '.example.com/'"}, "emojis": {15: _POINTERS[15]} | _EMOJI, "pins": _EVENT, "blocked_relays": _RELAY, "search_relays": _RELAY,
    "profile_badges": _POINTERS | _EVENT, "simple_groups": {12: "'group|g' || k || '|n' || k || '|wss://g.example.com/'"}, "git_authors": _PUBKEY, "git_repositories": _ADDRESSES, "media_follows": _PUBKEY,
    "dm_relays": _RELAY, "favorite_podcasts": _PUBKEY | {14: "'url|http://u/' || k"}, "authored_podcasts": _PUBKEY,
    "follow_sets": _PUBKEY, "follow_packs": _PUBKEY, "relay_sets": _RELAY, "emoji_sets": _EMOJI,
}


def _list_query(name: str, spec: lists.ListSpec) -> None:
    case = "CASE m " + " ".join(f"WHEN {m} THEN {x}" for m, x in _ITEM_SQL[name].items()) + " END"
    author = f"pubkey || '-' || (pos // {LIST_SPAN})"
    keys, groups = (f"{author} AS pubkey, event_type", f"{author}, event_type") if spec.is_set else (f"{author} AS pubkey", author)

    def run(spark: SparkSession, d: str) -> DataFrame:
        found = lists.load_set(set_events(spark, d, spec.kind), spec) if spec.is_set else lists.load_list(list_events(spark, d, spec.kind), spec)
        own = ["pubkey", F.col("title").alias("event_type")] if spec.is_set else ["pubkey"]
        return found.select(*own, F.size("items").cast("long").alias("n_items"), F.array_join(F.transform("items", _text), ",").alias("items"))

    _add(f"list_parse_{name}", run, f"WITH {TAGS_SQL} SELECT {keys}, count({case}) AS n_items, coalesce(string_agg({case}, ',' ORDER BY pos), '') AS items FROM rows_ GROUP BY {groups}")


def _items_query(name: str, spec: lists.ListSpec) -> None:
    """The items as rows: no user's tags meet in one row or task."""
    case = "CASE m " + " ".join(f"WHEN {m} THEN {x}" for m, x in _ITEM_SQL[name].items()) + " END"
    keys = ["pubkey", "event_type"] if spec.is_set else ["pubkey"]

    def run(spark: SparkSession, d: str) -> DataFrame:
        return lists.item_rows(tag_rows(spark, d), spec.parse).select(*keys, "pos", _text(F.col("item")).alias("item"))

    _add(f"list_items_{name}", run, f"WITH {TAGS_SQL} SELECT {', '.join(keys)}, pos, {case} AS item FROM rows_ WHERE {case} IS NOT NULL")


for _name, _spec in lists.SPECS.items():
    _list_query(_name, _spec)
    _items_query(_name, _spec)


def _follow_sets(n: DataFrame) -> DataFrame:
    sets = n.where("kind = 30023").select("id", F.sha2(F.col("pubkey").cast("binary"), 256).alias("pubkey"), F.lit(30000).alias("kind"), "created_at", F.array(tag("d", F.col("k")), tag("p", F.sha2(F.col("id").cast("binary"), 256))).alias("tags"))
    return lists.load_set(sets, lists.SPECS["follow_sets"])


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    n = notes(spark, d)
    pointer = F.array(tag("a", F.concat_ws(":", F.lit("30000"), F.sha2(F.col("pubkey").cast("binary"), 256), "k")))
    # A list for each author and LIST_SPAN ids: none grows with the table.
    author = F.concat_ws("-", "pubkey", F.floor(F.col("id").cast("long") / LIST_SPAN).cast("string"))
    named = n.where("kind = 1").groupBy(author.alias("pubkey")).agg(F.array_sort(F.collect_list(F.struct(F.col("id").cast("long").alias("i"), pointer[0].alias("t")))).alias("l"))
    given = named.select("pubkey", lists.items(F.transform("l", lambda x: x["t"]), lists.SPECS["favorite_follow_sets"].parse).alias("items"))
    full = lists.resolve_pointers(given, _follow_sets(n))
    first = F.transform("items", lambda i: F.coalesce(F.get(i["set_items"], F.lit(0))["value"], F.lit("-")))
    return full.select("pubkey", F.array_join(first, ",").alias("found"))


_add("pointer_resolve", _resolved, f"""WITH {NOTES_SQL}, sets AS (SELECT pubkey, k, sha256(id) AS v FROM notes WHERE kind = 30023 QUALIFY row_number() OVER (PARTITION BY pubkey, k ORDER BY created_at DESC, id) = 1)
SELECT n.pubkey || '-' || (CAST(n.id AS BIGINT) // {LIST_SPAN}) AS pubkey, string_agg(coalesce(s.v, '-'), ',' ORDER BY CAST(n.id AS BIGINT)) AS found FROM notes n LEFT JOIN sets s ON s.pubkey = n.pubkey AND s.k = n.k WHERE n.kind = 1 GROUP BY 1""")


def _resolved_rows(spark: SparkSession, d: str) -> DataFrame:
    n = notes(spark, d)
    named = n.where("kind = 1").select("pubkey", F.col("id").cast("long").alias("pos"), tag("a", F.concat_ws(":", F.lit("30000"), F.sha2(F.col("pubkey").cast("binary"), 256), "k")).alias("tag"))
    full = lists.resolve_rows(lists.item_rows(named, lists.SPECS["favorite_follow_sets"].parse), _follow_sets(n))
    return full.select("pubkey", "pos", F.coalesce(F.get("set_items", F.lit(0))["value"], F.lit("-")).alias("found"))


_add("pointer_rows", _resolved_rows, f"""WITH {NOTES_SQL}, sets AS (SELECT pubkey, k, sha256(id) AS v FROM notes WHERE kind = 30023 QUALIFY row_number() OVER (PARTITION BY pubkey, k ORDER BY created_at DESC, id) = 1)
SELECT n.pubkey, CAST(n.id AS BIGINT) AS pos, coalesce(s.v, '-') AS found FROM notes n LEFT JOIN sets s ON s.pubkey = n.pubkey AND s.k = n.k WHERE n.kind = 1""")


def _resolve(spark: SparkSession, d: str, spec: str, pointed: str, tags: Column) -> DataFrame:
    """The items of lists of one kind, as rows, with the sets of another that they point to."""
    n = notes(spark, d).where("kind = 30023")
    owner = F.sha2(F.col("k").cast("binary"), 256)
    sets = n.select("id", owner.alias("pubkey"), F.lit(lists.SPECS[pointed].kind).alias("kind"), "created_at", tags.alias("tags"))
    rows = lists.item_rows(tag_rows(spark, d), lists.SPECS[spec].parse)
    full = lists.resolve_rows(rows, lists.load_set(sets, lists.SPECS[pointed]))
    return full.select("pubkey", "pos", F.coalesce(F.get("set_items", F.lit(0))["value"], F.get("set_items", F.lit(0))["url"], F.col("item")["value"], F.col("item")["url"], F.lit("-")).alias("found"))


_POINTED_SQL = """newest AS (SELECT k, id FROM notes WHERE kind = 30023 QUALIFY row_number() OVER (PARTITION BY k ORDER BY created_at DESC, id) = 1)"""
_add("resolve_relays", lambda s, d: _resolve(s, d, "favorite_relays", "relay_sets", F.array(tag("d", F.concat(F.lit("x:"), "k")), tag("relay", F.concat(F.lit("wss://"), "id", F.lit(".example.com/"))))), f"""WITH {NOTES_SQL}, {TAGS_SQL}, {_POINTED_SQL}
SELECT r.pubkey, r.pos, CASE WHEN m = 2 THEN 'wss://host' || r.k || '.example.com/' ELSE coalesce('wss://' || n.id || '.example.com/', '-') END AS found FROM rows_ r LEFT JOIN newest n ON n.k = r.k WHERE m IN (2, 4)""")
_add("resolve_emojis", lambda s, d: _resolve(s, d, "emojis", "emoji_sets", F.array(tag("d", F.concat(F.lit("e"), "k")), tag("emoji", F.concat(F.lit("z"), "k"), F.concat(F.lit("http://z/"), "id")))), f"""WITH {NOTES_SQL}, {TAGS_SQL}, {_POINTED_SQL}
SELECT r.pubkey, r.pos, CASE WHEN m = 11 THEN 'http://e/' || r.k ELSE coalesce('http://z/' || n.id, '-') END AS found FROM rows_ r LEFT JOIN newest n ON n.k = r.k WHERE m IN (11, 15)""")


def _refresh_run(spark: SparkSession, d: str) -> DataFrame:
    """Mute lists of all authors: the store holds those of even users, tried just now for every third; each author asks in a mode by its number."""
    own, now = _store(spark), NOW
    spec = lists.SPECS["mutes"]
    who = table(spark, d, "events").select(F.col("user_id").alias("u")).distinct()
    event = lambda rows, tag_value, at: rows.select(F.concat(F.col("u").cast("string"), F.lit(f":{tag_value}")).alias("id"), F.col("u").cast("string").alias("pubkey"), F.lit(spec.kind).alias("kind"), F.lit(at).cast("long").alias("created_at"), F.lit("").alias("sig"), F.array(tag("word", tag_value)).alias("tags"), F.lit("").alias("content"), F.lit(None).cast("array<string>").alias("seen_on"))
    own.save(event(who.where("u % 2 = 0"), "old", 10), now - 9 * 86400)
    own.attempt(event(who.where("u % 6 = 0"), "old", 10), now - 60)
    mode = F.element_at(F.array(*[F.lit(m) for m in ("default", "force", "cache_only", "provided", "reset")]), (F.col("u") % 5 + 1).cast("int"))
    found = lists.run_refresh(own, event(who.where("u % 7 <> 0"), "new", 20), who.select(F.col("u").cast("string").alias("pubkey"), mode.alias("mode")), spec, now, event(who, "given", 30))
    return found.select("pubkey", F.coalesce(F.get("items", F.lit(0))["value"], F.lit("-")).alias("word"), "is_fresh")


_add("refresh_run", _refresh_run, """SELECT CAST(u AS VARCHAR) AS pubkey,
  CASE WHEN u % 5 = 4 THEN '-' WHEN u % 5 = 3 THEN 'given' WHEN u % 2 = 0 THEN 'old' WHEN u % 5 IN (0, 1) AND u % 7 <> 0 THEN 'new' ELSE '-' END AS word,
  u % 5 IN (3, 4) OR (u % 5 IN (0, 1) AND u % 2 = 1 AND u % 7 <> 0) AS is_fresh
FROM (SELECT DISTINCT user_id AS u FROM events)""")


def _profile(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    name = F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_name"))
    content = F.when(F.col("c_custkey") % 11 == 0, "{broken").otherwise(F.to_json(F.struct(name.alias("name"), F.concat(F.lower("c_mktsegment"), F.lit("@x.org")).alias("nip05"), F.col("c_acctbal").cast("string").alias("about"))))
    key = F.sha2(F.col("c_custkey").cast("string").cast("binary"), 256)
    events = c.select(key.alias("id"), key.alias("pubkey"), F.lit(0).alias("kind"), F.lit(1).cast("long").alias("created_at"), content.alias("content"))
    found = latest.newest(events, ["pubkey"]).withColumn("profile", profiles.parse_profile(F.col("content")))
    return found.select("pubkey", profiles.short_name(F.col("profile"), F.substring("pubkey", 1, 8)).alias("short_name"))


_add("profile_parse", _profile, """SELECT sha256(CAST(c_custkey AS VARCHAR)) AS pubkey, CASE WHEN c_custkey % 11 = 0 THEN substring(sha256(CAST(c_custkey AS VARCHAR)), 1, 8)
  WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) ELSE c_name END AS short_name FROM customer""")


def _refresh(spark: SparkSession, d: str) -> DataFrame:
    n = notes(spark, d)
    attempts = n.where("kind = 7").groupBy("pubkey").agg(F.max("created_at").alias("last_attempt"))
    return lists.refresh_plan(n, n.where("kind = 0").select("pubkey").distinct(), attempts, _now(spark, d))


_add("refresh_plan", _refresh, f"""WITH {NOTES_SQL}, t AS (SELECT max(created_at) AS now FROM notes), a AS (SELECT pubkey, max(created_at) AS la FROM notes WHERE kind = 7 GROUP BY pubkey)
SELECT pubkey, CASE WHEN la IS NULL THEN 'missing' WHEN la < now - 172800 THEN 'stale' ELSE 'fresh' END AS state, la IS NOT NULL AND la >= now - 172800 AS is_fresh, la IS NULL OR la < now - 172800 AS fetch
FROM (SELECT DISTINCT pubkey FROM notes) LEFT JOIN a USING (pubkey), t""")

# Scalars

_add("hash_key", lambda s, d: notes(s, d).select("id", S.hash_prefix(F.col("k")).alias("h"), S.id_suffix(F.sha2(F.col("id").cast("binary"), 256)).alias("s")), f"WITH {NOTES_SQL} SELECT id, substring(sha256(k), 1, 16) AS h, substring(sha256(id), 49, 16) AS s FROM notes")
_NORMALIZE_SQL = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '^http', 'ws'), '^(wss?://[^/?]+)$', '\1/'), '^(wss?://[^/?]+/[^?]*[^/?])/+(\?|$)', '\1\2')"
_add("normalize_url", lambda s, d: table(s, d, "pages").select("page_id", S.normalize_url(F.col("url")).alias("url")), f"SELECT page_id, {_NORMALIZE_SQL} AS url FROM pages")
_add("simple_url", lambda s, d: table(s, d, "pages").select("page_id", S.simple_url(F.col("url")).alias("simple"), S.url_without_scheme(S.normalize_url(F.col("url"))).alias("bare"), S.http_url(S.normalize_url(F.col("url"))).alias("http")), rf"SELECT page_id, regexp_replace(regexp_replace(url, '^(wss?|https?)://', ''), '/$', '') AS simple, regexp_replace(replace(n, 'wss://', ''), '/+$', '') AS bare, regexp_replace(n, '^ws', 'http') AS http FROM (SELECT page_id, url, {_NORMALIZE_SQL} AS n FROM pages)")


def _addresses(spark: SparkSession, d: str) -> DataFrame:
    a = F.concat_ws(":", F.lit("30023"), F.sha2(F.col("pubkey").cast("binary"), 256), F.when(F.col("k").cast("int") % 2 == 0, F.col("k")).otherwise(F.concat(F.col("k"), F.lit(":x"))))
    n = notes(spark, d).select("id", a.alias("a"))
    return n.select("id", S.address_part(F.col("a"), "kind").alias("kind"), S.address_part(F.col("a"), "identifier").alias("identifier"), S.is_address(F.col("a")).alias("is_address"), S.is_hex32(S.address_part(F.col("a"), "pubkey")).alias("is_hex"))


_add("addr_split", _addresses, f"WITH {NOTES_SQL} SELECT id, '30023' AS kind, CASE WHEN CAST(k AS INT) % 2 = 0 THEN k ELSE k || ':x' END AS identifier, CAST(k AS INT) % 2 = 0 AS is_address, true AS is_hex FROM notes")
_add("get_tag_or", lambda s, d: notes(s, d).select("id", S.tag_or(F.col("tags"), "d", "none").alias("d"), S.tag_or(F.col("tags"), "t", "none").alias("t"), S.tag_or(F.col("tags"), "zz", "none").alias("zz")), f"WITH {NOTES_SQL} SELECT id, CASE WHEN kind = 30023 THEN k ELSE 'none' END AS d, event_type AS t, 'none' AS zz FROM notes")
_add("backoff_seconds", lambda s, d: table(s, d, "lineitem").select("l_linenumber").distinct().select("l_linenumber", S.backoff_seconds(F.col("l_linenumber")).cast("long").alias("seconds"), S.relays_per_user(F.col("l_linenumber") * 300).cast("long").alias("relays")), "SELECT DISTINCT l_linenumber, CAST(least(l_linenumber * 120, 600) AS BIGINT) AS seconds, CAST(CASE WHEN l_linenumber * 300 < 100 THEN 4 WHEN l_linenumber * 300 < 800 THEN 3 WHEN l_linenumber * 300 < 1200 THEN 2 ELSE 1 END AS BIGINT) AS relays FROM lineitem")
_add("array_helpers", lambda s, d: notes(s, d).select("id", F.array_join(S.unique(F.array("k", "event_type"), F.array("event_type", "k", "pubkey")), ",").alias("u"), F.array_join(S.append_unique(F.array("k", "k"), F.array("pubkey", "k")), ",").alias("a"), F.array_join(S.without(F.array("k", "pubkey", "k"), F.array(F.lit("3")), F.array(F.lit("5"))), ",").alias("w")), f"""WITH {NOTES_SQL}
SELECT id, CASE WHEN pubkey = k THEN k || ',' || event_type ELSE concat_ws(',', k, event_type, pubkey) END AS u, CASE WHEN pubkey = k THEN k || ',' || k ELSE concat_ws(',', k, k, pubkey) END AS a, array_to_string(list_filter([k, pubkey, k], lambda x: x NOT IN ('3', '5')), ',') AS w FROM notes""")
_add("json_round_trip", lambda s, d: raw_events.serialize(notes(s, d)).select(raw_events.parse(F.col("raw")).alias("e")).select("e.id", "e.pubkey", "e.kind", "e.created_at", F.size("e.tags").alias("n_tags"), F.get(F.col("e.tags"), F.lit(0))[1].alias("first")), f"WITH {NOTES_SQL} SELECT id, pubkey, kind, created_at, CASE WHEN kind IN (5, 30023) THEN 3 ELSE 2 END AS n_tags, event_type AS first FROM notes")
_add("kind_class", lambda s, d: notes(s, d).select("id", F.when(is_addressable(F.col("kind")), "addressable").when(is_replaceable(F.col("kind")), "replaceable").otherwise("regular").alias("class")), f"WITH {NOTES_SQL} SELECT id, CASE kind WHEN 30023 THEN 'addressable' WHEN 0 THEN 'replaceable' ELSE 'regular' END AS class FROM notes")
_add("tag_explode", lambda s, d: tag_rows(s, d).where(F.get("tag", F.lit(0)).isin("p", "r")).groupBy(F.get("tag", F.lit(0)).alias("name")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.get("tag", F.lit(1))).alias("distinct_values")), f"WITH {TAGS_SQL} SELECT CASE WHEN m IN (0, 1) THEN 'p' ELSE 'r' END AS name, count(*) AS n, count(DISTINCT CASE m WHEN 0 THEN h WHEN 1 THEN 'short' WHEN 5 THEN 'wss://r' || k || '.example.com/' WHEN 6 THEN 'wss://r' || k || '.example.com' ELSE 'wss://no.example.com' END) AS distinct_values FROM rows_ WHERE m IN (0, 1, 5, 6, 7) GROUP BY 1")

# Streams and extensions


def _stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """All events twice through a stream of files; each id comes out once."""
    out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = table(spark, d, "events")
    # Four files, two a batch, so that copies meet across batches.
    events.unionByName(events).repartition(4).write.parquet(f"{out}/files")
    twice = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(f"{out}/files")
    query = tail.deduplicated(twice, "ts", "event_id", "36500 days").select("event_id", "user_id", "event_type").writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("event_id long, user_id long, event_type string").parquet(f"{out}/rows")


_add("stream_dedupe", _stream_dedupe, "SELECT event_id, user_id, event_type FROM events")


def _tumbling(spark: SparkSession, d: str) -> DataFrame:
    e = notes(spark, d).select("kind", (F.col("created_at") - F.col("created_at") % 3600).alias("hour"))
    return e.groupBy("hour", "kind").agg(F.count(F.lit(1)).alias("n"))


_add("tumbling_window", _tumbling, f"WITH {NOTES_SQL} SELECT created_at - created_at % 3600 AS hour, kind, count(*) AS n FROM notes GROUP BY ALL")


def _session(spark: SparkSession, d: str) -> DataFrame:
    s = tail.sessions(table(spark, d, "events"), "user_id")
    zone = lambda c: F.unix_timestamp(c) - F.unix_timestamp(F.lit("1970-01-01 00:00:00").cast("timestamp"))
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"), F.min(zone(F.col("start"))).alias("first"))


_add("session_window", _session, """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g), c AS (SELECT user_id, sid, count(*) AS n, min(ts) AS t FROM s GROUP BY ALL)
SELECT user_id, count(*) AS sessions, max(n) AS longest, CAST(min(epoch_us(t) // 1000000) AS BIGINT) AS first FROM c GROUP BY user_id""")
_add("cube_counts", lambda s, d: notes(s, d).cube("kind", "pubkey").agg(F.count(F.lit(1)).alias("n")), f"WITH {NOTES_SQL} SELECT kind, pubkey, count(*) AS n FROM notes GROUP BY CUBE (kind, pubkey)")


def _asof(spark: SparkSession, d: str) -> DataFrame:
    n = notes(spark, d)
    marks = n.where("kind in (1, 0)").select("pubkey", "created_at", "id", "kind")
    w = W.partitionBy("pubkey").orderBy("created_at", F.col("kind"), F.col("id").cast("long")).rowsBetween(W.unboundedPreceding, 0)
    return marks.withColumn("profile", F.last(F.when(F.col("kind") == 0, F.col("id")), True).over(w)).where("kind = 1").select("id", "profile")


_add("asof_join", _asof, f"""WITH {NOTES_SQL} SELECT id, profile FROM (SELECT id, kind, last_value(CASE WHEN kind = 0 THEN id END IGNORE NULLS) OVER (PARTITION BY pubkey ORDER BY created_at, kind, CAST(id AS BIGINT) ROWS UNBOUNDED PRECEDING) AS profile FROM notes WHERE kind IN (0, 1)) WHERE kind = 1""")


def queries() -> dict[str, Query]:
    """Every query by name."""
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL with the same rows and column names."""
    return dict(_SQL)
