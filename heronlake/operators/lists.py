"""Typed lists and sets from the tags of each author's newest event of a kind."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heronlake.functions.scalars import address_part, is_hex32, normalize_url, present, tag_or, tag_value
from heronlake.operators.latest import newest

#: One type for items of every list; what a list doesn't use is null.
ITEM = T.StructType(
    [
        T.StructField("item_type", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("kind", T.IntegerType()),
        T.StructField("pubkey", T.StringType()),
        T.StructField("identifier", T.StringType()),
        T.StructField("relays", T.ArrayType(T.StringType())),
        T.StructField("read", T.BooleanType()),
        T.StructField("write", T.BooleanType()),
        T.StructField("name", T.StringType()),
        T.StructField("url", T.StringType()),
    ]
)
TagItem = Callable[[Column], Column]


def item(item_type: str, **fields: Column) -> Column:
    """An item struct; missing fields are null."""
    return F.struct(*[(F.lit(item_type) if f.name == "item_type" else fields.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in ITEM])


def _at(t: Column, i: int) -> Column:
    return F.get(t, F.lit(i))


def _named(t: Column, name: str) -> Column:
    return F.coalesce(_at(t, 0) == name, F.lit(False))


def value_item(name: str, item_type: str, hex_only: bool = False) -> TagItem:
    """Tags of a name whose value is not empty, or is a 32-byte hex string."""

    def run(t: Column) -> Column:
        ok = is_hex32(_at(t, 1)) if hex_only else present(_at(t, 1)).isNotNull()
        return F.when(_named(t, name) & ok, item(item_type, value=_at(t, 1)))

    return run


def relay_item(name: str = "relay") -> TagItem:
    """Tags of a name as normalised relay URLs."""
    return lambda t: F.when(_named(t, name) & present(_at(t, 1)).isNotNull(), item("relay", value=normalize_url(_at(t, 1))))


def pointer_item(kind: int | None) -> TagItem:
    """``a`` tags of one kind, or any, with a hex public key, as address pointers."""

    def run(t: Column) -> Column:
        a = _at(t, 1)
        ok = _named(t, "a") & is_hex32(address_part(a, "pubkey"))
        ok = ok & ((address_part(a, "kind") == str(kind)) if kind is not None else address_part(a, "kind").rlike("^[0-9]{1,9}$"))
        relays = F.when(present(_at(t, 2)).isNotNull(), F.array(_at(t, 2)))
        return F.when(F.coalesce(ok, F.lit(False)), item("pointer", kind=address_part(a, "kind").try_cast("int"), pubkey=address_part(a, "pubkey"), identifier=address_part(a, "identifier"), relays=relays))

    return run


def _read_write(t: Column) -> Column:
    two = F.size(t) == 2
    mode = _at(t, 2)
    ok = _named(t, "r") & present(_at(t, 1)).isNotNull() & (two | F.coalesce(mode.isin("read", "write"), F.lit(False)))
    return F.when(ok, item("relay", value=normalize_url(_at(t, 1)), read=two | (mode == "read"), write=two | (mode == "write")))


def _scroll(t: Column) -> Column:
    relays = F.when(present(_at(t, 2)).isNotNull(), F.array(normalize_url(_at(t, 2))))
    return F.when(_named(t, "e") & is_hex32(_at(t, 1)), item("event", value=_at(t, 1), kind=F.lit(1227), relays=relays, pubkey=F.when(is_hex32(_at(t, 3)), _at(t, 3))))


def _emoji(t: Column) -> Column:
    return F.when(_named(t, "emoji") & (F.size(t) >= 3), item("emoji", name=_at(t, 1), url=_at(t, 2)))


def _group(t: Column) -> Column:
    return F.when(_named(t, "group") & (F.size(t) >= 3), item("group", value=_at(t, 1), url=normalize_url(_at(t, 2)), name=_at(t, 3)))


def _server(t: Column) -> Column:
    return F.when(_named(t, "server") & present(_at(t, 1)).isNotNull(), item("server", value=F.regexp_replace(normalize_url(_at(t, 1)), "^ws", "http")))


def any_of(*parts: TagItem) -> TagItem:
    """The first of several parsers that takes a tag."""
    return lambda t: F.coalesce(*[p(t) for p in parts])


@dataclass(frozen=True)
class ListSpec:
    """A list or set: the kind of its events and how a tag becomes an item."""

    kind: int
    parse: TagItem
    is_set: bool = False


_PUBKEYS = value_item("p", "pubkey", hex_only=True)
SPECS: dict[str, ListSpec] = {
    "follows": ListSpec(3, _PUBKEYS),
    "wiki_authors": ListSpec(10101, _PUBKEYS),
    "wiki_relays": ListSpec(10102, relay_item()),
    "favorite_follow_sets": ListSpec(10021, pointer_item(30000)),
    "favorite_relays": ListSpec(10012, any_of(relay_item(), pointer_item(30002))),
    "relay_list": ListSpec(10002, _read_write),
    "favorite_scrolls": ListSpec(10027, _scroll),
    "mutes": ListSpec(10000, any_of(_PUBKEYS, value_item("e", "thread", hex_only=True), value_item("t", "hashtag"), value_item("word", "word"))),
    "bookmarks": ListSpec(10003, any_of(value_item("e", "event"), value_item("a", "address"))),
    "blossom_servers": ListSpec(10063, _server),
    "emojis": ListSpec(10030, any_of(pointer_item(30030), _emoji)),
    "pins": ListSpec(10001, value_item("e", "event")),
    "blocked_relays": ListSpec(10006, relay_item()),
    "search_relays": ListSpec(10007, relay_item()),
    "profile_badges": ListSpec(10008, any_of(pointer_item(None), value_item("e", "event", hex_only=True))),
    "simple_groups": ListSpec(10009, _group),
    "git_authors": ListSpec(10017, _PUBKEYS),
    "git_repositories": ListSpec(10018, value_item("a", "address")),
    "media_follows": ListSpec(10020, _PUBKEYS),
    "dm_relays": ListSpec(10050, relay_item()),
    "favorite_podcasts": ListSpec(10054, any_of(_PUBKEYS, value_item("url", "url"))),
    "authored_podcasts": ListSpec(10064, _PUBKEYS),
    "follow_sets": ListSpec(30000, _PUBKEYS, True),
    "follow_packs": ListSpec(39089, _PUBKEYS, True),
    "relay_sets": ListSpec(30002, relay_item(), True),
    "emoji_sets": ListSpec(30030, _emoji, True),
}


def items(tags: Column, parse: TagItem) -> Column:
    """The items of all tags that a parser takes, in order."""
    return F.filter(F.transform(tags, lambda t: parse(t)), lambda x: x.isNotNull())


def item_rows(tags: DataFrame, parse: TagItem) -> DataFrame:
    """Rows with a column ``tag`` as rows with a column ``item``, without those that a parser doesn't take; no list is collected."""
    return tags.withColumn("item", parse(F.col("tag"))).where("item is not null").drop("tag")


def load_list(events: DataFrame, spec: ListSpec, kind: int | None = None) -> DataFrame:
    """(pubkey, event_id, created_at, items) of every author's newest list."""
    own = newest(events.where(F.col("kind") == (spec.kind if kind is None else kind)), ["pubkey"])
    return own.select("pubkey", F.col("id").alias("event_id"), "created_at", items(F.col("tags"), spec.parse).alias("items"))


def load_set(events: DataFrame, spec: ListSpec, kind: int | None = None) -> DataFrame:
    """(pubkey, kind, d, event_id, created_at, items, title, image, description) of every author's newest set of each identifier."""
    own = events.where(F.col("kind") == (spec.kind if kind is None else kind)).withColumn("d", F.coalesce(tag_value(F.col("tags"), "d"), F.lit("")))
    own = newest(own, ["pubkey", "kind", "d"])
    optional = [present(tag_value(F.col("tags"), name)).alias(name) for name in ("image", "description")]
    return own.select("pubkey", "kind", "d", F.col("id").alias("event_id"), "created_at", items(F.col("tags"), spec.parse).alias("items"), tag_or(F.col("tags"), "title", F.col("d")).alias("title"), *optional)


def resolve_rows(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """The columns of ``rows`` (one of them ``item``) with the ``set_items`` and ``title`` of the set that a pointer names, a row for each item.

    A pointer without a set has no items.
    """
    named = sets.select(F.col("kind").alias("_k"), F.col("pubkey").alias("_p"), F.col("d").alias("_d"), F.col("items").alias("_items"), "title")
    joined = rows.join(named, (F.col("item.kind") == F.col("_k")) & (F.col("item.pubkey") == F.col("_p")) & (F.col("item.identifier") == F.col("_d")), "left")
    inner = F.when(F.col("item.item_type") == "pointer", F.coalesce("_items", F.array().cast(T.ArrayType(ITEM))))
    return joined.select(*rows.columns, inner.alias("set_items"), "title")


def resolve_pointers(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """Replace pointers in lists by the sets they name: (pubkey, items), an item with its set's items and title, in place.

    A pointer without a set has no items.
    """
    joined = resolve_rows(lists.select("pubkey", F.posexplode_outer("items").alias("pos", "item")), sets)
    entry = F.struct("pos", "item", "set_items", "title")
    # The items of one list: bounded by an event's tags.
    return joined.groupBy("pubkey").agg(F.array_sort(F.collect_list(F.when(F.col("item").isNotNull(), entry)), _by_pos).alias("items"))


def _by_pos(a: Column, b: Column) -> Column:
    return a["pos"] - b["pos"]


def staleness(last_attempt: Column, now: int, ttl: int = 2 * 86400) -> Column:
    """``missing``, ``stale`` or ``fresh`` by when something was last looked for."""
    return F.when(last_attempt.isNull(), "missing").when(last_attempt < now - ttl, "stale").otherwise("fresh")


def refresh_plan(requests: DataFrame, stored: DataFrame, attempts: DataFrame, now: int, mode: str = "default", ttl: int = 2 * 86400) -> DataFrame:
    """(pubkey, state, is_fresh, fetch) of each requested author.

    Modes: ``default`` fetches what is missing or stale, ``force`` everything,
    ``cache_only`` nothing.
    """
    known = requests.select("pubkey").distinct().join(stored.select("pubkey", F.lit(True).alias("_held")), "pubkey", "left").join(attempts.select("pubkey", "last_attempt"), "pubkey", "left")
    state = staleness(F.col("last_attempt"), now, ttl)
    fetch = {"default": state != "fresh", "force": F.lit(True), "cache_only": F.lit(False)}[mode]
    return known.select("pubkey", state.alias("state"), (state == "fresh").alias("is_fresh"), fetch.alias("fetch"))


def run_refresh(store, source: DataFrame, requests: DataFrame, spec: ListSpec, now: int, provided: DataFrame | None = None, ttl: int = 2 * 86400) -> DataFrame:
    """Load the lists of the requested authors, from the store or the ``source``: (pubkey, event_id, items, is_fresh).

    ``requests`` is (pubkey, mode), one row for each author.  ``default``
    fetches what is missing or older than ``ttl``, ``force`` everything,
    ``cache_only`` nothing; ``provided`` saves and uses the author's event of
    the table ``provided``; ``reset`` deletes what is stored.  What is stored
    is used at once even if a newer version is fetched; that one is saved, so
    the next request finds it.  An attempt is recorded for every author that
    was fetched for, found or not.
    """
    requests = store.stage(requests.select("pubkey", "mode"))
    wanted = requests.select(F.xxhash64("pubkey").alias("pos"), F.lit(spec.kind).alias("kind"), "pubkey", F.lit("").alias("d"))
    reset = requests.where("mode = 'reset'").select("pubkey")
    own = store.events().where(F.col("kind") == spec.kind)
    store.delete_rows(own.join(reset, "pubkey", "left_semi"))
    given = None
    if provided is not None:
        given = store.stage(newest(provided.where(F.col("kind") == spec.kind).join(requests.where("mode = 'provided'").select("pubkey"), "pubkey", "left_semi"), ["pubkey"]))
        store.save(given, now)
    before = wanted.select("pos", "pubkey").join(store.load_replaceables(wanted), "pos").select("pubkey", "last_attempt", F.get("events", F.lit(0)).alias("stored"))
    state = store.stage(requests.join(before, "pubkey"))
    old = F.col("stored").isNull() | F.col("last_attempt").isNull() | (F.col("last_attempt") < now - ttl)
    due = state.where(((F.col("mode") == "default") & old) | (F.col("mode") == "force")).select("pubkey")
    found = store.stage(newest(source.where(F.col("kind") == spec.kind).join(due, "pubkey", "left_semi"), ["pubkey"]))
    store.save(found)
    store.attempt(due.select(F.lit(spec.kind).alias("kind"), "pubkey", F.array().cast("array<array<string>>").alias("tags")), now)
    fetched = found.select("pubkey", F.col("id").alias("_id"), F.col("tags").alias("_tags"))
    joined = state.join(fetched, "pubkey", "left")
    fresh = F.col("mode").isin("reset", "provided") | (F.col("stored").isNull() & F.col("_id").isNotNull())
    tags = F.coalesce(F.col("stored")["tags"], F.col("_tags"), F.array().cast("array<array<string>>"))
    return joined.select("pubkey", F.coalesce(F.col("stored")["id"], "_id").alias("event_id"), items(tags, spec.parse).alias("items"), fresh.alias("is_fresh"))
