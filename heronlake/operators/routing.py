"""Which relay to ask for whom: picks, fan-out plans and fallbacks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heronlake.functions.scalars import backoff_seconds

Picker = Callable[[Column], Column]
#: Authors or identifiers of one request.
REQUEST = 500


def dealt(rows: DataFrame, group: Sequence[str], key: str, most: int = REQUEST) -> DataFrame:
    """Distinct rows (group, key) with ``request``: a group is dealt by a hash of the key to requests of about ``most`` rows, so that none grows with the group."""
    once = rows.select(*group, key).distinct()
    sizes = once.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / most).alias("_requests"))
    number = F.conv(F.substring(F.sha2(F.col(key).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return once.join(sizes, list(group)).withColumn("request", F.pmod(number, "_requests")).drop("_requests")


def first_writes(k: int = 2) -> Picker:
    """The first ``k`` write relays of a list."""
    return lambda items: F.slice(F.transform(F.filter(items, lambda i: i["write"]), lambda i: i["value"]), 1, k)


def usable(items: Column, blocked: Column) -> Column:
    """Write relays that are not backing off; ``blocked`` is an array of URLs."""
    return F.filter(items, lambda i: i["write"] & ~F.array_contains(blocked, i["value"]))


def pick(relay_lists: DataFrame, picker: Picker | None = None, fallback: Sequence[str] = ()) -> DataFrame:
    """(pubkey, url): the picked relays of each author, or the fallback where none is picked."""
    urls = (picker or first_writes())(F.coalesce(F.col("items"), F.array().cast(relay_lists.schema["items"].dataType)))
    if fallback:
        urls = F.when(F.size(urls) == 0, F.array(*[F.lit(u) for u in fallback])).otherwise(urls)
    return relay_lists.select("pubkey", F.explode(urls).alias("url")).distinct()


def resting(state: DataFrame, now: int) -> DataFrame:
    """(url) of the relays that may not be asked yet: a row of ``state`` (url, failures, last_attempt) for each."""
    return state.where((F.col("failures") > 0) & (F.col("last_attempt") + backoff_seconds(F.col("failures")) >= now)).select("url")


def pick_allowed(relays: DataFrame, blocked: DataFrame, k: int = 2) -> DataFrame:
    """(pubkey, url): the first ``k`` of each author's relays (pubkey, pos, url) that are not ``blocked`` (url)."""
    w = W.partitionBy("pubkey").orderBy("pos")
    return relays.join(blocked, "url", "left_anti").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).select("pubkey", "url")


def outbox_batch(picked: DataFrame, filters: Sequence[int] = (0,), per_author: int | None = None) -> DataFrame:
    """(url, filter_idx, request, authors, n_authors): requests for each relay and filter, of about REQUEST sorted authors each.

    With ``per_author``, an author is asked for at that many of its relays,
    those that most authors share first.
    """
    if per_author:
        counts = picked.groupBy("url").agg(F.count(F.lit(1)).alias("_n"))
        w = W.partitionBy("pubkey").orderBy(F.col("_n").desc(), "url")
        picked = picked.join(counts, "url").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_author).select("pubkey", "url")
    by_url = dealt(picked, ["url"], "pubkey").groupBy("url", "request").agg(F.array_sort(F.collect_list("pubkey")).alias("authors"))
    return by_url.select("url", F.explode(F.array(*[F.lit(i) for i in filters])).alias("filter_idx"), "request", "authors", F.size("authors").cast("long").alias("n_authors"))


def batch_sizes(picked: DataFrame) -> DataFrame:
    """(url, n_authors) for relays so common that their author lists should stay rows: counts only."""
    return picked.groupBy("url").agg(F.count_distinct("pubkey").alias("n_authors"))


def round_robin(rows: DataFrame, urls: Sequence[str], key: str = "pubkey", out: str = "url") -> DataFrame:
    """Deal rows to a list of URLs by a hash of their key: even, repeatable and without a global order."""
    return rows.withColumn(out, F.get(F.array(*[F.lit(u) for u in urls]), F.pmod(F.xxhash64(key), F.lit(len(urls))).cast("int")))


def shuffled(rows: DataFrame, seed: int = 0) -> DataFrame:
    """Rows in a random order that a seed fixes."""
    return rows.orderBy(F.rand(seed))


def first_tier(tiers: Sequence[DataFrame], key: str) -> DataFrame:
    """Of each key the row of the first source that has it, with ``tier``; later sources serve what earlier ones lack."""
    every = None
    for i, t in enumerate(tiers):
        t = t.withColumn("tier", F.lit(i))
        every = t if every is None else every.unionByName(t)
    best = every.groupBy(key).agg(F.min(F.struct("tier", F.struct(*every.columns).alias("row"))).alias("b"))
    return best.select("b.row.*")


def pointer_requests(pointers: DataFrame) -> DataFrame:
    """(kind, pubkey, request, identifiers): wanted addresses as requests for each kind and author, of about REQUEST sorted identifiers each."""
    named = dealt(pointers.where("identifier is not null"), ["kind", "pubkey"], "identifier")
    return named.groupBy("kind", "pubkey", "request").agg(F.array_sort(F.collect_list("identifier")).alias("identifiers"))


def relay_since(wanted: DataFrame) -> DataFrame:
    """(url, since): the earliest last attempt of (url, last_attempt); null where one was never made."""
    return wanted.groupBy("url").agg(F.when(F.count("last_attempt") == F.count(F.lit(1)), F.min("last_attempt")).alias("since"))
