"""An event store in Parquet snapshots, in buckets by author.

Plain Parquet has no MERGE.  Each table lies in ``buckets`` folders by a hash of
the author, and a change writes new folders for the buckets it touches only;
then a new version file names the folders that count, and readers of the old
ones are not disturbed.  There is one writer.  An id is a hash of its event,
the author included, so equal ids always meet in one bucket.  Files are sorted
by (pubkey, created_at): author, kind and time conditions skip row groups, and
conditions on authors skip whole buckets.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heronlake.operators.filters import MAX_LIMIT, Filter, matching, query
from heronlake.operators.latest import newest, per_key, surviving
from heronlake.operators.schema import EVENT_COLUMNS, EVENT_SCHEMA, identifier, is_addressable, kind_is_addressable, valid, with_derived

EVENTS = T.StructType([*EVENT_SCHEMA.fields, T.StructField("d", T.StringType()), T.StructField("created_day", T.IntegerType())])
BOUNDS = "pubkey string, kind int, oldest long, newest long"
ATTEMPTS = "kind int, pubkey string, d string, last_attempt long"
TABLES = {"events": EVENTS, "bounds": BOUNDS, "attempts": ATTEMPTS}
BUNDLE = 50


class EventStore:
    """Tables ``events``, ``bounds`` and ``attempts`` in one folder.

    ``buckets`` is fixed when the store is created: about the size of all
    events over that of a rewrite one change may cost.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path = spark, path.rstrip("/")
        self.buckets = self._version().get("buckets", buckets)

    # Versions

    def _fs(self):
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _names(self, folder: str) -> list[str]:
        fs, path = self._fs()
        at = path(folder)
        return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []

    def _numbers(self) -> list[int]:
        return [int(x.removesuffix(".json")) for x in self._names(f"{self.path}/versions") if x.endswith(".json") and not x.startswith("_")]

    def _version(self) -> dict:
        """The newest version: for each table the folder of every bucket that has rows."""
        numbers = self._numbers()
        return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.path}/versions/{numbers[-1]:012d}.json").collect())) if numbers else {}

    def _swap(self, **changes) -> None:
        """Publish a new version: a file that is complete before it gets its name, so no reader sees a part of it."""
        now = self._version() | changes
        number = max(self._numbers(), default=0) + 1
        fs, path = self._fs()
        temporary = path(f"{self.path}/versions/_{uuid.uuid4().hex}.json")
        out = fs.create(temporary)
        out.write(json.dumps(now).encode())
        out.close()
        if not fs.rename(temporary, path(f"{self.path}/versions/{number:012d}.json")):
            raise RuntimeError(f"version {number} was written by another writer")

    def _read(self, name: str, touched: Iterable[int] | None = None) -> DataFrame:
        """A table, or only some of its buckets."""
        held = self._version().get(name, {})
        wanted = held if touched is None else [str(b) for b in set(touched) if str(b) in held]
        if not wanted:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(*[f"{self.path}/{held[b]}/bucket={b}" for b in sorted(wanted, key=int)])

    def _put(self, name: str, rows: DataFrame, touched: Sequence[int], order: Sequence[str]) -> None:
        """Replace the buckets ``touched`` of a table by ``rows``.  A bucket with much of the data is split among tasks by Spark's rebalancing."""
        folder = f"{name}-{uuid.uuid4().hex}"
        dealt = rows.withColumn("bucket", self._bucket()).hint("rebalance", "bucket")
        dealt.sortWithinPartitions("bucket", *order).write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        written = [x.removeprefix("bucket=") for x in self._names(f"{self.path}/{folder}") if x.startswith("bucket=")]
        kept = {b: f for b, f in self._version().get(name, {}).items() if int(b) not in touched}
        self._swap(**{name: kept | dict.fromkeys(written, folder)})

    def _bucket(self) -> Column:
        return F.pmod(F.crc32(F.coalesce("pubkey", F.lit("")).cast("binary")), F.lit(self.buckets)).cast("int")

    def _touched(self, rows: DataFrame) -> list[int]:
        """The buckets of some rows: at most as many as there are."""
        return [r[0] for r in rows.select(self._bucket().alias("b")).distinct().collect()]

    def create(self) -> None:
        """Make empty tables where there are none."""
        if not self._version():
            self._swap(buckets=self.buckets, **{name: {} for name in TABLES})

    def drop(self) -> None:
        """Delete the store's folder."""
        fs, path = self._fs()
        fs.delete(path(self.path), True)

    def vacuum(self) -> int:
        """Delete folders and version files that the newest version doesn't need, and return how many.

        Only when nobody reads an older version or a result that was returned before.
        """
        fs, path = self._fs()
        current = self._version()
        needed = {f"{folder}/bucket={b}" for name in TABLES for b, folder in current.get(name, {}).items()}
        roots = {x.split("/")[0] for x in needed}
        old = [f"versions/{n:012d}.json" for n in self._numbers()[:-1]]
        for folder in self._names(self.path):
            if folder not in roots:
                old += [folder] if folder != "versions" else []
            else:
                old += [x for x in (f"{folder}/{b}" for b in self._names(f"{self.path}/{folder}") if b.startswith("bucket=")) if x not in needed]
        for x in old:
            fs.delete(path(f"{self.path}/{x}"), True)
        return len(old)

    def catalog(self) -> DataFrame:
        """(name, size, last_modified) of the current tables; an empty one has size 0 and no time."""
        fs, path = self._fs()
        rows = []
        for name in sorted(TABLES):
            at = [path(f"{self.path}/{folder}/bucket={b}") for b, folder in self._version().get(name, {}).items()]
            rows.append((name, sum(fs.getContentSummary(x).getLength() for x in at), max((fs.getFileStatus(x).getModificationTime() // 1000 for x in at), default=None)))
        return self.spark.createDataFrame(rows, "name string, size long, last_modified long")

    # Events

    def events(self, authors: Sequence[str] | None = None) -> DataFrame:
        """All stored events, or those in the buckets of some authors."""
        return self._read("events", None if authors is None else {zlib.crc32((a or "").encode()) % self.buckets for a in authors})

    def _matching(self, f: Filter) -> DataFrame:
        return self.events(f.authors if f.ids is None else None)

    def query(self, f: Filter | Mapping, most: int = MAX_LIMIT) -> DataFrame:
        """The newest events that match."""
        f = f if isinstance(f, Filter) else Filter.of(f)
        return query(self._matching(f), f, most).select(*EVENT_COLUMNS)

    def _replace(self, events: DataFrame, touched: Sequence[int]) -> None:
        self._put("events", with_derived(events.select(*EVENT_COLUMNS)), touched, ("pubkey", "created_at"))

    def save(self, batch: DataFrame, last_attempt: int | None = None) -> DataFrame:
        """Save events and return (id, stored) for each distinct id of the batch.

        A known id is not stored again.  A replaceable event is stored only if
        it is newer than what is there.  An all-zero id stands for "looked, and
        there was none": only the attempt is recorded.  ``_arrival`` orders the
        batch where it has that column, else time and id do.  Only the buckets
        of the batch's authors are read and written.  The batch is written once
        before, so that the answer fits what was stored whatever its source.
        """
        batch = self.stage(batch)
        if "_arrival" not in batch.columns:
            batch = batch.withColumn("_arrival", F.struct("created_at", "id"))
        new = valid(batch).select(*EVENT_COLUMNS, "_arrival").withColumn("_old", F.lit(1))
        touched = self._touched(new)
        old = self._read("events", touched).select(*EVENT_COLUMNS).withColumn("_old", F.lit(0))
        if touched:
            arrival = F.struct(F.col("_old").alias("o"), F.col("_arrival").alias("a"))
            every = old.withColumn("_arrival", F.lit(None).cast(new.schema["_arrival"].dataType)).unionByName(new).withColumn("_arrival", arrival)
            once = every.groupBy("id").agg(F.min_by(F.struct(*every.columns), "_arrival").alias("r")).select("r.*")
            self._replace(surviving(once), touched)
        if last_attempt:
            self.attempt(batch, last_attempt)
        ids = old.select("id").withColumn("_known", F.lit(True))
        stored = self._read("events", touched).select("id").withColumn("_held", F.lit(True))
        return batch.select("id").distinct().join(ids, "id", "left").join(stored, "id", "left").select("id", (F.col("_known").isNull() & F.col("_held").isNotNull()).alias("stored"))

    def attempt(self, rows: DataFrame, now: int) -> None:
        """Record that (kind, pubkey, d) of some rows was looked for; the latest time stays."""
        d = F.when(is_addressable(F.col("kind")), identifier(F.col("tags"))).otherwise(F.lit(""))
        new = rows.select("kind", "pubkey", d.alias("d"), F.lit(now).cast("long").alias("last_attempt"))
        touched = self._touched(new)
        every = self._read("attempts", touched).unionByName(new)
        self._put("attempts", every.groupBy("kind", "pubkey", "d").agg(F.max("last_attempt").alias("last_attempt")), touched, ("pubkey", "kind"))

    def stage(self, rows: DataFrame) -> DataFrame:
        """Rows as they are now; ``vacuum`` deletes them."""
        folder = f"{self.path}/staged-{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        return self.spark.read.schema(rows.schema).parquet(folder)

    def _remove(self, found: DataFrame) -> DataFrame:
        """Delete the events with the ids of ``found`` (id, pubkey) and return the ids."""
        found = self.stage(found.select("id", "pubkey").distinct())
        touched = self._touched(found)
        if touched:
            self._replace(self._read("events", touched).join(found.select("id"), "id", "left_anti"), touched)
        return found.select("id")

    def delete_rows(self, found: DataFrame) -> DataFrame:
        """Delete the events of some rows (id, pubkey) and return the ids."""
        return self._remove(found)

    def delete(self, filters: Sequence[Filter | Mapping], limit: int | None = None) -> DataFrame:
        """Delete what the filters match, each up to its limit if there is one, and return the ids."""
        found = self.spark.createDataFrame([], "id string, pubkey string")
        for f in (x if isinstance(x, Filter) else Filter.of(x) for x in filters):
            rows = matching(self._matching(f), f)
            n = f.limit or limit
            found = found.unionByName((rows.orderBy(F.col("created_at").desc(), "id").limit(n) if n else rows).select("id", "pubkey"))
        return self._remove(found)

    def delete_replaceable(self, kind: int, pubkey: str) -> DataFrame:
        """Delete all events of an author and kind."""
        return self.delete([Filter(authors=[pubkey], kinds=[kind])])

    def apply_deletions(self, strict: bool = True, batch: DataFrame | None = None) -> DataFrame:
        """Delete what stored deletion events (kind 5) point to; return the ids.

        After saving a ``batch``, only its authors' buckets can hold anything
        new to delete, as long as deletions are strict.
        """
        events = self._read("events", self._touched(batch) if strict and batch is not None else None)
        return self._remove(deleted_by(events, strict).join(events.select("id", "pubkey"), "id"))

    def load_replaceables(self, specs: DataFrame) -> DataFrame:
        """For each row (pos, kind, pubkey, d) the last attempt and the event, or the newest 50 where an addressable kind has a null d."""
        touched = self._touched(specs)
        return load_replaceables(specs, self._read("events", touched), self._read("attempts", touched))

    # Bounds

    def bounds(self) -> DataFrame:
        """(pubkey, kind, oldest, newest)."""
        return self._read("bounds")

    def bounds_map(self) -> DataFrame:
        """(pubkey, kinds): a map from kind to [oldest, newest]."""
        return bounds_map(self.bounds())

    def set_bounds(self, rows: DataFrame) -> None:
        """Upsert bounds; given rows win."""
        touched = self._touched(rows)
        old = self._read("bounds", touched).join(rows, ["pubkey", "kind"], "left_anti")
        self._put("bounds", old.unionByName(rows.select("pubkey", "kind", "oldest", "newest")), touched, ("pubkey", "kind"))


def bounds_map(bounds: DataFrame) -> DataFrame:
    """(pubkey, kinds): a map from kind to [oldest, newest]; an author has as many entries as there are kinds."""
    pair = F.struct("kind", F.array("oldest", "newest"))
    return bounds.groupBy("pubkey").agg(F.map_from_entries(F.collect_list(pair)).alias("kinds"))


def deleted_by(events: DataFrame, strict: bool = True) -> DataFrame:
    """Ids of events that kind-5 events delete, by ``e`` tags (ids) and ``a`` tags (addresses).

    With ``strict`` only an author's own events go, and only those not newer
    than the deletion.
    """
    marks = events.where("kind = 5").select(F.col("pubkey").alias("_by"), F.col("created_at").alias("_at"), F.explode("tags").alias("t"))
    marks = marks.select("_by", "_at", F.get("t", F.lit(0)).alias("_name"), F.get("t", F.lit(1)).alias("_value")).where("_name in ('e', 'a')")
    allowed = (F.col("pubkey") == F.col("_by")) & (F.col("created_at") <= F.col("_at")) if strict else F.lit(True)
    keyed = events.where("kind <> 5").select("id", "pubkey", "created_at", F.concat_ws(":", F.col("kind").cast("string"), "pubkey", identifier(F.col("tags"))).alias("_address"))
    by_id = keyed.join(marks.where("_name = 'e'"), F.col("id") == F.col("_value")).where(allowed).select("id")
    by_address = keyed.join(marks.where("_name = 'a'"), F.col("_address") == F.col("_value")).where(allowed).select("id")
    return by_id.unionByName(by_address).distinct()


def load_replaceables(specs: DataFrame, events: DataFrame, attempts: DataFrame, most: int = BUNDLE) -> DataFrame:
    """(pos, last_attempt, events): what is stored for each wanted (pos, kind, pubkey, d), newest first.

    ``d`` null asks for all identifiers of an addressable kind, at most
    ``most``; the last attempt is then the latest of them.
    """
    row = F.struct(*EVENT_COLUMNS)
    d = F.when(is_addressable(F.col("kind")), identifier(F.col("tags"))).otherwise(F.lit(""))
    held = events.join(specs.select("kind", "pubkey").distinct(), ["kind", "pubkey"], "left_semi").withColumn("_d", d)
    held = newest(held, ["kind", "pubkey", "_d"])
    one = specs.where(F.col("d").isNotNull() | ~is_addressable(F.col("kind"))).withColumn("_d", F.coalesce("d", F.lit("")))
    found = one.join(held.select("kind", "pubkey", "_d", F.array(row).alias("events")), ["kind", "pubkey", "_d"], "left")
    found = found.join(attempts.withColumnRenamed("d", "_d"), ["kind", "pubkey", "_d"], "left").select("pos", "last_attempt", "events")
    bundles = specs.where(F.col("d").isNull() & is_addressable(F.col("kind")))
    top = per_key(held, ["kind", "pubkey"], most)
    listed = top.groupBy("kind", "pubkey").agg(F.array_sort(F.collect_list(F.struct((-F.col("created_at")).alias("_t"), "id", row.alias("row")))).alias("l"))
    listed = listed.select("kind", "pubkey", F.transform("l", lambda x: x["row"]).alias("events"))
    tried = attempts.groupBy("kind", "pubkey").agg(F.max("last_attempt").alias("last_attempt"))
    many = bundles.join(listed, ["kind", "pubkey"], "left").join(tried, ["kind", "pubkey"], "left").select("pos", "last_attempt", "events")
    return found.unionByName(many)


def specs_of(spark: SparkSession, wanted: Sequence[tuple[int, str, str | None]]) -> DataFrame:
    """Wanted (kind, pubkey, d) as a table with their positions."""
    schema = T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("pubkey", T.StringType()), T.StructField("d", T.StringType())])
    return spark.createDataFrame([(i, k, p, d if kind_is_addressable(k) else "") for i, (k, p, d) in enumerate(wanted)], schema)
