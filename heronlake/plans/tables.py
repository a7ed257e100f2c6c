"""The driver's tables as the engine's tables: ``events`` as notes, ``lineitem`` as follow edges, tags for lists."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = {"signup": 0, "click": 1, "error": 5, "view": 7, "purchase": 30023}
#: A fixed present, so that results are the same on every run.
NOW = 1_800_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a temporary folder where a local session has none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file://" + tempfile.mkdtemp(prefix="spark-heronlake-")


def seconds(ts: Column) -> Column:
    """Epoch seconds of a timestamp without a zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def tag(*parts: Column | str) -> Column:
    return F.array(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the protocol: id, pubkey, kind, created_at, tags, content, event_type and k.  Purchases are addressable by k; errors delete the author's purchase of their k."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[F.col("event_type")]
    base = e.select(F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("pubkey"), kind.alias("kind"), seconds(F.col("ts")).alias("created_at"), F.lit("").alias("sig"), "event_type", k.alias("k"), "value", F.col("props").alias("content"))
    own = F.when(F.col("event_type") == "purchase", F.array(tag("d", F.col("k")))).when(F.col("event_type") == "error", F.array(tag("a", F.concat_ws(":", F.lit("30023"), "pubkey", "k"))))
    tags = F.concat(F.array(tag("t", F.col("event_type")), tag("k", F.col("k"))), F.coalesce(own, F.array().cast("array<array<string>>")))
    return base.withColumn("tags", tags).withColumn("seen_on", F.lit(None).cast("array<string>"))


NOTES_SQL = """notes AS (
  SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS pubkey,
    CASE event_type WHEN 'signup' THEN 0 WHEN 'click' THEN 1 WHEN 'error' THEN 5 WHEN 'view' THEN 7 WHEN 'purchase' THEN 30023 END AS kind,
    CAST(epoch_us(ts) // 1000000 AS BIGINT) AS created_at, event_type, json_extract_string(props, '$.k') AS k, value
  FROM events)"""


def follows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges (src, dst) of all rows: a supplier follows, for each part it sells, the supplier of the part's first order line."""
    lines = table(spark, sf_dir, "lineitem")
    first = lines.groupBy("l_partkey").agg(F.min(F.struct("l_orderkey", "l_linenumber", "l_suppkey")).alias("line"))
    pairs = lines.select(F.col("l_suppkey").alias("src"), "l_partkey").distinct()
    return pairs.join(first, "l_partkey").select("src", F.col("line.l_suppkey").alias("dst")).distinct()


FOLLOWS_SQL = """first_lines AS (SELECT l_partkey, l_suppkey AS dst FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) = 1),
follows AS (SELECT DISTINCT l_suppkey AS src, dst FROM lineitem JOIN first_lines USING (l_partkey))"""


def relay_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's event types as relays, in the order of their first use: (pubkey, url, pos)."""
    from pyspark.sql import Window as W

    first = notes(spark, sf_dir).groupBy("pubkey", F.col("event_type").alias("url")).agg(F.min("created_at").alias("t"))
    return first.withColumn("pos", F.row_number().over(W.partitionBy("pubkey").orderBy("t", "url")))


RELAYS_SQL = NOTES_SQL + """, relays AS (
  SELECT pubkey, event_type AS url, row_number() OVER (PARTITION BY pubkey ORDER BY min(created_at), event_type) AS pos FROM notes GROUP BY pubkey, event_type)"""


def tag_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pubkey, event_type, pos, tag): a tag for each event, of sixteen forms in turn, some of them malformed."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    key = F.sha2(k.cast("binary"), 256)
    join = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    forms = [
        tag("p", key), tag("p", "short"), tag("relay", join("https://Host", k, ".example.com")), tag("a", join("30000:", key, ":d", k)),
        tag("a", join("30002:", key, ":x:", k), "wss://r.example"), tag("r", join("wss://r", k, ".example.com/")), tag("r", join("wss://r", k, ".example.com"), "read"), tag("r", "wss://no.example.com", "other"),
        tag("e", key, "wss://rr.example/x/", key), tag("t", join("tag", k)), tag("word", join("w", k)), tag("emoji", join("s", k), join("http://e/", k)),
        tag("group", join("g", k), "wss://g.example.com", join("n", k)), tag("server", join("https://m", k, ".example.com")), tag("url", join("http://u/", k)), tag("a", join("30030:", key, ":e", k)),
    ]
    form = F.lit(None).cast("array<string>")
    for i, f in reversed(list(enumerate(forms))):
        form = F.when(F.col("event_id") % 16 == i, f).otherwise(form)
    return e.select(F.col("user_id").cast("string").alias("pubkey"), "event_type", F.col("event_id").alias("pos"), form.alias("tag"))


TAGS_SQL = """rows_ AS (SELECT CAST(user_id AS VARCHAR) AS pubkey, event_type, event_id AS pos, event_id % 16 AS m,
    json_extract_string(props, '$.k') AS k, sha256(json_extract_string(props, '$.k')) AS h FROM events)"""


#: Each made list event holds the tags of so many events at most.
LIST_SPAN = 64


def list_events(spark: SparkSession, sf_dir: str, kind: int) -> DataFrame:
    """Events of a kind that hold all tags between them: an author for each user and LIST_SPAN ids, so that no event grows with the table."""
    author = F.concat_ws("-", "pubkey", F.floor(F.col("pos") / LIST_SPAN).cast("string"))
    rows = tag_rows(spark, sf_dir).groupBy(author.alias("pubkey")).agg(F.array_sort(F.collect_list(F.struct("pos", "tag"))).alias("l"))
    return rows.select(F.col("pubkey").alias("id"), "pubkey", F.lit(kind).alias("kind"), F.lit(1).cast("long").alias("created_at"), F.transform("l", lambda x: x["tag"]).alias("tags"))


def set_events(spark: SparkSession, sf_dir: str, kind: int) -> DataFrame:
    """The same with an event for each event type, which is its identifier."""
    author = F.concat_ws("-", "pubkey", F.floor(F.col("pos") / LIST_SPAN).cast("string"))
    rows = tag_rows(spark, sf_dir).groupBy(author.alias("pubkey"), "event_type").agg(F.array_sort(F.collect_list(F.struct("pos", "tag"))).alias("l"))
    tags = F.concat(F.array(tag("d", F.col("event_type")), tag("title", "")), F.transform("l", lambda x: x["tag"]))
    return rows.select(F.concat_ws(":", "pubkey", "event_type").alias("id"), "pubkey", F.lit(kind).alias("kind"), F.lit(1).cast("long").alias("created_at"), tags.alias("tags"))
