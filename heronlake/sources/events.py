"""Readers and writers of raw event JSON, and of recorded relays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heronlake.operators.schema import EVENT_COLUMNS, EVENT_SCHEMA


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Events of JSON lines; lines that are no event become rows of nulls and are left out."""
    return spark.read.schema(EVENT_SCHEMA).json(path).where("id is not null")


def read_stream(spark: SparkSession, path: str, **options) -> DataFrame:
    """New JSON-lines files of a folder, as a stream of events."""
    return spark.readStream.schema(EVENT_SCHEMA).options(**options).json(path)


def parse(raw: Column) -> Column:
    """A raw event string as a struct."""
    return F.from_json(raw, EVENT_SCHEMA)


def serialize(events: DataFrame, out: str = "raw") -> DataFrame:
    """Each event as one JSON string; a null ``seen_on`` is left out."""
    return events.select("id", F.to_json(F.struct(*EVENT_COLUMNS)).alias(out))


def read_relays(spark: SparkSession, folder: str, since: int = 0) -> DataFrame:
    """Events of recorded relays, JSON lines in ``folder/<name>.jsonl`` on any store that Spark reads, with the relay's name in ``seen_on``."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.jsonl$", 1)
    events = spark.read.schema(EVENT_SCHEMA).option("pathGlobFilter", "*.jsonl").json(folder).where(F.col("id").isNotNull() & (F.col("created_at") >= since))
    return events.withColumn("seen_on", F.array(F.url_decode(name))).select(*EVENT_COLUMNS)
