"""Profiles from the JSON content of kind-0 events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heronlake.functions.scalars import npub, present, short_npub
from heronlake.operators.latest import newest

FIELDS = ("name", "display_name", "about", "picture", "website", "banner", "nip05", "lud16", "lud06")
PROFILE = T.StructType([T.StructField(f, T.StringType()) for f in FIELDS])


def parse_profile(content: Column) -> Column:
    """The content as a struct; null fields where it is no JSON object."""
    return F.from_json(content, PROFILE, {"mode": "PERMISSIVE"})


def short_name(profile: Column, fallback: Column) -> Column:
    """The first of name, display name and the part of nip05 before ``@`` that is not empty, else the fallback."""
    return F.coalesce(present(profile["name"]), present(profile["display_name"]), present(F.get(F.split(profile["nip05"], "@"), F.lit(0))), fallback)


def load_profiles(events: DataFrame) -> DataFrame:
    """(pubkey, npub, short_name, image, profile, created_at) of each author's newest profile."""
    own = newest(events.where("kind = 0"), ["pubkey"]).withColumn("profile", parse_profile(F.col("content"))).withColumn("npub", npub(F.col("pubkey")))
    return own.select("pubkey", "npub", short_name(F.col("profile"), F.coalesce(short_npub(F.col("npub")), F.col("pubkey"))).alias("short_name"), F.col("profile.picture").alias("image"), "profile", "created_at")


def needs_refetch(profile: Column, last_attempt: Column, now: int, ttl: int = 2 * 86400, empty_ttl: int = 3600) -> Column:
    """Missing, older than ``ttl``, or without name, picture and about and older than ``empty_ttl``."""
    empty = F.coalesce(present(profile["name"]), present(profile["picture"]), present(profile["about"])).isNull()
    return last_attempt.isNull() | (last_attempt < now - ttl) | (empty & (last_attempt < now - empty_ttl))
