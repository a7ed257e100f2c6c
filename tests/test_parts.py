"""Scalars, pointers, back-off, streams and sources."""

import json
import os

import pytest
from pyspark.sql import functions as F

from heronlake.functions import scalars as S
from heronlake.operators.graph import needs_refresh
from heronlake.operators.profiles import load_profiles, needs_refetch, parse_profile
from heronlake.operators.routing import first_tier, round_robin
from heronlake.operators.schema import EVENT_SCHEMA
from heronlake.operators.store import EventStore
from heronlake.sources import events as sources
from heronlake.streaming import tail


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("o")).first()["o"]


def test_urls(spark):
    cases = {"https://Relay.Example.com": "wss://relay.example.com/", "wss://a.b/x/": "wss://a.b/x", "wss://a.b:443/x#frag": "wss://a.b/x", "ws://a.b:80": "ws://a.b/", "wss://a.b/x/?q=1": "wss://a.b/x?q=1", None: None, "": ""}
    for url, expected in cases.items():
        assert one(spark, url, S.normalize_url) == expected, url
    assert one(spark, "wss://a.b//", S.url_without_scheme) == "a.b"


def test_hex_and_addresses(spark):
    key = "a" * 64
    assert [one(spark, v, S.is_hex32) for v in (key, key + "zz", "A" * 64, "", None)] == [True, True, False, False, False]
    assert [one(spark, v, S.is_address) for v in (f"1:{key}:x", f"1:{key}:x:y", f"1:{key}:", None)] == [True, False, False, False]
    assert one(spark, f"1:{key}:x:y", lambda c: S.address_part(c, "identifier")) == "x:y"
    assert one(spark, "nothing", lambda c: S.address_part(c, "kind")) is None


def test_bech32():
    key = bytes(range(32))
    assert S.bech32_decode(S.bech32_encode("npub", key)) == ("npub", key)
    # The test vector of BIP 173 for an empty payload.
    assert S.bech32_decode("a12uel5l") == ("a", b"")
    assert S.bech32_decode("a12uel5x") is None
    entries = b"\x00\x03abc\x01\x05wss:/\x02\x20" + key + b"\x03\x04" + (30023).to_bytes(4, "big")
    assert S.decode_pointer(S.bech32_encode("naddr", entries)) == {"relays": ["wss:/"], "identifier": "abc", "pubkey": key.hex(), "kind": 30023}
    assert S.decode_pointer("f" * 64) == {"id": "f" * 64} and S.decode_pointer("junk") is None


def test_backoff_table(spark):
    # (failures, age of the last attempt in minutes) -> allowed, failures after
    for failures, age, allowed, after in [(2, 3, False, 2), (2, 5, True, 1), (1, 3, True, 0), (6, 8, False, 6), (6, 11, True, 5)]:
        assert tail.backoff_step(failures, 100_000 - 60 * age, "ask", 100_000)[:2] == (allowed, after)
    rows = [(1, "failure"), (2, "failure"), (3, "ask"), (400, "ask"), (401, "ask"), (2000, "ask")]
    state = failures, last = (0, 0)
    for at, what in rows:
        allowed, failures, last = tail.backoff_step(failures, last, what, at)
    got = spark.createDataFrame([(rows,)], "l array<struct<ts:long,what:string>>").select(tail.backoff_fold(F.col("l")).alias("s")).first()["s"]
    assert (got["failures"], got["last_attempt"], got["allowed"]) == (failures, last, allowed)
    assert state == (0, 0)


def test_backoff_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [{"url": "wss://a", "at": a, "what": w} for a, w in [(1, "failure"), (2, "ask"), (500, "ask")]]
    (tmp_path / "in" / "1.json").write_text("\n".join(map(json.dumps, lines)))
    stream = spark.readStream.schema("url string, at long, what string").json(str(tmp_path / "in"))
    query = tail.backoff_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted((r["at"], r["allowed"], r["failures"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, None, 1), (2, False, 1), (500, True, 0)]


def test_live_tail_equals_batch(spark, tmp_path):
    def raw(n, kind, at, tags=()):
        return {"id": f"{n:064x}", "pubkey": "b" * 64, "kind": kind, "created_at": at, "sig": "", "tags": [list(t) for t in tags], "content": ""}

    (tmp_path / "in").mkdir()
    files = [[raw(1, 1, 10), raw(2, 0, 11)], [raw(1, 1, 10), raw(3, 0, 12)], [raw(4, 5, 20, [("e", f"{1:064x}")])]]
    for i, rows in enumerate(files):
        path = tmp_path / "in" / f"{i}.json"
        path.write_text("\n".join(map(json.dumps, rows)))
        os.utime(path, (1000 + i, 1000 + i))
    store = EventStore(spark, "file://" + str(tmp_path / "store"))
    store.create()
    seen = []
    query = tail.live(sources.read_stream(spark, str(tmp_path / "in"), maxFilesPerTrigger=1), store, str(tmp_path / "state"), lambda df: seen.extend(int(r["id"], 16) for r in df.collect()), availableNow=True)
    query.awaitTermination(300)
    assert sorted(int(r["id"], 16) for r in store.events().collect()) == [3, 4]
    assert sorted(seen) == [1, 2, 3, 4]


def test_sources(spark, tmp_path):
    line = {"id": "1" * 64, "pubkey": "2" * 64, "kind": 1, "created_at": 9, "sig": "", "tags": [["e", 'odd],"'], ["p"]], "content": "x"}
    (tmp_path / "relay.jsonl").write_text(json.dumps(line) + "\n" + json.dumps(line | {"created_at": 1}))
    got = sources.read_relays(spark, str(tmp_path), since=5).collect()
    assert [(r["created_at"], r["seen_on"], r["tags"]) for r in got] == [(9, ["relay"], [["e", 'odd],"'], ["p"]])]
    assert sources.read_json(spark, str(tmp_path / "relay.jsonl")).count() == 2
    text = sources.serialize(sources.read_json(spark, str(tmp_path / "relay.jsonl"))).first()["raw"]
    assert json.loads(text)["tags"] == line["tags"] and "seen_on" not in json.loads(text)


def test_npub_column(spark):
    keys = ["ab" * 32, "0" * 64, "f" * 64, "0123456789abcdef" * 4, "xyz", "", None, "a" * 63]
    got = spark.createDataFrame(list(enumerate(keys)), "i int, k string").select("i", S.npub(F.col("k")).alias("n")).collect()
    for r in got:
        assert r["n"] == (S.bech32_encode("npub", bytes.fromhex(keys[r["i"]])) if r["i"] < 4 else None)


def test_profiles(spark):
    rows = [("1" * 64, "a" * 64, 0, 5, "", [], '{"name":"","display_name":"D"}', None), ("2" * 64, "b" * 64, 0, 5, "", [], "null", None), ("3" * 64, "c" * 64, 0, 5, "", [], '{"nip05":"x@y"}', None)]
    got = {r["pubkey"][0]: r["short_name"] for r in load_profiles(spark.createDataFrame(rows, EVENT_SCHEMA)).collect()}
    assert got["a"] == "D" and got["c"] == "x" and got["b"].startswith("npub1") and "…" in got["b"]
    frame = spark.createDataFrame([("{}", 99_000), ('{"name":"n"}', 90_000), ("{}", 90_000), ("{}", None)], "c string, at long")
    due = frame.select(needs_refetch(parse_profile(F.col("c")), F.col("at"), 100_000).alias("d")).collect()
    assert [r["d"] for r in due] == [False, False, True, True]
    assert needs_refresh(10, None, 1) and not needs_refresh(10, 90, 100) and needs_refresh(2, 0, 50_000)


def test_routing(spark):
    a = spark.createDataFrame([("x", 1)], "k string, v int")
    b = spark.createDataFrame([("x", 2), ("y", 3)], "k string, v int")
    assert sorted((r["k"], r["v"], r["tier"]) for r in first_tier([a, b], "k").collect()) == [("x", 1, 0), ("y", 3, 1)]
    dealt = round_robin(spark.range(300).selectExpr("cast(id as string) pubkey"), ["a", "b", "c"])
    assert min(r["count"] for r in dealt.groupBy("url").count().collect()) > 70


def test_url_in_one_form(spark):
    from heronlake.functions.scalars import normalize_url

    pairs = [("HTTPS://Host.Example:443/a//b///?b=2&a=1&a=0#x", None), ("https://Host.Example:443/a//b///?b=2&a=1&a=0#x", "wss://host.example/a/b?a=1&a=0&b=2"), ("ws://x:80", "ws://x/"), ("wss://x//", "wss://x/"), ("wss://x/?z=1&y=//", "wss://x/?y=//&z=1"), ("", ""), (None, None)]
    got = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(pairs)], "i int, u string").select("i", normalize_url(F.col("u")).alias("n")).collect()
    for r in got:
        if r["i"]:
            assert r["n"] == pairs[r["i"]][1], pairs[r["i"]]


def test_pointers_round_trip_and_filter():
    from heronlake.functions.scalars import decode_pointer, encode_pointer
    from heronlake.operators.filters import pointer_filter

    key, other = "ab" * 32, "cd" * 32
    cases = {"note": key, "npub": key, "nevent": {"id": key, "relays": ["wss://r.example"], "author": other}, "nprofile": {"pubkey": key, "relays": []}, "naddr": {"identifier": "d:1", "pubkey": key, "kind": 30023, "relays": ["wss://r.example"]}}
    for kind, value in cases.items():
        assert decode_pointer(encode_pointer(kind, value)) == ({"id" if kind == "note" else "pubkey": value} if isinstance(value, str) else value)
    assert pointer_filter(key)[0].ids == [key] and pointer_filter(encode_pointer("nevent", cases["nevent"]))[1:] == (["wss://r.example"], other)
    f, relays, author = pointer_filter(encode_pointer("naddr", cases["naddr"]))
    assert (f.authors, f.kinds, f.tags, f.limit, relays, author) == ([key], [30023], {"d": ["d:1"]}, 1, ["wss://r.example"], key)
    for bad in (encode_pointer("npub", key), "nonsense", ""):
        with pytest.raises(ValueError):
            pointer_filter(bad)
