"""Store behaviour on small hand-made events."""

import random

import pytest

from heronlake.operators.filters import Filter, matching, query
from heronlake.operators.schema import EVENT_SCHEMA
from heronlake.operators.store import EventStore, specs_of

AUTHORS = [f"{i:064x}" for i in range(1, 6)]


def event(n, author, kind, at, tags=(), content=""):
    return (f"{n:064x}", AUTHORS[author], kind, at, "0" * 128, [list(t) for t in tags], content, None)


def frame(spark, rows):
    return spark.createDataFrame(rows, EVENT_SCHEMA)


@pytest.fixture
def store(spark, tmp_path):
    s = EventStore(spark, "file://" + str(tmp_path / "store"))
    s.create()
    return s


def ids(df):
    return [int(r["id"], 16) for r in df.collect()]


def test_bounds_of_800_events(spark):
    mark = f"{10**6:064x}"
    rows = []
    for i in range(800):
        tags = [("t", "even" if i % 2 == 0 else "odd")]
        tags += [("p", AUTHORS[1 - i % 2])] * (i % 10 == 0) + [("e", mark)] * (i % 200 == 0)
        rows.append(event(i + 1, i % 2, [9, 99, 9999][i % 3], 10000 + i, tags))
    e = frame(spark, rows).cache()
    a, b = AUTHORS[:2]
    cases = [
        (Filter(since=10000, limit=780), 780), (Filter(since=10700), 100), (Filter(since=10600, until=10700), 101), (Filter(until=10700, limit=32), 32),
        (Filter(since=10500, limit=4000), 300), (Filter(tags={"e": [mark]}), 4), (Filter(authors=[b], kinds=[9]), 133), (Filter(authors=[b], kinds=[9], limit=12), 12),
        (Filter(authors=[a, b], kinds=[9, 99], limit=60), 60), (Filter(authors=[a, b], kinds=[9, 99, 9999], tags={"t": ["odd"]}, limit=800), 400),
        (Filter(authors=[b], kinds=[9], since=10050, until=10100), 9), (Filter(tags={"e": [mark]}, since=10050, until=10200), 1), (Filter(tags={"e": [mark]}, until=300), 0),
        (Filter(tags={"e": [mark], "t": ["odd"]}, since=10050, until=10400), 0), (Filter(tags={"e": [mark], "t": ["even"]}, since=10050, until=10400), 2), (Filter(kinds=[]), 0), (Filter(limit=0), 800),
    ]
    for f, n in cases:
        assert query(e, f).count() == n, f
    newest = ids(query(e, Filter(until=10700, limit=32)))
    assert newest == sorted(newest, reverse=True) and min(newest) > 661
    wanted = [r["id"] for r in query(e, Filter(authors=[b], kinds=[9], limit=9)).collect()]
    assert [r["id"] for r in query(e, Filter(ids=wanted[::-1] + wanted[:2])).collect()] == wanted[::-1]


def test_random_filters_against_a_naive_matcher(spark):
    rng = random.Random(5)
    rows = [event(i, rng.randrange(5), rng.choice([0, 1, 5, 30000]), rng.randrange(50), [(rng.choice("dtk"), str(rng.randrange(4))) for _ in range(rng.randrange(4))]) for i in range(1, 200)]
    e = frame(spark, rows).cache()

    def naive(f, r):
        tags = {k: [t[1] for t in r[5] if t[0] == k] for k in "dtk"}
        tags["d"] = tags["d"][:1]
        ok = (f.authors is None or r[1] in f.authors) and (f.kinds is None or r[2] in f.kinds)
        ok = ok and all(set(tags[k]) & set(v) for k, v in f.tags.items())
        return ok and (f.since is None or r[3] >= f.since) and (f.until is None or r[3] <= f.until)

    some = lambda values, p: rng.sample(values, rng.randrange(0, len(values))) if rng.random() < p else None
    for _ in range(25):
        tags = {k: v for k in "dtk" if (v := some(["0", "1", "2", "3"], 0.3)) is not None}
        f = Filter(authors=some(AUTHORS, 0.4), kinds=some([0, 1, 5, 30000], 0.4), tags=tags, since=rng.choice([None, 10]), until=rng.choice([None, 40]))
        assert sorted(ids(matching(e, f))) == sorted(int(r[0], 16) for r in rows if naive(f, r)), f


def test_replacing(spark, store):
    d = [("d", "bla")]
    for n, (author, at) in enumerate([(0, 1), (1, 2), (0, 100), (0, 50)], 1):
        stored = store.save(frame(spark, [event(n, author, 30023, at, d)])).collect()
        assert [r["stored"] for r in stored] == [n != 4]
    assert sorted(ids(store.events())) == [2, 3]
    # In one batch, equal times, and no d tag.
    store.save(frame(spark, [event(10, 2, 0, 7), event(11, 2, 0, 7), event(12, 2, 0, 9), event(13, 2, 30001, 3), event(14, 2, 30001, 4)]))
    assert sorted(ids(store.query({"authors": [AUTHORS[2]]}))) == [12, 14]
    assert [r["stored"] for r in store.save(frame(spark, [event(15, 2, 0, 9)])).collect()] == [False]


def test_saving_again_and_deleting(spark, store):
    batch = frame(spark, [event(i, 0, 1, 3000 + i) for i in range(1, 6)])
    assert all(r["stored"] for r in store.save(batch).collect())
    assert not any(r["stored"] for r in store.save(batch).collect())
    assert sorted(ids(store.delete([Filter(ids=[f"{1:064x}"]), {"ids": [f"{2:064x}"]}, {"ids": [f"{3:064x}"]}]))) == [1, 2, 3]
    assert sorted(ids(store.query({}))) == [4, 5]
    assert sorted(ids(store.delete_replaceable(1, AUTHORS[0]))) == [4, 5]
    assert store.events().count() == 0


def test_deletion_events(spark, store):
    rows = [event(1, 0, 1, 10), event(2, 1, 1, 10), event(3, 0, 30023, 10, [("d", "x:y")]), event(4, 0, 1, 99)]
    rows.append(event(9, 0, 5, 50, [("e", f"{1:064x}"), ("e", f"{2:064x}"), ("e", f"{4:064x}"), ("a", f"30023:{AUTHORS[0]}:x:y")]))
    store.save(frame(spark, rows))
    assert sorted(ids(store.apply_deletions())) == [1, 3]
    assert sorted(ids(store.apply_deletions(strict=False))) == [2, 4]


def test_lookups_bounds_and_catalog(spark, store):
    zero = (("0" * 64), AUTHORS[3], 3, 0, "", [], "", None)
    store.save(frame(spark, [event(1, 0, 3, 5), event(2, 0, 30000, 6, [("d", "a")]), event(3, 0, 30000, 7, [("d", "b")]), zero]), last_attempt=77)
    assert store.events().count() == 3
    wanted = [(3, AUTHORS[0], None), (3, AUTHORS[3], None), (30000, AUTHORS[0], "a"), (30000, AUTHORS[0], None), (30000, AUTHORS[0], "")]
    found = {r["pos"]: (r["last_attempt"], [int(e["id"], 16) for e in r["events"] or []]) for r in store.load_replaceables(specs_of(spark, wanted)).collect()}
    assert found == {0: (77, [1]), 1: (77, []), 2: (77, [2]), 3: (77, [3, 2]), 4: (None, [])}
    store.set_bounds(spark.createDataFrame([(AUTHORS[0], 1, 5, 9), (AUTHORS[0], 2, 1, 2)], "pubkey string, kind int, oldest long, newest long"))
    store.set_bounds(spark.createDataFrame([(AUTHORS[0], 1, 4, 10)], "pubkey string, kind int, oldest long, newest long"))
    assert store.bounds_map().first()["kinds"] == {1: [4, 10], 2: [1, 2]}
    assert {r["name"] for r in store.catalog().collect()} == {"events", "bounds", "attempts"}


def test_changes_touch_only_their_buckets_and_vacuum_keeps_the_rest(spark, store):
    store.save(frame(spark, [event(i, i % 5, 1, i) for i in range(1, 21)]))
    before = store._version()["events"]
    store.save(frame(spark, [event(30, 0, 1, 30)]))
    after = store._version()["events"]
    changed = {b for b in after if after[b] != before.get(b)}
    assert len(changed) == 1 and set(before) == set(after) and len(before) > 1
    assert sorted(ids(store.query({"authors": [AUTHORS[0]]}))) == [5, 10, 15, 20, 30]
    assert store.vacuum() > 0 and store.vacuum() == 0
    assert sorted(ids(EventStore(spark, store.path, buckets=7).events())) == [*range(1, 21), 30]
    assert store.save(frame(spark, [])).count() == 0
    assert ids(store.delete([])) == []


def test_deletions_of_a_batch_look_at_its_authors_only(spark, store):
    store.save(frame(spark, [event(1, 0, 1, 5), event(2, 1, 1, 5), event(3, 1, 5, 9, [("e", f"{2:064x}")])]))
    batch = frame(spark, [event(4, 0, 5, 9, [("e", f"{1:064x}"), ("e", f"{2:064x}")])])
    store.save(batch)
    assert ids(store.apply_deletions(batch=batch)) == [1]
    assert ids(store.apply_deletions()) == [2]
    assert sorted(ids(store.events())) == [3, 4]
