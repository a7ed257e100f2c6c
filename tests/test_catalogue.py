"""Every catalogue query against DuckDB."""

import duckdb
import pytest

from heronlake.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents pages".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    found = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    expected = sorted((tuple(r[names.index(c)] for c in columns) for r in found.fetchall()), key=repr)
    assert got == expected


def test_follows_keep_every_row(spark, tmp_path):
    from heronlake.operators import graph
    from heronlake.plans.tables import follows

    # (order, line, part, supplier); parts are more than suppliers.
    rows = [(1, 1, 500, 1), (2, 1, 900, 2), (2, 2, 500, 3), (3, 1, 900, 1), (4, 1, 1300, 4), (5, 1, 1300, 2)]
    lines = spark.createDataFrame([(*r, 1.0, 0.0) for r in rows], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_discount double")
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    edges = follows(spark, str(tmp_path))
    assert {tuple(r) for r in edges.collect()} == {(1, 1), (2, 2), (3, 1), (1, 2), (4, 4), (2, 4)}
    assert {r[0] for r in graph.web_of_trust(edges, 1).collect()} == {1, 2, 4}


def test_whole_lookups_reach_every_author(spark, duck):
    from heronlake.plans.tables import follows

    authors, pairs = duck.execute("SELECT count(DISTINCT user_id), count(DISTINCT (user_id, json_extract_string(props, '$.k'))) FROM events").fetchone()
    q = catalogue.queries()
    assert q["load_bundles"](spark, DATA).count() == authors
    assert q["load_replaceables"](spark, DATA).count() == pairs
    sellers = duck.execute("SELECT count(DISTINCT l_suppkey) FROM lineitem").fetchone()[0]
    assert follows(spark, DATA).select("src").distinct().count() == sellers


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_backoff_holds_no_key(spark, tmp_path):
    from pyspark.sql import functions as F

    from heronlake.streaming import tail

    assert "collect_list" not in _plan(catalogue.queries()["backoff_fold"](spark, DATA))
    # One key with two thirds of the rows, over many Arrow batches.
    what = ["failure", "ask", "ask", "success", "failure", "failure", "ask"]
    rows = spark.range(60_000).select(F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("u"), F.col("id") % 50)).alias("pubkey"), (F.col("id") * 97).alias("ts"), F.element_at(F.array(*map(F.lit, what)), (F.col("id") % 7 + 1).cast("int")).alias("what"))
    got = {r["pubkey"]: (r["failures"], r["last_attempt"], r["allowed"]) for r in tail.backoff_latest(rows, "pubkey").collect()}
    state = {}
    for i in range(60_000):
        key = "hot" if i % 3 < 2 else f"u{i % 50}"
        allowed, failures, last = tail.backoff_step(*state.get(key, (0, 0, None))[:2], what[i % 7], i * 97)
        state[key] = failures, last, allowed
    assert got == state


def test_item_rows_collect_nothing(spark):
    for name in ("list_items_mutes", "list_items_relay_sets", "pointer_rows"):
        plan = _plan(catalogue.queries()[name](spark, DATA))
        assert "collect_list" not in plan and "collect_set" not in plan
