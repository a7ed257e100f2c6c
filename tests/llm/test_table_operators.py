"""Mixing, URL filters, components, the pipeline and the queries' SQL."""

import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from heronlake.llm import components, mixing, registry, url_labels, urls
from heronlake.llm.common import words_column


def targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, full = share * sum(sizes.values()), set()
    while True:
        rest = [s for s in order if s not in full]
        level = (total - sum(cap * sizes[s] for s in full)) / sum(w[s] for s in rest) if rest else 0
        new = {s for s in rest if level * w[s] > cap * sizes[s]}
        if not new:
            return {s: cap * sizes[s] if s in full else level * w[s] for s in order}
        full |= new


def test_mix(spark):
    rng = random.Random(1)
    rows = []
    for i in range(900):
        source = rng.choice([None, "a", "B", "é", "z"] + ["hot"] * 3)
        rows.append((None if i % 97 == 0 else i, " ".join("w" * rng.choice([0, 1, 5, 40, 300])) if i % 50 else None, source, "clash"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    mixed = mixing.mix(docs, words_column(F.col("text")))
    got = mixed.collect()
    assert len(got) == len(rows)
    sizes, taken = {}, {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["copies"] * r["size"]
        assert 0 <= r["copies"] <= 2
    expected = targets(sizes)
    for r in got:
        assert r["target"] == pytest.approx(expected[r["source"]]) and r["source_size"] == sizes[r["source"]]
    for s, t in expected.items():
        assert abs(taken[s] - t) <= max(0.01 * t, 5), s
    again = mixing.mix(docs, words_column(F.col("text"))).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    # Rates are the exponential tilt: one dual variable for each source.
    import math

    for s in sizes:
        duals = {round(math.log(r["rate"]) / r["size"], 9) for r in got if r["source"] == s and r["size"] and r["rate"] < 2}
        assert len(duals) <= 1
    assert mixing.mix(docs.limit(0), words_column(F.col("text"))).count() == 0


def test_repeat_mixed(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, "c", "x"), (2, "c", "x"), (3, None, "y")], "doc_id long, text string, source string")
    out = mixing.repeat_mixed(docs, words_column(F.col("text")))
    assert out.columns == docs.columns and out.where("source = 'x'").agg(F.sum(words_column(F.col("text")))).first()[0] == 6


def test_url_rules(spark):
    rows = ["http://a.org/x", "https://www.EXAMPLE.org/es/1", "http://example.org/en/12", "http://notexample.org/en/1", "http://x.com/fr/2?q", "http://x.com/de/", "http://com/de/9", "http://x.org", "http://x.org?a/b", "no scheme", None, "", "http://", "a://b#c", "http://xcom/fr/", "//", "x" * 5000 + "://h/p"]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    weights = [0.0] * 65
    got = {r["page_id"]: r for r in urls.judge(pages, weights, registry.URL_RULES).collect()}
    for i, u in enumerate(rows):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(len(r), r, v) for v, r in registry.URL_RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        best = max(fits, default=(0, None, "block"))
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, best[1], best[2]), u


def probability(weights):
    return urls.score(urls.host_of(F.col("url")), urls.path_of(F.col("url")), weights)


def test_url_weights_against_numpy(spark):
    rows = [(u, label) for i, (u, label) in enumerate(url_labels.rows()) if i % 9 == 0] * 2
    table = spark.createDataFrame([*rows, ("http://a.example.org/x", None)], "url string, label int")
    weights = urls.train(table, size=64, rounds=8, rate=3.0)
    found = table.where("label is not null").orderBy("url", "label").select("label", urls.buckets(urls.host_of(F.col("url")), urls.path_of(F.col("url")), 64).alias("b")).collect()
    x, y = np.zeros((len(found), 65)), np.array([float(r["label"]) for r in found])
    for i, r in enumerate(found):
        x[i, [*r["b"], 64]] = 1 / math.sqrt(len(r["b"]) + 1)
    share = np.where(y > 0.5, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    w, speed = np.zeros(65), np.zeros(65)
    for _ in range(8):
        speed = 0.9 * speed + 3.0 * x.T @ ((y - 1 / (1 + np.exp(-x @ (w + 0.9 * speed)))) * share) / len(y)
        w += speed
    assert np.allclose(weights, w, atol=2e-6) and len(weights) == 65
    assert urls.train(table.limit(0), size=16) == [0.0] * 17


def test_url_model(spark):
    # No host of the pages teaches.
    hosts = {r["h"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select(urls.host_of(F.col("url")).alias("h")).collect()}
    table = urls.labelled_urls(spark).withColumn("host", F.regexp_replace(urls.host_of(F.col("url")), r"^(www|m|blog)\.", ""))
    assert not hosts & {r["host"] for r in table.collect()}
    # A third of the names is held out in all forms.
    part = F.crc32(F.substring_index("host", ".", 1)) % 3
    weights = urls.train(table.where(part != 0).select("url", "label"))
    right = table.where(part == 0).select(F.avg(((probability(weights) >= 0.5).cast("int") == F.col("label")).cast("int"))).first()[0]
    assert right > 0.7


def test_url_edge_cases(spark):
    weights = [0.5] * 65
    rows = [(1, "http://a.org/" + "x" * 100_000, "h"), (2, None, "h"), (2, None, "h"), (3, "", "h"), (4, "HTTP://É.com/fr/", "h")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = urls.judge(pages, weights, registry.URL_RULES, keep=("page_id", "host")).collect()
    assert len(got) == 5 and sorted(r["host"] for r in got) == ["", "", "", "a.org", "É.com"]
    assert urls.judge(pages.limit(0), weights, registry.URL_RULES).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (7, None)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sql(spark):
    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    for name, sql in registry.oracle_sql().items():
        df = registry.queries()[name](spark, data)
        assert sorted(map(tuple, df.collect())) == sorted(con.execute(sql).fetchall()), name


def test_pipeline(spark):
    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "jaccard_join", "secret_scan", "source_mix", "byte_bpe"]
    out = corpus_pipeline.run(spark, data)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    n = out.count()
    assert 0 < n < 2 * docs.count()
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (None, "w " * 3, "en", "s", 6)], docs.schema)
    for rows in (odd, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, rows, data).columns == docs.columns
