"""Every operator and stage beside columns of its own names, with nulls, repeats, an empty table and a text of ten megabytes."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from heronlake.llm import audio, bpe, jaccard, langid, licenses, lm, mixing, quality, registry, secrets, urls
from heronlake.llm.common import words_column, written

MADE = [
    *quality.STATS, "base_failed", "distance", "kept", "g", "center", "v0", "n", "print", "mark", "head", "rid", "n_shingles", "component_id", "text_key", "size", "source_size", "target", "rate", "copies",
    "spans", "statuses", "hash", "repo", "owner", "kind", "status", "found", "host", "path", "rule", "verdict", "score", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids", "held_out", "n_known", "train_tokens", "base_score",
    "media", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "fingerprints", "lang_pred", "words", "_text", "_row", "_k_0", "_in0", "_in1", "in_0", "in_1", "_text_key", "_lang", "_source", "_h", "_size", "_key", "_d", "_c_0", "_spans", "_copy", "_COPIES",
]


@pytest.fixture(scope="module")
def docs(spark):
    long = " ".join(f"word{i % 9973} und{i}" for i in range(700_000))
    assert len(long) > 10_000_000
    prose = [f"The house number {i} stands on a quiet street, and its {i + 3} windows look at the river." for i in range(25)]
    rows = [(i, t, "en", "a/b", len(t)) for i, t in enumerate(prose)] + [(0, prose[0], "en", "a/b", 1)] * 3
    rows += [(100, long, "en", "a/b", len(long)), (101, None, None, None, None), (None, "password = hunter2hunter2 and more words that make this row long enough", "de", None, 3), (102, "", "fr", "c", 0), (103, " \n", None, "c", 2)]
    return written(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select("*", *[F.lit("own").alias(c) for c in MADE]), "test-clash")


def run_all(docs):
    keep = ("doc_id", *MADE)
    model = langid.train(docs, F.col("lang"), sample_docs=5, rounds=3)
    return {
        "quality": quality.judge(docs, keep=keep),
        "jaccard": jaccard.near_duplicates(docs, keep=keep),
        "mixing": mixing.mix(docs, words_column(F.col("text")), keep=keep),
        "secrets": secrets.scan_owned(docs, F.col("source"), F.col("source"), keep=keep),
        "licenses": licenses.scan(docs, keep=keep),
        "urls": urls.judge(docs.withColumnRenamed("text", "url"), [0.1] * 65, registry.URL_RULES, keep=keep),
        "bpe": bpe.round_trip(docs, *registry.vocabulary(), keep=keep),
        "lm": lm.score(docs, F.col("doc_id") % 3 == 1, keep=keep),
        "audio": audio.media_features(audio.store_texts(docs), keep=keep),
        "langid": langid.predict(docs, model, keep=keep),
    }


def test_operators(spark, docs):
    n = docs.count()
    for name, df in run_all(docs).items():
        lower = [c.lower() for c in df.columns]
        assert len(lower) == len(set(lower)), name
        # Written, so that every column is computed.
        out = written(df, f"test-{name}")
        assert out.count() == n and {r[0] for r in out.select("doc_id").collect()} == {r[0] for r in docs.select("doc_id").collect()}, name


def test_operators_on_an_empty_table(spark, docs):
    for name, df in run_all(docs.limit(0)).items():
        assert df.count() == 0, name


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages(spark, docs, name, stage):
    out = written(stage(spark, docs, ""), f"test-stage-{name}")
    if name == "byte_bpe":
        assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == docs.count()
        return
    assert out.columns == docs.columns
    found = out.collect()
    assert found and all(r[c] == "own" for r in found for c in MADE)
    ids = {r["doc_id"] for r in found}
    assert ids <= {r[0] for r in docs.select("doc_id").collect()} and (name in ("quality_rules", "jaccard_join") or 0 in ids)
