"""Every stage of the pipeline against brute force on its own input."""

import collections
import hashlib
import re

import numpy as np
import pytest
from test_table_operators import targets
from test_text_operators import WORDS, brute_components, encoder, shingles

import corpus_pipeline
from heronlake.llm import quality
from heronlake.llm.common import written

DATA = "/root/testdata/sf0.001"
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def stages(spark):
    """The input and the output of each stage, written between stages as the pipeline does."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    # Rows of one source for a robust estimate, outliers, secrets, and copies.
    prose = [r["text"] for r in docs.where("lang = 'en' and n_chars between 300 and 3000").orderBy("doc_id").limit(40).collect()]
    key = "Zz9yX8wV7uT6sR5qP4oN3"
    # Words in reverse, so that the rows are no near copies of others.
    prose = [" ".join(reversed(t.split())) for t in prose]
    extra = [(90_000 + i, f"{t} {key if i in (1, 2) else ''} password: hunter2hunter{i}", "en", "own/a" if i < 20 else "own/b", None) for i, t in enumerate(prose)]
    extra += [(91_000, " ".join("#&" + w for w in prose[0].split()), "en", "own/a", 1), (None, prose[1], None, None, None), (91_001, None, None, "own/a", 0), (91_002, "", "en", None, 0)]
    now = written(docs.unionByName(spark.createDataFrame(extra, docs.schema)), "test-pipeline")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, now, DATA), f"test-{name}")
        out[name] = (now, after)
        now = after
    return out


def test_quality_stage(stages):
    before, after = stages["quality_rules"]
    judged = quality.judge(before, keep=("doc_id", "text", "lang", "source", "n_chars"))
    kept = []
    for r in judged.collect():
        words = WORDS.findall(r["text"] or "")
        grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        seen = collections.Counter(grams)
        cover = {i + j for i, g in enumerate(grams) if seen[g] > 1 for j in range(5)}
        failed = len(words) < 10 or 100 * len(cover) > 20 * len(words)
        assert r["base_failed"] == failed
        # The distance from the group's estimate decides on the rest.
        if not failed and r["distance"] <= quality.chi2(1 - 1e-5, quality.DIMS):
            kept.append(tuple(r[c] for c in before.columns))
    assert rows(after) == sorted(kept, key=repr) and 0 < len(kept) < before.count()
    assert 91_000 not in {r["doc_id"] for r in after.collect()}


def test_join_stage(stages):
    before, after = stages["jaccard_join"]
    found = sorted(before.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    group = brute_components([shingles(r["text"], 5) for r in found], 80)
    expected = [tuple(found[i]) for i in sorted(set(group))]
    assert rows(after) == sorted(expected, key=repr) and len(expected) < len(found)


def test_secret_stage(stages):
    before, after = stages["secret_scan"]
    found = before.collect()
    spans, owners = [], collections.defaultdict(set)
    for r in found:
        t = r["text"]
        own = [(m.start(), 0, m.end(), m[1]) for m in ASSIGN.finditer(t) if len(m[1]) >= 8]
        own += [(m.start(), k, m.end(), m[0]) for k, p in ((1, "AKIA[A-Z0-9]{12,}"), (2, "[0-9a-f]{32,}")) for m in re.finditer(p, t)]
        base = list(own)
        for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", t):
            if all(re.search(c, m[0]) for c in ("[A-Z]", "[a-z]", "[0-9]")) and not any(a < m.end() and m.start() < e for a, _, e, _ in base):
                own.append((m.start(), 3, m.end(), m[0]))
        spans.append(sorted(own))
        for *_, secret in own:
            owners[secret].add((r["source"] or "\0").split("/")[0])
    expected = []
    for r, own in zip(found, spans, strict=True):
        text, at = "", 0
        for start, kind, end, secret in own:
            if kind < 3 or len(owners[secret]) < 3:
                text += r["text"][at:start] + "[SECRET]" if start >= at else ""
                at = max(at, end)
        text += r["text"][at:]
        expected.append((r["doc_id"], text, r["lang"], r["source"], len(text)))
    assert rows(after) == sorted(expected, key=repr)
    assert any("[SECRET]" in e[1] for e in expected)


def test_mix_stage(stages):
    before, after = stages["source_mix"]
    given, taken = collections.Counter(map(tuple, before.collect())), collections.Counter(map(tuple, after.collect()))
    size = lambda r: len(WORDS.findall(r[1] or ""))
    assert set(taken) <= set(given) and all(n <= 2 * given[r] for r, n in taken.items())
    sizes, got, least = collections.Counter(), collections.Counter(), {}
    for r, n in given.items():
        sizes[r[3]] += n * size(r)
        least[r[3]] = min(least.get(r[3], 1 << 60), size(r))
    for r, n in taken.items():
        got[r[3]] += n * size(r)
    for source, target in targets(sizes).items():
        assert abs(got[source] - target) <= max(0.01 * target, least[source]), source


def test_bpe_stage(stages):
    before, after = stages["byte_bpe"]
    own = encoder()
    expected = []
    for r in before.collect():
        ids = np.array(own.encode_ordinary(r["text"] or ""), "<u4")
        expected.append((r["doc_id"], len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert rows(after) == sorted(expected, key=repr)
