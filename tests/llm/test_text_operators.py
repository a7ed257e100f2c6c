"""The text operators against brute force, with nulls, empty and long texts, ties and repeated rows."""

import base64
import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from heronlake.llm import audio, bpe, jaccard, langid, licenses, lm, quality, registry, secrets
from heronlake.llm.common import crc_of

WORDS = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string"


def frame(spark, texts, **other):
    rows = [(i, t, other.get("lang", ["en"] * len(texts))[i], other.get("source", ["s"] * len(texts))[i], None, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


ODD = [None, "", " \n\t\x0b ", "one", "a b c d", "É\u00a0x \u2028y", "x" * 50_000, "a b c d e " * 30, "same line\nsame line\n\n  \nsame line ", "#*$%&|<>", "Ünï cödé " * 9, "a\x1cb \x85c"]


def test_statistics(spark):
    rng = random.Random(1)
    texts = ODD + [" ".join(rng.choice(["a", "b", "cc", "D\n", "#x"]) for _ in range(rng.randrange(60))) for _ in range(60)]
    got = by_id(quality.statistics(frame(spark, texts)))
    for i, text in enumerate(texts):
        t = text or ""
        w = WORDS.findall(t)
        seen = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        cover = {k + j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        expected = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), len(lines))
        assert tuple(got[i][n] for n in quality.STATS[:6]) == expected, t


def test_quality_verdicts(spark):
    rng = random.Random(2)
    prose = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(40, 90))) + "."
    clean = [prose() for _ in range(300)]
    junk = [" ".join(w + "###" for w in prose().split()) for _ in range(8)] + [prose().upper() for _ in range(8)]
    # Many copies of one text must not make the others look far.
    texts = clean + junk + [clean[0]] * 300 + [None, "", "too short"]
    source = ["s" if i % 2 else None for i in range(len(texts))]
    kept = [r["kept"] for r in sorted(quality.judge(frame(spark, texts, source=source)).collect(), key=lambda r: r["doc_id"])]
    assert sum(kept[:300]) >= 299 and not any(kept[300:316]) and all(kept[316:616]) and not any(kept[616:])
    good = quality.keep_good(frame(spark, texts, source=source))
    assert good.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_words"] and good.count() == sum(kept)
    assert quality.judge(frame(spark, texts).limit(0)).count() == 0
    # Every document that passes the base rules has a distance, in a group of one as well.
    source = ["s"] * 300 + ["t"] * 4 + ["u", "v"]
    few = by_id(quality.judge(frame(spark, clean + clean[:4] + [junk[0], "short"], source=source)))
    assert all(few[i]["kept"] and few[i]["distance"] >= 0 for i in range(300, 304)) and not few[304]["kept"] and few[304]["distance"] > 33 and few[305]["distance"] is None


def test_quality_verdicts_against_brute_force(spark):
    rng = random.Random(21)
    prose = lambda p: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, p))) + rng.choice(["", "", ".", ",\n"]) for _ in range(rng.randint(40, 190)))
    texts = [prose(9) for _ in range(150)] + [prose(7).title() for _ in range(90)] + [" | ".join(prose(9).split()) for _ in range(12)]
    texts += texts[:5] * 3
    lang, source = [rng.choice(["xx", "xx", None]) for _ in texts], [rng.choice(["a", "b", None]) for _ in texts]
    got = by_id(quality.judge(frame(spark, texts, lang=lang, source=source)))
    v = np.array([[r[f"v{i}"] for i in range(quality.DIMS)] for r in sorted(quality.statistics(frame(spark, texts)).select("doc_id", *quality.vector()).collect(), key=lambda r: r["doc_id"])]) / quality.UNIT

    def plain(rows):
        z = v[sorted({texts[i]: i for i in rows}.values())]
        median = np.median(np.sort(z, axis=0)[: len(z) - (len(z) % 2 == 0)], axis=0)
        spread = np.abs(z - median)
        mad = np.maximum(1.4826 * np.median(np.sort(spread, axis=0)[: len(z) - (len(z) % 2 == 0)], axis=0), np.maximum(z.std(axis=0) / 10, 1 / quality.UNIT))
        y = np.clip((z - median) / mad, -quality.FAR, quality.FAR)
        best = None
        for far in ((y**2).sum(axis=1), (y**2).max(axis=1)):
            for _ in range(30):
                near = y[np.argsort(far)[: max(1, round(0.75 * len(y)))]]
                center, cov = near.mean(axis=0), np.cov(near.T, bias=True) * 0.75 / quality._chi2_below(quality.chi2(0.75, quality.DIMS), quality.DIMS + 2)
                values, vectors = np.linalg.eigh(cov)
                values = np.maximum(values, quality.FLOOR)
                far = ((y - center) @ vectors) ** 2 @ (1 / values)
            if best is None or np.log(values).sum() < best[0] - 1e-9:
                best = (np.log(values).sum(), far)
        near = y[best[1] <= quality.chi2(0.975, quality.DIMS)]
        values, vectors = np.linalg.eigh(np.cov(near.T, bias=True) * 0.975 / quality._chi2_below(quality.chi2(0.975, quality.DIMS), quality.DIMS + 2))
        return len(z), median + mad * near.mean(axis=0), (vectors * np.maximum(values, quality.FLOOR)) @ vectors.T * np.outer(mad, mad)

    good = [i for i in range(len(texts)) if not got[i]["base_failed"]]
    _, all_center, all_cov = plain(good)
    wrong = 0
    for key in set(zip(lang, source, strict=True)):
        rows = [i for i in good if (lang[i], source[i]) == key]
        center, cov = all_center, all_cov
        for n, own_center, own_cov in (plain([i for i in good if lang[i] == key[0]]), plain(rows)):
            w = n / (n + quality.PARENT)
            center, cov = w * own_center + (1 - w) * center, w * own_cov + (1 - w) * cov
        far = np.einsum("ij,jk,ik->i", v[rows] - center, np.linalg.inv(cov), v[rows] - center)
        assert np.median(np.abs(np.array([got[i]["distance"] for i in rows]) / far - 1)) < 0.1
        wrong += sum(got[i]["kept"] != (d <= quality.chi2(1 - 1e-5, quality.DIMS)) for i, d in zip(rows, far, strict=True))
    assert wrong <= 2 and 0 < sum(not got[i]["kept"] for i in good) < 40


def points_of(spark, x):
    v = np.round(x * quality.UNIT).astype(int)
    return spark.createDataFrame([("g", *map(int, r)) for r in v], "g string, " + ", ".join(f"v{i} long" for i in range(quality.DIMS)))


def test_mcd_matches_the_plain_algorithm(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, quality.DIMS)) @ np.diag([1, 0.05, 2, 1, 1, 0.7])
    x[:80] += 9
    found = quality.estimates(points_of(spark, x)).first()
    center, cov = np.array(found["center"]), np.array(found["cov"]).reshape(quality.DIMS, -1)
    assert found["n"] == 600 and np.abs(center - x[80:].mean(axis=0)).max() < 0.15
    assert np.allclose(np.sqrt(np.diag(cov)), x[80:].std(axis=0), rtol=0.15)
    far = np.einsum("ij,jk,ik->i", x - center, np.linalg.inv(cov), x - center)
    assert far[:80].min() > quality.chi2(0.999, quality.DIMS) > np.quantile(far[80:], 0.97)


def test_mcd_follows_correlations(spark):
    """A vector off the correlation is far though each coordinate is near, and one along it is near though its length is large."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, quality.DIMS))
    x[:, 1] = x[:, 0] + 0.2 * x[:, 1]
    off, along = np.zeros(quality.DIMS), np.zeros(quality.DIMS)
    off[:2], along[:2] = (1.5, -1.5), (3.2, 3.2)
    x[:5] = off
    found = quality.estimates(points_of(spark, x)).first()
    center, precision = np.array(found["center"]), np.linalg.inv(np.array(found["cov"]).reshape(quality.DIMS, -1))
    distance = lambda y: (y - center) @ precision @ (y - center)
    cut = quality.chi2(1 - 1e-5, quality.DIMS)
    assert distance(off) > cut > distance(along) and (off**2).sum() < cut < 2 * (along**2).sum()
    values = np.linalg.eigvalsh(np.array(found["cov"]).reshape(quality.DIMS, -1))
    # None at the floor.
    assert values.min() > 2 * quality.FLOOR * 0.9


def brute_components(sets, percent):
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(sets)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = sorted((find(i), find(j)))
            parent[y] = x
    return [find(i) for i in range(len(sets))]


def shingles(text, size):
    w = [x.translate(LOWER) for x in WORDS.findall(text or "")]
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}


def variants(rng, words, n):
    for _ in range(n):
        w = list(words)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        yield " ".join(w)


@pytest.mark.parametrize("block", [2_000_000, 300])
def test_jaccard_components(spark, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(4)
    shared = [f"p{i}" for i in range(40)]
    texts = list(ODD)
    for _ in range(12):
        texts += variants(rng, [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(5, 90))], rng.randint(1, 12))
    texts += [" ".join([*shared, *(f"u{rng.randrange(10**6)}" for _ in range(12))]) for _ in range(15)]
    texts += [texts[20]] * 5 + [texts[20].upper()] + ["a b c d"]
    got = by_id(jaccard.near_duplicates(frame(spark, texts), size=4, percent=85))
    sets = [shingles(t, 4) for t in texts]
    assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i]["component_id"] for i in range(len(texts))] == brute_components(sets, 85)


def test_trie_finds_every_pair():
    rng = random.Random(6)
    for percent in (50, 80, 85, 100):
        # A few n-grams of each set are its own: only their number is given.
        sets = [(sorted(rng.sample(range(25), rng.randint(1, 25))), rng.choice([0, 0, 1, 3])) for _ in range(150)]
        trie = jaccard.Trie(percent)
        for i, (s, own) in enumerate(sets):
            trie.add(s, len(s) + own, i)
        for k, (s, own) in enumerate(sets):
            a = set(s)
            linked = {i for i, (b, other) in enumerate(sets) if 100 * len(a & set(b)) >= percent * (len(a | set(b)) + own + other)}
            assert set(trie.matches(s, len(s) + own)) - {k} == linked - {k}


def test_keep_one(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(5, long, "a"), (3, long + " x", "b"), (3, long + " x", "b"), (None, "other words here now ok", "c"), (9, None, "d"), (8, "", "d"), (7, "solo", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 3, 7, 8, 9]
    assert jaccard.keep_one(docs.limit(0)).count() == 0


def test_repeated_rows_are_read_once(spark, monkeypatch):
    """Ten thousand repeats of a row and a near copy of it: one set for each text."""
    long = " ".join(f"w{i}" for i in range(60))
    docs = spark.range(10_000).select(F.lit(1).alias("doc_id"), F.lit(long).alias("text")).union(spark.createDataFrame([(2, long + " x")], "doc_id int, text string"))
    seen = []
    monkeypatch.setattr(jaccard, "written", lambda df, name, real=jaccard.written: seen.append((name, real(df, name))) or seen[-1][1])
    monkeypatch.setattr(jaccard, "forget", lambda *tables: None)
    got = jaccard.near_duplicates(docs).groupBy("component_id").count().collect()
    assert [tuple(r) for r in got] == [(1, 10_001)]
    assert {name: df.count() for name, df in seen if name in ("jaccard-sets", "jaccard-left", "jaccard-values", "jaccard-ordered")} == dict.fromkeys(("jaccard-sets", "jaccard-left", "jaccard-values", "jaccard-ordered"), 2)


def test_secrets(spark):
    key = "Ab3dEfGh1jKlMn0pQrStUv"
    texts = [None, "", "é password = 'hunter2hunter2' AKIA" + "A" * 12, "token=short token: " + "f" * 32, f"x {key} y", f"z {key}", "q Zz9" + "yX8" * 8, "Password: secret: abcdefghij", "apikey=" + "1" * 50_000]
    source = ["o/a"] * 5 + ["p/b"] * 4
    found = by_id(secrets.scan_owned(frame(spark, texts, source=source), F.col("source"), F.substring_index("source", "/", 1)).select("doc_id", secrets.digest(F.col("spans")).alias("d")))
    got = [found[i]["d"] for i in range(len(texts))]
    assert got[:2] == ["", ""] and got[2] == "assign:2:28,access:30:46" and got[3] == "assign:12:51,hex:19:51"
    # The same key at two owners is shared; another one is its owner's.
    assert (got[4], got[5]) == ("shared:2:24", "shared:2:24") and got[6] == "owned:2:29" and got[7] == "" and got[8] == "assign:0:50007,hex:7:50007"
    masked = by_id(secrets.mask_owned(frame(spark, texts, source=source), F.col("source"), F.substring_index("source", "/", 1)))
    assert masked[2]["text"] == "é [SECRET]' [SECRET]" and masked[3]["text"] == "token=short [SECRET]" and masked[0]["text"] is None and masked[4]["text"] == "x [SECRET] y"
    # At three owners it is copied, and so in five repositories of two owners.
    for source in (["a/r", "b/r", "c/r", "c/r", "c/s"], ["a/1", "a/2", "a/3", "b/1", "b/2"]):
        rows = secrets.scan_owned(frame(spark, [f"k {key}", f"password={key}", *[key] * 3], source=source), F.col("source"), F.substring_index("source", "/", 1))
        assert [[(s["kind"], s["status"]) for s in r["spans"]] for r in sorted(rows.collect(), key=lambda r: r["doc_id"])] == [[], [("assign", "copied")], [], [], []]
    one = secrets.scan_owned(frame(spark, [key] * 6, source=[f"a/{i}" for i in range(6)]), F.col("source"), F.substring_index("source", "/", 1))
    assert {(s["kind"], s["n_repos"], s["n_owners"]) for r in one.collect() for s in r["spans"]} == {("owned", 6, 1)}
    assert secrets.scan_owned(frame(spark, ["x"]).limit(0), F.col("source"), F.col("source")).count() == 0


def test_ownership(spark):
    rows = spark.createDataFrame([("h", "a", "x"), ("h", "b", "x"), ("h", None, None), ("g", "a", "x"), ("g", "a", "x")], "hash string, repo string, owner string")
    got = {r["hash"]: (r["n_spans"], r["n_repos"], r["n_owners"]) for r in secrets.ownership(rows).collect()}
    assert got == {"h": (3, 3, 2), "g": (2, 1, 1)}


def test_licenses(spark):
    mit = licenses.TEMPLATES["MIT"][2]
    changed = mit.replace("hereby", "now").replace("merge, publish", "publish")
    texts = [None, "", "Released under the MIT License.", f"x y z {mit} tail", f"{'pad ' * 3000}{changed} end", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0. " * 2, "nothing of the kind here", mit[:200]]
    got = by_id(licenses.scan(frame(spark, texts)))
    names = [[s["license"] for s in got[i]["spans"]] for i in range(len(texts))]
    assert names == [[], [], ["MIT"], ["MIT"], ["MIT"], ["GPL-3.0"], ["CC-BY-NC-4.0"] * 2, [], []]
    assert got[3]["spans"][0]["first_word"] == 3 and got[4]["spans"][0]["containment"] < 1
    assert licenses.scan(frame(spark, ["x"]).limit(0)).count() == 0


def test_license_recall_against_brute_force():
    """Windows with at least the containment asked for are found."""
    rng = random.Random(8)
    bands = licenses.Bands(licenses.TEMPLATES)
    missed = 0
    for name, forms in licenses.TEMPLATES.items():
        for text in forms:
            for _ in range(3):
                w = text.split()
                if len(w) > 40:
                    w[rng.randrange(len(w))] = "changed"
                body = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(0, 60))]
                found = licenses.scan_column(bands, pa.array([" ".join(body + w + body)]))[0]
                missed += name not in [s["license"] for s in found] and len(re.findall("[A-Za-z0-9]+", text)) >= 5
    assert missed == 0


def encoder():
    import tiktoken

    path, pattern = registry.vocabulary()
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("test", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_bpe(spark, monkeypatch):
    rng = random.Random(9)
    texts = ODD + ["".join(rng.choice(["a", " ", "  ", "\n", "é", "1", "'s", "!", "\u3000", " b"]) for _ in range(rng.randrange(400))) for _ in range(60)]
    own = encoder()
    monkeypatch.setattr(bpe, "PIECE_CHARS", 16)
    path = registry.vocabulary()
    for t in texts:
        assert "".join(bpe.safe_pieces(t or "", 16)) == (t or "")
        assert bpe.encode_text(t or "", *path).tolist() == own.encode_ordinary(t or "")
    got = by_id(bpe.round_trip(frame(spark, texts), *path))
    for i, t in enumerate(texts):
        ids = own.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    both = by_id(bpe.decode(bpe.encode(frame(spark, texts), *path), *path))
    assert all(bytes(both[i]["decoded"]).decode() == (t or "") for i, t in enumerate(texts))


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm(spark, order, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK", 150)
    monkeypatch.setattr(lm, "STRETCH", 7)
    rng = random.Random(10)
    texts = ODD + [" ".join(rng.choice("aAbcdefg") for _ in range(rng.randrange(30))) for _ in range(50)]
    out = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    mu = (7.0, 3.0)
    got = by_id(lm.score(frame(spark, texts), crc_of(F.col("doc_id")) % 7 == 2, order=order, mu=mu))
    rows = [[0] * (order - 1) + [w.translate(LOWER) for w in WORDS.findall(t or "")] + [0] for t in texts]
    counts = [collections.Counter() for _ in range(order + 1)]
    history = [collections.Counter() for _ in range(order + 1)]
    for row, held in zip(rows, out, strict=True):
        for i in range(order - 1, len(row)) if not held else ():
            for k in range(1, order + 1):
                counts[k][tuple(row[i - k + 1 : i + 1])] += 1
                history[k][tuple(row[i - k + 1 : i])] += 1
    n, v = sum(counts[1].values()), len(counts[1])
    for i, row in enumerate(rows):
        base = score = 0.0
        for j in range(order - 1, len(row)):
            p = (counts[1][(row[j],)] + 1) / (n + v + 1)
            base += math.log10(p)
            for k in range(2, order + 1):
                p = (counts[k][tuple(row[j - k + 1 : j + 1])] + mu[k - 2] * p) / (history[k][tuple(row[j - k + 1 : j])] + mu[k - 2])
            score += math.log10(p)
        assert got[i]["held_out"] == out[i] and got[i]["train_tokens"] == n and got[i]["n_tokens"] == len(row) - order + 1
        assert got[i]["base_score"] == pytest.approx(base) and got[i]["score"] == pytest.approx(score)
    assert lm.score(frame(spark, ["x"]).limit(0), F.lit(False)).count() == 0
    assert lm.score(frame(spark, ["x y"]), F.lit(True)).first()["score"] == 0


def test_audio(spark):
    texts = ODD + ["Same.", "Same."]
    media = audio.store_texts(frame(spark, texts))
    got = by_id(audio.media_features(media))
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        padded = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (got[i]["payload_bytes"], got[i]["payload_sha256"], got[i]["tail_crc32"]) == (len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert got[i]["media_bytes"] == len(padded) + 44
    assert got[len(texts) - 1]["fingerprints"] == got[len(texts) - 2]["fingerprints"]


def test_fingerprints_find_an_excerpt():
    rng = np.random.default_rng(11)
    t = np.arange(60_000) / audio.RATE
    sound = sum(np.sin(2 * np.pi * f * t * (1 + 0.1 * np.sin(t))) for f in (300, 700, 1500))
    sound = (128 + 30 * sound / np.abs(sound).max() + rng.normal(0, 1, len(t))).astype(np.uint8)
    whole = {int(x) & 0xFFFFFFFF for x in audio.fingerprint(sound.tobytes())}
    part = {int(x) & 0xFFFFFFFF for x in audio.fingerprint(sound[12_800:25_600].tobytes())}
    assert len(part & whole) > 0.8 * len(part) > 0


def test_language(spark):
    rng = random.Random(12)
    alphabets = {"xx": ["ka", "lo", "mi"], "yy": ["zu", "tre", "vo"], "zz": ["pé", "qui", "sse"]}
    say = lambda k, n: " ".join("".join(rng.choice(alphabets[k]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    lang = [k for k in alphabets for _ in range(40)]
    texts = [say(k, rng.randint(5, 40)) for k in lang]
    model = langid.train(frame(spark, texts, lang=lang), F.col("lang"))
    new = [say(k, 12) for k in lang[::4]] + [None, "", "123 !!!", "Ω"]
    got = by_id(langid.predict(frame(spark, new), model))
    assert [got[i]["lang_pred"] for i in range(30)] == lang[::4]
    assert [got[30 + i]["lang_pred"] for i in range(3)] == ["und"] * 3 and got[33]["lang_pred"] in alphabets
    assert all(0 <= r["score"] <= 1 for r in got.values())
    mixed = say("xx", 12) + " " + say("yy", 12)
    words = langid.label_words(frame(spark, [mixed]), model).first()["words"]
    assert [w["lang"] for w in words] == ["xx"] * 12 + ["yy"] * 12
    empty = langid.train(frame(spark, ["a"], lang=[None]), F.col("lang"))
    assert langid.predict(frame(spark, ["a"]), empty).first()["lang_pred"] == "und"


def test_language_sample_counts_copies_once(spark):
    # 4,040 rows of yy hold 41 distinct texts; shares by rows drew hardly any of them.
    texts = [f"ka lo {i}" for i in range(30)] + [f"zu tre {i}" for i in range(40)] + ["vo vo"] * 4000
    rows = frame(spark, texts, lang=["xx"] * 30 + ["yy"] * 4040).select("text", F.col("lang").alias("label"))
    for most, expected in ((20, [20, 20]), (35, [30, 35]), (300, [30, 41])):
        # Each text is one stretch.
        names, picked = langid.sample(rows, most)
        assert names == ["xx", "yy"] and [len(set(p)) for p in picked] == [len(p) for p in picked] == expected
        assert all(set(p) <= set(texts) for p in picked)


def test_language_sample_reads_whole_texts(spark):
    long = " ".join(f"w{i}" for i in range(40_000))
    rows = spark.createDataFrame([(long, "xx"), ("ka lo", "yy"), ("", "yy"), (None, "yy"), ("zu", None), ("qui", "zz")], "text string, label string")
    names, picked = langid.sample(rows, 300, 2)
    assert names == ["xx", "yy"] and picked[1] == ["ka lo"]
    words = [w for t in picked[0] for w in t.split()]
    assert len(picked[0]) == langid.SAMPLE_STRETCHES and len(words) == len(set(words)) > (langid.SAMPLE_STRETCHES - 1) * langid.STRETCH_WORDS
    assert max(int(w[1:]) for w in words) > 39_000


def test_language_edge_cases(spark):
    model = langid.train(frame(spark, ["ka lo mi"] * 3 + ["zu tre"] * 3, lang=["xx"] * 3 + ["yy"] * 3), F.col("lang"))
    docs = spark.createDataFrame([(1, "ka " * 300_000, "x"), (2, "zu", "x"), (2, "zu", "x"), (3, None, "x")], "doc_id long, text string, score string")
    got = langid.predict(docs, model, keep=("doc_id", "score")).collect()
    assert [r["lang_pred"] for r in sorted(got, key=lambda r: r["doc_id"])] == ["xx", "yy", "yy", "und"] and got[0]["score"] > 0.5
    assert langid.predict(docs.limit(0), model).count() == 0


def test_language_learns_transitions_and_a_lexicon(spark):
    texts = ["The cat the dog"] * 30 + ["la casa la"] * 30
    rows = frame(spark, texts, lang=["en"] * 30 + ["es"] * 30).select("text", F.col("lang").alias("label"))
    assert langid.lexicon(rows) == {"en": {"the": 0.5, "cat": 0.25, "dog": 0.25}, "es": {"la": 2 / 3, "casa": 1 / 3}}
    start, end = (langid.train(rows, F.col("label"), rounds=n) for n in (0, 20))
    assert not np.allclose(start["transitions"], end["transitions"]) and end["lexicon_weights"].any()
    assert end["lexicon_weights"][0, 0] > end["lexicon_weights"][0, 1] and end["lexicon_weights"][1, 1] > end["lexicon_weights"][1, 0]
    # Expected pairs against all paths.
    rng = np.random.default_rng(14)
    scores, transitions, pairs, total = rng.normal(size=(5, 3)), rng.normal(size=(3, 3)), np.zeros((3, 3)), np.zeros((3, 3))
    langid.forward_backward(scores, np.array([0, 5]), transitions, pairs)
    for path in itertools.product(range(3), repeat=5):
        steps = list(itertools.pairwise(path))
        weight = math.exp(sum(scores[i, k] for i, k in enumerate(path)) + sum(transitions[p] for p in steps))
        for p in steps:
            total[p] += weight
    assert np.allclose(pairs, 4 * total / total.sum())


@pytest.mark.parametrize("piece", [512, 2, 1])
def test_forward_backward_is_exact(piece, monkeypatch):
    monkeypatch.setattr(langid, "PIECE", piece)
    rng = np.random.default_rng(13)
    scores, transitions = rng.normal(size=(9, 3)), rng.normal(size=(3, 3))
    first = np.array([0, 4, 4, 9])
    pairs, both = np.zeros((3, 3)), np.zeros((3, 3))
    got = langid.forward_backward(scores, first, transitions, pairs)
    for a, b in ((0, 4), (4, 9)):
        total, moves = np.zeros((b - a, 3)), np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=b - a):
            weight = math.exp(sum(scores[a + i, k] for i, k in enumerate(path)) + sum(transitions[x, y] for x, y in itertools.pairwise(path)))
            for i, k in enumerate(path):
                total[i, k] += weight
            for move in itertools.pairwise(path):
                moves[move] += weight
        assert np.allclose(got[a:b], total / total.sum(axis=1, keepdims=True))
        both += moves * (b - a - 1) / moves.sum()
    assert np.allclose(pairs, both)


def test_a_million_words_are_labelled_quickly():
    import time

    rng = np.random.default_rng(15)
    scores = rng.normal(size=(1_000_000, 4))
    began = time.perf_counter()
    langid.forward_backward(scores, np.array([0, len(scores)]), np.eye(4))
    assert time.perf_counter() - began < 10


def test_licenses_against_all_windows():
    """Every window of every text is compared with every template, by sets of words."""
    rng = random.Random(31)
    bands = licenses.Bands(licenses.TEMPLATES)
    words_of = lambda t: [w.lower() for w in re.findall("[A-Za-z0-9\x80-\U0010ffff]+", t)]
    grams = lambda w: [tuple(w[i : i + licenses.SIZE]) for i in range(len(w) - licenses.SIZE + 1)]
    templates = [(name, grams(words_of(t))) for name, forms in licenses.TEMPLATES.items() for t in forms]
    texts = []
    for name, forms in licenses.TEMPLATES.items():
        w = list(forms[-1].split())
        for changes in (0, 1, len(w) // 12, len(w) // 4, len(w)):
            v = list(w)
            for _ in range(changes):
                v[rng.randrange(len(v))] = f"x{rng.randrange(10**6)}"
            pad = [f"p{rng.randrange(10**6)}" for _ in range(rng.randrange(40))]
            texts.append(" ".join(pad + v + pad[:7]))
    for text, spans in zip(texts, licenses.scan_column(bands, pa.array(texts)), strict=True):
        own = grams(words_of(text))
        best = {}
        for name, wanted in templates:
            m = len(wanted)
            for at in range(0, len(own) if m else 0, licenses.stride_of(m)):
                share = len(set(own[max(0, at - m // 4) : at + m + m // 4]) & set(wanted)) / len(set(wanted))
                if share * 100 >= licenses.PERCENT:
                    best[name] = max(best.get(name, 0), share)
        found = {s["license"]: s["containment"] for s in spans}
        # Of licences that overlap the most contained ones are given.
        assert set(found) == {name for name, share in best.items() if share == max(best.values())} if best else not found, text
        assert all(found[k] == pytest.approx(best[k]) for k in found)


def test_fingerprints_against_a_slow_transform():
    rng = np.random.default_rng(17)
    for size in (64, 256, 320, 5000):
        payload = rng.integers(0, 256, size, dtype=np.uint8)
        n = max(1, math.ceil((size - audio.FRAME) / audio.HOP) + 1)
        padded = np.full((n - 1) * audio.HOP + audio.FRAME, 128, dtype=np.uint8)
        padded[:size] = payload
        turns = np.exp(-2j * np.pi * np.outer(np.arange(audio.FRAME // 2 + 1), np.arange(audio.FRAME)) / audio.FRAME)
        window = [0.5 - 0.5 * math.cos(2 * math.pi * i / (audio.FRAME - 1)) for i in range(audio.FRAME)]
        power = [np.abs(turns @ [(float(x) - 128) * w for x, w in zip(padded[i * audio.HOP : i * audio.HOP + audio.FRAME], window, strict=True)]) for i in range(n)]
        peaks = []
        for i, row in enumerate(power):
            for low, high in audio.BANDS:
                top = max(range(low, high), key=lambda b: row[b])
                beside = [max(power[j][low:high]) for j in (i - 1, i + 1) if 0 <= j < n]
                if row[top] > 2 * row.mean() and all(row[top] >= x for x in beside):
                    peaks.append((i, top))
        peaks.sort()
        pairs = sorted(a << 32 | f << 20 | g << 8 | (b - a) for k, (a, f) in enumerate(peaks) for b, g in peaks[k + 1 : k + 1 + audio.FAN_OUT] if b - a <= audio.MAX_GAP)
        assert audio.fingerprint(payload.tobytes()).tolist() == pairs
