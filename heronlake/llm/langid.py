"""Language identification of code-switched text by a linear-chain conditional random field.

Every word is a position; its features are the word, affixes and character
n-grams, hashed into a bounded table of weights, and its frequencies in a
lexicon of each language's frequent words.  Weights and transitions between
languages are learned by the same gradient steps.  Forward-backward gives each word its
probabilities; a document's are their mean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heronlake.llm.common import by_bytes, passed
from heronlake.llm.tokenhash import SPACE, buffer, mix, word_hashes, word_spans

BUCKETS = 1 << 15
#: Bounds of the training sample: languages, and of each language documents, and stretches of their texts of so many words.
MAX_LABELS, SAMPLE_DOCS, SAMPLE_STRETCHES, STRETCH_WORDS = 200, 300, 1200, 30
#: Words of a text that are stepped through one after the other; longer texts are cut and handed over by matrices.
PIECE = 512
#: A word is frequent in a language when it is one of so many words; so a lexicon has as many words at most.
FREQUENT = 5000
UNKNOWN = "und"
WORDS = T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())]))
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
#: Bytes that are letters: ASCII letters; those above 127 are decided on characters.
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True


def _bucket(codes: np.ndarray, kind: int) -> np.ndarray:
    return ((codes * np.uint32(2654435761) + np.uint32(kind * 0x9E3779B1 & 0xFFFFFFFF)) >> np.uint32(17)).astype(np.int64)


def _grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the byte pairs and triples that start at each place, A to Z folded."""
    low = _FOLD[data]
    pair = np.zeros(len(data), dtype=np.uint32)
    triple = np.zeros(len(data), dtype=np.uint32)
    pair[:-1] = low[:-1] << np.uint32(8) | low[1:]
    triple[:-2] = low[:-2] << np.uint32(16) | low[1:-1] << np.uint32(8) | low[2:]
    return pair, triple


def features(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word index, bucket) of every feature of every word: the whole word, first and last two and three bytes, and byte triples."""
    pair, triple = _grams(data)
    index = np.arange(len(starts))
    long2, long3 = lengths >= 2, lengths >= 3
    words = [index, index[long2], index[long2], index[long3], index[long3]]
    with np.errstate(over="ignore"):
        found = [
            (word_hashes(data, starts, lengths) >> np.uint64(49)).astype(np.int64),
            _bucket(pair[starts[long2]], 1),
            _bucket(pair[starts[long2] + lengths[long2] - 2], 2),
            _bucket(triple[starts[long3]], 3),
            _bucket(triple[starts[long3] + lengths[long3] - 3], 4),
        ]
        inner = np.maximum(lengths - 2, 0)
        first = np.cumsum(inner) - inner
        at = np.arange(int(inner.sum())) - np.repeat(first, inner) + np.repeat(starts, inner)
        words.append(np.repeat(index, inner))
        found.append(_bucket(triple[at], 5))
    return np.concatenate(words), np.concatenate(found)


def lexicon(rows: DataFrame) -> dict[str, dict[str, float]]:
    """Of each label of (text, label) its frequent words and their shares, A to Z folded, counted over all rows."""
    folded = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = rows.where("text is not null and label is not null").select("label", F.explode(F.split(folded, r"[\x20\x09-\x0D]+")).alias("word")).where("word <> ''")
    counts = words.groupBy("label", "word").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("label").agg(F.sum("n").alias("total"))
    out: dict[str, dict[str, float]] = {}
    for r in counts.join(totals, "label").where(F.col("n") * FREQUENT >= F.col("total")).collect():
        out.setdefault(r["label"], {})[r["word"]] = r["n"] / r["total"]
    return out


def _lexicon_table(names: list[str], shares: dict[str, dict[str, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of all frequent words, and a row of each with log shares by label; 0 is a word that is not frequent there."""
    words = sorted({w for own in shares.values() for w in own})
    data, offsets = buffer(pa.array(words, pa.string()))
    hashes = word_hashes(data, offsets[:-1], np.diff(offsets))
    table = np.array([[np.log1p(shares.get(k, {}).get(w, 0.0) * FREQUENT) for k in names] for w in words], dtype=np.float32).reshape(len(words), len(names))
    order = np.argsort(hashes)
    # A last row of zeros for all other words.
    return hashes[order], np.concatenate([table[order], np.zeros((1, len(names)), np.float32)])


def lexicon_rows(model: dict, hashes: np.ndarray) -> np.ndarray:
    """The row of the lexicon of each word."""
    known = model["lexicon"][0]
    if not len(known):
        return np.zeros(len(hashes), dtype=np.int64)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, at, len(known))


def emissions(model: dict, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A row of scores by label for each word."""
    weights = model["weights"]
    out = np.zeros((len(starts), weights.shape[1]), dtype=np.float32)
    pair, triple = _grams(data)
    with np.errstate(over="ignore"):
        hashes = word_hashes(data, starts, lengths)
        out += weights[(hashes >> np.uint64(49)).astype(np.int64)]
        out += (model["lexicon"][1] @ model["lexicon_weights"])[lexicon_rows(model, hashes)]
        for size, codes, kinds in ((2, pair, (1, 2)), (3, triple, (3, 4))):
            fit = np.flatnonzero(lengths >= size)
            out[fit] += weights[_bucket(codes[starts[fit]], kinds[0])]
            out[fit] += weights[_bucket(codes[starts[fit] + lengths[fit] - size], kinds[1])]
        inner = np.maximum(lengths - 2, 0)
        fit = np.flatnonzero(inner)
        if len(fit):
            inner = inner[fit]
            first = np.cumsum(inner) - inner
            at = np.arange(int(inner.sum())) - np.repeat(first, inner) + np.repeat(starts[fit], inner)
            out[fit] += np.add.reduceat(weights[_bucket(triple[at], 5)], first, axis=0)
    # Long words hold many n-grams; the root keeps them from drowning the chain.
    return out / np.sqrt(5.0 + np.maximum(lengths - 2, 0))[:, None].astype(np.float32)


def forward_backward(scores: np.ndarray, first: np.ndarray, transitions: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
    """Label probabilities of each word; ``first`` holds each sequence's first word, with the end.

    The expected counts of label pairs of neighbours are added to ``pairs``.

    Sequences are cut into pieces of PIECE words that take steps together.
    What enters and leaves a piece of a longer sequence is exact: it comes from
    the products of the pieces' steps, so that no loop is as long as a text.
    """
    labels = scores.shape[1]
    e = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float64) + 1e-12
    t = np.exp(transitions - transitions.max()) if labels else transitions
    counts = np.diff(first)
    pieces = -(-counts // PIECE)
    last = np.cumsum(pieces)
    number = np.arange(int(last[-1]) if len(last) else 0) - np.repeat(last - pieces, pieces)
    begin = np.repeat(first[:-1], pieces) + PIECE * number
    size = np.minimum(PIECE, np.repeat(first[1:], pieces) - begin)
    enter, leave = np.ones((len(begin), labels)), np.ones((len(begin), labels))
    inner = number > 0
    long = np.repeat(pieces > 1, pieces)
    if long.any():
        through = np.tile(np.eye(labels), (len(begin), 1, 1))
        some = np.flatnonzero(long)
        for step in range(int(size[some].max())):
            some = some[size[some] > step]
            move = through[some] if step == 0 else through[some] @ t
            if step == 0:
                move[inner[some]] = t
            move = move * e[begin[some] + step][:, None, :]
            through[some] = move / move.max(axis=(1, 2), keepdims=True)
        # From piece to piece, all long sequences together.
        for k in range(1, int(pieces.max())):
            at = np.flatnonzero(number == k)
            now = np.einsum("ij,ijk->ik", enter[at - 1], through[at - 1])
            enter[at] = now / now.sum(axis=1, keepdims=True)
        for k in range(int(pieces.max()) - 1, 0, -1):
            at = np.flatnonzero(number == k)
            back = np.einsum("ijk,ik->ij", through[at], leave[at])
            leave[at - 1] = back / back.sum(axis=1, keepdims=True)
    order = np.argsort(-size, kind="stable")
    begin, size, inner, enter, leave = begin[order], size[order], inner[order], enter[order], leave[order]
    alpha = np.ones((len(scores), labels))
    live = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1 if len(size) else 1), side="right")
    now = None
    for step, n in enumerate(live):
        at = begin[:n] + step
        now = np.where(inner[:, None], enter @ t, 1.0) * e[at] if step == 0 else (now[:n] @ t) * e[at]
        now /= now.sum(axis=1, keepdims=True)
        alpha[at] = now
    forward = alpha.copy() if pairs is not None else alpha
    beta = leave
    ends = begin + size - 1
    alpha[ends] *= leave
    for step in range(len(live) - 1, 0, -1):
        n = live[step]
        at = begin[:n] + step
        ahead = beta[:n] * e[at]
        if pairs is not None:
            joint = forward[at - 1][:, :, None] * t * ahead[:, None, :]
            pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        back = ahead @ t.T
        back /= back.sum(axis=1, keepdims=True)
        beta[:n] = back
        alpha[at - 1] *= back
    if pairs is not None and inner.any():
        joint = enter[inner][:, :, None] * t * (beta * e[begin])[inner][:, None, :] if len(begin) else 0
        pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return alpha / alpha.sum(axis=1, keepdims=True)


def sample(rows: DataFrame, sample_docs: int, max_labels: int = MAX_LABELS) -> tuple[list[str], list[list[str]]]:
    """The labels of (text, label), and of each SAMPLE_STRETCHES stretches of its ``sample_docs`` distinct texts of smallest hash, or of all where it has fewer.

    Texts are cut whole into stretches of STRETCH_WORDS words, and those of
    smallest hash are taken, wherever they stand.  Of more than ``max_labels``
    labels those with the most distinct texts are learned.
    """
    rows = rows.where("text is not null and label is not null").withColumn("h", F.xxhash64("text"))
    # Distinct texts, not rows: copies must not narrow a label's share.
    by_label = rows.select("label", "h").distinct().groupBy("label").count().orderBy(F.col("count").desc(), "label").limit(max_labels)
    counted = {r["label"]: r["count"] for r in by_label.collect()}
    names = sorted(counted)
    if not names:
        return [], []
    # A share of the hash space for each label, twice what is needed: of 600 expected texts, fewer than 300 are as good as impossible.
    shares = F.create_map(*[F.lit(x) for k in names for x in (k, min(1.0, 2.0 * sample_docs / counted[k]))])
    share = F.pmod("h", F.lit(1_000_000_007)) / 1_000_000_007.0
    near = rows.where(share < F.element_at(shares, F.col("label"))).dropDuplicates(["label", "h"])
    # A few hundred texts of a label at most: a window over them is small.
    near = near.withColumn("_r", F.row_number().over(W.partitionBy("label").orderBy("h"))).where(F.col("_r") <= sample_docs)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / STRETCH_WORDS)), lambda i: F.concat_ws(" ", F.slice("w", (i * STRETCH_WORDS + 1).cast("int"), STRETCH_WORDS)))
    stretches = near.select("label", words.alias("w")).where(F.size("w") > 0).select("label", F.explode(cut).alias("text"))
    order = W.partitionBy("label").orderBy(F.xxhash64("text"), "text")
    found = stretches.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= SAMPLE_STRETCHES).select("label", "text").orderBy(F.xxhash64("text"), "text").toPandas()
    return names, [list(found["text"][found["label"] == name]) for name in names]


def train(docs: DataFrame, labels: Column, text: str = "text", sample_docs: int = SAMPLE_DOCS, rounds: int = 60, seed: int = 7) -> dict:
    """Fit the weights on a bounded sample of labelled rows.

    Of at most MAX_LABELS labels and ``sample_docs`` distinct texts of each, by
    the hash of the text, at most SAMPLE_STRETCHES stretches from anywhere in
    them are taken; rows with a null label or text teach nothing.  Four
    stretches of different documents are strung together, so that transitions
    see switches.  Weights and transitions start at 0 and follow the gradient
    of the exact likelihood, by forward-backward.
    Without a labelled row the model has no label and predicts ``und``.
    """
    rows = docs.select(F.col(text).alias("text"), labels.cast("string").alias("label"))
    names, picked = sample(rows, sample_docs)
    if not names:
        return {"labels": [], "weights": np.zeros((BUCKETS, 0), np.float32), "transitions": np.zeros((0, 0)), "lexicon": _lexicon_table([], {}), "lexicon_weights": np.zeros((0, 0), np.float32)}
    rng = np.random.default_rng(seed)
    # Stretches, shuffled: (label, text).
    stretches = [(k, text) for k, part in enumerate(picked) for text in part]
    rng.shuffle(stretches)
    chains = [stretches[i : i + 4] for i in range(0, len(stretches), 4)]
    texts = pa.array([" ".join(s for _, s in chain) for chain in chains])
    data, offsets = buffer(texts)
    starts, lengths, first = word_spans(data, offsets)
    gold = np.concatenate([np.full(len(s.split()), k) for chain in chains for k, s in chain]) if chains else np.zeros(0, np.int64)
    model = {"labels": names, "weights": np.zeros((BUCKETS, len(names)), np.float32), "transitions": np.zeros((len(names), len(names))), "lexicon": _lexicon_table(names, lexicon(rows.where(F.col("label").isin(names)))), "lexicon_weights": np.zeros((len(names), len(names)), np.float32)}
    n = len(starts)
    if n == 0 or len(names) < 2:
        return model
    word, bucket = features(data, starts, lengths)
    order = np.argsort(word, kind="stable")
    word, bucket = word[order], bucket[order]
    own = np.searchsorted(word, np.arange(n))
    scale = 1 / np.sqrt(5.0 + np.maximum(lengths - 2, 0))
    target = np.eye(len(names))[gold]
    inside = np.ones(n, dtype=bool)
    inside[first[:-1][np.diff(first) > 0]] = False
    links = np.flatnonzero(inside)
    seen = np.zeros((len(names), len(names)))
    np.add.at(seen, (gold[links - 1], gold[links]), 1)
    power = np.full(model["weights"].shape, 1e-3)
    power_pairs, power_lexicon = np.full(seen.shape, 1e-3), np.full(seen.shape, 1e-3)
    frequent = model["lexicon"][1][lexicon_rows(model, word_hashes(data, starts, lengths))]
    # Adaptive gradient steps.
    for _ in range(rounds):
        # The same as emissions(), with the features found once.
        scores = (np.add.reduceat(model["weights"][bucket], own, axis=0) + frequent @ model["lexicon_weights"]) * scale[:, None]
        expected = np.zeros_like(seen)
        miss = (target - forward_backward(scores, first, model["transitions"], expected)) * scale[:, None]
        gradient = np.stack([np.bincount(bucket, weights=miss[word, k], minlength=BUCKETS) for k in range(len(names))], axis=1) / n
        gradient -= 1e-7 * model["weights"]
        power += gradient**2 * 1e4
        model["weights"] = (model["weights"] + 0.5 * gradient * 100 / np.sqrt(power)).astype(np.float32)
        gradient = frequent.T @ miss / n - 1e-7 * model["lexicon_weights"]
        power_lexicon += gradient**2 * 1e4
        model["lexicon_weights"] = (model["lexicon_weights"] + 0.1 * gradient * 100 / np.sqrt(power_lexicon)).astype(np.float32)
        gradient = (seen - expected) / n - 1e-7 * model["transitions"]
        power_pairs += gradient**2 * 1e4
        model["transitions"] = model["transitions"] + 0.3 * gradient * 100 / np.sqrt(power_pairs)
    return model


def predict_column(model: dict, column: pa.Array) -> tuple[list[str], np.ndarray]:
    """The language and score of each text."""
    data, offsets = buffer(column)
    starts, lengths, first = word_spans(data, offsets)
    counts = np.diff(first)
    lettered = np.diff(np.concatenate([[0], np.cumsum(_LETTER[data])])[offsets]) > 0
    for i in np.flatnonzero(~lettered & (np.diff(offsets) > 0)):
        lettered[i] = any(map(str.isalpha, column[i].as_py()))
    names = model["labels"]
    if not names:
        return [UNKNOWN] * len(column), np.zeros(len(column))
    posterior = forward_backward(emissions(model, data, starts, lengths), first, model["transitions"])
    total = np.concatenate([np.zeros((1, len(names))), np.cumsum(posterior, axis=0)])
    mean = (total[first[1:]] - total[first[:-1]]) / np.maximum(counts, 1)[:, None]
    best = mean.argmax(axis=1)
    known = lettered & (counts > 0)
    return [names[k] if ok else UNKNOWN for k, ok in zip(best, known, strict=True)], np.where(known, np.clip(mean.max(axis=1), 0, 1), 0.0)


def predict(docs: DataFrame, model: dict, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, lang_pred and score of every whole text.

    Null texts, and texts without a letter, are ``und`` with score 0.  Ties go
    to the first language by name.  The model's size is bounded (BUCKETS times
    MAX_LABELS), so it is broadcast.  A kept column with the name of one made
    here gives way to it.
    """
    keep = passed(keep, ("lang_pred", "score"))
    source = docs.select(*keep, text)
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(batches, len(keep), 5 << 20):
            lang, score = predict_column(shared.value, part.column(len(keep)))
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=schema.names)

    return source.mapInArrow(run, schema)


def word_labels(model: dict, text: str) -> list[tuple[str, str, float]]:
    """(word, language, probability) of each word of one text."""
    data, offsets = buffer(pa.array([text]))
    starts, lengths, first = word_spans(data, offsets)
    if not len(starts) or not model["labels"]:
        return []
    p = forward_backward(emissions(model, data, starts, lengths), first, model["transitions"])
    return [(bytes(data[a : a + n]).decode(), model["labels"][int(k)], float(v)) for a, n, k, v in zip(starts, lengths, p.argmax(axis=1), p.max(axis=1), strict=True)]


def label_words(docs: DataFrame, model: dict, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and an array ``words`` of (word, lang, score): the labels of each word of code-switched texts.  A kept column named words gives way."""
    keep = passed(keep, ("words",))
    source = docs.select(*keep, text)
    schema = docs.select(*keep).schema.add("words", WORDS)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = part[list(keep)].copy()
            out["words"] = [[{"word": w, "lang": k, "score": s} for w, k, s in word_labels(shared.value, t or "")] for t in part[text]]
            yield out

    return source.mapInPandas(run, schema)
