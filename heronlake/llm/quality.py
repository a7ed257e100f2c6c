"""Quality rules: base statistics, and robust multivariate outliers for each language and source.

The method is the minimum covariance determinant.  A document's statistics
become a short vector of whole numbers (in units of 1/1024), so that sums are
exact and reruns agree.  Vectors are estimated for each language and source,
each language, and all documents, on the scale of the group's own medians and
MADs.  Concentration steps run on Spark: each is one aggregation of counts,
sums and products by group and binned distance, from which a small task for
each group takes the closest share of the vectors.  A group's estimate is
drawn towards its language's, and that towards the whole, by their sizes.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heronlake.llm.common import by_bytes, forget, passed, written
from heronlake.llm.tokenhash import SPACE, buffer, mix, ngram_hashes, word_hashes, word_spans

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_punct", "n_short", "n_long")
UNIT = 1024
DIMS = 6
#: Whole numbers for a MAD in the concentration steps, and the most MADs that a coordinate counts there.
STEPS, FAR = 64, 100
#: No direction's variance is below this, in squared MADs: a tenth of a MAD.
FLOOR = 0.01
BINS = 2048
#: Parts of a group that are joined with its parameters apart.
SALTS = 8
#: Characters and words of typical prose that are added to each text, so that the shares of short texts scatter no more than those of others.
PRIOR_CHARS, PRIOR_WORDS = 500.0, 100.0
#: The distinct texts of its language's weight in a group's estimate.
PARENT = 60


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


_SYMBOL = _table(b"#*$%&|<>")
_UPPER = _table(bytes(range(65, 91)))
_PUNCT = _table(bytes(x for x in range(33, 127) if not chr(x).isalnum()))
_POINT = _table(bytes(x for x in range(256) if not SPACE[x] and not 128 <= x < 192))
_NEWLINE = np.zeros(256, dtype=bool)
_NEWLINE[10] = True


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    order = np.argsort(keys, kind="stable")
    sorted_ = keys[order]
    same = sorted_[1:] == sorted_[:-1]
    out = np.zeros(len(keys), dtype=bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def text_stats(column: pa.Array, window: int = 5) -> dict[str, np.ndarray]:
    """The numbers in STATS for each text of a column; all 0 for null and empty texts."""
    data, offsets = buffer(column)
    # An Arrow column of strings has less than 2**31 bytes.
    sums = np.zeros(len(data) + 1, dtype=np.int32)

    def count(flags: np.ndarray) -> np.ndarray:
        np.cumsum(flags, dtype=np.int32, out=sums[1:])
        return np.diff(sums[offsets]).astype(np.int64)

    starts, lengths, first = word_spans(data, offsets)
    out = {"n_words": np.diff(first), "word_chars": count(_POINT[data]), "n_symbols": count(_SYMBOL[data]), "n_upper": count(_UPPER[data]), "n_punct": count(_PUNCT[data])}

    np.cumsum(_POINT[data], dtype=np.int32, out=sums[1:])
    chars = sums[starts + lengths] - sums[starts]
    row = np.repeat(np.arange(len(column)), np.diff(first))
    for name, flags in (("n_short", chars <= 3), ("n_long", chars >= 9)):
        out[name] = np.bincount(row, weights=flags, minlength=len(column)).astype(np.int64)

    line_starts, line_lengths, line_first = word_spans(data, offsets, _NEWLINE)
    row = np.repeat(np.arange(len(column)), np.diff(line_first))
    np.cumsum(~SPACE[data], dtype=np.int32, out=sums[1:])
    filled = sums[line_starts + line_lengths] > sums[line_starts]
    with np.errstate(over="ignore"):
        keys = mix(word_hashes(data, line_starts[filled], line_lengths[filled], lower=False) + mix(row[filled].astype(np.uint64)))
    lines = np.bincount(row[filled], minlength=len(column))
    _, kept = np.unique(keys, return_index=True)
    out["n_lines"] = lines
    out["n_dup_lines"] = lines - np.bincount(row[filled][kept], minlength=len(column))

    words = word_hashes(data, starts, lengths, lower=False)
    row = np.repeat(np.arange(len(column)), np.diff(first))
    grams = ngram_hashes(words, window)
    whole = np.flatnonzero(row[: len(grams)] == row[window - 1 :]) if len(grams) else np.zeros(0, dtype=np.int64)
    with np.errstate(over="ignore"):
        twice = whole[_repeats(mix(grams[whole] + mix(row[whole].astype(np.uint64))))]
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + window, -1)
    out["n_repeat_words"] = np.bincount(row, weights=np.cumsum(cover)[:-1] > 0, minlength=len(column)).astype(np.int64)
    return out


def statistics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and the columns STATS (long) of every whole text; null texts have no words, lines or characters.

    A kept column with the name of one of STATS gives way to it.
    """
    keep = passed(keep, STATS)
    source = docs.select(*keep, text)
    schema = docs.select(*keep).schema
    for name in STATS:
        schema = schema.add(name, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(batches, len(keep), 1 << 20):
            found = text_stats(part.column(len(keep)))
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *[pa.array(found[n], pa.int64()) for n in STATS]], names=schema.names)

    return source.mapInArrow(run, schema)


def base_failed() -> Column:
    """Fewer than ten words, or over a fifth of the words in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def vector() -> list[Column]:
    """The transformed statistics, as whole numbers of units: log word length, the roots of the shares of upper case, punctuation, long words and line ends, and the share of short words.

    Each count has that of PRIOR_CHARS or PRIOR_WORDS of typical prose added.
    """
    chars, words = F.lit(PRIOR_CHARS), F.lit(PRIOR_WORDS)
    share = lambda a, typical, b, prior: (F.col(a) + F.lit(typical) * prior) / (F.col(b) + prior)
    parts = [
        F.log(share("word_chars", 5.0, "n_words", words)),
        F.sqrt(share("n_upper", 0.016, "word_chars", chars)),
        F.sqrt(share("n_punct", 0.03, "word_chars", chars)),
        share("n_short", 0.3, "n_words", words),
        F.sqrt(share("n_long", 0.08, "n_words", words)),
        F.sqrt(share("n_lines", 1 / 35, "n_words", words)),
    ]
    return [F.round(x * UNIT).cast("long").alias(f"v{i}") for i, x in enumerate(parts)]


def chi2(p: float, d: int) -> float:
    """A quantile of the chi-squared distribution (Wilson and Hilferty's approximation)."""
    a = 2 / (9 * d)
    return d * (1 - a + NormalDist().inv_cdf(p) * a**0.5) ** 3


def _quadratic(prefix: str = "v", unit: float = UNIT) -> Column:
    """Squared Mahalanobis distance of the columns v0.. from ``center`` by ``precision``."""
    off = [F.col(f"{prefix}{i}") / F.lit(float(unit)) - F.col("center")[i] for i in range(DIMS)]
    total = F.lit(0.0)
    for i in range(DIMS):
        for j in range(i, DIMS):
            total = total + F.col("precision")[i * DIMS + j] * off[i] * off[j] * (1 if i == j else 2)
    return total


_SCALES = "g string, n long, median array<double>, mad array<double>"
_PARAMS = "g string, start int, center array<double>, cov array<double>, precision array<double>, logdet double, settled boolean"


def _scales(points: DataFrame) -> DataFrame:
    """Sizes, coordinate-wise medians and MADs of each group, from a histogram of the whole-number coordinates.

    A MAD counts at least a tenth of the standard deviation, and a unit.
    """
    flat = points.select("g", F.posexplode(F.array(*[f"v{i}" for i in range(DIMS)])).alias("i", "v")).groupBy("g", "i", "v").agg(F.count(F.lit(1)).alias("n"))

    def median(values: np.ndarray, n: np.ndarray) -> float:
        order = np.argsort(values, kind="stable")
        return float(values[order][np.searchsorted(np.cumsum(n[order]), (n.sum() + 1) // 2)])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        center, scale = np.zeros(DIMS), np.zeros(DIMS)
        for i, part in rows.groupby("i"):
            v, n = part["v"].to_numpy() / UNIT, part["n"].to_numpy()
            order = np.argsort(v)
            v, n = v[order], n[order]
            center[i] = median(v, n)
            mean = (v * n).sum() / n.sum()
            deviation = np.sqrt(((v - mean) ** 2 * n).sum() / n.sum())
            scale[i] = max(1.4826 * median(np.abs(v - center[i]), n), deviation / 10, 1 / UNIT)
        return pd.DataFrame({"g": rows["g"].iloc[:1], "n": [int(n.sum())], "median": [center.tolist()], "mad": [scale.tolist()]})

    return flat.groupBy("g").applyInPandas(run, _SCALES)


def _scaled(points: DataFrame, scales: DataFrame) -> DataFrame:
    """(g, salt, u0 ..): the vectors in STEPS whole numbers a MAD from the median, at most FAR MADs."""
    most = F.lit(STEPS * FAR)
    steps = [F.round((F.col(f"v{i}") / F.lit(float(UNIT)) - F.col("median")[i]) / F.col("mad")[i] * STEPS) for i in range(DIMS)]
    salt = F.pmod(F.xxhash64(*[f"v{i}" for i in range(DIMS)]), F.lit(SALTS)).cast("int").alias("salt")
    return points.join(scales, "g").select("g", salt, *[F.greatest(-most, F.least(most, x)).cast("long").alias(f"u{i}") for i, x in enumerate(steps)])


def _moments(points: DataFrame, params: DataFrame, distance: Column, most: float | None = None) -> DataFrame:
    """Counts, sums and products by group, start and binned distance (up to ``most``): partly summed before the shuffle."""
    # Where Spark joins by a shuffle, a group with much of the rows is dealt to several tasks.
    near = points.join(params.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["g", "salt"])
    far = (near if most is None else near.where(distance <= most)).withColumn("bin", F.least(F.lit(BINS - 1), F.floor(F.log2(1 + 16 * distance) * 96)).cast("int"))
    sums = [F.sum(f"u{i}").alias(f"s{i}") for i in range(DIMS)]
    products = [F.sum(F.col(f"u{i}") * F.col(f"u{j}")).alias(f"p{i}_{j}") for i in range(DIMS) for j in range(i, DIMS)]
    return far.groupBy("g", "start", "bin").agg(F.max("logdet").alias("before"), F.count(F.lit(1)).alias("n"), *sums, *products)


_SUMS = [f"s{i}" for i in range(DIMS)] + [f"p{i}_{j}" for i in range(DIMS) for j in range(i, DIMS)]


def _concentrate(moments: DataFrame, share: float, scale: float, tolerance: float = 0.01) -> DataFrame:
    """Mean and covariance of the closest ``share`` of each group's vectors; of the bin at the edge the missing part of its sums counts.

    A group has BINS rows here at most.
    """
    own = W.partitionBy("g", "start")
    wanted = F.lit(share) * F.sum("n").over(own)
    before = F.sum("n").over(own.orderBy("bin")) - F.col("n")
    rows = moments.withColumns({"wanted": wanted, "weight": F.greatest(F.lit(0.0), F.least(F.lit(1.0), (wanted - before) / F.col("n")))})
    sums = rows.groupBy("g", "start").agg(F.max("before").alias("before"), F.max("wanted").alias("wanted"), *[F.sum(F.col(c) * F.col("weight")).alias(c) for c in _SUMS])
    upper = np.triu_indices(DIMS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            means = rows[_SUMS].to_numpy(dtype=float) / rows["wanted"].to_numpy(dtype=float)[:, None]
            center = means[:, :DIMS] / STEPS
            cov = np.zeros((len(rows), DIMS, DIMS))
            cov[:, upper[0], upper[1]] = cov[:, upper[1], upper[0]] = means[:, DIMS:] / STEPS**2
            values, vectors = np.linalg.eigh((cov - center[:, :, None] * center[:, None, :]) * scale)
            values = np.maximum(values, FLOOR)
            logdet = np.log(values).sum(axis=1)
            flat = lambda x: ((vectors * x[:, None, :]) @ vectors.transpose(0, 2, 1)).reshape(-1, DIMS * DIMS).tolist()
            settled = np.abs(logdet - rows["before"].astype(float).to_numpy()) <= tolerance
            yield pd.DataFrame({"g": rows["g"], "start": rows["start"].astype("int32"), "center": center.tolist(), "cov": flat(values), "precision": flat(1 / values), "logdet": logdet, "settled": settled})

    return sums.mapInPandas(run, _PARAMS)


def estimates(points: DataFrame, share: float = 0.75, steps: int = 20) -> DataFrame:
    """Minimum-covariance-determinant estimates (g, n, center, cov) of each group of ``points`` (g, v0 .. v5).

    Two starts are concentrated side by side: from the closest vectors in
    squared MADs, and by the largest coordinate alone.  Each is concentrated
    until its determinant settles, or ``steps`` times.  The smaller determinant
    wins, ties go to the first start; then one reweighting by the 97.5 %
    quantile.  Scales are made consistent for a normal distribution, and no
    direction is narrower than a tenth of a MAD.
    """
    points = written(points, "mcd-points")
    scales = written(_scales(points), "mcd-scales")
    scaled = written(_scaled(points, scales), "mcd-scaled")
    squares = [F.pow(F.col(f"u{i}") / F.lit(float(STEPS)), 2) for i in range(DIMS)]
    first = F.when(F.col("start") == 0, sum(squares[1:], squares[0])).otherwise(DIMS * F.greatest(*squares))
    both = scales.select("g", F.explode(F.array(F.lit(0), F.lit(1))).alias("start"), F.lit(None).cast("double").alias("logdet"))
    # The share of a normal distribution's covariance that its closest part shows.
    inner = _chi2_below(chi2(share, DIMS), DIMS + 2) / share
    now = written(_concentrate(_moments(scaled, both, first), share, 1 / inner), "mcd-params")
    ended = []
    for _ in range(steps):
        seen = Observation()
        moved = _concentrate(_moments(scaled, now, _quadratic("u", STEPS)), share, 1 / inner)
        now = written(moved.observe(seen, F.sum((~F.col("settled")).cast("int")).alias("open")), "mcd-params")
        ended.append(now.where("settled"))
        now = now.where("not settled")
        if not seen.get["open"]:
            break
    else:
        ended.append(now)
    every = ended[0]
    for more in ended[1:]:
        every = every.unionByName(more)
    best = every.groupBy("g").agg(F.min(F.struct("logdet", "start", "center", "precision")).alias("b")).select("g", F.col("b.start").alias("start"), "b.center", "b.precision", "b.logdet")
    best = written(best, "mcd-best")
    again = _concentrate(_moments(scaled, best, _quadratic("u", STEPS), chi2(0.975, DIMS)), 1.0, 0.975 / _chi2_below(chi2(0.975, DIMS), DIMS + 2))
    # Back from MADs.
    center = F.transform(F.sequence(F.lit(0), F.lit(DIMS - 1)), lambda i: F.col("median")[i] + F.col("mad")[i] * F.col("center")[i])
    cov = F.transform(F.sequence(F.lit(0), F.lit(DIMS * DIMS - 1)), lambda i: F.col("cov")[i] * F.col("mad")[F.floor(i / DIMS).cast("int")] * F.col("mad")[i % DIMS])
    out = written(again.join(scales, "g").select("g", "n", center.alias("center"), cov.alias("cov")), "mcd-estimates")
    forget(points, scales, scaled, best)
    return out


def _chi2_below(x: float, d: int) -> float:
    """The chi-squared distribution function for even d, in closed form."""
    term = total = 1.0
    for k in range(1, d // 2):
        term *= x / 2 / k
        total += term
    return 1 - float(np.exp(-x / 2)) * total


def _levels() -> list[Column]:
    """The groups of a row: its language and source, its language, and all; null is a value of its own."""
    name = lambda *parts: F.to_json(F.array(*parts)) if parts else F.lit("[]")
    return [name("_lang", "_source"), name("_lang"), name()]


def fit(stats: DataFrame) -> DataFrame:
    """The model (g, center, precision) of each language and source, from a table of ``_lang``, ``_source``, ``_text_key``, base_failed and the vector.

    Each distinct text of a group counts once.  An estimate of n texts has the
    weight n against PARENT for its language's, which in turn is drawn so
    towards that of all; so a group of a single text has an estimate as well.
    """
    once = stats.where("not base_failed").select("_lang", "_source", "_text_key", *[f"v{i}" for i in range(DIMS)]).dropDuplicates(["_lang", "_source", "_text_key"])
    fine, mid, all_ = _levels()
    found = estimates(once.select(F.explode(F.array(fine, mid, all_)).alias("g"), *[f"v{i}" for i in range(DIMS)]))
    # Made of a column, so that the join with the estimate of all stays one by key.
    groups = once.select(fine.alias("g"), mid.alias("g1")).distinct().withColumn("g2", F.concat(F.substring("g", 1, 1), F.lit("]")))
    for k in ("1", "2"):
        groups = groups.join(found.select(F.col("g").alias(f"g{k}"), *[F.col(c).alias(f"{c}{k}") for c in ("n", "center", "cov")]), f"g{k}")

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            center, cov = np.array(rows["center2"].tolist()).reshape(-1, DIMS), np.array(rows["cov2"].tolist()).reshape(-1, DIMS * DIMS)
            for k in ("1", ""):
                own = (rows[f"n{k}"] / (rows[f"n{k}"] + PARENT)).to_numpy()[:, None]
                center = own * np.array(rows[f"center{k}"].tolist()).reshape(-1, DIMS) + (1 - own) * center
                cov = own * np.array(rows[f"cov{k}"].tolist()).reshape(-1, DIMS * DIMS) + (1 - own) * cov
            precision = np.linalg.inv(cov.reshape(-1, DIMS, DIMS)).reshape(-1, DIMS * DIMS)
            yield pd.DataFrame({"g": rows["g"], "center": center.tolist(), "precision": precision.tolist()})

    out = written(groups.join(found, "g").mapInPandas(draw, "g string, center array<double>, precision array<double>"), "quality-model")
    forget(found)
    return out


_MADE = (*STATS, "base_failed", "distance", "kept")


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", keep: tuple[str, ...] = ("doc_id",), p: float = 1 - 1e-5) -> DataFrame:
    """Base statistics and the verdict ``kept`` for every row.

    Result: ``keep``, STATS, base_failed, distance (squared Mahalanobis; null
    only where all texts of the language and source fail the base rules) and
    kept.  Groups are (language, source), null being a value of its own.
    Estimates use each distinct text of a group once, so copies, however many,
    count as one; every row is judged.  Null and empty texts fail the base
    rules.  A kept column with the name of one made here gives way to it.
    Where ``keep`` holds the text, the statistics are computed a second time
    with it rather than written to disk beside it.
    """
    keep = passed(keep, _MADE)
    names = tuple(f"_k_{i}" for i in range(len(keep)))
    own = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.col(lang).cast("string").alias("_lang"), F.col(source).cast("string").alias("_source"), F.xxhash64(text).alias("_text_key"), F.col(text).alias("_text"))
    full = lambda kept: statistics(own, "_text", (*kept, "_lang", "_source", "_text_key")).withColumn("base_failed", base_failed()).select("*", *vector())
    narrow = written(full(() if text in keep else names), "quality-stats")
    rows = full(names) if text in keep else narrow
    judged = rows.withColumn("g", _levels()[0]).join(fit(narrow), "g", "left").withColumn("distance", _quadratic())
    kept = ~F.col("base_failed") & (F.col("distance") <= chi2(p, DIMS))
    return judged.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], *STATS, "base_failed", "distance", F.coalesce(kept, F.lit(False)).alias("kept"))


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    at = {c: f"in_{i}" for i, c in enumerate(docs.columns)}
    judged = judge(docs.select([F.col(c).alias(n) for c, n in at.items()]), at[text], at[lang], at[source], keep=tuple(at.values()), **options)
    return judged.where("kept").select([F.col(n).alias(c) for c, n in at.items()])
