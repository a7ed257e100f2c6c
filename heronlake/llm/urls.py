"""URL filters: allow and block rules, and for other URLs a logistic regression on hashed character n-grams.

Everything is DataFrame functions.  The model is an array of weights, one for
each hash bucket, and so bounded by a parameter; scoring needs no shuffle.  The
labelled table is small: it becomes one row of arrays, on which all steps of
the fit run in a single job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heronlake.llm import url_labels
from heronlake.llm.common import lower_az, passed, written

BUCKETS = 16384
SIZES = (3, 4, 5)


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, label) rows of the small labelled table, each in the forms that hosts and paths commonly take, so that these tell nothing."""
    table = spark.createDataFrame([(i, *row) for i, row in enumerate(url_labels.rows())], "i int, url string, label int")
    name = F.regexp_replace(host_of(F.col("url")), r"^(www|m|blog)\.|\.example\.(com|net|org)$", "")
    forms = [F.format_string(form, name, (31 * F.col("i") + 17 * k) % 9973 if "%d" in form else path_of(F.col("url"))) for k, form in enumerate(url_labels.FORMS)]
    return table.select(F.explode(F.array(*forms)).alias("url"), "label")


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A to Z in lower case; empty without one."""
    return F.coalesce(lower_az(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _hashed(framed: Column, mark: str, n: int, size: int) -> Column:
    """The buckets of all n-grams of one part of a URL."""
    last = F.length(framed) - (n - 1)
    spots = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(spots, lambda i: F.pmod(F.xxhash64(F.lit(mark), F.substring(framed, i, F.lit(n))), F.lit(size)).cast("int"))


def buckets(host: Column, path: Column, size: int = BUCKETS) -> Column:
    """The distinct hash buckets of the character n-grams of host and path."""
    both = ((host, "h"), (path, "p"))
    grams = []
    for part, mark in both:
        framed = F.concat(F.lit("^"), part, F.lit("$"))
        for n in SIZES:
            grams.append(_hashed(framed, mark, n, size))
    return F.array_distinct(F.concat(*grams))


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def train(labelled: DataFrame, size: int = BUCKETS, rounds: int = 12, rate: float = 40.0, limit: int = 5_000) -> list[float]:
    """Weights of a logistic regression, the bias last, by full-batch gradient steps with momentum.

    ``labelled`` is (url, label); rows with a null label are left out and at
    most ``limit`` rows are used, a documented bound: they meet in one row.
    The classes weigh the same.  The ``size`` + 1 weights are all that reaches
    the driver.  Without rows all weights are 0: everything scores 0.5.
    """
    rows = labelled.where("label is not null").select("url", F.col("label").cast("double").alias("label")).orderBy("url", "label").limit(limit)
    rows = rows.withColumn("b", F.concat(buckets(host_of(F.col("url")), path_of(F.col("url")), size), F.array(F.lit(size))))
    rows = written(rows.withColumn("i", F.row_number().over(W.orderBy("url", "label")) - 1), "url-labels")
    # Buckets in use, numbered, each with its rows.
    used = rows.select("i", F.explode("b").alias("b")).groupBy("b").agg(F.array_sort(F.collect_list("i")).alias("rows"))
    used = written(used.withColumn("j", F.row_number().over(W.orderBy("b")) - 1), "url-buckets")
    flat = rows.select("i", "label", (F.lit(1.0) / F.sqrt(F.size("b"))).alias("scale"), F.explode("b").alias("b")).join(used.select("b", "j"), "b")
    texts = flat.groupBy("i").agg(F.max("label").alias("label"), F.max("scale").alias("scale"), F.array_sort(F.collect_list("j")).alias("f"))
    both = texts.select(F.struct("i", "label", "scale", "f").alias("text"), F.lit(None).cast(used.schema["rows"].dataType).alias("rows"), F.lit(None).cast("int").alias("j"), F.lit(None).cast("int").alias("b"))
    both = both.unionByName(used.select(F.lit(None).cast(both.schema["text"].dataType).alias("text"), "rows", "j", "b"))
    used_struct = F.when(F.col("j").isNotNull(), F.struct("j", "b", "rows"))
    one = written(both.agg(F.array_sort(F.collect_list("text")).alias("texts"), F.array_sort(F.collect_list(used_struct)).alias("used")), "url-fit")

    ones = F.aggregate("texts", F.lit(0.0), lambda acc, t: acc + t["label"])
    balance = lambda label: F.size("texts") / (2.0 * F.when(label > 0.5, ones).otherwise(F.size("texts") - ones))

    def step(state: Column, _: Column) -> Column:
        def error(t: Column) -> Column:
            # Nesterov: the gradient where the momentum leads.
            total = F.aggregate(t["f"], F.lit(0.0), lambda acc, j: acc + state["w"][j] + 0.9 * state["speed"][j])
            return (t["label"] - 1.0 / (1.0 + F.exp(-total * t["scale"]))) * t["scale"] * t["weight"]

        def move(errors: Column) -> Column:
            gradient = F.transform("used", lambda u: F.aggregate(u["rows"], F.lit(0.0), lambda acc, i: acc + errors[i]))
            faster = F.zip_with(state["speed"], gradient, lambda v, g: 0.9 * v + F.lit(rate) * g / F.size("texts"))
            return _bound(faster, lambda speed: F.struct(F.zip_with(state["w"], speed, lambda w, v: w + v).alias("w"), speed.alias("speed")))

        return _bound(F.transform("weighted", error), move)

    weighted = F.transform("texts", lambda t: F.struct(t["label"], t["scale"], t["f"], balance(t["label"]).alias("weight")))
    zero = F.transform("used", lambda u: F.lit(0.0))
    fitted = one.withColumn("weighted", weighted).select("used", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(zero.alias("w"), zero.alias("speed")), step)["w"].alias("w"))
    found = fitted.select(F.transform("used", lambda u: u["b"]).alias("b"), F.transform("w", lambda w: F.round(w, 6)).alias("w")).first()
    weights = [0.0] * (size + 1)
    for b, w in zip(found["b"] or [], found["w"] or [], strict=True):
        weights[b] = w
    return weights


def score_of(features: Column, weights: list[float]) -> Column:
    """The probability of label 1 for buckets with the bias among them."""
    table = F.from_json(F.lit(str(weights)), "array<double>")
    total = F.aggregate(features, F.lit(0.0), lambda acc, b: acc + F.get(table, b))
    return 1.0 / (1.0 + F.exp(-total / F.sqrt(F.greatest(F.size(features), F.lit(1)))))


def score(host: Column, path: Column, weights: list[float]) -> Column:
    """The probability that a URL should be blocked."""
    size = len(weights) - 1
    return score_of(F.concat(buckets(host, path, size), F.array(F.lit(size))), weights)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its action; both null if none does.

    A rule is (action, host and path prefix).  Its host fits itself and all
    subdomains; its path must start the URL's.  Of equally long ones the first
    given counts.
    """
    ordered = sorted(rules, key=lambda r: -len(r[1]))
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, rule in reversed(ordered):
        own, _, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        name, action = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(verdict)).otherwise(action)
    return name, action


def judge(pages: DataFrame, weights: list[float], rules: list[tuple[str, str]], url: str = "url", keep: tuple[str, ...] = ("page_id",), threshold: float = 0.5) -> DataFrame:
    """``keep``, host, path, rule, verdict and score of every row.

    The verdict is the longest fitting rule's, or ``block`` where the model's
    score reaches ``threshold``.  Null URLs and those without ``://`` have an
    empty host and path, no rule, and are judged by the model like any other.
    A kept column with the name of one made here gives way to it.  Only the
    columns used are read; there is no shuffle.
    """
    keep = passed(keep, ("host", "path", "rule", "verdict", "score"))
    names = tuple(f"_k_{i}" for i in range(len(keep)))
    parts = pages.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    scored = parts.withColumns({"rule": rule, "_action": action, "score": score(F.col("host"), F.col("path"), weights)})
    verdict = F.coalesce(F.col("_action"), F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return scored.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], "host", "path", "rule", verdict.alias("verdict"), "score")
