"""Mixing sources to target weights by entropy balancing, with DataFrame functions only.

Document i of source s gets the rate r = min(cap, exp(l_s * size_i / mean_s)):
of all rates up to the cap that give the source its token target, those closest
to 1 in relative entropy.  The dual variables l_s of all sources are found
together by Newton iterations over a histogram of sizes; rates then become
whole copies by rounding their running sum in each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heronlake.llm.common import forget, passed, written

#: Rows of one size class of a source that one window task may sort.
CLASS_ROWS = 50_000


def source_targets(by_source: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Add ``target`` to a table (source, source_size).

    Sources, by code point with null last, weigh ``weights`` in turn and share
    ``share`` times all sizes.  A target stops at ``cap`` times its source's
    size and the excess is shared again by weight until none is above: sources
    fill in the order of cap * size / weight, and the rest share one level.
    One row for each source; the windows see those rows only.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    fill = W.orderBy("_full", F.col("source").asc_nulls_last())
    rows = by_source.withColumn("_w", turn).withColumn("_full", F.lit(cap) * F.col("source_size") / F.col("_w"))
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_total", F.sum("source_size").over(W.partitionBy()) * F.lit(share))
    level = (F.col("_total") - F.lit(cap) * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("_w").over(fill.rowsBetween(0, W.unboundedFollowing))
    # The level is right from the first source that doesn't fill at it.
    rows = rows.withColumn("_level", level)
    rows = rows.withColumn("_level", F.min(F.when(F.col("_full") >= F.col("_level"), F.struct("_full", "_level"))).over(W.partitionBy())["_level"])
    target = F.when(F.col("_level").isNull() | (F.col("_full") <= F.col("_level")), F.lit(cap) * F.col("source_size")).otherwise(F.col("_w") * F.col("_level"))
    return rows.select("source", "source_size", target.cast("double").alias("target"))


def solve(hist: DataFrame, targets: DataFrame, cap: float = 2.0, rounds: int = 60, tolerance: float = 1e-9) -> DataFrame:
    """The dual variable ``dual`` of every source, by guarded Newton steps.

    ``hist`` is (source, size, n); ``targets`` is (source, source_size,
    source_rows, target).  Each round is one aggregation of the histogram; a
    step that leaves the bracket found so far is replaced by its middle.
    Sources whose target is the cap need no dual and keep null.
    """
    open_ = F.col("target") < F.lit(cap) * F.col("source_size") * (1 - 1e-12)
    state = targets.where(open_ & (F.col("source_size") > 0)).select(
        "source", "target", (F.col("source_size") / F.col("source_rows")).alias("mean"), F.lit(0.0).alias("dual"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(None).cast("double").alias("miss")
    )
    state = written(state, "mix-duals")
    for _ in range(rounds):
        z = F.col("size") / F.col("mean")
        free = F.exp(F.least(F.col("dual") * z, F.lit(50.0)))
        rate = F.least(F.lit(cap), free)
        step = (
            hist.join(state, hist["source"].eqNullSafe(state["source"]))
            .groupBy(state["source"], "target", "mean", "dual", "low", "high")
            .agg(F.sum(F.col("n") * F.col("size") * rate).alias("got"), F.sum(F.when(free < cap, F.col("n") * F.col("size") * z * rate).otherwise(0.0)).alias("slope"))
        )
        miss = F.col("got") - F.col("target")
        low = F.when(miss < 0, F.col("dual")).otherwise(F.col("low"))
        high = F.when(miss >= 0, F.col("dual")).otherwise(F.col("high"))
        step = step.select("source", "target", "mean", "dual", low.alias("low"), high.alias("high"), miss.alias("miss"), "slope")
        newton = F.when(F.col("slope") > 0, F.col("dual") - F.col("miss") / F.col("slope"))
        # Without a bound on a side yet, a step goes at most 8 + twice as far.
        far = F.lit(8.0) + F.abs("dual")
        middle = F.when(F.col("low").isNull(), F.col("dual") - far).when(F.col("high").isNull(), F.col("dual") + far).otherwise((F.col("low") + F.col("high")) / 2)
        inside = newton.isNotNull() & (newton >= F.coalesce("low", F.col("dual") - far)) & (newton <= F.coalesce("high", F.col("dual") + far))
        done = F.abs("miss") <= F.lit(tolerance) * F.col("target")
        seen = Observation()
        moved = step.withColumn("dual", F.when(done, F.col("dual")).when(inside, newton).otherwise(middle)).drop("slope")
        before, state = state, written(moved.observe(seen, F.max((F.abs("miss") > F.lit(tolerance) * F.col("target")).cast("int")).alias("open")), "mix-duals")
        forget(before)
        if not seen.get["open"]:
            break
    else:
        raise RuntimeError(f"some source misses its target after {rounds} Newton steps")
    return state.select("source", "mean", "dual")


_MADE = ("source", "size", "source_size", "target", "rate", "copies")


def mix(docs: DataFrame, size: Column, source: str = "source", key: str = "doc_id", keep: tuple[str, ...] = ("doc_id",), weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, cap: int = 2, trims: int = 4) -> DataFrame:
    """Copies of each document so that every source comes near its token target.

    Result: one row for each row of ``docs``: ``keep``, source, size,
    source_size, target, rate (double) and copies (long, at most ``cap``).
    Null sources are one source, the last; null sizes count as 0 and such
    documents get one copy at rate 1.  A kept column with the name of one made
    here gives way to it.  Rows that repeat a key are rounded one
    after the other; reruns agree because the order is by size, a hash of the
    key and the key.

    Rounding: with sizes falling, copies follow the running sum of rates, so
    that a source misses its target by about a document.  ``trims`` more
    rounds each take or add one copy of the document that brings the source
    nearest to its target, if one brings it nearer at all.
    """
    keep = passed(keep, _MADE)
    names = tuple(f"_k_{i}" for i in range(len(keep)))
    own = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.col(source).cast("string").alias("source"), F.coalesce(size, F.lit(0)).cast("long").alias("size"), F.xxhash64(key).alias("_h"))
    own = written(own.withColumn("_row", F.monotonically_increasing_id()), "mix-sizes")
    hist = written(own.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-histogram")
    by_source = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("source_rows"))
    goals = source_targets(by_source.select("source", "source_size"), weights, share, float(cap))
    goals = written(by_source.select("source", "source_rows").join(goals.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), "mix-targets")
    duals = solve(hist, goals, float(cap)).withColumnRenamed("source", "_s")
    full = goals.join(duals, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")

    # A size class of a source has one rate; large classes are cut by hash so that no window task is large.
    sized = hist.join(full.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("dual").isNull(), F.lit(float(cap))).otherwise(F.least(F.lit(float(cap)), F.exp(F.least(F.col("dual") * F.col("size") / F.col("mean"), F.lit(50.0)))))
    classes = sized.withColumn("rate", rate).withColumn("_cuts", F.ceil(F.col("n") / CLASS_ROWS))
    classes = written(classes.select(F.col("source").alias("_s"), F.col("size").alias("_z"), "source_size", "target", "rate", "_cuts"), "mix-rates")
    rated = own.join(classes, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z"))).drop("_s", "_z").withColumn("_cut", F.pmod("_h", "_cuts"))
    rated = written(rated, "mix-rated")

    # Running sum of the rates before each (size, cut) of a source: one row for each, not for each document.
    cells = rated.groupBy("source", "size", "_cut").agg(F.count(F.lit(1)).alias("_n"), F.max("rate").alias("_r"))
    ahead = W.partitionBy("source").orderBy(F.col("size").desc(), "_cut").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select(F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("_cut").alias("_c"), F.coalesce(F.sum(F.col("_n") * F.col("_r")).over(ahead), F.lit(0.0)).alias("_before"))
    cells = written(cells, "mix-cells")
    placed = rated.join(cells, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")) & (F.col("_cut") == F.col("_c"))).drop("_s", "_z", "_c")
    rank = F.row_number().over(W.partitionBy("source", "size", "_cut").orderBy("_h", *names, "_row"))
    # A millionth of slack keeps sums of whole rates whole.
    upto = lambda k: F.floor(F.col("_before") + F.col("rate") * k + F.lit(0.5 + 1e-6))
    copies = F.when(F.col("size") == 0, F.lit(1)).when(F.col("rate") >= cap, F.lit(cap)).otherwise(F.least(F.lit(cap), F.greatest(F.lit(0), upto(rank) - upto(rank - 1))))
    out = written(placed.withColumn("copies", copies.cast("long")), "mix-copies")

    # Trims: the document whose size is nearest to what a source still misses; one row for each source, and each round misses by less.
    forget(own, rated, cells, classes)
    change = None
    for _ in range(trims):
        now = out if change is None else out.join(change, "_row", "left").withColumn("copies", F.col("copies") + F.coalesce("_add", F.lit(0))).drop("_add")
        missing = now.groupBy("source").agg((F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("_miss"))
        missing = missing.withColumnRenamed("source", "_s")
        fits = (F.col("size") > 0) & (F.col("size") < 2 * F.abs("_miss")) & F.when(F.col("_miss") > 0, F.col("copies") < cap).otherwise(F.col("copies") > 0)
        best = now.join(missing, F.col("source").eqNullSafe(F.col("_s"))).where(fits).groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - F.abs("_miss")).alias("_off"), "size", "_h", "_row", F.signum("_miss").cast("long").alias("_add"))).alias("b"))
        found = best.select("b._row", "b._add")
        found = found if change is None else change.unionByName(found).groupBy("_row").agg(F.sum("_add").alias("_add"))
        change = written(found, "mix-trims")
    if change is not None:
        out = out.join(change, "_row", "left").withColumn("copies", F.col("copies") + F.coalesce("_add", F.lit(0)))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], "source", "size", "source_size", "target", "rate", F.col("copies").cast("long").alias("copies"))


def repeat_mixed(docs: DataFrame, size: Column, text: str = "text", source: str = "source", key: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` repeated by their copies; rows with 0 copies go.

    The mix runs on narrow rows; texts are joined back by their hash, each
    distinct text once.  Other columns may have any names.
    """
    columns = docs.columns
    at = {c: f"_in{i}" for i, c in enumerate(columns)}
    own = docs.select(*[F.col(c).alias(n) for c, n in at.items()], size.alias("_size"), F.xxhash64(text).alias("_text_key"))
    narrow = tuple(n for c, n in at.items() if c != text)
    mixed = mix(own, F.col("_size"), at[source], at[key], (*narrow, "_text_key"), **options).where("copies > 0").select(*narrow, "_text_key", "copies")
    texts = own.groupBy("_text_key").agg(F.first(at[text]).alias(at[text]))
    back = mixed.join(texts, "_text_key").withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return back.select([F.col(n).alias(c) for c, n in at.items()])
