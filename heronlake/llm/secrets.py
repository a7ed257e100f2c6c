"""Secret scans, with corpus-wide ownership of each candidate.

Base rules give spans of three kinds.  Besides, long mixed-case strings are
candidates; hashes of all candidates are counted over the whole corpus by
distinct repositories and owners.  A candidate that many owners hold is a
copied example; one that a single owner holds is a live-looking credential and
its span is added as kind ``owned``; one that few hold is added as ``shared``.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heronlake.llm.common import by_bytes, passed, written

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
OPEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: In the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "owned", "shared")

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("hash", T.StringType())])


def candidates(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, hash of the secret) of one text: all base spans, and ``open`` candidates that overlap none."""
    found = []
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= 8:
            found.append(("assign", m.start(), m.end(), m[2]))
    found += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    base = sorted((a, b) for _, a, b, _ in found)
    starts, reach = [a for a, _ in base], list(accumulate((b for _, b in base), max))
    for m in OPEN.finditer(text):
        s = m[0]
        before = bisect_left(starts, m.end())
        if re.search("[A-Z]", s) and re.search("[a-z]", s) and re.search("[0-9]", s) and not (before and reach[before - 1] > m.start()):
            found.append(("open", m.start(), m.end(), s))
    return [(k, a, b, hashlib.sha256(s.encode()).hexdigest()[:32]) for k, a, b, s in sorted(found, key=lambda x: (x[1], (*KINDS[:3], "open").index(x[0])))]


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "found") -> DataFrame:
    """The columns ``keep`` and an array ``out`` of candidate spans of every whole text; null texts have none.  A kept column named like ``out`` gives way."""
    keep = passed(keep, (out,))
    source = docs.select(*keep, text)
    schema = docs.select(*keep).schema.add(out, T.ArrayType(SPAN))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("hash", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(batches, len(keep), 4 << 20):
            rows = [[dict(zip(("kind", "start", "end", "hash"), x, strict=True)) for x in candidates(t or "")] for t in part.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(rows, kind)], names=schema.names)

    return source.mapInArrow(run, schema)


def ownership(spans: DataFrame, repo: str = "repo", owner: str = "owner") -> DataFrame:
    """hash, n_spans, n_repos, n_owners over all rows of (hash, repo, owner).

    Counting first by (hash, repo, owner) keeps a hash with very many copies
    from meeting in one task: each task sends one row for each triple.
    """
    triples = spans.groupBy("hash", repo, owner).agg(F.count(F.lit(1)).alias("n"))
    # A null repository or owner counts as one of its own.
    return triples.groupBy("hash").agg(
        F.sum("n").alias("n_spans"),
        (F.count_distinct(repo) + F.max(F.col(repo).isNull().cast("long"))).alias("n_repos"),
        (F.count_distinct(owner) + F.max(F.col(owner).isNull().cast("long"))).alias("n_owners"),
    )


def scan_owned(docs: DataFrame, repo: Column, owner: Column, text: str = "text", keep: tuple[str, ...] = ("doc_id",), max_owners: int = 1, copied_owners: int = 3, copied_repos: int = 5) -> DataFrame:
    """Scan every text and label each span by the ownership of its secret.

    Result: one row for each row of ``docs``: ``keep`` and an array ``spans``
    of (start, rank, kind, end, hash, n_repos, n_owners, status).  Status is
    ``owned`` (at most ``max_owners`` owners, in any number of repositories),
    ``copied`` (at least ``copied_owners`` owners, or more than ``max_owners``
    and at least ``copied_repos`` repositories) or ``shared``.  Base spans
    always stay, with their status; ``open`` candidates stay unless copied, and
    their kind is then the status.  Null texts and texts without a candidate
    have an empty array.  Repeated rows stay apart.  A kept column named spans
    gives way.
    """
    keep = passed(keep, ("spans",))
    names = tuple(f"_k_{i}" for i in range(len(keep)))
    named = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], repo.alias("_repo"), owner.alias("_owner"), F.col(text).alias("_text"))
    found = scan(named, "_text", (*names, "_repo", "_owner"), "_found")
    # Written once: the number given to a row then holds.
    found = written(found.withColumn("_row", F.monotonically_increasing_id()), "secret-candidates")
    flat = found.where(F.size("_found") > 0).select("_row", "_repo", "_owner", F.explode("_found").alias("s")).select("_row", "_repo", "_owner", "s.*")
    owned = ownership(flat.select("hash", F.col("_repo").alias("repo"), F.col("_owner").alias("owner")))
    copied = (F.col("n_owners") >= copied_owners) | ((F.col("n_owners") > max_owners) & (F.col("n_repos") >= copied_repos))
    status = F.when(F.col("n_owners") <= max_owners, "owned").when(copied, "copied").otherwise("shared")
    labelled = flat.join(owned, "hash").withColumn("status", status)
    labelled = labelled.where((F.col("kind") != "open") | (F.col("status") != "copied")).withColumn("kind", F.when(F.col("kind") == "open", F.col("status")).otherwise(F.col("kind")))
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    # The spans of one text: bounded by the text.
    by_row = labelled.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "kind", "end", "hash", "n_repos", "n_owners", "status"))).alias("_spans"))
    joined = found.select("_row", *names).join(by_row, "_row", "left")
    return joined.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], F.coalesce("_spans", F.array().cast(by_row.schema["_spans"].dataType)).alias("spans"))


def mask(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced by ``mark``; spans that overlap an earlier one are cut at its end.

    ``spans`` must be sorted by start.  Null texts stay null.
    """
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))
    step = F.aggregate(
        spans,
        start,
        lambda acc, s: F.struct(
            F.when(s["start"] >= acc["at"], F.concat(acc["done"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["done"]).alias("done"),
            F.greatest(acc["at"], s["end"]).alias("at"),
        ),
    )
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(step["done"], F.substring(text, step["at"] + 1, F.length(text))))


def digest(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask_owned(docs: DataFrame, repo: Column, owner: Column, text: str = "text", mark: str = "[SECRET]", **options) -> DataFrame:
    """The rows of ``docs`` with every span of their texts masked, base spans and those that are not copied.

    Which spans a text has depends on the text and the corpus alone, so they
    are joined back by a hash of the text, once for each distinct text.  Other
    columns may have any names.
    """
    at = {c: f"_in{i}" for i, c in enumerate(docs.columns)}
    own = docs.select(*[F.col(c).alias(n) for c, n in at.items()], repo.alias("_r"), owner.alias("_o"), F.xxhash64(text).alias("_text_key"))
    found = scan_owned(own, F.col("_r"), F.col("_o"), at[text], ("_text_key",), **options).where(F.size("spans") > 0)
    once = found.groupBy("_text_key").agg(F.min("spans").alias("_spans"))
    masked = F.when(F.col("_spans").isNull(), F.col(at[text])).otherwise(mask(F.col(at[text]), F.col("_spans"), mark))
    return own.join(once, "_text_key", "left").select([(masked if c == text else F.col(n)).alias(c) for c, n in at.items()])
