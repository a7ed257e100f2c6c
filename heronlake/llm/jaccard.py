"""N-gram Jaccard join of documents by a prefix tree.

1. A document's set are the hashes of its distinct word n-grams.  Equal sets
   become one (their copies are linked without comparison).
2. Linked sets share at least some of the first n-grams of each in the order of
   their hashes: sets that share too few of these with any others are linked
   with nothing.  Of the sets left all n-grams are counted.
3. N-grams are ordered globally, rare ones first.  Linked sets share one of
   their first few; sets that do are candidates, and their connected
   components are joined independently.
4. In a component the sets are stored in a trie in that order.  Each set
   traverses it, sharing the partial overlaps of common paths, and leaves a
   subtree as soon as the remaining lengths can't give the overlap it needs.

N-grams are rows (token, rid) of two longs; counting and joining them is Spark's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heronlake.llm.common import by_bytes, forget, passed, shuffle_partitions, written
from heronlake.llm.components import components
from heronlake.llm.tokenhash import buffer, mix, ngram_hashes, word_hashes, word_spans

#: N-grams of a block of a trie.
BLOCK = 500_000
#: One of so many n-grams of a set is wanted beyond the first that a link needs, before sets are read whole.
SLACK = 8


def sets_of(column: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's word n-grams; a shorter text is one n-gram, an empty one none."""
    data, offsets = buffer(column)
    starts, lengths, first = word_spans(data, offsets)
    words = word_hashes(data, starts, lengths)
    grams = ngram_hashes(words, size)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            found = np.sort(grams[a : b - size + 1])
            keep = np.ones(len(found), dtype=bool)
            keep[1:] = found[1:] != found[:-1]
            out.append(found[keep])
        elif b > a:
            out.append(ngram_hashes(words[a:b], b - a) ^ np.uint64(b - a))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def _prints(found: list[np.ndarray]) -> list[bytes]:
    """A 128-bit fingerprint of each set."""
    with np.errstate(over="ignore"):
        return [int(mix(x).sum()).to_bytes(8, "big") + int(mix(x ^ np.uint64(0x5851F42D4C957F2D)).sum() ^ np.uint64(len(x))).to_bytes(8, "big") for x in found]


def need(n: int, percent: int) -> int:
    """The least overlap of a set of size n with any linked set, and the least size of one."""
    return -(-percent * n // 100)


def _lists(found: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
    flat = np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def describe(docs: DataFrame, size: int, percent: int, text: str, keep: tuple[str, ...]) -> DataFrame:
    """``keep``, n (set size), print (128-bit fingerprint of the set), mark (48 bits of it) and head: the first n-grams by hash, given once for equal sets of a batch.

    Of the o >= need(n) n-grams that a set shares with a linked one, the first
    k stand among its first n - need(n) + k, and so they do in the other set.
    """
    schema = docs.select(*keep).schema.add("n", "long").add("print", "binary").add("mark", "long").add("head", T.ArrayType(T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(batches, len(keep), 3 << 20):
            found = sets_of(part.column(len(keep)), size)
            prints = _prints(found)
            seen: set[bytes] = set()
            heads = []
            for x, p in zip(found, prints, strict=True):
                heads.append(x[:0] if p in seen else x[: len(x) - need(len(x), percent) + max(1, len(x) // SLACK)])
                seen.add(p)
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array([len(x) for x in found], pa.int64()), pa.array(prints, pa.binary()), pa.array([int.from_bytes(p[:6], "big") for p in prints], pa.int64()), _lists(heads)], names=schema.names)

    return docs.select(*keep, text).mapInArrow(run, schema)


def _shared(tokens: DataFrame, of: str = "rid") -> DataFrame:
    """(token, hub) of the n-grams of (token, rid) that more than one set holds, with the smallest."""
    return tokens.groupBy("token").agg(F.min(of).alias("hub"), F.max(of).alias("_last")).where("hub <> _last").select("token", "hub")


class Trie:
    """Ordered sets with shared starts; an edge holds the n-grams up to the next branch.

    A set is given by its n-grams that any other set holds, and its size: the
    n-grams of its own come first in the order and match nothing.
    """

    def __init__(self, percent: int):
        self.percent = percent
        self.root: list = [[], {}, [], 1 << 60, 0, 1 << 60]  # n-grams, children by their first, members that end here, least and largest set below, fewest own n-grams below

    def add(self, ordered: list[int], n: int, member: int) -> None:
        node, at, length, own = self.root, 0, len(ordered), n - len(ordered)
        node[3], node[4], node[5] = min(node[3], n), max(node[4], n), min(node[5], own)
        while at < length:
            child = node[1].get(ordered[at])
            if child is None:
                node[1][ordered[at]] = [ordered[at:], {}, [(member, n)], n, n, own]
                return
            edge, k = child[0], 0
            stop = min(len(edge), length - at)
            while k < stop and edge[k] == ordered[at + k]:
                k += 1
            if k < len(edge):  # split the edge where the sets part
                lower = [edge[k:], child[1], child[2], child[3], child[4], child[5]]
                child[0], child[1], child[2] = edge[:k], {edge[k]: lower}, []
            child[3], child[4], child[5] = min(child[3], n), max(child[4], n), min(child[5], own)
            node, at = child, at + k
        node[2].append((member, n))

    def matches(self, ordered: list[int], n: int) -> Iterator[int]:
        """Members linked with a set, the likeliest paths first."""
        p, alone = self.percent, n - len(ordered)
        place = {t: i for i, t in enumerate(ordered)}
        # 100 * overlap >= p * union  <=>  (100 + p) * overlap >= p * (n + m)
        q = 100 + p
        stack = [(self.root, 0, alone, 0)]  # node, overlap above it, own n-grams passed without a match, theirs without a match
        while stack:
            node, overlap, own, theirs = stack.pop()
            if 100 * node[4] < p * n or 100 * n < p * node[3]:
                continue
            least = max(node[3], -(-p * n // 100))
            # What remains on either side bounds the overlap that can still come.
            most_theirs = (100 * node[4] - p * n) // q - node[5]
            most_own = (100 * n - p * least) // q
            if theirs > most_theirs or own > most_own:
                continue
            for t in node[0]:
                i = place.get(t)
                if i is None:
                    theirs += 1
                    if theirs > most_theirs:
                        break
                else:
                    own = alone + i - overlap
                    overlap += 1
                    if own > most_own:
                        break
            else:
                for member, m in node[2]:
                    if q * overlap >= p * (n + m):
                        yield member
                matched = []
                for t, child in node[1].items():
                    (matched if t in place else stack).append((child, overlap, own, theirs))
                stack += matched


def _join(rids: list[int], labels: list[int], sets: list[list[int]], sizes: list[int], asks: list[bool], stores: list[bool], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the rows of one block; rows of one label count as linked already."""
    parent = list(range(len(rids)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    seen: dict[int, int] = {}
    for i, label in enumerate(labels):
        if label in seen:
            parent[i] = seen[label]
        else:
            seen[label] = i
    trie, out = Trie(percent), []
    # Rows that are only stored come first and rows that only ask last.
    order = sorted(range(len(rids)), key=lambda i: (asks[i] + (not stores[i]), sizes[i], rids[i]))
    roots: set[int] = set()  # linked groups that have a set in the trie
    for i in order:
        if asks[i]:
            open_ = len(roots) - (find(i) in roots)
            for j in trie.matches(sets[i], sizes[i]) if open_ else ():
                a, b = find(i), find(j)
                if a != b:
                    out.append((rids[i], rids[j]))
                    parent[b] = a
                    roots.discard(b)
                    roots.add(a)
                    open_ -= 1
                    if not open_:
                        break
        if stores[i]:
            trie.add(sets[i], sizes[i], i)
            roots.add(find(i))
    return out


_LINKS = "a long, b long"


def _forest(tasks: DataFrame, percent: int) -> DataFrame:
    """Links found in each task (task, component, rid, label, asks, stores, n, set); components of one task are joined one by one."""

    def run(table: pa.Table) -> pa.Table:
        component = table.column("component").to_numpy()
        order = np.argsort(component, kind="stable")
        cuts = np.flatnonzero(np.diff(component[order])) + 1
        links = []
        for rows in np.split(order, cuts):
            part = table.take(pa.array(rows))
            links += _join(*[part.column(c).to_pylist() for c in ("rid", "label", "set", "n", "asks", "stores")], percent)
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})

    return tasks.groupBy("task").applyInArrow(run, _LINKS)


def ordered_sets(sets: DataFrame, percent: int) -> DataFrame:
    """(rid, n, set): of (rid, n, set) the sets that share enough n-grams, and of each the shared ones in the global order: by the number of sets, then by hash."""
    tokens = sets.select("rid", "n", F.explode("set").alias("token"))
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1")
    # The n-grams of one set: bounded by its document.
    held = tokens.join(counts.hint("merge"), "token").groupBy("rid").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("_c", "token"))).alias("set"))
    return held.where(F.size("set") * 100 >= F.col("n") * percent).select("rid", "n", F.transform("set", lambda x: x["token"]).alias("set"))


def link_sets(sets: DataFrame, percent: int = 85) -> DataFrame:
    """Links (a, b) between the rows of ``sets`` (rid, n, set in the global order): a spanning forest of every linked group.

    Sets must differ from each other.  Candidates are found by the first
    n-grams in the global order, candidate components joined by tries.  A
    component above BLOCK n-grams is dealt to blocks: each is joined in itself
    and with the component's first row; then the rows outside its largest
    linked group (few, in a family of near copies) ask every block.  Pairs
    inside the largest group are linked already, so no link is lost.
    """
    spark = sets.sparkSession
    # A set's own n-grams come first in the order and are in no other set.
    first = F.size("set") - F.ceil(F.col("n") * percent / 100).cast("int") + 1
    heads = written(sets.select("rid", F.explode(F.slice("set", 1, F.greatest(first, F.lit(0)))).alias("token")), "jaccard-heads")
    edges = heads.join(_shared(heads).hint("merge"), "token").where("rid <> hub").select(F.col("rid").alias("a"), F.col("hub").alias("b")).distinct()
    groups = components(edges).withColumnRenamed("node", "rid")
    held = sets.join(groups, "rid")
    sizes = held.groupBy("component").agg(F.sum("n").alias("_n"))
    held = written(held.join(sizes, "component").withColumn("_blocks", F.ceil(F.col("_n") / BLOCK).cast("int")).select("component", "rid", "n", "set", "_blocks"), "jaccard-candidates")
    tasks = 4 * shuffle_partitions(spark)
    one = held.where("_blocks = 1").withColumn("task", F.pmod(F.xxhash64("component"), F.lit(tasks)).cast("string"))
    many = held.where("_blocks > 1")
    row = lambda task, label, asks, stores: [task, "component", "rid", label, F.lit(asks).alias("asks"), F.lit(stores).alias("stores"), "n", "set"]
    links = _forest(one.select(row("task", F.col("rid").alias("label"), True, True)), percent)
    if many.take(1):
        block = F.pmod(F.xxhash64("rid"), F.col("_blocks"))
        name = lambda b: F.concat_ws(":", "component", b.cast("string")).alias("task")
        own = many.select(row(name(block), F.col("rid").alias("label"), True, True))
        every = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
        hub = many.where("rid = component").withColumn("_b", every).where(F.col("_b") != block).select(row(name(F.col("_b")), F.col("rid").alias("label"), True, False))
        inner = written(_forest(own.unionByName(hub), percent), "jaccard-links")
        labels = components(inner)
        named = many.join(labels.select(F.col("node").alias("rid"), F.col("component").alias("_label")), "rid", "left").withColumn("label", F.coalesce("_label", "rid")).drop("_label")
        most = named.groupBy("component", "label").agg(F.count(F.lit(1)).alias("_c")).groupBy("component").agg(F.max(F.struct("_c", "label")).alias("_m")).select("component", F.col("_m.label").alias("_main"))
        named = written(named.join(most, "component"), "jaccard-named")
        data = named.select(row(name(block), "label", False, True))
        asking = named.where("label <> _main").withColumn("_b", every).select(row(name(F.col("_b")), "label", True, False))
        links = links.unionByName(inner).unionByName(_forest(data.unionByName(asking), percent))
    return links


_MADE = ("n_shingles", "component_id", "text_key")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Linked groups of documents: ``key``, ``keep``, n_shingles, component_id and text_key (xxhash64 of the text).

    Two documents link when 100 * intersection >= ``percent`` * union of their
    sets of ``size``-word n-grams (A to Z in lower case; a shorter text is one
    n-gram).  component_id is the smallest ``key`` reachable by links.  Null
    and empty texts have no n-grams and are linked with nothing: their
    component is their own key.  A null key is a row like any other, and a
    group of null keys only has a null component.  Repeated rows are copies.
    A kept column with the name of one made here, or of the key, gives way to it.
    """
    keep = passed(keep, (key, *_MADE))
    names = tuple(f"_k_{i}" for i in range(len(keep)))
    named = docs.select(F.col(key).alias("_key"), *[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.xxhash64(text).alias("_text_key"), F.col(text).alias("_text"))
    info = written(describe(named, size, percent, "_text", ("_key", *names, "_text_key")), "jaccard-documents")
    groups = info.where("n > 0").groupBy("print").agg(F.min("_key").alias("least"), F.min(F.struct("_key", "_text_key")).alias("rep"), F.max("n").alias("n"), F.max("mark").alias("mark"))
    groups = written(groups.select(F.monotonically_increasing_id().alias("rid"), "print", "least", F.col("rep._key").alias("rep_key"), F.col("rep._text_key").alias("rep_text"), "n", "mark"), "jaccard-sets")

    # Copies in several batches only let a set pass that needn't; a link is missed where the marks of both sets agree, once in 2**48.
    heads = info.select("mark", F.explode("head").alias("token"))
    # What grows with the input is never broadcast.
    found = heads.join(_shared(heads, "mark").hint("merge"), "token", "left_semi").groupBy("mark").agg(F.count(F.lit(1)).alias("_c"))
    enough = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * percent / 100) / SLACK))
    left = written(groups.join(found, "mark").where(F.col("_c") >= enough).select("rid", "rep_key", "rep_text", "n"), "jaccard-left")
    texts = named.join(left.hint("merge"), F.col("_text_key").eqNullSafe(F.col("rep_text")) & F.col("_key").eqNullSafe(F.col("rep_key"))).select("rid", "n", "_text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(batches, 2, 3 << 20):
            yield pa.RecordBatch.from_arrays([*part.columns[:2], _lists(sets_of(part.column(2), size))], names=["rid", "n", "set"])

    # Rows that repeat key and text stand for one set.
    sets = written(texts.dropDuplicates(["rid"]).mapInArrow(read, "rid long, n long, set array<long>"), "jaccard-values")
    ordered = written(ordered_sets(sets, percent), "jaccard-ordered")
    linked = components(link_sets(ordered, percent))
    whole = groups.join(linked.select(F.col("node").alias("rid"), "component"), "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    whole = written(whole.select("print", "component", "least"), "jaccard-groups")
    least = whole.groupBy("component").agg(F.min("least").alias("component_id"))
    final = whole.join(least, "component").select("print", "component_id")
    joined = info.join(final, "print", "left")
    forget(groups, left, sets, ordered)
    return joined.select(F.col("_key").alias(key), *[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("_key")).otherwise(F.col("component_id")).alias("component_id"), F.col("_text_key").alias("text_key"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each linked group the row with the smallest key stays.

    Rows without n-grams all stay, except that rows equal in key and text
    count as one.  Null keys come first.  Other columns may have any names.
    """
    columns = [F.col(c).alias(f"_c_{i}") for i, c in enumerate(docs.columns)]
    found = near_duplicates(docs.select(F.col(text).alias("_t"), F.col(key).alias("_d")), size, percent, "_t", "_d")
    row = F.struct(F.col("_d").alias("a"), F.col("text_key").alias("b"))
    stay = found.groupBy("component_id", F.when(F.col("n_shingles") == 0, row).alias("_alone")).agg(F.min(row).alias("_first"))
    stay = stay.select(F.col("_first.a").alias("_stay_key"), F.col("_first.b").alias("_stay_text"))
    own = docs.select(*columns, F.col(key).alias("_d"), F.xxhash64(text).alias("_h"))
    kept = own.join(stay, F.col("_d").eqNullSafe(F.col("_stay_key")) & (F.col("_h") == F.col("_stay_text")), "left_semi")
    return kept.dropDuplicates(["_d", "_h"]).select([F.col(f"_c_{i}").alias(c) for i, c in enumerate(docs.columns)])
