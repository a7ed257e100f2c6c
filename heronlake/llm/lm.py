"""Scoring texts with an n-gram model, as a weighted backoff automaton.

States are histories with a count, arcs the n-grams seen after them, and each
state has a failure arc to the next shorter history:

    p_1(w)     = (c(w) + 1) / (N + V + 1)
    p_k(w | h) = (c(h w) + mu * p_{k-1}(w | h')) / (c(h) + mu)

so an arc weighs p_k where c(h w) > 0, and a failure arc mu / (c(h) + mu)
where it is 0.  A text is read left to right from the state after an end.

The counts are too many to send to each task.  Chunks of texts ask ranges of
n-gram hashes for the counts of just their n-grams; each range sums what the
chunks report and answers; then each chunk has its part of the automaton and
traverses its texts.  The number of ranges follows the size of all texts, so
that neither a range nor a chunk grows with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronlake.llm.common import by_bytes, passed
from heronlake.llm.tokenhash import buffer, combine, pack, pack_sorted, unpack, unpack_sorted, word_hashes, word_spans

#: Tokens of a chunk, and tokens of a text that are read at a stretch.
CHUNK, STRETCH = 1_500_000, 256
#: Bytes of text for a range of n-gram hashes, and for a task that reads chunks.
RANGE_BYTES, TASK_BYTES = 8 << 20, 20 << 20
#: The hash of the token that ends a text; words can't have it but by chance.
END = np.uint64(0x243F6A8885A308D3)

_PACKED = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("order", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("types", pa.int64()), ("tokens", pa.int64())])
_PACKED_SPARK = "chunk long, part int, order int, a binary, b binary, types long, tokens long"


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each with an end, and where each text starts, with the end."""
    data, offsets = buffer(column)
    starts, lengths, first = word_spans(data, offsets)
    words = word_hashes(data, starts, lengths)
    counts = np.diff(first) + 1
    begin = np.concatenate([[0], np.cumsum(counts)])
    out = np.full(int(begin[-1]), END, dtype=np.uint64)
    inner = np.ones(len(out), dtype=bool)
    inner[begin[1:] - 1] = False
    out[inner] = words
    return out, begin


def ngrams(tokens: np.ndarray, begin: np.ndarray, order: int) -> list[np.ndarray]:
    """The keys of the 1- to ``order``-grams that end at each token; before a text stand ends."""
    keys = [tokens]
    past = [tokens]
    for k in range(1, order):
        before = np.empty_like(tokens)
        before[1:] = past[-1][:-1]
        before[begin[:-1]] = END
        past.append(before)
        out = past[k]
        for j in range(k - 1, -1, -1):
            out = combine(out, past[j])
        keys.append(out)
    return keys


def _ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def _ask(batches: Iterator[pa.RecordBatch], kept: int, order: int, parts: int) -> Iterator[pa.RecordBatch]:
    """For each chunk: a row with its texts as numbers, and for each range and order its n-grams and their training counts."""
    task = TaskContext.get().partitionId()
    rows: list[pa.RecordBatch] = []
    tokens: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    serial = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal serial
        chunk = task << 32 | serial
        serial += 1
        flat, each = np.concatenate(tokens), np.concatenate(counts)
        begin = np.concatenate([[0], np.cumsum(each)])
        header = pa.Table.from_batches(rows).combine_chunks()
        train = np.repeat(~header.column(kept - 1).to_numpy().astype(bool), each)
        out = []
        for k, keys in enumerate(ngrams(flat, begin, order), 1):
            found, inverse = np.unique(keys, return_inverse=True)
            seen = np.bincount(inverse[train], minlength=len(found)).astype(np.uint32)
            if k == 1:
                header = header.append_column("__len", pa.array(each, pa.int64()))
                out.append((chunk, chunk % parts, 0, _ipc(header), _pair(pack_sorted(found), pack(inverse.astype(np.uint32))), 0, 0))
            # Ranges of the top 32 bits.
            cuts = np.searchsorted(found, _bounds(parts))
            cuts = np.append(cuts, len(found))
            for part in range(parts):
                s = slice(cuts[part], cuts[part + 1])
                if k == 1 or cuts[part + 1] > cuts[part]:
                    out.append((chunk, part, k, pack_sorted(found[s]), pack(seen[s]), 0, 0))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), _PACKED.types, strict=True)], schema=_PACKED)

    total = 0
    for batch in batches:
        flat, begin = tokens_of(batch.column(kept))
        rows.append(pa.RecordBatch.from_arrays(batch.columns[:kept], names=batch.schema.names[:kept]))
        tokens.append(flat)
        counts.append(np.diff(begin))
        total += len(flat)
        if total >= CHUNK:
            yield from flush()
            rows, tokens, counts, total = [], [], [], 0
    if rows:
        yield from flush()


def _bounds(parts: int) -> np.ndarray:
    """The least key of each range."""
    return ((np.arange(parts, dtype=np.uint64) << np.uint64(32)) // np.uint64(parts)) << np.uint64(32)


def _pair(a: bytes, b: bytes) -> bytes:
    return len(a).to_bytes(8, "big") + a + b


def _unpair(x: bytes) -> tuple[bytes, bytes]:
    n = int.from_bytes(x[:8], "big")
    return x[8 : 8 + n], x[8 + n :]


def _serve(table: pa.Table) -> pa.Table:
    """One range: the summed counts of each chunk's n-grams; with order 1 go the range's numbers of types and tokens."""
    order = table.column("order").to_numpy()
    out = [table.filter(pa.array(order == 0)).cast(_PACKED)]
    for k in range(1, int(order.max()) + 1):
        asked = table.filter(pa.array(order == k))
        if not asked.num_rows:
            continue
        keys = [unpack_sorted(x, np.uint64) for x in asked.column("a").to_pylist()]
        sizes = [len(x) for x in keys]
        flat = np.concatenate(keys)
        seen = np.concatenate([unpack(x, np.uint32) for x in asked.column("b").to_pylist()])
        sort = np.argsort(flat, kind="stable")
        ordered = flat[sort]
        new = np.ones(len(flat), dtype=bool)
        new[1:] = ordered[1:] != ordered[:-1]
        group = np.cumsum(new) - 1
        sums = np.bincount(group, weights=seen[sort]).astype(np.uint64)
        answer = np.empty(len(flat), dtype=np.uint64)
        answer[sort] = sums[group] if len(flat) else sums[:0]
        types, tokens = (int((sums > 0).sum()), int(sums.sum())) if k == 1 else (0, 0)
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        packed = [pack(answer[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        n = asked.num_rows
        out.append(pa.Table.from_arrays([asked.column("chunk").cast(pa.int64()), asked.column("part").cast(pa.int32()), asked.column("order").cast(pa.int32()), pa.array(packed, pa.binary()), pa.array([b""] * n, pa.binary()), pa.array([types] * n, pa.int64()), pa.array([tokens] * n, pa.int64())], schema=_PACKED))
    return pa.concat_tables(out)


class Automaton:
    """The part of the backoff automaton that the texts of a chunk can meet.

    ``ids[k]`` numbers the (k+1)-gram that ends at each token, ``counts[k]``
    holds the training count of each number.  State 0 is the empty history.
    Histories of k tokens are numbered from ``base[k]`` on: those of the chunk,
    and last the one before a text (``ends`` texts were trained on).  Those
    with a count are reached.  An arc leaves a state by a word, with a log10
    weight, for the longest history that the word leaves behind; the failure
    arc of a state leads to its next shorter history.
    """

    def __init__(self, ids: list[np.ndarray], counts: list[np.ndarray], begin: np.ndarray, ends: int, types: int, tokens: int, mu: tuple[float, ...]):
        self.words, self.order, self.types = ids[0].astype(np.int64), len(ids), len(counts[0])
        base = np.concatenate([[0, 1], 1 + np.cumsum([len(c) + 1 for c in counts[: self.order - 1]])]).astype(np.int64)
        self.start = int(base[-1]) - 1
        self.failure, self.lost = np.zeros(int(base[-1]), dtype=np.int64), np.zeros(int(base[-1]))
        keys, weights, targets = [], [], []
        p = None
        for k in range(self.order):
            # Any place of a (k+1)-gram tells its history, its word and its shorter n-grams.
            place = np.empty(len(counts[k]), dtype=np.int64)
            place[ids[k]] = np.arange(len(ids[k]))
            if k == 0:
                source = np.zeros(len(place), dtype=np.int64)
                p = (counts[0] + 1.0) / (tokens + types + 1.0)
                seen = np.ones(len(place), dtype=bool)
            else:
                before = np.full(len(ids[0]), len(counts[k - 1]), dtype=np.int64)
                before[1:] = ids[k - 1][:-1]
                before[begin[:-1]] = len(counts[k - 1])
                source = base[k] + before[place]
                held = np.append(counts[k - 1], float(ends))
                p = (counts[k] + mu[k - 1] * p[ids[k - 1][place]]) / (held[before[place]] + mu[k - 1])
                seen = counts[k] > 0
                own = slice(int(base[k]), int(base[k + 1]))
                self.lost[own] = np.log10(mu[k - 1] / (held + mu[k - 1]))
                if k > 1:
                    shorter = np.empty(len(held), dtype=np.int64)
                    shorter[ids[k - 1]] = ids[k - 2]
                    shorter[-1] = len(counts[k - 2])
                    self.failure[own] = base[k - 1] + shorter
            # The longest history that a word leaves behind has order - 1 tokens; an unseen word leaves none.
            left = base[k + 1] + np.arange(len(place)) if k + 1 < self.order else base[k] + ids[k - 1][place] if k else np.zeros(len(place), dtype=np.int64)
            targets.append(np.where(counts[k] > 0, left, 0)[seen])
            keys.append((source * self.types + self.words[place])[seen])
            weights.append(np.log10(p)[seen])
        every = np.concatenate(keys)
        sort = np.argsort(every, kind="stable")
        self.keys, self.weights, self.targets = every[sort], np.concatenate(weights)[sort], np.concatenate(targets)[sort]
        self.unigram = np.log10((counts[0] + 1.0) / (tokens + types + 1.0))

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The log10 probability of a word after each state, and the state that follows: failure arcs are taken until a state has an arc for the word."""
        gained = np.zeros(len(state))
        state, open_ = state.copy(), np.arange(len(state))
        while len(open_):
            key = state[open_] * self.types + word[open_]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            found, at = open_[hit], at[hit]
            gained[found] += self.weights[at]
            state[found] = self.targets[at]
            open_ = open_[~hit]
            gained[open_] += self.lost[state[open_]]
            state[open_] = self.failure[state[open_]]
        return gained, state

    def traverse(self, begin: np.ndarray) -> np.ndarray:
        """log10 probability of each text, read left to right with the state carried from token to token.

        Many texts take a step together.  A long text is read at stretches of
        STRETCH tokens side by side: as a state holds order - 1 tokens at most,
        reading these from the empty history on gives a stretch's first state.
        """
        length = np.diff(begin)
        pieces = -(-length // STRETCH)
        text = np.repeat(np.arange(len(length)), pieces)
        first = begin[:-1][text] + STRETCH * (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        stop = np.minimum(first + STRETCH, begin[1:][text])
        order = np.argsort(-(stop - first), kind="stable")
        text, first, stop = text[order], first[order], stop[order]
        state = np.full(len(text), self.start, dtype=np.int64)
        inner = np.flatnonzero(first > begin[:-1][text])
        state[inner] = 0
        for back in range(self.order - 1, 0, -1):
            state[inner] = self.step(state[inner], self.words[first[inner] - back])[1]
        total = np.zeros(len(text))
        live = np.searchsorted(-(stop - first), -np.arange(1, STRETCH + 1), side="right")
        for at, n in enumerate(live[live > 0]):
            gained, state[:n] = self.step(state[:n], self.words[first[:n] + at])
            total[:n] += gained
        return np.bincount(text, weights=total, minlength=len(length))


_MADE = (("held_out", "boolean"), ("n_tokens", "long"), ("n_known", "long"), ("train_tokens", "long"), ("base_score", "double"), ("score", "double"))


def score(docs: DataFrame, held_out: Column, text: str = "text", keep: tuple[str, ...] = ("doc_id",), order: int = 2, mu: tuple[float, ...] = (100.0, 20.0)) -> DataFrame:
    """Score every whole text with a model of the texts that are not held out.

    Result: ``keep``, held_out, n_tokens, n_known, train_tokens, base_score (of
    p_1) and score (of p_order), log10.  Null and empty texts are one end
    token.  A null ``held_out`` counts as false.  Where nothing is left to
    learn from, every token has probability 1.  A kept column with the name of
    one made here gives way to it.
    """
    keep = passed(keep, tuple(name for name, _ in _MADE))
    names = tuple(f"_k_{i}" for i in range(len(keep)))
    source = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).alias("_text"))
    kept = len(keep) + 1
    size = source.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    parts, tasks = max(6, -(-size // RANGE_BYTES)), max(6, -(-size // TASK_BYTES))
    schema = source.select(*names).schema
    for name, kind in _MADE:
        schema = schema.add(name, kind)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _ask(by_bytes(batches, kept, 3 << 20), kept, order, parts)

    def answer(table: pa.Table) -> pa.Table:
        kinds = table.column("order").to_numpy()
        at = int(np.flatnonzero(kinds == 0)[0])
        header = pa.ipc.open_stream(table.column("a")[at].as_py()).read_all()
        words, ids = _unpair(table.column("b")[at].as_py())
        words, ids = unpack_sorted(words, np.uint64), unpack(ids, np.uint32)
        flat = words[ids]
        each = header.column("__len").to_numpy()
        begin = np.concatenate([[0], np.cumsum(each)])
        answers = table.filter(pa.array(kinds > 0)).sort_by([("order", "ascending"), ("part", "ascending")])
        kinds = answers.column("order").to_numpy()
        types = int(answers.column("types").to_numpy().sum())
        tokens = int(answers.column("tokens").to_numpy().sum())
        numbers, counts = [], []
        ends = 0
        for k, keys in enumerate(ngrams(flat, begin, order), 1):
            sums = np.concatenate([unpack(answers.column("a")[int(i)].as_py(), np.uint64) for i in np.flatnonzero(kinds == k)])
            numbers.append(ids if k == 1 else np.unique(keys, return_inverse=True)[1])
            counts.append(sums.astype(np.float64))
            if k == 1:
                ends = int(sums[np.searchsorted(words, END)])
        automaton = Automaton(numbers, counts, begin, ends, types, tokens, mu)
        add = lambda x: np.add.reduceat(x, begin[:-1])
        found = [pa.array(each, pa.int64()), pa.array(add((counts[0][ids] > 0).astype(np.int64)), pa.int64()), pa.array(np.full(len(each), tokens), pa.int64()), pa.array(add(automaton.unigram[ids])), pa.array(automaton.traverse(begin))]
        return pa.Table.from_arrays([*[header.column(i) for i in range(kept)], *found], names=schema.names)

    packed = source.mapInArrow(ask, _PACKED_SPARK)
    served = packed.repartition(parts, "part").groupBy("part").applyInArrow(_serve, _PACKED_SPARK)
    scored = served.repartition(tasks, "chunk").groupBy("chunk").applyInArrow(answer, schema)
    return scored.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], *[name for name, _ in _MADE])
