"""Substring deduplication by suffix automata of reference shards.

A window is ``length`` consecutive words of one document (words unchanged). A window is repeated if
its words also start anywhere else, in the same document too; every word under a repeated window goes.

Routing. Of each window the smallest hash among its ``ANCHOR``-word grams is its anchor; equal windows
have equal anchors. Consecutive windows with one anchor position form a run, a stretch of words. Runs
meet in shards by anchor:

* a run whose words are those of another run is repeated as a whole;
* runs that share an anchor with different words are the reference shard of that anchor: a
  generalised suffix automaton is built over them, and each run is streamed through it for its
  matching statistics, the longest suffix at each word that occurs elsewhere; where that reaches
  ``length``, the window is repeated;
* a run that is alone with its anchor is not repeated.

A reference shard is not broadcast, as repeated passages grow with the corpus, but sent to the task of
its anchor. Equal runs are contracted in the buffer that reads them. An anchor with more than
``HOT_HERE`` different runs in a buffer or ``HOT`` in all (a passage that very many documents share) is
split by whole windows instead, contracted in the same way, and its shard hears of it by a single
record from each buffer; so no group gathers in one task and nothing is capped. Runs and anchors
are compared by 128 and 64 bits of hashes of their words (runs by two polynomials over two seeds' word hashes), the automata work on the words themselves.

Null and empty texts have no words. Runs, asks and spans are keyed by a 64-bit hash of doc_id and text,
so different texts under a null or repeated doc_id have nothing to do with one another; rows that
repeat both are copies of one another and get the same spans. An empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shards, words

LENGTH = 35
ANCHOR = 18
HOT = 64
HOT_HERE = 16
RUN = np.dtype([("g", "<u8"), ("r", "<u8"), ("s", "<u8"), ("doc", "<i8"), ("start", "<i4"), ("n", "<i2"), ("many", "<i2")])
SPAN = np.dtype([("doc", "<i8"), ("start", "<i4"), ("n", "<i4")])
WINDOW = np.dtype([("a", "<u8"), ("b", "<u8"), ("doc", "<i8"), ("start", "<i4"), ("many", "<i4")])
ASK = np.dtype([("g", "<u8"), ("start", "<i4"), ("n", "<i2"), ("many", "<i1"), ("hot", "<i1")])
ASKED = np.dtype([("doc", "<i8"), *ASK.descr])
_RUNS, _SPANS, _WINDOWS, _ASKED = 0, 1, 2, 3
_SIGN = -1
_SEED = 0xD6E8FEB86659FD93


def _smallest(x: np.ndarray, k: int) -> np.ndarray:
    """Index of the first smallest of each k consecutive values."""
    value, at, width = x, np.arange(len(x)), 1
    while width < k:
        step = min(width, k - width)
        left = value[:-step] <= value[step:]
        at = np.where(left, at[:-step], at[step:])
        value = np.minimum(value[:-step], value[step:])
        width += step
    return at


def find_runs(h: np.ndarray, other: np.ndarray, index: np.ndarray, doc: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> np.ndarray:
    """The runs of a block of words that are hashed by two seeds."""
    if len(h) < length:
        return np.zeros(0, RUN)
    grams = words.Grams(h)
    g = grams.of(np.arange(len(h) - anchor + 1), anchor)
    at = _smallest(g, length - anchor + 1)
    row = np.repeat(np.arange(len(index) - 1), np.diff(index))
    window = np.flatnonzero(row[: len(h) - length + 1] == row[length - 1 :])
    at = at[window]
    first = shards.runs(at, row[window])
    n = np.diff(np.append(first, len(window)))
    start = window[first]
    out = np.zeros(len(first), RUN)
    out["g"] = g[at[first]]
    out["r"] = grams.of(start, n + length - 1)
    out["s"] = words.Grams(other).of(start, n + length - 1) + n.astype(np.uint64)
    out["doc"] = doc[row[start]]
    out["start"] = start - index[row[start]]
    out["n"] = n
    out["many"] = 1
    return out


def _contract(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one of each run, spans of those that were there more than once)."""
    runs = runs[np.lexsort((runs["s"], runs["r"], runs["g"]))]
    first = shards.runs(runs["g"], runs["r"], runs["s"])
    count = np.diff(np.append(first, len(runs)))
    again = np.repeat(count > 1, count)
    span = np.zeros(int(again.sum()), SPAN)
    for name in ("doc", "start", "n"):
        span[name] = runs[name][again]
    out = runs[first].copy()
    out["many"][count > 1] = 2
    return out, span


def _divert(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(runs for the shards, hot ones for the windows): an anchor with very many runs here sends its shard only a sign of that."""
    first = shards.runs(runs["g"])
    size = np.diff(np.append(first, len(runs)))
    hot = np.repeat(size > HOT_HERE, size)
    asked = np.zeros(int(hot.sum()), ASKED)
    for name in ("doc", "g", "start", "n", "many"):
        asked[name] = runs[name][hot]
    asked["hot"] = 1
    sign = np.zeros(int((size > HOT_HERE).sum()), RUN)
    sign["g"], sign["many"] = runs["g"][first[size > HOT_HERE]], _SIGN
    return np.concatenate([runs[~hot], sign]), asked


def _once(asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one of each ask, spans of those that were there more than once: rows that repeat doc_id and text)."""
    asked = np.sort(asked, order=["doc", "g", "start", "n", "many"])
    first = shards.runs(asked["doc"], asked["g"], asked["start"], asked["n"])
    count = np.diff(np.append(first, len(asked)))
    out = asked[np.append(first[1:], len(asked)) - 1] if len(first) else asked  # the last has the largest many
    span = np.zeros(int((count > 1).sum()), SPAN)
    for name in ("doc", "start", "n"):
        span[name] = out[name][count > 1]
    out["many"][count > 1] = 2
    return out, span


def _send_runs(length: int, anchor: int):
    def send(batches, n):
        held = []

        def flush():
            runs, span = _contract(np.concatenate(held))
            runs, asked = _divert(runs)
            yield from shards.pack(runs, shards.shard_of(words.mix(runs["g"]), n), _RUNS, n)  # anchors are smallest hashes, so not even themselves
            for kind, rows in ((_SPANS, np.unique(span)), (_ASKED, asked)):
                yield from shards.pack(rows, shards.shard_of(words.mix(rows["doc"].astype(np.uint64)), n), kind, n)

        for batch in batches:
            doc = batch.column(0).to_numpy()
            for i, index, h, starts, ends, data in words.hashed_words(batch.column(1), False):
                other = words.word_hashes(data, starts, ends, _SEED)
                held.append(find_runs(h, other, index, doc[i : i + len(index) - 1], length, anchor))
            if sum(x.nbytes for x in held) >= shards.FLUSH_BYTES:
                yield from flush()
                held = []
        if held:
            yield from flush()

    return send


def _by_doc(doc: np.ndarray, rows: np.ndarray) -> list[tuple[int, bytes]]:
    order = np.argsort(doc, kind="stable")
    doc, rows = doc[order], rows[order]
    first = shards.runs(doc)
    edge = np.append(first, len(doc))
    return [(int(doc[a]), rows[a:b].tobytes()) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def _verdict_rows(spans: np.ndarray, asks_doc: np.ndarray, asks: np.ndarray):
    s, a = _by_doc(spans["doc"], spans), _by_doc(asks_doc, asks)
    yield words.plain(
        ["doc_id", "spans", "asks"],
        [
            pa.array([d for d, _ in s] + [d for d, _ in a], pa.int64()),
            pa.array([x for _, x in s] + [None] * len(a), pa.binary()),
            pa.array([None] * len(s) + [x for _, x in a], pa.binary()),
        ],
    )


def _judge(got):
    """Spans that are settled, and the runs that an automaton has to settle."""
    runs = shards.joined(got.get(_RUNS), RUN)
    hot = np.unique(runs["g"][runs["many"] == _SIGN])
    runs = runs[runs["many"] != _SIGN]
    runs = runs[np.lexsort((runs["s"], runs["r"], runs["g"]))]
    first = shards.runs(runs["g"], runs["r"], runs["s"])
    count = np.diff(np.append(first, len(runs)))
    copied = np.repeat((count > 1) | (runs["many"][first] > 1), count)
    tell = copied & (runs["many"] == 1)  # the others were told of where they were contracted
    span = np.zeros(int(tell.sum()), SPAN)
    for name in ("doc", "start", "n"):
        span[name] = runs[name][tell]
    one = runs[first].copy()
    one["many"] = np.where(copied[first], 2, 1)
    group = shards.runs(one["g"])
    size = np.diff(np.append(group, len(one)))
    single = np.add.reduceat((one["many"] == 1).astype(np.int64), group) if len(group) else size
    signed = np.isin(one["g"][group], hot)
    wanted = np.repeat((size > 1) & (single > 0) | signed, size)
    ask = np.zeros(int(wanted.sum()), ASKED)
    for name in ("doc", "g", "start", "n", "many"):
        ask[name] = one[name][wanted]
    ask["hot"] = np.repeat((size > HOT) | signed, size)[wanted]
    asked, twice = _once(shards.joined(got.get(_ASKED), ASKED))
    ask = np.concatenate([ask, asked])
    own = np.zeros(len(ask), ASK)
    for name in ASK.names:
        own[name] = ask[name]
    yield from _verdict_rows(np.unique(np.concatenate([span, twice, shards.joined(got.get(_SPANS), SPAN)])), ask["doc"], own)


class SuffixAutomaton:
    """A generalised suffix automaton over lists of tokens, with how often each state's words end."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.size = [0]
        self.ends = [0]

    def add(self, tokens: list, weight: int = 1) -> None:
        nxt, link, size, ends = self.next, self.link, self.size, self.ends
        last = 0
        for t in tokens:
            known = nxt[last].get(t)
            if known is not None and size[known] == size[last] + 1:
                last = known
                ends[last] += weight
                continue
            if known is None:
                new = len(nxt)
                nxt.append({})
                size.append(size[last] + 1)
                link.append(0)
                ends.append(0)
                p = last
                while p >= 0 and t not in nxt[p]:
                    nxt[p][t] = new
                    p = link[p]
                if p < 0:
                    last = new
                    ends[last] += weight
                    continue
                known = nxt[p][t]
                if size[known] == size[p] + 1:
                    link[new] = known
                    last = new
                    ends[last] += weight
                    continue
            else:
                new, p = -1, last
            clone = len(nxt)
            nxt.append(nxt[known].copy())
            size.append(size[p] + 1)
            link.append(link[known])
            ends.append(0)
            while p >= 0 and nxt[p].get(t) == known:
                nxt[p][t] = clone
                p = link[p]
            link[known] = clone
            if new >= 0:
                link[new] = clone
                last = new
            else:
                last = clone
            ends[last] += weight

    def close(self) -> None:
        """Sums the ends of longer words into their suffixes."""
        for s in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            self.ends[self.link[s]] += self.ends[s]

    def shared(self, tokens: list) -> list[int]:
        """For each token, the length of the longest suffix there that ends at two places or more."""
        out, state = [], 0
        for t in tokens:
            state = self.next[state][t]
            s = state
            while s > 0 and self.ends[s] < 2:
                s = self.link[s]
            out.append(self.size[s])
        return out


def repeated_windows(contexts: list[tuple[list, int]], length: int = LENGTH) -> list[np.ndarray]:
    """For each (tokens, weight), which of its windows occur at two places or more."""
    automaton = SuffixAutomaton()
    for tokens, weight in contexts:
        automaton.add(tokens, weight)
    automaton.close()
    return [np.array(automaton.shared(tokens)[length - 1 :]) >= length if weight == 1 else np.ones(len(tokens) - length + 1, bool) for tokens, weight in contexts]


def _contexts(length: int):
    """The words of the runs that documents are asked for; of hot anchors, their windows."""

    def run(batches):
        hot, held, last = [], 0, None

        def flush():
            every = np.concatenate(hot) if hot else np.zeros(0, WINDOW)
            every = every[np.lexsort((every["b"], every["a"]))]
            first = shards.runs(every["a"], every["b"])
            count = np.diff(np.append(first, len(every)))
            again = np.repeat((count > 1) | (np.maximum.reduceat(every["many"], first) > 1 if len(first) else False), count)
            one = every[first].copy()
            one["many"] = np.where(again[first], 2, 1)
            told = every[again & (every["many"] == 1)]
            for rows, settled in ((one, False), (told, True)):
                if len(rows):
                    route = rows["a"].view(np.int64) if not settled else rows["doc"]
                    data = [x.tobytes() for x in rows]
                    yield words.plain(["route", "kind", "doc_id", "start", "many", "data"], [np.ascontiguousarray(route), np.full(len(rows), _SPANS if settled else _WINDOWS, np.int32), rows["doc"], rows["start"], rows["many"].astype(np.int32), pa.array(data, pa.binary())])

        for batch in batches:
            route, doc_id, start, many, data = [], [], [], [], []
            for doc, text, lists in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True):
                if doc == last:  # the same text again, whose asks tell of both
                    continue
                last = doc
                ask = np.frombuffer(b"".join(lists), ASK)
                tokens = (text or "").encode().split()
                for x in ask[ask["hot"] == 0]:
                    a, n = int(x["start"]), int(x["n"])
                    route.append(int(x["g"].view(np.int64)))
                    doc_id.append(doc)
                    start.append(a)
                    many.append(int(x["many"]))
                    data.append(b" ".join(tokens[a : a + n + length - 1]))
                for x in ask[ask["hot"] == 1]:
                    a, n = int(x["start"]), int(x["n"])
                    some = np.zeros(n, WINDOW)
                    marks = b"".join(xxhash.xxh3_128_digest(b" ".join(tokens[i : i + length])) for i in range(a, a + n))
                    some["a"], some["b"] = np.frombuffer(marks, "<u8").reshape(-1, 2).T
                    some["doc"], some["start"], some["many"] = doc, np.arange(a, a + n), x["many"]
                    hot.append(some)
                    held += some.nbytes
            if held >= shards.FLUSH_BYTES:
                yield from flush()
                hot, held = [], 0
            if route:
                yield words.plain(["route", "kind", "doc_id", "start", "many", "data"], [np.array(route, np.int64), np.full(len(route), _RUNS, np.int32), np.array(doc_id, np.int64), np.array(start, np.int32), np.array(many, np.int32), pa.array(data, pa.binary())])
        yield from flush()

    return run


def _automata(length: int):
    """Settles the runs and windows of a shard."""

    def run(batches):
        groups: dict[int, list] = {}
        windows, told = [], []
        for b in batches:
            for route, kind, doc, start, many, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if kind == _RUNS:
                    groups.setdefault(route, []).append((doc, start, many, data))
                elif kind == _WINDOWS:
                    windows.append(data)
                else:
                    told.append((doc, start, 1))
        for rows in groups.values():
            found = repeated_windows([(data.split(b" "), many) for *_, many, data in rows], length)
            for (doc, start, many, _), hit in zip(rows, found, strict=True):
                if many == 1 and hit.any():
                    at = np.flatnonzero(hit)
                    edge = np.append(np.append(0, np.flatnonzero(np.diff(at) > 1) + 1), len(at))
                    told += [(doc, start + int(at[i]), int(j - i)) for i, j in zip(edge[:-1], edge[1:], strict=True)]
        every = np.frombuffer(b"".join(windows), WINDOW)
        every = every[np.lexsort((every["b"], every["a"]))]
        first = shards.runs(every["a"], every["b"])
        if len(first):
            count = np.diff(np.append(first, len(every)))
            again = np.repeat((count > 1) | (np.maximum.reduceat(every["many"], first) > 1), count)
            rest = every[again & (every["many"] == 1)]
            told += [(int(x["doc"]), int(x["start"]), 1) for x in rest]
        span = np.array(told, SPAN) if told else np.zeros(0, SPAN)
        yield from _verdict_rows(span, np.zeros(0, np.int64), np.zeros(0, ASK))

    return run


_VERDICT = "doc_id long, spans binary, asks binary"


def repeated_spans(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """docs: doc_id that no two texts share, text. (doc_id, spans): packed (doc, first word, number of repeated windows), in one or more rows a document."""
    n = shards.shard_count(docs.sparkSession)
    met = shards.checkpointed(shards.exchange(docs, _send_runs(length, anchor), _judge, _VERDICT))
    asks = met.filter(F.col("asks").isNotNull()).groupBy("doc_id").agg(F.collect_list("asks").alias("asks"))
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]  # unused, but so the shuffle of the texts serves the cutting too
    rows = docs.join(asks, "doc_id").select("doc_id", "text", "asks", *rest).mapInArrow(_contexts(length), "route long, kind int, doc_id long, start int, many int, data binary")
    settled = rows.repartition(n, "route").mapInArrow(_automata(length), _VERDICT)
    return met.select("doc_id", "spans").unionByName(settled.select("doc_id", "spans")).filter(F.col("spans").isNotNull())


def _cut(length: int):
    def run(batches):
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, lists in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                tokens = (text or "").encode().split()
                n_words.append(len(tokens))
                if lists:
                    span = np.frombuffer(b"".join(lists), SPAN)
                    depth = np.zeros(len(tokens) + 1, np.int64)
                    np.add.at(depth, np.minimum(span["start"], len(tokens)), 1)
                    np.add.at(depth, np.minimum(span["start"] + span["n"] + length - 1, len(tokens)), -1)
                    stay = np.cumsum(depth[:-1]) == 0
                    tokens = [t for t, s in zip(tokens, stay.tolist(), strict=True) if s]
                n_removed.append(n_words[-1] - len(tokens))
                kept.append(b" ".join(tokens).decode())
            yield words.plain(["doc_id", "n_words", "n_removed", "kept_text"], [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())])

    return run


def remove_repeats(table: DataFrame, length: int = LENGTH, anchor: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text of every row."""
    docs = shards.documents(table)
    docs = docs.select(F.xxhash64("doc_id", "text", F.col("text").isNull()).alias("doc_id"), "text", F.col("doc_id").alias("id"))
    spans = repeated_spans(docs, length, anchor or max(1, length // 2 + 1)).groupBy("doc_id").agg(F.collect_list("spans").alias("spans"))
    out = docs.join(spans, "doc_id", "left").select("id", "text", "spans")
    out = out.mapInArrow(_cut(length), "doc_id long, n_words long, n_removed long, kept_text string")
    return out.withColumn("doc_id", shards.real_id())
