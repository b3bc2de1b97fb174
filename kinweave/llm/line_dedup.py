"""Reversible line deduplication: sharded cuckoo filters before exact reference-count tables.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased; keys are compared by
128-bit digests. A key of at least ``min_chars`` code points that two documents hold stays only in
the smallest doc_id holding it.

Keys are contracted inside each buffer (smallest owner, number of holders), so the commonest line
costs one record per buffer; then they meet in hash shards. In a shard the cuckoo filter tells new
keys from those perhaps seen: new ones go straight into the table, and only the others are looked up
and merged in the exact table. A key that was seen always hits, so nothing is missed.

The state of a shard is a filter and a table of (key, count, owner). ``insert`` adds documents and
``delete`` takes them away again: a key whose count falls to zero leaves table and filter, and where
the owner went the next one is found among the documents that remain. In one call a key counts each
doc_id once, however many rows repeat it; a doc_id inserted by two calls counts twice, and goes by two deletions.
A shard's table is read into one task, so ``n_shards`` has to grow with the number of distinct lines (40 bytes each).

Null or empty texts are one empty line. Rows that repeat a doc_id are one document. A null doc_id
sorts after all others, and all rows with a null doc_id are one document. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shards, words

KEY = np.dtype([("a", "<u8"), ("b", "<u8")])
ENTRY = np.dtype([("a", "<u8"), ("b", "<u8"), ("owner", "<i8"), ("count", "<i8")])
DROP = np.dtype([("doc", "<i8"), ("a", "<u8"), ("b", "<u8")])
_ENTRIES, _DROPS, _TABLE, _FILTER = 0, 1, 2, 3
MIN_CHARS = 10
_BUFFER = 1 << 20
_CELL = 1 << 21  # entries to a binary cell of a stored state


class CuckooFilter:
    """16-bit fingerprints, four to a bucket, two buckets a key; whole arrays are added or removed at once."""

    def __init__(self, capacity: int, slots: np.ndarray | None = None):
        n = 1 << max(1, int(np.ceil(np.log2(max(1, capacity) / 4 / 0.8))))
        self.slots = np.zeros((n, 4), np.uint16) if slots is None else slots
        self.mask = np.uint64(len(self.slots) - 1)

    def _place(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mark = (key & np.uint64(0xFFFF)).astype(np.uint16)
        mark[mark == 0] = 1
        return ((key >> np.uint64(16)) & self.mask).astype(np.int64), mark

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ (words.mix(mark.astype(np.uint64)) & self.mask).astype(np.int64)

    def may_hold(self, key: np.ndarray) -> np.ndarray:
        one, mark = self._place(key)
        two = self._other(one, mark)
        return (self.slots[one] == mark[:, None]).any(1) | (self.slots[two] == mark[:, None]).any(1)

    def _settle(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Puts what fits into free slots; returns which did not."""
        order = np.argsort(bucket, kind="stable")
        at = bucket[order]
        start = shards.runs(at)
        rank = np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))
        free = self.slots[at] == 0
        fits = rank < free.sum(1)
        slot = np.argsort(~free, axis=1, kind="stable")[np.arange(len(at)), np.minimum(rank, 3)]
        self.slots[at[fits], slot[fits]] = mark[order][fits]
        left = np.ones(len(bucket), bool)
        left[order[fits]] = False
        return left

    def add(self, key: np.ndarray) -> None:
        bucket, mark = self._place(key)
        for attempt in range(600):
            if not len(bucket):
                return
            left = self._settle(bucket, mark)
            bucket, mark = bucket[left], mark[left]
            if attempt == 0 or not len(bucket):
                bucket = self._other(bucket, mark)
                continue
            # both buckets are full: one item per bucket takes a resident's place, the others turn to their other bucket
            first = np.unique(bucket, return_index=True)[1]
            at, own = bucket[first], mark[first]
            slot = (attempt * 7 + own.astype(np.int64)) % 4
            out = self.slots[at, slot].copy()
            self.slots[at, slot] = own
            bucket = self._other(bucket, mark)
            mark[first], bucket[first] = out, self._other(at, out)
            stay = np.ones(len(bucket), bool)
            stay[first[out == 0]] = False
            bucket, mark = bucket[stay], mark[stay]
        raise OverflowError("the cuckoo filter is overfull")

    def remove(self, key: np.ndarray) -> None:
        bucket, mark = self._place(key)
        for _ in range(8):
            for _ in range(2):
                if not len(bucket):
                    return
                hit = self.slots[bucket] == mark[:, None]
                code = np.where(hit.any(1), bucket * 4 + hit.argmax(1), -1)
                first = np.unique(code, return_index=True)[1]
                first = first[code[first] >= 0]
                self.slots.reshape(-1)[code[first]] = 0
                keep = np.ones(len(bucket), bool)
                keep[first] = False
                bucket, mark = bucket[keep], mark[keep]
                bucket = self._other(bucket, mark)


def line_keys(text: bytes, min_chars: int) -> list[bytes | None]:
    """The digest of each line's key; None for keys that are too short to count."""
    out = []
    for line in text.split(b"\n"):
        key = line.strip(words.SPACE).lower()
        if len(key) < min_chars or not key.isascii() and len(key.decode()) < min_chars:
            out.append(None)
        else:
            out.append(xxhash.xxh3_128_digest(key))
    return out


def _contract(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(an entry per key, drops already certain: holders that are not the smallest here)."""
    order = np.lexsort((doc, key["b"], key["a"]))
    doc, key = doc[order], key[order]
    once = shards.runs(key["a"], key["b"], doc)
    doc, key = doc[once], key[once]
    first = shards.runs(key["a"], key["b"])
    entry = np.zeros(len(first), ENTRY)
    entry["a"], entry["b"], entry["owner"] = key["a"][first], key["b"][first], doc[first]
    entry["count"] = np.diff(np.append(first, len(doc)))
    rest = np.ones(len(doc), bool)
    rest[first] = False
    drop = np.zeros(int(rest.sum()), DROP)
    drop["doc"], drop["a"], drop["b"] = doc[rest], key["a"][rest], key["b"][rest]
    return entry, drop


def _mapper(min_chars: int):
    def send(batches, n):
        docs, keys, held = [], [], 0

        def flush():
            key = np.frombuffer(b"".join(keys), KEY)
            entry, drop = _contract(np.array(docs, np.int64), key)
            yield from shards.pack(entry, shards.shard_of(entry["a"], n), _ENTRIES, n)
            yield from shards.pack(drop, shards.shard_of(words.mix(drop["doc"].astype(np.uint64)), n), _DROPS, n)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = [k for k in line_keys((text or "").encode(), min_chars) if k]
                keys += own
                docs += [doc] * len(own)
                held += len(own)
                if held >= _BUFFER:
                    yield from flush()
                    docs, keys, held = [], [], 0
        if held:
            yield from flush()

    return send


def _fold(table: np.ndarray) -> np.ndarray:
    """Entries of equal keys as one: summed counts, smallest owner."""
    table = table[np.lexsort((table["owner"], table["b"], table["a"]))]
    first = shards.runs(table["a"], table["b"])
    out = table[first].copy()
    if len(first):
        out["count"] = np.add.reduceat(table["count"], first)
    return out


def _insert(filt: CuckooFilter, table: list[np.ndarray], parts: list[bytes]) -> np.ndarray:
    """Adds buffers of entries; returns those whose key had perhaps been seen."""
    seen = []
    for part in parts:
        entry = np.frombuffer(part, ENTRY)
        old = filt.may_hold(entry["a"])
        # two new keys of one buffer may share a mark, but their digests differ: both are new
        filt.add(entry["a"][~old])
        table.append(entry[~old])
        seen.append(entry[old])
    return np.concatenate(seen) if seen else np.zeros(0, ENTRY)


def _state_of(got: dict[int, list[bytes]], room: int) -> tuple[CuckooFilter, np.ndarray]:
    table = shards.joined(got.get(_TABLE), ENTRY)
    have = len(table)
    filt = CuckooFilter(have + room)
    old = got.get(_FILTER)
    if old and len(old[0]) == filt.slots.nbytes:
        filt = CuckooFilter(0, np.frombuffer(old[0], np.uint16).reshape(-1, 4).copy())
    elif have:
        filt.add(table["a"])
    return filt, table


def _merge(got: dict[int, list[bytes]]) -> tuple[CuckooFilter, np.ndarray, np.ndarray]:
    """(filter, exact table, entries that met an earlier one) of a shard after its insertions."""
    parts = got.get(_ENTRIES, [])
    filt, old = _state_of(got, sum(len(p) for p in parts) // ENTRY.itemsize)
    pieces = [old]
    seen = _insert(filt, pieces, parts)
    table = np.concatenate(pieces)
    if not len(seen):
        return filt, table, seen
    again = np.isin(table["a"], seen["a"])
    meet = np.concatenate([table[again], seen])
    folded = _fold(meet)
    falsely = len(folded) - int(again.sum())  # keys that only shared a mark with another key
    if falsely:
        known = table[again]
        new = folded[~_held(folded, known)]
        filt.add(new["a"])
    return filt, np.concatenate([table[~again], folded]), meet


def _held(some: np.ndarray, among: np.ndarray) -> np.ndarray:
    kind = np.dtype("V16")
    a = np.ascontiguousarray(some[["a", "b"]].astype(KEY)).view(kind).ravel()
    b = np.ascontiguousarray(among[["a", "b"]].astype(KEY)).view(kind).ravel()
    return np.isin(a, b)


def _verdicts(got):
    """Drops of a shard by document, as concatenated digests."""
    _, _, meet = _merge(got)
    meet = meet[np.lexsort((meet["owner"], meet["b"], meet["a"]))]
    first = shards.runs(meet["a"], meet["b"])
    owner = np.repeat(meet["owner"][first], np.diff(np.append(first, len(meet))))
    lost = meet[meet["owner"] != owner]
    drop = np.zeros(len(lost), DROP)
    drop["doc"], drop["a"], drop["b"] = lost["owner"], lost["a"], lost["b"]
    drop = np.concatenate([drop, shards.joined(got.get(_DROPS), DROP)])
    drop = drop[np.argsort(drop["doc"], kind="stable")]
    first = shards.runs(drop["doc"])
    if len(first):
        edge = np.append(first, len(drop))
        key = np.ascontiguousarray(drop[["a", "b"]].astype(KEY))
        data = [key[edge[i] : edge[i + 1]].tobytes() for i in range(len(first))]
        yield words.plain(["doc_id", "keys"], [drop["doc"][first], pa.array(data, pa.binary())])


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, keys): the digests of the lines that each document loses, in one or more rows."""
    return shards.exchange(docs, _mapper(min_chars), _verdicts, "doc_id long, keys binary")


def _apply(min_chars: int):
    def run(batches):
        for batch in batches:
            n_lines, n_dropped, kept = [], [], []
            for text, lists in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = (text or "").encode()
                if not lists:
                    n_lines.append(raw.count(b"\n") + 1)
                    n_dropped.append(0)
                    kept.append(text or "")
                    continue
                gone = {part[i : i + 16] for part in lists for i in range(0, len(part), 16)}
                lines, keys = raw.split(b"\n"), line_keys(raw, min_chars)
                stay = [x for x, k in zip(lines, keys, strict=True) if k is None or k not in gone]
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
                kept.append(b"\n".join(stay).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())],
                ["doc_id", "n_lines", "n_dropped", "kept_text"],
            )

    return run


def dedup_lines(table: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text of every row of a documents table."""
    docs = shards.documents(table)
    gone = dropped_lines(docs, min_chars).groupBy("doc_id").agg(F.collect_list("keys").alias("keys"))
    out = docs.join(gone, "doc_id", "left").select("doc_id", "text", "keys")
    out = out.mapInArrow(_apply(min_chars), "doc_id long, n_lines long, n_dropped long, kept_text string")
    return out.withColumn("doc_id", shards.real_id())


# --- incremental state -------------------------------------------------------------------------

STATE = "shard int, kind int, data binary"


def _changed(sign: int):
    def run(batches):
        got: dict[int, dict[int, list[bytes]]] = {}
        for b in batches:
            for s, k, d in zip(*(c.to_pylist() for c in b.columns), strict=True):
                got.setdefault(s, {}).setdefault(k, []).append(d)
        for s, own in got.items():
            if sign > 0:
                filt, table, _ = _merge(own)
            else:
                filt, table = _state_of(own, 0)
                less = _fold(shards.joined(own.get(_ENTRIES), ENTRY))
                less["count"] *= -1
                both = np.concatenate([table, less[_held(less, table)]])
                order = np.lexsort((both["count"] < 0, both["b"], both["a"]))
                both = both[order]
                first = shards.runs(both["a"], both["b"])
                count = np.add.reduceat(both["count"], first) if len(first) else np.zeros(0, np.int64)
                table = both[first].copy()
                table["count"] = count
                filt.remove(table["a"][count <= 0])
                table = table[count > 0]
            yield from _stored(s, table, filt.slots.tobytes())

    return run


def _stored(shard: int, table: np.ndarray, slots: bytes):
    """A shard's rows: its filter, and its table in cells of bounded size."""
    cells = [table[i : i + _CELL].tobytes() for i in range(0, max(1, len(table)), _CELL)]
    for kind, data in [(_FILTER, slots), *((_TABLE, c) for c in cells)]:
        yield words.plain(["shard", "kind", "data"], [np.array([shard], np.int32), np.array([kind], np.int32), pa.array([data], pa.binary())])


def _entries(n: int):
    """Packs (a, b, doc_id) rows, each once, contracted by key."""

    def run(batches):
        for b in batches:
            key = np.zeros(len(b), KEY)
            for c in ("a", "b"):
                key[c] = b.column(c).to_numpy().view(np.uint64)
            entry, _ = _contract(b.column("doc_id").to_numpy(), key)
            yield from shards.pack(entry, shards.shard_of(entry["a"], n), _ENTRIES, n)

    return run


def _rolled(state: DataFrame | None, table: DataFrame, sign: int, n_shards: int, min_chars: int) -> DataFrame:
    # rows that repeat a doc_id are one document, wherever they stand, so a key counts each doc_id once
    packed = holders(table, min_chars).distinct().mapInArrow(_entries(n_shards), STATE)
    if state is not None:
        packed = packed.unionByName(state.select("shard", "kind", "data"))
    return packed.repartitionById(n_shards, F.col("shard")).mapInArrow(_changed(sign), STATE)


def insert(state: DataFrame | None, table: DataFrame, n_shards: int = 64, min_chars: int = MIN_CHARS) -> DataFrame:
    """The state after adding documents; None is the empty state. n_shards stays the same for one state."""
    return _rolled(state, table, 1, n_shards, min_chars)


def delete(state: DataFrame, gone: DataFrame, remaining: DataFrame, n_shards: int = 64, min_chars: int = MIN_CHARS) -> DataFrame:
    """The state after taking documents away that were inserted; remaining holds all other inserted documents."""
    left = _rolled(state, gone, -1, n_shards, min_chars)
    keys = entries(left).select("a", "b", "owner")
    orphans = keys.join(shards.documents(gone).select(F.col("doc_id").alias("owner")).distinct(), "owner", "left_semi")
    owners = holders(remaining, min_chars).join(orphans.select("a", "b"), ["a", "b"], "left_semi")
    owners = owners.groupBy("a", "b").agg(F.min("doc_id").alias("owner"))

    def packed(batches):
        for b in batches:
            entry = np.zeros(len(b), ENTRY)
            for c in ("a", "b"):
                entry[c] = b.column(c).to_numpy().view(np.uint64)
            entry["owner"] = b.column("owner").to_numpy()
            yield from shards.pack(entry, shards.shard_of(entry["a"], n_shards), _ENTRIES, n_shards)

    def owned(batches):
        got: dict[int, dict[int, list[bytes]]] = {}
        for b in batches:
            for s, k, d in zip(*(c.to_pylist() for c in b.columns), strict=True):
                got.setdefault(s, {}).setdefault(k, []).append(d)
        for s, own in got.items():
            table, new = shards.joined(own.get(_TABLE), ENTRY).copy(), shards.joined(own.get(_ENTRIES), ENTRY)
            if len(new):
                both = np.concatenate([table, new])
                both = both[np.lexsort((both["count"], both["b"], both["a"]))]  # the new owner stands before its entry
                last = np.append(shards.runs(both["a"], both["b"])[1:], len(both)) - 1
                first = shards.runs(both["a"], both["b"])
                table = both[last].copy()
                table["owner"] = both["owner"][first]
            if _TABLE in own:
                yield from _stored(s, table, own[_FILTER][0])

    rows = left.unionByName(owners.mapInArrow(packed, STATE))
    return rows.repartitionById(n_shards, F.col("shard")).mapInArrow(owned, STATE)


def entries(state: DataFrame) -> DataFrame:
    """The exact table of a state: a, b (the key's digest), owner, count."""

    def run(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                t = np.frombuffer(data, ENTRY)
                yield words.plain(["a", "b", "owner", "count"], [t["a"].view("<i8"), t["b"].view("<i8"), t["owner"], t["count"]])

    return state.filter(F.col("kind") == _TABLE).select("data").mapInArrow(run, "a long, b long, owner long, count long")


def holders(table: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(a, b, doc_id): one row per key and document."""

    def run(batches):
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                key = np.frombuffer(b"".join({k for k in line_keys((text or "").encode(), min_chars) if k}), KEY)
                yield words.plain(["a", "b", "doc_id"], [key["a"].view("<i8"), key["b"].view("<i8"), np.full(len(key), doc, np.int64)])

    return shards.documents(table).mapInArrow(run, "a long, b long, doc_id long")
