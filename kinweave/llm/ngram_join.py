"""Jaccard join on word n-grams: size-banded tiles, bitmap signatures, exact intersections.

A document's set is its distinct 3-word shingles of lower-cased (A-Z) words. Two sets x and y link at
Jaccard >= 0.9 exactly when their symmetric difference d satisfies 19 d <= |x| + |y|.

Tiles. Set sizes fall into bands. A pair whose smaller set is in band k differs in at most D_k
shingles, so if the hash space is cut into D_k + 1 + t_k ranges, the two sets agree on all but D_k of
them. Each set sends the digest of every range that isn't empty, for its own band and, where a
smaller partner can be in the band below, for that one too. Only sets that agree on a whole range
meet in a tile; common phrases alone bring nothing together. A pair could agree on empty ranges only
if both sets leave more than t_k ranges empty; those few also send the classic prefix of their
sorted shingles. So no link is lost.

Candidates. Tiles give star edges, whose components are the groups in which all links lie. In a
group, signed bitmaps (the parity of hashed shingles) bound the symmetric difference from below, that
is the overlap from above; only pairs that pass are intersected exactly, array by array. Members
already known to be connected are not compared again, so a group of n near copies costs about n
comparisons. A group over ``group_rows`` documents, or as many times ``SHINGLES_A_ROW`` shingles, is compared with its smallest member first, spread over
tasks; only members that don't link with that one are then compared with all, block by block.

Copies of one set are linked inside the buffer that reads them and only one goes on, so a huge group
of copies costs one set a buffer. Sets without shingles link with nothing. Rows that repeat a doc_id
are one node that has the links of all of them, and stand in the result as often. Null doc_ids sort
last and are one node, returned as null. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache
from math import exp, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators.graph import connected_components

from . import shards, words

PAIR = np.dtype([("key", "<u8"), ("doc", "<i8")])
EDGE = np.dtype([("a", "<i8"), ("b", "<i8")])
_TILES, _LINKS, _SIZES = 0, 1, 2
GROUP_ROWS = 4096
SHINGLES_A_ROW = 1024
_BAND = 1.5
_LEAST = 9  # smaller sets link only when equal

_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def linked(both: np.ndarray, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """100 * intersection >= 90 * union, in whole numbers."""
    return 100 * both >= 90 * (one + other - both)


@lru_cache
def bands(largest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower edge, number of ranges, empty ranges allowed) of the bands up to a size."""
    edge = [_LEAST]
    while edge[-1] <= largest:
        edge.append(max(edge[-1] + 1, int(edge[-1] * _BAND)))
    ranges, spare = [], []
    for low, high in zip(edge, edge[1:], strict=False):
        most = ((high - 1) + (high - 1) * 10 // 9) // 19
        # as few spare ranges as make sets with more empty ones rare
        lack = []
        for t in range(1, 40):
            empty = (most + 1 + t) * exp(-low / (most + 1 + t))
            lack.append(max(0.0, empty + 3 * sqrt(empty) - t))
            if not lack[-1]:
                break
        t = int(np.argmin(lack)) + 1
        m = most + 1 + t
        ranges.append(m)
        spare.append(t)
    return np.array(edge[:-1], np.int64), np.array(ranges, np.int64), np.array(spare, np.int64)


def shingle_sets(column, n: int = 3):
    """For each block: (first row, sorted distinct shingles of all its rows, index of each row's first)."""
    for i, index, h, *_ in words.hashed_words(column, True):
        rows, count = len(index) - 1, np.diff(index)
        short = np.flatnonzero((count > 0) & (count < n))
        out = np.zeros(0, np.uint64)
        if len(h) >= n:
            x = h[: len(h) - n + 1].copy()
            for k in range(1, n):
                x = x * _C[0] + h[k : len(h) - n + 1 + k]
            out = words.mix(x)
        own = np.repeat(np.arange(rows), count)
        ok = own[: len(out)] == own[n - 1 :][: len(out)] if len(out) else np.zeros(0, bool)
        sets, whose = out[ok], own[: len(out)][ok]
        if len(short):  # the whole sequence as one
            whole = [words.mix(np.array([np.bitwise_xor.reduce(words.mix(h[index[r] : index[r + 1]] + np.arange(count[r], dtype=np.uint64) * _C[1]))], np.uint64) ^ _C[int(count[r])])[0] for r in short]
            sets, whose = np.append(sets, np.array(whole, np.uint64)), np.append(whose, short)
            order = np.argsort(whose, kind="stable")
            sets, whose = sets[order], whose[order]
        at = np.searchsorted(whose, np.arange(rows + 1))
        for a, b in zip(at[:-1], at[1:], strict=True):
            sets[a:b].sort()
        new = np.ones(len(sets), bool)
        new[1:] = (sets[1:] != sets[:-1]) | (whose[1:] != whose[:-1])
        yield i, sets[new], np.searchsorted(whose[new], np.arange(rows + 1))


def tile_keys(sets: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row): what each set sends to its tiles."""
    size = np.diff(index)
    keys, rows = [], []
    have = np.flatnonzero(size)
    total = np.zeros(len(sets) + 1, np.uint64)
    np.cumsum(words.mix(sets ^ _C[2]), out=total[1:])
    keys.append(words.mix((total[index[have + 1]] - total[index[have]]) ^ (size[have].astype(np.uint64) * _C[3])))
    rows.append(have)
    if len(size) and size.max() >= _LEAST:
        low, ranges, spare = bands(int(size.max()))
        home = np.searchsorted(low, size, side="right") - 1
        below = home - 1
        visits = (below >= 0) & (10 * (low[np.maximum(home, 0)] - 1) >= 9 * size)
        whose = np.repeat(np.arange(len(size)), size)
        for band, part in ((home, home >= 0), (below, visits)):
            pick = part[whose]
            at, row = np.flatnonzero(pick), whose[pick]
            if not len(at):
                continue
            m = ranges[band[row]].astype(np.uint64)
            piece = (sets[at] >> np.uint64(32)) * m >> np.uint64(32)
            first = shards.runs(piece, row)
            last = np.append(first[1:], len(at)) - 1
            digest = total[at[last] + 1] - total[at[first]]
            place = (band[row[first]].astype(np.uint64) << np.uint64(40)) + (piece[first] << np.uint64(1))
            keys.append(words.mix(digest ^ words.mix(place + _C[1])))
            rows.append(row[first])
            full = np.bincount(row[first], minlength=len(size))
            for r in np.flatnonzero(part & (ranges[np.maximum(band, 0)] - full > spare[np.maximum(band, 0)])):
                prefix = sets[index[r] : index[r] + size[r] - -(-9 * size[r] // 10) + 1]
                keys.append(words.mix(prefix ^ words.mix(np.array([(int(band[r]) << 40) + 1], np.uint64) + _C[1])))
                rows.append(np.full(len(prefix), r))
    return np.concatenate(keys), np.concatenate(rows)


def _hang(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one pair per key, edges from the other holders of a key to it)."""
    pairs = pairs[np.lexsort((pairs["doc"], pairs["key"]))]
    first = shards.runs(pairs["key"])
    hub = np.repeat(pairs["doc"][first], np.diff(np.append(first, len(pairs))))
    far = pairs["doc"] != hub
    edge = np.zeros(int(far.sum()), EDGE)
    edge["a"], edge["b"] = pairs["doc"][far], hub[far]
    return pairs[first], np.unique(edge)


def _tiles(batches, n):
    pairs, links, sizes, copies, held = [], [], [], {}, 0

    def flush():
        left, edges = _hang(np.concatenate(pairs)) if pairs else (np.zeros(0, PAIR), np.zeros(0, EDGE))
        yield from shards.pack(left, shards.shard_of(left["key"], n), _TILES, n)
        for kind, rows in ((_TILES + 10, [edges]), (_LINKS, links), (_SIZES, sizes)):
            rows = np.concatenate([np.zeros(0, EDGE), *rows])
            yield from shards.pack(rows, shards.shard_of(words.mix(rows["a"].astype(np.uint64)), n), kind, n)

    for batch in batches:
        doc = batch.column(0).to_numpy()
        for i, sets, index in shingle_sets(batch.column(1)):
            count = np.diff(index)
            ids = doc[i : i + len(count)]
            known = np.zeros(len(count), EDGE)
            known["a"], known["b"] = ids, count
            sizes.append(known)
            fresh, same = np.zeros(len(count), bool), []
            for r in np.flatnonzero(count):
                own = sets[index[r] : index[r + 1]]
                twin = copies.get(mark := (len(own), own[0], own[-1], own[len(own) // 2]))
                if twin is not None and np.array_equal(twin[1], own):
                    same.append((ids[r], twin[0]))
                else:
                    copies[mark] = (ids[r], own.copy())
                    held += own.nbytes + 200
                    fresh[r] = True
            if same:
                links.append(np.array(same, EDGE))
            if fresh.any():
                pick = np.repeat(fresh, count)
                at = np.append(0, np.cumsum(count[fresh]))
                key, row = tile_keys(sets[pick], at)
                pair = np.zeros(len(key), PAIR)
                pair["key"], pair["doc"] = key, ids[fresh][row]
                pairs.append(pair)
                held += pair.nbytes
        if held >= shards.FLUSH_BYTES:
            yield from flush()
            pairs, links, sizes, copies, held = [], [], [], {}, 0
    yield from flush()


def _met(got):
    _, edges = _hang(shards.joined(got.get(_TILES), PAIR))
    near = np.unique(np.concatenate([edges, shards.joined(got.get(_TILES + 10), EDGE)]))
    for kind, rows in ((_TILES, near), (_LINKS, shards.joined(got.get(_LINKS), EDGE)), (_SIZES, shards.joined(got.get(_SIZES), EDGE))):
        yield words.plain(["kind", "a", "b"], [np.full(len(rows), kind, np.int32), rows["a"], rows["b"]])


# --- exact comparison of a group ----------------------------------------------------------------


def bitmaps(sets: list[np.ndarray], most: int) -> np.ndarray:
    """Parity signatures: two of them differ in at most as many bits as the sets in elements."""
    bits = 512
    while bits < 4 * most:
        bits *= 2
    out = np.zeros((len(sets), bits // 64), np.uint64)
    for i, s in enumerate(sets):
        odd = (np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
        out[i] = np.packbits(odd).view(np.uint64)
    return out


class Group:
    """Sets that may link, with what bounds and decides their overlaps."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        self.sets = sets
        self.maps = bitmaps(sets, int(self.size.max()) * 2 // 19 + 1)

    def partners(self, i: int, among: np.ndarray) -> np.ndarray:
        """Those of ``among`` that link with member i."""
        one, other = self.size[i], self.size[among]
        among = among[(10 * np.minimum(one, other) >= 9 * np.maximum(one, other))]
        if len(among):
            apart = np.bitwise_count(self.maps[among] ^ self.maps[i]).sum(1)
            among = among[19 * apart.astype(np.int64) <= one + self.size[among]]
        if not len(among):
            return among
        mine, out = self.sets[i], []
        for a in range(0, len(among), 512):
            part = among[a : a + 512]
            every = np.concatenate([self.sets[j] for j in part])
            found = mine[np.minimum(np.searchsorted(mine, every), len(mine) - 1)] == every
            both = np.add.reduceat(found.astype(np.int64), np.append(0, np.cumsum(self.size[part])[:-1]))
            out.append(part[linked(both, one, self.size[part])])
        return np.concatenate(out)

    def forest(self, some: np.ndarray | None = None) -> list[tuple[int, int]]:
        """Links that connect what is connected. With ``some``, only links with an end among those count."""
        unseen, out = np.arange(len(self.sets)), []
        mine = np.ones(len(self.sets), bool)
        if some is not None:
            mine[:] = False
            mine[some] = True
        while len(unseen):
            queue, unseen = [int(unseen[0])], unseen[1:]
            while queue and len(unseen):
                i = queue.pop()
                near = self.partners(i, unseen if mine[i] else unseen[mine[unseen]])
                out += [(int(j), i) for j in near]
                queue += near.tolist()
                unseen = np.setdiff1d(unseen, near, assume_unique=True)
        return out


def _sets_of(column) -> list[bytes]:
    out = []
    for _, sets, index in shingle_sets(column):
        out += [sets[a:b].tobytes() for a, b in zip(index[:-1], index[1:], strict=True)]
    return out


def _with_sets(batches):
    for b in batches:
        rest = [x for x in b.schema.names if x != "text"]
        yield pa.RecordBatch.from_arrays([*[b.column(x) for x in rest], pa.array(_sets_of(b.column("text")), pa.binary())], [*rest, "shingles"])


def _compare(batches):
    """Links in each tile (key) of rows (tile, doc_id, asks, shingles)."""
    tiles: dict[int, list] = {}
    for b in batches:
        for tile, *row in zip(*(b.column(x).to_pylist() for x in ("tile", "doc_id", "asks", "shingles")), strict=True):
            tiles.setdefault(tile, []).append(row)
    while tiles:
        rows = tiles.popitem()[1]
        unique = {}
        links = []
        for doc, asks, data in rows:
            twin = unique.setdefault(data, [doc, asks])
            twin[1] = twin[1] or asks
            if twin[0] != doc:
                links.append((doc, twin[0]))
        ids = [x for x, _ in unique.values()]
        asks = np.flatnonzero([x for _, x in unique.values()])
        if len(ids) > 1 and len(asks):
            group = Group([np.frombuffer(x, np.uint64) for x in unique])
            links += [(ids[i], ids[j]) for i, j in group.forest(None if len(asks) == len(ids) else asks)]
        if links:
            a, b = np.array(links, np.int64).T
            yield words.plain(["a", "b"], [a, b])


_LINK_SCHEMA = "a long, b long"


def _links(sets: DataFrame, n: int) -> DataFrame:
    """Exact links within tiles; sets: tile, doc_id, asks, shingles."""
    return sets.repartition(n, "tile").mapInArrow(_compare, _LINK_SCHEMA)


def links(table: DataFrame, group_rows: int = GROUP_ROWS) -> tuple[DataFrame, DataFrame]:
    """(sizes: doc_id, n_shingles per row; links: a, b, enough to connect all that link)."""
    docs = shards.documents(table)
    n = shards.shard_count(table.sparkSession)
    met = shards.checkpointed(shards.exchange(docs, _tiles, _met, "kind int, a long, b long"))
    sizes = met.filter(F.col("kind") == _SIZES).select(F.col("a").alias("doc_id"), F.col("b").alias("n_shingles"))
    same = met.filter(F.col("kind") == _LINKS).select("a", "b")
    groups = shards.checkpointed(connected_components(met.filter(F.col("kind") == _TILES).select("a", "b"), small=0))
    # a group weighs its documents, or its shingles where those are many: a task holds group_rows * SHINGLES_A_ROW of them
    size = sizes.groupBy(F.col("doc_id").alias("node")).agg(F.sum("n_shingles").alias("_s"))
    weight = F.greatest(F.count("*"), F.ceil(F.sum("_s") / SHINGLES_A_ROW))
    count = shards.checkpointed(groups.join(size, "node").groupBy("root").agg(weight.alias("n")))
    groups = groups.join(count, "root").withColumnRenamed("node", "doc_id")
    source = docs.join(groups, "doc_id").select("doc_id", "root", "n", "text")
    small = source.filter(F.col("n") <= group_rows).mapInArrow(_with_sets, "doc_id long, root long, n long, shingles binary")
    found = _links(small.select(F.xxhash64("root").alias("tile"), "doc_id", F.lit(True).alias("asks"), "shingles"), n)
    out = same.unionByName(found)
    if not count.filter(F.col("n") > group_rows).isEmpty():
        out = out.unionByName(_large(source.filter(F.col("n") > group_rows), n, group_rows))
    return sizes, out


def _large(source: DataFrame, n: int, group_rows: int) -> DataFrame:
    """Links of the groups that are too large for one task."""
    sets = shards.checkpointed(source.mapInArrow(_with_sets, "doc_id long, root long, n long, shingles binary"))
    blocks = F.ceil(F.col("n") / (group_rows // 2)).cast("int")
    sets = sets.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    hub = sets.filter("doc_id = root").dropDuplicates(["root"])
    hub = hub.select("root", "blocks", F.col("doc_id"), "shingles", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    star = hub.select("root", "block", "doc_id", F.lit(True).alias("asks"), "shingles").unionByName(sets.select("root", "block", "doc_id", F.lit(False).alias("asks"), "shingles"))
    first = shards.checkpointed(_links(star.withColumn("tile", F.xxhash64("root", "block")), n))
    known = connected_components(first, small=0).join(sets.select(F.col("root").alias("hub")).distinct(), F.col("root") == F.col("hub"), "left_semi")
    odd = sets.join(known.select(F.col("node").alias("doc_id")), "doc_id", "left_anti")
    odd = shards.checkpointed(odd.select("root", "block", "blocks", "doc_id", "shingles"))
    if odd.isEmpty():
        return first
    # every member that the smallest one doesn't reach, in blocks, against all members, in blocks
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("against")
    asking = odd.select("root", F.col("block").alias("from"), every, "doc_id", F.lit(True).alias("asks"), "shingles")
    froms = odd.select("root", F.col("block").alias("from")).distinct()
    asked = sets.join(froms, "root").select("root", "from", F.col("block").alias("against"), "doc_id", F.lit(False).alias("asks"), "shingles")
    tiles = asking.unionByName(asked).withColumn("tile", F.xxhash64("root", "from", "against"))
    return first.unionByName(_links(tiles, n))


def components(table: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    sizes, found = links(table, group_rows)
    parts = connected_components(found, small=0).withColumnRenamed("node", "doc_id")
    out = sizes.join(parts, "doc_id", "left")
    return out.select(shards.real_id(), "n_shingles", F.nullif(F.coalesce("root", "doc_id"), F.lit(shards.NO_ID)).alias("component_id"))


def representatives(table: DataFrame) -> DataFrame:
    """One row of each component, that of the smallest doc_id (null last), with all columns; rows without links stay.

    Here every row is a node of its own, whatever its doc_id, so only the rows that are near copies
    go; a row that is repeated as a whole stays once.
    """
    rows, key = shards.with_row_key(table)
    _, found = links(rows.select(F.col(key).alias("doc_id"), "text"))
    parts = shards.checkpointed(connected_components(found, small=0).withColumnRenamed("node", "row"))
    ids = rows.select(F.col(key).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(shards.NO_ID)).alias("id"))
    best = parts.join(ids, "row").groupBy("root").agg(F.min(F.struct("id", "row")).alias("best"))
    return shards.without(rows, key, parts.join(best.select("best.row"), "row", "left_anti").select(F.col("row").alias("gone")))
