"""Nearest neighbours with an adaptive dimension scan inside inverted lists.

Vectors are turned by one random orthogonal matrix, after which any leading dimensions estimate a
distance without bias. They go to the list of the nearest of some centroids. A query probes the
nearest lists; in each, partial distances grow column block by column block, for all queries of the list
together, and after each block a hypothesis test drops the pairs whose partial distance already shows, at
``slack`` standard errors, that the whole one exceeds the k-th best so far. The survivors' distances are
then taken exactly, in double precision, on the vectors as they are given.

There are about as many lists as the root of the number of vectors, ``max_lists`` at most. Centroids are fitted
on ``SAMPLE_A_LIST`` vectors a list, ``max_sample`` at most, the first by a hash of their id. On that sample the
share of lists is measured that holds ``recall`` of the true neighbours; that many lists are probed, and more where
those hold few vectors. The first ``MAX_PROBE_SAMPLE`` of the sample travel with the queries: the k-th nearest of
those in the probed lists bounds the distance from the start; within a block the first few vectors tighten it.
Every vector is indexed; of equal vectors in one block only the k + 1 smallest ids are compared, as no other can be
among the k nearest. A list is cut into blocks of about ``block_rows`` by a hash of the id, so a vector
that stands a million times is spread over as many blocks as it needs. A query's vector goes once to each
task that holds any block of its lists.

A query of which the tests left fewer than k candidates is searched again in all lists without tests, so each
gets k neighbours, or all candidates if there are fewer.

Vectors that are null, zero, of another length than most, or that hold null or non-finite numbers
take no part, and neither do rows with a null vec_id. Rows that repeat a vec_id count as one
candidate, at its smallest distance; a query never finds its own vec_id. Ties go to the smaller
vec_id. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shards, words

MAX_SAMPLE = 65_536
SAMPLE_A_LIST = 32
LEAST_SAMPLE = 4096
MAX_PROBE_SAMPLE = 1024
MAX_LISTS = 8192
BLOCK_ROWS = 4096
RECALL = 0.97
SLACK = 2.1
COLUMNS = 8
_PAIRS = 1 << 21  # partial distances in memory at a time
_SCHEMA = "shard int, tile int, data binary, probes binary"
_FOUND = "query_id long, vec_id long, score double"


@dataclass
class Index:
    """What every task needs: sizes are bounded by the parameters, not by the table."""

    dims: int
    turn: np.ndarray
    centroids: np.ndarray  # turned
    sizes: np.ndarray  # vectors a list
    first_tile: np.ndarray  # tiles before each list; one more at the end
    sample_ids: np.ndarray
    sample: np.ndarray
    sample_list: np.ndarray
    probe_share: float


def usable(ids, column, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(vec_id, matrix) of the rows that take part."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    values = column.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    right = size == dims
    rows = values[np.repeat(right, size)].reshape(-1, dims) if dims else np.zeros((0, 0))
    good = np.isfinite(rows).all(1) & (rows != 0).any(1)
    known = ids.is_valid().to_numpy(zero_copy_only=False)[right]
    name = ids.fill_null(0).to_numpy(zero_copy_only=False)[right]
    return name[good & known], rows[good & known]


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids**2).sum(1) - 2 * x @ centroids.T).argmin(1)


def _lists(x: np.ndarray, n: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centroids by Lloyd's rounds from distinct vectors of the sample."""
    x = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[: max(1, n)]].copy()
    for _ in range(rounds):
        at = _nearest(x, c)
        count = np.bincount(at, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c[count > 0] = total[count > 0] / count[count > 0, None]
    return c


def _share(x: np.ndarray, centroids: np.ndarray, k: int, recall: float, asked: int = 512) -> float:
    """The share of nearest lists that holds ``recall`` of the true k neighbours of some sample vectors."""
    at, ranks = _nearest(x, centroids), []
    for i in range(min(asked, len(x))):
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        near = np.argsort(d, kind="stable")[: min(k, len(x) - 1)]
        place = np.argsort(np.argsort((centroids**2).sum(1) - 2 * centroids @ x[i], kind="stable"))
        ranks.append(place[at[near]])
    ranks = np.concatenate(ranks) if ranks else np.zeros(0)
    return float((np.quantile(ranks, recall) + 1) / len(centroids)) if len(ranks) else 1.0


def _source(table: DataFrame) -> DataFrame:
    return table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def _fit_for_use(rows: DataFrame) -> DataFrame:
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.dropna().filter(finite & F.exists("embedding", lambda x: x != 0))


def fit(table: DataFrame, max_sample: int = MAX_SAMPLE, max_lists: int = MAX_LISTS, block_rows: int = BLOCK_ROWS, recall: float = RECALL, k: int = 10, seed: int = 7) -> Index | None:
    """None if no vector can take part."""
    rows = _fit_for_use(_source(table))
    dims = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if dims is None:
        return None
    dims, n = dims["d"], dims["n"]
    lists = int(min(max_lists, max(1, np.sqrt(n))))
    most = min(max_sample, max(LEAST_SAMPLE, SAMPLE_A_LIST * lists))
    picked = rows.filter(F.size("embedding") == dims).orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).toArrow()  # bounded by max_sample
    ids, sample = usable(picked["vec_id"].combine_chunks(), picked["embedding"], dims)
    turn = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))[0]
    centroids = _lists(sample @ turn, min(lists, max(1, len(ids) // 8)))

    def count(batches):
        total = np.zeros(len(centroids), np.int64)
        for b in batches:
            _, x = usable(b.column(0), b.column(1), dims)
            total += np.bincount(_nearest(x @ turn, centroids), minlength=len(centroids))
        yield words.plain(["list", "n"], [np.arange(len(total)), total])

    sizes = np.zeros(len(centroids), np.int64)
    for r in _source(table).mapInArrow(count, "list long, n long").groupBy("list").agg(F.sum("n").alias("n")).collect():  # one row a list
        sizes[r["list"]] = r["n"]
    tiles = np.append(0, np.cumsum(-(-sizes // block_rows)))
    first = slice(0, MAX_PROBE_SAMPLE)
    return Index(dims, turn, centroids, sizes, tiles, ids[first], sample[first], _nearest(sample[first] @ turn, centroids), _share(sample @ turn, centroids, k, recall))


def _packed(tile: np.ndarray, n: int, parts: list[np.ndarray]) -> pa.RecordBatch:
    """A row for each tile: its ids and vectors as doubles."""
    order = np.argsort(tile, kind="stable")
    rows = np.column_stack([p[order] for p in parts])
    first = shards.runs(tile[order])
    edge = np.append(first, len(order))
    data = [rows[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
    tile = tile[order][first].astype(np.int32)
    return words.plain(["shard", "tile", "data", "probes"], [tile % n, tile, pa.array(data, pa.binary()), pa.array([None] * len(first), pa.binary())])


def _bits(ids: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(ids, np.int64).view(np.float64)


def _block(index: Index, at: np.ndarray, ids: np.ndarray) -> np.ndarray:
    blocks = np.maximum(index.first_tile[at + 1] - index.first_tile[at], 1).astype(np.uint64)
    return index.first_tile[at] + (words.mix(ids.astype(np.uint64)) % blocks).astype(np.int64)


def _contracted(ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of equal vectors the k + 1 smallest ids: ties go to the smaller id, and a query leaves out one at most."""
    order = np.lexsort((ids, np.unique(np.ascontiguousarray(x).view(f"V{8 * x.shape[1]}").ravel(), return_inverse=True)[1]))
    ids, x = ids[order], x[order]
    first = np.append(True, (x[1:] != x[:-1]).any(1))
    again = ~first & np.append(False, ids[1:] == ids[:-1])
    ids, x, first = ids[~again], x[~again], first[~again]
    start = np.maximum.accumulate(np.where(first, np.arange(len(ids)), 0))
    few = np.arange(len(ids)) - start <= k
    return ids[few], x[few]


def _candidates(index: Index, n: int, k: int):
    def run(batches):
        for b in batches:
            ids, x = usable(b.column(0), b.column(1), index.dims)
            if len(ids):
                ids, x = _contracted(ids, x, k)
                yield _packed(_block(index, _nearest(x @ index.turn, index.centroids), ids).astype(np.int32), n, [_bits(ids), x])

    return run


def _bound(index: Index, own: int, query: np.ndarray, probed: np.ndarray, k: int) -> float:
    """The squared distance of the k-th nearest of the travelling sample in the probed lists, each id once."""
    there = (index.sample_ids != own) & np.isin(index.sample_list, probed)
    ids = index.sample_ids[there]
    if len(ids) < k:
        return np.inf
    d = ((index.sample[there] - query) ** 2).sum(1)
    order = np.argsort(d, kind="stable")
    once = np.sort(np.unique(ids[order], return_index=True)[1])
    return float(d[order][once[k - 1]]) if len(once) >= k else np.inf


def _questions(index: Index, n: int, k: int, probe_share: float, tests: bool):
    def run(batches):
        least = max(1, int(np.ceil(probe_share * len(index.centroids))))
        for b in batches:
            ids, x = usable(b.column(0), b.column(1), index.dims)
            if not len(ids):
                continue
            tiles, rows, bound = [], [], np.full(len(ids), np.inf)
            y = x @ index.turn
            far = (index.centroids**2).sum(1) - 2 * y @ index.centroids.T
            for i in range(len(ids)):
                order = np.argsort(far[i], kind="stable")
                enough = int(np.searchsorted(np.cumsum(index.sizes[order]), 4 * k + 1)) + 1
                probed = order[: max(least, enough)]
                if tests:
                    bound[i] = _bound(index, ids[i], x[i], probed, k)
                for j in probed:
                    tiles.append(np.arange(index.first_tile[j], index.first_tile[j + 1]))
                    rows.append(np.full(len(tiles[-1]), i))
            tile, row = np.concatenate(tiles).astype(np.int64), np.concatenate(rows)
            for shard in np.unique(tile % n):
                here = tile % n == shard
                which, place = np.unique(row[here], return_inverse=True)
                asks = np.column_stack([_bits(ids[which]), bound[which], x[which]])
                probes = np.column_stack([tile[here], place]).astype(np.int32)
                yield words.plain(["shard", "tile", "data", "probes"], [np.array([shard], np.int32), np.array([-1], np.int32), pa.array([asks.tobytes()], pa.binary()), pa.array([probes.tobytes()], pa.binary())])

    return run


class Scan:
    """The candidates of one block in column blocks of the turned space."""

    def __init__(self, index: Index, ids: np.ndarray, given: np.ndarray, slack: float = SLACK):
        self.index, self.slack = index, slack
        self.ids, self.given = ids, given
        turned = self.given @ index.turn
        self.cuts = list(range(0, index.dims, COLUMNS))
        self.columns = [np.ascontiguousarray(turned[:, c : c + COLUMNS]) for c in self.cuts]

    def limit(self, bound: np.ndarray, seen: int) -> np.ndarray:
        """What a partial distance over the first ``seen`` dimensions may come to if the whole one keeps to the bound."""
        share = seen / self.index.dims
        return bound * (share * (1 + self.slack / np.sqrt(seen)) ** 2 if share < 1 else 1 + 1e-9) + 1e-12

    def nearest(self, own: np.ndarray, queries: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the query, vec_id, distance) of at most k candidates each; bound is a squared distance that k others don't exceed."""
        out = []
        step = max(1, _PAIRS // max(1, len(self.ids)))
        for a in range(0, len(own), step):
            cut = slice(a, a + step)
            q, i, d = self._nearest(own[cut], queries[cut], bound[cut].copy(), k)
            out.append((q + a, i, d))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _nearest(self, own, queries, bound, k):
        turned = queries @ self.index.turn
        few = min(8 * k, len(self.ids))
        if few == 8 * k and len(np.unique(self.ids[:few])) == few:  # the first few are measured whole
            d = ((self.given[None, :few] - queries[:, None]) ** 2).sum(2)
            d[self.ids[None, :few] == own[:, None]] = np.inf
            bound = np.minimum(bound, np.partition(d, k - 1, axis=1)[:, k - 1])
        first, ask = self.columns[0], turned[:, : self.columns[0].shape[1]]
        part = (first**2).sum(1)[None, :] + (ask**2).sum(1)[:, None] - 2 * ask @ first.T
        # what rounding takes from a difference of squares is no reason to drop a pair
        slip = 1e-9 * ((ask**2).sum(1)[:, None] + (first**2).sum(1)[None, :])
        stay = (part <= self.limit(bound, first.shape[1])[:, None] + slip) & (self.ids[None, :] != own[:, None])
        q, c = np.nonzero(stay)
        part = np.maximum(part[q, c], 0)
        for at, column in zip(self.cuts[1:], self.columns[1:], strict=True):
            part += ((column[c] - turned[q, at : at + COLUMNS]) ** 2).sum(1)
            keep = part <= self.limit(bound, min(at + COLUMNS, self.index.dims))[q] * (1 + 1e-9)
            q, c, part = q[keep], c[keep], part[keep]
        d = np.sqrt(((self.given[c] - queries[q]) ** 2).sum(1))
        ids = self.ids[c]
        order = np.lexsort((ids, d, q))
        q, ids, d = q[order], ids[order], d[order]
        # each id once, at its smallest distance, and k of them
        seen = np.lexsort((d, ids, q))
        once = np.zeros(len(q), bool)
        once[seen[shards.runs(q[seen], ids[seen])]] = True
        q, ids, d = q[once], ids[once], d[once]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        return q[rank < k], ids[rank < k], d[rank < k]


def _search(index: Index, k: int, slack: float):
    def run(batches):
        tiles: dict[int, list[bytes]] = {}
        asked: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for tile, data, probes in zip(*(b.column(c).to_pylist() for c in ("tile", "data", "probes")), strict=True):
                if tile >= 0:
                    tiles.setdefault(tile, []).append(data)
                    continue
                asks, probe = np.frombuffer(data).reshape(-1, index.dims + 2), np.frombuffer(probes, np.int32).reshape(-1, 2)
                probe = probe[np.argsort(probe[:, 0], kind="stable")]
                first = shards.runs(probe[:, 0])
                for x, y in zip(first, np.append(first[1:], len(probe)), strict=True):
                    asked.setdefault(int(probe[x, 0]), []).append((asks, probe[x:y, 1]))
        for tile, want in asked.items():
            have = tiles.pop(tile, None)
            if not have:
                continue
            rows = np.frombuffer(b"".join(have)).reshape(-1, index.dims + 1)
            scan = Scan(index, *_contracted(np.ascontiguousarray(rows[:, 0]).view(np.int64), rows[:, 1:], k), slack)
            asks = np.concatenate([a[rows] for a, rows in want])
            own = np.ascontiguousarray(asks[:, 0]).view(np.int64)
            q, v, s = scan.nearest(own, asks[:, 2:], asks[:, 1], k)
            yield words.plain(["query_id", "vec_id", "score"], [own[q], v, s])

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(table: DataFrame, queries: DataFrame, k: int = 10, index: Index | None = None, probe_share: float | None = None, slack: float = SLACK) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest that are found for each row of queries."""
    index = index or fit(table, k=k)
    if index is None:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n = shards.shard_count(table.sparkSession)

    def pass_over(asking: DataFrame, share: float, slack_: float, tests: bool) -> DataFrame:
        rows = _source(table).mapInArrow(_candidates(index, n, k), _SCHEMA)
        rows = rows.unionByName(asking.mapInArrow(_questions(index, n, k, share, tests), _SCHEMA))
        return rows.repartitionById(n, F.col("shard")).mapInArrow(_search(index, k, slack_), _FOUND)

    asking = _source(queries)
    found = shards.checkpointed(_ranked(pass_over(asking, probe_share or index.probe_share, slack, True), k))
    have = found.groupBy("query_id").agg(F.count("*").alias("_n"))
    wanted = asking.filter(F.size("embedding") == index.dims).transform(_fit_for_use)
    short = wanted.join(have, F.col("vec_id") == F.col("query_id"), "left").filter(F.coalesce("_n", F.lit(0)) < k).select("vec_id", "embedding")
    short = shards.checkpointed(short)
    if short.isEmpty():
        return found
    again = _ranked(pass_over(short, 1.0, np.inf, False), k)
    return found.join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(again)


def hundredth(vec_id: str = "vec_id") -> Column:
    return F.col(vec_id) % 100 == 0
