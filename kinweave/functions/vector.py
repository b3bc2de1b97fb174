"""Cosines: as an expression for given pairs, and by tiles of matrix products for all pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.operators.graph import checkpointed


def cosine(a: Column, b: Column) -> Column:
    """Over the shorter length; a zero norm counts as 1, and a null or empty side gives 0."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a.cast("array<double>"), 1, n), F.slice(b.cast("array<double>"), 1, n)

    def total(c: Column) -> Column:
        return F.aggregate(c, F.lit(0.0), lambda s, v: s + v)

    def norm(c: Column) -> Column:
        s = F.sqrt(total(F.transform(c, lambda v: v * v)))
        return F.when(s == 0, F.lit(1.0)).otherwise(s)

    dot = total(F.zip_with(x, y, lambda u, v: u * v))
    return F.when(a.isNull() | b.isNull() | (n <= 0), F.lit(0.0)).otherwise(dot / (norm(x) * norm(y)))


def all_pairs(vectors: DataFrame, tile_rows: int = 2048, least: float | None = None, rows: int | None = None, without: DataFrame | None = None) -> DataFrame:
    """(a_id, b_id, score) for all a_id < b_id of (id string, embedding), or those of at least ``least``; not the pairs of ``without`` (a_id, b_id).

    Rows are dealt into blocks, a row each, and every pair of blocks is a tile. No row is copied to disk for its
    tiles: tasks read the blocks that they pair, no side is broadcast, and the pairs aren't shuffled, as the pairs of ``without``
    travel with their blocks. Vectors of unequal length are compared over the shorter one.
    """

    def compare(one: _Block, two: _Block, same: bool, gone: list) -> Iterator[pa.RecordBatch]:
        score = _scores(one, two)
        pool, x, y = _places(one.ids, two.ids)
        keep = x[:, None] < y[None, :] if same else x[:, None] != y[None, :]
        if least is not None:
            keep &= score >= least
        if gone:
            at = [pc.index_in(pa.concat_arrays([g[c] for g in gone]), pool) for c in (0, 1)]
            here = pc.and_(at[0].is_valid(), at[1].is_valid())
            low, high = (c.filter(here).to_numpy(zero_copy_only=False).astype(np.int64) for c in at)
            row, column = np.full(len(pool), -1), np.full(len(pool), -1)
            row[x], column[y] = np.arange(len(x)), np.arange(len(y))
            for i, j in ((row[low], column[high]), (row[high], column[low])):
                keep[i[(i >= 0) & (j >= 0)], j[(i >= 0) & (j >= 0)]] = False
        yield from _told(pool, x, y, score, keep)

    return _tiled(vectors, tile_rows, rows, compare, _PAIRS, without)


def band_counts(vectors: DataFrame, edges: Sequence[float], tile_rows: int = 2048, rows: int | None = None) -> DataFrame:
    """(band, n): how many pairs score at least 0, 1, .. of the ascending edges; a tile sends a row a band, no pairs."""

    def compare(one: _Block, two: _Block, same: bool, gone: list) -> Iterator[pa.RecordBatch]:
        score = _scores(one, two)
        _, x, y = _places(one.ids, two.ids)
        band = np.searchsorted(np.array(edges, float), score[x[:, None] < y[None, :] if same else x[:, None] != y[None, :]], side="right")
        n = np.bincount(band, minlength=len(edges) + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n)), pa.int32()), pa.array(n, pa.int64())], ["band", "n"])

    return _tiled(vectors, tile_rows, rows, compare, "band int, n long").groupBy("band").agg(F.sum("n").alias("n")).filter("n > 0")


def cross_pairs(some: DataFrame, every: DataFrame, tile_rows: int = 2048, least: float | None = None, counts: tuple[int, int] | None = None) -> DataFrame:
    """(a_id, b_id, score), a_id < b_id, of all pairs of which one id at least is in ``some``; every holds those of some too.

    Only the product of some with every is computed, in tiles of a block of either.
    """
    n, m = counts or (some.count(), every.count())
    asked = every.join(some.select("id", F.lit(True).alias("chosen")).distinct(), "id", "left")
    left = _blocks(some.withColumn("chosen", F.lit(True)), -(-n // tile_rows))
    right = _blocks(asked.withColumn("chosen", F.coalesce("chosen", F.lit(False))), -(-m // tile_rows))

    def compare(one: _Block, two: _Block, same: bool, gone: list) -> Iterator[pa.RecordBatch]:
        pool, x, y = _places(one.ids, two.ids)
        score = _scores(one, two)
        # a pair of two chosen ids is met from both sides and taken from the smaller one
        keep = (x[:, None] != y[None, :]) & (~two.chosen[None, :] | (x[:, None] < y[None, :]))
        yield from _told(pool, x, y, score, keep if least is None else keep & (score >= least))

    return _met(left, right, F.lit(True), compare, _PAIRS)


_PAIRS = "a_id string, b_id string, score double"
_BLOCK = "block int, ids array<string>, sizes binary, wide int, numbers binary, chosen binary, gone array<struct<own:int,a:array<string>,b:array<string>>>"
#: Blocks are dealt into so many partitions at most; every pair of partitions is a task.
_DEALT = 64
#: Columns of a tile to an Arrow batch.
_STRIP = 64


@dataclass
class _Block:
    ids: pa.Array
    sizes: np.ndarray
    numbers: np.ndarray  # the vectors' components, one vector after the other
    chosen: np.ndarray

    @classmethod
    def of(cls, ids: pa.Array, sizes: bytes, wide: int, numbers: bytes, chosen: bytes) -> _Block:
        return cls(ids, np.frombuffer(sizes, "<i4"), np.frombuffer(numbers, f"<f{wide}"), np.frombuffer(chosen, bool))


def _places(one: pa.Array, two: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(the distinct ids in order, the place of each of one's ids among them, and of two's)."""
    named = pa.concat_arrays([one, two]).dictionary_encode()
    order = pc.sort_indices(named.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    at = place[named.indices.to_numpy()]
    return named.dictionary.take(pa.array(order)), at[: len(one)], at[len(one) :]


def _told(pool: pa.Array, x: np.ndarray, y: np.ndarray, score: np.ndarray, keep: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The kept pairs, a strip of some columns of the tile to a batch, row by row: an id comes again after few pairs, so that files of them stay small."""
    for at in range(0, len(y), _STRIP):
        u, v = x[:, None], y[at : at + _STRIP]
        here = np.flatnonzero(keep[:, at : at + _STRIP])
        if len(here):
            low, high, told = (c.ravel()[here] for c in (np.minimum(u, v), np.maximum(u, v), score[:, at : at + _STRIP]))
            yield pa.RecordBatch.from_arrays([pool.take(pa.array(low)), pool.take(pa.array(high)), pa.array(told)], ["a_id", "b_id", "score"])


def _block_of(c: Column | str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")


def _blocks(vectors: DataFrame, blocks: int, without: DataFrame | None = None) -> DataFrame:
    """The vectors (id, embedding, chosen) as a row for each block, checkpointed; rows without an id take no part, nor do an id's later rows in a block, whose ids are in order.

    The pairs of ``without`` go with the larger block of their tile, by the smaller one.
    """
    blocks = max(1, blocks)
    kept = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    source = vectors.filter(F.col("id").isNotNull()).select(
        _block_of("id", blocks).alias("block"), "id", F.col("embedding").cast(kept).alias("embedding"), "chosen", F.lit(None).cast("int").alias("own"), F.lit(None).cast("string").alias("b")
    )
    if without is not None:
        ends = [_block_of(c, blocks) for c in ("a_id", "b_id")]
        pairs = without.select(F.greatest(*ends).alias("block"), F.col("a_id").alias("id"), F.lit(None).cast(kept).alias("embedding"), F.lit(False).alias("chosen"), F.least(*ends).alias("own"), "b_id")
        source = source.unionByName(pairs.withColumnRenamed("b_id", "b").dropna(subset=["id", "b"]))
    dealt = min(blocks, _DEALT)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.Table]] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for b in pc.unique(batch.column("block")).to_pylist():
                held.setdefault(b, []).append(table.filter(pc.equal(table["block"], b)))
        for b, parts in held.items():
            table = pa.concat_tables(parts)
            pairs, table = table.filter(pc.is_valid(table["own"])), table.filter(pc.is_null(table["own"]))
            gone = [{"own": o, "a": (own := pairs.filter(pc.equal(pairs["own"], o)))["id"].to_pylist(), "b": own["b"].to_pylist()} for o in pc.unique(pairs["own"]).to_pylist()]
            named = table["id"].combine_chunks().dictionary_encode()
            table = table.take(pa.array(np.unique(named.indices.to_numpy(), return_index=True)[1])).sort_by("id")
            embedding = table["embedding"].combine_chunks()
            sizes = pc.fill_null(pc.list_value_length(embedding), 0).to_numpy().astype("<i4")
            numbers = embedding.flatten().to_numpy(zero_copy_only=False)
            numbers = numbers.astype("<f4" if numbers.dtype == np.float32 else "<f8")
            chosen = table["chosen"].combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
            row = {"block": b, "ids": table["id"].to_pylist(), "sizes": sizes.tobytes(), "wide": numbers.dtype.itemsize, "numbers": numbers.tobytes(), "chosen": chosen.tobytes(), "gone": gone}
            yield pa.RecordBatch.from_pylist([row], _PACKED)

    packed = source.repartitionById(dealt, F.col("block") % dealt).mapInArrow(pack, _BLOCK)
    return checkpointed(packed)


_PACKED = pa.schema(
    [
        ("block", pa.int32()), ("ids", pa.list_(pa.string())), ("sizes", pa.binary()), ("wide", pa.int32()), ("numbers", pa.binary()), ("chosen", pa.binary()),
        ("gone", pa.list_(pa.struct([("own", pa.int32()), ("a", pa.list_(pa.string())), ("b", pa.list_(pa.string()))]))),
    ]
)
_SIDE = ("ids", "sizes", "wide", "numbers", "chosen")


def _met(left: DataFrame, right: DataFrame, which: Column, compare: Callable, schema: str) -> DataFrame:
    """compare(one block, another, whether they have one number, pairs to leave out) for all blocks of left and right that meet ``which`` (own, other)."""
    one = left.select(F.col("block").alias("own"), *[F.col(c).alias(f"{c}_") for c in _SIDE])
    two = right.select(F.col("block").alias("other"), *_SIDE, "gone")
    both = one.join(two.hint("shuffle_replicate_nl"), which)
    both = both.withColumn("gone", F.filter("gone", lambda g: g["own"] == F.col("own")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1)

                def side(end: str, row=row) -> _Block:
                    ids, *rest = (row.column(f"{c}{end}") for c in _SIDE)
                    return _Block.of(ids.flatten(), *(c[0].as_py() for c in rest))

                gone = row.column("gone")[0].values
                pairs = [(g["a"].values, g["b"].values) for g in gone] if gone is not None else []
                yield from compare(side("_"), side(""), row.column("own")[0] == row.column("other")[0], pairs)

    return both.mapInArrow(run, schema)


def _tiled(vectors: DataFrame, tile_rows: int, rows: int | None, compare: Callable, schema: str, without: DataFrame | None = None) -> DataFrame:
    """compare for every pair of blocks, a block with itself too."""
    n = vectors.count() if rows is None else rows
    packed = _blocks(vectors.withColumn("chosen", F.lit(False)), -(-n // tile_rows), without)
    return _met(packed, packed, F.col("own") <= F.col("other"), compare, schema)


def _scores(a: _Block, b: _Block) -> np.ndarray:
    """Cosines of all pairs over the shorter length: one matrix product for each pair of lengths."""
    shape = (len(a.sizes), len(b.sizes))
    a, b = (_by_length(x) for x in (a, b))
    out = np.zeros(shape)
    for p, (i, x) in a.items():
        for q, (j, y) in b.items():
            n = min(p, q)
            if n:
                product = _unit(x[:, :n]) @ _unit(y[:, :n]).T
                if product.shape == shape:
                    return product
                out[np.ix_(i, j)] = product
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(1))
    norm[norm == 0] = 1
    return x / norm[:, None]


def _by_length(block: _Block) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """length -> (places, matrix); a null vector has length 0."""
    start = np.cumsum(block.sizes, dtype=np.int64) - block.sizes
    return {int(n): (at := np.flatnonzero(block.sizes == n), block.numbers[start[at][:, None] + np.arange(n)].astype(float)) for n in np.unique(block.sizes)}
