"""Shuffles of packed records.

Millions of small fixed-width records are cheaper to move as a few byte strings than as rows. A map
side packs numpy records by destination shard, the shuffle carries one row per (buffer, shard), and
the reduce side sees all records of its shards. Shards come from hashes of keys, so they are even;
the callers contract repeated keys inside a buffer before sending, so that a hot key costs at most
one record per buffer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.operators.graph import checkpointed as checkpointed

FLUSH_BYTES = 48 << 20
_PACKED = "shard int, kind int, data binary"


def shard_count(spark: SparkSession) -> int:
    """As many shards as the session's shuffles have partitions: the deployer sizes both together."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shard_of(key: np.ndarray, n: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int32)


def pack(records: np.ndarray, shard: np.ndarray, kind: int, n: int) -> Iterator[pa.RecordBatch]:
    """One row per shard that has records; shard numbers must be below n."""
    if not len(records):
        return
    order = np.argsort(shard, kind="stable")
    records = records[order]
    edge = np.searchsorted(shard[order], np.arange(n + 1))
    have = np.flatnonzero(np.diff(edge))
    data = [records[edge[s] : edge[s + 1]].tobytes() for s in have]
    yield pa.RecordBatch.from_arrays(
        [pa.array(have.astype(np.int32)), pa.array(np.full(len(have), kind, np.int32)), pa.array(data, pa.binary())],
        ["shard", "kind", "data"],
    )


def exchange(
    source: DataFrame,
    mapper: Callable[[Iterator[pa.RecordBatch], int], Iterator[pa.RecordBatch]],
    reducer: Callable[[dict[int, list[bytes]]], Iterator[pa.RecordBatch]],
    schema: str,
) -> DataFrame:
    """mapper packs its batches for n shards; reducer gets {kind: byte strings} of one shard."""
    n = shard_count(source.sparkSession)

    def send(batches):
        return mapper(batches, n)

    def receive(batches):
        got: dict[int, dict[int, list[bytes]]] = {}
        for b in batches:
            for s, k, d in zip(*(c.to_pylist() for c in b.columns), strict=True):
                got.setdefault(s, {}).setdefault(k, []).append(d)
        while got:
            yield from reducer(got.popitem()[1])

    return source.mapInArrow(send, _PACKED).repartitionById(n, F.col("shard")).mapInArrow(receive, schema)


def joined(parts: list[bytes] | None, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(parts or []), kind)


def runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys in sorted arrays."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


#: Stands in for a null doc_id inside the operators, so that it sorts last and joins; never returned.
NO_ID = 2**63 - 1


def documents(df: DataFrame, *more) -> DataFrame:
    """doc_id and text (and more columns, by name or expression), whatever else the table holds."""
    return df.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        *[F.col(c) if isinstance(c, str) else c for c in more],
    )


def real_id(name: str = "doc_id"):
    return F.nullif(F.col(name), F.lit(NO_ID)).alias(name)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def fresh(table: DataFrame, name: str) -> str:
    """A column name that the table doesn't have, in any case of letters."""
    taken = {c.lower() for c in table.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_row_key(table: DataFrame) -> tuple[DataFrame, str]:
    """The table with a 64-bit hash of all that a row holds, and that column's name: rows that share it are the same row again.

    A doc_id may be null or stand for several texts; this names the row whatever its doc_id.
    """
    names = [F.col(quoted(c)) for c, kind in table.dtypes if "map<" not in kind and "variant" not in kind]
    key = fresh(table, "_row")
    return table.withColumn(key, F.xxhash64(*names, *[x.isNull() for x in names])), key


def without(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """One row of each key that isn't in the column ``gone``, without the key."""
    # repeats are combined before the shuffle, and the join finds the rows dealt out as it needs them
    return rows.dropDuplicates([key]).join(gone.withColumnRenamed("gone", key), key, "left_anti").drop(key)
