"""Exact deduplication by composable polynomial fingerprints.

Texts are equal when identical after deleting ``[\\x20\\x09-\\x0D]``. The normalised bytes b0..bn-1 have
the fingerprint sum(b_i * 256**(n-1-i)) mod P for a 128-bit prime P. Fingerprints compose: that of a
concatenation is ``left * 256**len(right) + right``, so the chunks of a huge text are hashed in
parallel, each by its own task, and combined by length-shifted arithmetic.

Equal fingerprints of equal length are then compared byte by byte, chunk after chunk: a buffer
compares its own copies with one another and sends on a single one of each, and those meet again by
(group, chunk number). So a group of copies of any size costs one text per buffer. A group in which
the texts differ is split by their digests.

Of equal texts the row with the most code points, then the smallest doc_id, stays. Null texts are
empty. Rows that repeat a doc_id stand in the result as often; a null doc_id sorts last and is
returned as null. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shards, words

CHUNK_BYTES = 1 << 16
HUGE_CHARS = 4 << 20
_BUFFER_BYTES = 64 << 20


@lru_cache
def prime(seed: str = "exact dedup", bits: int = 128) -> int:
    """The first probable prime from a point that the seed names; not of a special form."""
    n = int.from_bytes(hashlib.sha256(seed.encode()).digest(), "big") >> (256 - bits) | 1 | 1 << (bits - 1)
    while any(pow(a, n - 1, n) != 1 for a in (2, 3, 5, 7, 11, 13, 17, 19)):
        n += 2
    return n


@lru_cache(maxsize=4096)
def _shift(length: int, modulus: int) -> int:
    return pow(256, length, modulus)


def combine(left: tuple[int, int], right: tuple[int, int], modulus: int) -> tuple[int, int]:
    """(fingerprint, length) of a concatenation."""
    return (left[0] * _shift(right[1], modulus) + right[0]) % modulus, left[1] + right[1]


def fingerprint(data: bytes, modulus: int, chunk: int = CHUNK_BYTES) -> tuple[int, int]:
    out = (0, 0)
    for i in range(0, len(data), chunk):
        part = data[i : i + chunk]
        out = combine(out, (int.from_bytes(part, "big") % modulus, len(part)), modulus)
    return out


def normalised(text: str | None) -> bytes:
    return (text or "").encode().translate(None, words.SPACE)


def _prints(modulus: int):
    names = ["doc_id", "hash", "fingerprint", "n_bytes", "n_chars", "text_sha256"]

    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            data = [normalised(t) for t in texts.to_pylist()]
            found = [fingerprint(d, modulus) for d in data]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("hash"),
                    pa.array([x.to_bytes(16, "big") for x, _ in found], pa.binary()),
                    pa.array([n for _, n in found], pa.int64()),
                    pc.fill_null(pc.utf8_length(texts), 0).cast(pa.int64()),
                    pa.array([hashlib.sha256(d).hexdigest() for d in data], pa.string()),
                ],
                names,
            )

    return run


_PRINTS = "doc_id long, hash long, fingerprint binary, n_bytes long, n_chars long, text_sha256 string"


def _chunk_prints(modulus: int):
    def run(batches):
        for batch in batches:
            found = [fingerprint(normalised(t), modulus) for t in batch.column("part").to_pylist()]
            rest = [x for x in batch.schema.names if x != "part"]
            yield words.plain([*rest, "fingerprint", "n_bytes"], [*(batch.column(x) for x in rest), pa.array([x.to_bytes(16, "big") for x, _ in found], pa.binary()), pa.array([n for _, n in found], pa.int64())])

    return run


def _combined(modulus: int):
    def run(key: tuple[pa.Scalar, ...], chunks: pa.Table) -> pa.Table:
        parts, out = {}, (0, 0)
        for number, x, n in zip(chunks["chunk"].to_pylist(), chunks["fingerprint"].to_pylist(), chunks["n_bytes"].to_pylist(), strict=True):
            parts[number] = (int.from_bytes(x, "big"), n)
        for number in sorted(parts):
            out = combine(out, parts[number], modulus)
        row = {"doc_id": key[0], "hash": chunks["hash"][0], "fingerprint": pa.scalar(out[0].to_bytes(16, "big"), pa.binary()), "n_bytes": pa.scalar(out[1], pa.int64()), "n_chars": chunks["n_chars"][0], "text_sha256": chunks["text_sha256"][0]}
        same = len(chunks) // len(parts)  # rows that repeat doc_id and text
        return pa.table({k: pa.repeat(v, same) for k, v in row.items()})

    return run


def _hash():
    return F.xxhash64(F.col("text").cast("string")).alias("hash")


def fingerprints(table: DataFrame, modulus: int | None = None, huge_chars: int = HUGE_CHARS) -> DataFrame:
    """doc_id, hash of the text as it is, fingerprint, n_bytes, n_chars and SHA-256 of every row; texts over huge_chars are hashed chunk by chunk in parallel."""
    modulus = modulus or prime()
    docs = shards.documents(table, _hash())
    long = F.coalesce(F.length("text") > huge_chars, F.lit(False))
    usual = docs.filter(~long).mapInArrow(_prints(modulus), _PRINTS)
    n = F.ceil(F.length("text") / huge_chars).cast("int")
    huge = docs.filter(long).select("doc_id", "hash", F.sha2("text", 256).alias("mark"), F.length("text").cast("long").alias("n_chars"), _sha().alias("text_sha256"), "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk"))
    part = F.substring("text", F.col("chunk") * huge_chars + 1, F.lit(huge_chars)).alias("part")
    chunks = huge.select("doc_id", "hash", "mark", "n_chars", "text_sha256", "chunk", part).repartition("mark", "chunk")
    chunks = chunks.mapInArrow(_chunk_prints(modulus), "doc_id long, hash long, mark string, n_chars long, text_sha256 string, chunk int, fingerprint binary, n_bytes long")
    return usual.unionByName(chunks.groupBy("doc_id", "mark").applyInArrow(_combined(modulus), _PRINTS))


def _pieces(batches, chunk: int):
    """Compares the copies inside a buffer and passes on one text of each group, in chunks."""

    def flush(held):
        for group, (doc, data) in held.items():
            parts = range(0, max(1, len(data)), chunk)
            yield words.plain(
                ["group", "chunk", "doc_id", "data"],
                [pa.array([group] * len(parts), pa.binary()), pa.array(range(len(parts)), pa.int32()), pa.array([doc] * len(parts), pa.int64()), pa.array([data[i : i + chunk] for i in parts], pa.binary())],
            )

    held, size = {}, 0
    for batch in batches:
        for doc, text, group in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data = normalised(text)
            if group not in held:
                held[group] = (doc, data)
                size += len(data)
            elif held[group][1] != data:  # a second text under one fingerprint: chunk -1 tells of it
                yield words.plain(["group", "chunk", "doc_id", "data"], [pa.array([group], pa.binary()), pa.array([-1], pa.int32()), pa.array([doc], pa.int64()), pa.array([b""], pa.binary())])
        if size >= _BUFFER_BYTES:
            yield from flush(held)
            held, size = {}, 0
    yield from flush(held)


def _unequal(batches):
    """Streams chunks in order of group and number; a group whose chunks of one number differ is returned."""
    last, first, odd = None, b"", set()
    for batch in batches:
        for group, number, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (group, number) != last:
                last, first = (group, number), data
            if number < 0 or data != first:
                odd.add(group)
    yield words.plain(["group"], [pa.array(sorted(odd), pa.binary())])


def _sha(text: str = "text"):
    return F.sha2(F.translate(F.coalesce(F.col(text), F.lit("")), " \t\n\x0b\x0c\r", "").cast("binary"), 256)


def collisions(table: DataFrame, members: DataFrame, chunk: int = CHUNK_BYTES) -> DataFrame:
    """The groups (fingerprint, length) of members whose texts aren't all equal; members: doc_id, hash, group, each once."""
    # a row meets its own group by doc_id and text, as a doc_id may be null or stand for several texts
    copies = shards.documents(table, _hash()).join(members, ["doc_id", "hash"]).select("doc_id", "text", "group")
    parts = copies.mapInArrow(lambda b: _pieces(b, chunk), "group binary, chunk int, doc_id long, data binary")
    n = shards.shard_count(table.sparkSession)
    parts = parts.select("group", "chunk", "data").repartition(n, "group", "chunk").sortWithinPartitions("group", "chunk")
    return parts.mapInArrow(_unequal, "group binary").distinct()


def _best(found: DataFrame) -> DataFrame:
    first = F.min(F.struct((-F.col("n_chars")).alias("less"), "doc_id")).alias("best")
    return found.groupBy("group").agg(first, F.count("*").alias("group_size"))


def dedup(table: DataFrame, modulus: int | None = None, huge_chars: int = HUGE_CHARS, chunk: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    found = shards.checkpointed(fingerprints(table, modulus, huge_chars).withColumn("group", F.concat("fingerprint", F.col("n_bytes").cast("string").cast("binary"))))
    # both sides of the joins on a group are plain scans, so that AQE can split a group of many copies
    best = shards.checkpointed(_best(found))
    members = found.select("doc_id", "hash", "group").distinct().join(best.filter("group_size > 1"), "group").select("doc_id", "hash", "group")
    odd = shards.checkpointed(collisions(table, members, chunk))
    if not odd.isEmpty():
        odd = odd.withColumn("odd", F.lit(True))
        found = found.join(odd, "group", "left").withColumn("group", F.when(F.col("odd"), F.concat("group", F.col("text_sha256").cast("binary"))).otherwise(F.col("group")))
        best = shards.checkpointed(_best(found))
    out = found.join(best, "group").select(
        shards.real_id(),
        F.nullif(F.col("best.doc_id"), F.lit(shards.NO_ID)).alias("keep_id"),
        "group_size",
        (F.col("doc_id") == F.col("best.doc_id")).alias("kept"),
        "text_sha256",
    )
    return out


def kept_documents(table: DataFrame) -> DataFrame:
    """One row of each group of equal texts, with all columns: that of the most code points, then the smallest doc_id (null last).

    Rows are told apart by all that they hold, not by their doc_id; a row that is repeated as a whole stays once.
    """
    rows, key = shards.with_row_key(table)
    found = dedup(rows.select(F.col(key).alias("doc_id"), "text"))
    groups = shards.checkpointed(found.filter("group_size > 1").select(F.col("doc_id").alias("row"), "keep_id").distinct())
    ids = rows.select(F.col(key).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(shards.NO_ID)).alias("id"), (-F.coalesce(F.length(F.col("text").cast("string")), F.lit(0))).alias("less"))
    best = groups.join(ids, "row").groupBy("keep_id").agg(F.min(F.struct("less", "id", "row")).alias("best"))
    return shards.without(rows, key, groups.join(best.select("best.row"), "row", "left_anti").select(F.col("row").alias("gone")))
