"""Mixing sources to target weights.

Every document gets a hash-random key; within each source the documents are sorted by ranges of that
key, token counts are summed along the order by a distributed prefix sum, and the order is cut where
the source's budget is used up. A budget above the source's size repeats the whole source as often
as it fits (an epoch) and cuts the last one.

Sources in code point order, null last, weigh ``weights`` in turn. All sources share the sum of all
sizes; a target stops at ``most`` times its source's size and the excess is shared again by weight
among the others, until none is above. A document's size is its number of words; null texts have
none. The document at the cut gives only the words that are missing, so each source meets its
budget, its target rounded to a whole number.

Rows that repeat a doc_id, or have none, are separate documents. An empty table gives an empty
result; other columns are ignored. Keys are hashes of the seed, the doc_id and the text alone, so reruns
agree whatever the partitioning.

The sources' totals are one row a source. Documents never gather by source: a bucket of the key
range holds about ``bucket_rows`` of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shards, words

WEIGHTS = (5, 2, 1)
MOST = 3
BUCKET_ROWS = 2048
ROOM = 4096


def _sizes(batches):
    for batch in batches:
        out = []
        data, offsets = words.text_buffer(batch.column("text"))
        for i, j in words.blocks(offsets):
            _, _, index = words.word_bounds(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            out.append(np.diff(index))
        size = np.concatenate(out) if out else np.zeros(0, np.int64)
        rest = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(size, pa.int64())], [*rest, "size"])


def sizes(table: DataFrame, row: str | None = None, seed: str = "mix") -> DataFrame:
    """doc_id, source, key, row (the named column, or null) and size of every row."""
    text = F.col("text").cast("string")
    # the text too, as a doc_id may be null or stand for many rows, which then fall all over the key's range
    key = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null")), F.sha2(F.coalesce(text, F.lit("")), 256))
    own = (F.lit(None) if row is None else F.col(row)).cast("long").alias("row")
    docs = table.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.sha2(key, 256).alias("key"), own, text.alias("text"))
    return docs.mapInArrow(_sizes, "doc_id long, source string, key string, row long, size long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, n, source_size, target (double), budget (long): one row a source."""
    totals = sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    totals = shards.checkpointed(totals.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * most))
    rest, share, full = totals.agg(F.sum("source_size"), F.sum("weight"), F.lit(-1)).first()
    whole, rest, share = rest or 0, rest or 0, share or 1

    def over(rest: int, share: int) -> Column:
        return F.col("weight") * F.lit(rest).cast("decimal(38,0)") > F.col("cap") * F.lit(share).cast("decimal(38,0)")

    while True:  # each round closes at least one source or is the last; a round is one aggregate row
        capped = over(rest, share)
        n, taken, open_share = totals.agg(F.count_if(capped), F.sum(F.when(capped, F.col("cap"))), F.sum(F.when(~capped, F.col("weight")))).first()
        if n == full or open_share is None:
            break
        full, rest, share = n, whole - (taken or 0), open_share
    even = F.col("weight").cast("double") * F.lit(float(rest)) / F.lit(float(share))
    target = F.when(over(rest, share), F.col("cap").cast("double")).otherwise(F.least(even, F.col("cap").cast("double")))
    return totals.withColumn("target", target).withColumn("budget", F.floor(F.col("target") + 0.5)).drop("weight", "cap")


def _mixed(sized: DataFrame, weights: tuple[int, ...], most: int, bucket_rows: int) -> DataFrame:
    plan = shards.checkpointed(targets(sized, weights, most).withColumn("buckets", F.ceil(F.col("n") / bucket_rows)))
    part = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    keyed = sized.join(plan.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    keyed = keyed.withColumn("bucket", F.floor(part * F.col("buckets") / F.lit(float(1 << 32))))
    # prefix sums in three levels, so that no task holds more than ROOM buckets, or runs of them, of a source
    sums = shards.checkpointed(keyed.groupBy("source", "bucket").agg(F.sum("size").alias("own")).withColumn("run", F.floor(F.col("bucket") / ROOM)))
    runs = sums.groupBy("source", "run").agg(F.sum("own").alias("own_run"))
    before = lambda c, *by: F.coalesce(F.sum(c).over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(F.col("source").alias("_source"), F.col("run").alias("_run"), before("own_run", "source", "run").alias("before_run"))
    sums = sums.join(runs, F.col("source").eqNullSafe(F.col("_source")) & (F.col("run") == F.col("_run"))).drop("_source", "_run")
    sums = sums.withColumn("before_bucket", F.col("before_run") + before("own", "source", "run", "bucket")).select(F.col("source").alias("_source"), F.col("bucket").alias("_bucket"), "before_bucket")
    keyed = keyed.join(sums, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket")))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before_bucket") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0)
    last = F.col("budget") - F.col("epochs") * F.col("source_size")
    keyed = keyed.withColumn("epochs", epochs).withColumn("_before", start)
    taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(last - F.col("_before"), F.col("size")))
    return keyed.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "source", "row")


def mix(table: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = "mix", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, size, source_size, target, taken and source of every row."""
    return _mixed(shards.checkpointed(sizes(table, None, seed)), weights, most, bucket_rows).drop("row")


def mixed_documents(table: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = "mix") -> DataFrame:
    """The rows of the table of which the mix takes any words, with all its columns; a document taken k times stands k times.

    A document's repeats are its taken words over its size, rounded up, so one cut within the
    document stands whole. Documents without words weigh nothing and stay once. Rows are told apart by
    all that they hold, not by their doc_id; rows that are the same as a whole share the largest of their repeats.
    """
    rows, key = shards.with_row_key(table)
    times = shards.fresh(rows, "_times")
    out = _mixed(shards.checkpointed(sizes(rows, key, seed)), weights, most, BUCKET_ROWS)
    repeats = F.when(F.col("size") == 0, 1).otherwise(F.ceil(F.col("taken") / F.col("size"))).cast("int")
    plan = out.groupBy(F.col("row").alias(key)).agg(F.max(repeats).alias(times)).filter(F.col(times) > 0)
    kept = rows.join(plan, key).withColumn(times, F.sequence(F.lit(1), F.col(times)))
    return kept.select(*[F.col(shards.quoted(c)) for c in table.columns], F.explode(times).alias(key)).drop(key)
