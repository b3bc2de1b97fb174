"""Accounts as a stream: each micro-batch is one run of the raw ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinweave.config import Config
from kinweave.functions import text
from kinweave.sources import io


def ingest(accounts: DataFrame, base: str, cfg: Config, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends account_id, account_name (and metadata) of a streaming frame to accounts_raw.

    A micro-batch writes the partition of its own run_id and replaces it, so a batch that is repeated
    after a failure leaves the ledger as if it had come once. Late rows belong to a later run; the
    cumulative mapping applies to them as to any other.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.withColumns({"normalized_name": text.normalize_name(F.col("account_name")), "run_id": F.lit(f"{cfg.run_id}-{number:06d}")})
        io.append(rows, base, "accounts_raw", cfg.metadata_columns)

    out = accounts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()


def current_accounts(raw: DataFrame) -> DataFrame:
    """The last row of each account over all runs."""
    return io.latest(raw, ["account_id"], F.col("run_id"))
