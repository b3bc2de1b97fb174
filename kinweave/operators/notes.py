"""Reviewer notes and the guidance that is rendered from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.sources import io

GLOBAL, FOCAL = "GLOBAL", "FOCAL"


def store(old: DataFrame, new: DataFrame, *order: Column) -> DataFrame:
    """Notes by (scope, focal_master_id, note), the last one of each; a leading ! and blanks around are dropped, empty notes left out."""
    clean = F.trim(F.regexp_replace(F.trim("note"), "^!", ""))
    rows = new.withColumn("note", clean).filter("note <> ''")
    return io.upsert(old, rows, ["scope", "focal_master_id", "note"], *order)


def _joined(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    parts = F.sort_array(F.collect_list(F.struct(*order, "note")))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["note"]), " | ").alias("guidance"))


def everyone(notes: DataFrame, order: list[str]) -> DataFrame:
    """guidance: one row with the global notes as a line, null without any."""
    rows = notes.filter((F.col("scope") == GLOBAL) & (F.trim(F.coalesce("note", F.lit(""))) != ""))
    out = _joined(rows, [], order).select(F.nullif("guidance", F.lit("")).alias("guidance"))
    return out.select(F.concat(F.lit("Global guidance: "), "guidance").alias("guidance"))


def render(notes: DataFrame, order: list[str]) -> DataFrame:
    """focal_master_id, context: the global guidance, then the focal's own, a line each; blanks are skipped."""
    rows = notes.filter("trim(coalesce(note, '')) <> ''")
    everyone = _joined(rows.filter(F.col("scope") == GLOBAL), [], order).select(F.nullif("guidance", F.lit("")).alias("_global"))
    own = _joined(rows.filter(F.col("scope") == FOCAL), ["focal_master_id"], order)
    # the global guidance is one aggregate row
    out = own.join(F.broadcast(everyone), F.lit(True), "left")
    first = F.when(F.col("_global").isNotNull(), F.concat(F.lit("Global guidance: "), F.col("_global")))
    second = F.concat(F.lit("Focal "), F.col("focal_master_id"), F.lit(" guidance: "), F.col("guidance"))
    return out.select("focal_master_id", F.concat_ws("\n", first, second).alias("context"))
