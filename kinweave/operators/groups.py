"""Manual group operations as account overrides, with a log of what was done and what failed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The operations' names.
REMOVE, REPARENT, ADD_PARENT, BREAK_UP = "remove_member", "reparent_member", "add_parent_to_singleton", "breakup_group"
KNOWN = (REMOVE, REPARENT, ADD_PARENT, BREAK_UP)


def overrides(matched: DataFrame, operations: DataFrame) -> DataFrame:
    """(account_id, master_account_id) after operations (sequence, operation, target_id, new_master); the last one on an account wins."""
    ops = operations.filter(F.col("operation").isin(*KNOWN))
    single = ops.filter(F.col("operation") != BREAK_UP)
    to = F.when(F.col("operation") == REMOVE, F.col("target_id")).otherwise(F.col("new_master"))
    single = single.select("sequence", F.col("target_id").alias("account_id"), to.alias("master_account_id"))
    broken = ops.filter(F.col("operation") == BREAK_UP).select("sequence", F.col("target_id").alias("master_account_id"))
    members = matched.select("account_id", "master_account_id").join(broken, "master_account_id")
    members = members.filter("account_id <> master_account_id").select("sequence", "account_id", F.col("account_id").alias("master_account_id"))
    rows = single.unionByName(members).filter("master_account_id IS NOT NULL")
    last = F.max_by("master_account_id", "sequence").alias("master_account_id")
    return rows.groupBy("account_id").agg(last)


def log(matched: DataFrame, operations: DataFrame) -> DataFrame:
    """A row for each operation: status, error, members_affected (a broken group counts its master too)."""
    sizes = matched.groupBy(F.col("master_account_id").alias("target_id")).agg(F.count("*").cast("int").alias("_size"))
    known = F.col("operation").isin(*KNOWN)
    needs_master = F.col("operation").isin(REPARENT, ADD_PARENT) & F.col("new_master").isNull()
    error = F.when(~F.coalesce(known, F.lit(False)), F.concat(F.lit("unknown operation: "), F.coalesce("operation", F.lit("")))).when(needs_master, "new_master is missing")
    out = operations.join(sizes, "target_id", "left").withColumn("error", error)
    affected = F.when(F.col("error").isNotNull(), 0).when(F.col("operation") == BREAK_UP, F.coalesce("_size", F.lit(0))).otherwise(1)
    return out.withColumns({"status": F.when(F.col("error").isNull(), "completed").otherwise("failed"), "members_affected": affected.cast("int")}).drop("_size")


def completed(operations: DataFrame, reviewer: str | None = None) -> DataFrame:
    """Operations with what they leave out: an id from the time and the place in the list, the reviewer, the time."""
    now = F.current_timestamp()
    wanted = {"operation_id": F.concat(F.lit("op_"), F.unix_timestamp(now).cast("string"), F.lit("_"), F.col("sequence").cast("string")), "reviewer": F.lit(reviewer), "created_at": now}
    have = set(operations.columns)
    return operations.withColumns({c: F.coalesce(F.col(c), x) if c in have else x for c, x in wanted.items()})


def mapping_rows(overrides_: DataFrame) -> DataFrame:
    """Overrides as rows of the cumulative mapping: an account that leaves its group maps to itself."""
    return overrides_.select(F.col("account_id").alias("old_master_id"), F.col("master_account_id").alias("canonical_master_id"))


def allowed(matched: DataFrame, operations: DataFrame) -> DataFrame:
    """The operations that make sense on the groups as they are, those of the widgets: a member isn't its own master, the target is another master."""
    own = matched.select(F.col("account_id").alias("target_id"), "is_master", "group_size")
    heads = matched.filter("is_master").select(F.col("account_id").alias("new_master"), F.lit(True).alias("_head"))
    rows = operations.join(own, "target_id").join(heads, "new_master", "left")
    fits = (
        F.when(F.col("operation") == REMOVE, ~F.col("is_master"))
        .when(F.col("operation") == REPARENT, ~F.col("is_master") & F.col("_head"))
        .when(F.col("operation") == ADD_PARENT, (F.col("group_size") == 1) & F.col("_head") & (F.col("target_id") != F.col("new_master")))
        .when(F.col("operation") == BREAK_UP, F.col("is_master") & (F.col("group_size") > 2))
    )
    return rows.filter(F.coalesce(fits, F.lit(False))).select(*operations.columns)
