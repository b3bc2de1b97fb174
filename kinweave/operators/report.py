"""Counts, indicators, drill-downs and histories for people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave import config
from kinweave.operators import graph, groups


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def decision_counts(judged: DataFrame) -> DataFrame:
    """One row: yes, no, unsure and all."""
    of = lambda v: F.count_if(F.col("llm_decision") == v)
    return judged.agg(of(config.YES).alias("yes"), of(config.NO).alias("no"), of(config.UNSURE).alias("needs_confirmation"), F.count("*").alias("total"))


def merge_kpis(before: DataFrame, after: DataFrame) -> DataFrame:
    """original, final and merged masters of two full matches, and the share of accounts left as they were in percent."""
    one = before.agg(F.count_if("is_master").alias("original_masters"), F.count("*").alias("accounts"))
    two = after.agg(F.count_if("is_master").alias("final_masters"))
    moved = before.select("account_id", F.col("master_account_id").alias("_old")).join(after.select("account_id", "master_account_id"), "account_id").agg(F.count_if(F.col("_old") != F.col("master_account_id")).alias("affected"))
    # three rows of one aggregate each
    out = one.join(F.broadcast(two), F.lit(True)).join(F.broadcast(moved), F.lit(True))
    share = F.round((1 - F.col("affected") / F.greatest("accounts", F.lit(1))) * 100, 6)
    return out.select("original_masters", "final_masters", (F.col("original_masters") - F.col("final_masters")).alias("merged"), "affected", share.alias("efficiency"))


def singletons(matched: DataFrame) -> DataFrame:
    return matched.groupBy("master_account_id").agg(F.count("*").alias("n")).filter("n = 1").select("master_account_id")


def drilldown(matched: DataFrame, master: str) -> DataFrame:
    """Members of a group with their role."""
    rows = matched.filter(F.col("master_account_id") == master)
    return rows.select("account_id", F.when(F.col("is_master"), "Master").otherwise("Member").alias("role"), "group_size")


def pairs_of(pairs: DataFrame, master: str) -> DataFrame:
    return pairs.filter((F.col("master_a_id") == master) | (F.col("master_b_id") == master))


def last_adjustment(log: DataFrame, at: str = "created_at") -> DataFrame:
    """One row: how many operations completed, and when the last one did."""
    done = F.col("status") == "completed"
    return log.agg(F.count_if(done).alias("completed"), F.max(F.when(done, F.col(at))).alias("last_at"))


def change_summary(changes: DataFrame, most: int = 3) -> DataFrame:
    """One line: the first changes by pair, and how many more there are."""
    line = F.concat("pair_key", F.lit(": "), "old_decision", F.lit(" -> "), "new_decision")
    first = changes.orderBy("pair_key").limit(most).select(line.alias("line"))
    shown = first.agg(F.array_join(F.sort_array(F.collect_list("line")), "; ").alias("shown"))
    count = changes.agg(F.count("*").alias("n"))
    # two rows of one aggregate each
    out = shown.join(F.broadcast(count), F.lit(True))
    more = F.when(F.col("n") > most, F.concat(F.lit("; +"), (F.col("n") - most).cast("string"), F.lit(" more"))).otherwise("")
    return out.select(F.concat("shown", more).alias("summary"), "n")


def adjustment_texts(log: DataFrame) -> DataFrame:
    """operation_id and a sentence on each operation."""
    op, target, to = F.col("operation"), F.col("target_id"), F.coalesce("new_master", F.lit("?"))
    text = (
        F.when(op == groups.REMOVE, F.concat(F.lit("Removed "), target, F.lit(" from its group")))
        .when(op == groups.REPARENT, F.concat(F.lit("Moved "), target, F.lit(" to "), to))
        .when(op == groups.ADD_PARENT, F.concat(F.lit("Added "), target, F.lit(" to the group of "), to))
        .when(op == groups.BREAK_UP, F.concat(F.lit("Broke up the group of "), target))
        .otherwise("Unknown action")
    )
    return log.select("operation_id", text.alias("text"))


def history(changes: DataFrame, human: DataFrame) -> DataFrame:
    """People's decisions, then rerun pairs that nobody decided."""
    decided = human.filter("human_decision IS NOT NULL")
    people = decided.select("pair_key", F.lit("HUMAN").alias("kind"), F.col("human_decision").alias("what"))
    reruns = changes.filter("change IN ('CHANGED', 'CONFIRMED')").join(decided.select("pair_key"), "pair_key", "left_anti")
    return people.unionByName(reruns.select("pair_key", F.lit("RERUN").alias("kind"), F.col("change").alias("what")))


def status(frames: dict[str, DataFrame]) -> DataFrame:
    """table, rows of each frame."""
    out = None
    for name, df in frames.items():
        own = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = own if out is None else out.unionByName(own)
    return out


def change_preview(changes: DataFrame, affected: DataFrame, matched: DataFrame) -> DataFrame:
    """One row: changed pairs, accounts that they affect, all masters, and the share of masters left as they are in percent."""
    one = changes.agg(F.count("*").alias("changed_pairs"))
    two = affected.agg(F.count_distinct("id").alias("affected"))
    three = matched.agg(F.count_if("is_master").alias("masters"))
    # three rows of one aggregate each
    out = one.join(F.broadcast(two), F.lit(True)).join(F.broadcast(three), F.lit(True))
    return out.withColumn("efficiency", F.round((1 - F.col("affected") / F.greatest("masters", F.lit(1))) * 100, 6))


def applied_merges(mapping: DataFrame, names: DataFrame) -> DataFrame:
    """Each merge with both names (id, account_name); a name that isn't there is null."""
    out = mapping.select("old_master_id", "canonical_master_id")
    for side in ("old", "canonical"):
        out = out.join(names.select(F.col("id").alias(f"{side}_master_id"), F.col("account_name").alias(f"{side}_name")), f"{side}_master_id", "left")
    return out


def placed(df: DataFrame, *order: Column) -> DataFrame:
    """The rows with their place in the whole order, from 1: sorted by ranges, and each range starts where the counts of those before it end."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # kept, as ranges are drawn from a sample and both passes need the same
    rows = graph.checkpointed(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # one row a range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = rows.withColumn("_part", part).join(F.broadcast(sizes.withColumn("_before", before)), "_part")
    return out.withColumn("place", (F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).cast("long")).drop("_part", "_at", "_n", "_before")
