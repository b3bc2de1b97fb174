"""Review queue, reruns' updates, human decisions and their lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave import config
from kinweave.config import Config
from kinweave.operators import graph
from kinweave.sources import io


def needs_review(cfg: Config) -> Column:
    """Unsure, or a weak yes, or a weak no near the band; strict bounds on confidence."""
    unsure = F.col("llm_decision") == config.UNSURE
    if cfg.needs_only_queue:
        return F.coalesce(unsure, F.lit(False))
    weak_yes = (F.col("llm_decision") == config.YES) & (F.col("llm_confidence") < 0.70)
    weak_no = (F.col("llm_decision") == config.NO) & (F.col("llm_confidence") < 0.60) & (F.col("score") >= cfg.t_low - 0.05)
    return F.coalesce(unsure | weak_yes | weak_no, F.lit(False))


def queue(judged: DataFrame, cfg: Config) -> DataFrame:
    rows = judged.filter("candidate_master_id IS NOT NULL").filter(needs_review(cfg))
    return rows.withColumns({"queue_reason": F.lit(config.UNSURE), "status": F.lit(config.QUEUED)})


def rerun_updates(rerun: DataFrame, queue_: DataFrame, cfg: Config) -> DataFrame:
    """A queue row for each rejudged pair, with the reviewer, notes and time of its last queue row; a confident yes is approved if the configuration says so."""
    order = [F.col(c) for c in ("updated_at", "enqueued_at") if c in queue_.columns]
    carried = io.latest(queue_, ["pair_key"], *order).select("pair_key", "reviewer", "notes", "enqueued_at")
    approve = (F.col("llm_decision") == config.YES) & (F.col("llm_confidence") >= cfg.auto_approve_confidence) & F.lit(cfg.auto_approve)
    out = rerun.drop("reviewer", "notes", "enqueued_at").join(carried, "pair_key", "left")
    return out.withColumns(
        {
            "queue_reason": F.lit(config.UNSURE),
            "status": F.when(approve, config.APPROVED).otherwise(config.QUEUED),
            "decision": F.when(approve, F.lit(config.AFTER_NOTES_TAG)),
        }
    )


# The answers of a reviewer.
SAY_YES, SAY_NO, SKIP = "y", "n", "s"


def batch_answers(queue_: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A reviewer's answers (pair_key, answer y/n/s, note, reviewer) to queued pairs: (approved queue rows, notes).

    Only a yes changes a pair; a no or a skip leaves it queued. A note holds for everyone and for the
    pair's focal. Of several answers on a pair, a yes counts.
    """
    said = answers.select("pair_key", F.lower(F.trim("answer")).alias("answer"), F.col("note"), F.col("reviewer").alias("_reviewer"))
    open_ = queue_.filter(F.col("status") == config.QUEUED)
    yes = io.latest(said.filter(F.col("answer") == SAY_YES), ["pair_key"], F.col("note"), F.col("_reviewer"))
    rows = open_.drop("reviewer", "notes", "decision").join(yes, "pair_key")
    rows = rows.withColumns({"status": F.lit(config.APPROVED), "decision": F.lit(config.HUMAN_APPROVED), "reviewer": F.col("_reviewer"), "notes": F.nullif(F.trim("note"), F.lit(""))}).drop("answer", "note", "_reviewer")
    noted = open_.select("pair_key", "focal_master_id").join(said.filter("trim(coalesce(note, '')) <> ''"), "pair_key")
    scopes = F.explode(F.array(F.lit("GLOBAL"), F.lit("FOCAL"))).alias("scope")
    notes_ = noted.select(scopes, "focal_master_id", "note").distinct()
    return rows, notes_.withColumn("focal_master_id", F.when(F.col("scope") == "FOCAL", F.col("focal_master_id")))


def admin_answers(proposals: DataFrame, answers: DataFrame) -> DataFrame:
    """Gate rows of an admin's answers (pair_key, answer, note, reviewer) on proposed pairs: y approves, n rejects, anything else leaves the pair as it is."""
    said = answers.select("pair_key", F.lower(F.trim("answer")).alias("_answer"), F.col("note").alias("notes"), "reviewer")
    said = io.latest(said.filter(F.col("_answer").isin(SAY_YES, SAY_NO)), ["pair_key"], F.col("_answer") == SAY_NO, F.col("notes"))
    ends = proposals.select("pair_key", F.col("m1").alias("focal_master_id"), F.col("m2").alias("candidate_master_id")).dropDuplicates(["pair_key"])
    return ends.join(said, "pair_key").withColumn("action", F.when(F.col("_answer") == SAY_YES, "APPROVE").otherwise("REJECT")).drop("_answer")


def decision_updates(updates: DataFrame, cfg: Config) -> DataFrame:
    """Ledger rows of given decisions; those without a pair or a decision are left out."""
    return updates.filter("pair_key IS NOT NULL AND pair_key <> '' AND decision IS NOT NULL AND decision <> ''").withColumn("source", F.lit(cfg.source))


def status_events(queue_: DataFrame, updates: DataFrame) -> DataFrame:
    """What decisions (pair_key, decision, reviewer, notes) make of the pairs' last queue rows: approved on YES, else rejected."""
    new = io.latest(updates, ["pair_key"], F.col("decision"))
    new = new.select("pair_key", F.col("decision").alias("_decision"), F.col("reviewer").alias("_reviewer"), F.col("notes").alias("_notes"))
    out = queue_.join(new, "pair_key")
    status = F.when(F.col("_decision") == config.YES, config.APPROVED).otherwise(config.REJECTED)
    return out.withColumns({"status": status, "reviewer": F.col("_reviewer"), "notes": F.col("_notes")}).drop("_decision", "_reviewer", "_notes")


def diagnostics(queue_: DataFrame, diff: DataFrame, human: DataFrame) -> DataFrame:
    """One row: pairs queued, pairs rejudged, and pairs that a person has decided."""
    one = queue_.agg(F.count_if(F.col("status") == config.QUEUED).alias("queued"))
    two = diff.agg(F.count_if(F.col("change").isin("CHANGED", "CONFIRMED")).alias("rerun"))
    three = human.agg(F.count_if(F.col("human_decision").isNotNull()).alias("human"))
    # three rows of one aggregate each
    return one.join(F.broadcast(two), F.lit(True)).join(F.broadcast(three), F.lit(True))


def current_status(queue_: DataFrame, *order: Column) -> DataFrame:
    """The last event of each pair."""
    return io.latest(queue_, ["pair_key"], *order)


def human_decisions(rows: DataFrame, accepted: DataFrame, denied: DataFrame) -> DataFrame:
    """Marks pairs that a person accepted or denied, with where the decision came from; a denial wins."""
    yes = accepted.select("pair_key").distinct().withColumn("_yes", F.lit(True))
    no = denied.select("pair_key").distinct().withColumn("_no", F.lit(True))
    tag = F.when(F.col("_no"), "HUMAN_REJECTED").when(F.col("_yes"), "HUMAN_APPROVED")
    out = rows.join(yes, "pair_key", "left").join(no, "pair_key", "left").withColumn("human_decision", tag)
    final = F.when(F.col("_no"), config.NO).when(F.col("_yes"), config.YES).otherwise(F.col("llm_decision"))
    lineage = F.when(tag.isNotNull(), F.concat(F.lit("Human: "), F.col("llm_decision"), F.lit(" -> "), final)).otherwise(F.concat(F.lit("Model: "), F.col("llm_decision")))
    return out.withColumns({"final_decision": final, "lineage": lineage}).drop("_yes", "_no")


def apply_edits(judged: DataFrame, edits: DataFrame) -> DataFrame:
    """Judgements with people's edits (pair_key, llm_decision, llm_confidence); an edit with an unknown decision or a
    confidence outside [0, 1] is ignored, and of several edits of a pair the most confident counts."""
    valid = edits.filter(F.col("llm_decision").isin(config.YES, config.NO, config.UNSURE) & F.col("llm_confidence").between(0, 1))
    valid = io.latest(valid, ["pair_key"], F.col("llm_confidence"), F.col("llm_decision"))
    new = valid.select("pair_key", F.col("llm_decision").alias("_decision"), F.col("llm_confidence").alias("_confidence"))
    out = judged.join(new, "pair_key", "left")
    return out.withColumns({"llm_decision": F.coalesce("_decision", "llm_decision"), "llm_confidence": F.coalesce("_confidence", "llm_confidence")}).drop("_decision", "_confidence")


def rerun_preview(judged: DataFrame, ids: DataFrame, names: DataFrame) -> DataFrame:
    """The judged pairs that touch any of the ids, with their current decision and both names (id, account_name)."""
    mark = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    out = judged.select("pair_key", "focal_master_id", "candidate_master_id", "llm_decision")
    for side in ("focal", "candidate"):
        key = f"{side}_master_id"
        out = out.join(mark.withColumnsRenamed({"id": key, "_hit": f"_{side}"}), key, "left")
        out = out.join(names.select(F.col("id").alias(key), F.col("account_name").alias(f"{side}_name")), key, "left")
    return out.filter(F.coalesce("_focal", "_candidate", F.lit(False))).drop("_focal", "_candidate")


def split_resolved(rows: DataFrame) -> DataFrame:
    """Adds state: RESOLVED once a person has decided or the model is sure, else QUEUED."""
    sure = F.col("human_decision").isNotNull() | (F.col("llm_decision") != config.UNSURE)
    return rows.withColumn("state", F.when(sure, "RESOLVED").otherwise("QUEUED"))


def decision_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """pair_key, old_decision, new_decision where two judgements of a pair differ."""
    old = before.select("pair_key", F.col("llm_decision").alias("old_decision"))
    new = after.select("pair_key", F.col("llm_decision").alias("new_decision"))
    return old.join(new, "pair_key").filter("old_decision <> new_decision")


def rerun_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Upsert of a rerun by pair: the new judgement where there is one, with what it was and whether it changed."""
    old = before.select("pair_key", F.col("llm_decision").alias("rerun_from"), F.col("llm_confidence").alias("_confidence"))
    new = after.select("pair_key", F.col("llm_decision").alias("_new"), F.col("llm_confidence").alias("_new_confidence"))
    out = old.join(new, "pair_key", "full")
    change = F.when(F.col("_new").isNull(), "KEPT").when(F.col("rerun_from").isNull(), "NEW").when(F.col("_new") == F.col("rerun_from"), "CONFIRMED").otherwise("CHANGED")
    return out.select("pair_key", "rerun_from", F.coalesce("_new", "rerun_from").alias("llm_decision"), F.coalesce("_new_confidence", "_confidence").alias("llm_confidence"), change.alias("change"))


def affected_accounts(changes: DataFrame, yes_edges: DataFrame) -> DataFrame:
    """(id): both ends of changed pairs, and all that yes decisions connect to them."""
    left, right = F.split("pair_key", r"\|", 2)[0], F.split("pair_key", r"\|", 2)[1]
    ends = changes.select(F.explode(F.array(left, right)).alias("id")).distinct()
    parts = graph.connected_components(yes_edges, "focal_master_id", "candidate_master_id")
    roots = parts.join(ends.withColumnRenamed("id", "node"), "node", "left_semi").select("root").distinct()
    reached = parts.join(roots, "root", "left_semi").select(F.col("node").alias("id"))
    return ends.unionByName(reached).distinct()


def transitive_yes(judged: DataFrame, affected: DataFrame | None = None) -> DataFrame:
    """Pairs inside one component of yes decisions become yes; with ``affected`` only pairs that touch it."""
    yes = judged.filter(F.col("llm_decision") == config.YES)
    parts = graph.connected_components(yes, "focal_master_id", "candidate_master_id")
    out = judged.join(parts.select(F.col("node").alias("focal_master_id"), F.col("root").alias("_a")), "focal_master_id", "left")
    out = out.join(parts.select(F.col("node").alias("candidate_master_id"), F.col("root").alias("_b")), "candidate_master_id", "left")
    inside = (F.col("_a") == F.col("_b")) & (F.col("llm_decision") != config.YES)
    if affected is not None:
        mark = affected.select("id").distinct().withColumn("_hit", F.lit(True))
        for side in ("focal_master_id", "candidate_master_id"):
            out = out.join(mark.withColumnsRenamed({"id": side, "_hit": f"_{side}"}), side, "left")
        inside = inside & (F.coalesce("_focal_master_id", "_candidate_master_id", F.lit(False)))
    inside = F.coalesce(inside, F.lit(False))
    reason = F.when(inside, F.format_string(config.TRANSITIVE_REASON.replace("{}", "%s"), F.col("_a"))).otherwise(F.col("llm_reason"))
    return out.withColumns({"llm_reason": reason, "llm_decision": F.when(inside, config.YES).otherwise(F.col("llm_decision"))}).drop("_a", "_b", "_focal_master_id", "_candidate_master_id")
