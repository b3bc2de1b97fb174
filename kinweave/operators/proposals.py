"""Proposals, admin gate, ledgers, mappings and the tables after them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave import config
from kinweave.operators import graph, match
from kinweave.sources import io

_COLUMNS = ("pair_key", "m1", "m2", "source", "score", "reason", "confidence")
#: Where a proposal comes from; null where the rows that it is made from don't say.
_ORIGIN = {"prompt_version": "string", "model_name": "string", "decided_at": "timestamp", "reviewer": "string", "notes": "string"}


def _origin(rows: DataFrame, **given: Column) -> list[Column]:
    return [(given[c] if c in given else F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in _ORIGIN.items()]


def _ends(key: str = "pair_key") -> tuple[Column, Column]:
    parts = F.split(key, r"\|", 2)
    return parts[0].alias("m1"), parts[1].alias("m2")


def _precedence() -> Column:
    out = F.lit(-1)
    for i, s in enumerate(config.SOURCE_ORDER):
        out = F.when(F.col("source") == s, i).otherwise(out)
    return out


def strongest(rows: DataFrame) -> DataFrame:
    """One proposal a pair, of the strongest source."""
    return io.latest(rows, ["pair_key"], _precedence(), F.col("score"))


def draft(candidates: DataFrame, judged: DataFrame, queue: DataFrame, decided_yes: DataFrame | None = None) -> DataFrame:
    """Automatic pairs, the model's yes and people's approvals, without pairs decided yes before."""
    none = F.lit(None).cast("double")
    auto = candidates.filter(F.col("route") == config.AUTO)
    why = F.lit(config.AUTO_REASON)
    nobody = {"model_name": F.lit(None), "reviewer": F.lit(None), "notes": F.lit(None)}
    auto = auto.select("pair_key", *_ends(), F.lit(config.AUTO_95).alias("source"), "score", why.alias("reason"), none.alias("confidence"), *_origin(auto, prompt_version=why, **nobody))
    model = judged.filter(F.col("llm_decision") == config.YES)
    model = model.select("pair_key", *_ends(), F.lit(config.LLM_YES).alias("source"), "score", F.col("llm_reason").alias("reason"), F.col("llm_confidence").alias("confidence"), *_origin(model, reviewer=F.lit(None), notes=F.lit(None)))
    tag = F.when(F.coalesce("decision", F.lit("")) == config.AFTER_NOTES_TAG, config.HUMAN_AFTER_NOTES).otherwise(config.HUMAN_APPROVED)
    human = queue.filter(F.col("status") == config.APPROVED)
    when = {"decided_at": F.col("updated_at")} if "updated_at" in queue.columns else {}
    human = human.select("pair_key", *_ends(), tag.alias("source"), "score", F.col("llm_reason").alias("reason"), F.col("llm_confidence").alias("confidence"), *_origin(human, **when))
    rows = auto.unionByName(model).unionByName(human)
    return rows if decided_yes is None else rows.join(decided_yes.select("pair_key").distinct(), "pair_key", "left_anti")


def edited(judged: DataFrame) -> DataFrame:
    """Proposals from judgements that people have gone through: every yes is theirs."""
    yes = judged.filter(F.col("llm_decision") == config.YES)
    return yes.select("pair_key", *_ends(), F.lit(config.HUMAN_APPROVED).alias("source"), "score", F.col("llm_reason").alias("reason"), F.col("llm_confidence").alias("confidence"))


def _when(gate: DataFrame) -> dict[str, Column]:
    return {"decided_at": F.col("updated_at")} if "updated_at" in gate.columns else {}


def admin_gate(proposals: DataFrame, gate: DataFrame) -> DataFrame:
    """Without what the admin rejected and with what the admin approved; gate: the last action of each pair."""
    none = F.lit(None).cast("double")
    rejected = gate.filter("action = 'REJECT'").select("pair_key").distinct()
    approved = gate.filter("action = 'APPROVE'")
    approved = approved.select(
        "pair_key", *_ends(), F.lit(config.ADMIN_APPROVED).alias("source"), none.alias("score"), F.lit(config.ADMIN_YES_REASON).alias("reason"), none.alias("confidence"),
        *_origin(approved, prompt_version=F.lit(config.ADMIN_PROMPT), model_name=F.lit(None), **_when(approved)),
    )
    rows = proposals.select(*_COLUMNS, *_origin(proposals))
    return strongest(rows.join(rejected, "pair_key", "left_anti").unionByName(approved))


def decision_rows(proposals: DataFrame, gate: DataFrame) -> DataFrame:
    """Ledger rows of a finalised run: YES for proposals, NO for admin rejections."""
    yes = proposals.select("pair_key", "source", "score", "reason", F.lit(config.YES).alias("decision"), "confidence", *_origin(proposals))
    no = gate.filter("action = 'REJECT'")
    none = F.lit(None).cast("double")
    no = no.select(
        "pair_key", F.lit(config.ADMIN_REJECT).alias("source"), none.alias("score"), F.lit(config.ADMIN_NO_REASON).alias("reason"), F.lit(config.NO).alias("decision"), none.alias("confidence"),
        *_origin(no, prompt_version=F.lit(config.ADMIN_PROMPT), model_name=F.lit(None), **_when(no)),
    )
    return yes.unionByName(no)


def preview(proposals: DataFrame, cfg: config.Config) -> DataFrame:
    """Proposals as they are shown before a run is finalised, with the columns that led to them and the time."""
    return proposals.withColumns({"run_id": F.lit(cfg.run_id), "preview_at": F.current_timestamp(), "column_config": F.lit(cfg.column_config())})


def mapping_delta(proposals: DataFrame) -> DataFrame:
    """old_master_id, canonical_master_id: each master that isn't the smallest of its component, and that."""
    parts = graph.connected_components(proposals, "m1", "m2")
    return parts.filter("node <> root").select(F.col("node").alias("old_master_id"), F.col("root").alias("canonical_master_id"))


def compress(mapping: DataFrame) -> DataFrame:
    """Chains resolved to their smallest id; a row that maps an id to itself detaches it and is kept apart."""
    edges = mapping.filter("old_master_id <> canonical_master_id").select(F.col("old_master_id").alias("m1"), F.col("canonical_master_id").alias("m2"))
    own = mapping.filter("old_master_id = canonical_master_id").select("old_master_id", "canonical_master_id").distinct()
    linked = edges.join(own.select(F.col("old_master_id").alias("m1")), "m1", "left_anti")
    return mapping_delta(linked).join(own.select("old_master_id"), "old_master_id", "left_anti").unionByName(own)


def effective(mapping: DataFrame, *order: Column) -> DataFrame:
    """The last row of each old id, compressed."""
    return compress(io.latest(mapping, ["old_master_id"], *order))


def postapply(full_match: DataFrame, mapping: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    return match.apply_mapping(full_match, mapping, overrides)


def gold(applied: DataFrame) -> DataFrame:
    return match.masters(applied).drop("stage_rule", "normalized_name")
