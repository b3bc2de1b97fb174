"""One run from accounts to gold as frames; ``service`` puts it between tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.config import Config
from kinweave.functions import text
from kinweave.operators import groups, jobs, match, notes, proposals, report, review
from kinweave.operators.graph import checkpointed
from kinweave.sources import io

Frames = dict[str, DataFrame]
Keep = Callable[[str, DataFrame], DataFrame]
#: Frames from which several others are made: taken once.
_SHARED = ("candidates", "judged")


def _kept(name: str, df: DataFrame) -> DataFrame:
    return checkpointed(df) if name in _SHARED else df


def match_and_judge(
    accounts: DataFrame,
    cfg: Config,
    embedder: jobs.Embedder | jobs.Stored | None = None,
    judge: jobs.Judge | Callable[[DataFrame], DataFrame] | None = None,
    state: Frames | None = None,
    keep: Keep = _kept,
) -> Frames:
    """Frames from the exact groups to the review queue. ``keep`` gets each as it is made and gives back the frame to go on with."""
    state = state or {}
    matched = match.perfect_match(io.latest(accounts, ["account_id"], F.col("account_name")))
    known = state.get("mapping")
    if known is not None or state.get("overrides") is not None:
        if known is None:
            known = accounts.sparkSession.createDataFrame([], "old_master_id string, canonical_master_id string")
        else:
            known = proposals.effective(known, *[F.col(c) for c in ("updated_at", "run_id") if c in known.columns])
        matched = match.apply_mapping(matched, known, state.get("overrides"))
    matched = keep("full_match", matched)
    heads = keep("masters", match.masters(matched))
    columns = [c for c in cfg.similarity_columns if c in heads.columns]
    texts = heads.select(F.col("account_id").alias("id"), "account_name", text.weighted_text(columns, cfg.weights).alias("similarity_text"))
    vectors = jobs.embed(texts, embedder or jobs.hashed_embedder())
    decided = state.get("decisions")
    yes = None if decided is None else decided.filter("decision = 'YES'")
    pairs = match.similarity_pairs(vectors, yes, least=match.least_cosine(cfg))
    if cfg.fuzz_weight:
        pairs = match.with_fuzz(pairs, texts, cfg)
    pairs = keep("pairs", pairs)
    routed = keep("candidates", match.route(pairs, cfg))
    band = routed
    if cfg.scope != "all":
        seeds = accounts.sparkSession.createDataFrame([(i,) for i in cfg.scope_ids()], "id string")
        band = jobs.scoped(routed.filter("route = 'LLM'"), cfg.scope, seeds)
    top = jobs.ranked(band, cfg)
    context = heads.select(F.col("account_id").alias("id"), *[c for c in dict.fromkeys((*cfg.context_columns, *cfg.metadata_columns)) if c in heads.columns])
    work = keep("llm_jobs", jobs.prompts(jobs.build(top, context)))
    judged = keep("judged", jobs.decide(top, work, judge or jobs.band_judge(cfg.t_auto - 0.05, cfg.t_low + 0.05)))
    queued = keep("review_queue", review.queue(judged, cfg))
    return {"full_match": matched, "masters": heads, "pairs": pairs, "candidates": routed, "llm_jobs": work, "judged": judged, "review_queue": queued}


def finalize(frames: Frames, cfg: Config, state: Frames) -> Frames:
    """Proposals, ledger rows, the mapping's delta and the tables after it. state: review_queue, admin_gate, decisions, mapping, overrides."""
    judged = frames["judged"]
    queue = state.get("review_queue")
    if queue is None:
        queue = judged.limit(0).withColumns({"status": F.lit(None).cast("string"), "decision": F.lit(None).cast("string")})
    decided = state.get("decisions")
    yes = None if decided is None else decided.filter("decision = 'YES'")
    draft = proposals.draft(frames["candidates"], judged, queue, yes)
    gate = state.get("admin_gate")
    if gate is None:
        gate = judged.limit(0).select("pair_key", F.lit(None).cast("string").alias("action"))
    final = checkpointed(proposals.admin_gate(draft, gate))
    delta = checkpointed(proposals.mapping_delta(final))
    known = state.get("mapping")
    every = delta
    if known is not None:
        order = [F.col(c) for c in ("updated_at", "run_id") if c in known.columns]
        every = proposals.compress(proposals.effective(known, *order).unionByName(delta))
    applied = match.apply_mapping(frames["full_match"], every, state.get("overrides"))
    return {"proposals": final, "decisions": proposals.decision_rows(final, gate), "mapping": delta, "postapply": applied, "gold": proposals.gold(applied)}


def run_cycle(accounts: DataFrame, cfg: Config, embedder=None, judge=None, state: Frames | None = None) -> Frames:
    """All frames of a cycle. accounts: account_id, account_name and metadata; state: mapping, decisions,
    review_queue, admin_gate, overrides of earlier runs. A judge is a callable on the top candidates' rows
    (an expression) or an object with a ``judge`` protocol call."""
    frames = match_and_judge(accounts, cfg, embedder, judge, state)
    return frames | finalize(frames, cfg, state or {})


def run(operation: str, cfg: Config, frames: Frames, embedder=None, judge=None) -> Frames:
    """One operation on given frames, without tables: FULL_PIPELINE, FINALIZE, UPDATE_DECISIONS, GROUP_OPERATIONS, RERUN_ONLY, REVIEW, NOTES or STATUS."""
    operation = operation.strip().upper()
    if operation == "FULL_PIPELINE":
        return run_cycle(frames["accounts"], cfg, embedder, judge, {k: v for k, v in frames.items() if k != "accounts"})
    if operation == "FINALIZE":
        out = finalize(frames, cfg, {k: frames[k] for k in ("review_queue", "admin_gate", "decisions", "mapping", "overrides") if k in frames})
        return out if cfg.finalize else {"proposals": out["proposals"]}
    if operation == "UPDATE_DECISIONS":
        out = {"decisions": review.decision_updates(frames["updates"], cfg)}
        return out | ({"review_queue": review.status_events(review.current_status(frames["review_queue"], F.col("updated_at"), F.col("enqueued_at")), out["decisions"])} if "review_queue" in frames else {})
    if operation == "GROUP_OPERATIONS":
        ops = groups.completed(frames["operations"])
        return {"overrides": groups.overrides(frames["full_match"], ops), "log": groups.log(frames["full_match"], ops)}
    if operation == "RERUN_ONLY":
        judged = jobs.rejudge(frames["llm_results"], frames["context"], cfg, judge or jobs.band_judge(cfg.t_auto - 0.05, cfg.t_low + 0.05))
        return {"judged": judged, "review_queue": review.rerun_updates(judged, frames["review_queue"], cfg)}
    if operation == "REVIEW":
        approved, noted = review.batch_answers(frames["review_queue"], frames["answers"])
        return {"review_queue": approved, "notes": noted}
    if operation == "NOTES":
        return {"notes": notes.store(frames["old"], frames["notes"], F.col("added_at"))}
    if operation == "STATUS":
        return {"status": report.status(frames)}
    raise ValueError(f"unknown operation {operation!r}")
