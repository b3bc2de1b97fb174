"""Judgement jobs: top candidates per focal, batches, pluggable judges, reruns."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave import config
from kinweave.config import Config
from kinweave.functions import text
from kinweave.operators import graph
from kinweave.sources import io


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class Judge(Protocol):
    """(focal, its candidates) -> for each judged candidate: id, score, decision, confidence, reason (None where not given).

    It may return (judgements, {"request_id": .., "token_usage": ..}) instead.
    """

    def __call__(self, focal: str, candidates: list[dict], context: str | None) -> list[dict] | tuple[list[dict], dict]: ...


def settings(env: Mapping[str, str], *names: str) -> dict[str, str]:
    """The named settings of a service; a missing or empty one is an error that names all that are missing."""
    missing = [n for n in names if not env.get(n)]
    if missing:
        raise ValueError(f"missing settings: {', '.join(missing)}")
    return {n: env[n] for n in names}


class Lazy:
    """A client that is built on its first call, once in each Python worker, and not where the plan is made."""

    def __init__(self, build: Callable[[], Callable]):
        self.build = build
        self._client = None

    def __call__(self, *args):
        if self._client is None:
            self._client = self.build()
        return self._client(*args)

    def __reduce__(self):
        return Lazy, (self.build,)


def hashed_embedder(dims: int = 64) -> Embedder:
    """Offline and the same in every process: each text seeds a normal vector by its digest."""

    def embed(texts: list[str]) -> list[list[float]]:
        seeds = (int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "big") for t in texts)
        return [np.random.default_rng(s).standard_normal(dims).tolist() for s in seeds]

    return embed


@dataclass
class Stored:
    """Embeddings that are there already: a table of (id, embedding) in place of a service."""

    vectors: DataFrame


def embed(texts: DataFrame, embedder: Embedder | Stored, batch: int = 64) -> DataFrame:
    """(id, similarity_text) -> id, similarity_text, embedding; ``batch`` texts a request, on the executors."""
    if isinstance(embedder, Stored):
        return texts.select("id", "similarity_text").join(embedder.vectors.select("id", "embedding"), "id", "left")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch].copy()
                part["embedding"] = embedder(part["similarity_text"].fillna("").tolist())
                yield part

    return texts.select("id", "similarity_text").mapInPandas(run, "id string, similarity_text string, embedding array<float>")


def ranked(candidates: DataFrame, cfg: Config) -> DataFrame:
    """The top_n candidates of each focal in the review band, with rank and batch_index; ties go to the smaller id."""
    band = candidates.filter(F.col("route") == config.REVIEW)
    order = Window.partitionBy("master_a_id").orderBy(F.desc("score"), "master_b_id")
    out = band.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= cfg.top_n)
    return out.withColumn("batch_index", F.floor((F.col("rank") - 1) / max(1, cfg.batch_size)).cast("int"))


def build(top: DataFrame, context: DataFrame) -> DataFrame:
    """One row per (focal_master_id, batch_index) with its candidates in rank order; context: id and its columns."""
    names = [c for c in context.columns if c != "id"]
    focal = context.select(F.col("id").alias("master_a_id"), *[F.col(c).alias(f"focal_{c}") for c in names])
    other = context.select(F.col("id").alias("master_b_id"), *[F.col(c).alias(f"candidate_{c}") for c in names])
    rows = top.join(focal, "master_a_id").join(other, "master_b_id")
    one = F.struct("rank", F.col("master_b_id").alias("candidate_master_id"), "score", *[f"candidate_{c}" for c in names])
    groups = rows.groupBy(F.col("master_a_id").alias("focal_master_id"), "batch_index", *[f"focal_{c}" for c in names])
    return groups.agg(F.sort_array(F.collect_list(one)).alias("candidates"))


def prompts(work: DataFrame) -> DataFrame:
    """What a judge is asked, as JSON: the focal's context and its candidates, nulls left out."""
    names = [c for c in work.columns if c.startswith("focal_") and c != "focal_master_id"]
    focal = F.struct(F.col("focal_master_id").alias("id"), *[F.col(c).alias(c.removeprefix("focal_")) for c in names])
    return work.withColumn("prompt_json", F.to_json(F.struct(focal.alias("focal"), "candidates")))


_FLAT = "focal_master_id string, candidate_master_id string, score double, llm_decision string, llm_confidence double, llm_reason string, request_id string, token_usage_json string"


def judge(jobs: DataFrame, judge_: Judge, context: Column | None = None) -> DataFrame:
    """A row for each judgement; missing fields get their defaults, a judgement without an id is left out."""
    rows = jobs.select("focal_master_id", F.to_json("candidates").alias("candidates"), (F.lit(None) if context is None else context).cast("string").alias("context"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for focal, candidates, note in pdf.itertuples(index=False):
                own = json.loads(candidates)
                known = {c["candidate_master_id"]: c["score"] for c in own}
                said = judge_(focal, own, note)
                said, meta = said if isinstance(said, tuple) else (said, {})
                usage = meta.get("token_usage")
                about = (meta.get("request_id"), None if usage is None else json.dumps(usage))
                for d in said:
                    name = d.get("candidate_master_id")
                    if name:
                        out.append((focal, name, d.get("score", known.get(name)), d.get("decision"), d.get("confidence"), d.get("reason"), *about))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _FLAT.split(", ")])

    return with_defaults(rows.mapInPandas(run, _FLAT))


def with_defaults(judged: DataFrame) -> DataFrame:
    # What a missing field of a judgement means.
    return judged.filter("candidate_master_id IS NOT NULL").withColumns(
        {
            "score": F.coalesce("score", F.lit(0.0)),
            "llm_decision": F.coalesce("llm_decision", F.lit(config.UNSURE)),
            "llm_confidence": F.coalesce("llm_confidence", F.lit(0.6)),
            "llm_reason": F.coalesce("llm_reason", F.lit("model_decision")),
            "pair_key": text.pair_key(F.col("focal_master_id"), F.col("candidate_master_id")),
        }
    )


def band_judge(yes: float, no: float) -> Callable[[DataFrame], DataFrame]:
    """The offline judge as an expression: by score alone, confidence twice the score."""

    def run(rows: DataFrame) -> DataFrame:
        decision = F.when(F.col("score") >= yes, config.YES).when(F.col("score") < no, config.NO).otherwise(config.UNSURE)
        return rows.select(
            F.col("master_a_id").alias("focal_master_id"),
            F.col("master_b_id").alias("candidate_master_id"),
            "pair_key",
            "score",
            decision.alias("llm_decision"),
            F.round(F.col("score") * 2, 6).alias("llm_confidence"),
            F.lit("score band").alias("llm_reason"),
        )

    return run


def decide(top: DataFrame, work: DataFrame, judge_: Judge | Callable[[DataFrame], DataFrame], context: Column | None = None) -> DataFrame:
    """Judgements by an object with a ``judge`` call over the work, or by an expression over the top candidates' rows."""
    return judge(work, judge_.judge, context) if hasattr(judge_, "judge") else judge_(top)


_ANSWER = ("candidate_master_id", "score", "llm_decision", "llm_confidence", "llm_reason", "prompt_version")


def results(judged: DataFrame, prompt_version: str = config.PROMPT, model: str | None = None) -> DataFrame:
    """Judgements as they are stored: a row for each request, with its answers in an array by candidate."""
    about = {"request_id": "string", "token_usage_json": "string", "context_used": "string", "context_hash": "string"}
    rows = io.ensure_columns(judged, about).withColumn("prompt_version", F.lit(prompt_version))
    out = rows.groupBy("focal_master_id", "prompt_version", *about).agg(F.sort_array(F.collect_list(F.struct(*_ANSWER))).alias("results"))
    return out.withColumns({"model_name": F.lit(model).cast("string"), "decided_at": F.current_timestamp()})


def exploded(stored: DataFrame) -> DataFrame:
    """A row for each stored answer; requests without answers and answers without a candidate are left out."""
    rest = [c for c in stored.columns if c not in ("results", "prompt_version")]
    rows = stored.select(*rest, F.explode_outer("results").alias("_r")).filter("_r.candidate_master_id IS NOT NULL")
    rows = rows.select(*rest, *[F.col("_r")[c].alias(c) for c in _ANSWER])
    return rows.withColumn("pair_key", text.pair_key(F.col("focal_master_id"), F.col("candidate_master_id")))


# --- scopes and reruns ---------------------------------------------------------------------------


def seeded(edges: DataFrame, seeds: DataFrame, a: str = "master_a_id", b: str = "master_b_id") -> DataFrame:
    """(id) of everything connected to a seed, the seeds that have edges included."""
    parts = graph.connected_components(edges, a, b)
    roots = parts.join(seeds.select(F.col("id").alias("node")).distinct(), "node", "left_semi").select("root").distinct()
    return parts.join(roots, "root", "left_semi").select(F.col("node").alias("id"))


def scoped(band: DataFrame, scope: str, focals: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Rows whose focal (master_a_id) is in scope: all, foci, or foci_related by the given edges."""
    if scope == "all":
        return band
    ids = focals if scope == "foci" else seeded(band if edges is None else edges, focals)
    return band.join(ids.select(F.col("id").alias("master_a_id")).distinct(), "master_a_id", "left_semi")


def notes_for(rows: DataFrame, pair_notes: DataFrame | None, focal_notes: DataFrame | None, global_notes: str | None) -> DataFrame:
    """Adds context_used by precedence pair, row, focal, global, and its hash."""
    out = rows if "notes" in rows.columns else rows.withColumn("notes", F.lit(None).cast("string"))
    for notes, key, name in ((pair_notes, "pair_key", "_pair_note"), (focal_notes, "focal_master_id", "_focal_note")):
        out = out.withColumn(name, F.lit(None).cast("string")) if notes is None else out.join(notes.select(key, F.col("note").alias(name)), key, "left")
    used = F.coalesce("_pair_note", "notes", "_focal_note", F.lit(global_notes).cast("string"))
    return out.withColumn("context_used", used).drop("_pair_note", "_focal_note").withColumn("context_hash", text.context_hash(F.col("context_used")))


def rerun_rows(judged: DataFrame, cfg: Config) -> DataFrame:
    """The judged pairs that a rerun covers: by scope around focals and pair keys, then by the pair list."""
    out = judged
    spark = judged.sparkSession
    ids = set(cfg.rerun_focals)
    for key in cfg.rerun_pairs:
        left, bar, right = key.partition("|")
        ids |= {left, right} if bar else set()
    if cfg.rerun_scope != "all" and ids:
        seeds = spark.createDataFrame([(i,) for i in sorted(ids)], "id string")
        if cfg.rerun_scope == "component":
            seeds = seeded(judged, seeds, "focal_master_id", "candidate_master_id")
        out = out.join(seeds.withColumnRenamed("id", "focal_master_id"), "focal_master_id", "left_semi")
    if cfg.rerun_pairs:
        out = out.filter(F.col("pair_key").isin(*cfg.rerun_pairs))
    return out


def rejudge(stored: DataFrame, context: DataFrame, cfg: Config, judge_: Judge | Callable[[DataFrame], DataFrame], focal_notes: DataFrame | None = None) -> DataFrame:
    """New judgements of the pairs of all stored results that the rerun covers, with the notes that apply to them.

    Of a pair that was judged several times the last answer is taken. focal_notes: focal_master_id and note, one a
    focal, where the configuration has none. context: id and its columns; pairs
    of which either master isn't there any more are left out. A focal's pairs are one request, whose context
    holds the different notes of its pairs, a line each.
    """
    spark = stored.sparkSession
    rows = io.latest(exploded(stored), ["focal_master_id", "candidate_master_id"], F.col("decided_at"), F.col("run_id"))
    rows = rerun_rows(rows.select("pair_key", "focal_master_id", "candidate_master_id", "score", "llm_decision"), cfg)
    names = [c for c in context.columns if c != "id"]
    for side in ("focal", "candidate"):
        rows = rows.join(context.select(F.col("id").alias(f"{side}_master_id"), *[F.col(c).alias(f"{side}_{c}") for c in names]), f"{side}_master_id")
    given = lambda m, key: spark.createDataFrame(sorted(m.items()), f"{key} string, note string") if m else None
    own = given(cfg.focal_notes, "focal_master_id")
    if focal_notes is not None:
        rest = focal_notes.select("focal_master_id", "note")
        own = rest if own is None else own.unionByName(rest.join(own.select("focal_master_id"), "focal_master_id", "left_anti"))
    rows = notes_for(rows, given(cfg.pair_notes, "pair_key"), own, cfg.global_notes)
    asked = rows.withColumnsRenamed({"focal_master_id": "master_a_id", "candidate_master_id": "master_b_id"})
    if hasattr(judge_, "judge"):
        one = F.struct("candidate_master_id", "score", *[f"candidate_{c}" for c in names])
        used = F.array_join(F.array_sort(F.collect_set("context_used")), "\n")
        work = rows.groupBy("focal_master_id", *[f"focal_{c}" for c in names]).agg(F.sort_array(F.collect_list(one)).alias("candidates"), used.alias("_context"))
        judged = judge(work, judge_.judge, F.col("_context"))
    else:
        judged = judge_(asked)
    return judged.drop("context_used", "context_hash").join(rows.select("pair_key", "focal_master_id", "context_used", "context_hash"), ["pair_key", "focal_master_id"], "left")
