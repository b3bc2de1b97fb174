"""Operations between tables: each reads the ledgers that it needs and appends its own rows, stamped with run and time.

Ledgers are never changed in place. An operation writes the partition of its run (and its step, where
several operations of a run write one table) as a whole, so a repeated operation leaves what one would.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave import config, schemas
from kinweave.config import Config
from kinweave.functions import text
from kinweave.operators import groups, jobs, notes, proposals, report, review
from kinweave.operators.graph import checkpointed
from kinweave.plans import cycle
from kinweave.sources import io


class Service:
    def __init__(self, spark: SparkSession, base: str, embedder=None, judge=None):
        self.spark, self.base, self.embedder, self.judge = spark, base, embedder, judge

    def table(self, name: str, cfg: Config | None = None, run_id: str | None = None) -> DataFrame:
        """A table by its name, read when it is used; missing ones are empty."""
        metadata = cfg.metadata_columns if cfg and name in schemas.OF_ACCOUNTS else ()
        return io.read(self.spark, self.base, name, metadata, run_id)

    def _write(self, df: DataFrame, name: str, cfg: Config, step: str = "", **stamps) -> DataFrame:
        """Appends rows and gives back what was written."""
        rows = df.withColumns({"run_id": F.lit(cfg.run_id), "step": F.lit(step), **stamps})
        io.append(rows, self.base, name, cfg.metadata_columns if name in schemas.OF_ACCOUNTS else ())
        out = self.table(name, cfg, cfg.run_id)
        return out.filter(F.col("step") == step) if "step" in out.columns else out

    def _queue(self) -> DataFrame:
        """The last event of each pair."""
        return review.current_status(self.table("review_queue"), F.coalesce("updated_at", "enqueued_at"), F.col("run_id"), F.col("step"))

    def _gate(self) -> DataFrame:
        return io.latest(self.table("admin_gate"), ["pair_key"], F.col("updated_at"), F.col("run_id"))

    def _applied(self) -> DataFrame:
        """Decisions that a finalised run has put into the mapping; one that a person has only written down is still to be proposed."""
        return self.table("decisions").filter(~F.col("source").eqNullSafe(config.UPDATES_SOURCE))

    def _approved(self) -> DataFrame:
        """The last queue row of each pair, and pairs that people decided YES without one."""
        queue = self._queue()
        told = self.table("decisions").filter((F.col("source") == config.UPDATES_SOURCE) & (F.col("decision") == config.YES))
        told = io.latest(told, ["pair_key"], F.col("decided_at"), F.col("run_id")).join(queue.select("pair_key"), "pair_key", "left_anti")
        told = told.select("pair_key", "reviewer", "notes", F.col("decided_at").alias("updated_at"), F.lit(config.APPROVED).alias("status"))
        return queue.unionByName(told, allowMissingColumns=True)

    def _overrides(self) -> DataFrame:
        """Of the mapping, what people did to accounts."""
        rows = self.table("mapping").filter(F.col("source") == config.UPDATES_SOURCE)
        rows = io.latest(rows, ["old_master_id"], F.col("updated_at"), F.col("run_id"))
        return rows.select(F.col("old_master_id").alias("account_id"), F.col("canonical_master_id").alias("master_account_id"))

    def _mapping(self) -> DataFrame:
        return self.table("mapping").filter(F.col("source") != config.UPDATES_SOURCE)

    def _names(self, cfg: Config) -> DataFrame:
        heads = io.latest(self.table("masters", cfg), ["account_id"], F.col("run_id") == cfg.run_id, F.col("run_id"))
        wanted = dict.fromkeys((*cfg.context_columns, *cfg.metadata_columns))
        return heads.select(F.col("account_id").alias("id"), *[c for c in wanted if c in heads.columns])

    def run(self, operation: str, params: Mapping[str, Any] | None = None) -> dict[str, DataFrame]:
        """An operation by its name with its parameters; returns what was written.

        Configuration is read from the parameters by the names of the environment variables (RUN_ID, T_AUTO,
        RERUN_SCOPE, ...). Rows come as frames or as lists of dicts: accounts, updates, operations, answers,
        admin_answers, notes.
        """
        params = dict(params or {})
        cfg = Config.from_env({k: v if isinstance(v, str) else config.as_text(v) for k, v in params.items() if k.isupper()})
        steps = {
            "FULL_PIPELINE": self.full_pipeline,
            "RERUN_ONLY": self.rerun,
            "UPDATE_DECISIONS": self.update_decisions,
            "GROUP_OPERATIONS": self.group_operations,
            "REVIEW": self.review,
            "ADMIN_REVIEW": self.admin_review,
            "NOTES": self.notes,
            "FINALIZE": self.finalize,
            "STATUS": self.status,
        }
        step = steps.get(operation.strip().upper())
        if step is None:
            raise ValueError(f"unknown operation {operation!r}; known: {', '.join(steps)}")
        return step(cfg, params)

    def _rows(self, params: Mapping[str, Any], name: str, shape: str) -> DataFrame:
        """Rows given as a frame or a list of dicts; columns that aren't there are null."""
        given = params.get(name)
        kinds = dict(c.split() for c in shape.split(", "))
        if isinstance(given, DataFrame):
            return io.ensure_columns(given, kinds)
        return self.spark.createDataFrame([tuple(r.get(c) for c in kinds) for r in given or []], shape)

    def full_pipeline(self, cfg: Config, params: Mapping[str, Any]) -> dict[str, DataFrame]:
        given = params.get("accounts")
        if given is not None:
            accounts = self._rows(params, "accounts", "account_id string, account_name string")
            accounts = self._write(accounts.withColumn("normalized_name", text.normalize_name(F.col("account_name"))), "accounts_raw", cfg)
        else:
            accounts = self.table("accounts_raw", cfg, cfg.run_id)
        out = {"accounts_raw": accounts}
        now = F.current_timestamp()

        def keep(name: str, df: DataFrame) -> DataFrame:
            if name == "judged":
                df = checkpointed(df)
                out["llm_results"] = self._write(jobs.results(df, config.PROMPT, cfg.model), "llm_results", cfg, "FULL_PIPELINE")
                return jobs.exploded(out["llm_results"])
            if name == "llm_jobs":
                out[name] = self._write(df, name, cfg, created_at=now, model_name=F.lit(cfg.model), prompt_version=F.lit(config.PROMPT))
                return df
            if name == "review_queue":
                df = df.withColumn("route_at_enqueue", F.lit(config.REVIEW))
                out[name] = self._write(df, name, cfg, "FULL_PIPELINE", enqueued_at=now)
                return df
            stamps = {"tagged_at": now} if name == "candidates" else {}
            out[name] = self._write(df, name, cfg, **stamps)
            return out[name]

        accounts = accounts.drop("run_id", "normalized_name")
        # what earlier runs did; this run's own rows would be those of a repeated operation
        before = F.col("run_id") != cfg.run_id
        state = {"mapping": self._mapping().filter(before), "decisions": self._applied().filter(before), "overrides": self._overrides()}
        cycle.match_and_judge(accounts, cfg, self.embedder, self.judge, state, keep)
        return out

    def rerun(self, cfg: Config, params: Mapping[str, Any]) -> dict[str, DataFrame]:
        """Judges pairs of all stored results again, with the stored notes, those of the parameters first."""
        focal = None
        if params.get("use_stored_notes"):
            kept = self.table("notes")
            focal = notes.render(kept, ["added_at"]).withColumnRenamed("context", "note")
            cfg = cfg.with_(global_notes=cfg.global_notes or notes.everyone(kept, ["added_at"]).first()["guidance"])  # one row
        judge = self.judge or jobs.band_judge(cfg.t_auto - 0.05, cfg.t_low + 0.05)
        # the rerun's own rows of an earlier attempt don't count
        stored = self.table("llm_results").filter(~((F.col("run_id") == cfg.run_id) & (F.col("step") == "RERUN_ONLY")))
        judged = checkpointed(jobs.rejudge(stored, self._names(cfg), cfg, judge, focal))
        out = {"llm_results": self._write(jobs.results(judged, config.PROMPT_WITH_CONTEXT, cfg.model), "llm_results", cfg, "RERUN_ONLY")}
        rows = jobs.exploded(out["llm_results"])
        queue = self.table("review_queue").filter(~((F.col("run_id") == cfg.run_id) & (F.col("step") == "RERUN_ONLY")))
        queue = review.current_status(queue, F.coalesce("updated_at", "enqueued_at"))
        updates = review.rerun_updates(rows, queue, cfg).withColumn("route_at_enqueue", F.lit(config.REVIEW))
        now = F.current_timestamp()
        return out | {"review_queue": self._write(updates, "review_queue", cfg, "RERUN_ONLY", updated_at=now, enqueued_at=F.coalesce("enqueued_at", now))}

    def update_decisions(self, cfg: Config, params: Mapping[str, Any]) -> dict[str, DataFrame]:
        updates = self._rows(params, "updates", "pair_key string, decision string, reviewer string, notes string")
        rows = review.decision_updates(updates, cfg)
        events = checkpointed(review.status_events(self._queue(), rows))
        out = {"decisions": self._write(rows, "decisions", cfg, "UPDATE_DECISIONS", decided_at=F.current_timestamp())}
        return out | {"review_queue": self._write(events, "review_queue", cfg, "UPDATE_DECISIONS", updated_at=F.current_timestamp())}

    def group_operations(self, cfg: Config, params: Mapping[str, Any]) -> dict[str, DataFrame]:
        """Operations on the run's groups: a log row each, and account overrides for the mapping."""
        shape = "operation_id string, sequence long, operation string, target_id string, new_master string, reviewer string, notes string"
        ops = self._rows(params, "operations", shape)
        if not isinstance(params.get("operations"), DataFrame):
            ops = self.spark.createDataFrame([(i, *r) for i, r in enumerate(ops.drop("sequence").collect())], "sequence long, operation_id string, operation string, target_id string, new_master string, reviewer string, notes string")  # given by hand
        ops = groups.completed(ops, params.get("reviewer"))
        matched = self.table("postapply", cfg, cfg.run_id)
        matched = self.table("full_match", cfg, cfg.run_id) if matched.isEmpty() else matched
        out = {"operations": self._write(groups.log(matched, ops), "operations", cfg)}
        done = out["operations"].filter("status = 'completed'")
        over = groups.mapping_rows(groups.overrides(matched, done))
        return out | {"mapping": self._write(over, "mapping", cfg, "GROUP_OPERATIONS", updated_at=F.current_timestamp(), source=F.lit(config.UPDATES_SOURCE))}

    def review(self, cfg: Config, params: Mapping[str, Any]) -> dict[str, DataFrame]:
        """A reviewer's answers in one go: approved pairs, and notes for everyone and for the focal."""
        answers = self._rows(params, "answers", "pair_key string, answer string, note string, reviewer string")
        approved, noted = (checkpointed(x) for x in review.batch_answers(self._queue(), answers))
        now = F.current_timestamp()
        out = {"review_queue": self._write(approved, "review_queue", cfg, "REVIEW", updated_at=now)}
        return out | self.notes(cfg, {"notes": noted})

    def admin_review(self, cfg: Config, params: Mapping[str, Any]) -> dict[str, DataFrame]:
        answers = self._rows(params, "admin_answers", "pair_key string, answer string, note string, reviewer string")
        rows = review.admin_answers(self.table("proposals", cfg, cfg.run_id), answers)
        return {"admin_gate": self._write(rows, "admin_gate", cfg, updated_at=F.current_timestamp())}

    def notes(self, cfg: Config, params: Mapping[str, Any]) -> dict[str, DataFrame]:
        given = self._rows(params, "notes", "scope string, focal_master_id string, note string").withColumn("added_at", F.current_timestamp())
        old = self.table("notes", cfg, cfg.run_id)
        return {"notes": self._write(checkpointed(notes.store(old, given, F.col("added_at"))), "notes", cfg)}

    def finalize(self, cfg: Config, params: Mapping[str, Any]) -> dict[str, DataFrame]:
        """Writes the preview; with FINALIZE set, the decisions, the mapping and the tables after it too."""
        judged = io.latest(jobs.exploded(self.table("llm_results", cfg, cfg.run_id)), ["focal_master_id", "candidate_master_id"], F.col("decided_at"), F.col("step"))
        frames = {"candidates": self.table("candidates", cfg, cfg.run_id), "judged": judged, "full_match": self.table("full_match", cfg, cfg.run_id)}
        own = (F.col("run_id") == cfg.run_id) & (F.col("step") == "FINALIZE")
        state = {"review_queue": self._approved(), "admin_gate": self._gate(), "decisions": self._applied().filter(~own), "mapping": self._mapping().filter(~own), "overrides": self._overrides()}
        made = cycle.finalize(frames, cfg, state)
        now, columns = F.current_timestamp(), F.lit(cfg.column_config())
        out = {"proposals": self._write(made["proposals"].withColumn("decided_at", F.coalesce("decided_at", now)), "proposals", cfg, preview_at=now, column_config=columns)}
        if not cfg.finalize:
            return out
        applied, gold = (checkpointed(made[x].select(*self.table(x, cfg).drop("run_id", "column_config").columns)) for x in ("postapply", "gold"))
        decisions, delta = checkpointed(made["decisions"]), checkpointed(made["mapping"])
        out["decisions"] = self._write(decisions, "decisions", cfg, "FINALIZE", decided_at=F.coalesce("decided_at", now))
        out["mapping"] = self._write(delta, "mapping", cfg, "FINALIZE", updated_at=now, source=F.lit(config.FINALIZATION))
        out["postapply"] = self._write(applied, "postapply", cfg, column_config=columns)
        out["gold"] = self._write(gold, "gold", cfg, column_config=columns)
        return out

    def status(self, cfg: Config, params: Mapping[str, Any]) -> dict[str, DataFrame]:
        return {"status": report.status({t: self.table(t, cfg) for t in schemas.TABLES})}


def export(service: Service, cfg: Config, folder: str) -> None:
    """The run's tables as CSV with a header each, the judgements as JSON, and the log of group operations."""
    for name in ("accounts_raw", "full_match", "masters", "pairs", "candidates", "review_queue", "admin_gate", "proposals", "decisions", "mapping", "postapply", "gold", "operations"):
        io.write_csv(service.table(name, cfg, cfg.run_id), f"{folder}/{name}")
    approved = service.table("review_queue", cfg, cfg.run_id).filter(F.col("status") == config.APPROVED)
    io.write_csv(approved, f"{folder}/human_approved")
    mapping = proposals.effective(service.table("mapping"), F.col("updated_at"), F.col("run_id"))
    io.write_csv(mapping, f"{folder}/mapping_cumulative")
    io.write_json(service.table("llm_results", cfg, cfg.run_id), f"{folder}/llm_results")
