"""Run configuration from environment-style mappings; a value that can't be read falls back to its default."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, field, replace

# Vocabularies of the tables.
AUTO, REVIEW, REJECT = "AUTO_YES_95", "LLM", "AUTO_NO"
YES, NO, UNSURE = "YES", "NO", "NEEDS_CONFIRMATION"
QUEUED, APPROVED, REJECTED = "QUEUED", "APPROVED", "REJECTED"
AUTO_95, LLM_YES, HUMAN_APPROVED = "AUTO_95", "LLM_YES", "HUMAN_APPROVED"
HUMAN_AFTER_NOTES, ADMIN_APPROVED, ADMIN_REJECT = "HUMAN_NOTES_AUTO_APPROVED", "ADMIN_APPROVED", "ADMIN_REJECT"
AFTER_NOTES_TAG = "HUMAN_APPROVED_AFTER_NOTES"
UPDATES_SOURCE = "HUMAN_POWERAPP"
PERFECT = "PERFECT"
POLICY, THRESHOLDS = "first_wins", "v1"
PROMPT, PROMPT_WITH_CONTEXT, ADMIN_PROMPT = "v1", "v2_with_context", "admin_review"
AUTO_REASON, ADMIN_YES_REASON, ADMIN_NO_REASON = "auto_threshold", "admin_approved", "admin_reject"
FINALIZATION = "FINALIZATION"
TRANSITIVE_REASON = "Transitively connected through focal rerun (via {})"
#: The later a source stands, the stronger it is when one pair has several.
SOURCE_ORDER = (AUTO_95, LLM_YES, HUMAN_APPROVED, HUMAN_AFTER_NOTES, ADMIN_APPROVED)


@dataclass(frozen=True)
class Config:
    run_id: str = "run-1"
    operation: str = "FULL_PIPELINE"
    t_auto: float = 0.95
    t_low: float = 0.70
    top_n: int = 3
    batch_size: int = 3
    similarity_columns: tuple[str, ...] = ("account_name",)
    context_columns: tuple[str, ...] = ("account_name",)
    metadata_columns: tuple[str, ...] = ()
    weights: Mapping[str, float] = field(default_factory=dict)
    emb_weight: float = 1.0
    fuzz_weight: float = 0.0
    auto_approve: bool = True
    auto_approve_confidence: float = 0.9
    rerun_scope: str = "all"
    rerun_focals: tuple[str, ...] = ()
    rerun_pairs: tuple[str, ...] = ()
    global_notes: str | None = None
    focal_notes: Mapping[str, str] = field(default_factory=dict)
    pair_notes: Mapping[str, str] = field(default_factory=dict)
    needs_only_queue: bool = False
    suppress_no: bool = False
    finalize: bool = False
    source: str = UPDATES_SOURCE
    model: str = "offline"
    keep_rejected: bool = True
    scope: str = "all"
    scope_focals: tuple[str, ...] = ()
    scope_pairs: tuple[str, ...] = ()

    def scope_ids(self) -> list[str]:
        """The ids around which the first judging goes: given ones and both ends of given pairs."""
        ends = [x for key in self.scope_pairs if "|" in key for x in key.split("|", 1)]
        return sorted({*self.scope_focals, *ends})

    def column_config(self) -> str:
        """The chosen columns as JSON, stored beside what was made from them."""
        return json.dumps({"similarity_columns": list(self.similarity_columns), "llm_context_columns": list(self.context_columns), "metadata_columns": list(self.metadata_columns)})

    def with_(self, **changes) -> Config:
        return replace(self, **changes)

    @classmethod
    def pandas_profile(cls) -> Config:
        """The single-process variant: a wider review band, mixed scores, only unsure pairs queued."""
        return cls(t_low=0.60, emb_weight=0.95, fuzz_weight=0.05, needs_only_queue=True)

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> Config:
        env = os.environ if env is None else env

        def read(name, kind, default):
            try:
                return kind(env[name])
            except (KeyError, TypeError, ValueError):
                return default

        def parsed(name, kind, default):
            try:
                value = json.loads(env[name])
            except (KeyError, TypeError, ValueError):
                return default
            return value if isinstance(value, kind) else default

        def flag(name, default):
            return {"true": True, "1": True, "yes": True, "false": False, "0": False, "no": False}.get(env.get(name, "").strip().lower(), default)

        def names(name, default):
            value = parsed(name, list, None)
            return default if value is None else tuple(map(str, value))

        def listed(name):
            given = parsed(name, list, None)
            if given is not None:
                return tuple(map(str, given))
            return tuple(x for x in (p.strip() for p in env.get(name, "").split(",")) if x)

        base = cls()
        top_n = read("LLM_TOP_N", int, base.top_n)
        return cls(
            run_id=env.get("RUN_ID", base.run_id),
            operation=env.get("OPERATION", base.operation).strip().upper(),
            t_auto=read("T_AUTO", float, base.t_auto),
            t_low=read("T_LLM_LOW", float, base.t_low),
            top_n=top_n,
            batch_size=max(1, read("LLM_BATCH_SIZE", int, top_n)),
            similarity_columns=names("SIMILARITY_COLUMNS", base.similarity_columns),
            context_columns=names("LLM_CONTEXT_COLUMNS", base.context_columns),
            metadata_columns=names("METADATA_COLUMNS", base.metadata_columns),
            weights={k: float(v) for k, v in parsed("SIMILARITY_WEIGHTS", dict, {}).items() if isinstance(v, int | float)},
            emb_weight=read("SIM_EMB_WEIGHT", float, base.emb_weight),
            fuzz_weight=read("SIM_FUZZ_WEIGHT", float, base.fuzz_weight),
            auto_approve=flag("AUTO_APPROVE_RERUN_YES", base.auto_approve),
            auto_approve_confidence=read("AUTO_APPROVE_RERUN_YES_CONF", float, base.auto_approve_confidence),
            rerun_scope=env.get("RERUN_SCOPE", base.rerun_scope).strip().lower(),
            rerun_focals=listed("RERUN_FOCALS"),
            rerun_pairs=listed("RERUN_PAIR_KEYS"),
            global_notes=env.get("GLOBAL_NOTES") or None,
            focal_notes=parsed("FOCAL_NOTES_JSON", dict, {}),
            pair_notes=parsed("RERUN_NOTES_JSON", dict, {}),
            finalize=flag("FINALIZE", base.finalize),
            source=env.get("UPDATE_DECISION_SOURCE", base.source),
            model=env.get("MODEL_NAME", base.model),
            keep_rejected=flag("KEEP_REJECTED", base.keep_rejected),
            scope=env.get("SCOPE", base.scope).strip().lower(),
            scope_focals=listed("FOCALS"),
            scope_pairs=listed("SEED_PAIRS"),
        )


def as_text(value) -> str:
    """A parameter as an environment variable would hold it: text as it is, anything else as JSON."""
    return value if isinstance(value, str) else json.dumps(value)


def parse_accounts(text: str) -> list[tuple[str, str]]:
    """``id|name, id|name``; anything else is an error."""
    out = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        account_id, bar, name = part.partition("|")
        if not bar or not account_id.strip() or not name.strip():
            raise ValueError(f"expected id|name, got {part!r}")
        out.append((account_id.strip(), name.strip()))
    return out
