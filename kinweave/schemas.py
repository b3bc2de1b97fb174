"""One schema a table: readers always return it, so a missing table and an empty one are the same."""

from __future__ import annotations

from collections.abc import Iterable

_MASTER = "account_id string, account_name string, master_account_id string, is_master boolean, group_size long, is_dupe boolean"
_ASKED = "prompt_version string, model_name string, request_id string, token_usage_json string, context_used string, context_hash string, decided_at timestamp"
_ANSWER = "candidate_master_id:string,score:double,llm_decision:string,llm_confidence:double,llm_reason:string,prompt_version:string"
_PROPOSAL = "pair_key string, m1 string, m2 string, source string, score double, reason string, confidence double, prompt_version string, model_name string, decided_at timestamp, reviewer string, notes string"

#: A table with ``step`` gets rows from several operations of a run; each run and step is a partition that is written as a whole.
TABLES = {
    "accounts_raw": "account_id string, account_name string, normalized_name string, run_id string",
    "full_match": f"{_MASTER}, stage_rule string, run_id string",
    "masters": f"{_MASTER}, run_id string",
    "pairs": "pair_key string, master_a_id string, master_b_id string, score double, run_id string",
    "candidates": "pair_key string, master_a_id string, master_b_id string, score double, route string, proposed_keep_master string, proposed_merge_master string, policy string, threshold_version string, tagged_at timestamp, run_id string",
    "llm_jobs": "focal_master_id string, batch_index int, prompt_json string, model_name string, prompt_version string, created_at timestamp, run_id string",
    "llm_results": f"focal_master_id string, results array<struct<{_ANSWER}>>, {_ASKED}, run_id string, step string",
    "review_queue": f"pair_key string, focal_master_id string, candidate_master_id string, score double, llm_decision string, llm_confidence double, llm_reason string, {_ASKED}, queue_reason string, status string, decision string, reviewer string, notes string, route_at_enqueue string, enqueued_at timestamp, updated_at timestamp, run_id string, step string",
    "admin_gate": "pair_key string, focal_master_id string, candidate_master_id string, action string, reviewer string, notes string, updated_at timestamp, run_id string",
    "proposals": f"{_PROPOSAL}, preview_at timestamp, column_config string, run_id string",
    "decisions": "pair_key string, source string, score double, reason string, decision string, decided_at timestamp, confidence double, prompt_version string, model_name string, reviewer string, notes string, run_id string, step string",
    "mapping": "old_master_id string, canonical_master_id string, updated_at timestamp, source string, run_id string, step string",
    "postapply": f"{_MASTER}, stage_rule string, column_config string, run_id string",
    "gold": f"{_MASTER}, column_config string, run_id string",
    "operations": "operation_id string, sequence long, operation string, target_id string, new_master string, status string, error string, members_affected int, reviewer string, notes string, created_at timestamp, run_id string",
    "notes": "scope string, focal_master_id string, note string, added_at timestamp, run_id string",
}
#: Tables whose rows are accounts and carry the accounts' metadata.
OF_ACCOUNTS = ("accounts_raw", "full_match", "masters", "postapply", "gold")


def schema(table: str, metadata: Iterable[str] = ()) -> str:
    """The schema of a table, with one nullable string per metadata column."""
    return ", ".join([TABLES[table], *(f"`{c}` string" for c in metadata)])


def partitions(table: str) -> list[str]:
    columns = [c.split()[0] for c in TABLES[table].split(", ")]
    return [c for c in ("run_id", "step") if c in columns]
