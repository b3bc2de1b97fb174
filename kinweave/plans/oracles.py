"""DuckDB SQL for the registered queries, from the base tables."""

from __future__ import annotations

_NORM = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


def _key(a: str, b: str) -> str:
    return f"least({a}, {b}) || '|' || greatest({a}, {b})"


_E = """
e AS (SELECT CAST(vec_id AS VARCHAR) AS id, CAST(embedding AS DOUBLE[]) AS v, CAST(label AS VARCHAR) AS label FROM embeddings),
pairs AS (
  SELECT a.id || '|' || b.id AS pair_key, a.id AS master_a_id, b.id AS master_b_id, list_cosine_similarity(a.v, b.v) AS score
  FROM e a JOIN e b ON a.id < b.id),
band AS (SELECT * FROM pairs WHERE score >= 0.30 AND score < 0.40),
edges AS (SELECT pair_key, master_a_id AS m1, master_b_id AS m2, score FROM pairs WHERE score >= 0.40),
ranked AS (
  SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY master_a_id ORDER BY score DESC, master_b_id) AS INTEGER) AS rank FROM band) WHERE rank <= 3)"""


def _judge(name: str, yes: float, no: float) -> str:
    return f"""
{name} AS (
  SELECT pair_key, master_a_id AS focal_master_id, master_b_id AS candidate_master_id, score,
         CASE WHEN score >= {yes} THEN 'YES' WHEN score < {no} THEN 'NO' ELSE 'NEEDS_CONFIRMATION' END AS llm_decision,
         round(score * 2, 6) AS llm_confidence FROM ranked)"""


_J = _E + "," + _judge("judged", 0.38, 0.33)
_J2 = _J + "," + _judge("again", 0.35, 0.31)
_NEEDS = "(llm_decision = 'NEEDS_CONFIRMATION' OR llm_decision = 'YES' AND llm_confidence < 0.70 OR llm_decision = 'NO' AND llm_confidence < 0.60 AND score >= 0.30 - 0.05)"
_QUEUE = f"queue AS (SELECT * FROM judged WHERE {_NEEDS})"


def _reach(name: str, edges: str, a: str, b: str) -> str:
    """Components by closure: (node, root)."""
    return f"""
{name}_both AS (SELECT {a} AS x, {b} AS y FROM {edges} UNION SELECT {b}, {a} FROM {edges}),
{name}_walk AS (SELECT x, x AS y FROM {name}_both UNION SELECT w.x, l.y FROM {name}_walk w JOIN {name}_both l ON w.y = l.x),
{name} AS (SELECT x AS node, min(y) AS root FROM {name}_walk GROUP BY x)"""


_DRAFT = (
    _J
    + f""", {_QUEUE},
draft AS (
  SELECT pair_key, m1, m2, 'AUTO_95' AS source, score, 'auto_threshold' AS reason, CAST(NULL AS DOUBLE) AS confidence, 0 AS o FROM edges
  UNION ALL SELECT pair_key, focal_master_id, candidate_master_id, 'LLM_YES', score, 'score band', llm_confidence, 1 FROM judged WHERE llm_decision = 'YES'
  UNION ALL SELECT pair_key, focal_master_id, candidate_master_id, CASE WHEN CAST(focal_master_id AS BIGINT) % 6 = 0 THEN 'HUMAN_NOTES_AUTO_APPROVED' ELSE 'HUMAN_APPROVED' END,
         score, 'score band', llm_confidence, CASE WHEN CAST(focal_master_id AS BIGINT) % 6 = 0 THEN 3 ELSE 2 END FROM queue WHERE CAST(focal_master_id AS BIGINT) % 3 = 0),
gate AS (
  SELECT pair_key, focal_master_id AS m1, candidate_master_id AS m2, CASE WHEN CAST(focal_master_id AS BIGINT) % 5 = 0 THEN 'REJECT' ELSE 'APPROVE' END AS action
  FROM judged WHERE CAST(focal_master_id AS BIGINT) % 5 = 0 OR CAST(focal_master_id AS BIGINT) % 7 = 0),
gated AS (
  SELECT * FROM draft WHERE pair_key NOT IN (SELECT pair_key FROM gate WHERE action = 'REJECT')
  UNION ALL SELECT pair_key, m1, m2, 'ADMIN_APPROVED', NULL, 'admin_approved', NULL, 4 FROM gate WHERE action = 'APPROVE'),
final AS (SELECT * EXCLUDE (o, k) FROM (SELECT *, row_number() OVER (PARTITION BY pair_key ORDER BY o DESC) AS k FROM gated) WHERE k = 1)"""
)

_MATCH = """
named AS (SELECT {id} AS account_id, {norm} AS n{more} FROM {table} WHERE {col} IS NOT NULL),
matched AS (SELECT *, min(account_id) OVER (PARTITION BY n) AS master_account_id, count(*) OVER (PARTITION BY n) AS group_size FROM named)"""
_DOCS = _MATCH.format(id="CAST(doc_id AS VARCHAR)", norm=_NORM.format("text"), more=", lang, source", table="documents", col="text")
_PARTS = _MATCH.format(id="CAST(p_partkey AS VARCHAR)", norm=_NORM.format("p_name"), more=", p_partkey", table="part", col="p_name")
_FLAGS = "account_id, master_account_id, group_size, account_id = master_account_id AS is_master, group_size > 1 AS is_dupe, CASE WHEN group_size > 1 THEN 'PERFECT' END AS stage_rule"
_MAPPED = (
    _DOCS
    + """,
chain AS (SELECT CAST(doc_id AS VARCHAR) AS old, CAST(doc_id - doc_id % 10 AS VARCHAR) AS root FROM documents WHERE doc_id % 10 = 1
          UNION ALL SELECT CAST(d.doc_id AS VARCHAR), CAST(d.doc_id - 2 AS VARCHAR) FROM documents d WHERE d.doc_id % 10 = 2 AND d.doc_id - 1 IN (SELECT doc_id FROM documents)
          UNION ALL SELECT CAST(d.doc_id AS VARCHAR), CAST(d.doc_id - 1 AS VARCHAR) FROM documents d WHERE d.doc_id % 10 = 2 AND d.doc_id - 1 NOT IN (SELECT doc_id FROM documents)),
moved AS (SELECT account_id, coalesce(root, master_account_id) AS master_account_id, lang, source, master_account_id AS before FROM matched LEFT JOIN chain ON old = master_account_id),
applied AS (SELECT *, count(*) OVER (PARTITION BY master_account_id) AS group_size FROM moved)"""
)


def _lcs(a: str, b: str) -> str:
    """LCS length: the rows of the table as a fold over a's characters, each a fold over b's."""
    return (
        f"list_last(list_reduce(string_split({a}, ''), lambda r, c: list_reduce(range(1, length({b}) + 1), "
        f"lambda s, j: list_append(s, CASE WHEN substr({b}, CAST(j AS INTEGER), 1) = c THEN r[j] + 1 ELSE greatest(r[j + 1], s[j]) END), [CAST(0 AS BIGINT)]), "
        f"list_transform(range(0, length({b}) + 1), lambda z: CAST(0 AS BIGINT))))"
    )


def _sorted_tokens(c: str) -> str:
    return f"array_to_string(list_sort(string_split({c}, ' ')), ' ')"


def _after(overrides: str) -> str:
    return f"""WITH {_PARTS},
over AS ({overrides}),
moved AS (SELECT m.account_id, coalesce(o.to_id, m.master_account_id) AS master_account_id FROM matched m LEFT JOIN over o USING (account_id))
SELECT account_id, master_account_id, count(*) OVER (PARTITION BY master_account_id) AS group_size, account_id = master_account_id AS is_master FROM moved"""


_TARGET = "SELECT CAST(p_partkey AS VARCHAR) AS account_id, {} AS to_id FROM part WHERE p_partkey % 13 = 0"
_NEIGHBOURS = "embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"
_COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"

_DIFF = (
    _J2
    + """,
half AS (SELECT * FROM again WHERE CAST(focal_master_id AS BIGINT) % 2 = 0),
diff AS (
  SELECT pair_key, o.llm_decision AS rerun_from, coalesce(n.llm_decision, o.llm_decision) AS llm_decision, coalesce(n.llm_confidence, o.llm_confidence) AS llm_confidence,
         CASE WHEN n.llm_decision IS NULL THEN 'KEPT' WHEN o.llm_decision IS NULL THEN 'NEW' WHEN n.llm_decision = o.llm_decision THEN 'CONFIRMED' ELSE 'CHANGED' END AS change
  FROM judged o FULL JOIN half n USING (pair_key)),
human AS (
  SELECT *, CASE WHEN CAST(focal_master_id AS BIGINT) % 6 = 0 THEN 'HUMAN_REJECTED' WHEN CAST(focal_master_id AS BIGINT) % 4 = 0 THEN 'HUMAN_APPROVED' END AS human_decision,
         CASE WHEN CAST(focal_master_id AS BIGINT) % 6 = 0 THEN 'NO' WHEN CAST(focal_master_id AS BIGINT) % 4 = 0 THEN 'YES' ELSE llm_decision END AS final_decision FROM judged),
lined AS (SELECT *, CASE WHEN human_decision IS NOT NULL THEN 'Human: ' || llm_decision || ' -> ' || final_decision ELSE 'Model: ' || llm_decision END AS lineage FROM human)"""
)

SQL = {
    "f01_normalize_name": f"""SELECT 'doc' AS kind, CAST(doc_id AS BIGINT) AS id, {_NORM.format("text")} AS normalized_name FROM documents
        UNION ALL SELECT 'part', CAST(p_partkey AS BIGINT), {_NORM.format("p_name")} FROM part""",
    "f02_pair_key": f"""WITH k AS (SELECT vec_id, {_key("CAST(vec_id AS VARCHAR)", "CAST(vec_id + 1 AS VARCHAR)")} AS pair_key FROM embeddings)
        SELECT vec_id, pair_key, split_part(pair_key, '|', 1) AS left_id, split_part(pair_key, '|', 2) AS right_id FROM k""",
    "f03_weighted_similarity_text": f"""SELECT p_partkey, concat_ws(' ', CASE WHEN p_name <> '' THEN {_NORM.format("p_name")} || ' ' || {_NORM.format("p_name")} END,
        CASE WHEN p_brand <> '' THEN {_NORM.format("p_brand")} END, CASE WHEN p_type <> '' THEN {_NORM.format("p_type")} END) AS similarity_text FROM part""",
    "f04_combined_text": f"SELECT p_partkey, {_NORM.format("concat_ws(' | ', p_name, p_brand, p_type)")} AS combined_text FROM part",
    "f05_cosine": f"SELECT a.vec_id, round({_COS}, 6) AS cosine FROM {_NEIGHBOURS}",
    "f06_token_sort_ratio": f"""WITH n AS (SELECT DISTINCT {_NORM.format("p_name")} AS name FROM part),
        p AS (SELECT a.name, b.name AS other, {_sorted_tokens("a.name")} AS x, {_sorted_tokens("b.name")} AS y FROM n a JOIN n b ON a.name < b.name)
        SELECT name, other, round(2.0 * {_lcs("x", "y")} / (length(x) + length(y)), 6) AS ratio FROM p""",
    "f07_combined_score": f"""WITH p AS (SELECT a.vec_id, {_COS} AS c,
          {_sorted_tokens("'vec ' || a.vec_id || ' of label ' || a.label")} AS x, {_sorted_tokens("'vec ' || b.vec_id || ' of label ' || b.label")} AS y FROM {_NEIGHBOURS}),
        f AS (SELECT vec_id, c, 2.0 * {_lcs("x", "y")} / (length(x) + length(y)) AS r FROM p)
        SELECT vec_id, round(c, 6) AS emb_score, round(r, 6) AS fuzz_score, round(0.95 * c + 0.05 * r, 6) AS score FROM f""",
    "x01_embed_batches": f"""WITH t AS (SELECT CAST(p_partkey AS VARCHAR) AS id, {_NORM.format("p_name")} AS x FROM part)
        SELECT id, array_to_string(list_transform(range(26), lambda i: length(x) - length(replace(x, chr(97 + CAST(i AS INTEGER)), ''))), ',') AS letters FROM t""",
    "s18_fallback_vectors": f"SELECT {_NORM.format('p_name')} AS name, count(*) AS group_size, CAST(1 AS BIGINT) AS texts, 16 AS dims FROM part GROUP BY 1",
    "f13_context_hash": "SELECT conv_id, turn, substr(sha256(coalesce(text, '')), 1, 12) AS context_hash FROM conversations",
    "f16_json_decode": """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{"k":' || CAST(json_extract(props, '$.k') AS BIGINT) || '}' AS props FROM events""",
    "f18_csv_list": "SELECT p_partkey, replace(p_name, ' ', '+') AS items FROM part",
    "d01_perfect_match": f"WITH {_DOCS} SELECT {_FLAGS} FROM matched",
    "d01_perfect_match_parts": f"WITH {_PARTS} SELECT {_FLAGS} FROM matched",
    "d02_apply_mapping": f"WITH {_MAPPED} SELECT {_FLAGS} FROM applied",
    "d03_masters_slice": f"WITH {_DOCS} SELECT account_id, group_size, lang, source FROM matched WHERE account_id = master_account_id",
    "d04_similarity_pairs": f"""WITH {_E} SELECT pair_key, master_a_id, master_b_id, round(score, 6) AS score FROM pairs
        WHERE NOT (score >= 0.40 AND (CAST(master_a_id AS BIGINT) + CAST(master_b_id AS BIGINT)) % 2 = 0)""",
    "d05_route_candidates": f"""WITH {_E}, r AS (SELECT *, CASE WHEN score >= 0.40 THEN 'AUTO_YES_95' WHEN score >= 0.30 THEN 'LLM' ELSE 'AUTO_NO' END AS route FROM pairs)
        SELECT pair_key, master_a_id, master_b_id, round(score, 6) AS score, route, CASE WHEN route = 'AUTO_YES_95' THEN master_a_id END AS proposed_keep_master,
        CASE WHEN route = 'AUTO_YES_95' THEN master_b_id END AS proposed_merge_master, 'first_wins' AS policy, 'v1' AS threshold_version FROM r""",
    "a06_route_counts": f"WITH {_E} SELECT CASE WHEN score >= 0.40 THEN 'AUTO_YES_95' WHEN score >= 0.30 THEN 'LLM' ELSE 'AUTO_NO' END AS route, count(*) AS n FROM pairs GROUP BY 1",
    "j15_scores_of": f"""WITH {_E}, w AS (SELECT vec_id, {_key("CAST(vec_id AS VARCHAR)", "CAST(vec_id + 1 AS VARCHAR)")} AS pair_key FROM embeddings)
        SELECT vec_id, w.pair_key, coalesce(round(score, 6), 0.0) AS score FROM w LEFT JOIN (SELECT * FROM pairs WHERE score >= 0.30) p USING (pair_key)""",
    "d25_incremental": f"WITH {_E} SELECT pair_key, master_a_id, master_b_id, round(score, 6) AS score FROM pairs",
    "w01_llm_top_n": f"WITH {_E} SELECT pair_key, master_a_id, master_b_id, round(score, 6) AS score, rank FROM ranked",
    "w05_batches": f"WITH {_E} SELECT master_a_id, CAST((rank - 1) // 2 AS INTEGER) AS batch_index, count(*) AS n FROM ranked GROUP BY 1, 2",
    "d06_llm_jobs": f"""WITH {_E} SELECT r.master_a_id AS focal_master_id, CAST((rank - 1) // 2 AS INTEGER) AS batch_index, f.label AS focal_label,
        string_agg(r.master_b_id || ':' || c.label, ',' ORDER BY rank) AS candidates FROM ranked r JOIN e f ON f.id = r.master_a_id JOIN e c ON c.id = r.master_b_id GROUP BY 1, 2, 3""",
    "d07_judge_offline": f"WITH {_J} SELECT * REPLACE (round(score, 6) AS score) FROM judged",
    "x04_judge_protocol": f"""WITH {_J} SELECT pair_key, focal_master_id, candidate_master_id, round(score, 6) AS score, llm_decision,
        CASE WHEN llm_decision = 'NEEDS_CONFIRMATION' THEN 0.6 ELSE llm_confidence END AS llm_confidence, 'model_decision' AS llm_reason FROM judged""",
    "f14_stored_results": f"""WITH {_E}, b AS (SELECT *, count(*) OVER (PARTITION BY master_a_id) AS n FROM ranked WHERE rank <= 2)
        SELECT pair_key, master_a_id AS focal_master_id, 'NO' AS llm_decision, 'strict' AS llm_reason, 'v1' AS prompt_version, 'strict' AS model_name, 'r-' || master_a_id AS request_id,
        '{{"candidates": ' || n || '}}' AS token_usage_json, true AS stamped FROM b""",
    "f15_prompts": f"""WITH {_E} SELECT master_a_id AS focal_master_id, CAST((rank - 1) // 2 AS INTEGER) AS batch_index, master_a_id AS asked_id, f.label AS focal_label, rank,
        master_b_id AS candidate_master_id, c.label AS candidate_label FROM ranked r JOIN e f ON f.id = r.master_a_id JOIN e c ON c.id = r.master_b_id""",
    "o05_focals_in_order": f"WITH {_E} SELECT master_a_id, row_number() OVER (ORDER BY master_a_id) AS place FROM (SELECT DISTINCT master_a_id FROM ranked)",
    "v02_rejudge_focal": f"""WITH {_J} SELECT pair_key, 'r-' || focal_master_id AS request_id, '{{"candidates": ' || count(*) OVER (PARTITION BY focal_master_id) || '}}' AS token_usage_json, 'NO' AS llm_decision FROM judged""",
    "d08_rerun": f"""WITH RECURSIVE {_J}, {_QUEUE}, {_reach("c", "judged", "focal_master_id", "candidate_master_id")},
        hit AS (SELECT node FROM c WHERE root IN (SELECT root FROM c WHERE node IN ('0', '20', '40', '60', '80'))),
        u AS (SELECT *, CASE WHEN focal_master_id = '20' THEN 'look twice' WHEN focal_master_id = '31' THEN 'look once' ELSE 'everyone' END AS context_used FROM judged WHERE focal_master_id IN (SELECT node FROM hit)),
        r AS (SELECT pair_key, CASE WHEN score >= CASE WHEN context_used LIKE 'look%' THEN 0.34 ELSE 0.38 END THEN 'YES' WHEN score < 0.33 THEN 'NO' ELSE 'NEEDS_CONFIRMATION' END AS llm_decision, llm_confidence, context_used FROM u)
        SELECT pair_key, r.llm_decision, r.llm_confidence, 'again' AS llm_reason, context_used, substr(sha256(context_used), 1, 12) AS context_hash,
        CASE WHEN r.llm_decision = 'YES' AND r.llm_confidence >= 0.70 THEN 'APPROVED' ELSE 'QUEUED' END AS status, CASE WHEN r.llm_decision = 'YES' AND r.llm_confidence >= 0.70 THEN 'HUMAN_APPROVED_AFTER_NOTES' END AS decision,
        CASE WHEN q.pair_key IS NOT NULL THEN 'bob' END AS reviewer FROM r LEFT JOIN queue q USING (pair_key)""",
    "d08_rerun_notes": f"""WITH RECURSIVE {_J}, {_reach("c", "judged", "focal_master_id", "candidate_master_id")},
        hit AS (SELECT node FROM c WHERE root IN (SELECT root FROM c WHERE node IN (SELECT focal_master_id FROM judged WHERE CAST(focal_master_id AS BIGINT) % 20 = 0))),
        u AS (SELECT pair_key, CASE WHEN CAST(focal_master_id AS BIGINT) % 3 = 0 THEN 'pair ' || pair_key WHEN CAST(focal_master_id AS BIGINT) % 2 = 0 THEN 'focal ' || focal_master_id ELSE 'everyone' END AS context_used
              FROM judged WHERE focal_master_id IN (SELECT node FROM hit))
        SELECT pair_key, context_used, substr(sha256(context_used), 1, 12) AS context_hash FROM u""",
    "d09_review_queue": f"WITH {_J}, {_QUEUE} SELECT pair_key, round(score, 6) AS score, llm_decision, 'NEEDS_CONFIRMATION' AS queue_reason, 'QUEUED' AS status FROM queue",
    "d10_rerun_updates": f"""WITH {_J2}, {_QUEUE} SELECT a.pair_key, a.llm_decision, CASE WHEN a.llm_decision = 'YES' AND a.llm_confidence >= 0.72 THEN 'APPROVED' ELSE 'QUEUED' END AS status,
        CASE WHEN a.llm_decision = 'YES' AND a.llm_confidence >= 0.72 THEN 'HUMAN_APPROVED_AFTER_NOTES' END AS decision, CASE WHEN q.pair_key IS NOT NULL THEN 'ann' END AS reviewer,
        CASE WHEN q.pair_key IS NOT NULL THEN 'see' END AS notes FROM again a LEFT JOIN queue q USING (pair_key)""",
    "d11_decision_updates": "SELECT CAST(user_id AS VARCHAR) AS pair_key, event_type AS decision, event_id, 'HUMAN_POWERAPP' AS source FROM events WHERE user_id % 9 <> 0 AND event_id % 4 <> 0",
    "d23_decision_changes": f"WITH {_J2} SELECT pair_key, o.llm_decision AS old_decision, n.llm_decision AS new_decision FROM judged o JOIN again n USING (pair_key) WHERE o.llm_decision <> n.llm_decision",
    "d29_rerun_diff": f"WITH {_DIFF} SELECT * FROM diff",
    "d27_flat_decisions": f"""WITH {_J} SELECT j.* REPLACE (round(score, 6) AS score), f.label AS focal_name, c.label AS candidate_name
        FROM judged j LEFT JOIN e f ON f.id = focal_master_id LEFT JOIN e c ON c.id = candidate_master_id""",
    "d28_human_decisions": f"WITH {_DIFF} SELECT pair_key, human_decision, final_decision, lineage FROM lined",
    "d30_resolved_lineage": f"""WITH {_DIFF} SELECT CASE WHEN human_decision IS NOT NULL OR llm_decision <> 'NEEDS_CONFIRMATION' THEN 'RESOLVED' ELSE 'QUEUED' END || ':' || lineage AS key,
        count(*) AS n FROM lined GROUP BY 1""",
    "v11_decision_history": f"""WITH {_DIFF} SELECT pair_key, 'HUMAN' AS kind, human_decision AS what FROM lined WHERE human_decision IS NOT NULL
        UNION ALL SELECT pair_key, 'RERUN', change FROM diff WHERE change IN ('CHANGED', 'CONFIRMED') AND pair_key NOT IN (SELECT pair_key FROM lined WHERE human_decision IS NOT NULL)""",
    "a07_decision_counts": f"""WITH {_J} SELECT count(*) FILTER (WHERE llm_decision = 'YES') AS yes, count(*) FILTER (WHERE llm_decision = 'NO') AS no,
        count(*) FILTER (WHERE llm_decision = 'NEEDS_CONFIRMATION') AS needs_confirmation, count(*) AS total FROM judged""",
    "p15_decision_view": f"""WITH {_J} SELECT pair_key, llm_decision, row_number() OVER (ORDER BY llm_confidence DESC, score DESC, pair_key) AS place
        FROM judged WHERE llm_decision IN ('YES', 'NEEDS_CONFIRMATION')""",
    "d12_proposals": f"WITH {_DRAFT} SELECT * EXCLUDE (o) REPLACE (round(score, 6) AS score, round(confidence, 6) AS confidence) FROM draft",
    "d13_admin_gate": f"WITH {_DRAFT} SELECT * REPLACE (round(score, 6) AS score, round(confidence, 6) AS confidence) FROM final",
    "d14_preview": f"""WITH {_DRAFT} SELECT pair_key, m1, m2, source, reason, CASE WHEN source = 'AUTO_95' THEN 'auto_threshold' WHEN source = 'ADMIN_APPROVED' THEN 'admin_review' END AS prompt_version,
        '{{"similarity_columns": ["a", "b"], "llm_context_columns": ["account_name"], "metadata_columns": []}}' AS column_config, 'p1' AS run_id, true AS stamped FROM final""",
    "d15_decision_ledger": f"""WITH {_DRAFT} SELECT pair_key, source, round(score, 6) AS score, reason, 'YES' AS decision FROM final
        UNION ALL SELECT pair_key, 'ADMIN_REJECT', NULL, 'admin_reject', 'NO' FROM gate WHERE action = 'REJECT'""",
    "d16_mapping_delta": f"""WITH RECURSIVE {_DRAFT}, {_reach("c", "final", "m1", "m2")} SELECT node AS old_master_id, root AS canonical_master_id FROM c WHERE node <> root""",
    "w03_latest_per_key": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC) AS k FROM events) WHERE k = 1",
    "s09_upsert_keep_last": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 2 DESC, event_id DESC) AS k FROM events) WHERE k = 1",
    "s10_append_roundtrip": "SELECT n_name AS pair_key, CAST(n_nationkey AS DOUBLE) AS score, 'YES' AS decision, CAST(n_nationkey % 2 AS VARCHAR) AS run_id FROM nation",
    "g01_components": f"WITH RECURSIVE {_E}, {_reach('c', 'edges', 'm1', 'm2')} SELECT node, root FROM c",
    "g02_compress_mapping": f"WITH {_MAPPED} SELECT old AS old_master_id, root AS canonical_master_id FROM chain",
    "g03_component_sets": f"WITH RECURSIVE {_E}, {_reach('c', 'edges', 'm1', 'm2')} SELECT root, string_agg(node, ',' ORDER BY node) AS members FROM c GROUP BY root",
    "g04_seeded_component": f"""WITH RECURSIVE {_E}, {_reach("c", "edges", "m1", "m2")} SELECT node AS id FROM c WHERE root IN (SELECT root FROM c WHERE CAST(node AS BIGINT) < 50)""",
    "g05_scope_filter": f"""WITH RECURSIVE {_E}, {_reach("c", "edges", "m1", "m2")}, hit AS (SELECT node FROM c WHERE root IN (SELECT root FROM c WHERE CAST(node AS BIGINT) < 50)),
        wide AS (SELECT * FROM pairs WHERE score >= 0.30)
        SELECT 'all' AS scope, pair_key FROM wide UNION ALL SELECT 'foci', pair_key FROM wide WHERE CAST(master_a_id AS BIGINT) < 50
        UNION ALL SELECT 'foci_related', pair_key FROM wide WHERE master_a_id IN (SELECT node FROM hit)""",
    "g06_queue_component": f"""WITH RECURSIVE {_J}, {_QUEUE}, {_reach("c", "queue", "focal_master_id", "candidate_master_id")}
        SELECT node AS id FROM c WHERE root IN (SELECT root FROM c WHERE CAST(node AS BIGINT) < 50) INTERSECT SELECT focal_master_id FROM queue""",
    "g07_affected_accounts": f"""WITH RECURSIVE {_J}, {_judge("moved", 0.36, 0.33).strip()}, yes AS (SELECT * FROM judged WHERE llm_decision = 'YES'), {_reach("c", "yes", "focal_master_id", "candidate_master_id")},
        ends AS (SELECT unnest([o.focal_master_id, o.candidate_master_id]) AS id FROM judged o JOIN moved n USING (pair_key) WHERE o.llm_decision <> n.llm_decision)
        SELECT id FROM ends UNION SELECT node FROM c WHERE root IN (SELECT root FROM c WHERE node IN (SELECT id FROM ends))""",
    "g08_transitive_yes": f"""WITH RECURSIVE {_E}, {_judge("judged", 0.345, 0.33).strip()}, yes AS (SELECT * FROM judged WHERE llm_decision = 'YES'), {_reach("c", "yes", "focal_master_id", "candidate_master_id")},
        t AS (SELECT j.*, j.llm_decision <> 'YES' AND a.root IS NOT NULL AND a.root = b.root AS inside, a.root FROM judged j LEFT JOIN c a ON a.node = focal_master_id LEFT JOIN c b ON b.node = candidate_master_id)
        SELECT pair_key, CASE WHEN inside THEN 'YES' ELSE llm_decision END AS llm_decision,
        CASE WHEN inside THEN 'Transitively connected through focal rerun (via ' || root || ')' ELSE 'score band' END AS llm_reason FROM t""",
    "d17_postapply": f"WITH {_MAPPED} SELECT {_FLAGS} FROM applied",
    "d17_gold": f"WITH {_MAPPED} SELECT account_id, master_account_id, group_size, group_size > 1 AS is_dupe, lang FROM applied WHERE account_id = master_account_id",
    "a10_merge_kpis": f"""WITH {_MAPPED}, k AS (SELECT count(*) FILTER (WHERE account_id = before) AS original_masters, count(*) FILTER (WHERE account_id = master_account_id) AS final_masters,
        count(*) FILTER (WHERE before <> master_account_id) AS affected, count(*) AS accounts FROM applied)
        SELECT original_masters, final_masters, original_masters - final_masters AS merged, affected, round((1 - affected / CAST(accounts AS DOUBLE)) * 100, 6) AS efficiency FROM k""",
    "a05_singletons": f"WITH {_DOCS} SELECT master_account_id FROM matched WHERE group_size = 1",
    "d18_remove_member": _after(_TARGET.format("CAST(p_partkey AS VARCHAR)")),
    "d19_reparent_member": _after(_TARGET.format("'1'")),
    "d20_add_parent": _after("SELECT CAST(part.p_partkey AS VARCHAR) AS account_id, '1' AS to_id FROM part JOIN matched ON account_id = CAST(part.p_partkey AS VARCHAR) WHERE part.p_partkey % 13 = 0 AND group_size = 1"),
    "d21_breakup_group": _after("SELECT account_id, account_id AS to_id FROM matched WHERE account_id <> master_account_id AND master_account_id IN (SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey % 13 = 0)"),
    "d22_operation_log": f"""WITH {_PARTS}, s AS (SELECT master_account_id AS target_id, count(*) AS n FROM matched GROUP BY 1)
        SELECT 'op_' || p_partkey AS operation_id, 'breakup_group' AS operation, 'completed' AS status, CAST(NULL AS VARCHAR) AS error, CAST(coalesce(n, 0) AS INTEGER) AS members_affected
        FROM part LEFT JOIN s ON target_id = CAST(p_partkey AS VARCHAR) WHERE p_partkey % 13 = 0
        UNION ALL SELECT 'op_' || p_partkey, 'sing', 'failed', 'unknown operation: sing', 0 FROM part WHERE p_partkey % 13 = 0""",
    "v16_allowed_operations": f"""WITH {_PARTS}, t AS (SELECT * FROM matched WHERE p_partkey % 13 = 0)
        SELECT 'remove_member' AS operation, account_id AS target_id FROM t WHERE account_id <> master_account_id
        UNION ALL SELECT 'reparent_member', account_id FROM t WHERE account_id <> master_account_id AND '1' IN (SELECT master_account_id FROM matched WHERE account_id = '1')
        UNION ALL SELECT 'breakup_group', account_id FROM t WHERE account_id = master_account_id AND group_size > 2""",
    "d31_drilldown": f"WITH {_PARTS} SELECT account_id, CASE WHEN account_id = master_account_id THEN 'Master' ELSE 'Member' END AS role, group_size FROM matched WHERE master_account_id = '1'",
    "d31_pairs_of": f"WITH {_E} SELECT pair_key, master_a_id, master_b_id, round(score, 6) AS score FROM pairs WHERE master_a_id = '7' OR master_b_id = '7'",
    "d32_adjustments": """WITH t AS (SELECT CAST(p_partkey AS VARCHAR) AS k FROM part WHERE p_partkey % 13 = 0)
        SELECT 'op_' || k || '-remove_member' AS operation_id, 'Removed ' || k || ' from its group' AS text FROM t
        UNION ALL SELECT 'op_' || k || '-reparent_member', 'Moved ' || k || ' to 1' FROM t
        UNION ALL SELECT 'op_' || k || '-add_parent_to_singleton', 'Added ' || k || ' to the group of 1' FROM t
        UNION ALL SELECT 'op_' || k || '-breakup_group', 'Broke up the group of ' || k FROM t
        UNION ALL SELECT 'op_' || k || '-sing', 'Unknown action' FROM t""",
    "d33_notes_context": """WITH g AS (SELECT string_agg(text, ' | ' ORDER BY turn) AS g FROM conversations WHERE conv_id = 0 AND trim(coalesce(text, '')) <> ''),
        f AS (SELECT conv_id, string_agg(text, ' | ' ORDER BY turn) AS t FROM conversations WHERE conv_id <> 0 AND trim(coalesce(text, '')) <> '' GROUP BY conv_id)
        SELECT CAST(conv_id AS VARCHAR) AS focal_master_id, concat_ws(chr(10), 'Global guidance: ' || g, 'Focal ' || conv_id || ' guidance: ' || t) AS context FROM f, g""",
    "s22_notes_store": """SELECT 'FOCAL' AS scope, CAST(conv_id % 7 AS VARCHAR) AS focal_master_id, role AS note, max(conv_id * 1000 + turn) AS added_at FROM conversations GROUP BY 1, 2, 3""",
    "d35_status_report": f"""WITH {_J}, {_DOCS.strip()} SELECT 'full_match' AS "table", count(*) AS rows FROM matched UNION ALL SELECT 'candidates', count(*) FROM pairs WHERE score >= 0.30
        UNION ALL SELECT 'judged', count(*) FROM judged""",
    "d37_full_cycle": f"""WITH RECURSIVE {_DRAFT}, {_reach("c", "final", "m1", "m2")}, m AS (SELECT coalesce(root, id) AS account_id FROM e LEFT JOIN c ON node = id)
        SELECT account_id, count(*) AS group_size, count(*) > 1 AS is_dupe FROM m GROUP BY 1""",
    "d36_router": f"""WITH RECURSIVE {_J}, {_QUEUE}, yes AS (SELECT m1 AS a, m2 AS b FROM edges UNION SELECT focal_master_id, candidate_master_id FROM judged WHERE llm_decision = 'YES'
          UNION SELECT focal_master_id, candidate_master_id FROM queue WHERE CAST(focal_master_id AS BIGINT) % 3 = 0), {_reach("c", "yes", "a", "b")}, m AS (SELECT coalesce(root, id) AS account_id FROM e LEFT JOIN c ON node = id)
        SELECT account_id, count(*) AS group_size, count(*) > 1 AS is_dupe, 'r1' AS run_id FROM m GROUP BY 1""",
    "s03_run_partition": "SELECT CAST(s_suppkey AS VARCHAR) AS old_master_id, '1' AS canonical_master_id, '3' AS run_id FROM supplier WHERE s_suppkey % 5 = 3",
    "s04_csv_roundtrip": "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation",
    "s12_status_events": f"""WITH {_J}, {_QUEUE}, q AS (SELECT pair_key, CAST(focal_master_id AS BIGINT) % 3 AS r FROM queue)
        SELECT pair_key, CASE r WHEN 0 THEN 'APPROVED' WHEN 1 THEN 'REJECTED' ELSE 'QUEUED' END AS status, CASE WHEN r < 2 THEN 'ann' END AS reviewer, CASE WHEN r < 2 THEN 'ok' END AS notes FROM q""",
    "p01_project": "SELECT s_suppkey, s_name FROM supplier",
    "p02_ensure_columns": "SELECT r_regionkey, r_name, CAST(NULL AS DOUBLE) AS score FROM region",
    "d17_effective_mapping": f"""WITH {_MAPPED} SELECT old AS old_master_id, CASE WHEN CAST(old AS BIGINT) % 20 = 2 THEN old ELSE root END AS canonical_master_id FROM chain""",
    "d34_review_answers": f"""WITH {_J}, {_QUEUE}, q AS (SELECT *, CAST(focal_master_id AS BIGINT) % 4 AS r FROM queue)
        SELECT 'PAIR' AS kind, pair_key AS key, 'APPROVED:HUMAN_APPROVED:ann:seen ' || focal_master_id AS what FROM q WHERE r = 0
        UNION ALL SELECT DISTINCT 'FOCAL', focal_master_id, 'seen ' || focal_master_id FROM q WHERE r < 2 UNION ALL SELECT DISTINCT 'GLOBAL', NULL, 'seen ' || focal_master_id FROM q WHERE r < 2""",
    "d34_admin_answers": f"""WITH {_DRAFT}, p AS (SELECT DISTINCT pair_key, m1, m2, CAST(m1 AS BIGINT) % 4 AS r FROM draft)
        SELECT pair_key, m1 AS focal_master_id, m2 AS candidate_master_id, CASE r WHEN 0 THEN 'APPROVE' ELSE 'REJECT' END AS action, 'ann' AS reviewer, 'seen ' || m1 AS notes FROM p WHERE r < 2""",
    "v04_edit_rows": "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (3, 7) UNION ALL SELECT NULL, 'NEWLAND'",
    "v08_change_preview": f"""WITH RECURSIVE {_J}, {_judge("moved", 0.36, 0.33).strip()}, yes AS (SELECT * FROM judged WHERE llm_decision = 'YES'), {_reach("c", "yes", "focal_master_id", "candidate_master_id")},
        x AS (SELECT pair_key, o.focal_master_id, o.candidate_master_id FROM judged o JOIN moved n USING (pair_key) WHERE o.llm_decision <> n.llm_decision),
        ends AS (SELECT unnest([focal_master_id, candidate_master_id]) AS id FROM x),
        hit AS (SELECT id FROM ends UNION SELECT node FROM c WHERE root IN (SELECT root FROM c WHERE node IN (SELECT id FROM ends)))
        SELECT (SELECT count(*) FROM x) AS changed_pairs, (SELECT count(*) FROM hit) AS affected, count(*) AS masters, round((1 - (SELECT count(*) FROM hit) / CAST(count(*) AS DOUBLE)) * 100, 6) AS efficiency FROM e""",
    "v12_queue_diagnostics": f"""WITH {_DIFF}, {_QUEUE} SELECT (SELECT count(*) FROM queue) AS queued, (SELECT count(*) FROM diff WHERE change IN ('CHANGED', 'CONFIRMED')) AS rerun,
        (SELECT count(*) FROM lined WHERE human_decision IS NOT NULL) AS human""",
    "v15_applied_merges": f"""WITH RECURSIVE {_E}, {_reach("c", "edges", "m1", "m2")}, n AS (SELECT id, 'label ' || label AS name FROM e WHERE CAST(id AS BIGINT) % 3 > 0)
        SELECT node AS old_master_id, root AS canonical_master_id, a.name AS old_name, b.name AS canonical_name FROM c LEFT JOIN n a ON a.id = node LEFT JOIN n b ON b.id = root WHERE node <> root""",
    "g08_transitive_yes_affected": f"""WITH RECURSIVE {_E}, {_judge("judged", 0.345, 0.33).strip()}, yes AS (SELECT * FROM judged WHERE llm_decision = 'YES'), {_reach("c", "yes", "focal_master_id", "candidate_master_id")},
        t AS (SELECT j.*, j.llm_decision <> 'YES' AND a.root IS NOT NULL AND a.root = b.root AND (CAST(focal_master_id AS BIGINT) % 2 = 0 OR CAST(candidate_master_id AS BIGINT) % 2 = 0) AS inside, a.root
              FROM judged j LEFT JOIN c a ON a.node = focal_master_id LEFT JOIN c b ON b.node = candidate_master_id)
        SELECT pair_key, CASE WHEN inside THEN 'YES' ELSE llm_decision END AS llm_decision,
        CASE WHEN inside THEN 'Transitively connected through focal rerun (via ' || root || ')' ELSE 'score band' END AS llm_reason FROM t""",
    "v07_edit_decisions": f"""WITH {_J} SELECT pair_key, CASE WHEN CAST(focal_master_id AS BIGINT) % 4 = 0 THEN 'YES' ELSE llm_decision END AS llm_decision,
        CASE WHEN CAST(focal_master_id AS BIGINT) % 4 = 0 THEN 0.99 ELSE llm_confidence END AS llm_confidence FROM judged""",
    "d26_finalize_edited": f"""WITH RECURSIVE {_J}, yes AS (SELECT * FROM judged WHERE llm_decision = 'YES' OR CAST(focal_master_id AS BIGINT) % 4 = 0),
        {_reach("c", "yes", "focal_master_id", "candidate_master_id")}, m AS (SELECT coalesce(root, id) AS account_id FROM e LEFT JOIN c ON node = id)
        SELECT account_id, count(*) AS group_size, count(*) > 1 AS is_dupe FROM m GROUP BY 1""",
    "v09_rerun_preview": f"""WITH {_J} SELECT pair_key, focal_master_id, candidate_master_id, llm_decision, 'label ' || f.label AS focal_name, 'label ' || c.label AS candidate_name
        FROM judged j LEFT JOIN e f ON f.id = focal_master_id LEFT JOIN e c ON c.id = candidate_master_id WHERE CAST(focal_master_id AS BIGINT) < 50 OR CAST(candidate_master_id AS BIGINT) < 50""",
    "a09_last_adjustment": "SELECT count(*) FILTER (WHERE event_id % 3 = 0) AS completed, strftime(max(ts) FILTER (WHERE event_id % 3 = 0), '%Y-%m-%d %H:%M:%S') AS last_at FROM events",
    "o06_change_summary": f"""WITH {_J2}, x AS (SELECT pair_key, pair_key || ': ' || o.llm_decision || ' -> ' || n.llm_decision AS line FROM judged o JOIN again n USING (pair_key) WHERE o.llm_decision <> n.llm_decision),
        f AS (SELECT line FROM x ORDER BY pair_key LIMIT 3)
        SELECT (SELECT coalesce(string_agg(line, '; ' ORDER BY line), '') FROM f) || CASE WHEN count(*) > 3 THEN '; +' || (count(*) - 3) || ' more' ELSE '' END AS summary, count(*) AS n FROM x""",
    "o01_ranked_pairs": f"WITH {_E} SELECT pair_key, master_a_id, master_b_id, round(score, 6) AS score FROM pairs ORDER BY pairs.score DESC, pair_key LIMIT 15",
    "p10_null_split": f"WITH {_DIFF} SELECT human_decision IS NOT NULL AS human, count(*) AS n FROM lined GROUP BY 1",
    "p11_blank_rows": "SELECT doc_id FROM documents WHERE trim(regexp_replace(text, '[a-z]', '', 'g')) <> '' AND trim(lang) <> ''",
}
