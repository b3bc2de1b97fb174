"""Registered queries of the entity-resolution operators on the driver's tables, each with its SQL oracle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.config import Config
from kinweave.functions import text, vector
from kinweave.operators import graph, groups, jobs, match, notes, proposals, report, review
from kinweave.operators.graph import shared_folder
from kinweave.plans import cycle, oracles
from kinweave.plans.service import Service
from kinweave.sources import io

CFG = Config(t_auto=0.40, t_low=0.30, batch_size=2)
YES_FROM, NO_BELOW = 0.38, 0.33

_QUERIES: dict = {}


def _query(f):
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)


# --- frames from the tables ----------------------------------------------------------------------


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _documents(spark, d) -> DataFrame:
    return _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("account_id"), F.col("text").alias("account_name"), "lang", "source")


def _parts(spark, d) -> DataFrame:
    return _t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("account_id"), F.col("p_name").alias("account_name"))


def _vectors(spark, d) -> DataFrame:
    return _t(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding", F.col("label").cast("string").alias("label"))


def _pairs(spark, d, least: float | None = None) -> DataFrame:
    return match.similarity_pairs(_vectors(spark, d), least=least)


def _band(spark, d) -> DataFrame:
    return match.route(_pairs(spark, d, CFG.t_low), CFG)


def _top(spark, d) -> DataFrame:
    return jobs.ranked(_band(spark, d), CFG)


def _judged(spark, d, yes: float = YES_FROM, no: float = NO_BELOW) -> DataFrame:
    return jobs.band_judge(yes, no)(_top(spark, d))


def _judged_twice(spark, d, yes: float = 0.35, no: float = 0.31) -> tuple[DataFrame, DataFrame]:
    """The judgements and others by other bounds, from one pass over the pairs."""
    top = graph.checkpointed(_top(spark, d))
    return jobs.band_judge(YES_FROM, NO_BELOW)(top), jobs.band_judge(yes, no)(top)


def _shared(spark, d) -> tuple[DataFrame, DataFrame]:
    """(candidates, judgements) from one pass over the pairs."""
    band = graph.checkpointed(_band(spark, d))
    return band, jobs.band_judge(YES_FROM, NO_BELOW)(jobs.ranked(band, CFG))


def _edges(spark, d) -> DataFrame:
    return _pairs(spark, d, CFG.t_auto).select("pair_key", F.col("master_a_id").alias("m1"), F.col("master_b_id").alias("m2"))


def _approvals(judged: DataFrame) -> DataFrame:
    """Queue rows of every third focal are approved, of every sixth after notes."""
    number = F.col("focal_master_id").cast("long")
    rows = review.queue(judged, CFG)
    return rows.withColumns({"status": F.when(number % 3 == 0, "APPROVED").otherwise("QUEUED"), "decision": F.when(number % 6 == 0, "HUMAN_APPROVED_AFTER_NOTES")})


def _gate(judged: DataFrame) -> DataFrame:
    """Judged pairs: the admin rejects every fifth focal and approves every seventh that isn't."""
    number = F.col("focal_master_id").cast("long")
    action = F.when(number % 5 == 0, "REJECT").when(number % 7 == 0, "APPROVE")
    return judged.select("pair_key", action.alias("action")).filter("action IS NOT NULL")


def _draft(spark, d) -> DataFrame:
    band, judged = _shared(spark, d)
    return proposals.draft(band, judged, _approvals(judged))


def _final_and_gate(spark, d) -> tuple[DataFrame, DataFrame]:
    band, judged = _shared(spark, d)
    gate = _gate(judged)
    return proposals.admin_gate(proposals.draft(band, judged, _approvals(judged)), gate), gate


def _final(spark, d) -> DataFrame:
    return _final_and_gate(spark, d)[0]


def _chains(spark, d) -> DataFrame:
    """Documents whose number ends in 1 or 2 map to the number below, a chain of two steps."""
    number = F.col("doc_id").cast("long")
    rows = _t(spark, d, "documents").filter(number % 10 < 3).filter(number % 10 > 0)
    return rows.select(number.cast("string").alias("old_master_id"), (number - 1).cast("string").alias("canonical_master_id"))


def _applied(spark, d) -> DataFrame:
    return proposals.postapply(match.perfect_match(_documents(spark, d)), proposals.compress(_chains(spark, d)))


def _part_groups(spark, d) -> DataFrame:
    return match.perfect_match(_parts(spark, d))


def _operations(spark, d, kind: str) -> DataFrame:
    """Every thirteenth part is the target; a new master is the part numbered one."""
    rows = _t(spark, d, "part").filter("p_partkey % 13 = 0")
    return rows.select(
        F.col("p_partkey").cast("long").alias("sequence"),
        F.concat(F.lit("op_"), F.col("p_partkey").cast("string")).alias("operation_id"),
        F.lit(kind).alias("operation"),
        F.col("p_partkey").cast("string").alias("target_id"),
        F.lit("1" if kind in (groups.REPARENT, groups.ADD_PARENT) else None).cast("string").alias("new_master"),
    )


def _folder(spark, name: str) -> str:
    """A new folder for tables of a query, where checkpoints go too; the deployer's clean-up of that folder takes both."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _r6(df: DataFrame, *columns: str) -> DataFrame:
    """Scores at six decimals, halves away from zero as in the SQL; F.round makes two decimal numbers of each."""
    return df.withColumns({c: F.signum(c) * F.floor(F.abs(c) * 1e6 + 0.5) / 1e6 + 0.0 for c in columns})


# --- scalar functions ----------------------------------------------------------------------------


@_query
def f01_normalize_name(spark, d):
    docs = _t(spark, d, "documents").select(F.lit("doc").alias("kind"), F.col("doc_id").cast("long").alias("id"), text.normalize_name(F.col("text")).alias("normalized_name"))
    parts = _t(spark, d, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").cast("long").alias("id"), text.normalize_name(F.col("p_name")).alias("normalized_name"))
    return docs.unionByName(parts)


@_query
def f02_pair_key(spark, d):
    a, b = F.col("vec_id").cast("string"), (F.col("vec_id") + 1).cast("string")
    rows = _t(spark, d, "embeddings").select("vec_id", text.pair_key(a, b).alias("pair_key"))
    left, right = text.split_pair(F.col("pair_key"))
    return rows.select("vec_id", "pair_key", left.alias("left_id"), right.alias("right_id"))


@_query
def f03_weighted_similarity_text(spark, d):
    cols = ("p_name", "p_brand", "p_type")
    return _t(spark, d, "part").select("p_partkey", text.weighted_text(cols, {"p_name": 2.0, "p_brand": 0.5}).alias("similarity_text"))


@_query
def f04_combined_text(spark, d):
    return _t(spark, d, "part").select("p_partkey", text.combined_text(("p_name", "p_brand", "p_type")).alias("combined_text"))


def _neighbours(spark, d) -> DataFrame:
    rows = _t(spark, d, "embeddings")
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"), F.col("label").alias("other_label"))
    return rows.join(after, "vec_id")


@_query
def f05_cosine(spark, d):
    return _neighbours(spark, d).select("vec_id", F.round(vector.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


def _names(spark, d) -> DataFrame:
    return _t(spark, d, "part").select(text.normalize_name(F.col("p_name")).alias("name")).distinct()


@_query
def f06_token_sort_ratio(spark, d):
    a = _names(spark, d)
    pairs = a.join(a.withColumnRenamed("name", "other"), F.col("name") < F.col("other"))
    return pairs.select("name", "other", F.round(text.token_sort_ratio("name", "other"), 6).alias("ratio"))


@_query
def f07_combined_score(spark, d):
    cfg = Config.pandas_profile()
    one, two = F.col("vec_id").cast("string"), (F.col("vec_id") + 1).cast("string")
    emb = vector.cosine(F.col("embedding"), F.col("other"))
    pairs = _neighbours(spark, d).select("vec_id", one.alias("master_a_id"), two.alias("master_b_id"), emb.alias("score"))
    names = _vectors(spark, d).select("id", F.concat(F.lit("Vec "), "id", F.lit(" of label: "), "label").alias("account_name"))
    return _r6(match.with_fuzz(pairs, names, cfg).select("vec_id", "emb_score", "fuzz_score", "score"), "emb_score", "fuzz_score", "score")


class _Letters:
    """An embedder of one number a letter: how often it stands in the text."""

    def __call__(self, texts):
        return [[float(t.count(chr(97 + i))) for i in range(26)] for t in texts]


@_query
def x01_embed_batches(spark, d):
    """Texts through an embedding service, 64 a request."""
    texts = _parts(spark, d).select(F.col("account_id").alias("id"), text.weighted_text(["account_name"], {}).alias("similarity_text"))
    out = jobs.embed(texts, _Letters())
    return out.select("id", F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), ",").alias("letters"))


@_query
def s18_fallback_vectors(spark, d):
    """The offline embedder: equal texts get equal vectors, others other ones."""
    texts = _parts(spark, d).select(F.col("account_id").alias("id"), text.normalize_name(F.col("account_name")).alias("similarity_text"))
    out = jobs.embed(texts, jobs.hashed_embedder(16))
    same = out.groupBy(F.xxhash64("embedding").alias("h")).agg(F.count("*").alias("group_size"), F.min("similarity_text").alias("name"), F.count_distinct("similarity_text").alias("texts"), F.max(F.size("embedding")).alias("dims"))
    return same.select("name", "group_size", "texts", "dims")


@_query
def f13_context_hash(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", text.context_hash(F.col("text")).alias("context_hash"))


@_query
def f16_json_decode(spark, d):
    k = F.from_json("props", "k long")["k"]
    return _t(spark, d, "events").select("event_id", k.alias("k"), F.to_json(F.struct(k.alias("k"))).alias("props"))


@_query
def f18_csv_list(spark, d):
    rows = _t(spark, d, "part").select("p_partkey", F.concat(F.lit(" ,"), F.regexp_replace("p_name", " ", " , "), F.lit(",")).alias("listed"))
    return rows.select("p_partkey", F.array_join(text.csv_list(F.col("listed")), "+").alias("items"))


# --- matching ------------------------------------------------------------------------------------

_GROUP = ["account_id", "master_account_id", "group_size", "is_master", "is_dupe", "stage_rule"]


@_query
def d01_perfect_match(spark, d):
    return match.perfect_match(_documents(spark, d)).select(*_GROUP)


@_query
def d01_perfect_match_parts(spark, d):
    return _part_groups(spark, d).select(*_GROUP)


@_query
def d02_apply_mapping(spark, d):
    return _applied(spark, d).select(*_GROUP)


@_query
def d03_masters_slice(spark, d):
    return match.masters(match.perfect_match(_documents(spark, d))).select("account_id", "group_size", "lang", "source")


@_query
def d04_similarity_pairs(spark, d):
    decided = _edges(spark, d).filter((F.col("m1").cast("long") + F.col("m2").cast("long")) % 2 == 0)
    return _r6(match.similarity_pairs(_vectors(spark, d), decided), "score")


@_query
def d05_route_candidates(spark, d):
    return _r6(match.route(_pairs(spark, d), CFG), "score")


@_query
def a06_route_counts(spark, d):
    return match.route_counts(_vectors(spark, d), CFG)


@_query
def j15_scores_of(spark, d):
    """The score of each vector with the next one where that is in the upper band, else 0."""
    a, b = F.col("vec_id").cast("string"), (F.col("vec_id") + 1).cast("string")
    wanted = _t(spark, d, "embeddings").select("vec_id", text.pair_key(a, b).alias("pair_key"))
    return _r6(match.scores_of(wanted, _pairs(spark, d, CFG.t_low)), "score")


@_query
def d25_incremental(spark, d):
    vectors = _vectors(spark, d)
    changed = vectors.filter(F.col("id").cast("long") % 10 == 0)
    twist = F.transform("embedding", lambda x: -x).cast("array<float>")
    before = vectors.withColumn("embedding", F.when(F.col("id").cast("long") % 10 == 0, twist).otherwise(F.col("embedding")))
    old = match.similarity_pairs(before)
    return _r6(match.incremental_pairs(old, vectors, changed.select("id")), "score")


# --- jobs and review -----------------------------------------------------------------------------


@_query
def w01_llm_top_n(spark, d):
    return _r6(_top(spark, d).select("pair_key", "master_a_id", "master_b_id", "score", "rank"), "score")


@_query
def w05_batches(spark, d):
    return _top(spark, d).groupBy("master_a_id", "batch_index").agg(F.count("*").alias("n"))


@_query
def d06_llm_jobs(spark, d):
    work = jobs.build(_top(spark, d), _vectors(spark, d).select("id", "label"))
    listed = F.array_join(F.transform("candidates", lambda c: F.concat_ws(":", c["candidate_master_id"], c["candidate_label"])), ",")
    return work.select("focal_master_id", "batch_index", "focal_label", listed.alias("candidates"))


@_query
def d07_judge_offline(spark, d):
    return _r6(_judged(spark, d).drop("llm_reason"), "score")


class _Banded:
    """The offline judge behind the protocol; leaves reasons, and the confidence of unsure ones, to the defaults."""

    @staticmethod
    def judge(focal, candidates, context):
        out = []
        for c in candidates:
            s = c["score"]
            row = {"candidate_master_id": c["candidate_master_id"], "score": s}
            if s >= YES_FROM or s < NO_BELOW:
                row |= {"decision": "YES" if s >= YES_FROM else "NO", "confidence": round(2 * s, 6)}
            out.append(row)
        return out


@_query
def x04_judge_protocol(spark, d):
    work = jobs.build(_top(spark, d), _vectors(spark, d).select("id", "label"))
    return _r6(jobs.judge(work, _Banded.judge).drop("request_id", "token_usage_json"), "score", "llm_confidence")


class _Metered:
    """A judge that tells what a request cost."""

    @staticmethod
    def judge(focal, candidates, context):
        said = [{"candidate_master_id": c["candidate_master_id"], "decision": "NO", "confidence": 1.0, "reason": "strict"} for c in candidates]
        return said, {"request_id": f"r-{focal}", "token_usage": {"candidates": len(candidates)}}


@_query
def f14_stored_results(spark, d):
    """Judgements as stored, with what each request cost, and read back answer by answer; focals without answers leave nothing."""
    work = jobs.build(_top(spark, d), _vectors(spark, d).select("id", "label")).filter("batch_index = 0")
    stored = jobs.results(jobs.judge(work, _Metered.judge), model="strict")
    none = stored.withColumns({"results": F.array().cast(stored.schema["results"].dataType), "focal_master_id": F.lit("nobody")})
    out = jobs.exploded(stored.unionByName(none))
    return out.select("pair_key", "focal_master_id", "llm_decision", "llm_reason", "prompt_version", "model_name", "request_id", "token_usage_json", F.col("decided_at").isNotNull().alias("stamped"))


@_query
def f15_prompts(spark, d):
    work = jobs.prompts(jobs.build(_top(spark, d), _vectors(spark, d).select("id", "label")))
    asked = F.from_json("prompt_json", "focal struct<id:string,label:string>, candidates array<struct<rank:int,candidate_master_id:string,candidate_label:string>>")
    out = work.withColumn("p", asked).select("focal_master_id", "batch_index", F.explode("p.candidates").alias("c"), F.col("p.focal").alias("f"))
    return out.select("focal_master_id", "batch_index", F.col("f.id").alias("asked_id"), F.col("f.label").alias("focal_label"), F.col("c.rank").alias("rank"), F.col("c.candidate_master_id").alias("candidate_master_id"), F.col("c.candidate_label").alias("candidate_label"))


@_query
def o05_focals_in_order(spark, d):
    return report.placed(_top(spark, d).select("master_a_id").distinct(), F.col("master_a_id"))


def _judge_again(rows: DataFrame) -> DataFrame:
    """The offline judge on a rerun: a pair with a note that starts with look needs less for a yes."""
    look = F.coalesce(F.col("context_used").startswith("look"), F.lit(False))
    decision = F.when(F.col("score") >= F.when(look, 0.34).otherwise(YES_FROM), "YES").when(F.col("score") < NO_BELOW, "NO").otherwise("NEEDS_CONFIRMATION")
    ids = [F.col("master_a_id").alias("focal_master_id"), F.col("master_b_id").alias("candidate_master_id")]
    return rows.select(*ids, "pair_key", "score", decision.alias("llm_decision"), F.round(F.col("score") * 2, 6).alias("llm_confidence"), F.lit("again").alias("llm_reason"))


@_query
def d08_rerun(spark, d):
    """All stored answers around some focals, judged again with notes, and what that makes of the queue."""
    judged = graph.checkpointed(_judged(spark, d))
    stored = jobs.results(judged).withColumn("run_id", F.lit("1"))
    older = jobs.results(judged.withColumn("score", F.lit(0.0))).withColumns({"run_id": F.lit("0"), "decided_at": F.lit(None).cast("timestamp")})
    cfg = CFG.with_(rerun_scope="component", rerun_focals=("0", "20", "40", "60", "80"), global_notes="everyone", focal_notes={"20": "look twice", "31": "look once"}, auto_approve_confidence=0.70)
    again = jobs.rejudge(stored.unionByName(older), _vectors(spark, d).select("id", "label"), cfg, _judge_again)
    queued = review.queue(judged, CFG).select("pair_key", F.lit("ann").alias("reviewer"), F.lit("see").alias("notes"), F.lit(1).alias("enqueued_at"))
    twice = queued.unionByName(queued.withColumns({"reviewer": F.lit("bob"), "enqueued_at": F.lit(2)}))
    return review.rerun_updates(again, twice, cfg).select("pair_key", "llm_decision", "llm_confidence", "llm_reason", "context_used", "context_hash", "status", "decision", "reviewer")


@_query
def d08_rerun_notes(spark, d):
    """Notes by precedence around some focals."""
    judged = graph.checkpointed(_judged(spark, d))
    number = F.col("focal_master_id").cast("long")
    chosen = judged.filter(number % 20 == 0).select(F.col("focal_master_id").alias("id"))
    rows = judged.join(jobs.seeded(judged, chosen, "focal_master_id", "candidate_master_id").withColumnRenamed("id", "focal_master_id"), "focal_master_id", "left_semi")
    pair_notes = judged.filter(number % 3 == 0).select("pair_key", F.concat(F.lit("pair "), F.col("pair_key")).alias("note"))
    focal_notes = judged.filter(number % 2 == 0).select("focal_master_id", F.concat(F.lit("focal "), F.col("focal_master_id")).alias("note")).distinct()
    return jobs.notes_for(rows, pair_notes, focal_notes, "everyone").select("pair_key", "context_used", "context_hash")


@_query
def d09_review_queue(spark, d):
    return _r6(review.queue(_judged(spark, d), CFG).select("pair_key", "score", "llm_decision", "queue_reason", "status"), "score")


@_query
def d10_rerun_updates(spark, d):
    judged, rerun = _judged_twice(spark, d)
    queued = review.queue(judged, CFG).select("pair_key", F.lit("ann").alias("reviewer"), F.lit("see").alias("notes"), F.lit(1).alias("enqueued_at"))
    cfg = CFG.with_(auto_approve_confidence=0.72)
    return review.rerun_updates(rerun, queued, cfg).select("pair_key", "llm_decision", "status", "decision", "reviewer", "notes")


@_query
def d11_decision_updates(spark, d):
    rows = _t(spark, d, "events").select(F.when(F.col("user_id") % 9 != 0, F.col("user_id").cast("string")).alias("pair_key"), F.when(F.col("event_id") % 4 != 0, F.col("event_type")).alias("decision"), "event_id")
    return review.decision_updates(rows, CFG)


@_query
def d23_decision_changes(spark, d):
    return review.decision_changes(*_judged_twice(spark, d))


def _diff(spark, d) -> DataFrame:
    before, after = _judged_twice(spark, d)
    return review.rerun_diff(before, after.filter(F.col("focal_master_id").cast("long") % 2 == 0))


@_query
def d29_rerun_diff(spark, d):
    return _diff(spark, d)


@_query
def d27_flat_decisions(spark, d):
    label = _vectors(spark, d).select("id", "label")
    out = _judged(spark, d).drop("llm_reason")
    for side in ("focal", "candidate"):
        out = out.join(label.select(F.col("id").alias(f"{side}_master_id"), F.col("label").alias(f"{side}_name")), f"{side}_master_id", "left")
    return _r6(out, "score")


def _human(spark, d) -> DataFrame:
    judged = graph.checkpointed(_judged(spark, d))
    number = F.col("focal_master_id").cast("long")
    return review.human_decisions(judged, judged.filter(number % 4 == 0), judged.filter(number % 6 == 0))


@_query
def d28_human_decisions(spark, d):
    return _human(spark, d).select("pair_key", "human_decision", "final_decision", "lineage")


@_query
def d30_resolved_lineage(spark, d):
    return report.value_counts(review.split_resolved(_human(spark, d)).withColumn("key", F.concat_ws(":", "state", "lineage")), "key")


@_query
def v11_decision_history(spark, d):
    return report.history(_diff(spark, d), _human(spark, d))


@_query
def a07_decision_counts(spark, d):
    return report.decision_counts(_judged(spark, d))


@_query
def p15_decision_view(spark, d):
    shown = _judged(spark, d).filter(F.col("llm_decision").isin("YES", "NEEDS_CONFIRMATION"))
    out = report.placed(shown, F.desc("llm_confidence"), F.desc("score"), F.col("pair_key"))
    return out.select("pair_key", "llm_decision", "place")


_PROPOSED = ["pair_key", "m1", "m2", "source", "score", "reason", "confidence"]

# --- proposals and ledgers -----------------------------------------------------------------------


@_query
def d12_proposals(spark, d):
    return _r6(_draft(spark, d).select(*_PROPOSED), "score", "confidence")


@_query
def d13_admin_gate(spark, d):
    return _r6(_final(spark, d).select(*_PROPOSED), "score", "confidence")


@_query
def d14_preview(spark, d):
    """The preview as it is written and read back: proposals, chosen columns, time."""
    base = _folder(spark, "preview")
    cfg = CFG.with_(run_id="p1", similarity_columns=("a", "b"))
    io.append(proposals.preview(_final(spark, d), cfg), base, "proposals")
    out = io.read(spark, base, "proposals", run_id="p1")
    return out.select("pair_key", "m1", "m2", "source", "reason", "prompt_version", "column_config", "run_id", F.col("preview_at").isNotNull().alias("stamped"))


@_query
def d15_decision_ledger(spark, d):
    rows = proposals.decision_rows(*_final_and_gate(spark, d))
    return _r6(rows.select("pair_key", "source", "score", "reason", "decision"), "score")


@_query
def d16_mapping_delta(spark, d):
    return proposals.mapping_delta(_final(spark, d))


@_query
def w03_latest_per_key(spark, d):
    rows = io.latest(_t(spark, d, "events"), ["user_id"], F.col("ts"), F.col("event_id"))
    return rows.select("user_id", "event_id", "event_type")


@_query
def s09_upsert_keep_last(spark, d):
    rows = _t(spark, d, "events").select("user_id", "event_id", "event_type")
    out = io.upsert(rows.filter("event_id % 2 = 0"), rows.filter("event_id % 2 = 1"), ["user_id"], F.col("event_id"))
    return out


@_query
def s10_append_roundtrip(spark, d):
    """The decision ledger of two runs, one of them written twice, read back."""
    folder = _folder(spark, "ledger")
    rows = _t(spark, d, "nation").select(F.col("n_name").alias("pair_key"), F.col("n_nationkey").cast("double").alias("score"), F.lit("YES").alias("decision"), (F.col("n_nationkey") % 2).cast("string").alias("run_id"))
    io.append(rows, folder, "decisions")
    io.append(rows.filter("run_id = '1'"), folder, "decisions")
    return io.read(spark, folder, "decisions").select("pair_key", "score", "decision", "run_id")


# --- graph ---------------------------------------------------------------------------------------


@_query
def g01_components(spark, d):
    return graph.connected_components(_edges(spark, d), "m1", "m2")


@_query
def g02_compress_mapping(spark, d):
    return proposals.compress(_chains(spark, d))


@_query
def g03_component_sets(spark, d):
    parts = graph.connected_components(_edges(spark, d), "m1", "m2")
    return parts.groupBy("root").agg(F.array_join(F.sort_array(F.collect_set("node")), ",").alias("members"))


def _seeds(spark, d) -> DataFrame:
    return _vectors(spark, d).filter(F.col("id").cast("long") < 50).select("id")


@_query
def g04_seeded_component(spark, d):
    return jobs.seeded(_edges(spark, d), _seeds(spark, d), "m1", "m2")


@_query
def g05_scope_filter(spark, d):
    band = graph.checkpointed(_band(spark, d))
    related = band.filter(F.col("score") >= CFG.t_auto).select("master_a_id", "master_b_id")
    out = None
    for scope in ("all", "foci", "foci_related"):
        own = jobs.scoped(band, scope, _seeds(spark, d), related).select(F.lit(scope).alias("scope"), "pair_key")
        out = own if out is None else out.unionByName(own)
    return out


@_query
def g06_queue_component(spark, d):
    queued = graph.checkpointed(review.queue(_judged(spark, d), CFG))
    reached = jobs.seeded(queued, _seeds(spark, d), "focal_master_id", "candidate_master_id")
    return reached.intersect(queued.select(F.col("focal_master_id").alias("id")))


@_query
def g07_affected_accounts(spark, d):
    judged, moved = _judged_twice(spark, d, 0.36, 0.33)
    return review.affected_accounts(review.decision_changes(judged, moved), judged.filter("llm_decision = 'YES'"))


@_query
def g08_transitive_yes(spark, d):
    out = review.transitive_yes(_judged(spark, d, 0.345, 0.33))
    return out.select("pair_key", "llm_decision", "llm_reason")


# --- tables after a run, groups ------------------------------------------------------------------


@_query
def d17_postapply(spark, d):
    return _applied(spark, d).select(*_GROUP)


@_query
def d17_gold(spark, d):
    return proposals.gold(_applied(spark, d)).select("account_id", "master_account_id", "group_size", "is_dupe", "lang")


@_query
def a10_merge_kpis(spark, d):
    return report.merge_kpis(match.perfect_match(_documents(spark, d)), _applied(spark, d))


@_query
def a05_singletons(spark, d):
    return report.singletons(match.perfect_match(_documents(spark, d)))


def _after(spark, d, kind: str) -> DataFrame:
    matched = _part_groups(spark, d)
    over = groups.overrides(matched, _operations(spark, d, kind))
    none = spark.createDataFrame([], "old_master_id string, canonical_master_id string")
    return match.apply_mapping(matched, none, over).select("account_id", "master_account_id", "group_size", "is_master")


@_query
def d18_remove_member(spark, d):
    return _after(spark, d, groups.REMOVE)


@_query
def d19_reparent_member(spark, d):
    return _after(spark, d, groups.REPARENT)


@_query
def d20_add_parent(spark, d):
    """Singletons alone get a parent; the operation doesn't fit other parts."""
    matched = _part_groups(spark, d)
    ops = groups.allowed(matched.withColumn("is_master", F.coalesce(F.col("is_master") | (F.col("account_id") == "1"), F.lit(False))), _operations(spark, d, groups.ADD_PARENT))
    none = spark.createDataFrame([], "old_master_id string, canonical_master_id string")
    return match.apply_mapping(matched, none, groups.overrides(matched, ops)).select("account_id", "master_account_id", "group_size", "is_master")


@_query
def d21_breakup_group(spark, d):
    return _after(spark, d, groups.BREAK_UP)


@_query
def d22_operation_log(spark, d):
    ops = _operations(spark, d, groups.BREAK_UP).unionByName(_operations(spark, d, "sing"))
    return groups.log(_part_groups(spark, d), ops).select("operation_id", "operation", "status", "error", "members_affected")


@_query
def v16_allowed_operations(spark, d):
    ops = _operations(spark, d, groups.REMOVE).unionByName(_operations(spark, d, groups.REPARENT)).unionByName(_operations(spark, d, groups.BREAK_UP))
    return groups.allowed(_part_groups(spark, d), ops).select("operation", "target_id")


@_query
def d31_drilldown(spark, d):
    return report.drilldown(_part_groups(spark, d), "1")


@_query
def d31_pairs_of(spark, d):
    vectors = _vectors(spark, d)
    return _r6(match.pairs_of(vectors, vectors.filter("id = '7'")), "score")


@_query
def d32_adjustments(spark, d):
    ops = None
    for kind in (groups.REMOVE, groups.REPARENT, groups.ADD_PARENT, groups.BREAK_UP, "sing"):
        own = _operations(spark, d, kind).withColumn("operation_id", F.concat_ws("-", "operation_id", F.lit(kind)))
        ops = own if ops is None else ops.unionByName(own)
    return report.adjustment_texts(ops)


@_query
def d33_notes_context(spark, d):
    rows = _t(spark, d, "conversations").select(F.when(F.col("conv_id") == 0, "GLOBAL").otherwise("FOCAL").alias("scope"), F.col("conv_id").cast("string").alias("focal_master_id"), F.col("text").alias("note"), "turn")
    return notes.render(rows, ["turn"])


@_query
def s22_notes_store(spark, d):
    rows = _t(spark, d, "conversations").select(F.lit("FOCAL").alias("scope"), (F.col("conv_id") % 7).cast("string").alias("focal_master_id"), F.concat(F.lit(" !"), "role", F.lit(" ")).alias("note"), (F.col("conv_id") * 1000 + F.col("turn")).alias("added_at"))
    return notes.store(rows.limit(0), rows, F.col("added_at"))


@_query
def d35_status_report(spark, d):
    return report.status({"full_match": match.perfect_match(_documents(spark, d)), "candidates": _band(spark, d), "judged": _judged(spark, d)})


def _vector_accounts(spark, d) -> DataFrame:
    return _vectors(spark, d).select(F.col("id").alias("account_id"), F.concat_ws(" ", F.lit("vec"), "id").alias("account_name"))


@_query
def d37_full_cycle(spark, d):
    """One cycle over vectors as accounts named by their id: exact groups, stored embeddings, judging, approvals, admin, gold."""
    judged = _judged(spark, d)
    state = {"review_queue": _approvals(judged), "admin_gate": _gate(judged)}
    judge = jobs.band_judge(YES_FROM, NO_BELOW)
    out = cycle.run_cycle(_vector_accounts(spark, d), CFG.with_(keep_rejected=False), jobs.Stored(_vectors(spark, d)), judge, state)
    return out["gold"].select("account_id", "group_size", "is_dupe")


def _service(spark, d) -> Service:
    return Service(spark, _folder(spark, "tables"), jobs.Stored(_vectors(spark, d)), jobs.band_judge(YES_FROM, NO_BELOW))


_PARAMS = {"RUN_ID": "r1", "T_AUTO": "0.40", "T_LLM_LOW": "0.30", "LLM_BATCH_SIZE": "2", "KEEP_REJECTED": "false", "FINALIZE": "true"}


@_query
def d36_router(spark, d):
    """Operations between tables: a pipeline run, people's decisions on queued pairs, finalising."""
    own = _service(spark, d)
    queue = own.run("FULL_PIPELINE", {**_PARAMS, "accounts": _vector_accounts(spark, d)})["review_queue"]
    rest = F.col("focal_master_id").cast("long") % 3
    said = queue.select("pair_key", F.when(rest == 0, "YES").when(rest == 1, "NO").alias("decision"), F.lit("ann").alias("reviewer"), F.lit(None).cast("string").alias("notes"))
    own.run("UPDATE_DECISIONS", {**_PARAMS, "updates": said.filter("decision IS NOT NULL")})
    return own.run("finalize", _PARAMS)["gold"].select("account_id", "group_size", "is_dupe", "run_id")


@_query
def s03_run_partition(spark, d):
    """Only the partition of one run is read."""
    base = _folder(spark, "runs")
    rows = _t(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("old_master_id"), F.lit("1").alias("canonical_master_id"), (F.col("s_suppkey") % 5).cast("string").alias("run_id"), F.lit("x").alias("step"))
    io.append(rows, base, "mapping")
    return io.read(spark, base, "mapping", run_id="3").select("old_master_id", "canonical_master_id", "run_id")


@_query
def s04_csv_roundtrip(spark, d):
    path = _folder(spark, "csv")
    io.write_csv(_t(spark, d, "nation").select("n_nationkey", "n_name"), path)
    return io.read_csv(spark, path, ("n_nationkey", "n_name")).select("n_nationkey", "n_name")


@_query
def s12_status_events(spark, d):
    """The queue after people's decisions: the last event of each pair."""
    judged = review.queue(_judged(spark, d), CFG).withColumns({"reviewer": F.lit(None).cast("string"), "notes": F.lit(None).cast("string"), "at": F.lit(1)})
    rest = F.col("focal_master_id").cast("long") % 3
    said = judged.select("pair_key", F.when(rest == 0, "YES").when(rest == 1, "NO").alias("decision"), F.lit("ann").alias("reviewer"), F.lit("ok").alias("notes"))
    events = review.status_events(judged, review.decision_updates(said, CFG)).withColumn("at", F.lit(2))
    return review.current_status(judged.unionByName(events), F.col("at")).select("pair_key", "status", "reviewer", "notes")


@_query
def p01_project(spark, d):
    return io.project(_t(spark, d, "supplier"), ["s_suppkey", "nothing", "s_name"])


@_query
def p02_ensure_columns(spark, d):
    return io.ensure_columns(_t(spark, d, "region").select("r_regionkey", "r_name"), {"r_name": "int", "score": "double"})


@_query
def d17_effective_mapping(spark, d):
    """Every second number of a two-step chain is detached by a later run."""
    first = _chains(spark, d).withColumns({"run_id": F.lit("1"), "n": F.lit(1)})
    number = F.col("old_master_id").cast("long")
    later = first.filter(number % 20 == 2).withColumns({"canonical_master_id": F.col("old_master_id"), "run_id": F.lit("2"), "n": F.lit(2)})
    return proposals.effective(first.unionByName(later), F.col("n"), F.col("run_id"))


def _answers(rows: DataFrame) -> DataFrame:
    number = F.col("focal_master_id").cast("long") % 4
    answer = F.when(number == 0, " Y ").when(number == 1, "n").otherwise("s")
    return rows.select("pair_key", answer.alias("answer"), F.when(number < 2, F.concat(F.lit("seen "), "focal_master_id")).alias("note"), F.lit("ann").alias("reviewer"))


@_query
def d34_review_answers(spark, d):
    """A reviewer's answers to all queued pairs: what is approved, and the notes that are left."""
    queued = review.queue(_judged(spark, d), CFG)
    approved, noted = review.batch_answers(queued, _answers(queued))
    one = approved.select(F.lit("PAIR").alias("kind"), F.col("pair_key").alias("key"), F.concat_ws(":", "status", "decision", "reviewer", "notes").alias("what"))
    return one.unionByName(noted.select(F.col("scope").alias("kind"), F.col("focal_master_id").alias("key"), F.col("note").alias("what")))


@_query
def d34_admin_answers(spark, d):
    drafted = proposals.strongest(_draft(spark, d))
    answers = _answers(drafted.withColumn("focal_master_id", F.col("m1")))
    return review.admin_answers(drafted, answers).select("pair_key", "focal_master_id", "candidate_master_id", "action", "reviewer", "notes")


@_query
def v04_edit_rows(spark, d):
    rows = io.without(_t(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("n_nationkey"), "n_name"), "n_nationkey", "3", "7")
    return io.with_blank(rows, n_name="NEWLAND")


@_query
def v02_rejudge_focal(spark, d):
    """A rerun asks once for each focal, with all its pairs; the answers tell how many there were."""
    stored = jobs.results(_judged(spark, d)).withColumn("run_id", F.lit("1"))
    out = jobs.rejudge(stored, _vectors(spark, d).select("id", "label"), CFG, _Metered)
    return out.select("pair_key", "request_id", "token_usage_json", "llm_decision")


@_query
def v08_change_preview(spark, d):
    judged, moved = _judged_twice(spark, d, 0.36, 0.33)
    changes = review.decision_changes(judged, moved)
    return report.change_preview(changes, review.affected_accounts(changes, judged.filter("llm_decision = 'YES'")), match.perfect_match(_vector_accounts(spark, d)))


@_query
def v12_queue_diagnostics(spark, d):
    return review.diagnostics(review.queue(_judged(spark, d), CFG), _diff(spark, d), _human(spark, d))


@_query
def v15_applied_merges(spark, d):
    names = _vectors(spark, d).select("id", F.concat_ws(" ", F.lit("label"), "label").alias("account_name"))
    return report.applied_merges(proposals.mapping_delta(_edges(spark, d)), names.filter(F.col("id").cast("long") % 3 > 0))


@_query
def g08_transitive_yes_affected(spark, d):
    """Only pairs that touch an affected id turn."""
    out = review.transitive_yes(_judged(spark, d, 0.345, 0.33), _vectors(spark, d).filter(F.col("id").cast("long") % 2 == 0).select("id"))
    return out.select("pair_key", "llm_decision", "llm_reason")


# --- edits, previews, summaries ------------------------------------------------------------------


def _edited(spark, d) -> DataFrame:
    """Edits of every other focal; those of numbers 1 and 2 modulo 4 aren't valid."""
    rest = F.col("focal_master_id").cast("long") % 4
    decision = F.when(rest == 0, "YES").when(rest == 1, "MAYBE").when(rest == 2, "NO")
    judged = _judged(spark, d)
    edits = judged.select("pair_key", decision.alias("llm_decision"), F.when(rest == 2, 1.5).otherwise(0.99).alias("llm_confidence"))
    return review.apply_edits(judged, edits.filter("llm_decision IS NOT NULL"))


@_query
def v07_edit_decisions(spark, d):
    return _edited(spark, d).select("pair_key", "llm_decision", "llm_confidence")


@_query
def d26_finalize_edited(spark, d):
    accounts = _vector_accounts(spark, d)
    delta = proposals.mapping_delta(proposals.edited(_edited(spark, d)))
    return proposals.gold(proposals.postapply(match.perfect_match(accounts), delta)).select("account_id", "group_size", "is_dupe")


@_query
def v09_rerun_preview(spark, d):
    names = _vectors(spark, d).select("id", F.concat_ws(" ", F.lit("label"), "label").alias("account_name"))
    return review.rerun_preview(_judged(spark, d), _seeds(spark, d), names)


@_query
def a09_last_adjustment(spark, d):
    rows = _t(spark, d, "events").select("ts", F.when(F.col("event_id") % 3 == 0, "completed").otherwise("failed").alias("status"))
    return report.last_adjustment(rows, "ts").withColumn("last_at", F.date_format("last_at", "yyyy-MM-dd HH:mm:ss"))


@_query
def o06_change_summary(spark, d):
    return report.change_summary(review.decision_changes(*_judged_twice(spark, d)))


@_query
def o01_ranked_pairs(spark, d):
    """The best fifteen pairs by score and key."""
    return _r6(_pairs(spark, d, CFG.t_low).orderBy(F.desc("score"), "pair_key").limit(15), "score")


@_query
def p10_null_split(spark, d):
    return report.value_counts(_human(spark, d).withColumn("human", F.col("human_decision").isNotNull()), "human")


@_query
def p11_blank_rows(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", "lang", F.regexp_replace("text", "[a-z]", "").alias("rest"))
    return rows.filter("trim(rest) <> '' AND trim(lang) <> ''").select("doc_id")
