import datetime as dt
import glob

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from kinweave import __main__ as cli
from kinweave.config import Config, parse_accounts
from kinweave.functions import text, vector
from kinweave.operators import graph, groups, jobs, match, notes, proposals, report, review
from kinweave.plans import cycle
from kinweave.plans.service import Service
from kinweave.sources import io

NINE = [
    ("a1", "ACME Corp"), ("a2", "ACME Corp"), ("a3", "Acme Corporation"), ("f1", "Globex International Logistics"), ("b1", "Globex, LLC"),
    ("v1", "Unrelated Co"), ("x2", "Loblaws Ltd"), ("d1", "Microsoft"), ("d2", "Microsoft Corporation"),
]


def accounts(spark, rows):
    return spark.createDataFrame(rows, "account_id string, account_name string")


def test_normalize_name(spark):
    given = ["ACME, Inc.", "  A.C.M.E. Corp.", "--", "Ünïcode\tCo", None]
    df = spark.createDataFrame([(x,) for x in given], "x string").select(text.normalize_name(F.col("x")).alias("n"))
    assert [r.n for r in df.collect()] == ["acme inc", "a c m e corp", "", "n code co", None]


def test_pair_keys(spark):
    df = spark.createDataFrame([("a3", "a1"), ("9", "10"), ("x", None)], "a string, b string")
    assert [r[0] for r in df.select(text.pair_key(F.col("a"), F.col("b"))).collect()] == ["a1|a3", "10|9", None]
    left, right = text.split_pair(F.col("k"))
    rows = spark.createDataFrame([("a|b|c",), ("bad",)], "k string").select(left, right).collect()
    assert [tuple(r) for r in rows] == [("a", "b|c"), ("bad", None)]


def test_texts(spark):
    df = spark.createDataFrame([("Acme", "Retail", None)], "account_name string, industry string, location string")
    cols = ("account_name", "industry", "location")
    assert df.select(text.weighted_text(cols, {"account_name": 2.0, "industry": 0.5})).first()[0] == "acme acme retail"
    assert df.select(text.combined_text(cols)).first()[0] == "acme retail"
    notes_ = spark.createDataFrame([("",), (None,), ("note",)], "x string").select(text.context_hash(F.col("x")))
    assert [r[0] for r in notes_.collect()] == ["e3b0c44298fc", "e3b0c44298fc", "edb465624291"]


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [("corp acme", "acme corp", 1.0), ("globex llc", "globex l l c", 0.818182), ("abc", "xyz", 0.0), ("", "", 1.0), ("acme corp", "acme corporation", 0.72), ("microsoft", "microsoft corporation", 0.6), ("globex llc", "globex international logistics", 0.5)],
)
def test_token_sort_ratio(spark, a, b, want):
    got = spark.createDataFrame([(a, b)], "a string, b string").select(text.token_sort_ratio("a", "b")).first()[0]
    assert got == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize(("a", "b", "want"), [([1, 0], [0, 1], 0), ([1, 2], [2, 4], 1), ([], [1], 0), ([0, 0], [1, 1], 0), ([1, 2], [3], 1), (None, [1], 0), ([1, 1], [-1, -1], -1)])
def test_cosine(spark, a, b, want):
    df = spark.createDataFrame([[None if v is None else [float(x) for x in v] for v in (a, b)]], "a array<float>, b array<float>")
    assert df.select(vector.cosine(F.col("a"), F.col("b"))).first()[0] == pytest.approx(want)


def test_all_pairs_by_tiles(spark):
    rng = np.random.default_rng(0)
    rows = [(str(i), rng.standard_normal(8).tolist()) for i in range(57)]
    df = spark.createDataFrame(rows, "id string, embedding array<double>")
    by = dict(rows)
    got = {(r.a_id, r.b_id): r.score for r in vector.all_pairs(df, tile_rows=10).collect()}
    assert len(got) == 57 * 56 // 2
    for (a, b), s in got.items():
        x, y = np.array(by[a]), np.array(by[b])
        assert a < b and s == pytest.approx(x @ y / np.sqrt(x @ x * (y @ y)))
    assert {k for k, s in got.items() if s >= 0.3} == {(r.a_id, r.b_id) for r in vector.all_pairs(df, 10, 0.3).collect()}
    mixed = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0]), ("c", None)], "id string, embedding array<double>")
    assert {(r.a_id, r.b_id): round(r.score, 6) for r in vector.all_pairs(mixed).collect()} == {("a", "b"): 1.0, ("a", "c"): 0.0, ("b", "c"): 0.0}


def test_perfect_match_of_the_demo(spark):
    got = match.perfect_match(accounts(spark, [*NINE, ("z", None)]))
    assert match.masters(got).count() == 8
    assert {(r.account_id, r.group_size, r.is_dupe, r.stage_rule) for r in got.filter("master_account_id = 'a1'").collect()} == {("a1", 2, True, "PERFECT"), ("a2", 2, True, "PERFECT")}


def test_routes_take_both_bounds(spark):
    df = spark.createDataFrame([(0.95,), (0.9499,), (0.70,), (0.6999,)], "score double").select(match.route_of(F.col("score"), Config()))
    assert [r[0] for r in df.collect()] == ["AUTO_YES_95", "LLM", "LLM", "AUTO_NO"]


def test_review_predicate(spark):
    rows = [("NEEDS_CONFIRMATION", 0.9, 0.1, 1), ("YES", 0.69, 0.9, 1), ("YES", 0.70, 0.9, 0), ("NO", 0.59, 0.65, 1), ("NO", 0.59, 0.64, 0), ("NO", 0.60, 0.9, 0), (None, None, None, 0)]
    df = spark.createDataFrame(rows, "llm_decision string, llm_confidence double, score double, want int")
    assert df.filter(review.needs_review(Config()) != (F.col("want") == 1)).count() == 0


@pytest.mark.parametrize("small", [0, 3, 1000])
def test_components_by_either_way(spark, small):
    rng = np.random.default_rng(small)
    rows = [(int(x), int(y)) for x, y in rng.integers(0, 60, (40, 2))]
    edges = spark.createDataFrame([*rows, (5, None), (99, 99)], "a long, b long").repartition(3)
    root = {x: x for r in rows for x in r} | {99: 99}
    for _ in range(60):
        for x, y in rows:
            root[x] = root[y] = min(root[x], root[y])
    assert {(r.node, r.root) for r in graph.connected_components(edges, small=small).collect()} == set(root.items())


def test_components(spark):
    edges = spark.createDataFrame([("c", "b"), ("b", "a"), ("x", "y"), ("s", "s"), ("n", None)], "m1 string, m2 string")
    assert {(r.node, r.root) for r in graph.connected_components(edges, "m1", "m2").collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x"), ("s", "s")}
    assert {(r.old_master_id, r.canonical_master_id) for r in proposals.mapping_delta(edges).collect()} == {("b", "a"), ("c", "a"), ("y", "x")}
    path = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert graph.connected_components(path).select("root").distinct().collect()[0][0] == 0
    assert graph.connected_components(edges.limit(0), "m1", "m2").count() == 0


def test_chain_over_runs_and_detachment(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("c", "b", t, "1"), ("b", "a", t + dt.timedelta(1), "2")]
    kind = "old_master_id string, canonical_master_id string, updated_at timestamp, run_id string"
    pairs = lambda df: {(r.old_master_id, r.canonical_master_id) for r in df.collect()}
    assert pairs(proposals.effective(spark.createDataFrame(rows, kind), F.col("updated_at"))) == {("b", "a"), ("c", "a")}
    rows.append(("c", "c", t + dt.timedelta(2), "3"))
    assert pairs(proposals.effective(spark.createDataFrame(rows, kind), F.col("updated_at"))) == {("b", "a"), ("c", "c")}


def test_group_operations(spark):
    matched = match.perfect_match(accounts(spark, [("1", "x"), ("2", "x"), ("3", "x"), ("4", "y")]))
    ops = spark.createDataFrame([(1, "o1", "remove_member", "2", None), (2, "o2", "reparent_member", "2", "4"), (3, "o3", "breakup_group", "1", None), (4, "o4", "juggle", "1", None), (5, "o5", "reparent_member", "3", None)], "sequence int, operation_id string, operation string, target_id string, new_master string")
    assert {(r.account_id, r.master_account_id) for r in groups.overrides(matched, ops).collect()} == {("2", "2"), ("3", "3")}
    assert {(r.account_id, r.master_account_id) for r in groups.overrides(matched, ops.filter("sequence < 3")).collect()} == {("2", "4")}
    log = {r.operation_id: (r.status, r.members_affected) for r in groups.log(matched, ops).collect()}
    assert log == {"o1": ("completed", 1), "o2": ("completed", 1), "o3": ("completed", 3), "o4": ("failed", 0), "o5": ("failed", 0)}


def test_notes(spark):
    rows = spark.createDataFrame([("GLOBAL", None, "g1", 1), ("GLOBAL", None, "g2", 2), ("FOCAL", "a1", "n1", 1), ("FOCAL", "a2", "  ", 1)], "scope string, focal_master_id string, note string, added_at int")
    assert {r.focal_master_id: r.context for r in notes.render(rows, ["added_at"]).collect()} == {"a1": "Global guidance: g1 | g2\nFocal a1 guidance: n1"}
    stored = notes.store(rows, rows.withColumn("note", F.concat(F.lit(" !"), "note")), F.col("added_at"))
    assert stored.filter("trim(note) <> ''").count() == 3


def test_note_precedence(spark):
    rows = spark.createDataFrame([("p1", "f1", "own"), ("p2", "f1", "own"), ("p3", "f1", None), ("p4", "f2", None)], "pair_key string, focal_master_id string, notes string")
    out = jobs.notes_for(rows, spark.createDataFrame([("p1", "pair")], "pair_key string, note string"), spark.createDataFrame([("f1", "focal")], "focal_master_id string, note string"), "all")
    assert {r.pair_key: r.context_used for r in out.collect()} == {"p1": "pair", "p2": "own", "p3": "focal", "p4": "all"}


def test_judgement_defaults(spark):
    work = spark.createDataFrame([("f", [(1, "c", 0.5), (2, "d", 0.4)])], "focal_master_id string, candidates array<struct<rank:int,candidate_master_id:string,score:double>>")
    out = jobs.judge(work, lambda focal, own, note: [{"candidate_master_id": "c"}, {"decision": "YES"}]).collect()
    assert [(r.candidate_master_id, r.score, r.llm_decision, r.llm_confidence, r.llm_reason, r.pair_key) for r in out] == [("c", 0.5, "NEEDS_CONFIRMATION", 0.6, "model_decision", "c|f")]


def test_rerun_scopes(spark):
    judged = spark.createDataFrame([("a", "b", "a|b"), ("b", "c", "b|c"), ("x", "y", "x|y")], "focal_master_id string, candidate_master_id string, pair_key string")
    keys = lambda **c: {r.pair_key for r in jobs.rerun_rows(judged, Config(**c)).collect()}
    assert keys() == {"a|b", "b|c", "x|y"}
    assert keys(rerun_scope="focal", rerun_focals=("a",)) == {"a|b"}
    assert keys(rerun_scope="component", rerun_focals=("c",)) == {"a|b", "b|c"}
    assert keys(rerun_scope="focal") == {"a|b", "b|c", "x|y"}
    assert keys(rerun_scope="component", rerun_pairs=("b|c",)) == {"b|c"}


def test_incremental_equals_full(spark):
    rng = np.random.default_rng(1)
    rows = [(str(i), rng.standard_normal(4).tolist()) for i in range(30)]
    old = spark.createDataFrame([(i, [1.0, 0.0, 0.0, 0.0] if int(i) % 7 == 0 else v) for i, v in rows], "id string, embedding array<double>")
    new = spark.createDataFrame(rows, "id string, embedding array<double>")
    got = match.incremental_pairs(match.similarity_pairs(old), new, new.filter("cast(id as int) % 7 = 0").select("id"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, match.similarity_pairs(new).collect()))


def test_tables_round_trip_and_repeat(spark, tmp_path):
    base = str(tmp_path)
    assert io.read(spark, base, "decisions").count() == 0
    rows = spark.createDataFrame([("a|b", "YES", "001"), ("c|d", "NO", "run_2")], "pair_key string, decision string, run_id string")
    for _ in range(2):
        io.append(rows, base, "decisions")
    assert {(r.pair_key, r.run_id, r.score) for r in io.read(spark, base, "decisions").collect()} == {("a|b", "001", None), ("c|d", "run_2", None)}
    one = io.read(spark, base, "decisions", run_id="001")
    assert one.count() == 1 and "PartitionFilters: [isnotnull(run_id" in one._jdf.queryExecution().toString()
    io.write_csv(rows, f"{base}/csv")
    assert io.read_csv(spark, f"{base}/csv", ("pair_key",)).count() == 2
    with pytest.raises(ValueError):
        io.read_csv(spark, f"{base}/csv", ("nothing",))
    io.write_json(rows, f"{base}/json")
    assert spark.read.json(f"{base}/json").count() == 2


def test_upsert_keeps_the_last(spark):
    rows = lambda *r: spark.createDataFrame(r, "account_id string, name string, seq int")
    out = io.upsert(rows(("1", "old", 9)), rows(("1", "new", 1), ("1", "newer", 2), ("2", "b", 1)), ["account_id"], F.col("seq"))
    assert {(r.account_id, r.name) for r in out.collect()} == {("1", "newer"), ("2", "b")}


def test_configuration():
    cfg = Config.from_env({"T_AUTO": "bad", "T_LLM_LOW": "0.5", "LLM_TOP_N": "4", "SIMILARITY_COLUMNS": "{}", "METADATA_COLUMNS": '["x"]', "SIMILARITY_WEIGHTS": '{"x": 2}', "RERUN_FOCALS": " a, ,b", "FINALIZE": "true"})
    assert (cfg.t_auto, cfg.t_low, cfg.top_n, cfg.batch_size, cfg.similarity_columns, cfg.metadata_columns, cfg.weights, cfg.rerun_focals, cfg.finalize) == (0.95, 0.5, 4, 4, ("account_name",), ("x",), {"x": 2.0}, ("a", "b"), True)
    assert parse_accounts("a6|ACME Int Corp, d1|MS") == [("a6", "ACME Int Corp"), ("d1", "MS")]
    with pytest.raises(ValueError):
        parse_accounts("bad")


def test_cycle_and_router(spark):
    close = {"acme corp": [1.0, 0.0], "acme corporation": [0.99, 0.1], "microsoft": [0.0, 1.0], "microsoft corporation": [0.5, 0.87]}
    embedder = lambda texts: [close.get(t, [-1.0, -1.0]) for t in texts]
    rows = [r for r in NINE if r[0][0] in "ad"]
    out = cycle.run_cycle(accounts(spark, rows), Config(), embedder)
    assert {r.pair_key: r.route for r in out["candidates"].collect()}["a1|a3"] == "AUTO_YES_95"
    assert {(r.account_id, r.group_size) for r in out["gold"].collect()} == {("a1", 3), ("d1", 1), ("d2", 1)}
    assert cycle.run("STATUS", Config(), {"gold": out["gold"]})["status"].first()["rows"] == 3
    gate = spark.createDataFrame([("a1|a3", "REJECT"), ("d1|d2", "APPROVE")], "pair_key string, action string")
    queue = out["review_queue"].withColumn("decision", F.lit(None).cast("string"))
    done = cycle.run("FINALIZE", Config(finalize=True), {"candidates": out["candidates"], "judged": out["judged"], "review_queue": queue, "admin_gate": gate, "full_match": out["full_match"]})
    assert {(r.account_id, r.group_size) for r in done["gold"].collect()} == {("a1", 2), ("a3", 1), ("d1", 2)}
    with pytest.raises(ValueError):
        cycle.run("DANCE", Config(), {})


def test_embedding_is_the_same_everywhere(spark):
    texts = spark.createDataFrame([(str(i), f"name {i % 3}") for i in range(20)], "id string, similarity_text string")
    one, two = (sorted((r.id, tuple(r.embedding)) for r in jobs.embed(t, jobs.hashed_embedder(8), 4).collect()) for t in (texts, texts.repartition(5)))
    assert one == two and len({e for _, e in one}) == 3
    assert report.value_counts(texts, "similarity_text").count() == 3


def test_hot_names_and_masters(spark):
    rows = accounts(spark, [(str(i), "Blank & Co") for i in range(900)] + [(f"x{i}", f"name {i}") for i in range(100)])
    got = match.perfect_match(rows)
    assert {(r.master_account_id, r.group_size) for r in got.filter("group_size > 1").collect()} == {("0", 900)}
    assert got.count() == 1000 and "Window" not in got._jdf.queryExecution().toString()
    over = spark.createDataFrame([(str(i), str(i)) for i in range(5)], "account_id string, master_account_id string")
    none = spark.createDataFrame([], "old_master_id string, canonical_master_id string")
    after = match.apply_mapping(got, none, over)
    assert after.filter("account_id = '7'").first().group_size == 896


def test_incremental_pairs_take_only_the_affected_products(spark):
    rows = [(str(i), [float(i), 1.0]) for i in range(50)]
    df = spark.createDataFrame(rows, "id string, embedding array<double>")
    some = df.filter("id in ('3', '7')")
    got = {(r.a_id, r.b_id) for r in vector.cross_pairs(some, df, tile_rows=8).collect()}
    every = {(r.a_id, r.b_id): r.score for r in vector.all_pairs(df, tile_rows=8).collect()}
    assert got == {k for k in every if {"3", "7"} & set(k)}
    plan = vector.cross_pairs(some, df, tile_rows=8, counts=(2, 50))
    assert plan.count() == 49 + 48
    bands = {r.band: r.n for r in vector.band_counts(df, (0.5, 0.9), tile_rows=8).collect()}
    assert bands == {b: n for b in range(3) if (n := sum((0, 0.5, 0.9)[b] <= s < (0.5, 0.9, 2)[b] for s in every.values()))}
    odd = spark.createDataFrame([("a", [1.0, 2.0, 3.0]), ("b", [1.0, 2.0]), ("c", []), ("d", None), ("e", [0.0, 0.0])], "id string, embedding array<double>")
    assert {(r.a_id, r.b_id): round(r.score, 6) for r in vector.all_pairs(odd).collect() if r.score} == {("a", "b"): 1.0}


def test_all_pairs_shuffle_neither_copies_of_rows_nor_pairs(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(str(i), rng.standard_normal(6).tolist()) for i in range(60)], "id string, embedding array<double>")
    pairs = match.route(match.similarity_pairs(df), Config())
    assert pairs.count() == 60 * 59 // 2 and "Exchange" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_decided_pairs_leave_inside_the_tiles(spark):
    ids = [str(i) for i in range(40)] + ["7|", "7|a", "a|7", "|", "7||a"]
    df = spark.createDataFrame([(x, [float(i), 1.0]) for i, x in enumerate(ids)], "id string, embedding array<float>")
    every = {(r.a_id, r.b_id) for r in vector.all_pairs(df, tile_rows=8).collect()}
    assert len(every) == len(ids) * (len(ids) - 1) // 2
    keys = ["1|2", "2|1", "33|5", "7|7|a", "7||a|7", "39|nobody", "12", None, *[f"0|{i}" for i in range(1, 40, 3)]]
    decided = spark.createDataFrame([(k,) for k in keys], "pair_key string")
    got = {(r.a_id, r.b_id) for r in vector.all_pairs(df, tile_rows=8, without=text.ends_of(decided, "pair_key")).collect()}
    assert got == {(a, b) for a, b in every if f"{a}|{b}" not in keys} and len(got) < len(every) - 10
    left = match.similarity_pairs(df, decided)
    assert {(r.master_a_id, r.master_b_id) for r in left.collect()} == got
    assert "Exchange" not in left._jdf.queryExecution().executedPlan().toString()


def _bytes_a_row(df, path):
    """Of the columns in the files that a frame is written to, by column."""
    df.write.parquet(path)
    groups = [m.row_group(g) for f in glob.glob(f"{path}/*.parquet") for m in [pq.ParquetFile(f).metadata] for g in range(m.num_row_groups)]
    columns = [g.column(c) for g in groups for c in range(g.num_columns)]
    return {n: sum(c.total_compressed_size for c in columns if c.path_in_schema == n) / sum(g.num_rows for g in groups) for n in {c.path_in_schema for c in columns}}


def _vectors_in_any_order(spark, n=1200):
    rng = np.random.default_rng(6)
    rows = [(str(10_000 + 7 * i), rng.standard_normal(4).tolist()) for i in rng.permutation(n)]
    return spark.createDataFrame(rows, "id string, embedding array<double>").coalesce(1)


def test_files_of_pairs_hold_few_bytes_a_pair(spark, tmp_path):
    df = _vectors_in_any_order(spark)
    took = _bytes_a_row(match.similarity_pairs(df, df.select(F.lit("10000|10007").alias("pair_key")).limit(1)), str(tmp_path / "pairs"))
    assert took["pair_key"] < 4.2 and took["master_a_id"] + took["master_b_id"] < 0.35, took


def test_files_of_routed_pairs_hold_few_bytes_a_pair(spark, tmp_path):
    took = _bytes_a_row(match.route(match.similarity_pairs(_vectors_in_any_order(spark)), Config()), str(tmp_path / "routed"))
    assert sum(b for c, b in took.items() if c != "score") < 5, took


def test_files_of_incremental_pairs_hold_few_bytes_a_pair(spark, tmp_path):
    df = _vectors_in_any_order(spark)
    pairs = match.incremental_pairs(match.similarity_pairs(df), df, df.filter("cast(id as long) % 10 = 0").select("id"))
    took = _bytes_a_row(pairs, str(tmp_path / "again"))
    assert sum(b for c, b in took.items() if c != "score") < 5.5, took


def test_incremental_pairs_do_not_shuffle_the_old_ones(spark):
    df = spark.createDataFrame([(str(i), [float(i), 1.0]) for i in range(30)], "id string, embedding array<double>")
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = match.incremental_pairs(match.similarity_pairs(df), df, df.filter("id in ('3', '7')").select("id"))
        assert got.count() == 30 * 29 // 2
        assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)


def test_places_in_a_whole_order(spark):
    rows = [(i * 7919 % 1000, i) for i in range(1000)]
    got = report.placed(spark.createDataFrame(rows, "a int, b int"), F.desc("a")).collect()
    assert sorted((-r.a, r.place) for r in got) == [(-999 + i, i + 1) for i in range(1000)]


def test_rejected_pairs_can_be_left_in_the_tiles():
    assert match.least_cosine(Config()) is None
    assert match.least_cosine(Config(keep_rejected=False)) == 0.70
    assert match.least_cosine(Config(keep_rejected=False, t_low=0.6, emb_weight=0.95, fuzz_weight=0.05)) == pytest.approx(0.55 / 0.95)


def test_settings_and_lazy_clients(spark):
    with pytest.raises(ValueError, match="KEY, URL"):
        jobs.settings({"NAME": "x", "URL": ""}, "NAME", "KEY", "URL")
    built = jobs.Lazy(lambda: lambda texts: [[float(len(t))] for t in texts])
    texts = spark.createDataFrame([("1", "ab"), ("2", "abc")], "id string, similarity_text string")
    assert {r.id: list(r.embedding) for r in jobs.embed(texts, built).collect()} == {"1": [2.0], "2": [3.0]}


CLOSE = {"acme corp": [1.0, 0.0], "acme corporation": [0.99, 0.1], "acme int": [0.8, -0.6], "microsoft": [0.0, 1.0], "microsoft corporation": [0.5, 0.87], "zed": [-1.0, 0.1]}


def offline(texts):
    return [CLOSE.get(t, [-1.0, -1.0]) for t in texts]


def test_runs_between_tables(spark, tmp_path):
    own = Service(spark, str(tmp_path), offline, jobs.band_judge(0.97, 0.75))
    given = [{"account_id": i, "account_name": n} for i, n in NINE if i[0] in "ad"]
    first = {"RUN_ID": "run-1", "T_LLM_LOW": "0.6", "FINALIZE": True}
    for _ in range(2):  # a repeated operation leaves what one would
        own.run("FULL_PIPELINE", {**first, "accounts": given})
    assert own.table("accounts_raw").count() == 5 and own.table("pairs").count() == 6
    assert {r.route for r in own.table("candidates").filter("pair_key = 'a1|a3'").collect()} == {"AUTO_YES_95"}
    assert own.table("candidates").filter("tagged_at is null").count() == 0
    queue = {r.pair_key: r.status for r in own.table("review_queue").collect()}
    assert queue == {"d1|d2": "QUEUED"}
    own.run("REVIEW", {**first, "answers": [{"pair_key": "d1|d2", "answer": "y", "note": "!same firm", "reviewer": "ann"}]})
    assert {(r.scope, r.focal_master_id, r.note) for r in own.table("notes").collect()} == {("GLOBAL", None, "same firm"), ("FOCAL", "d1", "same firm")}
    shown = own.run("FINALIZE", {**first, "FINALIZE": False})
    assert set(shown) == {"proposals"} and own.table("mapping").count() == 0
    for _ in range(2):
        done = own.run("FINALIZE", first)
    assert {(r.account_id, r.group_size) for r in done["gold"].collect()} == {("a1", 3), ("d1", 2)}
    assert {(r.old_master_id, r.canonical_master_id, r.source) for r in own.table("mapping").collect()} == {("a3", "a1", "FINALIZATION"), ("d2", "d1", "FINALIZATION")}
    assert {r.pair_key: r.source for r in own.table("decisions").collect()} == {"a1|a3": "AUTO_95", "d1|d2": "HUMAN_APPROVED"}
    # a second run carries the mapping over, and people's group operations after it
    second = {**first, "RUN_ID": "run-2"}
    own.run("FULL_PIPELINE", {**second, "accounts": [*given, {"account_id": "a6", "account_name": "ACME Int"}]})
    assert {(r.account_id, r.master_account_id) for r in own.table("full_match", run_id="run-2").collect()} == {("a1", "a1"), ("a2", "a1"), ("a3", "a1"), ("a6", "a6"), ("d1", "d1"), ("d2", "d1")}
    assert {r.pair_key for r in own.table("review_queue", run_id="run-2").collect()} == {"a1|a6"}
    log = own.run("GROUP_OPERATIONS", {**second, "operations": [{"operation": "remove_member", "target_id": "d2"}, {"operation": "dance", "target_id": "d1"}], "reviewer": "bob"})["operations"]
    assert {(r.operation, r.status, r.reviewer) for r in log.collect()} == {("remove_member", "completed", "bob"), ("dance", "failed", "bob")}
    own.run("UPDATE_DECISIONS", {**second, "updates": [{"pair_key": "a1|a6", "decision": "YES", "reviewer": "ann"}, {"pair_key": "", "decision": "NO"}]})
    gold = own.run("FINALIZE", second)["gold"]
    assert {(r.account_id, r.group_size) for r in gold.collect()} == {("a1", 4), ("d1", 1), ("d2", 1)}
    assert own.run("STATUS", second)["status"].filter("table = 'gold'").first()["rows"] == 5
    with pytest.raises(ValueError, match="unknown operation"):
        own.run("DANCE")


def test_rerun_between_tables(spark, tmp_path):
    own = Service(spark, str(tmp_path), offline)
    given = [{"account_id": i, "account_name": n} for i, n in [("a1", "ACME Corp"), ("a6", "ACME Int"), ("d1", "Microsoft"), ("d2", "Microsoft Corporation")]]
    params = {"RUN_ID": "r", "T_LLM_LOW": "0.6"}
    own.run("FULL_PIPELINE", {**params, "accounts": given})
    assert {r.pair_key: r.status for r in own.table("review_queue").collect()} == {"a1|a6": "QUEUED", "d1|d2": "QUEUED"}
    asked = []

    class Strict:
        @staticmethod
        def judge(focal, candidates, context):
            said = [{"candidate_master_id": c["candidate_master_id"], "decision": "YES", "confidence": 0.95, "reason": context} for c in candidates if "candidate_account_name" in c]
            return said, {"token_usage": {"asked": len(candidates)}}

    own.judge = Strict
    out = own.run("RERUN_ONLY", {**params, "RERUN_SCOPE": "component", "RERUN_FOCALS": "d2", "GLOBAL_NOTES": "all", "FOCAL_NOTES_JSON": {"d1": "just him"}})
    assert {(r.pair_key, r.status, r.decision, r.llm_reason, r.prompt_version) for r in out["review_queue"].collect()} == {("d1|d2", "APPROVED", "HUMAN_APPROVED_AFTER_NOTES", "just him", "v2_with_context")}
    assert out["llm_results"].first().token_usage_json == '{"asked": 1}' and not asked
    gold = own.run("FINALIZE", {**params, "FINALIZE": True})
    assert {(r.account_id, r.group_size) for r in gold["gold"].collect()} == {("a1", 1), ("a6", 1), ("d1", 2)}
    own.run("NOTES", {**params, "notes": [{"scope": "GLOBAL", "note": "be kind"}, {"scope": "FOCAL", "focal_master_id": "a1", "note": "!no"}]})
    later = own.run("RERUN_ONLY", {**params, "RUN_ID": "s", "use_stored_notes": True})
    used = {r.pair_key: r.context_used for r in later["review_queue"].collect()}
    assert used == {"a1|a6": "Global guidance: be kind\nFocal a1 guidance: no", "d1|d2": "Global guidance: be kind"}
    assert {r.source for r in gold["decisions"].collect()} == {"HUMAN_NOTES_AUTO_APPROVED"}


def test_command_line(spark, tmp_path):
    base = str(tmp_path / "tables")
    answers = tmp_path / "answers.csv"
    answers.write_text("pair_key,answer,note,reviewer\na1|zz,n,,ann\n")
    out = cli.main(["--base", base, "--cycle_name", "c1", "--demo_stateful", "--add_accounts", "z9|Zed", "--review", str(answers), "--admin_review", str(answers), "--rerun_scope", "all"], spark)
    assert out["gold"].count() == 6 and out["gold"].filter("account_id = 'z9'").count() == 1
    again = cli.main(["--base", base, "--cycle_name", "c2", "--demo_stateful"], spark)
    assert again["gold"].filter("account_id = 'z9'").count() == 1
    assert spark.read.option("header", True).csv(f"{base}/export/c1/gold").count() == 6
    given = tmp_path / "in.csv"
    given.write_text("account_id,account_name\n1,Acme\n2,ACME\n")
    assert cli.main(["--base", str(tmp_path / "more"), "--input_csv", str(given)], spark)["gold"].count() == 1
    given.write_text("id,name\n1,Acme\n")
    with pytest.raises(ValueError, match="missing columns"):
        cli.main(["--base", str(tmp_path / "none"), "--input_csv", str(given)], spark)


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        get = staticmethod(lambda name, default: default)

    class Session:
        conf = Conf
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        graph.shared_folder(Session)
