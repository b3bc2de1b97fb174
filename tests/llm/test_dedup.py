import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.llm import exact_dedup, line_dedup, mixing, ngram_join, substring_dedup
from tests.llm.common import SPACE, WORD, corpus, fold, frame


def plain_lines(rows, least=10):
    holders = defaultdict(set)
    key = lambda line: fold(line.strip(SPACE))
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                holders[key(line)].add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or len(holders[key(x)]) < 2 or min(holders[key(x)]) == i]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_lines_match_brute_force(spark):
    rows = corpus()
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert got == plain_lines(rows)


def test_lines_of_null_and_repeated_ids(spark):
    rows = [(None, "a line that repeats"), (5, "a line that repeats"), (5, "a line that repeats"), (7, "a line that repeats")]
    got = sorted(((r.doc_id, r.n_dropped) for r in line_dedup.dedup_lines(frame(spark, rows)).collect()), key=str)
    assert got == [(5, 0), (5, 0), (7, 1), (None, 1)]
    assert line_dedup.dedup_lines(frame(spark, [(5, "the same id twice")] * 2)).agg({"n_dropped": "sum"}).first()[0] == 0


def test_line_state_is_reversible(spark):
    rows = corpus()
    old, new = rows[:40], rows[40:]
    one = line_dedup.insert(None, frame(spark, old), n_shards=4)
    two = line_dedup.insert(one, frame(spark, new), n_shards=4)
    every = line_dedup.insert(None, frame(spark, rows), n_shards=4)
    table = lambda s: sorted(map(tuple, line_dedup.entries(s).collect()))
    assert table(two) == table(every)
    back = line_dedup.delete(two, frame(spark, new), frame(spark, old), n_shards=4)
    assert table(back) == table(one)
    gone = line_dedup.delete(two, frame(spark, old), frame(spark, new), n_shards=4)
    assert table(gone) == table(line_dedup.insert(None, frame(spark, new), n_shards=4))


def test_line_state_counts_each_document_once(spark):
    line = "the same line of boilerplate"
    table = lambda s: sorted((r.owner, r["count"]) for r in line_dedup.entries(s).collect())
    twice = frame(spark, [(1, line), (1, line + "\n" + line), (None, line), (None, line)], parts=4)
    one = line_dedup.insert(None, twice, n_shards=2)
    assert [n for _, n in table(one)] == [2]
    two = line_dedup.insert(one, frame(spark, [(2, line), (2, line)], parts=2), n_shards=2)
    assert table(two) == [(1, 3)]
    left = line_dedup.delete(two, twice, frame(spark, [(2, line), (2, line)], parts=2), n_shards=2)
    assert table(left) == [(2, 1)]
    none = line_dedup.delete(left, frame(spark, [(2, line), (2, line)], parts=2), frame(spark, []), n_shards=2)
    assert table(none) == []
    again = line_dedup.delete(line_dedup.insert(two, twice, n_shards=2), twice, frame(spark, [(1, line), (2, line), (None, line)]), n_shards=2)
    assert table(again) == table(two)


def test_line_state_in_several_cells(spark, monkeypatch):
    rows = [(i, f"line number {i}\na line that all hold") for i in range(40)]
    whole = line_dedup.insert(None, frame(spark, rows), n_shards=2)
    monkeypatch.setattr(line_dedup, "_CELL", 8)
    cells = line_dedup.insert(line_dedup.insert(None, frame(spark, rows[:20]), n_shards=2), frame(spark, rows[20:]), n_shards=2)
    table = lambda s: sorted(map(tuple, line_dedup.entries(s).collect()))
    assert table(cells) == table(whole) and len(table(cells)) == 41


def test_cuckoo_filter_holds_and_forgets():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 2**63, 50_000).astype(np.uint64))
    f = line_dedup.CuckooFilter(len(keys))
    for part in np.array_split(keys, 7):
        f.add(part)
    assert f.may_hold(keys).all()
    f.remove(keys[::2])
    assert f.may_hold(keys[1::2]).all()
    assert f.may_hold(keys[::2]).mean() < 0.01


def plain_exact(rows):
    groups = defaultdict(list)
    norm = lambda t: "".join(c for c in t or "" if c not in SPACE)
    for i, t in rows:
        groups[norm(t)].append((-len(t or ""), i))
    return sorted((i, min(groups[norm(t)])[1], len(groups[norm(t)]), min(groups[norm(t)])[1] == i, hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows)


@pytest.mark.parametrize("options", [{}, {"modulus": 101, "huge_chars": 50, "chunk": 16}])
def test_exact_matches_brute_force_even_when_fingerprints_collide(spark, options):
    rows = corpus()
    got = sorted(map(tuple, exact_dedup.dedup(frame(spark, rows), **options).collect()))
    assert got == plain_exact(rows)


@pytest.mark.parametrize("options", [{}, {"modulus": 101, "huge_chars": 50, "chunk": 16}])
def test_exact_with_null_and_repeated_ids_of_different_texts(spark, options):
    rows = [(None, f"text {i % 7}") for i in range(30)] + [(3, f"text {i % 5} ") for i in range(20)] + [(3, "alone"), (None, None), (4, "")]
    got = exact_dedup.dedup(frame(spark, rows), **options).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").replace(" ", "")].append((-len(t or ""), i is None, i))
    want = [(i, min(g)[2], len(g), i == min(g)[2], hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for _, _, i in g]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


CLASHING = ["_kept", "_id", "_times", "_epoch", "_row", "_ROW_", "row", "group", "best", "gone", "keep_id", "root", "size", "taken", "a`b"]


@pytest.mark.parametrize("run", [exact_dedup.kept_documents, ngram_join.representatives, mixing.mixed_documents])
def test_stages_bear_columns_of_any_name(spark, run):
    rows = corpus()[:40]
    plain = frame(spark, rows)
    extra = plain.select("doc_id", "text", "lang", "source", "n_chars", *[F.col("doc_id").alias(c) for c in CLASHING])
    got, want = run(extra), run(plain.select("doc_id", "text", "lang", "source", "n_chars"))
    assert got.columns == extra.columns
    if run is not mixing.mixed_documents:  # whose random keys are those of whole rows
        assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in want.collect())
    assert all(r["_id"] == r.doc_id == r["_epoch"] == r["a`b"] for r in got.collect())


def test_mixed_rows_of_null_and_repeated_ids_repeat_on_their_own(spark):
    rows = [(None, "a b c " * (i + 1)) for i in range(30)] + [(5, "d e " * (i + 1)) for i in range(30)]
    table = frame(spark, rows)
    out = mixing.mix(table)
    assert out.count() == len(rows)
    plan = {r.source: (r.budget, r.source_size) for r in mixing.targets(mixing.sizes(table)).collect()}
    taken = Counter()
    for r in mixing.mixed_documents(table).collect():
        taken[r.source] += len(r.text.split())
    largest = max(len(t.split()) for _, t in rows)
    for source, (budget, _) in plan.items():
        assert budget <= taken[source] <= budget + largest


def test_components_of_null_and_repeated_ids(spark):
    text = lambda name, n=60: " ".join(f"{name}{i}" for i in range(n))
    rows = [(1, text("a")), (None, text("a") + " end"), (None, text("b")), (7, text("c")), (7, text("d")), (2, text("d") + " end"), (9, text("e"))]
    got = sorted(((r.doc_id, r.component_id) for r in ngram_join.components(frame(spark, rows)).collect()), key=str)
    # a doc_id (or none) is one node that has the links of all its rows
    assert got == sorted([(1, 1), (None, 1), (None, 1), (7, 2), (7, 2), (2, 2), (9, 9)], key=str)


def test_fingerprints_compose():
    p = exact_dedup.prime()
    data = bytes(range(256)) * 50
    whole = exact_dedup.fingerprint(data, p)
    left, right = exact_dedup.fingerprint(data[:777], p, 100), exact_dedup.fingerprint(data[777:], p, 33)
    assert exact_dedup.combine(left, right, p) == whole == (int.from_bytes(data, "big") % p, len(data))


def plain_repeats(rows, k=35):
    words = {i: WORD.findall(t or "") for i, t in rows}
    seen = Counter(tuple(w[j : j + k]) for w in words.values() for j in range(len(w) - k + 1))
    out = {}
    for i, w in words.items():
        gone = set()
        for j in range(len(w) - k + 1):
            if seen[tuple(w[j : j + k])] > 1:
                gone |= set(range(j, j + k))
        out[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


@pytest.mark.parametrize(("length", "many"), [(35, 0), (35, 150), (5, 40)])
def test_repeats_match_brute_force(spark, length, many):
    rows = corpus()
    shared = " ".join(f"p{i}" for i in range(60))  # one passage in very many documents: its anchors are hot
    rows += [(5000 + i, f"before{i} x{i} y{i} {shared} after{i} z{i} u{i}") for i in range(many)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.remove_repeats(frame(spark, rows), length).collect()}
    assert got == plain_repeats(rows, length)


@pytest.mark.parametrize("many", [0, 150])
def test_repeats_of_different_texts_under_one_id(spark, many):
    shared = " ".join(f"p{i}" for i in range(60))
    own = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    rows = [(None, own("a", 90) + " " + shared), (None, own("b", 200)), (None, own("c", 40)), (5, shared), (5, own("d", 120)), (5, own("e", 20))]
    rows += [(None, own("k", 70)), (None, own("k", 70)), (None, own("s", 50) + " " + shared), (None, own("s", 50) + " " + shared)]
    rows += [(None, f"before{i} {shared} after{i}") for i in range(many)]
    want = plain_repeats(list(enumerate(t for _, t in rows)))
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.remove_repeats(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(((i, *want[k]) for k, (i, _) in enumerate(rows)), key=str)


def test_suffix_automaton_counts():
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 3, rng.integers(4, 30)).tolist() for _ in range(12)]
    found = substring_dedup.repeated_windows([(t, 1) for t in texts], 4)
    seen = Counter(tuple(t[j : j + 4]) for t in texts for j in range(len(t) - 3))
    for t, hit in zip(texts, found, strict=True):
        assert hit.tolist() == [seen[tuple(t[j : j + 4])] > 1 for j in range(len(t) - 3)]


def plain_components(rows):
    sets = []
    for i, t in rows:
        w = [fold(x) for x in WORD.findall(t or "")]
        sets.append((i, {tuple(w[j : j + 3]) for j in range(len(w) - 2)} if len(w) > 2 else ({tuple(w)} if w else set())))
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= 90 * len(x | y):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return sorted((i, len(x), find(i)) for i, x in sets)


@pytest.mark.parametrize("group_rows", [512, 4])
def test_jaccard_matches_brute_force(spark, group_rows):
    rows = corpus()
    base = [f"s{i}" for i in range(200)]
    for k in range(40):  # a large group of near copies, and a chain of drifting ones
        near = list(base)
        near[5 * k] = f"n{k}"
        rows.append((1000 + k, " ".join(near)))
    for k in range(12):
        rows.append((2000 + k, " ".join([f"c{i}" for i in range(8 * k, 200 + 8 * k)])))
    for n in range(3, 30):
        rows += [(3000 + 10 * n + e, " ".join(f"t{n}x{i}" for i in range(n + e))) for e in range(3)]
    got = sorted(map(tuple, ngram_join.components(frame(spark, rows), group_rows).collect()))
    assert got == plain_components(rows)


def test_groups_of_long_texts_are_split_by_their_shingles(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SHINGLES_A_ROW", 50)
    rng = np.random.default_rng(8)
    rows = []
    for g in range(3):
        body = [f"w{g}x{i}" for i in range(1200)]
        for k in range(9):
            own = list(body)
            for at in rng.integers(0, 1200, 4 + 30 * (k % 3 == 2)):
                own[at] = f"c{g}{k}{at}"
            rows.append((g * 100 + k, " ".join(own)))
    got = sorted(map(tuple, ngram_join.components(frame(spark, rows), 8).collect()))
    assert got == sorted(plain_components(rows))


def test_no_pair_escapes_the_tiles():
    rng = np.random.default_rng(5)
    for size in [*range(1, 60), 100, 333, 1000]:
        pool = np.unique(rng.integers(0, 2**63, 3 * size + 8).astype(np.uint64))
        rng.shuffle(pool)
        x = np.sort(pool[:size])
        for lost in range(size // 9 + 1):
            for gained in range(size // 9 + 1):
                if size > 100 and (lost, gained) not in ((0, size // 9), (size // 20, size // 20), (size // 10, 0)):
                    continue
                y = np.sort(np.concatenate([x[lost:], pool[size : size + gained]]))
                both = size - lost
                if not len(y) or not ngram_join.linked(np.array([both]), np.array([size]), np.array([len(y)]))[0]:
                    continue
                key, row = ngram_join.tile_keys(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]))
                assert np.intersect1d(key[row == 0], key[row == 1]).size, (size, lost, gained)


def test_mix_meets_budgets(spark):
    rows = corpus()
    table = frame(spark, rows)
    got = mixing.mix(table, bucket_rows=8).toPandas()
    again = mixing.mix(table.repartition(7), bucket_rows=8).toPandas()
    assert sorted(got.itertuples(index=False), key=str) == sorted(again.itertuples(index=False), key=str)
    size = {i: len(WORD.findall(t or "")) for i, t in rows}
    assert dict(zip(got.doc_id, got["size"], strict=True)) == size
    assert (got.taken <= 3 * got["size"]).all()
    per = got.groupby(got.source.fillna("null")).agg({"taken": "sum", "target": "first", "source_size": "first"})
    assert (per.taken == np.floor(per.target + 0.5)).all()
    assert (per.target <= 3 * per.source_size).all()
    assert abs(per.target.sum() - sum(size.values())) < 1e-6
    weight = {"b": 5, "hot": 2, "é": 1, "null": 5}
    free = [s for s in per.index if per.target[s] < 3 * per.source_size[s]]
    assert len({round(per.target[s] / weight[s], 6) for s in free}) <= 1


def test_mixed_rows_stand_as_often_as_they_are_taken(spark):
    table = frame(spark, corpus())
    times = {r.doc_id: r["count"] for r in mixing.mixed_documents(table).groupBy("doc_id").count().collect()}
    for r in mixing.mix(table).collect():
        assert times.get(r.doc_id, 0) == (-(-r.taken // r.size) if r.size else 1)


@pytest.mark.parametrize("run", [line_dedup.dedup_lines, exact_dedup.dedup, substring_dedup.remove_repeats, ngram_join.components, mixing.mix, mixing.mixed_documents, exact_dedup.kept_documents, ngram_join.representatives])
def test_empty_and_null_tables(spark, run):
    assert run(frame(spark, [(1, "x")]).limit(0)).count() == 0
    assert run(frame(spark, [(None, None)])).count() == 1
