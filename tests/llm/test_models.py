import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinweave.llm import ann, lm_mixing, pieces, pii, toxicity, words
from tests.llm.common import WORD, corpus, fold, frame

# --- nearest neighbours ---


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score double, `rank` int")


def exact(rows, queries, k=10):
    usable = {i: np.array(v, np.float32).astype(float) for i, v, *_ in rows if i is not None and v and None not in v and len(v) == 16 and np.isfinite(v).all() and any(v)}
    out = {}
    for q in queries:
        if q in usable:
            d = sorted((float(np.sqrt(((usable[q] - x) ** 2).sum())), i) for i, x in usable.items() if i != q)
            out[q] = d[:k]
    return out


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((12, 16))
    rows = [(i, (centres[i % 12] + rng.standard_normal(16)).tolist(), 0, 0.0, 0) for i in range(3000)]
    rows += [(3000 + i, rows[100][1], 0, 0.0, 0) for i in range(400)]  # one common vector
    rows += [(5000, None, 0, 0.0, 0), (5100, [0.0] * 16, 0, 0.0, 0), (5200, [1.0, None] * 8, 0, 0.0, 0), (5300, [math.nan] * 16, 0, 0.0, 0), (5400, [1.0] * 3, 0, 0.0, 0), (None, [1.0] * 16, 0, 0.0, 0)]
    return rows


def test_neighbours_recall_and_order(spark, points):
    table = vectors(spark, points)
    index = ann.fit(table, max_sample=1500, block_rows=100)
    got = {}
    for r in ann.search(table, table.filter(ann.hundredth()), index=index).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    want = exact(points, [i for i, *_ in points if i is not None and i % 100 == 0])
    assert set(got) == set(want)
    hits = 0
    for q, rows in got.items():
        rows.sort()
        assert [r for r, *_ in rows] == list(range(1, 11))
        assert [(s, v) for _, s, v in rows] == sorted((s, v) for _, s, v in rows)
        assert q not in [v for *_, v in rows]
        true = dict((i, d) for d, i in want[q])
        hits += sum(v in true for *_, v in rows)
        for _, s, v in rows:
            if v in true:
                assert s == pytest.approx(true[v], rel=1e-12)
    assert hits / (10 * len(got)) >= 0.95


def test_all_lists_without_tests_is_exact(spark, points):
    table = vectors(spark, points + points[:50])  # repeated rows
    index = ann.fit(table, max_sample=500, block_rows=64)
    found = ann.search(table, table.filter("vec_id in (0, 100, 3100)"), index=index, probe_share=1.0, slack=1e9)
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in found.collect())
    want = exact(points, [0, 100, 3100])
    want_rows = sorted((q, n + 1, i) for q, rows in want.items() for n, (_, i) in enumerate(rows))
    assert sorted(set(got)) == want_rows


def test_scan_alone_finds_the_neighbours_of_the_tables(spark):
    """Recall of the probed scan against brute force, on a table well above the travelling sample."""
    rng = np.random.default_rng(5)
    base = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    given = np.stack(base["embedding"].to_numpy()).astype(np.float32)
    x = np.concatenate([given + rng.normal(0, 0.3 * given.std(), given.shape) for _ in range(6)]).astype(np.float32)
    rows = [(i, v.tolist(), 0, 0.0, 0) for i, v in enumerate(x)]
    table = vectors(spark, rows).repartition(8)
    found = ann.search(table, table.filter(ann.hundredth())).toPandas()
    hits = 0
    for q, own in found.groupby("query_id"):
        d = ((x.astype(float) - x[q].astype(float)) ** 2).sum(1)
        d[q] = np.inf
        hits += len(set(own["vec_id"]) & set(np.lexsort((np.arange(len(d)), d))[:10].tolist()))
    assert len(found) == 10 * len(range(0, len(x), 100))
    assert hits >= 0.95 * len(found)


def test_queries_that_the_tests_leave_short_are_searched_again(spark, points):
    table = vectors(spark, points[:40])
    index = ann.fit(table, max_sample=1500)
    got = ann.search(table, table.filter("vec_id < 3"), index=index, slack=-3.0).toPandas()  # tests that drop nearly all
    want = exact(points[:40], [0, 1, 2])
    assert {(r.query_id, r.vec_id) for r in got.itertuples()} == {(q, i) for q, rows in want.items() for _, i in rows}


def test_unusable_vectors_do_not_hide_usable_ones(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAST_SAMPLE", 4)
    rows = [(i, [math.nan] * 8, 0, 0.0, 0) for i in range(200)] + [(1000 + i, [float(i + j) for j in range(1, 9)], 0, 0.0, 0) for i in range(30)]
    table = vectors(spark, rows)
    assert ann.search(table, table.filter(ann.hundredth())).count() == 10


def test_few_and_no_vectors(spark):
    few = vectors(spark, [(0, [1.0] * 4, 0, 0.0, 0), (1, [2.0] * 4, 0, 0.0, 0), (2, [1.5] * 4, 0, 0.0, 0)])
    assert [(r.vec_id, r["rank"]) for r in ann.search(few, few.filter("vec_id = 0")).orderBy("rank").collect()] == [(2, 1), (1, 2)]
    assert ann.search(few.limit(0), few.limit(0)).count() == 0
    none = vectors(spark, [(0, None, 0, 0.0, 0)])
    assert ann.search(none, none).count() == 0


# --- tokens ---


@pytest.fixture(scope="module")
def tokenizer():
    return pieces.Tokenizer(pieces.read_model())


def slow_best(tokenizer, model, text):
    by = {p: (s, i) for i, (p, s, k) in enumerate(model) if k in (1, 4)}
    longest = max(map(len, by))
    score = [0.0] + [-math.inf] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - longest), end):
            if text[start:end] in by:
                score[end] = max(score[end], score[start] + by[text[start:end]][0])
        if text[end - 1] not in by:
            score[end] = max(score[end], score[end - 1] + tokenizer.unknown)
    return score[-1]


def test_best_path_is_best(tokenizer):
    model = pieces.read_model()
    rng = random.Random(4)
    words = ["hello", "▁world", "▁the▁of", "naïve", "日本語", "\U0001f600", "xqzj", "ing", "▁▁▁▁", "1234,5", "€uro", "tion"]
    for _ in range(150):
        text = "".join(rng.choice(words) for _ in range(rng.randint(1, 6)))
        ids, score = tokenizer.best(text)
        assert score == pytest.approx(slow_best(tokenizer, model, text))


def test_best_path_agrees_with_the_library(tokenizer):
    import sentencepiece

    with open(pieces.MODEL_PATH, "rb") as f:
        data = f.read()
    # the same pieces and scores, read as a unigram model: trainer_spec { model_type: UNIGRAM } is appended
    library = sentencepiece.SentencePieceProcessor(model_proto=data + bytes([2 << 3 | 2, 2, 3 << 3, 1]))
    model = pieces.read_model()
    same = 0
    words = [f"{a}{b}" for a in ("inter", "play", "sch", "réu", "work", "un") for b in ("national", "ing", "önheit", "nion", "shop", "able", "x")]
    for w in words:
        own, theirs = tokenizer.best("▁" + w), library.encode(w)
        assert own[1] == pytest.approx(sum(model[i][1] for i in theirs))
        same += own[0] == theirs
    assert same >= 0.9 * len(words)


def test_round_trip(spark, tokenizer):
    rows = [*corpus(), (900, "  two  spaces \n\n and\ttabs "), (901, "▁ mark ▁▁ \U0001f600\x00"), (902, "\n"), (903, " ")]
    out = {r.doc_id: r for r in pieces.decode(pieces.encode(frame(spark, rows))).collect()}
    for i, t in rows:
        assert out[i].text == t
        assert out[i].n_tokens == (None if t is None else len(out[i].ids) // 4)
    lists = pieces.encode(frame(spark, [(1, "a b"), (2, "")])).select("doc_id", pieces.unpack().alias("x")).collect()
    assert {r.doc_id: r.x for r in lists} == {1: np.frombuffer(tokenizer.encode("a b"), "<u4").tolist(), 2: []}


def test_cuts_lose_nothing(tokenizer):
    model = pieces.read_model()
    whole = pieces.Tokenizer(model)
    assert whole.cuts
    whole.cuts = False
    for _, t in corpus()[:40]:
        if t:
            parts, one = (sum(model[i][1] for i in np.frombuffer(x.encode(t[:400].replace("\n", " ")), "<u4")) for x in (tokenizer, whole))
            assert parts == pytest.approx(one)


# --- personal data ---

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    double = lambda n: n * 2 - 9 if n > 4 else n * 2
    return sum(int(c) if k % 2 == 0 else double(int(c)) for k, c in enumerate(reversed(d))) % 10 == 0


def plain_base(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in _EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in _IP.finditer(t) if all(int(x) < 256 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in _CARD.finditer(t) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in _PHONE.finditer(t) if 8 <= len(digits(m[0])) <= 15]


PII_TEXTS = [
    "write to jane.doe@example.com or a@b.c@d.ef, x@y, @z.com é@q.io",
    "ip 10.0.0.1 and 999.1.1.1 and 1.2.3.4.5.6.7.8 and 001.002.003.004",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112, 5500000000000004 123",
    "call +49 (0)30 1234567 or +1-555-123-4567- or +12 or phone 555-123-4567",
    "mail joe (at) example (dot) com, order 1234567890123456, isbn 978 3 16 148410 0",
    "",
]


def test_base_spans_match_the_patterns():
    rng = random.Random(1)
    bits = ["a", "@", ".", "b.c", "1", "23", "4111 1111 1111 1111", " ", "-", "+", "(", ")", "255", "é", "%", "+49 30 123456 7"]
    order = {k: i for i, k in enumerate(pii.KINDS)}
    for t in PII_TEXTS + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(3000)]:
        assert sorted(pii.base_spans(t), key=lambda s: (order[s[0]], s[1])) == plain_base(t), t


def test_spans_keep_the_base_and_add_likely_ones(spark):
    rows = list(enumerate(PII_TEXTS * 20)) + [(5000, None)]
    table = frame(spark, rows)
    model = pii.fit(table)
    got = {r.doc_id: r for r in pii.find(table, model).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        base = [f"{k}:{a}:{b}" for k, a, b in plain_base(t or "")]
        assert got[i].base == ",".join(base)
        assert set(base) <= set(got[i].spans.split(",")) | {""}
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(x.startswith(k) for x in base) for k in pii.KINDS]
    assert "<phone>" in {r.doc_id: r.text for r in pii.redact(table, model).collect()}[3]
    assert pii.find(table.limit(0)).count() == 0


def test_reliabilities_tell_good_labelers_from_bad():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.4
    right = np.array([0.95, 0.9, 0.8, 0.5, 0.7])
    vote = np.where(rng.random((20_000, 5)) < right, 1, -1) * np.where(truth, 1, -1)[:, None]
    pattern, count = np.unique(vote, axis=0, return_counts=True)
    chance, rates, prior = pii.reliabilities(pattern, count.astype(float))
    assert prior == pytest.approx(0.4, abs=0.02)
    assert np.allclose(rates[1, :, 2], right, atol=0.03)


# --- language model ---


def test_unigram_base_and_counts(spark):
    rows = corpus()
    got = {r.doc_id: r for r in lm_mixing.score(frame(spark, rows), head=64).collect()}
    tokens = {i: [fold(w) for w in WORD.findall(t or "")] + [None] for i, t in rows}
    train = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    total = sum(train.values())
    for i, ws in tokens.items():
        r = got[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 7 == 2)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(w in train for w in ws), total)
        assert r.base_score == pytest.approx(sum(math.log10((train[w] + 1) / (total + len(train) + 1)) for w in ws), rel=1e-9)
        assert r.score < 0


def test_language_model_with_null_and_repeated_ids(spark):
    rows = [(None, f"alpha beta w{i}") for i in range(6)] + [(7, f"gamma w{i} alpha") for i in range(6)] + [(3, "x " * 200), (7, None), (None, ""), (None, "alpha beta w1")]
    train = [t for i, t in rows if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2]
    seen = Counter(w for t in train for w in [*WORD.findall(fold(t or "")), "\n"])
    total, distinct = sum(seen.values()), len(seen)
    want = []
    for i, t in rows:
        own = [*WORD.findall(fold(t or "")), "\n"]
        base = sum(math.log10((seen[w] + 1) / (total + distinct + 1)) for w in own)
        want.append((str(i), len(own), sum(seen[w] > 0 for w in own), round(base, 6)))
    for head in (lm_mixing.HEAD, 3):  # with rare words met by the shuffle too
        out = lm_mixing.score(frame(spark, rows), head).collect()
        assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in out) == sorted(want)
        assert {r.train_tokens for r in out} == {total}


def test_every_training_text_teaches(spark, monkeypatch):
    """Dealt into lessons, each distinct row stands in one of its own half."""
    texts = [f"text {i}" for i in range(50)]
    batch = pa.RecordBatch.from_arrays([pa.array([*range(50), *range(50)], pa.int64()), pa.array(texts * 2)], ["doc_id", "text"])
    out = pa.Table.from_batches(list(lm_mixing._dealt(3)(iter([batch])))).to_pylist()
    assert sorted(r["text"] for r in out) == sorted(texts)
    assert all(r["lesson"] % 2 == (r["key"] & 1) and 0 <= r["lesson"] < 6 for r in out)


def test_every_token_teaches():
    """Each token decides once at the first node of its code; so many decisions taught that gate."""
    text = pa.array([" ".join(f"w{i * i % 97}" for i in range(500)), "w1 w4 unheard", ""])
    n = 500 + 3 + 3  # words and ends
    top = np.zeros(40, lm_mixing.COUNT)
    top["token"], top["n"] = np.unique(np.concatenate([h for _, h, *_ in lm_mixing.tokens(text)]))[:40], 1
    code, slots = lm_mixing.Code.of(top, 1000), lm_mixing.LEAST_SLOTS

    class Sent:
        value = [[np.zeros(2 * s, np.uint16).view("<i2") for s in lm_mixing._sizes(slots)]] * 2

    batch = pa.RecordBatch.from_arrays([pa.array([0] * 3, pa.int32()), pa.array([1, 2, 3], pa.int64()), pa.array([1, 2, 3], pa.int64()), text], ["lesson", "key", "more", "text"])
    (out,) = lm_mixing._lessons(code, slots, Sent())(iter([batch]))
    cell, taught = out.column("cell").to_numpy(), out.column("n").to_numpy()
    assert taught[cell < 3 * lm_mixing._SEEN**2].sum() == 3 * n  # three inputs a decision


def test_spelt_bytes_have_a_short_complete_code():
    """Common bytes take few decisions, no byte shares a code, and a word's decisions spell it."""
    letters = np.zeros(256, np.int64)
    letters[list(b"etaoinshr dlu")] = 1000
    letters[list(b"\n\t")] = 300
    top = np.zeros(3, lm_mixing.COUNT)
    top["token"], top["n"] = [1, 2, 3], 5
    for counts in (letters, letters * 10**12, np.zeros(256, np.int64), None):
        code = lm_mixing.Code.of(top, 20, counts)
        assert (0.5 ** code.byte_depth.astype(float)).sum() == 1
        spelt = ["tests".encode(), "née".encode(), bytes(set(range(256)) - set(words.SPACE))]
        taken = [[] for _ in spelt]
        for gate, word, slot, _, bit in lm_mixing._letters(code, spelt):
            assert gate < lm_mixing._GATES and slot.max() < lm_mixing._sizes(1)[3] and len(word) == len(bit)
            for w in word:
                taken[w].append(gate)
        assert [len(t) for t in taken] == [sum(int(code.byte_depth[b]) for b in w + b" ") for w in spelt]
        codes = {(*(code.byte_step[d, b] for d in range(code.byte_depth[b])),) for b in range(256)}
        assert len(codes) == 256
    code = lm_mixing.Code.of(top, 20, letters)
    assert sum(int(code.byte_depth[b]) for b in b"tests ") <= 5 * 6  # eight decisions a byte before
    assert (lm_mixing.Code.of(top, 20).byte_depth == 8).all()


def test_byte_counts_are_of_training_texts(spark):
    rows = [(i, f"Word{i}\tof é") for i in range(40)] + [(None, None)]
    docs = lm_mixing.shards.documents(frame(spark, rows), lm_mixing.held_out().alias("held")).withColumn("train", ~F.col("held"))
    stored = lm_mixing.counts(docs)
    train = [t for i, t in rows if t and zlib.crc32(str(i).encode()) % 7 != 2]
    want = Counter(b"".join(fold(t).encode() for t in train))
    got = lm_mixing.byte_counts(stored)
    assert {b: int(n) for b, n in enumerate(got) if n} == want
    total, distinct = stored.agg(F.sum("total"), F.sum("distinct")).first()
    assert total == sum(len(WORD.findall(t)) for t in train) + sum(zlib.crc32(str("" if i is None else i).encode()) % 7 != 2 for i, _ in rows)
    assert distinct == len({w for t in train for w in WORD.findall(fold(t))}) + 1


def test_distinct_records():
    rng = np.random.default_rng(2)
    records = np.zeros(500, lm_mixing.USE)
    for c in records.dtype.names:
        records[c] = rng.integers(0, 4, 500)
    assert np.array_equal(lm_mixing._distinct(records), np.unique(records))
    assert len(lm_mixing._distinct(records[:0])) == 0


def test_learning_in_steps_is_the_plain_sum():
    """One step of the weights and of the map, against sums decision by decision."""
    rng = np.random.default_rng(5)
    n = 1000
    for k in (2, 3):
        x, seen, bit = rng.normal(size=(k, n)).astype(np.float32), rng.integers(0, 16, n), rng.integers(0, 2, n)
        lesson = lm_mixing.Lesson()
        start = lesson.mix.refine[7].astype(float).copy()
        lesson.learn(7, x, seen, bit)
        mixed = np.clip((0.4 * x.astype(float)).sum(0), -7.99, 7.99)
        error, place = bit - 1 / (1 + np.exp(-mixed)), (mixed + 8) * 2
        for s in range(16):
            own = seen == s
            rate = 1 / (1 + np.sqrt(own.sum() / (8 * lm_mixing.STEP)))
            step = rate * (x[:, own] * error[own]).sum(1) / ((x[:, own] ** 2).sum(1) * 0.25 + 16)
            assert np.allclose(lesson.mix.weights[7, s, :k], 0.4 + step, atol=1e-4)
            assert (lesson.mix.weights[7, s, k:] == np.float32(0.4)).all() and lesson.n[7, s] == own.sum()
        hat = np.maximum(0, 1 - np.abs(place[:, None] - np.arange(33)))
        odds = 0.5 * (mixed + hat @ start)
        force, many = hat.T @ (bit - 1 / (1 + np.exp(-odds))), hat.sum(0)
        assert np.allclose(lesson.n_refine[7], many, atol=1e-2)
        assert np.allclose(lesson.mix.refine[7], start + 4 / (1 + np.sqrt(many / (8 * lm_mixing.STEP))) * force / (many + 16), atol=1e-3)


def test_classes_in_order_give_the_same_decisions():
    top = np.zeros(300, lm_mixing.COUNT)
    top["token"], top["n"] = np.arange(1, 301), np.arange(300, 0, -1)
    code = lm_mixing.Code.of(top, int(top["n"].sum()) + 50)
    h = np.random.default_rng(3).integers(1, 330, 2000).astype(np.uint64)
    kind, rank, _ = code.look(h)
    order = lm_mixing._by_class(kind)
    one, two = ([set() for _ in h] for _ in range(2))
    for gate, at, node, bit in code.decisions(kind, rank):
        for a, x, b in zip(at, node, bit, strict=True):
            one[a].add((gate, int(x), int(b)))
    for gate, at, node, bit in code.decisions(kind[order], rank[order], True):
        for a, x, b in zip(order[at], node, bit, strict=True):
            two[a].add((gate, int(x), int(b)))
    assert one == two


def test_held_out_bits_a_byte_of_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    size = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    bits, size = lm_mixing.score(docs).filter("held_out").join(size, "doc_id").agg(F.sum("score") * -math.log2(10), F.sum("size")).first()
    assert bits / size < 4.05  # 2.25 on the ten times larger table


def test_model_is_a_probability_and_learns_order(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(("aa bb cc", "dd ee ff gg")) for _ in range(60))) for i in range(400)]
    table = frame(spark, rows)
    out = lm_mixing.score(table).toPandas()
    held = out[out.held_out]
    assert held.score.sum() > 0.6 * held.base_score.sum()  # log10: far likelier than by single words
    again = lm_mixing.score(table.repartition(5)).toPandas().set_index("doc_id").score
    assert np.allclose(again[out.doc_id].to_numpy(), out.score, rtol=1e-5)


def test_codes_are_complete():
    top = np.zeros(1000, lm_mixing.COUNT)
    top["token"], top["n"] = np.arange(1, 1001), np.arange(1000, 0, -1)
    code = lm_mixing.Code.of(top, int(top["n"].sum()) + 50)
    kind, rank, count = code.look(top["token"])
    assert (count == top["n"]).all()
    length = np.zeros(1000, int)
    seen = [[] for _ in range(1000)]
    for gate, at, node, bit in code.decisions(kind, rank):
        length[at] += 1
        for a, n, b in zip(at, node, bit, strict=True):
            seen[a].append((gate, int(n), int(b)))
    assert len({tuple(s) for s in seen}) == 1000
    assert (0.5**length).sum() <= 1


def test_language_model_without_training_rows(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = lm_mixing.score(frame(spark, [(held, "some words")])).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0)
    assert r.base_score == 0
    assert lm_mixing.score(frame(spark, []).limit(0)).count() == 0


def plain_added(texts):
    """The spans that the method adds, by the docstring: EM over vote patterns, a classifier on their chances; in plain loops."""
    found = [pii.candidates(t or "") for t in texts]
    pattern = Counter(c[4] for f in found for c in f)
    codes = sorted(pattern)
    vote, size, kind = pii._unpack(np.array(codes, np.int64))
    soft = {}
    for k in range(len(pii.KINDS)):
        own = [i for i in range(len(codes)) if kind[i] == k]
        rate = {1: [[0.1, 0.3, 0.6]] * pii.LABELERS, 0: [[0.6, 0.3, 0.1]] * pii.LABELERS}
        start, prior, chance, old = rate, 0.5, {}, {}
        for _ in range(100):
            for i in own:
                like = {c: (prior if c else 1 - prior) * math.prod(rate[c][j][vote[i, j] + 1] for j in range(pii.LABELERS)) for c in (0, 1)}
                chance[i] = like[1] / (like[0] + like[1])
            if all(abs(chance[i] - old.get(i, 0)) < 1e-10 for i in own):
                break
            old = dict(chance)
            rate = {0: [], 1: []}
            for c in (0, 1):
                for j in range(pii.LABELERS):
                    seen = [2 * start[c][j][v] + sum(pattern[codes[i]] * (chance[i] if c else 1 - chance[i]) for i in own if vote[i, j] + 1 == v) for v in range(3)]
                    rate[c].append([x / sum(seen) for x in seen])
            n = sum(pattern[codes[i]] for i in own)
            prior = (sum(pattern[codes[i]] * chance[i] for i in own) + 1) / (n + 2)
        soft |= chance
    traits = []
    for i in range(len(codes)):
        row = [1.0] + [float(vote[i, j] == 1) for j in range(pii.LABELERS)] + [float(vote[i, j] == -1) for j in range(pii.LABELERS)]
        traits.append(row + [float(size[i] == x) for x in range(5)] + [float(kind[i] == x) for x in range(len(pii.KINDS))])
    x, n, y = np.array(traits), np.array([pattern[c] for c in codes], float), np.array([soft[i] for i in range(len(codes))])
    n /= max(1.0, n.mean())
    w = np.zeros(x.shape[1])
    for _ in range(40_000):  # plain gradient descent to the same minimum
        w -= 0.5 * (x.T @ (n * (1 / (1 + np.exp(-x @ w)) - y)) + 1e-2 * w) / n.sum()
    chance = dict(zip(codes, (1 / (1 + np.exp(-x @ w))).tolist(), strict=True))
    return [sorted((k, a, b) for k, a, b, base, code in f if not base and chance[code] >= 0.5) for f in found], chance


def test_added_spans_are_those_of_plain_em_and_descent(spark):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
        text = rng.choice([
            f"mail me: joe{i} (at) site (dot) com", f"call {digits(3)} {digits(3)} {digits(4)} please", f"+49 30 {digits(7)}", f"order {digits(3)} {digits(3)} {digits(4)}",
            f"a.b@site{i}.org and 10.0.0.{i % 256}", f"card 4{digits(15)}", f"serial {digits(14)}", "host fe80:0:0:0:1:2:3:4 up", "nothing here",
        ])
        rows.append((i, text))
    want, chance = plain_added([t for _, t in rows])
    assert all(abs(c - 0.5) > 0.01 for c in chance.values())
    got = {r.doc_id: r for r in pii.find(frame(spark, rows)).collect()}
    for (i, _), added in zip(rows, want, strict=True):
        every, base = (sorted(x.split(",")) if x else [] for x in (got[i].spans, got[i].base))
        assert sorted(f"{k}:{a}:{b}" for k, a, b in added) == sorted(set(every) - set(base))
    assert any(want)


LONG = 1_000_000
VERY_LONG = {
    "letters": "a" * LONG + "@b.c", "digits": "1" * LONG, "dots": "1." * (LONG // 2), "ats": "@a.b " * (LONG // 5), "signs": "@" * LONG, "plus": "+1" + "(" * LONG,
    "pluses": "+1 " * (LONG // 3), "spelt": "a" * LONG + " (at) b", "cards": "4111 1111 1111 1112 " * (LONG // 20), "phones": "030 123 4567, " * (LONG // 14),
    "colons": "a:" * (LONG // 2), "dashes": "-" * LONG, "domains": "x@" + "a." * (LONG // 2), "mails": "a@b.c " * (LONG // 6), "brackets": "x(at)" * (LONG // 5),
}


@pytest.mark.parametrize("name", sorted(VERY_LONG))
def test_personal_data_takes_linear_time(name):
    took = []
    for part in (4, 1):
        text = VERY_LONG[name][-LONG // part :]
        began = time.perf_counter()
        pii.candidates(text)
        took.append(time.perf_counter() - began)
    assert took[1] < max(1.0, 12 * took[0]) and took[1] < 20


# --- toxicity ---


def slow_segments(s):
    """By definition: recursively the best segment, then both sides."""
    if not len(s) or max(s) <= 0:
        return []
    best, at = 0, None
    for a in range(len(s)):
        total = 0.0
        for b in range(a, len(s)):
            total += s[b]
            if total > best + 1e-12:
                best, at = total, (a, b + 1)
    a, b = at
    return slow_segments(s[:a]) + [(a, b, best)] + [(x + b, y + b, z) for x, y, z in slow_segments(s[b:])]


def test_segments_match_the_definition():
    rng = np.random.default_rng(3)
    for _ in range(300):
        s = rng.normal(-0.2, 1, rng.integers(0, 25))
        got = toxicity.segments(s)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in slow_segments(s)]


def scores_of(model, words):
    _, _, h, begun, *_ = next(iter(toxicity._tokens(pa.array([" ".join(words)]))))
    return model.of(h, begun)


def plain_tokens(text):
    cut = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
    return [w.strip(cut) or w for w in WORD.findall(fold(text or ""))]


def plain_scores(texts, least):
    """The score of any word by the docstring; texts: (text, toxic), all different."""
    bad, good = Counter(), Counter()
    for text, toxic in texts:
        (bad if toxic else good).update(set(plain_tokens(text)))
    starts = lambda w: [w.encode()[:k] for k in range(8, 2, -1) if len(w.encode()) >= k]
    stem = {}
    for w in set(bad) | set(good):
        for b in starts(w):
            cell = stem.setdefault(b, [0.0, 0.0])
            cell[0] += bad[w] / (bad[w] + good[w])
            cell[1] += good[w] / (bad[w] + good[w])

    def root(b, g, n1, n0):
        part = lambda x, e: x * math.log(x / e) if x else 0.0
        return math.sqrt(max(0.0, 2 * (part(b, (b + g) * n1 / (n1 + n0)) + part(g, (b + g) * n0 / (n1 + n0)))))

    odds = lambda b, g, n1, n0, share: min(8, max(-4, math.log((b + share) / n1) - math.log((g + 1 - share) / n0)))
    n1, n0 = sum(bad.values()), sum(good.values())
    t1 = sum(bad[w] / (bad[w] + good[w]) for w in set(bad) | set(good))
    t0 = len(set(bad) | set(good)) - t1
    kept = {b: odds(*c, t1, t0, t1 / (t1 + t0)) for b, c in stem.items() if root(*c, t1, t0) >= least}

    def score(w):
        above = next((kept[b] for b in starts(w) if b in kept), None)
        if bad[w] + good[w] and (above is not None or root(bad[w], good[w], n1, n0) >= least):
            return odds(bad[w], good[w], n1, n0, 1 / (1 + math.exp(-(above or 0)) * n0 / n1))
        return -toxicity.DRIFT if above is None else above

    return score


def test_scores_are_those_of_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "LEAST_Z", (3.0,))
    rng = random.Random(4)
    calm = ["Été,", "日本", "x", "--", "can't"] + [f"word{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(1, 600):
        text = [rng.choice(calm) for _ in range(rng.randint(5, 50))]
        if i % 5 == 2:
            text.insert(rng.randrange(len(text)), rng.choice(["Nasty!", "vile***", f"loweihr{rng.randrange(90)}", f"réeux{rng.randrange(90)}"]))
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(i % 5 == 2)))
    table = frame(spark, rows)
    model = toxicity.fit(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    train = {t: x for (i, t), (_, _, x) in zip(rows, labels, strict=True) if zlib.crc32(str(i).encode()) % 5}
    score = plain_scores(list(train.items()), 3.0)
    new = ["loweihrfremd", "réeuxnouveau", "nastyish", "strange", "wordless", "a"]
    every = sorted({w for t in train for w in plain_tokens(t)}) + new
    assert np.allclose(scores_of(model, every), [score(w) for w in every])
    assert score("loweihrfremd") > 1 and score("réeuxnouveau") > 1 and score("strange") < 0
    out = {r.doc_id: r.score for r in toxicity.score(table, model).collect()}
    for i, text in rows[::7]:
        s = [score(w) for w in plain_tokens(text)]
        p = [1 - math.exp(-model.k * len(s) * math.exp(-model.lam * x)) for *_, x in slow_segments(s)]
        best = max((x for *_, x in slow_segments(s)), default=0.0)
        logs = [-math.log10(x) for x in p]
        x = [min(max(logs, default=0.0), 40), math.sqrt(min(400, sum(x for x in logs if x >= 3))), best / math.sqrt(len(s) + 1)]
        z = model.curve[0] + float(np.dot(x, model.curve[1:]))
        assert math.isclose(out[i], 1 / (1 + math.exp(-z)), rel_tol=1e-6)


def test_held_out_labels_of_the_tables_are_found(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    out = toxicity.score(docs, toxicity.fit(docs, labels)).filter("held_out").join(labels, "doc_id")
    found = {r.toxic: (r.n, r.hit) for r in out.groupBy("toxic").agg(F.count("*").alias("n"), F.sum("predicted").alias("hit")).collect()}
    assert found[1][1] >= 0.8 * found[1][0]
    assert found[0][1] <= 0.01 * found[0][0]


def test_very_long_texts_are_scored_whole(spark):
    rows = [(i, f"calm{i % 7} text {'vile' if i % 3 == 0 else 'kind'} end") for i in range(1, 200)]
    table = frame(spark, rows)
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int")
    model = toxicity.fit(table, labels)
    long = [(1, "word " * 300_000 + "vile vile vile vile " * 5 + "word " * 1000), (2, "x" * 2_000_000), (None, "!" * 1_000_000)]
    out = {r.doc_id: r for r in toxicity.score(frame(spark, long), model).collect()}
    assert out[1].segments >= 1 and out[2].segments == out[None].segments == 0


def test_held_out_toxic_texts_are_found(spark):
    rng = random.Random(9)
    calm = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        text = [rng.choice(calm) for _ in range(rng.randint(20, 120))]
        bad = i % 6 == 0
        if bad:
            for _ in range(6):
                text.insert(rng.randrange(len(text)), rng.choice(["nasty", "Vile", "foul"]))
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(bad)))
    rows += [(5000, None), (5001, "")]
    table, known = frame(spark, rows), spark.createDataFrame([*labels, (5002, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(table, known)
    out = toxicity.score(table, model).toPandas().set_index("doc_id")
    assert out.score.between(0, 1).all()
    assert len(out) == len(rows)
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert out.held_out[held].all()
    right = sum(out.predicted[i] == (i % 6 == 0) for i in held)
    assert right >= 0.97 * len(held)
    assert toxicity.passages(table, model).filter("lower(passage) rlike 'nasty|vile|foul'").count() > 100
    kept = toxicity.clean_documents(table, known)
    assert kept.columns == table.columns
    assert kept.count() == (out.predicted == 0).sum()


@pytest.mark.parametrize(("texts", "size"), [(400, 30), (400, 400), (2400, 30), (2400, 200)])
def test_words_of_toxic_texts_alone_are_kept(spark, texts, size):
    rng = random.Random(texts + size)
    calm, rude = [f"word{i}" for i in range(300)], ["nasty", "vile", "foul"]
    rows, labels = [], []
    for i in range(texts):
        text = [rng.choice(calm) for _ in range(size)]
        if i % 8 == 0:
            text.insert(rng.randrange(size), rng.choice(rude))
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(i % 8 == 0)))
    table, known = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(table, known)
    assert (scores_of(model, rude) > 0).all()


def test_rows_are_scored_one_by_one_whatever_their_id(spark):
    rows = [(i, f"calm{i % 7} t{i} text {'vile' if i % 3 == 0 else 'kind'} end") for i in range(1, 200)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int")
    model = toxicity.fit(frame(spark, rows), labels)
    odd = [(None, "vile vile"), (None, "kind"), (4, "vile vile"), (4, "kind"), (4, "kind"), (None, None)]
    out = sorted((str(r.doc_id), r.predicted) for r in toxicity.score(frame(spark, odd), model).collect())
    assert out == sorted([("None", 1), ("None", 0), ("4", 1), ("4", 0), ("4", 0), ("None", 0)])


def test_toxicity_without_labels(spark):
    table = frame(spark, [(1, "a"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in toxicity.score(table, toxicity.fit(table, none)).collect()} == {0}
    assert toxicity.score(table.limit(0), toxicity.fit(table.limit(0), none)).count() == 0
