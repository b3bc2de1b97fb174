"""The pipeline's stages against plain versions of them, and the queries against SQL."""

import duckdb
import pytest

import corpus_pipeline
from kinweave.llm import mixing, pieces, queries, toxicity
from tests.llm.common import corpus, frame
from tests.llm.test_dedup import plain_components, plain_exact

TESTDATA = "/root/testdata/sf0.001"


def test_stages_drop_what_they_should(spark, tmp_path):
    rows = corpus()
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = docs.columns
    step = dict(corpus_pipeline.STAGES)
    clean = step["toxicity"](spark, docs, str(tmp_path))
    assert clean.columns == names and clean.count() == len(rows)
    kept = step["exact dedup"](spark, clean, str(tmp_path))
    stay = {i for i, keep, _, k, _ in plain_exact(rows) if k}
    assert kept.columns == names and {r.doc_id for r in kept.collect()} == stay
    near = step["n-gram jaccard join"](spark, kept, str(tmp_path))
    roots = {i for i, _, root in plain_components([r for r in rows if r[0] in stay]) if i == root}
    assert near.columns == names and {r.doc_id for r in near.collect()} == roots
    mixed = step["mixing"](spark, near, str(tmp_path))
    times = sum(-(-r.taken // r.size) if r.size else 1 for r in mixing.mix(near).collect())
    assert mixed.columns == names and mixed.count() == times
    last = step["sentencepiece"](spark, mixed, str(tmp_path))
    assert last.count() == times
    texts = dict(rows)
    assert all(r.text == texts[r.doc_id] for r in pieces.decode(last).collect())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == times


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{TESTDATA}/documents.parquet'")
    want = con.sql(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, TESTDATA).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)
    assert sorted(map(str, got[names].itertuples(index=False))) == sorted(map(str, want[names].itertuples(index=False)))


def test_toxic_rows_leave_the_pipeline(spark):
    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet")
    labels = spark.read.parquet(f"{TESTDATA}/labels.parquet")
    gone = {r.doc_id for r in toxicity.score(docs, toxicity.fit(docs, labels)).filter("predicted = 1").collect()}
    kept = {r.doc_id for r in corpus_pipeline.toxic(spark, docs, TESTDATA).collect()}
    assert not kept & gone and len(kept) + len(gone) == docs.count()


def odd_ids():
    """Texts without or under one repeated doc_id, of which some are near copies of others, with the texts that stay."""
    long = lambda name, n=60: " ".join(f"{name}{i}" for i in range(n))
    near = lambda name: long(name) + " end"
    rows = [(1, long("a")), (None, near("a"))]  # a near copy without an id
    rows += [(None, long(f"n{k}")) for k in range(6)] + [(7, long(f"r{k}")) for k in range(4)]
    rows += [(2, long("b")), (7, near("b"))]
    return rows, {t for _, t in rows} - {near("a"), near("b")}


def test_near_copies_alone_leave_when_ids_are_null_or_repeated(spark):
    rows, stay = odd_ids()
    got = [r.text for r in corpus_pipeline.near(spark, frame(spark, rows + rows[2:4] * 3), "").collect()]
    assert sorted(got) == sorted(stay)


def test_one_row_of_equal_texts_stays_when_ids_are_null_or_repeated(spark):
    rows, _ = odd_ids()
    copies = [(None, rows[0][1]), (3, rows[2][1]), (7, "  " + rows[8][1]), (7, rows[9][1]), (9, rows[9][1])]
    got = [(r.doc_id, r.text) for r in corpus_pipeline.exact(spark, frame(spark, rows * 3 + copies), "").collect()]
    # a copy with an id goes before one without, and one with more code points before both
    want = set(rows) - {rows[2], rows[8]} | {copies[1], copies[2]}
    assert sorted(got, key=str) == sorted(want, key=str)
