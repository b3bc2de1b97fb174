from kinweave.config import Config
from kinweave.sources import io
from kinweave.streaming import ingest


def test_micro_batches_become_runs(spark, tmp_path):
    source, base, kept = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    kind = "account_id string, account_name string"
    for rows in ([("1", "Acme, Inc.")], [("1", "ACME Int"), ("2", "Zed")]):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(source)
        ingest.ingest(spark.readStream.schema(kind).parquet(source), base, Config(run_id="s"), kept).awaitTermination(60)
    raw = io.read(spark, base, "accounts_raw")
    assert {(r.account_id, r.normalized_name, r.run_id) for r in raw.collect()} == {("1", "acme inc", "s-000000"), ("1", "acme int", "s-000001"), ("2", "zed", "s-000001")}
    assert {(r.account_id, r.account_name) for r in ingest.current_accounts(raw).collect()} == {("1", "ACME Int"), ("2", "Zed")}
