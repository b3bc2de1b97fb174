"""A whole run from the command line: accounts from a CSV file through the pipeline to gold, tables under --base."""

from __future__ import annotations

import argparse
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave import config
from kinweave.plans import service
from kinweave.sources import io

_DEMO = "a1|Acme Corp,a2|ACME Corporation,a3|acme corp,b1|Globex,b2|Globex Inc.,c1|Initech"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kinweave", description=__doc__)
    env = os.environ
    p.add_argument("--base", required=True, help="folder of the tables, shared by the cluster")
    p.add_argument("--input_csv", default="", help="CSV with account_id and account_name; a demo without it")
    p.add_argument("--cycle_name", default="", help="the run's id and the folder of its CSV files")
    p.add_argument("--admin_review", default="", help="CSV of pair_key, answer (y/n), note, reviewer on proposals")
    p.add_argument("--review", default="", help="CSV of pair_key, answer (y/n/s), note, reviewer on queued pairs")
    p.add_argument("--llm_array_size", type=int, default=None, help="candidates to a request")
    p.add_argument("--scope", default=env.get("SCOPE", "all"), choices=["all", "foci", "foci_related"])
    p.add_argument("--focals", default=env.get("FOCALS", ""), help="ids, separated by commas")
    p.add_argument("--seed_pairs", default=env.get("SEED_PAIRS", ""), help="pair keys, separated by commas")
    p.add_argument("--rerun_scope", default="", choices=["", "all", "focal", "component"], help="judge again after the review")
    p.add_argument("--demo_stateful", action="store_true", help="keep the accounts given so far and add to them")
    p.add_argument("--add_accounts", default="", help="id|name, id|name")
    return p


def accounts(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    shape = "account_id string, account_name string"
    if args.input_csv:
        return io.read_csv(spark, args.input_csv, ("account_id", "account_name"))
    out = spark.createDataFrame(config.parse_accounts(_DEMO), shape)
    if args.demo_stateful:
        old = io.latest(io.read(spark, args.base, "accounts_raw"), ["account_id"], F.col("run_id")).select("account_id", "account_name")
        out = io.upsert(out, old, ["account_id"])
    if args.add_accounts:
        out = io.upsert(out, spark.createDataFrame(config.parse_accounts(args.add_accounts), shape), ["account_id"])
    return out


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> dict[str, DataFrame]:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("kinweave").getOrCreate()
    own = service.Service(spark, args.base)
    params = {**os.environ, "SCOPE": args.scope, "FOCALS": args.focals, "SEED_PAIRS": args.seed_pairs, "FINALIZE": "true"}
    params["RUN_ID"] = args.cycle_name or params.get("RUN_ID", "run-1")
    if args.llm_array_size:
        params["LLM_BATCH_SIZE"] = str(args.llm_array_size)
    own.run("FULL_PIPELINE", {**params, "accounts": accounts(spark, args)})
    if args.review:
        own.run("REVIEW", {**params, "answers": io.read_csv(spark, args.review, ("pair_key", "answer"))})
    if args.rerun_scope:
        own.run("RERUN_ONLY", {**params, "RERUN_SCOPE": args.rerun_scope, "RERUN_FOCALS": args.focals, "use_stored_notes": True})
    if args.admin_review:
        own.run("FINALIZE", {**params, "FINALIZE": "false"})
        own.run("ADMIN_REVIEW", {**params, "admin_answers": io.read_csv(spark, args.admin_review, ("pair_key", "answer"))})
    out = own.run("FINALIZE", params)
    cfg = config.Config.from_env(params)
    service.export(own, cfg, f"{args.base}/export/{cfg.run_id}")
    return out


if __name__ == "__main__":
    for name, df in main().items():
        print(f"{name}: {df.count()} rows")
