"""Exact groups, mapping application, candidate pairs and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave import config
from kinweave.config import Config
from kinweave.functions import text, vector


def group_flags(df: DataFrame) -> DataFrame:
    """group_size, is_master, is_dupe of rows with a master.

    Sizes are counted before the shuffle and joined back, so a group that holds most rows is one row
    on one side and splits on the other.
    """
    size = df.groupBy("master_account_id").agg(F.count("*").alias("group_size"))
    out = df.drop("group_size").join(size, "master_account_id")
    return out.withColumns({"is_master": F.col("account_id") == F.col("master_account_id"), "is_dupe": F.col("group_size") > 1})


def _rule() -> Column:
    return F.when(F.col("is_dupe"), F.lit(config.PERFECT))


def perfect_match(accounts: DataFrame) -> DataFrame:
    """Accounts of one normalised name under the smallest id; null names drop out. A name of very many accounts is no hot task, as in group_flags."""
    named = accounts.withColumn("normalized_name", text.normalize_name(F.col("account_name"))).dropna(subset=["normalized_name"])
    groups = named.groupBy("normalized_name").agg(F.min("account_id").alias("master_account_id"), F.count("*").alias("group_size"))
    out = named.join(groups, "normalized_name")
    out = out.withColumns({"is_master": F.col("account_id") == F.col("master_account_id"), "is_dupe": F.col("group_size") > 1})
    return out.withColumn("stage_rule", _rule())


def apply_mapping(matched: DataFrame, mapping: DataFrame, overrides: DataFrame | None = None, recompute_rule: bool = True) -> DataFrame:
    """Rewrites masters by (old_master_id, canonical_master_id), then accounts by overrides, and takes the flags again."""
    to = mapping.select(F.col("old_master_id").alias("master_account_id"), "canonical_master_id")
    out = matched.join(to, "master_account_id", "left")
    out = out.withColumn("master_account_id", F.coalesce("canonical_master_id", "master_account_id")).drop("canonical_master_id")
    if overrides is not None:
        own = overrides.select("account_id", F.col("master_account_id").alias("_own"))
        out = out.join(own, "account_id", "left").withColumn("master_account_id", F.coalesce("_own", "master_account_id")).drop("_own")
    out = group_flags(out)
    return out.withColumn("stage_rule", _rule()) if recompute_rule else out


def masters(matched: DataFrame) -> DataFrame:
    return matched.filter(F.col("account_id") == F.col("master_account_id"))


def _keyed(pairs: DataFrame) -> DataFrame:
    """With text.pair_key of the ids, which come in order."""
    return pairs.select(F.concat("a_id", F.lit("|"), "b_id").alias("pair_key"), F.col("a_id").alias("master_a_id"), F.col("b_id").alias("master_b_id"), "score")


def similarity_pairs(vectors: DataFrame, decided: DataFrame | None = None, least: float | None = None, rows: int | None = None) -> DataFrame:
    """pair_key, master_a_id, master_b_id, score of all pairs of (id, embedding), without those decided already (pair_key).

    Decided keys go to the tiles, so that the pairs, whose number is the square of the ids', need no shuffle.
    """
    return _keyed(vector.all_pairs(vectors, least=least, rows=rows, without=None if decided is None else text.ends_of(decided, "pair_key")))


def pairs_of(vectors: DataFrame, ids: DataFrame, least: float | None = None) -> DataFrame:
    """The pairs of some ids (id) with all others, without the other pairs' product."""
    some = vectors.join(ids.select("id").distinct(), "id", "left_semi")
    return _keyed(vector.cross_pairs(some, vectors, least=least))


def least_cosine(cfg: Config) -> float | None:
    """The cosine below which no pair reaches the review band, whatever its names; None where rejected pairs are kept too."""
    if cfg.keep_rejected:
        return None
    fuzz = max(0.0, cfg.fuzz_weight)
    return (cfg.t_low - fuzz) / cfg.emb_weight if fuzz and cfg.emb_weight > 0 else cfg.t_low if not cfg.fuzz_weight else None


def route_counts(vectors: DataFrame, cfg: Config, rows: int | None = None) -> DataFrame:
    """(route, n) of all pairs, counted inside the tiles."""
    n = vector.band_counts(vectors, (cfg.t_low, cfg.t_auto), rows=rows)
    names = F.element_at(F.array(F.lit(config.REJECT), F.lit(config.REVIEW), F.lit(config.AUTO)), F.col("band") + 1)
    return n.select(names.alias("route"), "n")


def scores_of(wanted: DataFrame, candidates: DataFrame) -> DataFrame:
    """The wanted pairs (pair_key) with their candidates' score, 0.0 where there is none."""
    known = candidates.groupBy("pair_key").agg(F.max("score").alias("_score"))
    return wanted.join(known, "pair_key", "left").withColumn("score", F.coalesce("_score", F.lit(0.0))).drop("_score")


def with_fuzz(pairs: DataFrame, names: DataFrame, cfg: Config) -> DataFrame:
    """Adds emb_score and fuzz_score and mixes them into score; names: id, account_name."""
    out = pairs.withColumnRenamed("score", "emb_score")
    for side in ("a", "b"):
        out = out.join(names.select(F.col("id").alias(f"master_{side}_id"), F.col("account_name").alias(f"name_{side}")), f"master_{side}_id", "left")
    out = out.withColumn("fuzz_score", text.token_sort_ratio(text.normalize_name(F.col("name_a")), text.normalize_name(F.col("name_b"))))
    mixed = F.lit(cfg.emb_weight) * F.col("emb_score") + F.lit(cfg.fuzz_weight) * F.coalesce("fuzz_score", F.lit(0.0))
    return out.withColumn("score", mixed).drop("name_a", "name_b")


def route_of(score: Column, cfg: Config) -> Column:
    return F.when(score >= cfg.t_auto, config.AUTO).when(score >= cfg.t_low, config.REVIEW).otherwise(config.REJECT)


def route(pairs: DataFrame, cfg: Config) -> DataFrame:
    """Both bounds belong to the upper band; automatic pairs propose a master to keep."""
    auto = F.col("route") == config.AUTO
    return pairs.withColumn("route", route_of(F.col("score"), cfg)).withColumns(
        {
            "proposed_keep_master": F.when(auto, F.col("master_a_id")),
            "proposed_merge_master": F.when(auto, F.col("master_b_id")),
            "policy": F.lit(config.POLICY),
            "threshold_version": F.lit(config.THRESHOLDS),
        }
    )


def incremental_pairs(old: DataFrame, vectors: DataFrame, affected: DataFrame) -> DataFrame:
    """Pairs after the affected ids' vectors changed: untouched pairs stay, and only the affected ids' products with all ids are taken again; equals a full run.

    The affected ids are broadcast, as the pairs are the square of the ids and would all be shuffled twice.
    """
    changed = affected.select("id").distinct()
    stay = old
    for side in ("master_a_id", "master_b_id"):
        stay = stay.join(F.broadcast(changed.withColumnRenamed("id", side)), side, "left_anti")
    return stay.select(*old.columns).unionByName(pairs_of(vectors, changed).select(*old.columns))
