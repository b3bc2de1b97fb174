"""Text expressions: names, pair keys, similarity texts, token-sort ratio."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def normalize_name(c: Column) -> Column:
    """Lower case, runs of anything but a-z and 0-9 as one space, trimmed; null stays null."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def pair_key(a: Column, b: Column) -> Column:
    """The ids in string order with a bar between; null if either is."""
    return F.when(a.isNotNull() & b.isNotNull(), F.concat_ws("|", F.least(a, b), F.greatest(a, b)))


def split_pair(key: Column) -> tuple[Column, Column]:
    """The two sides of a key, cut at the first bar; null if there is none."""
    parts = F.split(key, r"\|", 2)
    return parts[0], F.try_element_at(parts, F.lit(2))


def ends_of(keys: DataFrame, key: str) -> DataFrame:
    """(a_id, b_id) of the keys, a_id < b_id; a key of several bars gives every pair that has it."""
    parts = F.split(F.col(key), r"\|", -1)
    cut = keys.select(parts.alias("_p")).filter(F.size("_p") > 1).select("_p", F.explode(F.sequence(F.lit(1), F.size("_p") - 1)).alias("_i"))
    a, b = F.array_join(F.slice("_p", F.lit(1), F.col("_i")), "|"), F.array_join(F.slice("_p", F.col("_i") + 1, F.size("_p") - F.col("_i")), "|")
    return cut.select(a.alias("a_id"), b.alias("b_id")).filter("a_id < b_id")


def weighted_text(columns: Sequence[str], weights: Mapping[str, float]) -> Column:
    """Normalised values, each as often as its weight's whole part (once at least), blanks left out."""
    parts = []
    for c in columns:
        times = int(max(1, weights.get(c, 1)))
        value = normalize_name(F.col(c))
        parts.append(F.when(F.col(c) != "", F.concat_ws(" ", F.array_repeat(value, times))))
    return F.concat_ws(" ", *parts)


def combined_text(columns: Sequence[str]) -> Column:
    return normalize_name(F.concat_ws(" | ", *[F.col(c) for c in columns]))


def context_hash(c: Column) -> Column:
    return F.substring(F.sha2(F.coalesce(c, F.lit("")), 256), 1, 12)


def csv_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def _indel(a: str | None, b: str | None) -> float | None:
    """2 * LCS / (len + len) of the sorted tokens; the LCS by one big-integer step per character."""
    if a is None or b is None:
        return None
    a, b = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    if not a and not b:
        return 1.0
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & places.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return 2 * (len(a) - row.bit_count()) / (len(a) + len(b))


@F.pandas_udf(DoubleType())
def token_sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two names in [0, 1] whatever their word order; Arrow batches, linear in the length per 64 characters."""
    return pd.Series([_indel(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")
