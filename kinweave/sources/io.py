"""Tables at rest: explicit schemas, partition pruning by run, idempotent appends."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from kinweave import schemas


def read(spark: SparkSession, base: str, table: str, metadata: tuple[str, ...] = (), run_id: str | None = None) -> DataFrame:
    """A table with its schema; a missing one is empty. With run_id only that partition is read."""
    shape = schemas.schema(table, metadata)
    try:
        df = spark.read.schema(shape).parquet(f"{base}/{table}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        df = spark.createDataFrame([], shape)
    return df if run_id is None else df.filter(F.col("run_id") == run_id)


def conform(df: DataFrame, table: str, metadata: tuple[str, ...] = ()) -> DataFrame:
    """The table's columns in order and type; missing ones are null, others dropped."""
    shape = df.sparkSession.createDataFrame([], schemas.schema(table, metadata)).schema
    have = set(df.columns)
    return df.select(*[(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in shape])


def append(df: DataFrame, base: str, table: str, metadata: tuple[str, ...] = ()) -> None:
    """Writes rows of one or more runs; writing a run (or one step of it) again replaces it."""
    out = conform(df, table, metadata).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.partitionBy(*schemas.partitions(table)).parquet(f"{base}/{table}")


def read_csv(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> DataFrame:
    """All columns as strings; a missing required column is an error."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def write_csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def with_blank(df: DataFrame, **values) -> DataFrame:
    """The rows and one more, null but for the given values."""
    shape = StructType([StructField(f.name, f.dataType) for f in df.schema])
    return df.unionByName(df.sparkSession.createDataFrame([tuple(values.get(f.name) for f in shape)], shape))


def without(df: DataFrame, key: str, *values) -> DataFrame:
    """The rows but for those of the given keys; rows without a key stay."""
    return df.filter(~F.coalesce(F.col(key).isin(*values), F.lit(False)))


def project(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Those of the wanted columns that are there."""
    return df.select(*[c for c in wanted if c in df.columns])


def ensure_columns(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Adds missing columns as typed nulls."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items() if c not in df.columns})


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row a key: the last by the given order (nulls first)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[c.desc_nulls_last() for c in order]))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Old and new rows by key; a new row replaces an old one, and of several new ones the last stays."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return latest(both, keys, F.col("_new"), *order).drop("_new")
