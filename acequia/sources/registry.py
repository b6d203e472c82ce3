"""Fitted models as a Parquet table, one folder per model type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acequia.functions.naming import type_prefix
from acequia.schema import KEY, REGISTRY_SCHEMA


def save_models(models: DataFrame, path: str) -> None:
    """Append models; failed fits are kept with their errors, so that they can be reported."""
    models.write.mode("append").partitionBy("model_type").parquet(path)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REGISTRY_SCHEMA).parquet(path)


def load_models(
    spark: SparkSession, path: str, types: list[str] | str, latest: bool = True
) -> DataFrame:
    """Models of the chosen types; only their folders are read.

    A model trained again replaces its older self: ``latest`` keeps the newest
    row per type, station and target; a failed fit only where none succeeded.
    """
    types = [types] if isinstance(types, str) else list(types)
    chosen = read_registry(spark, path).filter(F.col("model_type").isin(types))
    if not latest:
        return chosen
    rest = [c for c in chosen.columns if c not in ("model_type", KEY, "target")]
    return (
        chosen.groupBy("model_type", KEY, "target")
        .agg(F.max_by(F.struct(*rest), F.struct(F.col("error").isNull(), "trained_at")).alias("_m"))
        .select("model_type", KEY, "target", "_m.*")
        .select(*chosen.columns)
    )


def require_models(models: DataFrame) -> DataFrame:
    if models.isEmpty():
        raise ValueError("no trained models of the chosen types")
    return models


def list_models(registry: DataFrame) -> DataFrame:
    return registry.select(F.concat("name", F.lit("_model")).alias("name")).distinct()


def available_types(names: DataFrame, column: str = "name") -> DataFrame:
    """Distinct model types found by prefix in saved model names."""
    kind = type_prefix(F.col(column)).alias("model_type")
    return names.select(kind).filter(F.col("model_type").isNotNull()).distinct()
