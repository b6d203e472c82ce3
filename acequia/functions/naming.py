"""Name rules: column headings, model names, file extensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acequia.schema import NAME_PREFIXES, ROBUST_PATTERNS, SPANISH_NAMES, VARIABLES


def require_climate(columns: list[str]) -> None:
    """Every one of the seven must be there, under its Spanish heading or our name."""
    missing = [es for es, canon in SPANISH_NAMES.items() if es not in columns and canon not in columns]
    if missing:
        raise ValueError(f"missing climate columns: {missing}")


def known_names(df: DataFrame) -> DataFrame:
    """Rename the Spanish headings that are there."""
    return df.withColumnsRenamed({k: v for k, v in SPANISH_NAMES.items() if k in df.columns})


def canonical_names(df: DataFrame) -> DataFrame:
    """Rename the Spanish headings by name; every one of the seven must be there."""
    require_climate(df.columns)
    return known_names(df)


def spanish_names(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({v: k for k, v in SPANISH_NAMES.items()})


def date_column(columns: list[str]) -> str:
    """First heading that contains 'fecha' in any case."""
    for name in columns:
        if "fecha" in name.lower():
            return name
    raise ValueError(f"no date column among {columns}")


def routed_scaler(heading: Column) -> Column:
    """'robust' or 'standard' for a column of headings."""
    low = F.lower(heading)
    hit = F.lit(False)
    for pattern in ROBUST_PATTERNS:
        hit = hit | low.contains(pattern)
    return F.when(hit, F.lit("robust")).otherwise(F.lit("standard"))


def bare_model_name(name: Column) -> Column:
    return F.replace(name, F.lit("_model"), F.lit(""))


def model_family(name: Column) -> Column:
    """sarima / sarimax share one table per family; any other model is its own."""
    bare = bare_model_name(name)
    return (
        F.when(bare.startswith("sarima_"), F.lit("sarima"))
        .when(bare.startswith("sarimax_"), F.lit("sarimax"))
        .otherwise(bare)
    )


def type_prefix(name: Column) -> Column:
    """Model type by the prefix of a saved model's name, null for unknown ones."""
    low = F.lower(name)
    out = None
    for prefix in NAME_PREFIXES:
        test = low.startswith(prefix + "_")
        out = F.when(test, F.lit(prefix)) if out is None else out.when(test, F.lit(prefix))
    return out


def sheet_name(model: Column) -> Column:
    return F.upper(F.substring(model, 1, 31))


def exog_columns(target: str, columns=VARIABLES, limit: int | None = None) -> list[str]:
    """Every column but the target, or only the first ``limit`` of them."""
    others = [c for c in columns if c != target]
    return others if limit is None else others[:limit]
