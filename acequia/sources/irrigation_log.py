"""Irrigation controller log: ';' separated, decimal comma, day-first, padded text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The headings of the log, in file order, and our column names.
LOG_HEADINGS = {
    "Programa": "program",
    "Nombre": "program_name",
    "Activación": "activation",
    "Inicio": "started_at",
    "Fin": "ended_at",
    "Duración": "duration_s",
    "Agua m³": "water_m3",
    "Abono 1 L": "fertiliser_1_l",
    "Abono 2 L": "fertiliser_2_l",
    "Abono 3 L": "fertiliser_3_l",
    "Abono 4 L": "fertiliser_4_l",
    "Tipo": "kind",
    "Sectores de Riego": "sector",
}
TIME_FORMAT = "dd/MM/yyyy H:mm"

TEXT_SCHEMA = T.StructType([T.StructField(h, T.StringType()) for h in LOG_HEADINGS])


def decimal_comma(text: Column) -> Column:
    return F.replace(F.trim(text), F.lit(","), F.lit(".")).cast("double")


def clock_seconds(text: Column) -> Column:
    """Seconds in an 'H:mm:ss' span; hours may exceed 23."""
    part = F.split(F.trim(text), ":")
    return (
        part[0].cast("bigint") * 3600 + part[1].cast("bigint") * 60 + part[2].cast("bigint")
    )


def parse_log(raw: DataFrame) -> DataFrame:
    """Typed rows from the log's text columns, plus data-quality flags.

    Suspicious rows are flagged and kept: a negative volume, an end before its
    start, or a duration more than a minute away from end minus start.
    """
    names = {v: k for k, v in LOG_HEADINGS.items()}

    def text(c: str) -> Column:
        return F.col(f"`{names[c]}`")

    typed = raw.select(
        text("program").cast("int").alias("program"),
        F.trim(text("program_name")).alias("program_name"),
        text("activation").cast("int").alias("activation"),
        F.to_timestamp_ntz(F.trim(text("started_at")), F.lit(TIME_FORMAT)).alias("started_at"),
        F.to_timestamp_ntz(F.trim(text("ended_at")), F.lit(TIME_FORMAT)).alias("ended_at"),
        clock_seconds(text("duration_s")).alias("duration_s"),
        decimal_comma(text("water_m3")).alias("water_m3"),
        *[
            decimal_comma(text(f"fertiliser_{i}_l")).alias(f"fertiliser_{i}_l")
            for i in range(1, 5)
        ],
        F.trim(text("kind")).alias("kind"),
        F.trim(text("sector")).cast("int").alias("sector"),
    )
    elapsed = F.timestamp_diff("SECOND", F.col("started_at"), F.col("ended_at"))
    return typed.withColumns(
        {
            "negative_water": F.col("water_m3") < 0,
            "ends_before_start": F.col("ended_at") < F.col("started_at"),
            "duration_mismatch": F.abs(elapsed - F.col("duration_s")) > 60,
        }
    )


def read_irrigation_log(spark: SparkSession, path: str) -> DataFrame:
    """The log by its known headings, in file order; other headings or broken rows raise."""
    raw = (
        spark.read.schema(TEXT_SCHEMA)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .option("sep", ";")
        .option("encoding", "UTF-8")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    return parse_log(raw)
