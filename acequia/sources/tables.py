"""The daily climate table derived from ``lineitem``, and irrigation-log text from ``events``.

No climate files are at hand, so each supplier stands for a weather station and
each ship date for a day. Sums are taken over integers, which makes
every derived value independent of the order rows are added in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from acequia.schema import DAY, KEY, VARIABLES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hundredths(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("bigint")


def _mean(value: Column, keep: Column | None = None) -> Column:
    if keep is not None:
        value = F.when(keep, value)
    return F.sum(value).cast("double") / F.count(value)


def climate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(station, day, seven variables): partial aggregation, then one exchange.

    The keys are the day as well, so a supplier with a third of all lines is
    spread over its days. Wind and radiation miss readings on some days.
    """
    flag = F.col("l_returnflag")
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.col("l_suppkey").cast("bigint").alias(KEY),
            F.col("l_shipdate").cast("date").alias(DAY),
        )
        .agg(
            (F.lit(900.0) + F.lit(10.0) * _mean(F.col("l_linenumber").cast("bigint"))).alias(
                "pressure_hpa"
            ),
            (F.lit(20.0) + F.lit(0.2) * _mean(F.pmod("l_partkey", F.lit(100)))).alias("rh_min"),
            (F.lit(0.5) + F.lit(0.5) * _mean(_hundredths("l_tax"), flag != "R")).alias(
                "wind_ms"
            ),
            (F.lit(5.0) + F.lit(0.5) * _mean(F.col("l_quantity").cast("bigint"))).alias(
                "temp_c"
            ),
            (
                F.lit(5e6) + F.lit(3.0) * _mean(_hundredths("l_extendedprice"), flag != "N")
            ).alias("rad_j"),
            F.when(F.min("l_quantity") <= 10, F.lit(0.5) * F.min("l_quantity"))
            .otherwise(F.lit(0.0))
            .alias("precip_mm"),
            (F.lit(40.0) + F.lit(5.0) * _mean(_hundredths("l_discount"))).alias("rh"),
        )
        .select(KEY, DAY, *VARIABLES)
    )


def irrigation_log_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events rendered as rows of the irrigation log, all columns text.

    Durations follow from the event id and stay below 16 hours.
    """
    seconds = F.pmod(F.col("event_id") * 37, F.lit(54000)).cast("bigint")
    start = F.date_trunc("minute", F.col("ts"))
    comma = F.replace(F.format_string("%.2f", F.col("value")), F.lit("."), F.lit(","))
    sector = F.pmod("user_id", F.lit(4)) + 1

    def stamp(c: Column) -> Column:
        return F.date_format(c, "dd/MM/yyyy H:mm")

    end = F.timestamp_add("SECOND", seconds.cast("int"), start)
    hours = F.floor(seconds / 3600)
    minutes, secs = F.floor(F.pmod(seconds, F.lit(3600)) / 60), F.pmod(seconds, F.lit(60))
    return table(spark, sf_dir, "events").select(
        F.col("event_id"),
        sector.cast("string").alias("Programa"),
        F.format_string("PROGRAMA%02d", sector).alias("Nombre"),
        F.pmod("event_id", F.lit(6)).cast("string").alias("Activación"),
        stamp(start).alias("Inicio"),
        stamp(end).alias("Fin"),
        F.format_string("%d:%02d:%02d", hours, minutes, secs).alias("Duración"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("-"), comma))
        .otherwise(comma)
        .alias("Agua m³"),
        comma.alias("Abono 1 L"),
        F.lit("0").alias("Abono 2 L"),
        F.lit("0").alias("Abono 3 L"),
        F.lit("0").alias("Abono 4 L"),
        F.when(F.col("event_type") == "signup", F.lit("Forzada "))
        .otherwise(F.lit(" Horario "))
        .alias("Tipo"),
        sector.cast("string").alias("Sectores de Riego"),
    )
