"""Daily climate CSV in and out, yearly files, tagged probe folders."""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acequia.functions.naming import date_column, known_names, require_climate, spanish_names
from acequia.operators.calendar import nan_to_null
from acequia.schema import DATE_HEADING, DAY, KEY, VARIABLES

DATE_FORMAT = "yyyy-MM-dd"


def csv_headings(spark: SparkSession, path: str) -> list[str]:
    """Headings of the CSV at ``path``: one line is read, nothing is inferred."""
    return (
        spark.read.option("header", True)
        .option("inferSchema", False)
        .option("encoding", "UTF-8")
        .csv(path)
        .columns
    )


def first_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, header) of each file: the first line of the block that begins at byte 0.

    One pass over the files, of which only first lines are kept and merged.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(paths)
    place = F.when(F.col("_metadata.file_block_start") == 0, F.monotonically_increasing_id())
    found = lines.select(F.col("_metadata.file_path").alias("path"), "value", place.alias("line"))
    header = F.regexp_replace(F.min_by("value", "line"), "^\\uFEFF", "")
    return found.groupBy("path").agg(header.alias("header"))


def files_by_headings(spark: SparkSession, paths: str | list[str]) -> dict[tuple[str, ...], list[str]]:
    """Files grouped by their own headings, in the order of the first file of each group.

    The driver holds a path for each file, as it does to list them.
    """
    same = first_lines(spark, paths).groupBy("header").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    groups = sorted((r["paths"], r["header"]) for r in same.collect())
    return {tuple(next(csv.reader([header]))): own for own, header in groups}


def csv_schema(headings: list[str], date_heading: str) -> T.StructType:
    """Date as text (cast later by format), station as long, all else double."""

    def kind(name: str):
        if name == date_heading:
            return T.StringType()
        return T.LongType() if name == KEY else T.DoubleType()

    return T.StructType([T.StructField(h, kind(h)) for h in headings])


def _read_same(
    spark: SparkSession, paths: str | list[str], headings, date_format: str, station: int
) -> DataFrame:
    """Files that share their headings; a file with other ones raises."""
    date_heading = date_column(list(headings))
    raw = (
        spark.read.schema(csv_schema(list(headings), date_heading))
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .option("nanValue", "NaN")
        .csv(paths)
    )
    # outside ANSI mode an unreadable date would become null and its row be lost
    problem = F.concat_ws(" ", F.lit("unreadable date"), F.col(DAY))
    unreadable = F.when(F.col(DAY).isNotNull(), F.raise_error(problem).cast("date"))
    named = raw.withColumnRenamed(date_heading, DAY).withColumn(
        DAY, F.coalesce(F.to_date(DAY, date_format), unreadable)
    )
    named = known_names(named)
    if KEY not in named.columns:
        named = named.withColumn(KEY, F.lit(station).cast("bigint"))
    rest = [c for c in named.columns if c not in (KEY, DAY)]
    return nan_to_null(named.select(KEY, DAY, *rest), rest)


def read_daily_csv(
    spark: SparkSession,
    paths: str | list[str],
    headings: list[str] | None = None,
    date_format: str = DATE_FORMAT,
    station: int = 0,
) -> DataFrame:
    """Daily rows of any columns (soil probes, climate), each file read by its own headings.

    The plan has one scan for each set of headings, however many files there
    are; columns some files lack become null. Pass ``headings`` when every
    file has them, to skip the pass over first lines; another file then raises.
    """
    if headings:
        return _read_same(spark, paths, headings, date_format, station)
    groups = files_by_headings(spark, paths)
    frames = [_read_same(spark, own, h, date_format, station) for h, own in groups.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_climate_csv(
    spark: SparkSession,
    path: str | list[str],
    headings: list[str] | None = None,
    date_format: str = DATE_FORMAT,
    station: int = 0,
) -> DataFrame:
    """Climate rows from CSV files; all seven variables must be in each file.

    Columns are found by name in each file, the date column by what its heading
    contains. A file without a station column is one station. Dates follow
    ``date_format`` strictly, and a row that does not parse raises rather than
    being lost.
    """
    groups = {tuple(headings): path} if headings else files_by_headings(spark, path)
    for names in groups:
        date_column(list(names))
        require_climate(list(names))
    frames = [_read_same(spark, own, h, date_format, station) for h, own in groups.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def write_climate_csv(
    df: DataFrame, path: str, date_heading: str = DATE_HEADING, year_files: bool = False
) -> None:
    """Write rows under the Spanish headings; ``year_files`` makes a folder per year.

    Yearly output is first spread by (year, station), so a year is written by
    many tasks.
    """
    out = spanish_names(df.select(KEY, DAY, *VARIABLES)).withColumnRenamed(DAY, date_heading)
    if year_files:
        out = out.withColumn("year", F.year(date_heading)).repartition("year", KEY)
    writer = out.write.option("header", True).option("dateFormat", DATE_FORMAT)
    if year_files:
        writer = writer.partitionBy("year")
    writer.csv(path)


def concat_files(
    spark: SparkSession, paths: list[str], headings: list[str] | None = None
) -> DataFrame:
    """Row-wise concatenation of several CSV sources by column name."""
    return read_climate_csv(spark, sorted(paths), headings)


def read_probe_folders(
    spark: SparkSession, folders: dict[str, str], date_format: str = DATE_FORMAT, tag: str = "probe"
) -> DataFrame:
    """Soil-probe folders, {name: path}, as one table that names each row's probe."""
    frames = {n: read_daily_csv(spark, path, date_format=date_format) for n, path in folders.items()}
    return tagged_union(frames, tag)


def tagged_union(frames: dict[str, DataFrame], tag: str = "probe") -> DataFrame:
    """Concatenate frames and name the one each row came from.

    Columns only some frames have become null elsewhere.
    """
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in sorted(frames.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
