"""Profile of the data files in a folder."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from acequia.session import materialize

RECOMMENDED_ROWS = 365


def recommended(rows: Column) -> Column:
    """A file is recommended when it holds more than a year of daily rows."""
    return rows > F.lit(RECOMMENDED_ROWS)


#: A comma outside quotes: an even number of quotes follows it.
_COMMA = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def heading_names(header: Column) -> Column:
    """Headings of a CSV line, quotes taken off and doubled quotes made single."""
    return F.transform(
        F.split(header, _COMMA),
        lambda x: F.replace(F.regexp_extract(x, r'(?s)^\s*"?(.*?)"?\s*$', 1), F.lit('""'), F.lit('"')),
    )


def _one_slash(path: str) -> str:
    """A local path as the scan writes it."""
    return re.sub("^file:/+", "file:/", path)


def _path(column: str) -> Column:
    """A scan's path, written as the listing has it."""
    return F.regexp_replace(column, "^file:/+", "file:/")


def _lines(text: DataFrame, paths: list[str] | None) -> DataFrame:
    """Per file: size, lines, bytes seen, first line, and whether all of it is UTF-8.

    A large file is counted by many tasks; only its sums and its first line are
    merged. A filter on paths prunes files before they are opened.
    """
    if paths is not None:
        text = text.filter(_path("_metadata.file_path").isin(paths))
    first = F.when(F.col("_metadata.file_block_start") == 0, F.monotonically_increasing_id())
    return (
        text.select(
            "value",
            _path("_metadata.file_path").alias("path"),
            F.col("_metadata.file_size").alias("size"),
            first.alias("line"),
        )
        .groupBy("path", "size")
        .agg(
            (F.count(F.lit(1)) - 1).alias("rows"),
            F.min_by("value", "line").alias("header"),
            F.bool_and(F.is_valid_utf8("value")).alias("utf8"),
        )
    )


def _reason(problem: Exception) -> str:
    """The innermost cause a failed job names."""
    text = str(problem)
    causes = re.findall(r"^Caused by: (.+)$", text, re.MULTILINE)
    line = causes[-1] if causes else text.strip().split("\n")[0]
    return line.strip()[:300]


def _read_apart(text: DataFrame, paths: list[str] | None, listed: list[str]) -> tuple[list[DataFrame], dict[str, str]]:
    """Counts of the files that can be read, and for each other one why not.

    All files are one job. If it fails the files are halved until the failing
    ones are alone, so a broken file costs a few jobs over ever fewer files and
    nothing but itself.
    """
    own = listed if paths is None else paths
    try:
        return [materialize(_lines(text, paths), "file-lines")], {}
    except Exception as problem:  # noqa: BLE001 - the message becomes the file's row
        if len(own) <= 1:
            return [], {path: f"unreadable: {_reason(problem)}" for path in own}
    half = len(own) // 2
    left, lost = _read_apart(text, own[:half], listed)
    right, more = _read_apart(text, own[half:], listed)
    return left + right, lost | more


def profile_files(spark: SparkSession, folder: str) -> DataFrame:
    """(folder, name, size, columns, rows, recommended, message) for every CSV below ``folder``.

    The extension counts in any case. Within a file, the line at the start of
    the block that begins at byte 0 is the heading. Files that hold no table,
    are not UTF-8, cannot be read, or went missing after they were listed keep
    a row with a message; the rest are profiled all the same.
    """
    reader = spark.read.option("pathGlobFilter", "*.[cC][sS][vV]").option("recursiveFileLookup", True)
    text = reader.text(folder)
    # The listing, which the driver holds anyway, names empty files too; a scan does not.
    listed = [_one_slash(path) for path in text.inputFiles()]
    counted, lost = _read_apart(text, None, listed)
    files = spark.createDataFrame([(p, lost.get(p)) for p in listed], "path string, problem string")
    none = spark.createDataFrame([], "path string, size long, rows long, header string, utf8 boolean")
    lines = reduce(DataFrame.unionByName, counted, none)
    header = F.regexp_replace("header", "^\uFEFF", "")
    names = F.when((F.trim(header) != "") & F.is_valid_utf8("header"), heading_names(header))
    dated = F.exists("columns", lambda c: F.lower(c).contains("fecha"))
    message = (
        F.when(F.col("problem").isNotNull(), F.col("problem"))
        .when(~F.coalesce("utf8", F.lit(True)), F.lit("not UTF-8"))
        .when(F.col("columns").isNull(), F.lit("empty file"))
        .when(~dated, F.lit("no date column"))
        .when(F.col("rows") == 0, F.lit("no rows"))
    )
    parts = F.split("path", "/")

    def part(place: int) -> Column:
        return F.url_decode(F.replace(F.element_at(parts, place), F.lit("+"), F.lit("%2B")))

    return (
        files.join(lines, "path", "left")
        .select(
            part(-2).alias("folder"),
            part(-1).alias("name"),
            F.coalesce("size", F.lit(0)).alias("size"),
            names.alias("columns"),
            F.coalesce("rows", F.lit(0)).alias("rows"),
            "problem",
            "utf8",
        )
        .withColumn("recommended", recommended(F.col("rows")))
        .withColumn("message", message)
        .drop("problem", "utf8")
    )
