"""Reading delivered files and stored results."""
from __future__ import annotations

import csv
import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from wattlens import constants as K
from wattlens.plans.staging import stage
from wattlens.sources import records

DELIMITERS = [",", ";", "\t"]


def clean_header(name: str) -> str:
    """Header text without byte-order mark, outer blanks and repeated blanks."""
    return re.sub(r"\s+", " ", str(name).replace("﻿", "").strip())


def clean_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[clean_header(c) for c in df.columns])


def inspect_lines(spark: SparkSession, path: str) -> tuple[str, str | None, bool]:
    """(encoding, first line with text, whether a quoted value runs over a line break), in one scan on the executors.

    The encoding is UTF-8 unless some line is not valid UTF-8. An odd number of quotes in a line means that a value
    goes on in the next one.
    """
    lines = spark.read.text(path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    found = lines.agg(F.count_if(~F.is_valid_utf8("value")).alias("invalid"), F.count_if(quotes % 2 == 1).alias("open")).first()
    encoding = "ISO-8859-1" if found["invalid"] else "UTF-8"
    text = F.decode(F.col("value").cast("binary"), encoding).alias("value")
    head = lines.select(text).filter(F.length(F.trim("value")) > 0).first()
    return encoding, head["value"] if head else None, found["open"] > 0


def read_lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """Lines with text below the header, which is the first line of every file."""
    lines = (spark.read.option("header", True).option("sep", "\u0001").option("quote", "").option("encoding", encoding)
             .option("escape", "").schema("value string").csv(path))
    return lines.filter(F.length(F.trim("value")) > 0)


def detect_delimiter(header: str) -> str:
    """The delimiter that occurs most often in the header line."""
    return max(DELIMITERS, key=lambda d: (header.count(d), -DELIMITERS.index(d)))


def scan_rows(spark: SparkSession, path: str, encoding: str | None = None) -> tuple[DataFrame, list[str]]:
    """(rows, header). A row has `cells`, a struct of texts c0, c1, ..., and its `fate`: `row`, `repaired` (a stray quote
    was taken out of it) or `skipped` (too many fields; cells are null). Rows come in file order, blank ones are left out.

    Where a value runs over line breaks, or a quote is left open, records are put together from lines by
    `records`; splits stay splits in either case.
    """
    detected, header, broken = inspect_lines(spark, path)
    encoding = encoding or detected
    if header is None:
        return spark.createDataFrame([], "cells struct<>, fate string"), []
    delimiter = detect_delimiter(header)
    names = [clean_header(n) for n in next(csv.reader([header.replace("\ufeff", "")], delimiter=delimiter))]
    columns = [f"c{i}" for i in range(len(names))]
    cells = F.from_csv("text", ", ".join(f"{c} string" for c in columns),
                       {"sep": delimiter, "escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"})
    if broken:
        lines = records.numbered_lines(spark, path, encoding)
        borders = stage(records.settled(records.split_rows(lines, delimiter), delimiter), "records")
        rows = records.formed(lines, borders, delimiter).filter(F.length(F.trim("text")) > 0)
        parts = F.split("text", f"\\Q{delimiter}\\E", -1)
        plain = F.struct(*[F.nullif(F.trim(F.get(parts, F.lit(i))), F.lit("")).alias(c) for i, c in enumerate(columns)])
        cells = F.when(F.col("repaired"), plain).otherwise(cells)
    else:
        unquoted = F.regexp_replace("value", '"[^"]*"', "")
        fields = F.length(unquoted) - F.length(F.replace(unquoted, F.lit(delimiter), F.lit(""))) + 1
        rows = read_lines(spark, path, encoding).select(F.col("value").alias("text"), fields.alias("fields"),
                                                        F.lit(False).alias("repaired"))
    fate = F.when(F.col("fields") > len(names), "skipped").when(F.col("repaired"), "repaired").otherwise("row")
    return rows.select(F.when(F.col("fields") <= len(names), cells).alias("cells"), fate.alias("fate")), names


def scan_counts(rows: DataFrame) -> DataFrame:
    """One row: how many records `scan_rows` has read, repaired and skipped."""
    return rows.agg(F.count("*").alias("records"), F.count_if(F.col("fate") == "repaired").alias("repaired_records"),
                    F.count_if(F.col("fate") == "skipped").alias("skipped_records"))


def scanned_table(rows: DataFrame, names: list[str]) -> DataFrame:
    """The columns of the records that were not skipped."""
    if not names:
        return rows.sparkSession.createDataFrame([], T.StructType([]))
    return rows.filter(F.col("fate") != "skipped").select("cells.*").toDF(*names)


def scan_csv(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """Tolerant scan: delimiter and encoding are detected, records with too many fields are skipped, short ones are filled
    with NULL, a line with a stray quote stands for itself. All columns come back as text. The first line of a file is
    its header. `scan_rows` also tells what became of each record."""
    return scanned_table(*scan_rows(spark, path, encoding))


def is_delimited(path: str) -> bool:
    return path.lower().endswith((".csv", ".txt", ".tsv"))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """One delivered table: CSV by the tolerant scan, Parquet as it is."""
    return scan_csv(spark, path) if is_delimited(path) else spark.read.parquet(path)


def read_delivery(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(stored table, counts of its records): a delivered file is parsed once."""
    if not is_delimited(path):
        table = stage(spark.read.parquet(path), "raw")
        return table, table.agg(F.count("*").alias("records"), F.lit(0).cast("long").alias("repaired_records"),
                                F.lit(0).cast("long").alias("skipped_records"))
    rows, names = scan_rows(spark, path)
    rows = stage(rows, "raw") if names else rows
    return scanned_table(rows, names), scan_counts(rows)


def read_weather(spark: SparkSession, path: str | None) -> DataFrame | None:
    """Weather dimension by (date, city); None when no file is given."""
    if not path:
        return None
    return weather_dimension(read_table(spark, path))


def weather_dimension(table: DataFrame) -> DataFrame:
    from wattlens.functions.columns import num
    from wattlens.operators.clean import parse_date
    city = F.col("city") if "city" in table.columns else F.lit(None).cast("string")
    numbers = [num(F.col(c)).alias(c) for c in table.columns if c not in ("date", "city")]
    return table.select(parse_date(F.col("date")).alias("date"),
                        F.coalesce(city.cast("string"), F.lit(K.DEFAULT_CITY)).alias("city"), *numbers,
                        F.monotonically_increasing_id().alias("_order"))


def read_result(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stored result, or an empty table of the same shape when it was never written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def generated_ids(df: DataFrame, name: str = "Generated Customer ID") -> DataFrame:
    """ROW_000001... in file order, for tables without an id column.

    Ids follow the scan order; only one count per input partition is combined, rows stay where they are.
    """
    staged = stage(df.withColumn("_pos", F.monotonically_increasing_id()), "rows")
    part, bits = F.shiftright("_pos", 33), 33
    sizes = staged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    # one row per input partition
    joined = staged.withColumn("_part", part).join(before, "_part")
    number = F.col("_before") + F.col("_pos") - F.shiftleft(F.col("_part"), bits) + 1
    return joined.withColumn(name, F.format_string("ROW_%06d", number)).drop("_part", "_pos", "_before")
