"""Sinks: report archive, audit rows and the rule check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waferlake.schema import REPORT


def write_archive(root: str, report_date: str | Column, **tables: DataFrame) -> None:
    """One folder per table, partitioned by report date (one for all, or a column); a rerun replaces its days."""
    day = F.lit(report_date) if isinstance(report_date, str) else report_date
    for name, df in tables.items():
        df.withColumn("report_date", day.cast("date")).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("report_date").parquet(f"{root}/{name}")


def read_archive(spark: SparkSession, root: str, table: str, schema: T.StructType | str, today: str, days: int) -> tuple[DataFrame, DataFrame]:
    """Archived rows of the last days, and the files of those days that gave none.

    The schema is given, so no file has to be readable to start. A corrupt file
    is passed over; the listing of the folder against the files that rows came
    from names it. Only partitions of the window are read.
    """
    path = f"{root}/{table}"
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    whole = T.StructType([*schema.fields, T.StructField("report_date", T.DateType())])
    window = F.col("report_date") >= F.date_sub(F.lit(today).cast("date"), days)
    rows = spark.read.schema(whole).option("ignoreCorruptFiles", "true").parquet(path).where(window)
    # only names are asked for, so no content is read
    listed = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "false").option("pathGlobFilter", "*.parquet").load(path)
        .where(F.col("report_date").cast("date") >= F.date_sub(F.lit(today).cast("date"), days)).select("path", "report_date")
    )
    name = lambda c: F.substring_index(c, "/", -1)
    gave = rows.select(name("_metadata.file_path").alias("_file"), "report_date").distinct()
    found = listed.withColumn("_file", name("path")).withColumn("report_date", F.col("report_date").cast("date"))
    return rows, found.join(gave, ["_file", "report_date"], "left_anti").select("report_date", F.col("_file").alias("file"))


def target_rows(shots: DataFrame, reports: DataFrame) -> DataFrame:
    """Shots of the reported lots only."""
    return shots.join(reports.select(*REPORT).distinct(), REPORT, "left_semi")


def flattened(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, ready for CSV."""
    nested = ("struct", "array", "map")
    return df.select(
        *[
            F.to_json(f.name).alias(f.name) if f.dataType.typeName() in nested else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def write_basis(basis: DataFrame, path: str, fmt: str = "csv") -> None:
    writer = flattened(basis).write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.json(path)


def write_rule_trace(root: str, report_date: str | Column, trace: DataFrame) -> None:
    """Every rule of every report, matched or not, beside the other tables of the archive."""
    write_archive(root, report_date, rule_trace=trace)
