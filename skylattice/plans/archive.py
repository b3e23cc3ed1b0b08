"""Monthly archives of landed files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Where names of radar files and of images hold year and month.
MONTHS = {"radar": r"_(\d{6})\d{6}\.h5$", "images": r"_(\d{6})\d{2}T\d{6}Z\.tif$"}


def month_of(name: Column) -> Column:
    """Year and month (six digits) of a landed file's name; NULL for a name of neither kind."""
    return F.coalesce(*[F.nullif(F.regexp_extract(name, p, 1), F.lit("")) for p in MONTHS.values()])


def month_plan(listing: DataFrame, month: Column, current: str) -> DataFrame:
    """month, files, names (sorted) of completed months; names of a month are those of one source's folder."""
    named = listing.withColumn("month", month).where((F.col("month") != "") & (F.col("month") < current))
    return named.groupBy("month").agg(F.count("*").alias("files"), F.sort_array(F.collect_list("name")).alias("names"))


def to_archive(plan: DataFrame, archived: DataFrame) -> DataFrame:
    """Months without an archive."""
    return plan.join(archived.select("month").distinct(), "month", "left_anti")


def compact(rows: DataFrame, month: str, path: str, *, dry_run: bool = False, rows_per_file: int = 5_000_000, parts: int = 16) -> DataFrame:
    """Writes rows by month in few large zstd files and gives month, rows and a digest to verify before deleting.

    A month is written by ``parts`` tasks.  Months that are there already are replaced, so that a retry does not double
    them.  The digest is a sum of row hashes, so it does not depend on the order of rows or files.
    """
    checks = rows.groupBy(month).agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")).alias("digest"))
    if not dry_run:
        dealt = rows.repartition(F.col(month), F.pmod(F.xxhash64(*rows.columns), F.lit(parts)))
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).partitionBy(month).parquet(path)
    return checks


def verified(checks: DataFrame, path: str, month: str, columns: list[str]) -> DataFrame:
    """The months whose archive holds the rows that checks counted."""
    back = checks.sparkSession.read.parquet(path).select(*columns)
    again = back.groupBy(F.col(month).cast("string").alias(month)).agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("digest"))
    return checks.withColumn(month, F.col(month).cast("string")).join(again, [month, "rows", "digest"], "left_semi").select(month)
