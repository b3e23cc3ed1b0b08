"""Caches whose partitions are made again only when what they are made from has changed."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.folders import exists, remove, replace, written


def fingerprints(inputs: dict[str, DataFrame], partition: str) -> DataFrame:
    """part, print: for each partition a digest of the rows of all inputs, whatever their order and files."""
    each = None
    for name, rows in sorted(inputs.items()):
        columns = sorted(rows.columns)
        one = rows.groupBy(F.col(partition).cast("string").alias("part")).agg(F.count("*").alias("n"), *[F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(38,0)")).alias(f"h{seed}") for seed in (1, 2)])
        one = one.select("part", F.concat_ws(":", F.lit(name), F.lit(rows.select(*columns).schema.simpleString()), "n", "h1", "h2").alias("says"))
        each = one if each is None else each.unionByName(one)
    return each.groupBy("part").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("says")), "|"), 256).alias("print"))


def table_print(tables: list[DataFrame]) -> str:
    """A digest of whole tables, for a ``version`` that follows what all partitions depend on."""
    says = []
    for rows in tables:
        columns = sorted(rows.columns)
        says.append(str(rows.agg(F.count("*"), *[F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(38,0)")) for seed in (1, 2)]).first()[:]) + str(columns))
    return sha256("|".join(says).encode()).hexdigest()[:32]


def _known(spark: SparkSession, path: str) -> DataFrame:
    empty = spark.createDataFrame([], "part string, print string")
    place = _place(spark, path)
    return spark.read.schema(empty.schema).parquet(f"{path}/{place}") if place else empty


def refresh(make: Callable[[DataFrame], DataFrame], inputs: dict[str, DataFrame], partition: str, path: str, version: str = "1") -> list[str]:
    """Brings the cache up to date and gives the partitions that were made again.

    ``make`` takes the inputs (in the order of their names), reduced to the partitions that changed, and gives rows with the
    partition's column.  A partition is made again if its inputs' rows, their schema or ``version`` differ from last time, and goes
    if no input has it any more.  The cache's rows are replaced before their fingerprints: a run that breaks off in between makes
    the same partitions once more.
    """
    spark = next(iter(inputs.values())).sparkSession
    now = written(fingerprints(inputs, partition).withColumn("print", F.concat_ws("/", F.lit(version), "print")), "prints")
    before = _known(spark, path)
    changed = written(now.join(before, ["part", "print"], "left_anti").select("part"), "changed")
    gone = [r.part for r in before.join(now, "part", "left_anti").select("part").collect()]  # as many as partitions
    names = [r.part for r in changed.collect()]
    if names:
        few = [rows.join(F.broadcast(changed), rows[partition].cast("string") == changed["part"], "left_semi") for _, rows in sorted(inputs.items())]
        made = written(make(*few), "made")
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(f"{path}/rows")
        # a partition for which nothing was made must not keep its old rows
        full = {r.part for r in made.select(F.col(partition).cast("string").alias("part")).distinct().collect()}
        gone += [part for part in names if part not in full]
    for part in gone:
        remove(spark, f"{path}/rows/{partition}={part}")
    place = f"prints-{uuid.uuid4().hex}"
    now.write.parquet(f"{path}/{place}")
    _point(spark, path, json.dumps({"prints": place}))
    return sorted(names)


def _point(spark: SparkSession, path: str, text: str) -> None:
    files = spark._jvm.org.apache.hadoop.fs
    part = files.Path(f"{path}/.current.json")
    fs = part.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    old = _place(spark, path)
    replace(spark, f"{path}/.current.json", f"{path}/current.json")
    if old:
        remove(spark, f"{path}/{old}")


def _place(spark: SparkSession, path: str) -> str | None:
    if not exists(spark, f"{path}/current.json"):
        return None
    return json.loads("\n".join(r.value for r in spark.read.text(f"{path}/current.json").collect()))["prints"]


def read(spark: SparkSession, path: str) -> DataFrame:
    """The cache's rows; partition values are text, as they were filed."""
    reader = spark.read.option("basePath", f"{path}/rows")
    if not exists(spark, f"{path}/rows"):
        raise ValueError(f"no cache at {path}")
    found = reader.parquet(f"{path}/rows")
    parts = {f.split("=")[0] for file in found.inputFiles()[:1] for f in file.split("/") if "=" in f}
    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name in parts else f.dataType) for f in found.schema])
    return spark.read.schema(schema).option("basePath", f"{path}/rows").parquet(f"{path}/rows")
