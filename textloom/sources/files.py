"""Manifests and clip names, read and written by Spark's own readers and writers."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType


def read_manifests(spark: SparkSession, path: str, schema: str, folder: str | None = None) -> DataFrame:
    """JSON lines below `path` (a glob), blank and broken lines left out; `folder` is a pattern whose group names the partition in file paths."""
    rows = spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    rows = rows.withColumn("folder", F.regexp_extract("_metadata.file_path", folder, 1)) if folder else rows
    return rows.filter("_bad is null").drop("_bad")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header; a byte order mark is no part of the first name."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("escape", '"').csv(path)


def clip_key(name: Column) -> tuple[Column, Column]:
    """(chapter, verse) of file names such as 002255.wav or 002255_3.wav; null for others."""
    part = lambda k: F.regexp_extract(name, r"(?:^|/)(\d{3})(\d{3})(?:_[^/.]*)?\.\w+$", k)
    number = lambda k: F.when(part(k) != "", part(k).cast("int"))
    return number(1), number(2)


def route(df: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that pass, the others): null counts as not passing."""
    passed = F.coalesce(valid, F.lit(False))
    return df.filter(passed), df.filter(~passed)


def write_new(df: DataFrame, path: str, *by: str) -> None:
    """Write JSON lines, by partition columns if given; never over what is there."""
    df.write.partitionBy(*by).mode("errorifexists").json(path)


def read_validated(spark: SparkSession, path: str, schema: str, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good rows, (raw, reasons) of the others): lines that are no JSON object, and rows for which a named check fails or is null."""
    raw = spark.read.text(path).filter(F.trim("value") != "").select("value", F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    rows = raw.select("value", "r.*")
    failed = F.array_compact(F.array(F.when(F.col("_bad").isNotNull(), "json"), *[F.when(~F.coalesce(c, F.lit(False)), n) for n, c in checks.items()]))
    told = rows.withColumn("reasons", failed)
    good, bad = told.filter(F.size("reasons") == 0), told.filter(F.size("reasons") > 0)
    return good.drop("value", "_bad", "reasons"), bad.select(F.col("value").alias("raw"), "reasons")


def read_nested(spark: SparkSession, path: str, schema: str, items: str) -> DataFrame:
    """Documents of whole JSON files, a row for each struct of their array `items`, beside the documents' other fields."""
    docs = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    rest = [c for c in docs.columns if c != items]
    return docs.select(*rest, F.posexplode(items).alias("place", "_i")).select(*rest, "place", "_i.*")


@F.pandas_udf(StringType())
def _literal_json(text: pd.Series) -> pd.Series:
    def one(t):
        try:
            return None if t is None else json.dumps(ast.literal_eval(t), ensure_ascii=False)
        except (ValueError, SyntaxError, TypeError):
            return None

    return text.map(one)


def literal(text: Column, schema: str) -> Column:
    """A nested value that is written as a Python literal; null where it is none."""
    return F.from_json(_literal_json(text), schema)


def links(html: Column, attribute: str = "href", tag: str = "a") -> Column:
    """Values of a quoted attribute of all tags of one kind, in order."""
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(rf'(?i)<{tag}\s[^>]*{attribute}="([^"]*)"'), F.lit(1))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files for spreadsheets: a header with a byte order mark, all values in quotes; never over what is there."""
    first, *rest = df.columns
    marked = df.select(F.col(f"`{first}`").alias("﻿" + first), *[F.col(f"`{c}`") for c in rest])
    marked.write.mode("errorifexists").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_parts(df: DataFrame, path: str, by: str) -> DataFrame:
    """Write a folder for each value of `by`; return its registry (by, rows, digest), which is written beside them.

    A digest is the SHA-256 of the sorted digests of a part's rows, so it does not depend on files or order.
    """
    df.write.partitionBy(by).mode("errorifexists").json(f"{path}/parts")
    row = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)])), 256)
    registry = df.select(by, row.alias("_h")).groupBy(by).agg(F.count("*").alias("rows"), F.sha2(F.array_join(F.array_sort(F.collect_list("_h")), ""), 256).alias("digest"))
    registry.write.mode("errorifexists").json(f"{path}/registry")
    return df.sparkSession.read.schema(registry.schema).json(f"{path}/registry")


def relocate(spark: SparkSession, source: str, target: str, pattern: str = "*") -> DataFrame:
    """Copy a folder's files to a new folder and return (name, sha256, moved): hashes before, and whether those after are the same.

    Files are copied by Hadoop's own copy, one after the other on the driver, which moves
    no bytes through Spark; both hashes are taken by Spark's tasks.  A file that the target
    has already is an error.
    """
    def hashes(path: str, name: str) -> DataFrame:
        files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
        return files.select(F.regexp_extract("path", r"[^/]+$", 0).alias("name"), F.sha2("content", 256).alias(name))

    before = hashes(source, "sha256")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    a, b = path(source), path(target)
    for status in a.getFileSystem(conf).globStatus(path(a, pattern)):
        to = path(b, status.getPath().getName())
        if b.getFileSystem(conf).exists(to):
            raise FileExistsError(str(to))
        jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), status.getPath(), b.getFileSystem(conf), to, False, conf)
    return before.join(hashes(target, "_after"), "name", "left").select("name", "sha256", F.col("sha256").eqNullSafe(F.col("_after")).alias("moved"))


def folder_inventory(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(folder, files, bytes) of all files below `path` whose names fit `glob`; contents are not read.  A folder without such files gives no row."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "length")
    return found.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
