"""File scans and incremental refresh plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.textual import glob_regex

IGNORED = ["**/node_modules/**", "**/.git/**", "**/dist/**", "**/__pycache__/**", "**/.venv/**"]


def scan_files(spark: SparkSession, root: str, patterns: Sequence[str] = ("**/*",), ignored: Sequence[str] = tuple(IGNORED), with_text: bool = True) -> DataFrame:
    """(path, size, modified, signature[, text]) of the files below ``root`` that fit a glob and no ignore rule.

    The path filter stands below the read of contents, so ignored files are listed but not opened.
    """
    columns = ["path", "length", "modificationTime"] + ["content"] * with_text
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(*columns)
    base = root.split("://")[-1].rstrip("/") + "/"
    rows = rows.withColumn("path", F.substring_index("path", base, -1))
    fit = F.lit(False)
    for p in patterns:
        fit = fit | F.col("path").rlike(glob_regex(p))
    for p in ignored:
        fit = fit & ~F.col("path").rlike(glob_regex(p))
    out = [F.col("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")]
    if with_text:
        out += [F.sha2("content", 256).alias("signature"), F.decode("content", "UTF-8").alias("text")]
    return rows.where(fit).select(*out)


def refresh_plan(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, change): added, modified, deleted or unchanged files by signature."""
    a, b = manifest.select("path", F.col("signature").alias("old")), current.select("path", F.col("signature").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "modified").otherwise("unchanged")
    return a.join(b, "path", "full_outer").select("path", change.alias("change"))


def refreshed(facts: DataFrame, extracted: DataFrame, plan: DataFrame, key: str = "path") -> DataFrame:
    """``facts`` without those of changed and deleted files, and with the newly extracted ones."""
    gone = plan.where("change in ('modified', 'deleted', 'added')").select(F.col("path").alias(key))
    return facts.join(gone, key, "left_anti").unionByName(extracted)
