"""Sinks: table bundles, incremental writes, and graph texts as rows of lines."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """A bundle of Parquet tables and a manifest of their schemas."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    manifest = json.dumps({"version": 1, "tables": {n: json.loads(t.schema.json()) for n, t in tables.items()}})
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def read_tables(spark, path: str) -> dict[str, DataFrame]:
    manifest = json.loads("\n".join(r.value for r in spark.read.text(f"{path}/manifest").collect()))
    if manifest["version"] != 1:
        raise ValueError(f"unknown version {manifest['version']}")
    return {n: spark.read.parquet(f"{path}/{n}") for n in manifest["tables"]}


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def dot_lines(edges: DataFrame) -> DataFrame:
    """(section, line) of a DOT graph; lines of one section are in no order, so the text is written in parallel."""
    spark = edges.sparkSession
    frame = spark.createDataFrame([(0, "digraph {"), (2, "}")], "section int, line string")
    body = edges.select(F.lit(1).alias("section"), F.concat(F.lit("  "), _quoted(F.col("from_path")), F.lit(" -> "), _quoted(F.col("to_path")), F.lit(";")).alias("line")).distinct()
    return frame.unionByName(body)


def mermaid_lines(edges: DataFrame) -> DataFrame:
    """(section, line) of a Mermaid flow chart; nodes are named by a hash of their path."""
    spark = edges.sparkSession
    node = lambda c: F.concat(F.lit("n"), F.substring(F.sha2(c, 256), 1, 12))
    nodes = edges.select(F.col("from_path").alias("p")).union(edges.select("to_path")).distinct()
    named = nodes.select(F.lit(1).alias("section"), F.concat(F.lit("  "), node("p"), F.lit('["'), F.replace(F.col("p"), F.lit('"'), F.lit("#quot;")), F.lit('"]')).alias("line"))
    arrows = edges.select(F.lit(2).alias("section"), F.concat(F.lit("  "), node("from_path"), F.lit(" --> "), node("to_path")).alias("line")).distinct()
    return spark.createDataFrame([(0, "flowchart LR")], "section int, line string").unionByName(named).unionByName(arrows)


def json_lines(files: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON object a row for nodes and edges."""
    a = files.select(F.to_json(F.struct(F.lit("node").alias("type"), *files.columns)).alias("value"))
    return a.unionByName(edges.select(F.to_json(F.struct(F.lit("edge").alias("type"), *edges.columns)).alias("value")))


def read_json_lines(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a graph that :func:`json_lines` wrote; lines that aren't objects of either kind are left out."""
    rows = spark.read.text(path).select(F.get_json_object("value", "$.type").alias("type"), "value")
    of = lambda kind, schema: rows.where(F.col("type") == kind).select(F.from_json("value", schema).alias("x")).select("x.*")
    return of("node", "path string, language string"), of("edge", "from_path string, to_path string, to_type string, raw string, type_only boolean, resolved string, confidence double, seq long")


def compact_json(files: DataFrame, edges: DataFrame) -> DataFrame:
    """One row (value): a JSON object with the sorted paths once, and edges as pairs of their places; for graphs that fit a text."""
    names = F.array_distinct(F.array_sort(F.collect_list("path")))
    book = files.select("path").agg(names.alias("files"))
    pairs = edges.where("to_type = 'file'").select("from_path", "to_path").distinct().agg(F.array_sort(F.collect_list(F.struct("from_path", "to_path"))).alias("e"))
    at = lambda c: F.array_position("files", c).cast("int") - 1
    one = book.select(F.lit(0).alias("k"), "files").join(pairs.select(F.lit(0).alias("k"), "e"), "k")
    return one.select(F.to_json(F.struct("files", F.transform("e", lambda x: F.array(at(x["from_path"]), at(x["to_path"]))).alias("edges"))).alias("value"))
