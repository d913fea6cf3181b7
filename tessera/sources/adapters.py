"""Engine tables over the driver's Parquet tables, as Spark plans and as the SQL that names the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import materialise

_LINE = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive line items of an order; the window orders by every column, since (order, line) repeats."""
    w = Window.partitionBy("l_orderkey").orderBy(*_LINE)
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("*", F.lead("l_suppkey").over(w).alias("next_supp"), F.lead("l_partkey").over(w).alias("next_part"), F.row_number().over(w).alias("rn"))


def _path(key: str):
    return F.concat(F.lit("src/s"), F.col(key).cast("string"), F.lit(".ts"))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps of :func:`file_edges` and :func:`symbol_edges` as a table, for queries that need both."""
    rows = _steps(spark, sf_dir).where("next_supp is not null or next_part is not null")
    return materialise(rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_discount", "next_supp", "next_part", "rn"), "steps")


def file_edges(spark: SparkSession, sf_dir: str, steps: DataFrame | None = None) -> DataFrame:
    """Dependency edges between suppliers' files, one for each step from a line item to the next; rows flagged N lead outside."""
    s = (_steps(spark, sf_dir) if steps is None else steps).where(F.col("next_supp").isNotNull())
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    out = F.col("l_returnflag") == "N"
    return s.join(part, s.l_partkey == part.p_partkey, "left").select(
        _path("l_suppkey").alias("from_path"),
        F.when(out, F.col("p_brand")).otherwise(_path("next_supp")).alias("to_path"),
        F.when(out, "external").otherwise("file").alias("to_type"),
        F.concat(F.lit("./s"), F.col("next_supp").cast("string")).alias("raw"),
        (F.col("l_linestatus") == "F").alias("type_only"),
        F.when(F.col("l_returnflag") == "A", "precise").when(F.col("l_returnflag") == "R", "heuristic").alias("resolved"),
        F.col("l_discount").alias("confidence"),
        (F.col("l_orderkey") * 1000 + F.col("rn")).alias("seq"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    lang = F.when(F.col("s_nationkey") % 3 == 0, "ts").when(F.col("s_nationkey") % 3 == 1, "py").otherwise("sql")
    return s.select(_path("s_suppkey").alias("path"), lang.alias("language"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    kind = F.when(F.col("p_type").isin("ECONOMY", "LARGE"), "function").when(F.col("p_type").isin("MEDIUM", "PROMO"), "class").otherwise("interface")
    return p.select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"),
        F.concat(F.lit("src/s"), (F.col("p_partkey") % 10 + 1).cast("string"), F.lit(".ts")).alias("file"),
        F.col("p_name").alias("name"),
        kind.alias("kind"),
        F.concat(F.lit("made "), F.col("p_type")).alias("docstring"),
        F.col("p_size").alias("line_span"),
        F.when(F.col("p_size") % 7 != 0, F.floor("p_retailprice").cast("long")).alias("complexity"),
        (F.col("p_size") % 2 == 0).alias("exported"),
    )


def symbol_edges(spark: SparkSession, sf_dir: str, steps: DataFrame | None = None) -> DataFrame:
    s = (_steps(spark, sf_dir) if steps is None else steps).where(F.col("next_part").isNotNull())
    label = F.when(F.col("l_linestatus") == "F", "calls").when(F.col("l_returnflag") == "N", "implements").when(F.col("l_returnflag") == "A", "extends")
    node = lambda c: F.concat(F.lit("p"), F.col(c).cast("string"))
    return s.select(node("l_partkey").alias("from_id"), node("next_part").alias("to_id"), label.alias("label"), (F.col("l_orderkey") * 1000 + F.col("rn")).alias("seq"))


def moved_edges(spark: SparkSession, sf_dir: str, edges: DataFrame | None = None) -> DataFrame:
    """The same edges in a later snapshot: files s1 to s9 have become s11 to s19, outside names have changed, low confidence is type-only."""
    to = F.when(F.col("to_type") == "external", F.regexp_replace("to_path", "Brand#1", "Mark#1")).otherwise(F.regexp_replace("to_path", r"^src/s([0-9])\.ts$", r"src/s1$1.ts"))
    return (file_edges(spark, sf_dir) if edges is None else edges).withColumn("to_path", to).withColumn("type_only", F.col("type_only") | (F.col("confidence") < 0.02))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("id"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file"), F.col("lang").alias("language"), F.col("doc_id").alias("ordinal"), F.coalesce("text", F.lit("")).alias("text"))


#: The same tables in SQL.
CTES = {
    "steps": f"""steps AS (SELECT *, lead(l_suppkey) OVER w AS next_supp, lead(l_partkey) OVER w AS next_part, row_number() OVER w AS rn
      FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY {", ".join(_LINE)}))""",
    "file_edges": """file_edges AS (SELECT 'src/s' || l_suppkey || '.ts' AS from_path,
      CASE WHEN l_returnflag = 'N' THEN p_brand ELSE 'src/s' || next_supp || '.ts' END AS to_path,
      CASE WHEN l_returnflag = 'N' THEN 'external' ELSE 'file' END AS to_type, './s' || next_supp AS raw, l_linestatus = 'F' AS type_only,
      CASE l_returnflag WHEN 'A' THEN 'precise' WHEN 'R' THEN 'heuristic' END AS resolved, l_discount AS confidence, l_orderkey * 1000 + rn AS seq
      FROM steps LEFT JOIN part ON p_partkey = l_partkey WHERE next_supp IS NOT NULL)""",
    "moved_edges": r"""moved_edges AS (SELECT * REPLACE (CASE WHEN to_type = 'external' THEN replace(to_path, 'Brand#1', 'Mark#1')
      ELSE regexp_replace(to_path, '^src/s([0-9])\.ts$', 'src/s1\1.ts') END AS to_path, type_only OR confidence < 0.02 AS type_only) FROM file_edges)""",
    "files": """files AS (SELECT 'src/s' || s_suppkey || '.ts' AS path, CASE s_nationkey % 3 WHEN 0 THEN 'ts' WHEN 1 THEN 'py' ELSE 'sql' END AS language FROM supplier)""",
    "symbols": """symbols AS (SELECT 'p' || p_partkey AS id, 'src/s' || (p_partkey % 10 + 1) || '.ts' AS file, p_name AS name,
      CASE WHEN p_type IN ('ECONOMY', 'LARGE') THEN 'function' WHEN p_type IN ('MEDIUM', 'PROMO') THEN 'class' ELSE 'interface' END AS kind,
      'made ' || p_type AS docstring, p_size AS line_span, CASE WHEN p_size % 7 <> 0 THEN floor(p_retailprice)::BIGINT END AS complexity,
      p_size % 2 = 0 AS exported FROM part)""",
    "symbol_edges": """symbol_edges AS (SELECT 'p' || l_partkey AS from_id, 'p' || next_part AS to_id,
      CASE WHEN l_linestatus = 'F' THEN 'calls' WHEN l_returnflag = 'N' THEN 'implements' WHEN l_returnflag = 'A' THEN 'extends' END AS label,
      l_orderkey * 1000 + rn AS seq FROM steps WHERE next_part IS NOT NULL)""",
    "chunks": """chunks AS (SELECT 'c' || doc_id AS id, source || '/' || doc_id || '.md' AS file, lang AS language, doc_id AS ordinal, coalesce(text, '') AS text FROM documents)""",
}


def with_ctes(*names: str, recursive: bool = False) -> str:
    """A WITH clause of the named tables."""
    wanted = list(dict.fromkeys((["steps"] if {"file_edges", "symbol_edges"} & {*names} else []) + list(names)))
    return f"WITH {'RECURSIVE ' * recursive}" + ",\n".join(CTES[n] for n in wanted)
