"""The fixed plans behind canned questions, and bounded read-only SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.languages import parse_question
from . import graphs


def most_called(symbols: DataFrame, edges: DataFrame, limit: int = 10) -> DataFrame:
    calls = edges.where("label = 'calls'").groupBy("to_id").agg(F.count("*").alias("calls"))
    found = symbols.where("kind = 'function'").join(calls, F.col("id") == F.col("to_id"))
    return found.select("id", "name", "file", "calls").orderBy(F.desc("calls"), "id").limit(limit)


def classes_implementing(symbols: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    target = symbols.where(F.col("name") == name).select(F.col("id").alias("to_id"))
    source = symbols.where("kind = 'class'").select(F.col("id").alias("from_id"), F.col("name"), "file")
    return edges.where("label in ('implements', 'extends')").join(target, "to_id", "left_semi").join(source, "from_id").select("name", "file").distinct()


def controllers_endpoints(symbols: DataFrame, limit: int = 10, suffix: str = "controller", verbs: str = "get|post|put|delete|patch") -> DataFrame:
    """Classes by name's end with their number of verb-named functions in the same file; zero counts stay."""
    owner = symbols.where((F.col("kind") == "class") & F.lower("name").endswith(suffix)).select("id", "name", "file")
    points = symbols.where((F.col("kind") == "function") & F.col("name").rlike(f"(?i)^({verbs})")).groupBy("file").agg(F.count("*").alias("endpoints"))
    return owner.join(points, "file", "left").select("id", "name", "file", F.coalesce("endpoints", F.lit(0)).alias("endpoints")).orderBy(F.desc("endpoints"), "id").limit(limit)


def highest_complexity(symbols: DataFrame, kind: str, limit: int = 10) -> DataFrame:
    rows = symbols.where(F.col("kind") == kind)
    return rows.orderBy(F.desc_nulls_last("complexity"), "id").limit(limit).select("id", "name", "file", F.coalesce("complexity", F.lit(0)).alias("complexity"))


def dependency_chain(symbols: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """(file, depth) of all that the files of a class depend on, the files themselves at depth 0."""
    starts = symbols.where((F.col("kind") == "class") & (F.col("name") == name)).select(F.lit("*").alias("origin"), F.col("file").alias("node")).distinct()
    return graphs.bfs(edges.where("to_type = 'file'"), starts).select(F.col("node").alias("file"), "depth")


def affected_functions(symbols: DataFrame, edges: DataFrame, module: str) -> DataFrame:
    """Functions in the module and in every file that depends on it."""
    near = graphs.bfs(edges.where("to_type = 'file'"), graphs.seeds_of(edges, [module]), direction="in").select(F.col("node").alias("file"))
    return symbols.where("kind = 'function'").join(near, "file", "left_semi").select("id", "name", "file")


def ask(question: str, symbols: DataFrame, symbol_edges: DataFrame, file_edges: DataFrame) -> DataFrame:
    """The answer to a canned question."""
    q = parse_question(question)
    plans = {
        "most_called": lambda: most_called(symbols, symbol_edges, q.limit),
        "classes_implementing": lambda: classes_implementing(symbols, symbol_edges, q.subject),
        "controllers_endpoints": lambda: controllers_endpoints(symbols, q.limit),
        "complex_class": lambda: highest_complexity(symbols, "class", q.limit),
        "complex_function": lambda: highest_complexity(symbols, "function", q.limit),
        "dependency_chain": lambda: dependency_chain(symbols, file_edges, q.subject),
        "affected_functions": lambda: affected_functions(symbols, file_edges, q.subject),
    }
    return plans[q.plan]()


MARK = "...[truncated]"
_QUOTED = re.compile(r"('(?:[^'\\]|\\.|'')*'|\"[^\"]*\"|`[^`]*`)")


def read_only(spark: SparkSession, query: str) -> bool:
    """Whether a text is a single statement that only reads, by Spark's own parser."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
    except Exception as e:  # the parser's complaints are Java exceptions of several classes
        raise ValueError(f"no statement: {str(e).splitlines()[0]}") from e
    jvm = spark._jvm
    kind = lambda name: jvm.java.lang.Class.forName(f"org.apache.spark.sql.catalyst.plans.logical.{name}")
    writes, wrapped = [kind("Command"), kind("ParsedStatement")], kind("UnresolvedWith")
    while wrapped.isInstance(plan):
        plan = plan.child()
    return not any(w.isInstance(plan) for w in writes)


def clipped(cell: Column, most: int) -> Column:
    """A text of at most ``most`` bytes: whole characters, then the mark."""
    raw, budget = cell.cast("binary"), max(0, most - len(MARK))
    inside = lambda p: F.hex(F.substring(raw, p + 1, 1)).between("80", "BF")  # noqa: E731  (the byte after p continues a character)
    cut = F.lit(max(0, budget - 3))
    for k in (2, 1, 0):
        p = max(0, budget - k)
        cut = F.when(~inside(p), F.lit(p)).otherwise(cut)
    return F.when(F.octet_length(cell) > most, F.concat(F.substring(raw, F.lit(1), cut).cast("string"), F.lit(MARK))).otherwise(cell)


def bounded_sql(spark: SparkSession, query: str, views: dict[str, DataFrame], max_rows: int = 100, max_bytes: int = 200_000, cell_bytes: int = 8_000, args: dict | list | None = None) -> DataFrame:
    """A read-only statement over named tables, clipped to rows, bytes a cell and bytes in all; ``truncated`` tells in every row whether anything was.

    ``args`` are the statement's parameters. At most 500 rows come back, so the
    running sum of bytes is over a bounded table. Names are replaced outside
    quotes only.
    """
    text = query.rstrip().rstrip(";")
    if not re.match(r"\s*(select|with|values|from|\()", text, re.I) or not read_only(spark, text):
        raise ValueError("only a single SELECT is allowed")
    parts = _QUOTED.split(text)
    for name, df in views.items():
        alias = f"_q_{id(df):x}_{name}"
        df.createOrReplaceTempView(alias)
        parts = [re.sub(rf"(?<![\w.]){re.escape(name)}(?![\w.])", f"`{alias}`", x) if k % 2 == 0 else x for k, x in enumerate(parts)]
    most = max(0, min(max_rows, 500))
    rows = (spark.sql("".join(parts), args=args) if args else spark.sql("".join(parts))).limit(most + 1)
    cells, cut = [], F.lit(False)
    for c, kind in rows.dtypes:
        col = F.col(f"`{c}`")
        if kind == "binary":
            cut = cut | col.isNotNull()
            col = F.concat(F.lit("<"), F.octet_length(col).cast("string"), F.lit(" bytes>"))
        elif kind == "string":
            cut = cut | F.coalesce(F.octet_length(col) > cell_bytes, F.lit(False))
            col = clipped(col, cell_bytes)
        cells.append(col.alias(c))
    shown = rows.select(*cells, cut.alias("_cut")).withColumn("_i", F.monotonically_increasing_id())
    size = F.octet_length(F.to_json(F.struct(*[f"`{c}`" for c in rows.columns])))
    w = Window.orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = shown.withColumn("_b", F.sum(size).over(w)).withColumn("_n", F.row_number().over(Window.orderBy("_i")))
    kept = (F.col("_n") <= most) & (F.col("_b") <= max_bytes)
    every = Window.partitionBy()  # at most 501 rows
    flagged = told.withColumn("truncated", F.max(F.when(kept, F.col("_cut")).otherwise(True)).over(every))
    return flagged.where(kept).drop("_i", "_b", "_n", "_cut")


def collected(rows: DataFrame, seconds: float) -> list:
    """The rows, or an error once the deadline has passed: the job is cancelled."""
    import threading
    import uuid

    sc, group = rows.sparkSession.sparkContext, f"bounded-{uuid.uuid4().hex}"
    sc.setJobGroup(group, "bounded statement", interruptOnCancel=True)
    late = threading.Event()
    timer = threading.Timer(seconds, lambda: (late.set(), sc.cancelJobGroup(group)))
    timer.start()
    try:
        return rows.collect()
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"no result within {seconds} s") from e
        raise
    finally:
        timer.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)
