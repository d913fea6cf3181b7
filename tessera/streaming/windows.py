"""Event-time aggregation and change streams; every plan here takes batch and streaming inputs alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str, late: str = "1 hour", time_col: str = "ts") -> DataFrame:
    """(window_start, event_type, events, total) by fixed windows; a stream drops what is ``late``."""
    rows = events.withWatermark(time_col, late) if events.isStreaming else events
    grouped = rows.groupBy(F.window(time_col, width).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("window_start"), "event_type", "events", "total")


def deduplicated(events: DataFrame, keys: list[str], late: str = "1 hour", time_col: str = "ts") -> DataFrame:
    """One row for each key; a stream keeps keys as long as the watermark asks."""
    return events.withWatermark(time_col, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def upsert(current: DataFrame, batch: DataFrame, key: str = "path") -> DataFrame:
    """``current`` after a batch of changes with columns of the table and ``kind`` (added, modified, deleted) and ``version``.

    The last version of a key in the batch counts; deleted keys go.
    """
    columns = current.columns
    last = batch.groupBy(key).agg(F.max_by(F.struct("kind", *[c for c in columns if c != key]), "version").alias("x")).select(key, "x.*")
    kept = current.join(last.select(key), key, "left_anti")
    return kept.unionByName(last.where("kind != 'deleted'").select(*columns))


#: Parts of a followed table; a batch rewrites the parts it touches.
PARTS = 64


def _part(key: str):
    return F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")


def followed(spark, path: str, version: int | None = None) -> DataFrame:
    """The table that :func:`follow` keeps under ``path``, as of a batch (the last one by default)."""
    book = spark.read.json(f"{path}/book/v={version}") if version is not None else spark.read.json(f"{path}/book")
    if version is None:
        book = book.where(F.col("v") == book.agg(F.max("v")).first()[0])
    rows = book.select("part", "version").collect()  # at most PARTS rows
    places = [f"{path}/data/version={r.version}/part={r.part}" for r in rows if r.version is not None]
    return spark.read.option("basePath", f"{path}/data").parquet(*places).drop("version", "part")


def follow(changes: DataFrame, path: str, key: str = "path", checkpoint: str | None = None):
    """Start a query that folds a change stream into a Parquet table under ``path``.

    The table lies in ``PARTS`` parts by the key's hash. A batch reads and writes
    only the parts that its keys fall into, under its own version, and a small
    book tells the version of every part, so a repeated batch rewrites its own
    version and readers never see half of one.
    """
    spark = changes.sparkSession

    def fold(batch: DataFrame, n: int) -> None:
        columns = [c for c in batch.columns if c not in ("kind", "version")]
        batch = batch.persist()
        touched = sorted(r[0] for r in batch.select(_part(key)).distinct().collect())  # at most PARTS numbers
        old = {r.part: r.version for r in spark.read.json(f"{path}/book/v={n - 1}").collect()} if n else dict.fromkeys(range(PARTS))
        places = [f"{path}/data/version={old[k]}/part={k}" for k in touched if old[k] is not None]
        base = spark.read.option("basePath", f"{path}/data").schema(batch.select(*columns).schema).parquet(*places).select(*columns) if places else spark.createDataFrame([], batch.select(*columns).schema)
        new = upsert(base, batch, key).withColumn("part", _part(key))
        new.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/data/version={n}")
        kept = {r[0] for r in spark.read.parquet(f"{path}/data/version={n}").select("part").distinct().collect()} if not new.isEmpty() else set()
        book = [(k, (n if k in kept else None) if k in touched else old[k]) for k in range(PARTS)]
        spark.createDataFrame(book, "part int, version int").coalesce(1).write.option("ignoreNullFields", "false").mode("overwrite").json(f"{path}/book/v={n}")
        batch.unpersist()

    writer = changes.writeStream.foreachBatch(fold)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).trigger(availableNow=True).start()


def matching(chunks: DataFrame, pattern: str, text_col: str = "text", *keep: str) -> DataFrame:
    """(kept columns, matches) of the rows that hold ``pattern``; the same plan over a table or a stream of files."""
    return chunks.where(F.col(text_col).rlike(pattern)).select(*keep, F.regexp_count(F.col(text_col), F.lit(pattern)).cast("long").alias("matches"))


def source(spark, path: str, schema, most_files: int = 100) -> DataFrame:
    """A stream of the Parquet files in ``path``; ``most_files`` a batch hold the source back while batches are worked on."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(path)


def drained(stream: DataFrame, path: str, checkpoint: str):
    """Write what a stream has now to Parquet and end; a restart goes on from the checkpoint."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def freshness(manifest: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session, stale, files): sessions (session, path, signature) with the number of their files that have changed or gone since."""
    now = manifest.select("path", F.col("signature").alias("_now"))
    rows = sessions.join(now, "path", "left")
    return rows.groupBy("session").agg(F.count_if(~F.col("signature").eqNullSafe(F.col("_now"))).alias("stale"), F.count("*").alias("files"))
