"""Streaming forms of detection, first-seen addresses and audit, on Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from keelsieve.operators import detect, weburl
from keelsieve.sinks import render
from keelsieve.sources.rules import Rule


def artifacts(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """Parquet files of artifacts as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def detected(stream: DataFrame, rules: Iterable[Rule], options: detect.Options) -> DataFrame:
    """Findings of a stream of artifacts: the batch plan as it is, stateless."""
    return detect.detect(stream, rules, options)


def first_seen(stream: DataFrame, url: str = "url", at: str | None = None, delay: str = "7 days") -> DataFrame:
    """Each canonical address once. With an event time, state is kept only as long as late rows are waited for."""
    rows = stream.withColumn("url", weburl.canonical_url(F.col(url))).where("url IS NOT NULL")
    rows = rows.withColumn("fingerprint", weburl.url_fingerprint(F.col("url")))
    if at is None:
        return rows.dropDuplicates(["fingerprint"])
    return rows.withWatermark(at, delay).dropDuplicatesWithinWatermark(["fingerprint"])


def counts(stream: DataFrame, at: str, keys: list[str], window: str = "1 hour", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Rows per event-time window and keys; windows close once the watermark passes them."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, window, slide) if slide else F.window(at, window), *keys).agg(F.count(F.lit(1)).alias("row_count"))


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there and stop; results go to Parquet. A restart with the same checkpoint repeats nothing."""
    query = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def append_audit(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Audit rows as JSON lines, until what is there is written."""
    query = stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def publish(messages: DataFrame, path: str, checkpoint: str, body: str = "body") -> StreamingQuery:
    """Messages within the size limit as JSON lines, each once even after a restart, until what is there is written."""
    query = render.publishable(messages, body).writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
