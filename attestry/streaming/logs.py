"""Structured Streaming forms of the ingest and log operators.

Each runs to the end of what is there (``availableNow``) and then stops; started again with
the same checkpoint it goes on with new files only.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import scratch


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream, whether the table is one file or a folder of files."""
    path = f"{sf_dir}/{name}.parquet"
    table = spark.read.parquet(path)
    source = spark.readStream.schema(table.schema)
    if any(file.endswith(f"/{name}.parquet") for file in table.inputFiles()):
        return source.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return source.parquet(path)


def to_the_end(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is available into Parquet files and read them."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").outputMode(mode).trigger(availableNow=True).start(f"{path}/rows")
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def windowed_counts(events: DataFrame, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Events per type and window; rows later than the watermark are left out, windows are final."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    g = timed.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("begin"), "event_type", "n", "total")


def ingest_new(documents: DataFrame, stored_path: str, checkpoint: str) -> None:
    """Append documents whose content is not stored yet, the first of each content per batch.

    The stored table is the state, so content is recognised whenever it came, and a batch
    that is run again after a failure finds its own rows and adds nothing.
    """

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.groupBy("content_hash").agg(F.min("id").alias("id"))
        try:
            known = spark.read.parquet(stored_path).select("content_hash")
        except Exception as problem:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(problem):
                raise
        else:
            fresh = fresh.join(known, "content_hash", "left_anti")
        fresh.select("id", "content_hash").write.mode("append").parquet(stored_path)

    query = documents.writeStream.option("checkpointLocation", checkpoint).foreachBatch(add).trigger(availableNow=True).start()
    query.awaitTermination()


def once_per_key(alerts: DataFrame, key: str, late: str) -> DataFrame:
    """The first row of each key within the watermark: a repeated alert is not sent twice."""
    return alerts.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark([key])


#: What an event does to a claim that waits; all other states are final.
TRANSITIONS = {"purchase": "APPROVED", "error": "REJECTED"}


def review_states(stream: DataFrame) -> DataFrame:
    """(user_id, state) whenever a waiting claim is decided: one small state per key, kept by Spark.

    The first deciding event in order of time counts; later ones find the claim decided.
    """

    def advance(key, frames, state):
        now = state.get[0] if state.exists else "PENDING"
        before = now
        events = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        if now == "PENDING":
            now = next((TRANSITIONS[e] for e in events["event_type"] if e in TRANSITIONS), now)
        state.update((now,))
        if now != before:
            yield pd.DataFrame({"user_id": [key[0]], "state": [now]})

    return stream.select("user_id", "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts")).groupBy("user_id").applyInPandasWithState(advance, "user_id long, state string", "now string", "append", "NoTimeout")


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_the_end(review_states(table_stream(spark, sf_dir, "events")), scratch(spark, "states"))


def ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "ingest")
    docs = table_stream(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2(F.regexp_replace(F.trim("text"), r"\s+", " "), 256).alias("content_hash"))
    ingest_new(docs, f"{folder}/stored", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/stored")


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = to_the_end(windowed_counts(table_stream(spark, sf_dir, "events")), scratch(spark, "windows"))
    return rows.select(F.to_date("begin").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def alerted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with an error, each once."""
    errors = table_stream(spark, sf_dir, "events").where("event_type = 'error'").select("user_id", "ts")
    return to_the_end(once_per_key(errors, "user_id", "400 days"), scratch(spark, "alerts")).select("user_id")
