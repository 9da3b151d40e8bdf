"""Bars, deduplication and versions as Structured Streaming jobs.

Every job reads a growing folder or file, keeps its state under a watermark or
by key, and publishes through a checkpointed sink, so a restarted job neither
loses nor repeats rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators import bars as br
from tidemark.sources.sinks import shared_path

c = F.col


def read_stream(spark: SparkSession, path: str, files_a_batch: int = 16) -> DataFrame:
    """New files of a path as a stream, with the schema that is there now."""
    # A pattern matches a single file as well as a folder.
    pattern = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_a_batch).parquet(pattern)


def timed(events: DataFrame) -> DataFrame:
    """Event time as an instant, which watermarks need."""
    return events.withColumn("ts", c("ts").cast("timestamp"))


def finished_bars(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Hourly bars; a bar leaves when no row can change it any more."""
    windows = timed(events).withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
    agg = windows.agg(F.count("*").alias("n"), F.max("value").alias("high"), F.min("value").alias("low"))
    return agg.select(c("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", "high", "low")


def finished_slots(rows: DataFrame, edges: list[int], late: str = "1 hour") -> DataFrame:
    """Bars of unequal slots. The watermark runs on the ends of slots, so a bar
    leaves when its slot ended ``late`` or more before the latest one met; rows
    of it that come after that change nothing.
    """
    ends = br.slot_bounds(edges)["available_at"].cast("timestamp")
    marked = br.in_slots(rows, edges).withColumn("end", ends).withWatermark("end", late)
    bars = marked.groupBy("end", "code", "day", "slot").agg(*br.slot_values(rows))
    return bars.drop("end").withColumns(br.slot_bounds(edges))


def first_seen(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Each key once for each hour of event time."""
    marked = timed(events).withWatermark("ts", late).withColumn("hour", F.window("ts", "1 hour").start)
    return marked.dropDuplicatesWithinWatermark([*keys, "hour"]).select(*keys, c("hour").cast("timestamp_ntz").alias("hour"))


def classify_stream(docs: DataFrame) -> DataFrame:
    """new, duplicate or changed for every version, against keyed state.

    State of a document is its last version and hash. A version that is not
    later than the last is stale and leaves the state alone.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, digest = state.get if state.exists else (None, None)
        rows = pd.concat(list(batches)).sort_values("version")
        out = []
        for version, h in zip(rows["version"], rows["hash"]):
            if last is not None and version <= last:
                kind = "stale"
            else:
                kind = "new" if last is None else "duplicate" if h == digest else "changed"
                last, digest = int(version), h
            out.append((key[0], int(version), h, kind))
        state.update((last, digest))
        yield pd.DataFrame(out, columns=["doc_id", "version", "hash", "kind"])

    digest = F.substring(F.sha2(F.coalesce("title", F.lit("")), 256), 1, 16)
    rows = docs.select("doc_id", "version", digest.alias("hash"))
    return rows.groupBy("doc_id").applyInPandasWithState(run, "doc_id long, version long, hash string, kind string", "version long, hash string", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, name: str, out: str | None = None) -> DataFrame:
    """Run a stream over all that is there now; what it published, as a table.
    ``out`` names the folder of an earlier run, whose checkpoint this one takes up."""
    spark = stream.sparkSession
    out = out or shared_path(spark, name)
    query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")
