"""The ledger as a stream: entries arrive, new ids are appended once, the outcome equals the batch append."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rollcall.operators.ledger import with_id


def append_stream(entries: DataFrame, target: str, checkpoint: str, late: str | None = None, moment: str = "ts") -> StreamingQuery:
    """Starts appending the entries with new ids to the table at target, for all input there is.

    Without `late` every id ever seen is remembered; with it, ids are forgotten once the watermark has passed, which
    bounds the state for streams whose repeats come within that delay.
    """
    new = with_id(entries)
    new = new.withWatermark(moment, late).dropDuplicatesWithinWatermark(["id"]) if late else new.dropDuplicates(["id"])
    return new.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def tally_stream(events: DataFrame, moment: str, kind: str, window: str, late: str) -> DataFrame:
    """(start, kind, n) per window, closed once the watermark has passed it; later rows are left out."""
    counted = events.withWatermark(moment, late).groupBy(F.window(moment, window), kind).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), kind, "n")


def run_append(spark: SparkSession, source: str, schema, make, target: str, checkpoint: str) -> DataFrame:
    """Streams the parquet files of source through make into the ledger at target and returns what is there."""
    append_stream(make(spark.readStream.schema(schema).parquet(source)), target, checkpoint).awaitTermination()
    return spark.read.parquet(target)
