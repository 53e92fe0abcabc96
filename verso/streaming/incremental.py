"""Translation of documents as they arrive, with the same functions as the batch flows.

A file stream is segmented and translated batch by batch; the checkpoint of the query remembers the files
and the results table remembers the segments, so that a restart repeats neither.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from verso.operators import html_segments, translators
from verso.plans import flows

PAGES = "page_id bigint, url string, html string"


def translate_pages(spark: SparkSession, path: str, results: str, checkpoint: str, translator: translators.Translator, source: str = "en", target: str = "zh-Hans", files_per_batch: int = 100) -> StreamingQuery:
    """Start a query over Parquet files of pages that works off what is there and then stops."""
    pages = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch).parquet(path)

    def batch(df: DataFrame, _: int) -> None:
        segments = html_segments.segments(df).select("doc_id", "seg_idx", "text")
        flows.translate(segments, translator, source, target, results)

    return pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """``start, event_type, n, total`` in windows of event time; rows later than the watermark are dropped."""
    timed = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type")
    return timed.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
