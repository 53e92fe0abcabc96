"""Bounded history and text exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CAPACITY, EVICTED = 1000, 100


def retained_count(n: Column) -> Column:
    """Rows left after n inserts, when each insert beyond the capacity drops the oldest hundred."""
    return F.when(n <= CAPACITY, n).otherwise(CAPACITY - EVICTED + 1 + (n - CAPACITY - 1) % EVICTED)


def retained(history: DataFrame, seq: str = "seq", by: str | None = None) -> DataFrame:
    """The newest rows that a bounded history would still hold, for each value of ``by``.

    At most ``CAPACITY`` rows can stay: a top-k by order and limit without ``by``, a rank within each group
    with it (Spark bounds such ranks before the shuffle).
    """
    if by is None:
        n = history.agg(retained_count(F.count("*")).alias("k"))
        newest = history.orderBy(F.desc(seq)).limit(CAPACITY)
        ranked = newest.withColumn("rn_", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(seq))))
        return ranked.filter(F.col("rn_") <= n.scalar()).drop("rn_")
    counts = history.groupBy(by).agg(retained_count(F.count("*")).alias("k_"))
    ranked = history.withColumn("rn_", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(seq)))).filter(F.col("rn_") <= CAPACITY)
    return ranked.join(counts, by).filter("rn_ <= k_").drop("rn_", "k_")


def clock(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss")


def record_text(original: Column, translated: Column) -> Column:
    """One record of the batch export; records follow each other without a separator."""
    return F.concat(F.lit("[Original]\n"), original, F.lit("\n[Translated]\n"), translated, F.lit("\n---"))


def batch_export(rows: DataFrame, order: str) -> DataFrame:
    """``order`` and ``content`` of each record of the export; the export is their contents in that order."""
    return rows.select(order, record_text(F.col("original"), F.col("translated")).alias("content"))


def write_export(rows: DataFrame, order: str, path: str) -> None:
    """The export as text files whose names are in the export's order; no task holds more than its part."""
    body = F.expr("substr(content, 1, length(content) - 3)").alias("content")  # the writer ends each record itself
    batch_export(rows, order).orderBy(order).select(body).write.option("lineSep", "---").text(path)


def history_file_name(seconds: Column) -> Column:
    return F.concat(F.lit("history_"), seconds.cast("string"), F.lit(".json"))


def write_history(rows: DataFrame, folder: str, seconds: int, seq: str = "seq") -> str:
    """The history, newest last, as JSON lines below a name that has the time; returns the path."""
    path = f"{folder.rstrip('/')}/history_{seconds}.json"
    rows.orderBy(seq).write.json(path)
    return path


def previews(rows: DataFrame, order: str, n: int, by: str | None = None) -> DataFrame:
    """The first ``n`` rows, of the table or of each value of ``by``."""
    if by is None:
        return rows.orderBy(order).limit(n)
    return rows.withColumn("rn_", F.row_number().over(Window.partitionBy(by).orderBy(order))).filter(F.col("rn_") <= n).drop("rn_")


def history_json(rows: DataFrame) -> DataFrame:
    """``json`` of each row, for a line-by-line export."""
    return rows.select(F.to_json(F.struct("*")).alias("json"))
