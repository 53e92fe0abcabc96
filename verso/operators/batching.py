"""Work selection, batch planning and completeness.

The planner works inside a row on the array of a document's segment sizes: no shuffle and no window, since
each block of at most MAX_SEGMENTS segments is halved at most seven times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verso.functions.text import let

MAX_SEGMENTS, MAX_BYTES = 100, 6000
_RANGE = "array<struct<lo:int,hi:int>>"


def lines_as_segments(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, texts``: each document's lines as its segments."""
    return docs.select(F.col(key).alias("doc_id"), F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1).alias("texts"))


def _range(lo: Column, hi: Column) -> Column:
    return F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))


def plan_batches(docs: DataFrame, texts: str = "texts", max_segments: int = MAX_SEGMENTS, max_bytes: int = MAX_BYTES, carry: str | None = None) -> DataFrame:
    """A row for each batch: ``doc_id, batch_idx, lo, hi, n_segments, n_bytes``, in order.

    Blocks of ``max_segments`` are halved while they have more than ``max_bytes`` bytes and more than one
    segment; a single segment may exceed the bytes. ``carry``: an array as long as ``texts``, of which each batch
    gets its own part as the column of that name.
    """
    df = let(docs.select("doc_id", *dict.fromkeys([texts, *[carry] * bool(carry)])), "sizes", F.transform(texts, lambda t: F.octet_length(t).cast("long")))
    df = df.drop(texts) if texts not in ("sizes", carry) else df
    n = F.size("sizes")
    blocks = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / max_segments).cast("int")), lambda b: _range(b * max_segments, F.least(b * max_segments + max_segments, n))))
    df = let(df, "ranges0", F.coalesce(blocks, F.array().cast(_RANGE)))
    total = lambda r: F.aggregate(F.slice(F.col("sizes"), r["lo"] + 1, r["hi"] - r["lo"]), F.lit(0).cast("long"), lambda a, x: a + x)
    rounds = max(1, max_segments - 1).bit_length()
    for k in range(rounds):
        halve = lambda r: F.when(
            (r["hi"] - r["lo"] > 1) & (total(r) > max_bytes),
            F.array(_range(r["lo"], r["lo"] + F.floor((r["hi"] - r["lo"]) / 2)), _range(r["lo"] + F.floor((r["hi"] - r["lo"]) / 2), r["hi"])),
        ).otherwise(F.array(_range(r["lo"], r["hi"])))
        df = let(df, f"ranges{k + 1}", F.flatten(F.transform(f"ranges{k}", halve))).drop(f"ranges{k}")
    part = lambda r: [F.slice(F.col(carry), r["lo"] + 1, r["hi"] - r["lo"]).alias("part")] if carry else []
    sized = F.transform(f"ranges{rounds}", lambda r: F.struct(r["lo"].alias("lo"), r["hi"].alias("hi"), total(r).alias("n_bytes"), *part(r)))
    out = df.select("doc_id", F.posexplode(sized).alias("batch_idx", "r"))
    found = [F.col("r.lo").alias("lo"), F.col("r.hi").alias("hi"), (F.col("r.hi") - F.col("r.lo")).alias("n_segments"), F.col("r.n_bytes").alias("n_bytes")]
    return out.select("doc_id", "batch_idx", *found, *([F.col("r.part").alias(carry)] if carry else []))


def naive_batches(n: Column, size: int = MAX_SEGMENTS) -> tuple[Column, Column]:
    """Number of batches of ``size``, and the last one's size."""
    return F.ceil(n / size), F.when(n % size == 0, F.least(n, F.lit(size))).otherwise(n % size)


def select_work(segments: DataFrame) -> DataFrame:
    """Segments still to be translated: no translation, and not kept as they are."""
    return segments.filter(F.col("translation").isNull() & ~F.coalesce("keep_original", F.lit(False)))


def keep_originals(segments: DataFrame) -> DataFrame:
    return segments.withColumn("translation", F.coalesce("translation", F.when(F.col("keep_original"), F.col("text"))))


def completeness(segments: DataFrame, key: str = "doc_id", idx: str = "seg_idx") -> DataFrame:
    """``key, n_segments, n_translated, first_missing, complete`` of every document."""
    missing = F.col("translation").isNull()
    return segments.groupBy(key).agg(F.count("*").alias("n_segments"), F.count("translation").alias("n_translated"), F.min(F.when(missing, F.col(idx))).alias("first_missing"), F.bool_and(~missing).alias("complete"))
