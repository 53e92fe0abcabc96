"""Translation cache: keys, probes, upserts and statistics over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verso.functions.text import is_translated, source_hash


def cache_key(text: Column, source: Column, target: Column, model: Column, prompt: Column) -> Column:
    """Hash of all that a translation depends on; parts are set apart so that no two lists of parts agree."""
    parts = [F.concat(F.octet_length(F.coalesce(c, F.lit(""))).cast("string"), F.lit(":"), F.coalesce(c, F.lit(""))) for c in (text, source, target, model, prompt)]
    return F.sha2(F.concat(*parts), 256)


def probe(requests: DataFrame, cache: DataFrame, key: str = "source_hash") -> DataFrame:
    """``requests`` with ``translated_text``, ``hit`` and ``tokens_used`` (0 for hits, null for misses).

    Requests that repeat a text fall on one row of the cache, which has a row for each key.
    """
    usable = cache.filter(is_translated(F.col("status"))).select(key, "translated_text")
    joined = requests.join(usable.withColumn("hit_", F.lit(True)), key, "left")
    hit = F.coalesce("hit_", F.lit(False))
    return joined.withColumn("hit", hit).withColumn("tokens_used", F.when(hit, 0)).drop("hit_")


def misses(requests: DataFrame, cache: DataFrame, key: str = "source_hash") -> DataFrame:
    """One request for each key that the cache cannot answer, so that equal texts reach the model once."""
    return requests.join(cache.filter(is_translated(F.col("status"))), key, "left_anti").dropDuplicates([key])


def upsert(cache: DataFrame, rows: DataFrame, key: str = "source_hash", version: str = "updated_at") -> DataFrame:
    """The latest row for each key; aggregation by key with the row as a value, no window over a key's history."""
    both = cache.withColumn("side_", F.lit(0)).unionByName(rows.withColumn("side_", F.lit(1)))
    others = [c for c in cache.columns if c != key]
    latest = both.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(version, "side_")).alias("row_"))
    return latest.select(*[F.col(key) if c == key else F.col(f"row_.{c}").alias(c) for c in cache.columns])


def remove(cache: DataFrame, keys: DataFrame, key: str = "source_hash") -> DataFrame:
    return cache.join(keys.select(key).distinct(), key, "left_anti")


def stats(cache: DataFrame, probes: DataFrame) -> DataFrame:
    """``total_items`` and ``hit_rate`` (0 without probes)."""
    size = cache.agg(F.count("*").alias("total_items"))
    rate = probes.agg(F.coalesce(F.avg(F.col("hit").cast("double")), F.lit(0.0)).alias("hit_rate"))
    return size.select("total_items", rate.scalar().alias("hit_rate"))


def documents_as_requests(docs: DataFrame) -> DataFrame:
    """Every text after the first of its kind, in order of ``doc_id``, finds the cache filled.

    The first of each text comes from an aggregation, which combines before the shuffle.
    """
    hashed = docs.select("doc_id", source_hash(F.coalesce("text", F.lit(""))).alias("source_hash"))
    first = hashed.groupBy("source_hash").agg(F.min("doc_id").alias("first"))
    return hashed.join(first, "source_hash").select("doc_id", "source_hash", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("hit"))
