"""Whole flows: documents in, translated documents out, with a results table to resume from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verso.functions import prompts
from verso.functions.text import TRANSLATED, output_name
from verso.operators import batching, html_segments, layout, markdown, spans, translators
from verso.operators import cache as caching
from verso.sources import files, sinks

RESULTS = "doc_id bigint, seg_idx int, translation string, error string"
CACHE = "source_hash string, translated_text string, status int, updated_at timestamp"
RESULT_COLUMNS = ("doc_id", "seg_idx", "translation", "error")
#: Batches whose results are appended together.
BATCHES_AT_ONCE = 1000
#: Seconds before each prompt, and tasks that send prompts at the same time.
PAUSE, IN_FLIGHT = 0.1, 8


def work_batches(segments: DataFrame, max_segments: int = batching.MAX_SEGMENTS, max_bytes: int = batching.MAX_BYTES) -> DataFrame:
    """``doc_id, batch_idx, segs`` of segments (``doc_id, seg_idx, text``), each document's in order."""
    listed = segments.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("seg_idx").alias("idx"), "text"))).alias("segs"))
    texts = listed.withColumn("texts", F.transform("segs", lambda s: s["text"]))
    return batching.plan_batches(texts, max_segments=max_segments, max_bytes=max_bytes, carry="segs").select("doc_id", "batch_idx", "segs")


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of Parquet files that may not have been begun yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    begun = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(schema).parquet(path) if begun else spark.createDataFrame([], schema)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The results so far, one row per segment: a translation before an error. Empty before the first run."""
    found = _table(spark, path, RESULTS)
    best = found.groupBy("doc_id", "seg_idx").agg(F.max_by(F.struct("translation", "error"), F.col("translation").isNotNull()).alias("r"))
    return best.select("doc_id", "seg_idx", "r.translation", "r.error")


def translate(
    segments: DataFrame,
    translator: translators.Translator,
    source: str,
    target: str,
    results: str,
    dedupe: bool = True,
    cache: str | None = None,
    model: str = "",
    system: str = prompts.SYSTEM_PROMPT,
    pause: float = PAUSE,
    in_flight: int = IN_FLIGHT,
    at_once: int = BATCHES_AT_ONCE,
    **options,
) -> DataFrame:
    """Translate what has no translation yet, append it to ``results``, and return all of its rows.

    Equal texts reach the model once (``dedupe``). With ``cache`` (a table that flows share), texts that were translated
    under the same languages, model and prompt reach no model, and new translations are added. Results are appended
    after every ``at_once`` batches and read back, so that no plan that uses them sends a prompt again and a run that
    stopped is continued by calling this again. ``in_flight`` tasks send prompts, ``pause`` seconds apart.
    """
    spark = segments.sparkSession
    segments = segments.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("seg_idx").cast("int").alias("seg_idx"), "text")
    key = caching.cache_key(F.col("text"), F.lit(source), F.lit(target), F.lit(model), F.lit(system))
    no_error = F.lit(None).cast("string").alias("error")

    def missing() -> DataFrame:
        known = read_results(spark, results).filter("translation is not null")
        return segments.join(known, ["doc_id", "seg_idx"], "left_anti")

    if cache:
        held = _table(spark, cache, CACHE).groupBy("source_hash").agg(F.max_by(F.struct("translated_text", "status"), "updated_at").alias("r")).select("source_hash", "r.*")
        hits = caching.probe(missing().withColumn("source_hash", key), held).filter("hit")
        hits.select("doc_id", "seg_idx", F.col("translated_text").alias("translation"), no_error).write.mode("append").parquet(results)
    todo = missing()
    if dedupe:
        first = F.min(F.struct("doc_id", "seg_idx", "text")).alias("r")
        todo = todo.groupBy(F.sha2("text", 256).alias("h")).agg(first).select("r.*")
    plan = f"{results.rstrip('/')}_plan"
    work_batches(todo).write.mode("overwrite").parquet(plan)
    batches = spark.read.parquet(plan)
    turns = -(-batches.count() // at_once)
    for turn in range(turns):
        part = batches.filter(F.pmod(F.xxhash64("doc_id", "batch_idx"), F.lit(turns)) == turn)
        done = translators.run_batches(part.repartition(in_flight), translator, source, target, system=system, pause=pause, **options)
        done.select(*RESULT_COLUMNS).write.mode("append").parquet(results)
    if dedupe and turns:
        by_text = segments.join(read_results(spark, results), ["doc_id", "seg_idx"]).filter("translation is not null").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("translation").alias("translation"))
        copies = missing().withColumn("h", F.sha2("text", 256)).join(by_text, "h")
        copies.select("doc_id", "seg_idx", "translation", no_error).write.mode("append").parquet(results)
    if cache and turns:
        sent = batches.select("doc_id", F.explode("segs").alias("s")).select("doc_id", F.col("s.idx").alias("seg_idx"), F.col("s.text").alias("text"))
        new = sent.join(read_results(spark, results), ["doc_id", "seg_idx"]).filter("translation is not null")
        new.select(key.alias("source_hash"), F.col("translation").alias("translated_text"), F.lit(TRANSLATED).alias("status"), F.current_timestamp().alias("updated_at")).write.mode("append").parquet(cache)
    return read_results(spark, results)


def require_complete(segments: DataFrame, results: DataFrame) -> None:
    """Raise, naming the first missing segment of a document, unless every segment has a translation."""
    joined = segments.select("doc_id", "seg_idx").join(results, ["doc_id", "seg_idx"], "left")
    gaps = batching.completeness(joined).filter("not complete").orderBy("doc_id").limit(1).collect()
    if gaps:
        raise ValueError(f"document {gaps[0].doc_id}: segment {gaps[0].first_missing} has no translation")


def failures(results: DataFrame) -> DataFrame:
    """``doc_id, n_failed, errors`` of documents with segments that could not be translated; ``errors``: ``seg_idx, error`` in order."""
    return results.filter("error is not null").groupBy("doc_id").agg(F.count("*").alias("n_failed"), F.array_sort(F.collect_list(F.struct("seg_idx", "error"))).alias("errors"))


def damaged_path(results: str) -> str:
    return f"{results.rstrip('/')}_damaged"


def translate_epubs(spark: SparkSession, path: str, out: str, results: str, translator: translators.Translator, source: str = "en", target: str = "zh-Hans", strict: bool = False, **options) -> DataFrame:
    """Books under ``path`` translated into ``out``; returns the results.

    Files that are no readable books are named with their errors in the table at :func:`damaged_path`; ``strict``
    raises for the first of them instead.
    """
    books = files.read_binary(spark, path, "*.epub")
    scanned = files.epub_sections(books)
    damaged = scanned.filter("error is not null").select("doc_id", "error").join(books.select("doc_id", "path"), "doc_id").select("doc_id", "path", "error")
    damaged.write.mode("overwrite").parquet(damaged_path(results))
    if strict and (bad := spark.read.parquet(damaged_path(results)).orderBy("path").limit(1).collect()):
        raise ValueError(f"{bad[0].path}: {bad[0].error}")
    sections = scanned.filter("error is null")
    segments = html_segments.segments(sections, "doc_id", "html", "section_idx").select("doc_id", "seg_idx", "text")
    done = translate(segments, translator, source, target, results, **options)
    require_complete(segments, done)
    marked = html_segments.skeletons(sections, "doc_id", "html", "section_idx").join(html_segments.by_number(done), "doc_id", "left")
    paths = sections.select("doc_id", F.col("section_idx").alias("sec"), "path", F.col("section_idx"))
    html = marked.join(paths, ["doc_id", "sec"]).select("doc_id", "section_idx", "path", html_segments.substitute(F.col("marked"), F.coalesce("translations", F.array().cast("array<string>"))).alias("html"))
    made = sinks.output_paths(sinks.epub_files(books, html), path, output_name)
    sinks.write_files(made, out, F.col("out"), F.col("content"))
    return done


def translate_markdown(spark: SparkSession, path: str, out: str, results: str, translator: translators.Translator, source: str = "en", target: str = "zh-Hans", **options) -> DataFrame:
    """Markdown files under ``path`` translated into ``out``; returns the results."""
    docs = files.read_text(spark, path)
    scanned = markdown.scan_documents(docs)
    segments = scanned.select("doc_id", F.posexplode("segments").alias("seg_idx", "text"))
    done = translate(segments, translator, source, target, results, **options)
    require_complete(segments, done)
    joined = scanned.join(html_segments.by_number(done), "doc_id", "left").join(docs.select("doc_id", "path"), "doc_id")
    text = markdown.render(F.col("marked"), F.col("segments"), F.coalesce("translations", F.array().cast("array<string>")), F.col("code_spans"))
    made = sinks.output_paths(joined.select("path", text.alias("content")), path, output_name)
    sinks.write_files(made, out, F.col("out"), F.col("content"))
    return done


def translate_positioned(positioned: DataFrame, images: DataFrame, out: str, results: str, translator: translators.Translator, source: str = "en", target: str = "zh-Hans", **options) -> DataFrame:
    """Documents of positioned text (``spans``, ``images``) translated and laid out again as a table of placed lines at ``out``.

    A text without a translation stays as it is; code is never translated. Returns the results.
    """
    spark = positioned.sparkSession
    elements = spans.page_elements(positioned, images)
    segments = elements.filter("kind = 'text'").select("doc_id", F.col("seg_idx").cast("int").alias("seg_idx"), "text")
    done = translate(segments, translator, source, target, results, **options)
    layout.lay_out(put_in(elements, done)).write.mode("overwrite").parquet(out)
    return read_results(spark, results)


def put_in(elements: DataFrame, results: DataFrame) -> DataFrame:
    """``elements`` with each text's translation, where there is one, for the text."""
    found = results.filter("translation is not null").select("doc_id", "seg_idx", "translation")
    joined = elements.withColumn("seg_idx", F.col("seg_idx").cast("int")).join(found, ["doc_id", "seg_idx"], "left")
    return joined.withColumn("text", F.coalesce("translation", "text")).drop("translation").select(*elements.columns)
