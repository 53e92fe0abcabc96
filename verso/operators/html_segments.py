"""HTML segmentation and marker-bearing skeletons, and the substitution of translations for markers.

Tokens of a page are exploded where the page is and meet again in one shuffle by document, in which every
running flag (code depth, pending element, number of flushes) is a window over the token order. Translations
are looked up by their segment's number, so that a missing one leaves a gap and moves no other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verso.functions.text import interleave, is_blank, trim

#: Elements whose text is translated, and markup that goes with it.
TRANSLATABLE = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "blockquote", "figcaption", "dt", "dd", "caption")
CODE = ("pre", "code")
INLINE = ("a", "abbr", "b", "br", "cite", "code", "em", "font", "i", "img", "mark", "q", "s", "small", "span", "strong", "sub", "sup", "u")
TOKEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<[^>]*>|[^<]+|<"
EPUB_MARKER, MARKDOWN_MARKER = "\x00EPUB_{}\x00", "\x00MD_{}\x00"


def tokens(pages: DataFrame, key: str = "page_id", html: str = "html", section: str | None = None) -> DataFrame:
    """``doc_id, sec, pos, tok, name, closes, ev, g, gt, pend`` of every token.

    ``ev``: 1 where a translatable element starts outside code, 0 where one ends. ``pend``: the last of
    these. ``g``: ends so far; ``gt``: ends in all, so that text after the last end is known to be lost.
    """
    source = pages.select(F.col(key).alias("doc_id"), (F.col(section) if section else F.lit(0)).alias("sec"), F.posexplode(F.regexp_extract_all(F.col(html), F.lit(TOKEN), F.lit(0))).alias("pos", "tok"))
    name = F.lower(F.regexp_extract("tok", r"^</?([a-zA-Z][a-zA-Z0-9]*)", 1))
    # Sections of a document stay together for all that follows.
    source = source.repartition("doc_id") if section else source
    source = source.withColumn("name", name).withColumn("closes", F.col("tok").startswith("</"))
    order = Window.partitionBy("doc_id", "sec").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("doc_id", "sec")
    step = F.when(F.col("name").isin(*CODE), F.when(F.col("closes"), -1).otherwise(1)).otherwise(0)
    deep = source.withColumn("cd", F.sum(step).over(order))
    event = F.when(F.col("name").isin(*TRANSLATABLE) & (F.col("cd") <= 0), F.when(F.col("closes"), 0).otherwise(1))
    flagged = deep.withColumn("ev", event)
    ends = F.when(F.col("ev") == 0, 1).otherwise(0)
    return flagged.withColumns({"pend": F.last("ev", ignorenulls=True).over(order), "g": F.sum(ends).over(order), "gt": F.sum(ends).over(whole)}).drop("cd")


def _is_text(tok: Column) -> Column:
    return ~tok.startswith("<")


def segments(pages: DataFrame, key: str = "page_id", html: str = "html", section: str | None = None) -> DataFrame:
    """``doc_id, sec, seg_idx, g, text``: the non-blank segments, numbered through a document's sections."""
    found = tokens(pages, key, html, section).filter(_is_text(F.col("tok")) & (F.col("pend") == 1) & (F.col("g") < F.col("gt")))
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("pos", "tok"))), lambda x: x["tok"])
    grouped = found.groupBy("doc_id", "sec", "g").agg(F.array_join(pieces, "").alias("raw"))
    trimmed = grouped.select("doc_id", "sec", "g", trim(F.col("raw")).alias("text")).filter("text <> ''")
    return trimmed.withColumn("seg_idx", F.row_number().over(Window.partitionBy("doc_id").orderBy("sec", "g")) - 1)


def skeletons(pages: DataFrame, key: str = "page_id", html: str = "html", section: str | None = None, marker: str = EPUB_MARKER) -> DataFrame:
    """``doc_id, sec, marked, segment_start, segment_count``: each section with markers for its segments.

    Between a translatable start and its flush, text and inline markup give way to the marker, which stands
    just before the end tag; all other tags stay.
    """
    found = tokens(pages, key, html, section)
    before, after = marker.split("{}")
    pending = (F.col("pend") == 1) & (F.col("g") < F.col("gt"))
    # An end belongs to the text that it closes; it has a segment if any of that text is not blank.
    closing = F.col("ev") == 0
    flagged = found.withColumn("own", F.col("g") - F.when(closing, 1).otherwise(0)).withColumn("full", _is_text(F.col("tok")) & pending & ~is_blank(F.col("tok")))
    of_segment = Window.partitionBy("doc_id", "sec", "own")
    flagged = flagged.withColumn("has", F.coalesce(closing, F.lit(False)) & F.max("full").over(of_segment))
    order = Window.partitionBy("doc_id", "sec").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = flagged.withColumn("number", F.when(F.col("has"), F.sum(F.col("has").cast("int")).over(order) - 1))
    piece = F.when(F.col("has"), F.col("tok")).when(pending & (_is_text(F.col("tok")) | F.col("name").isin(*INLINE)), "").otherwise(F.col("tok"))
    listed = F.array_sort(F.collect_list(F.struct("pos", "number", piece.alias("piece")))).alias("pieces")
    sections = numbered.groupBy("doc_id", "sec").agg(listed, F.count("number").alias("segment_count"))
    if section:
        earlier = Window.partitionBy("doc_id").orderBy("sec").rowsBetween(Window.unboundedPreceding, -1)
        sections = sections.withColumn("segment_start", F.coalesce(F.sum("segment_count").over(earlier), F.lit(0)))
    else:
        sections = sections.withColumn("segment_start", F.lit(0).cast("bigint"))
    mark = lambda x: F.concat(F.lit(before), (F.col("segment_start") + x["number"]).cast("string"), F.lit(after), x["piece"])
    marked = F.array_join(F.transform("pieces", lambda x: F.when(x["number"].isNotNull(), mark(x)).otherwise(x["piece"])), "")
    return sections.select("doc_id", "sec", marked.alias("marked"), "segment_start", "segment_count")


def by_number(translated: DataFrame) -> DataFrame:
    """``doc_id`` and ``translations``, an array with each translation at its segment's number and nulls in the gaps.

    Of rows that repeat a segment the smallest translation counts.
    """
    one = translated.groupBy("doc_id", F.col("seg_idx").cast("int").alias("seg_idx")).agg(F.min("translation").alias("translation"))
    found = one.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("seg_idx", "translation"))).alias("found"), F.max("seg_idx").alias("last"))
    return found.select("doc_id", F.transform(F.sequence(F.lit(0), F.col("last")), lambda k: F.try_element_at(F.col("found"), k)).alias("translations"))


def _once(f: Callable[[Column, Column], Column], a: Column, b: Column) -> Column:
    """``f(a, b)``, with both computed once for a row: a lambda's variables are values, which inner lambdas don't compute again."""
    return F.get(F.zip_with(F.array(a), F.array(b), f), F.lit(0))


def substitute(marked: Column, translations: Column, kind: str = "EPUB") -> Column:
    """``marked`` with each marker replaced by the translation of that index, or nothing.

    Values are inserted as they are: a value that looks like a marker or a back-reference is no pattern.
    """
    pattern = f"\x00{kind}_(\\d+)\x00"

    def put(marked: Column, translations: Column) -> Column:
        numbers = F.regexp_extract_all(marked, F.lit(pattern), F.lit(1))
        values = F.transform(numbers, lambda n: F.coalesce(F.get(translations, F.coalesce(n.try_cast("int"), F.lit(0))), F.lit("")))
        return interleave(F.split(marked, pattern, -1), values)

    return _once(put, marked, translations)


def restore_code(text: Column, codes: Column) -> Column:
    """Inline code for its numbered placeholders; an unknown number stays as it is."""
    pattern = r"`C(\d+)`"

    def put(text: Column, codes: Column) -> Column:
        whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        numbers = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        known = F.zip_with(whole, numbers, lambda w, n: F.coalesce(F.get(codes, F.coalesce(n.try_cast("int"), F.lit(-1))), w))
        return interleave(F.split(text, pattern, -1), known)

    return _once(put, text, codes)


def assemble(pages: DataFrame, translated: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Pages with their segments replaced; ``translated``: ``doc_id, seg_idx, translation``. A segment without one is left out."""
    joined = skeletons(pages, key, html).join(by_number(translated), "doc_id", "left")
    return joined.select("doc_id", substitute(F.col("marked"), F.coalesce("translations", F.array().cast("array<string>"))).alias("html"))
