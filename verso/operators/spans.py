"""Positioned text: line gaps, code islands, grouping into segments, headings and captions.

``spans``: doc_id, page, span_idx, text, x, y, font_size, is_monospace, is_italic; ``images``: doc_id, page,
img_idx, y, width, height, data. Thresholds are 32-bit floats, as in the positions themselves.
"""

from __future__ import annotations


from collections.abc import Iterable, Iterator
from itertools import chain, groupby
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verso.functions.text import is_blank
from verso.operators.folds import fold

DEFAULT_THRESHOLD, LEAST_THRESHOLD, PARAGRAPH_FACTOR = 25.0, 18.0, 1.8
LEFT_MARGIN, CAPTION_REACH = 72.0, 100.0
SENTENCE_ENDS = (".", "!", "?", "。", "！", "？")


def line_gaps(spans: DataFrame) -> DataFrame:
    """``doc_id, page, span_idx, gap`` of every span: from the one before it, if neither is blank and 1 < gap < 200; else null.

    No text goes through the shuffle, which is by document.
    """
    order = Window.partitionBy("doc_id", "page").orderBy("span_idx")
    slim = spans.select("doc_id", "page", "span_idx", "y", (~is_blank(F.col("text"))).alias("full")).repartition("doc_id")
    gaps = slim.select("doc_id", "page", "span_idx", (F.lag("y").over(order) - F.col("y")).alias("gap"), (F.col("full") & F.lag("full").over(order)).alias("both"))
    return gaps.withColumn("gap", F.when(F.expr("both and gap > 1 and gap < 200"), F.col("gap"))).drop("both")


def paragraph_thresholds(spans: DataFrame) -> DataFrame:
    """``doc_id, threshold``: between the two commonest line gaps (at tenths of a point), 18 at least.

    Of gaps that are equally common the smaller counts first. Documents without gaps get 25.
    """
    counts = line_gaps(spans).groupBy("doc_id", F.round(F.col("gap") * F.lit(10.0).cast("float")).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    # A document has at most 2000 bins.
    ranked = counts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("bin").isNotNull(), F.struct((-F.col("n")).alias("n"), "bin")))).alias("ranked"))
    tops = ranked.select("doc_id", F.get("ranked", F.lit(0))["bin"].alias("a"), F.get("ranked", F.lit(1))["bin"].alias("b"))
    line = F.col("a") / 10.0
    middle = (line + F.coalesce(F.col("b") / 10.0, line * PARAGRAPH_FACTOR)) / 2.0
    return tops.select("doc_id", F.when(F.col("a").isNull(), DEFAULT_THRESHOLD).otherwise(F.greatest(middle, F.lit(LEAST_THRESHOLD))).alias("threshold"))


def reading_order(spans: DataFrame) -> DataFrame:
    """``ord``: place on the page from top to bottom; missing places last."""
    top = F.when(F.isnan("y"), None).otherwise(F.col("y"))
    order = Window.partitionBy("doc_id", "page").orderBy(F.desc_nulls_last(top), "span_idx")
    return spans.withColumn("ord", F.row_number().over(order) - 1)


def islands(spans: DataFrame) -> DataFrame:
    """Non-blank spans in reading order with ``island``, counted up at each change between code and text."""
    ordered = reading_order(spans.filter(~is_blank(F.col("text"))))
    order = Window.partitionBy("doc_id", "page").orderBy("ord")
    change = F.coalesce((F.col("is_monospace") != F.lag("is_monospace").over(order)).cast("int"), F.lit(0))
    return ordered.withColumn("change", change).withColumn("island", F.sum("change").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("change")


def code_blocks(spans: DataFrame) -> DataFrame:
    """``doc_id, page, island, start_y, text, font_size, n_lines`` of each code island: its lines, the last line's font."""
    lines = F.array_sort(F.collect_list(F.struct("ord", "text", "font_size", "y")))
    grouped = islands(spans).filter("is_monospace").groupBy("doc_id", "page", "island").agg(lines.alias("lines"))
    return grouped.select(
        "doc_id",
        "page",
        "island",
        F.get("lines", F.lit(0))["y"].alias("start_y"),
        F.array_join(F.transform("lines", lambda s: s["text"]), "\n").alias("text"),
        F.get("lines", F.size("lines") - 1)["font_size"].alias("font_size"),
        F.size("lines").alias("n_lines"),
    )


def heading_level(font_size: Column) -> Column:
    """1 to 3 by font size, null for body text."""
    return F.when(font_size > 18, 1).when(font_size > 16, 2).when(font_size > 14, 3).cast("tinyint")


def classify(text: Column, font_size: Column, is_monospace: Column, min_x: Column, is_italic: Column) -> Column:
    """``struct<text, meta>`` of a group."""
    level = F.when(~is_monospace, heading_level(font_size))
    kind = F.when(is_monospace, "code").when(level.isNotNull(), "heading").otherwise("paragraph")
    indent = F.when(min_x < 9000, min_x - LEFT_MARGIN)
    meta = F.struct(kind.alias("kind"), level.alias("level"), is_monospace.alias("keep_original"), font_size.alias("font_size"), is_monospace.alias("is_monospace"), indent.cast("float").alias("indent"), is_italic.alias("is_italic"))
    return F.struct(text.alias("text"), meta.alias("meta"))


GROUPS = "doc_id bigint, page int, island int, group int, start_y float, text string, font_size float, min_x float, is_monospace boolean, is_italic boolean"


def _groups(spans: Iterable, threshold: float) -> Iterator[tuple]:
    """``number, text, font_size, min_x, is_monospace, is_italic`` of the groups of one island.

    A break depends on the largest font of the group so far: a fold, no window. A span below the one before it
    (or level with it) begins a group where the gap is a paragraph's or the font jumps; one above it, where it is
    far above or the text so far ends a sentence.
    """
    number, last = 0, None
    parts: list[str] = []
    font = least = 0.0
    mono = italic = False

    def closed() -> list[tuple]:
        text = "".join(parts).strip()
        return [(number, text, font, least, mono, italic)] if text else []

    for s in spans:
        if last is not None:
            rise = s.y - last.y
            if rise > 0:
                breaks = rise > 1000 or "".join(parts).rstrip().endswith(SENTENCE_ENDS)
            else:
                breaks = -rise > threshold or (abs(s.font_size - font) > 4 and any(map(str.strip, parts)))
            if breaks:
                yield from closed()
                number, parts = number + 1, []
        if not parts:
            font, least, mono, italic = 0.0, 9999.0, False, False
        elif not s.is_monospace:
            parts.append(" ")
        parts.append(s.text)
        font, least, mono, italic = max(font, s.font_size), min(least, s.x), mono or s.is_monospace, italic or s.is_italic
        last = s
    yield from closed()


def _fold_page(spans: Iterable) -> Iterator[tuple]:
    """``GROUPS`` of one island of a page; all have its height."""
    spans = iter(spans)
    first = next(spans)
    for number, text, *rest in _groups(chain([first], spans), first.threshold):
        yield (first.doc_id, first.page, first.island, number, first.y, text, *rest)


def group_spans(spans: DataFrame, thresholds: DataFrame | None = None) -> DataFrame:
    """Text groups of every page, classified: ``GROUPS`` and ``meta``. An island of a page is the unit of work."""
    source = islands(spans).filter(~F.col("is_monospace"))
    joined = source.join(thresholds if thresholds is not None else paragraph_thresholds(spans), "doc_id")
    needed = joined.select("doc_id", "page", F.col("island").cast("int").alias("island"), "ord", "text", "x", "y", "font_size", F.col("threshold").cast("double").alias("threshold"), "is_monospace", "is_italic")
    grouped = fold(needed, ["doc_id", "page", "island"], ["ord"], GROUPS, _fold_page)
    return grouped.withColumn("meta", classify(F.col("text"), F.col("font_size"), F.col("is_monospace"), F.col("min_x"), F.col("is_italic"))["meta"])


def simple_groups(spans: DataFrame, reach: float = 4.0) -> DataFrame:
    """``doc_id, page, grp, text``: runs of spans at most ``reach`` apart in height, joined without separator."""
    order = Window.partitionBy("doc_id", "page").orderBy("span_idx")
    fresh = (F.abs(F.col("y") - F.lag("y").over(order)) > reach).cast("int")
    marked = spans.withColumn("fresh", F.coalesce(fresh, F.lit(0))).withColumn("grp", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("span_idx", "text"))), lambda s: s["text"])
    return marked.groupBy("doc_id", "page", "grp").agg(F.array_join(pieces, "").alias("text"))


PLACED = "doc_id bigint, page int, place int, kind string, text string, font_size float, min_x float, is_monospace boolean, is_italic boolean, img_idx int, width double, height double, seg_idx int"


class Element(NamedTuple):
    """A text, code or image of a page; ``y`` is its height and ``seq`` its order among equal ones."""

    doc_id: int | None
    page: int | None
    y: float | None
    seq: int
    kind: str
    text: str | None = None
    font_size: float | None = None
    min_x: float | None = None
    is_monospace: bool | None = None
    is_italic: bool | None = None
    img_idx: int | None = None
    width: float | None = None
    height: float | None = None
    seg_idx: int | None = None


def page_parts(spans: DataFrame, images: DataFrame, thresholds: DataFrame | None = None) -> DataFrame:
    """What :func:`elements_in_order` reads of documents: their thresholds, non-blank spans and images.

    One row each, so that one shuffle by document takes all of them.
    """
    limits = (thresholds if thresholds is not None else paragraph_thresholds(spans)).select("doc_id", F.lit(0).alias("what"), F.col("threshold").cast("double").alias("threshold"))
    top = F.when(~F.isnan("y"), F.col("y"))
    texts = spans.filter(~is_blank(F.col("text"))).select("doc_id", "page", F.lit(1).alias("what"), top.alias("top"), F.col("span_idx").cast("long").alias("idx"), "y", "text", "x", "font_size", "is_monospace", "is_italic")
    pictures = images.select("doc_id", "page", F.lit(2).alias("what"), F.col("img_idx").cast("long").alias("idx"), F.col("y").cast("float").alias("y"), F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height"))
    return texts.unionByName(limits, allowMissingColumns=True).unionByName(pictures, allowMissingColumns=True)


def parts_order() -> list:
    """A document's :func:`page_parts` in order: its threshold, then page after page the spans from top to bottom and the images."""
    return [F.asc_nulls_first("page"), "what", F.desc_nulls_last("top"), "idx"]


def _by_height(y: float | None, then: int) -> tuple:
    """From top to bottom; missing heights last."""
    return (2, 0.0, then) if y is None else (0, 0.0, then) if y != y else (1, -y, then)


def _islands(spans: Iterable) -> Iterator[list]:
    """Runs of spans of a page, cut at each change between code and text."""
    island: list = []
    for s in spans:
        if island and None not in (island[-1].is_monospace, s.is_monospace) and island[-1].is_monospace != s.is_monospace:
            yield island
            island = []
        island.append(s)
    if island:
        yield island


def elements_in_order(parts: Iterable) -> Iterator[tuple[int, Element]]:
    """Each page's elements of one document's :func:`page_parts` with their place; a page is held at a time."""
    threshold, segment = None, 0
    for page, rows in groupby(parts, key=lambda r: r.page):
        lines, found = [], []
        for r in rows:
            if r.what == 0:
                threshold = r.threshold
            elif r.what == 1:
                lines.append(r)
            else:
                found.append(Element(r.doc_id, page, r.y, (1 << 60) + r.idx, "image", img_idx=r.idx, width=r.width, height=r.height))
        for k, island in enumerate(_islands(lines)):
            code = [s for s in island if s.is_monospace]
            if code:
                found.append(Element(code[0].doc_id, page, code[0].y, k * 1000000, "code", "\n".join([s.text for s in code]), code[-1].font_size))
            texts = [s for s in island if s.is_monospace is False]
            if texts and threshold is not None:
                for number, *rest in _groups(texts, threshold):
                    found.append(Element(texts[0].doc_id, page, texts[0].y, k * 1000000 + number, "text", *rest, seg_idx=segment))
                    segment += 1
        found.sort(key=lambda e: _by_height(e.y, e.seq))
        yield from enumerate(_captions_moved(found))


def _captions_moved(found: list[Element]) -> list[Element]:
    """Captions that stand before the nearest image in reach go behind it."""
    images = [(k, e.y) for k, e in enumerate(found) if e.kind == "image" and e.y is not None]
    keys = []
    for k, e in enumerate(found):
        target = k
        if images and e.kind == "text" and e.y is not None and (e.text.startswith("图") or "Figure" in e.text):
            far = [(abs(np.float32(y) - np.float32(e.y)), at) for at, y in images]
            target = max(k, min((x for x in far if x[0] < CAPTION_REACH), default=(0, k))[1])
        keys.append((target, target != k, k))
    return [found[k] for _, _, k in sorted(keys)]


def page_elements(spans: DataFrame, images: DataFrame, thresholds: DataFrame | None = None) -> DataFrame:
    """Text, code and images of every page in reading order, captions after the image that they belong to.

    ``doc_id, page, place, kind, text, font_size, meta, img_idx, width, height, seg_idx``; ``seg_idx`` numbers a
    document's texts by page, island and group, for their translations. A caption (its text starts
    with the sign for figure or has the word) goes behind the nearest image within 100 points if it stands
    before it; of equally near images the earlier counts.
    """

    def work(parts: Iterable) -> Iterator[tuple]:
        for place, e in elements_in_order(parts):
            yield (e.doc_id, e.page, place, *e[4:])

    placed = fold(page_parts(spans, images, thresholds), ["doc_id"], parts_order(), PLACED, work)
    meta = F.when(F.col("kind") == "text", classify(F.col("text"), F.col("font_size"), F.col("is_monospace"), F.col("min_x"), F.col("is_italic"))["meta"])
    return placed.select("doc_id", "page", "place", "kind", "text", "font_size", meta.alias("meta"), "img_idx", "width", "height", "seg_idx")


def synthetic_spans(docs: DataFrame) -> DataFrame:
    """Spans laid out from documents' lines: forty lines to a page, 14 points apart, fonts by a hash."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("i", "text"))
    h = F.conv(F.substring(F.md5("text"), 1, 4), 16, 10).cast("int")
    return lines.select(
        "doc_id",
        F.floor(F.col("i") / 40).cast("int").alias("page"),
        (F.col("i") % 40).cast("int").alias("span_idx"),
        "text",
        (F.lit(72.0) + h % 3 * 18).cast("float").alias("x"),
        (F.lit(780.0) - (F.col("i") % 40) * 14 - F.when(F.col("i") % 5 == 4, 7).otherwise(0)).cast("float").alias("y"),
        (F.lit(9.0) + h % 12).cast("float").alias("font_size"),
        (h % 7 == 0).alias("is_monospace"),
        (h % 11 == 0).alias("is_italic"),
    )
