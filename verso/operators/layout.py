"""Page layout: heading metrics, greedy wrapping and vertical placement."""

from __future__ import annotations

import math
import unicodedata
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verso.operators import spans as positioned
from verso.operators.folds import fold

#: Page and type sizes in points; by heading level: size, space before, space after.
PAGE_WIDTH, PAGE_HEIGHT, MARGIN, BASE, LINE = 595.28, 841.89, 72.0, 11.0, 15.4
HEADING_SIZE = {1: 20.0, 2: 17.0, 3: 14.0, 4: 12.0}
HEADING_BEFORE = {1: 24.0, 2: 20.0, 3: 16.0, 4: 12.0}
HEADING_AFTER = {1: 12.0, 2: 10.0, 3: 8.0}
OTHER_SIZE, OTHER_BEFORE, OTHER_AFTER = 11.0, 8.0, 6.0
WIDE, NARROW, SPACE = 0.95, 0.55, 0.3
ASCII_SPACE = " \t\n\x0c\r"
CODE_FONT = (9.0, 10.0)
#: Characters whose widths are summed together.
WRAPPED_AT_ONCE = 1 << 14
#: A page's foot above the margin; code: space before, space inside, indents of the text and of the bar.
FOOT, CODE_BEFORE, CODE_PAD, CODE_INDENT, BAR_INDENT = 30.0, 4.0, 2.0, 30.0, 18.0


def _lookup(level: Column, values: dict[int, float], other: float) -> Column:
    out = F.lit(other)
    for k, v in values.items():
        out = F.when(level == k, F.lit(v)).otherwise(out)
    return out


def heading_size(level: Column) -> Column:
    return _lookup(level, HEADING_SIZE, OTHER_SIZE)


def heading_before(level: Column) -> Column:
    return _lookup(level, HEADING_BEFORE, OTHER_BEFORE)


def heading_after(level: Column) -> Column:
    return _lookup(level, HEADING_AFTER, OTHER_AFTER)


def scaled_image(width: Column, height: Column) -> tuple[Column, Column]:
    """An image's size, no wider than the text."""
    room = PAGE_WIDTH - 2 * MARGIN
    factor = F.when(width > room, F.lit(room) / width).otherwise(F.lit(1.0))
    return width * factor, height * factor


def code_font(size: Column) -> Column:
    return F.least(F.greatest(size, F.lit(CODE_FONT[0])), F.lit(CODE_FONT[1]))


def italic_size() -> float:
    return max(8.0, BASE - 2)


#: Hundredths of the font size by ASCII code, and what all other characters have.
_WIDTHS = np.array([round(100 * (SPACE if chr(c) in ASCII_SPACE else NARROW)) for c in range(128)] + [round(100 * WIDE)])


def _line_end(text: str, start: int, size: float, area: float) -> int:
    used, end = 0.0, start
    while end < len(text):
        c = text[end]
        used += size * (WIDE if ord(c) > 0x7F else SPACE if c in ASCII_SPACE else NARROW)
        if used > area and end > start:
            break
        end += 1
    return end


def wrap(text: str, size: float, area: float) -> list[str]:
    """Lines of a text by summed character widths, at least one character each.

    What fits by the number of full-width characters, less two for safety, is one line. Ends are looked up in the
    sums of whole hundredths of the size; where rounding could decide, characters are added up one by one.
    """
    room, start, n = max(0, math.floor(area / size) - 2), 0, len(text)
    if n <= room:
        return [text] if text else []
    lines: list[str] = []
    # Sums are multiples of five hundredths; no line has more than ``most`` characters or, if not the last, fewer than ``room``.
    wide = 100 * area / size
    exact, most = abs(wide - 5 * round(wide / 5)) < 1e-3, int(max(wide, 0.0) / 30) + 2
    while n - start > room:
        # A long text needs no long list of sums.
        part = text[start : start + max(WRAPPED_AT_ONCE, 2 * most)]
        size_of_part, at = len(part), 0
        found = np.zeros(size_of_part + 1, np.int64)
        np.cumsum(_WIDTHS.take(np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32), mode="clip"), out=found[1:])
        sums = memoryview(found)
        stop = size_of_part - (room if start + size_of_part == n else most)
        while at < stop:
            if exact:
                end = _line_end(part, at, size, area)
            else:
                end = bisect_right(sums, sums[at] + wide, at + room, min(at + most, size_of_part) + 1) - 1
                if end <= at:
                    end = at + 1
            lines.append(part[at:end])
            at = end
        start += at
    if start < n:
        lines.append(text[start:])
    return lines


LAYOUT = "doc_id bigint, page_no int, line_no int, x double, y double, font string, size double, text string"


class Cursor:
    """Where the next line of a document goes: ``y`` is its base, from the page's foot."""

    def __init__(self, doc: int) -> None:
        self.doc, self.page, self.line, self.y = doc, 1, 0, PAGE_HEIGHT - MARGIN

    def room_for(self, height: float) -> None:
        """A new page if what is that high would reach into the foot."""
        if self.y - height < MARGIN + FOOT:
            self.page, self.line, self.y = self.page + 1, 0, PAGE_HEIGHT - MARGIN

    def place(self, x: float, y: float, font: str, size: float, text: str) -> tuple:
        self.line += 1
        return (self.doc, self.page, self.line - 1, x, y, font, size, text)

    def text(self, text: str, size: float, indent: float, font: str) -> list[tuple]:
        """A text's lines, narrowed and moved by ``indent``; a blank text is half a line of space."""
        text = text.strip()
        if not text:
            self.room_for(LINE / 2)
            self.y -= LINE / 2
        doc, x, lowest = self.doc, MARGIN + indent, MARGIN + FOOT
        page, number, y, rows = self.page, self.line, self.y, []
        for line in wrap(text, size, PAGE_WIDTH - 2 * MARGIN - indent):
            if line := line.rstrip():
                if y - LINE < lowest:
                    page, number, y = page + 1, 0, PAGE_HEIGHT - MARGIN
                rows.append((doc, page, number, x, y, font, size, line))
                number += 1
                y -= LINE
        self.page, self.line, self.y = page, number, y
        return rows

    def code(self, text: str, font_size: float) -> Iterator[tuple]:
        """A block of code: its lines as they are, kept together where a page can hold them, with a bar at their left."""
        size = min(max(font_size, CODE_FONT[0]), CODE_FONT[1])
        lines = [x.removesuffix("\r") for x in text.split("\n") if x.removesuffix("\r")]
        self.y -= CODE_BEFORE
        height = len(lines) * LINE + CODE_PAD
        self.room_for(height)
        yield self.place(MARGIN + BAR_INDENT, self.y - height + size, "bar", height, "")
        for line in lines:
            self.room_for(LINE)
            yield self.place(MARGIN + CODE_INDENT, self.y, "mono", size, line)
            self.y -= LINE
        self.y -= OTHER_AFTER

    def image(self, width: float, height: float) -> Iterator[tuple]:
        """An image, no wider than the text, with its top at the cursor."""
        factor = min(1.0, (PAGE_WIDTH - 2 * MARGIN) / width) if width else 1.0
        self.room_for(height * factor)
        yield self.place(MARGIN, self.y - height * factor, "image", height * factor, "")
        self.y -= height * factor + OTHER_AFTER


def _lay_out(elements: Iterable) -> Iterator[tuple]:
    """One document's elements, from top to bottom."""
    cursor = None
    for e in elements:
        cursor = cursor or Cursor(e.doc_id)
        if e.kind == "image":
            yield from cursor.image(e.width or 0.0, e.height or 0.0)
        elif e.kind == "code":
            yield from cursor.code(e.text, e.font_size)
        elif e.level is not None:
            cursor.y -= HEADING_BEFORE.get(e.level, OTHER_BEFORE)
            yield from cursor.text(e.text, HEADING_SIZE.get(e.level, OTHER_SIZE), max(e.indent, 0.0), "bold")
            cursor.y -= HEADING_AFTER.get(e.level, OTHER_AFTER)
        else:
            yield from cursor.text(e.text, italic_size() if e.is_italic else BASE, max(e.indent, 0.0), "italic" if e.is_italic else "body")
            cursor.y -= OTHER_AFTER


def lay_out(elements: DataFrame) -> DataFrame:
    """``LAYOUT`` of documents' elements in order (``page, place, kind, text, font_size, meta, width, height``).

    The cursor runs through the whole document, which is folded element by element in one task.
    """
    flat = elements.select(
        "doc_id",
        "page",
        "place",
        "kind",
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("font_size").cast("double"), F.lit(BASE)).alias("font_size"),
        F.col("meta.level").cast("int").alias("level"),
        F.coalesce(F.col("meta.indent").cast("double"), F.lit(0.0)).alias("indent"),
        F.coalesce("meta.is_italic", F.lit(False)).alias("is_italic"),
        F.col("width").cast("double").alias("width"),
        F.col("height").cast("double").alias("height"),
    )
    return fold(flat, ["doc_id"], ["page", "place"], LAYOUT, _lay_out)


class _Laid(NamedTuple):
    """What the layout reads of an element."""

    doc_id: int
    kind: str
    text: str
    font_size: float
    level: int | None
    indent: float
    is_italic: bool
    width: float | None
    height: float | None


def _laid(e: positioned.Element) -> _Laid:
    """An element as its row would be read: a text's level and indent as :func:`positioned.classify` has them."""
    font, least = e.font_size, e.min_x
    level = (1 if font > 18 else 2 if font > 16 else 3 if font > 14 else None) if e.kind == "text" and not e.is_monospace else None
    indent = float(np.float32(least - positioned.LEFT_MARGIN)) if least is not None and least < 9000 else 0.0
    return _Laid(e.doc_id, e.kind, e.text or "", BASE if font is None else font, level, indent, bool(e.is_italic), e.width, e.height)


def lay_out_pages(spans: DataFrame, images: DataFrame, thresholds: DataFrame | None = None) -> DataFrame:
    """:func:`lay_out` of :func:`positioned.page_elements` in one pass: texts are shuffled once and elements are no table between."""

    def work(parts: Iterable) -> Iterator[tuple]:
        return _lay_out(_laid(e) for _, e in positioned.elements_in_order(parts))

    return fold(positioned.page_parts(spans, images, thresholds), ["doc_id"], positioned.parts_order(), LAYOUT, work)


def display_width(text: str) -> int:
    """Columns of a terminal, for previews."""
    return sum(2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)
