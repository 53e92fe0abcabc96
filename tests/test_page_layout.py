"""Layout in one pass against the two steps that it joins, and wrapping against adding up."""

import random

import pytest
from pyspark.sql import functions as F

from verso.operators import layout, spans

SPANS = "doc_id bigint, page int, span_idx int, text string, x float, y float, font_size float, is_monospace boolean, is_italic boolean"
IMAGES = "doc_id bigint, page int, img_idx int, y float, width float, height float, data binary"


def pages(spark):
    rng = random.Random(3)
    rows, images = [], []
    for doc in range(8):
        for page in range(rng.randrange(1, 5)):
            for k in range(rng.randrange(25)):
                text = rng.choice(["one", "two. ", " ", "", "Figure 3", "图 1", "word " * rng.randrange(200), "字" * rng.randrange(1, 150)])
                rows.append((doc, page, k, text, rng.choice([72.0, 90.5, 108.0]), rng.choice([780.0 - 14 * k, 780.0 - 14 * k, 500.0, float("nan")]) if doc else 780.0 - 14 * k, rng.choice([9.0, 11.0, 15.0, 17.5, 20.0]), rng.random() < 0.2, rng.random() < 0.2))
            images += [(doc, page, k, rng.choice([700.0, 610.5, 450.0]), rng.choice([100.0, 900.0]), 120.0, None) for k in range(rng.randrange(4))]
    images.append((99, 0, 0, 500.0, 10.0, 10.0, None))
    return spark.createDataFrame(rows, SPANS), spark.createDataFrame(images, IMAGES)


def test_one_pass_gives_what_the_steps_give(spark):
    found, images = pages(spark)
    steps = layout.lay_out(spans.page_elements(found, images))
    one = layout.lay_out_pages(found, images)
    assert sorted(map(repr, one.collect())) == sorted(map(repr, steps.collect())) and one.schema == steps.schema
    plan = one._jdf.queryExecution().toString().split("== Initial Plan ==")[-1]
    # One for the texts, one for the gaps, which carry none.
    assert plan.count("Exchange hashpartitioning") == 2 and "Window" in plan and plan.count("MapInArrow") == 1


def test_elements_are_groups_code_and_images(spark):
    found, images = pages(spark)
    elements = spans.page_elements(found, images)
    texts = spans.group_spans(found).select("doc_id", "page", "text", "font_size", "meta")
    assert sorted(map(repr, elements.filter("kind = 'text'").select(texts.columns).collect())) == sorted(map(repr, texts.collect()))
    code = spans.code_blocks(found).select("doc_id", "page", "text", "font_size")
    assert sorted(map(repr, elements.filter("kind = 'code'").select(code.columns).collect())) == sorted(map(repr, code.collect()))
    assert elements.filter("kind = 'image'").count() == images.count()
    numbers = elements.filter("kind = 'text'").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("seg_idx"), F.max("seg_idx"), F.count_distinct("seg_idx")).collect()
    assert all(tuple(r)[2:] == (0, r.n - 1, r.n) for r in numbers)


def added_up(text, size, area):
    lines, room, start = [], max(0, int(area // size) - 2), 0
    while len(text) - start > room:
        used, end = 0.0, start
        while end < len(text):
            c = text[end]
            used += size * (layout.WIDE if ord(c) > 0x7F else layout.SPACE if c in layout.ASCII_SPACE else layout.NARROW)
            if used > area and end > start:
                break
            end += 1
        lines.append(text[start:end])
        start = end
    return lines + [text[start:]] * (start < len(text))


@pytest.mark.parametrize("at_once", [1, 50, 1 << 14])
def test_wrap_equals_adding_up(monkeypatch, at_once):
    monkeypatch.setattr(layout, "WRAPPED_AT_ONCE", at_once)
    rng = random.Random(7)
    for _ in range(300):
        text = "".join(rng.choice(["word", " ", "é", "字", "😀", "\n", "x"]) for _ in range(rng.randrange(400)))
        # Sizes and areas of which many sums are exactly the area, or nearly.
        size, area = rng.choice([9.0, 10.0, 11.0, 14.0, 20.0, 20.0]), rng.choice([451.28, 433.28, 440.0, 55.0, 19.0, 5.0, 0.0, -3.0, 110.0])
        assert layout.wrap(text, size, area) == added_up(text, size, area)
