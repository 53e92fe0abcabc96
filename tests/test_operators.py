"""Segmentation, batching, positioned text, Markdown, cache and history against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from verso.operators import batching, cache, history, html_segments, layout, markdown, spans


def pages(spark, *bodies):
    return spark.createDataFrame([(1, k, b) for k, b in enumerate(bodies)], "page_id bigint, sec int, html string")


@pytest.mark.parametrize(
    "body, expected",
    [
        ("<p>Use <code>x</code></p>", ["Use x"]),
        ("<pre><p>a</p></pre>", []),
        ("<li><pre>a</pre></li>", ["a"]),
        ("<li>a<p>b</p>c</li>", ["ab"]),
        ("<div>no</div><table><tr><td>1 &amp; 2</td></tr></table>", ["1 &amp; 2"]),
        ("<p>kept</p><p>lost", ["kept"]),
        ("<script>'</p>'</script><p> </p><p>x<!-- </p> -->y</p>", ["xy"]),
        ("", []),
    ],
)
def test_html_rules(spark, body, expected):
    df = pages(spark, body)
    assert [r.text for r in html_segments.segments(df).orderBy("seg_idx").collect()] == expected
    marked = html_segments.skeletons(df).collect()
    text = marked[0].marked if marked else ""
    assert text.count("\x00EPUB_") == len(expected)
    assert all(f"\x00EPUB_{k}\x00</" in text for k in range(len(expected)))


def test_sections_continue_numbers_and_substitution_is_literal(spark):
    df = pages(spark, "<p>a</p><p>b</p>", "<h1>c</h1>")
    rows = html_segments.skeletons(df, section="sec").orderBy("sec").collect()
    assert [(r.segment_start, r.segment_count) for r in rows] == [(0, 2), (2, 1)] and "\x00EPUB_2\x00" in rows[1].marked
    out = spark.createDataFrame([(rows[0].marked, ["$1 \\1 \x00EPUB_1\x00"])], "m string, t array<string>").select(html_segments.substitute(F.col("m"), F.col("t")).alias("h")).first().h
    assert out == "<p>$1 \\1 \x00EPUB_1\x00</p><p></p>"


def test_a_missing_translation_moves_no_other(spark):
    df = pages(spark, "<p>a</p><p> </p><p>b</p><li>c</li>")
    rows = spark.createDataFrame([(1, 0, "A"), (1, 2, "C"), (1, 2, "D")], "doc_id bigint, seg_idx int, translation string")
    assert html_segments.assemble(df, rows).first().html == "<p>A</p><p> </p><p></p><li>C</li>".replace("<p> </p>", "<p></p>")
    assert html_segments.assemble(df, rows.limit(0)).first().html == "<p></p><p></p><p></p><li></li>"


def test_batches_carry_their_own_part(spark):
    df = spark.createDataFrame([(1, ["x" * 4000, "y" * 4000, "z"]), (1, ["w"]), (2, [])], "doc_id bigint, texts array<string>")
    got = batching.plan_batches(df.withColumn("n", F.transform("texts", lambda t, i: i)), carry="n").select("doc_id", "batch_idx", "n").collect()
    assert sorted((r.doc_id, r.batch_idx, r.n) for r in got) == [(1, 0, [0]), (1, 0, [0]), (1, 1, [1, 2])]


def brute_plan(sizes):
    out, queue = [], []
    for lo in range(0, len(sizes), 100):
        queue.append((lo, min(lo + 100, len(sizes))))
    while queue:
        lo, hi = queue.pop(0)
        if hi - lo > 1 and sum(sizes[lo:hi]) > 6000:
            middle = lo + (hi - lo) // 2
            queue[:0] = [(lo, middle), (middle, hi)]
        else:
            out.append((lo, hi, sum(sizes[lo:hi])))
    return out


def test_batches(spark):
    rng = random.Random(1)
    cases = [[], [10], [7000], [60] * 100, [61] * 100, [1] * 101, [50] * 200, [2999, 3001], [3000, 3001], *[[rng.choice([0, 5, 900, 6500]) for _ in range(rng.randrange(250))] for _ in range(12)]]
    df = spark.createDataFrame([(k, ["é" * (s // 2) + "x" * (s % 2) for s in c]) for k, c in enumerate(cases)], "doc_id bigint, texts array<string>")
    rows = batching.plan_batches(df).orderBy("doc_id", "batch_idx").collect()
    for k, c in enumerate(cases):
        assert [(r.lo, r.hi, r.n_bytes) for r in rows if r.doc_id == k] == brute_plan(c)
    plan = batching.plan_batches(df)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_work_and_gaps(spark):
    df = spark.createDataFrame([(1, 0, "a", None, False), (1, 1, "b", "", False), (1, 2, "c", None, True), (2, 0, "d", None, None)], "doc_id bigint, seg_idx int, text string, translation string, keep_original boolean")
    assert [(r.doc_id, r.seg_idx) for r in batching.select_work(df).orderBy("doc_id").collect()] == [(1, 0), (2, 0)]
    rows = batching.completeness(batching.keep_originals(df)).orderBy("doc_id").collect()
    assert (rows[0].first_missing, rows[0].n_translated, rows[0].complete) == (0, 2, False)


def test_history_sizes(spark):
    n, rows = 0, {}
    for k in range(1, 2500):
        n = n + 1 if n + 1 <= 1000 else n + 1 - 100
        rows[k] = n
    df = spark.createDataFrame(list(rows.items()), "n bigint, kept bigint")
    assert df.filter(history.retained_count(F.col("n")) != F.col("kept")).count() == 0
    assert history.retained(spark.range(1, 1206).withColumnRenamed("id", "seq")).agg(F.count("*"), F.min("seq")).first() == (rows[1205], 1206 - rows[1205])


def test_cache(spark):
    c = spark.createDataFrame([("a", "A", 1, 1), ("b", "B", 0, 1)], "source_hash string, translated_text string, status int, updated_at int")
    r = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "source_hash string")
    assert sorted((x.source_hash, x.hit) for x in cache.probe(r, c).collect()) == [("a", True), ("b", False), ("c", False), ("c", False)]
    assert sorted(x.source_hash for x in cache.misses(r, c).collect()) == ["b", "c"]
    up = cache.upsert(c, spark.createDataFrame([("a", "A2", 1, 2), ("d", "D", 1, 1)], c.schema))
    assert {x.source_hash: x.translated_text for x in up.collect()} == {"a": "A2", "b": "B", "d": "D"} and up.columns == c.columns
    assert cache.stats(c, cache.probe(r, c)).first() == (2, 0.25) and cache.stats(c.limit(0), cache.probe(r.limit(0), c)).first() == (0, 0.0)
    keys = spark.createDataFrame([("ab", "c"), ("a", "bc")], "x string, y string").select(cache.cache_key(F.col("x"), F.col("y"), F.lit("t"), F.lit("m"), F.lit(None).cast("string")).alias("k")).collect()
    assert keys[0].k != keys[1].k


SPANS = "doc_id bigint, page int, span_idx int, text string, x float, y float, font_size float, is_monospace boolean, is_italic boolean"


def span(k, text, y, size=11.0, mono=False, x=72.0, page=0, doc=1):
    return (doc, page, k, text, float(x), float(y), float(size), mono, False)


def test_thresholds(spark):
    rows = [span(k, "t", 800 - 14.0 * k) for k in range(5)] + [span(5, "t", 700.0), span(6, "t", 660.0), span(7, " ", 640.0)]
    rows += [span(0, "only", 10.0, doc=2), *[span(k, "s", 500 - 12.0 * k, doc=3) for k in range(3)]]
    got = {r.doc_id: r.threshold for r in spans.paragraph_thresholds(spark.createDataFrame(rows, SPANS)).collect()}
    assert got == {1: pytest.approx((14 + 40) / 2), 2: 25.0, 3: 18.0}


def test_groups_and_code(spark):
    rows = [span(0, "Title", 780, 20), span(1, "one", 740), span(2, "two", 728), span(3, "far.", 640), span(4, "x = 1", 628, 9, True), span(5, "y = 2", 618, 10, True), span(6, "after", 600), span(7, "Figure 1", 590), span(8, " ", 580)]
    df = spark.createDataFrame(rows, SPANS)
    limit = spark.createDataFrame([(1, 20.0)], "doc_id bigint, threshold double")
    got = [(r.text, r.meta.kind, r.meta.level) for r in spans.group_spans(df, limit).orderBy(F.desc("start_y"), "island", "group").collect()]
    assert got == [("Title", "heading", 1), ("one two", "paragraph", None), ("far.", "paragraph", None), ("after Figure 1", "paragraph", None)]
    code = spans.code_blocks(df).collect()
    assert [(c.text, c.font_size, c.start_y) for c in code] == [("x = 1\ny = 2", 10.0, 628.0)]


def test_captions_follow_their_image(spark):
    rows = [span(0, "Figure 1", 500), span(1, "x", 300)]
    images = spark.createDataFrame([(1, 0, 0, 450.0, 600.0, 300.0, None), (1, 0, 1, 550.0, 10.0, 10.0, None), (1, 0, 2, 100.0, 10.0, 10.0, None)], "doc_id bigint, page int, img_idx int, y float, width float, height float, data binary")
    limit = spark.createDataFrame([(1, 50.0)], "doc_id bigint, threshold double")
    got = [(r.kind, r.text or r.img_idx) for r in spans.page_elements(spark.createDataFrame(rows, SPANS), images, limit).orderBy("place").collect()]
    # Both images are 50 points away; the earlier one is above, so nothing moves.
    assert got == [("image", 1), ("text", "Figure 1"), ("text", "x"), ("image", 0), ("image", 2)]  # an island has one height
    got = [(r.kind, r.text or r.img_idx) for r in spans.page_elements(spark.createDataFrame(rows, SPANS), images.filter("img_idx <> 1"), limit).orderBy("place").collect()]
    assert got[:3] == [("text", "x"), ("image", 0), ("text", "Figure 1")]


def test_wrap_and_layout(spark):
    assert layout.wrap("abc d", 11, 451) == ["abc d"] and layout.wrap("é" * 3, 300, 100) == ["é", "é", "é"] and layout.wrap("", 11, 451) == []
    text = "word " * 200
    lines = layout.wrap(text, 11, 451.28)
    assert "".join(lines).replace(" ", "") == text.replace(" ", "") and all(lines)
    rows = [span(k, f"line {k}.", 780 - 30.0 * k, page=p) for p in range(4) for k in range(20)]
    df = spark.createDataFrame(rows, SPANS)
    images = spark.createDataFrame([], "doc_id bigint, page int, img_idx int, y float, width float, height float, data binary")
    limit = spark.createDataFrame([(1, 20.0)], "doc_id bigint, threshold double")
    out = layout.lay_out(spans.page_elements(df, images, limit)).collect()
    assert [r.text for r in sorted(out, key=lambda r: (r.page_no, r.line_no))] == [f"line {k}." for _ in range(4) for k in range(20)]
    assert max(r.page_no for r in out) > 1 and min(r.y for r in out) >= layout.MARGIN


def brute_layout(elements):
    """Lines and where they stand, element by element, written down from the page rules."""
    page, y, out = 1, 841.89 - 72, []
    for kind, text, level, indent, italic, size, width, height in elements:
        def put(x, at, what):
            out.append((page, round(x, 3), round(at, 3), what))

        def turn(need):
            nonlocal page, y
            if y - need < 102:
                page, y = page + 1, 841.89 - 72

        if kind == "image":
            f = min(1, 451.28 / width)
            turn(height * f)
            put(72, y - height * f, "")
            y -= height * f + 6
        elif kind == "code":
            lines = [x for x in text.split("\n") if x]
            y -= 4
            turn(len(lines) * 15.4 + 2)
            put(90, y - (len(lines) * 15.4 + 2) + min(max(size, 9), 10), "")
            for x in lines:
                turn(15.4)
                put(102, y, x)
                y -= 15.4
            y -= 6
        else:
            s = {1: 20, 2: 17, 3: 14, 4: 12}.get(level, 11) if level else 9 if italic else 11
            y -= {1: 24, 2: 20, 3: 16, 4: 12}.get(level, 8) if level else 0
            area, rest = 451.28 - max(indent, 0), text.strip()
            if not rest:
                turn(7.7)
                y -= 7.7
            while rest:
                n = len(rest)
                if n > max(0, int(area / s) - 2):
                    n = 1
                    widths = [s * (0.95 if ord(c) > 127 else 0.3 if c in " \t\n\r" else 0.55) for c in rest]
                    while n < len(rest) and sum(widths[: n + 1]) <= area:
                        n += 1
                if rest[:n].rstrip():
                    turn(15.4)
                    put(72 + max(indent, 0), y, rest[:n].rstrip())
                    y -= 15.4
                rest = rest[n:]
            y -= {1: 12, 2: 10, 3: 8}.get(level, 6) if level else 6
    return out


def test_layout_equals_brute_force(spark):
    rng = random.Random(12)
    docs, rows = {}, []
    for doc in range(6):
        elements = []
        for place in range(60):
            kind = rng.choice(["text", "text", "text", "code", "image"])
            text = rng.choice(["", " ", "x", "word " * rng.randrange(1, 120), "字" * rng.randrange(1, 90), "a b\n\n  c\n" * rng.randrange(1, 30)])
            level, indent = rng.choice([None, None, 1, 2, 3, 4, 5]), rng.choice([0.0, 18.0, 36.0, -5.0])
            e = (kind, text, level if kind == "text" else None, indent, rng.random() < 0.3, rng.choice([7.0, 9.5, 14.0]), rng.choice([100.0, 451.28, 900.0]), rng.choice([50.0, 400.0]))
            elements.append(e)
            meta = None if kind != "text" else ("x", e[2], False, e[5], False, indent, e[4])
            rows.append((doc, place // 7, place % 7, kind, text, e[5], meta, e[6] if kind == "image" else None, e[7] if kind == "image" else None))
        docs[doc] = elements
    schema = "doc_id bigint, page int, place int, kind string, text string, font_size float, meta struct<kind:string,level:tinyint,keep_original:boolean,font_size:float,is_monospace:boolean,indent:float,is_italic:boolean>, width double, height double"
    out = layout.lay_out(spark.createDataFrame(rows, schema)).collect()
    for doc, elements in docs.items():
        mine = sorted((r for r in out if r.doc_id == doc), key=lambda r: (r.page_no, r.line_no))
        assert [(r.page_no, round(r.x, 3), round(r.y, 3), r.text) for r in mine] == brute_layout(elements)


def brute_groups(rows, limit):
    """Texts of a page's groups, where all spans are one island."""
    out, parts, font, last = [], [], 0.0, None
    for text, y, size in rows:
        so_far = "".join(parts).strip()
        if last is not None and ((y > last and (y - last > 1000 or so_far[-1:] in (".", "!", "?"))) or (y <= last and (last - y > limit or (abs(size - font) > 4 and so_far)))):
            out.append(so_far)
            parts, font = [], 0.0
        parts += [" ", text] if parts else [text]
        font, last = max(font, size), y
    return [t for t in [*out, "".join(parts).strip()] if t]


def test_groups_equal_brute_force(spark):
    rng = random.Random(13)
    data, rows = {}, []
    for page in range(30):
        y, lines = 780.0, []
        for k in range(rng.randrange(1, 30)):
            y -= rng.choice([0.0, 12.0, 14.0, 14.0, 30.0])
            lines.append((rng.choice(["one", "two.", " ", "three!"]), y, rng.choice([9.0, 11.0, 11.0, 16.0])))
            rows.append(span(k, lines[-1][0], lines[-1][1], lines[-1][2], page=page))
        data[page] = [x for x in lines if x[0].strip()]
    limit = spark.createDataFrame([(1, 20.0)], "doc_id bigint, threshold double")
    got = {}
    for r in spans.group_spans(spark.createDataFrame(rows, SPANS), limit).orderBy("page", "island", "group").collect():
        got.setdefault(r.page, []).append(r.text)
    assert got == {p: g for p, lines in data.items() if (g := brute_groups(lines, 20.0))}


MARKDOWN = """---
title: x
---
# Head *em* text

Hello **world** foo `code` <b>x</b>
second line with [link](http://a "t") and ![alt](i.png)

- a
  - b
1. one
2. [ ] two[^1]

> quote
> more

| h1 | h2 |
|----|----|
| a | b |

| c |
|---|

```py
x = 1
```

    indented

<div>
raw
</div>

[^1]: note
"""


def test_markdown(spark):
    segments, marked, codes = markdown.scan(MARKDOWN)
    assert segments == ["Head", "em", "text", "Hello", "world", "foo `C0` `C1`x`C2`", "second line with", "link", "and", "a", "b", "one", "two", "quote", "more", "h1", "h2", "a", "b", "c", "note"]
    assert codes == ["`code`", "<b>", "</b>"]
    assert [f"\x00MD_{k}\x00" in marked for k in range(len(segments))] == [True] * len(segments) and marked.count("\x00MD_") == len(segments)
    for raw in ("title: x\n", "```py\nx = 1\n```\n", "    indented\n", "<div>\nraw\n</div>\n", "![alt](i.png)", "](http://a)"):
        assert raw in marked
    docs = spark.createDataFrame([(1, MARKDOWN), (2, None), (3, ""), (4, "plain"), (5, "```\nopen")], "doc_id bigint, text string")
    out = markdown.scan_documents(docs)
    same = {r.doc_id: r.t for r in out.select("doc_id", markdown.render(F.col("marked"), F.col("segments"), F.col("segments"), F.col("code_spans")).alias("t")).collect()}
    assert same[2] == same[3] == "" and same[4] == "plain" and same[5] == "```\nopen\n```"
    assert "\x00" not in same[1] and "`C" not in same[1] and "`code` <b>x</b>" in same[1]
    again = markdown.scan(same[1])
    assert again[0] == segments


def test_markdown_random_keeps_every_word():
    rng = random.Random(2)
    pieces = ["word ", "**b** ", "`c` ", "\n", "\n\n", "# h\n", "- i\n", "> q\n", "| a | b |\n|---|---|\n", "1. n\n", "~~s~~", "[l](u)", "  \n", "```\n", "<i>", "_e_", "\\*", "*", "[^n]"]
    for _ in range(400):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(25)))
        segments, marked, codes = markdown.scan(text)
        assert marked.count("\x00MD_") == len(segments)
        words = sum(s.count("word") for s in segments) + marked.count("word")
        assert words == text.count("word")
