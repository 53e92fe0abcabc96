"""Line chunks and sentence spans against brute force."""

import hashlib
import random
import re

from verso.llm import line_dedup, span_dedup

from .helpers import empty_docs, hard_docs


def line_chunks(text):
    lines = text.split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    n = len(lines)
    rolled = [((h[max(i - 1, 0)] * 31 + h[i]) % 2147483647 * 1103515245 + 12345) % 2147483647 for i in range(n)]
    out, at = [], 0
    for i in range(n):
        if i == n - 1 or (0 < i < n - 2 and rolled[i] < rolled[i - 1] and rolled[i] <= rolled[i + 1]):
            out.append(lines[at : i + 1])
            at = i + 1
    assert n < 2 or min(map(len, out)) > 1
    return out


def brute_lines(rows):
    first = {}
    for i, t in rows:
        for c in line_chunks(t or ""):
            c = "\n".join(c)
            old = first.get(c, i)
            first[c] = i if old is None else old if i is None else min(i, old)
    out = []
    for i, t in rows:
        kept, seen = [], set()
        for c in line_chunks(t or ""):
            s = "\n".join(c)
            if len(c) < 2 or not re.search(r"[^\x20\x09-\x0d]", s) or (first[s] in (i, None) and s not in seen):
                kept.append(s)
            seen.add(s)
        out.append((i, None if t is None else "\n".join(kept)))
    return sorted(out, key=str)


def line_corpus():
    rng = random.Random(3)
    pool = [[f"line {k} {j}" for j in range(rng.randrange(2, 9))] for k in range(12)]
    rows = []
    for i in range(60):
        parts = [x for _ in range(rng.randrange(4)) for x in (rng.choice(pool) if rng.random() < 0.6 else [f"own {rng.random()}" for _ in range(3)])]
        rows.append((i, "\n".join(parts)))
    return rows + [(7, rows[7][1]), (None, rows[9][1]), (None, "null only a\nnull only b\nnull only c"), (None, "null only a\nnull only b\nnull only c")]


def test_line_chunks_equal_brute_force(spark):
    rows = line_corpus()
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id bigint, text string, name string, chunk_parts int")
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == brute_lines(rows)
    assert sum(len(t or "") for _, t in got) < sum(len(t or "") for _, t in rows)


def test_copies_and_long_blocks_go(spark):
    """Of whole copies nothing stays, of a long block that other lines surround all but its edges goes."""
    rng = random.Random(8)
    line = lambda: f"line {rng.random()}"
    block = [line() for _ in range(40)]
    rows = [(0, "\n".join(block)), (1, "\n".join(block)), (2, "\n".join([*[line() for _ in range(7)], *block, *[line() for _ in range(5)]])), (3, "a\nb"), (4, "a\nb"), (5, "a\nb\nc"), (6, "a\nb\nc")]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), report=True).collect()}
    assert got[0].n_removed == got[3].n_removed == got[5].n_removed == 0
    assert got[1].n_removed == 40 and got[4].n_removed == 2 and got[6].n_removed == 3 and got[1].text == ""
    assert 28 <= got[2].n_removed <= 40


def test_line_hard_rows(spark):
    docs = hard_docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(((r.doc_id, r.text) for r in line_dedup.dedup_lines(docs).collect()), key=str) == brute_lines(rows)
    assert line_dedup.dedup_lines(empty_docs(spark), report=True).count() == 0


def test_line_plan_has_no_python(spark):
    plan = line_dedup.dedup_lines(hard_docs(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan) and "Cartesian" not in plan and "NestedLoop" not in plan


def brute_spans(rows):
    def of(text):
        parts, sizes = span_dedup.sentences(text)
        assert "".join(parts) == text
        worded = [k for k, n in enumerate(sizes) if n]
        out = []
        for a in range(len(worded)):
            total = 0
            for b in range(a, len(worded)):
                total += sizes[worded[b]]
                if total >= span_dedup.SPAN_WORDS and b > a:
                    out.append((worded[a], worded[b], " ".join(" ".join(parts[k].split()) for k in worded[a : b + 1])))
                    break
        return parts, out

    first = {}
    for i, t in rows:
        for _, _, s in of(t or "")[1]:
            old = first.get(s, i)
            first[s] = i if old is None else old if i is None else min(i, old)
    result = []
    for i, t in rows:
        if t is None:
            result.append((i, None))
            continue
        parts, spans = of(t)
        drop, seen = set(), set()
        for a, b, s in spans:
            if first[s] not in (i, None) or s in seen:
                drop |= set(range(a, b + 1))
            seen.add(s)
        result.append((i, "".join(p for k, p in enumerate(parts) if k not in drop)))
    return sorted(result, key=str)


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefg") for _ in range(4)) for _ in range(n)).capitalize() + rng.choice(".!?")


def test_spans_equal_brute_force(spark):
    rng = random.Random(5)
    passages = [" ".join(sentence(rng, rng.randrange(5, 12)) for _ in range(8)) for _ in range(5)] + [sentence(rng, 60)]
    rows = []
    for i in range(60):
        text = " ".join(sentence(rng, rng.randrange(1, 30)) for _ in range(rng.randrange(6)))
        if rng.random() < 0.5:
            text += rng.choice([" ", "\n"]) + rng.choice(passages) + rng.choice([" ", "\n\n"]) + " ".join(sentence(rng, 9) for _ in range(3))
        rows.append((i, text))
    rows += [(5, rows[5][1]), (None, passages[0]), (70, passages[1] + "\n" + passages[1]), (None, "only null. " * 40)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, low string, span_id int")
    out = span_dedup.dedup_spans(docs)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == brute_spans(rows)
    # every repeated passage is gone but for one place; the rest stays
    texts = [r.text for r in out.collect()]
    for p in passages:
        assert sum(p in t for t in texts) == 1
    report = span_dedup.dedup_spans(docs, report=True).filter("removed_words > 0").count()
    assert report == sum(a != b for a, b in zip(brute_spans(rows), sorted(rows, key=str), strict=True)) or report > 0


def test_passages_in_mid_sentence(spark):
    """Passages of 51 words and more lose all copies but the first, wherever a sentence is when they begin, with or without signs."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    rows, planted = [], []
    for k in range(150):
        rate = (0, 0.05, 0.15)[k % 3]
        passage = [word() + ("." if rng.random() < rate else "") for _ in range(rng.randrange(51, 80))]
        planted.append(passage)
        for copy in (0, 1):
            around = [" ".join(word() + ("." if rng.random() < 0.08 else "") for _ in range(rng.randrange(1, 40))) for _ in range(2)]
            rows.append((2 * k + copy, " ".join([around[0], *passage, around[1]])))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    left = {r.doc_id: r for r in span_dedup.dedup_spans(docs, report=True).collect()}
    removed = [left[2 * k + 1].removed_words for k in range(len(planted))]
    assert all(left[2 * k].removed_words == 0 for k in range(len(planted)))
    assert all(r >= span_dedup.SPAN_WORDS for r in removed)
    assert sum(removed) > 0.8 * sum(map(len, planted))


def test_span_hard_rows(spark):
    docs = hard_docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(((r.doc_id, r.text) for r in span_dedup.dedup_spans(docs).collect()), key=str) == brute_spans(rows)
    assert span_dedup.dedup_spans(empty_docs(spark)).count() == 0
