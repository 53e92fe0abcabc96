"""Near-duplicate classes against brute force over all pairs."""

import functools
import random
from collections import Counter

import numpy as np

from verso.llm import near_dup

from .helpers import empty_docs, hard_docs


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b):
            row[j + 1] = old[j] + 1 if x == y else max(old[j + 1], row[j])
    return row[-1]


@functools.cache
def sketches(text):
    words = text.lower().split()
    return set(near_dup.sketch(near_dup.labelled(near_dup.shingles(near_dup.word_hashes(words)))).tolist()) if len(words) >= 5 else set()


def aligned(a, b):
    n = lcs(a, b)
    return n >= 0.8 * (len(a) + len(b) - n)


def brute_link(s, t):
    """Equal words, or a sketch in common and words that align."""
    a, b = s.lower().split(), t.lower().split()
    return a == b or bool(sketches(s) & sketches(t)) and aligned(a, b)


def brute_classes(rows):
    parent = {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, s) in enumerate(rows):
        for j, t in rows[:k]:
            if brute_link(s or "", t or ""):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in rows}


def test_alignment_equals_brute_force():
    rng = random.Random(1)
    for _ in range(400):
        a = np.array([rng.randrange(6) for _ in range(rng.randrange(40))], np.uint64)
        b = np.array([rng.randrange(6) for _ in range(rng.randrange(40))], np.uint64)
        assert near_dup.common_subsequence(a, b, 100) == lcs(a.tolist(), b.tolist())
    for _ in range(300):
        words = [f"w{rng.randrange(40)}" for _ in range(rng.randrange(5, 120))]
        other = [w if rng.random() > 0.1 else "z" for w in words]
        if rng.random() < 0.3:
            k = rng.randrange(len(words))
            other = other[:k] + other[k + rng.randrange(4) :]
        if other:
            assert near_dup.linked(near_dup.word_hashes(words), near_dup.word_hashes(other)) == aligned(words, other)


def shingle_similarity(a, b):
    x, y = (Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in (a, b))
    both = sum((x & y).values())
    return both / (sum(x.values()) + sum(y.values()) - both)


def test_recall_by_share_of_changed_words():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    for rate, least in ((0.01, 1.0), (0.02, 0.99), (0.03, 0.97), (0.04, 0.93), (0.05, 0.9)):
        found = 0
        for _ in range(200):
            base = [word() for _ in range(200)]
            other = list(base)
            for k in rng.sample(range(200), round(200 * rate)):
                other[k] = word()
            found += brute_link(" ".join(base), " ".join(other))
        assert found >= 200 * least, (rate, found)
    # Short texts whose shingles are similar by 0.8 agree in a sketch, too.
    for n in (9, 10, 14, 24, 40, 50, 60):
        missed = 0
        for _ in range(200):
            base = [word() for _ in range(n)]
            other = base[: n - max(1, (n - 4) // 5)]
            assert shingle_similarity(base, other) >= 0.79
            missed += not brute_link(" ".join(base), " ".join(other))
        assert not missed, n


def corpus(seed=7):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = []
    for group in range(12):
        base = [word() for _ in range(rng.randrange(60, 200))]
        for _ in range(rng.choice([1, 1, 4, 12])):
            copy = list(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    chain = [word() for _ in range(150)]
    for k in range(8):  # neighbours are similar, the ends are not
        rows.append(" ".join(chain))
        chain = [w if i // 4 != 4 * k + 1 else word() for i, w in enumerate(chain)]
    rows += ["same few", "same few", "same Few ", "", None, " \n", rows[0], rows[0].upper(), "it " * 400, "it " * 390]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_classes_equal_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, None, "x") for r in rows], "doc_id bigint, text string, words string, B string")
    got = {r.doc_id: r for r in near_dup.near_classes(docs).collect()}
    expected = brute_classes(rows)
    assert {i: r.class_id for i, r in got.items()} == expected
    for i, r in got.items():
        assert r.kept == (i == expected[i]) and r.class_size == sum(v == expected[i] for v in expected.values())


def test_hard_rows(spark):
    docs = hard_docs(spark)
    rows = near_dup.near_classes(docs).collect()
    assert len(rows) == docs.count()
    # A text that only a row without id has is alone; a null id with a text of row 6 belongs to the class of all texts with its words.
    assert {(r.class_id, r.class_size, r.kept) for r in rows if r.doc_id is None} == {(None, 1, True), (5, 4, False)}
    assert {r.class_id for r in rows if r.doc_id in (0, 1, 2, 3)} == {0}
    assert near_dup.near_classes(empty_docs(spark)).count() == 0


def test_components_of_long_chains_and_hubs(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 180)] + [(300, 299), (300, 300)]
    got = {r.node: r.label for r in near_dup.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**{k: 0 for k in range(1, 61)}, **{k: 100 for k in range(101, 180)}, 300: 299}


def test_large_group_of_mutual_copies(spark, monkeypatch):
    """Copies whose pairs are partly links, with blocks of every size."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(120)]
    rows = []
    for k in range(60):
        copy = list(base)
        for j in rng.sample(range(120), rng.randrange(4, 9)):
            copy[j] = word()
        rows.append((k, " ".join(copy)))
    expected = brute_classes(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for block in (256, 7):
        monkeypatch.setattr(near_dup, "BLOCK_NODES", block)
        assert {r.doc_id: r.class_id for r in near_dup.near_classes(docs).collect()} == expected


def test_common_matter_makes_no_pairs(spark, monkeypatch):
    """Texts that share two thirds and nothing else agree in sketches; none is compared in full, links among them are found."""
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    shared = [word() for _ in range(100)]
    rows = [(k, " ".join([*shared, *[word() for _ in range(50)]])) for k in range(80)]
    rows += [(100 + k, rows[k][1] + " " + word()) for k in (3, 50, 51)]
    made = []
    blocks = near_dup._rare_words
    monkeypatch.setattr(near_dup, "_rare_words", lambda *a: made.append(blocks(*a)) or made[-1])
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: r.class_id for r in near_dup.near_classes(docs).collect()} == brute_classes(rows)
    assert all(m.count() <= 6 for m in made)


def test_rows_compared_grow_with_the_group(spark, monkeypatch):
    """A group in common buckets, twice as large, whose nodes share rare words by two: twice the rows, not four times."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    shared = [word() for _ in range(100)]
    made = []
    frame = type(spark.range(1))
    deal = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, *a: made.append(self.count()) or deal(self, *a))
    monkeypatch.setattr(near_dup, "BLOCK_NODES", 1)
    for n in (30, 60):
        texts = []
        for k in range(n):
            pair = [word() for _ in range(30)] if k % 2 == 0 else pair
            # Every fifth pair is a link that no bucket's first node finds.
            texts.append(" ".join([*shared, *pair, *[word() for _ in range(6 if k // 2 % 5 == 3 else 20)]]))
        rows = list(enumerate(texts))
        docs = spark.createDataFrame(rows, "doc_id bigint, text string")
        got = {r.doc_id: r.class_id for r in near_dup.near_classes(docs).collect()}
        assert got == brute_classes(rows) and len(set(got.values())) < n
    assert len(made) == 2 and made[1] < 3 * made[0] and made[0] <= 30 * 31


def test_rows_that_stay(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(2, text, "a"), (1, text + " more", "b"), (1, text + " more", "c"), (None, text, "d"), (None, "lone text", "e"), (None, "lone  TEXT", "f"), (None, "other", "g"), (9, "short", "h"), (9, "other words", "i"), (10, "Short", "j")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, near_id string, words int")
    out = near_dup.drop_near(docs)
    assert out.columns == docs.columns
    got = [(r.doc_id, r.near_id) for r in out.collect()]
    assert sorted(x for x in got if x[0] is not None) == [(1, "b"), (1, "c"), (9, "h"), (9, "i")]
    assert len([x for x in got if x[0] is None]) == 2 and (None, "g") in got


def test_op9_query_on_the_whole_table(spark):
    """The registered query: a row for each document, classes as brute force finds them."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    expected = brute_classes(sorted((r.doc_id, r.text) for r in docs.collect()))
    got = near_dup.op9_near_dedup(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: r.class_id for r in got} == expected and all(r.kept == (r.doc_id == r.class_id) for r in got)
