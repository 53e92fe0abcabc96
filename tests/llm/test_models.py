"""The line classifier and the language model: exact parts against brute force, learned parts on held-out rows."""

import math
import random
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import public_tokenizers
import pytest

from verso.llm import attention, lm_score, quality

from .helpers import HARD_TEXTS, empty_docs, hard_docs

DATA = "/root/testdata/sf0.01"


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    counts = np.array([3, 1, 5, 2])
    scores, coupling = rng.normal(size=11), rng.normal(size=(2, 2))
    good, pairs, log_z = quality.forward_backward(scores, counts, coupling)
    at, expected_pairs, total = 0, np.zeros((2, 2)), 0.0
    for n in counts:
        s = scores[at : at + n]
        paths = list(product((0, 1), repeat=int(n)))
        weights = np.array([math.exp(sum(x * y for x, y in zip(s, p)) + sum(coupling[a, b] for a, b in zip(p, p[1:]))) for p in paths])
        total += math.log(weights.sum())
        weights /= weights.sum()
        for k in range(n):
            assert good[at + k] == pytest.approx(sum(w for w, p in zip(weights, paths) if p[k]))
        for w, p in zip(weights, paths):
            for a, b in zip(p, p[1:]):
                expected_pairs[a, b] += w
        at += n
    assert np.allclose(pairs, expected_pairs) and log_z == pytest.approx(total)


def test_features_do_not_depend_on_neighbouring_texts():
    texts = ["a b b c\n\nTHE END!! | 12", "", "\n", "x### y%%%\nplain words here", "z" * 3000, "same", "same", "same same\nsame"]
    together = quality.line_features(texts)
    at = 0
    for t, n in zip(texts, together[2]):
        alone = quality.line_features([t])
        assert n == t.count("\n") + 1 == alone[2][0]
        assert np.allclose(together[0][at : at + n], alone[0]) and np.allclose(together[1][at : at + n], alone[1])
        at += n


def brute_features(line):
    data = line.encode() + b"\n"
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", data) if w]
    n, upper, lower = max(1, len(words)), sum(65 <= b < 91 for b in data), sum(97 <= b < 123 for b in data)
    repeats = sum((a[:8], len(a)) == (b[:8], len(b)) for a, b in zip(words, words[1:]))
    return [
        math.log1p(len(words)) / 5,
        min(5 * sum(chr(b) in "#$%&*+<=>@\\^_`{|}~" for b in data) / len(data), 2),
        upper / max(1, upper + lower),
        min(data.count(b"!") / n, 2),
        min(3 * data.count(b"|") / n, 2),
        repeats / n,
        min(5 * sum(48 <= b < 58 for b in data) / len(data), 2),
        min(len(data) / n / 20, 2),
    ]


def brute_quality(model, text):
    """A text's score from the model's weights: features line by line, all labellings of the lines, the curve."""
    lines = text.split("\n")
    own = [brute_features(x) for x in lines]
    none = [0.0] * quality.FEATURES
    inputs = [[1.0, *own[k], *(own[k - 1] if k else none), *(own[k + 1] if k + 1 < len(own) else none)] for k in range(len(own))]
    odds = [float(np.dot(x, model.weights)) for x in inputs]
    total, good = 0.0, [0.0] * len(lines)
    for path in product((0, 1), repeat=len(lines)):
        weight = math.exp(sum(o * y for o, y in zip(odds, path)) + sum(model.coupling[a, b] for a, b in zip(path, path[1:])))
        total += weight
        for k, y in enumerate(path):
            good[k] += weight * y
    sizes = [len(x.encode()) + 1 for x in lines]
    mean = min(max(sum(g / total * s for g, s in zip(good, sizes)) / sum(sizes), 1e-6), 1 - 1e-6)
    a, b = model.curve
    return 1 / (1 + math.exp(-min(max(a + b * math.log(mean / (1 - mean)), -30), 30)))


def test_op7_scores_equal_brute_force(spark, monkeypatch):
    """The registered query on a whole table, with the model that it trained."""
    kept = []
    real = quality.train
    monkeypatch.setattr(quality, "train", lambda *a, **k: kept.append(real(*a, **k)) or kept[-1])
    got = {r.doc_id: r for r in quality.op7_quality_classifier(spark, DATA).collect()}
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    short = [i for i, t in texts.items() if t.count("\n") < 9]
    assert len(got) == len(texts) and len(short) > 100
    for i in short:
        assert got[i].score == pytest.approx(brute_quality(kept[0], texts[i]), abs=2e-4)
        assert got[i].predicted == (got[i].score >= 0.3) and got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_quality_on_held_out_rows(spark):
    from verso.llm.common import table

    got = {r.doc_id: r for r in quality.op7_quality_classifier(spark, DATA).collect()}
    truth = [(r.doc_id, r.quality) for r in table(spark, DATA, "labels").collect()]
    assert len(got) == table(spark, DATA, "documents").count()
    held = [(d, q) for d, q in truth if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(got[d].held_out for d, _ in held)
    assert sum(got[d].predicted == q for d, q in held) / len(held) > 0.95


def test_quality_hard_rows(spark):
    docs = hard_docs(spark)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(12)] + [(None, 1, 0), (1, None, 0), (2, 7, 0), (3, 0, 0)], "doc_id bigint, quality int, toxic int")
    model = quality.train(docs, labels)
    rows = quality.score(docs, model, name="q").collect()
    assert len(rows) == docs.count() and all(0 <= r.q <= 1 for r in rows) and rows[0].H is not None
    one_class = quality.train(docs, labels.filter("quality = 1"))
    assert one_class.constant == 1.0
    assert quality.train(empty_docs(spark), labels.limit(0)).constant == 0.5
    assert quality.score(empty_docs(spark), model).count() == 0


def brute_base(rows):
    split = lambda t: [bytes(w) for w in (t or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").replace(b"\r", b" ").split(b" ") if w]
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2
    counts = Counter()
    for i, t in rows:
        if not held(i):
            counts.update([*split(t), None])
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        tokens = [*split(t), None]
        out.append((i, held(i), len(tokens), sum(counts[w] > 0 for w in tokens), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens), 6)))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [1 << 16, 3])
def test_base_scores_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(lm_score, "HOT", hot)
    monkeypatch.setattr(lm_score, "COUNTED", 50)
    docs = hard_docs(spark)
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    rows = lm_score.score_texts(docs, path, pattern).collect()
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows), key=str)
    assert got == brute_base([(r.doc_id, r.text) for r in docs.collect()])
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)
    assert lm_score.score_texts(empty_docs(spark), path, pattern).count() == 0


def small_model(monkeypatch, seed=0, ids=300):
    """A model of few ids with random weights, some nodes without a view of the hidden state."""
    monkeypatch.setattr(attention, "NODES", 100)
    rng = np.random.default_rng(seed)
    counts = np.floor(1000 / (1 + np.arange(ids)) * rng.random(ids))
    codes = attention.Codes(counts, rng.random(ids) < 0.4, rng.integers(0, 3, (ids, attention.FREQUENT)).astype(np.float32))
    model = attention.Attention(codes, rng.integers(0, 50, (attention.PAD + 1, attention.CELLS)).astype(float))
    for k in model.NAMES:
        setattr(model, k, (getattr(model, k) + rng.normal(size=getattr(model, k).shape) * 0.3).astype(np.float32))
    return model


def brute_logs(model, ids, end):
    """Log-probabilities of a text's ids and its end, one place after the other, written down from the definition."""
    codes, size = model.codes, attention.BLOCK
    inputs = [end, *ids]
    rows = [codes.row[i] for i in inputs]
    out = []
    for t, target in enumerate([*ids, end]):
        first = max(0, (t // size - 1) * size)
        query = model.embed[rows[t]].astype(float) @ model.query / math.sqrt(attention.WIDTH)
        weights, total = np.zeros(attention.WIDTH), 0.0
        for u in range(first, t + 1):
            e = model.embed[rows[u]].astype(float)
            w = math.exp(query @ (e @ model.key) + model.place[t - u])
            weights, total = weights + w * (e @ model.value), total + w
        hidden = model.embed[rows[t]].astype(float) @ model.mix + weights / total
        hidden = hidden / (1 + np.abs(hidden))
        cells = hidden @ model.out + model.follow[rows[t]]
        log = cells[codes.cell[target]] - np.logaddexp.reduce(cells)
        for k in range(codes.start[target], codes.start[target + 1]):
            node = codes.node[k]
            z = codes.sign[k] * ((hidden @ model.nodes[node] if node < attention.NODES else 0) + codes.bias[node])
            log -= np.logaddexp(0, -z)
        out.append(log)
    return np.array(out)


def test_attention_equals_brute_force_and_is_proper(monkeypatch):
    rng = np.random.default_rng(1)
    model, end = small_model(monkeypatch), 299
    texts = [rng.integers(0, 299, n) for n in (0, 1, 15, 16, 17, 70)]
    windows, targets, real, owner = attention.blocks_of(texts, end)
    logs = model.logs(windows, targets).reshape(real.shape)
    for k, t in enumerate(texts):
        assert targets[owner == k][real[owner == k]].tolist() == [*t, end]
        assert np.allclose(logs[owner == k][real[owner == k]], brute_logs(model, t.tolist(), end), atol=1e-3)
    # What training minimises is the same number.
    loss, _ = model.step(model.codes.row[windows], targets, real)
    assert loss == pytest.approx(-logs[real].mean(), abs=1e-4)
    # All ids together have probability 1 after any context.
    one = np.repeat(windows[5:6], 300, axis=0)
    each = np.tile(np.arange(300)[:, None], (1, attention.BLOCK))
    assert np.allclose(np.exp(model.logs(one, each)).reshape(300, -1).sum(axis=0), 1, atol=1e-3)


def test_attention_is_causal(monkeypatch):
    rng = np.random.default_rng(2)
    model = small_model(monkeypatch)
    windows, targets = rng.integers(0, 299, (6, 2 * attention.BLOCK)), rng.integers(0, 299, (6, attention.BLOCK))
    before = model.logs(windows, targets).reshape(6, -1)
    windows[:, -1] = (windows[:, -1] + 1) % 299
    after = model.logs(windows, targets).reshape(6, -1)
    assert np.allclose(before[:, :-1], after[:, :-1], atol=1e-5) and not np.allclose(before[:, -1], after[:, -1])


def test_gradients_equal_differences(monkeypatch):
    rng = np.random.default_rng(3)
    model = small_model(monkeypatch)
    for k in model.NAMES:
        setattr(model, k, getattr(model, k).astype(np.float64))
    rows = rng.integers(0, 60, (4, 2 * attention.BLOCK))
    rows[0, : attention.BLOCK] = attention.PAD
    ids, real = rng.integers(0, 300, (4, attention.BLOCK)), rng.random((4, attention.BLOCK)) < 0.5
    _, g = model.step(rows, ids, real)
    for k in model.NAMES:
        value = getattr(model, k)
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in value.shape)
            at = (rows[1, -1], *at[1:]) if k == "embed" else (rng.integers(0, 100), *at[1:]) if k == "nodes" else at
            old = value[at]
            value[at] = old + 1e-4
            up, _ = model.step(rows, ids, real)
            value[at] = old - 1e-4
            down, _ = model.step(rows, ids, real)
            value[at] = old
            assert (up - down) / 2e-4 == pytest.approx(g[k][at], abs=2e-4), k


def test_parts_cover_texts_once():
    rng = random.Random(4)
    texts = ["", "a", "x" * 5000, " ".join("w" * rng.randrange(1, 30) for _ in range(900)), "a " * 512 + "b", "  lead" + " " * 1500 + "tail\n"]
    for t in texts:
        found = lm_score.parts_of(t, 1)
        assert [w for _, words, _, _ in found for w in words] == lm_score.words_of(t), t[:20]
        assert [p[2] for p in found] == [True] + [False] * (len(found) - 1) and found[-1][3]
    chosen = [len(lm_score.parts_of(" ".join(str(rng.random()) for _ in range(400)))) for _ in range(300)]
    assert 0.4 / lm_score.PARTS < sum(chosen) / 300 / 8 < 2.5 / lm_score.PARTS
    windows, targets, real, _ = attention.blocks_of([np.array([5, 6, 7])], 9, [False], [False])
    assert targets[real].tolist() == [6, 7] and windows[0, attention.BLOCK :][:4].tolist() == [10, 5, 6, 7]


def test_scores_equal_brute_force_and_beat_the_base(spark, monkeypatch):
    """Whole texts of the smallest table, with the model that the operator trained."""
    kept = []
    real = lm_score.train
    monkeypatch.setattr(lm_score, "train", lambda *a: kept.append(real(*a)) or kept[-1])
    monkeypatch.setattr(lm_score, "PARTS", 1)
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = {r.doc_id: r for r in lm_score.score_texts(docs, path, pattern).collect()}
    own = lm_score.subwords(path, pattern)
    texts = sorted(docs.collect(), key=lambda r: len(r.text or ""))
    for r in [*texts[:20], texts[100]]:
        ids = np.frombuffer(own.of(lm_score.words_of(r.text)), "<i4").tolist()
        assert rows[r.doc_id].score == pytest.approx(brute_logs(kept[0], ids, own.end).sum() / math.log(10), rel=1e-3)
    assert len(rows) == docs.count()


def test_model_learns_the_order_of_words(spark, monkeypatch):
    """Training rows that differ in their order of words only, which no count of words sees."""
    monkeypatch.setattr(lm_score, "PARTS", 1)
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    start = "river stone green light house tree water"
    scores = []
    for words in (start.split() * 30, sorted(start.split() * 30)):
        rows = [(k, start if zlib.crc32(str(k).encode()) % 7 == 2 else " ".join(words)) for k in range(60)]
        docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(2)
        out = lm_score.score_texts(docs, path, pattern).filter("held_out").collect()
        assert out and len({r.base_score for r in out}) == 1
        scores.append((out[0].base_score, out[0].score))
    assert scores[0][0] == scores[1][0] and scores[0][1] > scores[1][1] + 1 and scores[0][1] > scores[0][0]


def test_scores_do_not_depend_on_which_words_travel_or_on_tasks(spark, monkeypatch):
    docs = hard_docs(spark).select("doc_id", "text")
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    scores = []
    for hot, tasks in ((1 << 16, 2), (3, 2), (0, 1)):
        monkeypatch.setattr(lm_score, "HOT", hot)
        scores.append(sorted((str(r.doc_id), r.n_known, round(r.base_score, 6), round(r.score, 3)) for r in lm_score.score_texts(docs.coalesce(tasks), path, pattern).collect()))
    assert scores[0] == scores[1] == scores[2]


def test_many_tasks_average(spark, monkeypatch):
    """Parts dealt to several tasks give a model, too, that is better than the words' shares."""
    monkeypatch.setattr(lm_score, "PARTS", 1)
    monkeypatch.setattr(lm_score, "IDS_OF_TASK", 50_000)
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    out = lm_score.score_texts(docs, path, pattern).collect()
    assert all(math.isfinite(r.score) for r in out) and sum(r.score for r in out) / sum(r.n_tokens for r in out) > -5


def test_weights_learn_from_every_id_of_every_training_text(spark, monkeypatch):
    """As many targets as all whole training texts have ids and ends, in one partition and in many."""
    kept = []
    real = lm_score.train
    monkeypatch.setattr(lm_score, "train", lambda *a: kept.append(real(*a)) or kept[-1])
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    texts = [None, "", " " * 3000 + "late", "lone", "x" * 5000, "tail " * 900 + " " * 3000, *[f"some words {k} of a text " * 99 for k in range(40)], *["copy of a text " * 200] * 9]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    own = lm_score.subwords(path, pattern)
    expected = sum(len(own.of(lm_score.words_of(t))) // 4 + 1 for k, t in enumerate(texts) if zlib.crc32(str(k).encode()) % 7 != 2)
    for size in (1 << 21, 2000):
        monkeypatch.setattr(lm_score, "IDS_OF_TASK", size)
        assert lm_score.score_texts(docs, path, pattern).count() == len(texts)
        assert kept[-1].learnt == expected


def test_parts_are_joined_without_a_gap():
    rng = random.Random(6)
    texts = [None, "", " " * 3000, " " * 3000 + "late", "tail " * 300 + " " * 3000, "x" * 5000, " ".join("w" * rng.randrange(1, 30) for _ in range(900))]
    for t in texts:
        found = lm_score.chained([t], lm_score.PARTS)
        words = lm_score.words_of(t)
        assert [w for p in found for w in p[2].split()] == words and [p[4] for p in found] == [False] * (len(found) - 1) + [True]
        at = 0
        for p in found:
            assert p[3] == (words[at - 1] if at else b"")
            at += len(p[2].split())


def test_gradients_are_summed_by_row_once(monkeypatch):
    """A step sorts and sums vectors of the input's width, one for each place of a window, and not what is made of them."""
    rng = np.random.default_rng(5)
    model, sizes = small_model(monkeypatch), []
    real = attention._sums
    monkeypatch.setattr(attention, "_sums", lambda rows, values, n: sizes.append((n, values.size)) or real(rows, values, n))
    rows = rng.integers(0, 60, (7, 2 * attention.BLOCK))
    model.step(rows, rng.integers(0, 300, (7, attention.BLOCK)), np.ones((7, attention.BLOCK), bool))
    assert sum(size for n, size in sizes if n == attention.PAD + 1) == rows.size * attention.WIDTH


@pytest.mark.parametrize("scale", [1, 12])
def test_steps_lose_nothing_with_large_weights(monkeypatch, scale):
    """Loss as by definition, and finite gradients, where exponentials of the scores themselves would overflow, too."""
    rng = np.random.default_rng(6)
    model, end = small_model(monkeypatch), 299
    for k in ("query", "key", "out", "place"):
        setattr(model, k, getattr(model, k) * np.float32(scale))
    texts = [rng.integers(0, 299, n) for n in (0, 5, 40)]
    windows, targets, real, _ = attention.blocks_of(texts, end)
    loss, g = model.step(model.codes.row[windows], targets, real)
    logs = np.concatenate([brute_logs(model, t.tolist(), end) for t in texts])
    assert loss == pytest.approx(-logs.mean(), rel=1e-3) and all(np.isfinite(x).all() for x in g.values())


def test_descending_equals_adam_written_down(monkeypatch):
    """The weights after some steps, each factor and moment by the book."""
    rng = np.random.default_rng(7)
    model, other = small_model(monkeypatch), small_model(monkeypatch)
    rows, real = rng.integers(0, 60, (6, 4, 2 * attention.BLOCK)), np.ones((4, attention.BLOCK), bool)
    ids = rng.integers(0, 300, (6, 4, attention.BLOCK))
    model.descend(((r, i, real) for r, i in zip(rows, ids)), lambda t: 0.01 / t)
    m = {k: 0 for k in other.NAMES}
    v = dict(m)
    for t in range(1, 7):
        _, g = other.step(rows[t - 1], ids[t - 1], real)
        for k in other.NAMES:
            m[k], v[k] = 0.9 * m[k] + 0.1 * g[k], 0.99 * v[k] + 0.01 * g[k] ** 2
            change = 0.01 / t * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
            setattr(other, k, (getattr(other, k) - change).astype(np.float32))
    assert np.allclose(model.weights(), other.weights(), atol=2e-4)


@pytest.mark.parametrize("hot", [0, 3, 1 << 16])
def test_words_looked_up_together_have_the_ids_they_have_alone(hot):
    """Every control sign, other kinds of white space (which are no ends of words) and words that are only these."""
    own = lm_score.subwords(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = random.Random(8)
    signs = [*map(chr, range(128)), *"\x85\xa0    　﻿​Äßİé日😀'", "'s", "'LL ", " 12", "　 ", " 　", "\xa0\xa0 a"]
    texts = [None, "", " ", *HARD_TEXTS, *["".join(rng.choices(signs, k=rng.randrange(40))) for _ in range(300)], " ".join(f"w{k} {k}" for k in range(3000))]
    lists = [lm_score.words_of(t) for t in texts]
    counts = Counter([*(w for words in lists for w in words), *[b" "] * len(texts)])
    frequent = lm_score.Frequent(dict(counts.most_common(hot)), own)
    sizes, place, each, ids, rare = frequent.read(lm_score.lists_of(texts), own)
    assert sizes.tolist() == [len(words) for words in lists]
    flat = [w for words in lists for w in words]
    assert [w for w, p in zip(flat, place, strict=True) if p < 0] == rare.to_pylist()
    assert all(frequent.words[p].as_py() == w for w, p in zip(flat, place.tolist()) if p >= 0)
    assert [x.tolist() for x in lm_score._slices(ids, each)] == [own.ids(w) for w in flat]
    assert frequent.read(lm_score.lists_of([None, " "]), own)[0].tolist() == [0, 0]
    assert own.counted([b" ", b"a", "　".encode(), b"b"]) == [np.array(x, "<i4").tobytes() for x in ([own.end], own.ids(b"a"), own.ids("　".encode()), own.ids(b"b"))]
    assert own.counted([b" "]) == [np.array([own.end], "<i4").tobytes()] and own.counted([]) == []


def test_training_lines_keep_their_true_neighbours(spark):
    """A long text's lines, alternating between two kinds, are thinned to runs that still alternate."""
    text = "\n".join("PLAIN" if k % 2 else "some words of a line" for k in range(301))
    ((_, inputs, sizes, runs),) = [r for b in quality._sample([[[1], [text]]]) for r in zip(*b)]
    inputs = np.array(inputs).reshape(len(sizes), -1)
    features, size, counts = quality.line_features([text])
    whole = quality.with_neighbours(features, counts)
    assert sum(runs) == len(sizes) <= quality.TRAIN_LINES and all(n > 1 for n in runs)
    assert all((np.abs(whole - row).max(axis=1) < 1e-6).any() for row in inputs)
    own, after = inputs[:, 1 : 1 + quality.FEATURES], inputs[:, 1 + 2 * quality.FEATURES :]
    ends = np.cumsum(runs) - 1
    inside = np.setdiff1d(np.arange(len(sizes)), ends)
    assert np.allclose(own[inside + 1], after[inside])
