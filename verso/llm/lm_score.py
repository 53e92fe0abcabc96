"""Language-model scores of whole texts: a unigram base over words and a causal self-attention model over subwords.

Counts. Words (A-Z in lower case, split at white space) and one end per text are counted over all training
rows: each task sums its own words first, then one shuffle. The table of counts grows with the vocabulary
and is never broadcast or collected; its most frequent short words are (``HOT`` at most, found by a histogram of
counts), so that a scored text looks up its frequent words where it is and only its other words are joined, on
the words themselves.

Model. A text is its words, each after a space, as subword ids, then an end id. One layer of causal self-attention
(:mod:`.attention`) gives the probability of every next id from up to two blocks of ids before it. ``score`` is the
sum of these logs; nothing else is mixed in.

Training. From all training words with their counts come the frequencies of ids, which ids stand together in words
(which makes the output's cells) and which cell follows which id (what the weights start from). The weights are
trained with Adam on the whole texts of all training rows, in parts of about ``PART`` bytes: every id and every end is
a target, a part's first id after the last one of the part before. Parts are dealt by the hash of their row's id
and bytes, which depends on no partitioning and keeps copies apart, to partitions of about ``IDS_OF_TASK`` ids. One of
them trains the start in ``EPOCHS`` passes; from there each of the others makes one pass, and the mean of their weights,
weighted by their ids, is the model (where there is one partition, the start is).

Scoring. A text is cut into blocks of ids; each block is scored once and attends, masked, to itself and the
block before: overlapping windows of two blocks, evaluated in batches.

Null texts are empty and consist of the end alone. Rows keep their own number through the joins, so ids
may repeat or be null; ids are numbers (or text that casts to bigint). Without training rows all counts are 0 and
the weights are those of the start. A word of any length is encoded whole.
"""

from __future__ import annotations

import base64
import functools
import itertools
import math
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .attention import BATCH, BLOCK, CELLS, FREQUENT, PAD, Attention, Codes, blocks_of, frequent
from .common import cut, fold, map_columns, table

HELD_OUT, HELD_REMAINDER = 7, 2
#: Frequent words that travel with the tasks: so many at most, each of at most so many bytes.
HOT, HOT_BYTES = 1 << 16, 64
#: Bytes of the parts that a training text falls into, and one in how many the weights are trained on: all.
PART, PARTS = 1024, 1
IDS_OF_TASK, EPOCHS = 1 << 21, 2
#: Rates of the start (falling to a twentieth) and of the passes from it (falling likewise).
RATE, RATE_AFTER = 0.02, 0.004
#: Words counted by a task; ids scored at a time.
COUNTED, IDS_AT_ONCE = 400_000, 1 << 16


def words_of(text: str | None) -> list[bytes]:
    """The contract's words: ``bytes`` lower-cases A-Z only and splits at exactly space and 9 to 13."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class Subwords:
    """Ids of words from a byte-level vocabulary in ranks form; the id after the last rank is the end."""

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("subwords", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.end = max(ranks.values()) + 1

    def ids(self, word: bytes) -> list[int]:
        return self.encoding.encode_ordinary(" " + word.decode("utf-8", "replace"))

    def counted(self, words: list[bytes]) -> list[bytes]:
        """32-bit ids of each counted word; the one that is a space stands for the end."""
        found = iter(_slices(*self.each([w for w in words if w != b" "])))
        return [(np.array([self.end]) if w == b" " else next(found)).astype("<i4").tobytes() for w in words]

    @functools.cached_property
    def initial(self) -> np.ndarray:
        """Whether an id starts with a space, or is the end."""
        starts = [self.encoding.decode_single_token_bytes(i)[:1] == b" " for i in range(self.end)]
        return np.array([*starts, True])

    def of(self, words: list[bytes]) -> bytes:
        """32-bit ids of the words, joined."""
        return self.each(words)[0].astype("<i4").tobytes()

    def each(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and each word's number of ids.

        Words are encoded together, as no piece of the vocabulary's pattern goes on behind a space. White space of other
        kinds, which words may have, could be one piece with it; such words are encoded alone.
        """
        texts = [w.decode("utf-8", "replace") for w in words]
        joined = " " + " ".join(texts)
        if texts and joined.split() == texts:
            ids = np.array(self.encoding.encode_ordinary(joined), np.int64)
            starts = np.flatnonzero(self.initial[ids])
            if len(starts) == len(words):
                return ids, np.diff(np.append(starts, len(ids)))
        if len(words) < 8:
            return _flat([np.array(self.ids(w), "<i4").tobytes() for w in words])
        half = len(words) // 2
        return tuple(map(np.concatenate, zip(self.each(words[:half]), self.each(words[half:]), strict=True)))


class Frequent:
    """The frequent words that travel with tasks: their ids, and the logs of their counts (plus 1)."""

    def __init__(self, counts: dict[bytes, int], own: Subwords) -> None:
        self.end = math.log10(counts[b" "] + 1) if b" " in counts else None
        words = [w for w in counts if w != b" "]
        self.words = pa.array(words, pa.binary())
        self.logs = np.array([math.log10(counts[w] + 1) for w in words], np.float64)
        self.ids, self.sizes = own.each(words)

    def read(self, lists: pa.Array, own: Subwords) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """Of lists of words (empty ones are none): sizes of the lists, each word's place among the frequent ones (or -1)
        and its number of ids, all ids, and the words that are not frequent."""
        words, edges = lists.flatten().cast(pa.binary()), np.asarray(lists.offsets)
        real = np.asarray(pc.binary_length(words)) > 0
        edges = np.concatenate([[0], np.cumsum(real)])[edges - edges[0]]
        words = words.filter(pa.array(real))
        place = np.asarray(pc.fill_null(pc.index_in(words, value_set=self.words), -1)).astype(np.int64)
        missed = place < 0
        rare = words.filter(pa.array(missed))
        new = rare.dictionary_encode()
        ids, sizes = own.each(new.dictionary.to_pylist())
        at = place.copy()
        at[missed] = len(self.sizes) + np.asarray(new.indices)
        ids, sizes = np.concatenate([self.ids, ids]).astype(np.int32), np.concatenate([self.sizes, sizes])
        begin = (np.cumsum(sizes) - sizes).take(at)
        sizes = sizes.take(at)
        ends = np.cumsum(sizes)
        return np.diff(edges), place, sizes, ids.take(np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - sizes), sizes)), rare


def lists_of(texts: list[str | None]) -> pa.Array:
    """The contract's words of each text (and empty ones): Arrow lower-cases A-Z only and splits at exactly space and 9 to 13."""
    return pc.ascii_split_whitespace(pc.ascii_lower(pa.array([t or "" for t in texts], pa.string())))


def _slices(values: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Consecutive parts of these sizes."""
    ends = np.cumsum(sizes)
    return [values[i:j] for i, j in zip((ends - sizes).tolist(), ends.tolist())]


_subwords: dict[str, Subwords] = {}


def subwords(path: str, pattern: str) -> Subwords:
    return _subwords.get(path) or _subwords.setdefault(path, Subwords(path, pattern))


def _count(batches):
    held: Counter = Counter()

    def flush():
        rows = [list(held), list(held.values())]
        held.clear()
        return rows

    for (texts,) in batches:
        for text in texts:
            held.update(words_of(text))
            held[b" "] += 1  # the end: no word has a space
            if len(held) > COUNTED:
                yield flush()
    yield flush()


def parts_of(text: str | None, share: int = PARTS) -> list[tuple[int, list[bytes], bool, bool]]:
    """The parts of a text that weights are trained on: hash, words, and whether they have the text's start and end.

    A word belongs to the part in which it starts.
    """
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    found = []
    for k in range(0, len(data) + 1, PART):
        h = crc32(data[k : k + PART], len(data))
        if h % share == 0:
            begin, stop = k, k + PART
            while 0 < begin < len(data) and data[begin - 1] not in WHITE and data[begin] not in WHITE:
                begin += 1
            while begin < stop < len(data) and data[stop - 1] not in WHITE and data[stop] not in WHITE:
                stop += 1
            found.append((h, data[begin:stop].split(), k == 0, stop >= len(data)))
    return found


WHITE = b" \t\n\x0b\x0c\r"


def _dense(rows: DataFrame, size: int) -> np.ndarray:
    """Sums by place of rows (``at``, ``c``); at most ``size`` of them come to the driver."""
    out = np.zeros(size)
    found = rows.groupBy("at").agg(F.sum("c").alias("c")).toArrow()
    out[found["at"].to_numpy()] = found["c"].to_numpy()
    return out


def _sparse(total: np.ndarray) -> list:
    at = np.flatnonzero(total)
    return [at.tolist(), total[at].tolist()]


def _flat(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, and each word's number of ids."""
    return np.frombuffer(b"".join(ids), "<i4").astype(np.int64), np.array([len(i) // 4 for i in ids], np.int64)


def train(docs: DataFrame, counts: DataFrame, known, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> Attention:
    """The model of the training rows ``docs``; ``counts``: ``ids`` and ``c`` of all their words and ends; ``known``: broadcast, frequent words."""
    own = subwords(path, pattern)
    size, initial = own.end + 1, own.initial
    by_word = counts.select("ids", "c")

    def by_id(batches):
        total = np.zeros(size, np.int64)
        for ids, c in batches:
            flat, sizes = _flat(ids)
            np.add.at(total, flat, np.repeat(np.array(c, np.int64), sizes))
        yield _sparse(total)

    frequency = _dense(map_columns(by_word, "at bigint, c bigint", by_id), size)
    place = frequent(frequency)

    def by_neighbour(batches):
        """Ids that stand next to a frequent one, on either side, in a word."""
        total = np.zeros(size * FREQUENT, np.int64)
        for ids, c in batches:
            flat, sizes = _flat(ids)
            word, c = np.repeat(np.arange(len(sizes)), sizes), np.repeat(np.array(c, np.int64), sizes)
            for one, other in ((slice(None, -1), slice(1, None)), (slice(1, None), slice(None, -1))):
                ok = (word[one] == word[other]) & (place[flat[other]] >= 0)
                np.add.at(total, flat[one][ok] * FREQUENT + place[flat[other][ok]], c[one][ok])
        yield _sparse(total)

    beside = _dense(map_columns(by_word, "at bigint, c bigint", by_neighbour), size * FREQUENT).astype(np.float32).reshape(size, FREQUENT)
    codes = Codes(frequency, initial, beside)
    row, cell = codes.row, codes.cell

    def by_pair(batches):
        """Row of an id and cell of the next one in its word; behind them, how often a cell begins a word and a row ends one."""
        total = np.zeros((PAD + 1) * CELLS + CELLS + PAD + 1, np.int64)
        for ids, c in batches:
            flat, sizes = _flat(ids)
            sizes, c = sizes[sizes > 0], np.array(c, np.int64)[sizes > 0]
            word, ends = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes)
            inside = word[1:] == word[:-1]
            np.add.at(total, (row[flat[:-1]] * CELLS + cell[flat[1:]])[inside], c[word[:-1]][inside])
            np.add.at(total, (PAD + 1) * CELLS + cell[flat[ends - sizes]], c)
            np.add.at(total, (PAD + 1) * CELLS + CELLS + row[flat[ends - 1]], c)
        yield _sparse(total)

    pairs = _dense(map_columns(by_word, "at bigint, c bigint", by_pair), (PAD + 1) * CELLS + CELLS + PAD + 1)
    inside, first, last = np.split(pairs, [(PAD + 1) * CELLS, (PAD + 1) * CELLS + CELLS])
    model = Attention(codes, inside.reshape(PAD + 1, CELLS) + last[:, None] * first / max(1.0, first.sum()))
    model.learnt = _descend(docs, model, known, path, pattern, text, key, frequency.sum())
    return model


def chained(texts: list[str | None], share: int) -> list[tuple[int, int, bytes, bytes, bool]]:
    """The texts' parts: place of the text, hash, words, the word before them (none: the text starts here), and whether the text ends."""
    found = []
    for k, t in enumerate(texts):
        before = b""
        for h, words, _, ends in parts_of(t, share):
            if words or ends:
                found.append((k, h, b" ".join(words), before, ends))
            before = words[-1] if words else before
            if ends:  # later parts are inside the last word
                break
    return found


def _descend(docs: DataFrame, model: Attention, known, path: str, pattern: str, text: str, key: str, n_ids: float) -> int:
    """Train the model's weights on the parts of the texts of ``docs``, which have about ``n_ids`` ids; the number of targets."""
    row, end, share = model.codes.row, subwords(path, pattern).end, PARTS

    def to_parts(batches):
        for ids, texts in batches:
            found = list(zip(*chained(texts, share), strict=True)) or [[]] * 5
            yield [[ids[k] for k in found[0]], *found[1:]]

    tasks = max(1, math.ceil(n_ids / share / IDS_OF_TASK))
    dealt = F.pmod(F.xxhash64("id", "h", "words"), F.lit(tasks)).cast("int")
    source = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    parts = map_columns(source, "id bigint, h bigint, words binary, before binary, ends boolean", to_parts).withColumn("task", dealt)

    def passes(epochs: int, top: float):
        def work(batches):
            mine = Attention.__new__(Attention)
            mine.__dict__.update(model.__dict__)
            own = subwords(path, pattern)
            texts, starts, ends = [], [], []
            for words, before, e in batches:
                lists = pc.split_pattern(pa.array([b + b" " + w for w, b in zip(words, before, strict=True)], pa.binary()), b" ")
                counts, _, sizes, ids, _ = known.value.read(lists, own)
                first = np.cumsum(counts) - counts
                edges = np.concatenate([[0], np.cumsum(sizes)])
                # Of the word before a part, the last id is read.
                skipped = [int(sizes[k]) - 1 if b else 0 for k, b in zip(first, before, strict=True)]
                texts += [x[k:] for x, k in zip(_slices(ids, edges[first + counts] - edges[first]), skipped, strict=True)]
                starts += [not b for b in before]
                ends += e
            if not texts:
                return
            windows, targets, real, _ = blocks_of(texts, end, starts, ends)
            windows, targets = row[windows].astype(np.int32), targets.astype(np.int32)
            order = np.random.default_rng(2)
            steps = epochs * -(-len(windows) // BATCH)

            def drawn():
                for _ in range(epochs):
                    chosen = order.permutation(len(windows))
                    for k in range(0, len(chosen), BATCH):
                        at = chosen[k : k + BATCH]
                        yield windows[at], targets[at], real[at]

            mine.descend(drawn(), lambda t: top * min(1, t / 20) * (1 - 0.95 * t / steps))
            n = float(real.sum())
            learnt = mine.weights() * n
            for k in range(0, len(learnt), 1 << 16):
                yield [list(range(k, min(k + (1 << 16), len(learnt)))), learnt[k : k + (1 << 16)].tolist()]
            yield [[-1], [n]]

        return work

    def learn(chosen: DataFrame, epochs: int, top: float) -> int:
        """Put the mean of what the partitions learn into the model; one row for each weight comes to the driver."""
        source = chosen.sortWithinPartitions("h", "words", "before", "ends").select("words", "before", "ends")
        found = map_columns(source, "at int, v double", passes(epochs, top)).groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").toArrow()["v"].to_numpy()
        if len(found):
            model.put(found[1:] / found[0])
        return int(found[0]) if len(found) else 0

    learnt = learn(parts.filter("task = 0").repartition(1), EPOCHS, RATE)
    if tasks > 1:
        # Each number is a partition of its own, so that none holds several.
        learnt += learn(parts.filter("task > 0").repartitionById(tasks - 1, F.col("task") - 1), 1, RATE_AFTER)
    return learnt


def hot_words(counts: DataFrame) -> dict[bytes, int]:
    """The most frequent short words with their counts: all from some count on, ``HOT`` at most."""
    short = counts.filter(F.octet_length("w") <= HOT_BYTES).select("w", "c")
    # Counts of a power of two's sixteenth fall together, so that the histogram has at most some 1000 rows.
    level = F.floor(F.log2("c") * 16).cast("int")
    taken, least = 0, None
    for r in short.groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect():
        taken += r.n
        if taken > HOT:
            break
        least = r.level
    return {} if least is None else {bytes(r.w): r.c for r in short.filter(level >= least).collect()}


def score_texts(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` of every row."""
    training = fold(key, HELD_OUT) != HELD_REMAINDER
    parts = map_columns(docs.filter(training).select(F.col(text).alias("text")), "w binary, c bigint", _count)
    encode = lambda batches: ([w, c, subwords(path, pattern).counted(w)] for w, c in batches)
    counts = cut(map_columns(parts.groupBy("w").agg(F.sum("c").alias("c")), "w binary, c bigint, ids binary", encode))
    n, v = counts.agg(F.sum("c"), F.count("*")).first()
    n, v = n or 0, v or 0
    known = docs.sparkSession.sparkContext.broadcast(Frequent(hot_words(counts), subwords(path, pattern)))
    model = train(docs.filter(training), counts, known, path, pattern, text, key)
    task = docs.sparkSession.sparkContext.broadcast(model)

    def describe(batches):
        model, often = task.value, known.value
        mine, tables = subwords(path, pattern), model.tables()
        row = itertools.count(TaskContext.get().partitionId() << 33)

        def scores(group: list[np.ndarray]) -> list[float]:
            windows, targets, real, owner = blocks_of(group, mine.end)
            logs = np.where(real.ravel(), model.logs(windows, targets, tables), 0)
            return (np.bincount(np.repeat(owner, BLOCK), weights=logs, minlength=len(group)) / math.log(10)).tolist()

        for ids, texts, held in batches:
            counts, place, sizes, flat, rare = often.read(lists_of(texts), mine)
            owner, hot = np.repeat(np.arange(len(texts)), counts), place >= 0
            logs = np.bincount(owner[hot], weights=often.logs.take(place[hot]), minlength=len(texts))
            missed = np.bincount(owner[~hot], minlength=len(texts))
            found = counts - missed
            rare = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(missed)]), pa.int32()), rare)
            if often.end is None:
                rare = [[*words, b" "] for words in rare.to_pylist()]
            else:
                logs, found = logs + often.end, found + 1
            score: list[float] = []
            group: list[np.ndarray] = []
            size = 0
            for own in _slices(flat, np.bincount(owner, weights=sizes, minlength=len(texts)).astype(np.int64)):
                group.append(own)
                size += len(own)
                if size > IDS_AT_ONCE:
                    score += scores(group)
                    group, size = [], 0
            if group:
                score += scores(group)
            yield [[next(row) for _ in texts], ids, held, pa.array(counts + 1), pa.array(found), pa.array(logs), rare, score]

    source = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"), (~training).alias("held_out"))
    made = cut(map_columns(source, "row bigint, id bigint, held_out boolean, n_tokens bigint, known bigint, logs double, w array<binary>, score double", describe))
    rare = made.select("row", F.explode("w").alias("w"))
    found = rare.join(counts.select("w", "c"), "w").groupBy("row").agg(F.sum(F.log10(F.col("c") + 1.0)).alias("more_logs"), F.count("*").alias("more"))
    size = math.log10(n + v + 1)
    return made.drop("w").join(found, "row", "left").select(
        F.col("id").alias(key),
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * size).alias("base_score"),
        "score",
    )


def op8_lm_score(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return score_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
