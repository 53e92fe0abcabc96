"""Bound-certified best-fit packing of documents into sequences of a fixed number of tokens.

1. Each document is encoded once, where its text is; only a row for each piece leaves the task (length,
   start and checksum), so that no text is shuffled. The pieces are written to the shared folder.
2. The pieces are dealt evenly to partitions of about ``GROUP`` rows, each packed by best-fit decreasing.
   Dual feasible functions give a lower bound on each partition's number of sequences; a partition that
   meets its bound is certified optimal and is never touched again.
3. Partitions above their bound give up the documents of their open sequences, and every partition gives up
   the one sequence that may be half empty (its bound is rounded up for that one). These are dealt anew, whole
   sequences together, and packed again; the new packing holds where it needs fewer sequences. This goes on
   until a round saves no sequence or the bound over all pieces is met.
4. Every row tells how many sequences there are and the bound over all pieces together, which needs only the
   number of pieces of each length.

A null text is the empty text. Every document has at least one token, the closing id, so that every row
gives at least one piece. Ids may repeat or be null; pieces are rows, never joined by id. Ids are numbers (or text
that casts to bigint). A text of any length is encoded in one task and cut into pieces there.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_columns

CAPACITY, END_ID = 2048, 0
#: Pieces packed together by one task, a few MB.
GROUP = 50_000
#: Distinct words that a worker remembers, twice: those met lately and those before them.
CACHE_WORDS = 150_000

#: The characters with the Unicode property White_Space, which is what the vocabulary's splitter means by white space.
_WHITE = "".join(map(chr, (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_RARE = "".join(c for c in _WHITE if c not in "\n ")
_RUNS = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+\\Z")
_IRREGULAR = re.compile(f"[{_WHITE}][{_WHITE}]|[{_RARE}]|[\n ]\\Z")


class Remembered(dict):
    """Values by word, made when first asked for; what was not asked for lately is forgotten."""

    def __init__(self, make) -> None:
        self.make, self.older = make, {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.older = dict(self)
            self.clear()
        value = self.older.get(word)
        if value is None:
            value = self.make(word)
        self[word] = value
        return value


class WordEncoder:
    """Ids of texts, encoding each distinct word once.

    The splitter never joins a character that is not white space with white space after it, so that a text
    falls into words (white space, then other characters) whose ids do not depend on each other.

    The vocabulary is read by ``tokenizers``. In a byte-level vocabulary ids are merge ranks, so that
    ``tiktoken`` finds the same ids of a new word in a fraction of the time (a test holds them equal); words
    with a special token's string, and vocabularies whose ids are no ranks, go to ``tokenizers`` itself.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.hard = re.compile("|".join(map(re.escape, self.special)) or r"(?!)")
        self.fast = self._ranks()
        # Words as they are, and words that stand for themselves after a space (or begin with a line end).
        self.whole = Remembered(self._new)
        self.spaced = Remembered(lambda word: self._new(word if word[:1] == "\n" else " " + word))

    def _ranks(self):
        """The vocabulary as byte ranks, if its model is a plain byte-level one."""
        description = json.loads(self.tokenizer.to_str())
        model = description["model"]
        if description["normalizer"] or (description["pre_tokenizer"] or {}).get("type") != "ByteLevel" or model["type"] != "BPE":
            return None
        import public_tokenizers
        import tiktoken

        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in plain)}
        ranks = {bytes(shown[c] for c in token): i for token, i in model["vocab"].items() if token not in self.special}
        merges = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
        ordered = [model["vocab"][m.replace(" ", "")] for m in merges]
        if ordered != sorted(ordered) or description["pre_tokenizer"].get("add_prefix_space"):
            return None
        return tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _new(self, word: str) -> bytes:
        ids = self.fast(word) if self.fast is not None and not self.hard.search(word) else self.tokenizer.encode(word, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        for text in texts:
            if _IRREGULAR.search(text):
                yield b"".join(map(self.whole.__getitem__, _RUNS.findall(text)))
            else:
                first, *rest = text.replace("\n", " \n").split(" ")
                yield self.whole[first] + b"".join(map(self.spaced.__getitem__, rest))


_encoders: dict[str, WordEncoder] = {}


def _pieces(path: str, capacity: int):
    def work(batches):
        encoder = _encoders.get(path) or _encoders.setdefault(path, WordEncoder(path))
        end = END_ID.to_bytes(4, "little")
        for ids, texts in batches:
            out: list[list] = [[], [], [], [], []]
            for identifier, data in zip(ids, encoder.encode([t or "" for t in texts]), strict=True):
                data += end
                total = len(data) // 4
                first = (total - 1) % capacity + 1
                cuts = [0, *range(first, total + 1, capacity)]
                for k in range(len(cuts) - 1):
                    for column, value in zip(out, (identifier, k, cuts[k], cuts[k + 1] - cuts[k], zlib.crc32(data[4 * cuts[k] : 4 * cuts[k + 1]])), strict=True):
                        column.append(value)
            yield out

    return work


def lower_bound(sizes: np.ndarray, capacity: int = CAPACITY) -> int:
    """A number of bins that the sizes need at least."""
    return bound_of_counts(np.bincount(sizes, minlength=capacity + 1), capacity) if len(sizes) else 0


def bound_of_counts(count: np.ndarray, capacity: int = CAPACITY) -> int:
    """The best of two families of dual feasible functions, over all their parameters; ``count``: of each size.

    The first drops what is smaller than k and fills up what is larger than the capacity less k; the
    second rounds to multiples of a k-th.
    """
    count = count.astype(np.int64)
    total = np.cumsum(count * np.arange(capacity + 1))
    number = np.cumsum(count)
    k = np.arange(0, capacity // 2 + 1)
    middle = total[capacity - k] - np.where(k > 0, total[np.maximum(k - 1, 0)], 0)
    best = int((-(-(middle + capacity * (number[capacity] - number[capacity - k])) // capacity)).max())
    x = np.arange(capacity + 1)
    for m in range(1, 40):
        scaled = x * (m + 1)
        value = np.where(scaled % capacity == 0, x * m, scaled // capacity * capacity)  # times m
        best = max(best, -(-int((count * value).sum()) // (m * capacity)))
    return best


def best_fit(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Best-fit decreasing: the bin of each item, and the number of bins.

    Open bins stand in lists by what is left in them; a bit set of the lists in use finds the fullest bin
    that still fits in time independent of the number of bins.
    """
    bins = np.zeros(len(sizes), np.int64)
    open_bins: dict[int, list[int]] = {}
    used, made = 0, 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = used >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            stack = open_bins[left]
            b = stack.pop()
            if not stack:
                used &= ~(1 << left)
        else:
            left, b, made = capacity, made, made + 1
        bins[i] = b
        if left > size:
            left -= size
            open_bins.setdefault(left, []).append(b)
            used |= 1 << left
    return bins, made


def _offsets(bins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each item in its bin, gapless in the items' order, and how full its bin is."""
    order = np.argsort(bins, kind="stable")
    ends = np.cumsum(sizes[order])
    sorted_bins = bins[order]
    starts = np.concatenate([[True], sorted_bins[1:] != sorted_bins[:-1]]) if len(order) else np.zeros(0, bool)
    base = np.maximum.accumulate(np.where(starts, ends - sizes[order], 0))
    places = np.empty(len(order), np.int64)
    places[order] = ends - sizes[order] - base
    filled = np.bincount(bins, weights=sizes).astype(np.int64)[bins] if len(bins) else np.zeros(0, np.int64)
    return places, filled


PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PACKED = f"{PIECE}, sequence_id bigint, offset bigint, filled bigint, gap bigint"


def _pack(round_number: int, capacity: int):
    """Pack a partition, or pack it again and keep what was there if that needs no more bins."""

    def work(batches):
        columns = None
        for batch in batches:
            columns = batch if columns is None else [a + b for a, b in zip(columns, batch, strict=True)]
        if columns is None or not columns[0]:
            return
        sizes = np.array(columns[3], np.int64)
        bound = lower_bound(sizes, capacity)
        bins, made = best_fit(sizes, capacity)
        base = (round_number << 56) | (TaskContext.get().partitionId() << 32)
        sequences = bins + base
        if len(columns) > 5:
            before = np.array(columns[5], np.int64)
            names, inverse = np.unique(before, return_inverse=True)
            if len(names) <= made:
                bins, made, sequences = inverse, len(names), before
        places, filled = _offsets(bins, sizes)
        yield [*columns[:5], sequences.tolist(), places.tolist(), filled.tolist(), [made - bound] * len(sizes)]

    return work


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", exchange: bool = True) -> DataFrame:
    """Pieces of all documents with their place: ``PIECE``'s columns, ``sequence_id`` and ``offset``.

    ``filled`` is the sequence's length, ``gap`` the sequences that its partition has above its bound, ``sequences``
    the number of all sequences and ``least_sequences`` the number that no packing goes below.
    """
    pieces = cut(map_columns(docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")), PIECE, _pieces(tokenizer, capacity)))
    # At most one row for each length.
    lengths = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect():
        lengths[r.length] = r.n
    least = bound_of_counts(lengths, capacity)
    packed = cut(map_columns(pieces.repartition(-(-max(1, int(lengths.sum())) // GROUP)), PACKED, _pack(0, capacity)))
    open_ = ((F.col("gap") > 0) & (F.col("filled") < capacity)) | (F.col("filled") * 2 <= capacity)
    number = lambda rows: rows.filter("offset = 0").count()
    done, settled, turn = [], 0, 0
    current = number(packed)
    while exchange and settled + current > least:
        turn += 1
        rows, groups = packed.filter(open_).agg(F.count("*"), F.countDistinct(F.shiftright("sequence_id", 32))).first()
        if groups < 2:
            break
        closed = packed.filter(~open_)
        done.append(closed)
        before = current - number(closed)
        settled += current - before
        dealt = packed.filter(open_).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id").repartition(-(-rows // GROUP), F.xxhash64("sequence_id", F.lit(turn)))
        packed = cut(map_columns(dealt, PACKED, _pack(turn, capacity)))
        current = number(packed)
        if current >= before:
            break
    for other in done:
        packed = packed.unionByName(other)
    return packed.withColumns({"sequences": F.lit(settled + current).cast("bigint"), "least_sequences": F.lit(least).cast("bigint")})


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
