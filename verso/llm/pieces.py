"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text is prefixed by a space mark, its spaces become marks, and it falls into words (marks, then other
characters): no piece of the vocabulary has a mark after another character, so that words are encoded
independently. A worker remembers the words that it met lately. All words that are not known yet are merged
together, as one flat array of symbols: every round finds each word's smallest pair rank (a segmented
minimum), merges the leftmost pairs of that rank at once and compacts the arrays; words without a pair
leave. If a merge would make a pair that ranks before the one just merged, the word merges only its
leftmost pair in this round, so that the order is that of one merge at a time. Ranks are looked up in a hash
table of all pairs, once for each symbol and then only beside a merge.

A null text is the empty text, which has the end id alone. Symbols outside the vocabulary become their UTF-8
bytes' pieces. Every row is encoded by itself, so ids may repeat or be null and texts may be equal; ids are numbers
(or text that casts to bigint). A word may be as long as a text: a word of n characters costs n rounds at most.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns

MARK = "▁"
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_DOUBLE = re.compile("  |▁| \\Z")
#: Distinct words that a worker remembers, twice: those met lately and those before them. Words merged together.
CACHE_WORDS, WORDS_AT_ONCE = 150_000, 1 << 13
_NO_RANK = np.iinfo(np.int64).max


class PairTable:
    """Values by 64-bit key (never -1): open addressing with linear probing, all keys looked up together."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray, made: np.ndarray) -> None:
        bits = max(4, int(np.ceil(np.log2(len(keys) * 4 + 1))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.index = np.full(1 << bits, -1), np.full(1 << bits, len(keys))
        self.ranks, self.made = np.append(ranks, _NO_RANK), np.append(made, 0)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = keys[left[free]]
            placed = self.keys[slot] == keys[left]
            self.index[slot[placed]] = left[placed]
            left, slot = left[~placed], (slot[~placed] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each key."""
        slot = self._slot(keys)
        seen = self.keys[slot]
        hit = seen == keys
        found = np.where(hit, self.index[slot], len(self.made) - 1)
        open_ = np.flatnonzero(~hit & (seen != -1) & (keys != -1))
        while len(open_):
            slot_ = slot[open_] = (slot[open_] + 1) & self.mask
            seen = self.keys[slot_]
            hit = seen == keys[open_]
            found[open_[hit]] = self.index[slot_[hit]]
            open_ = open_[~hit & (seen != -1)]
        return self.ranks[found], self.made[found]


class PieceModel:
    """The tables of a BPE model with byte fallback: symbols, pair ranks and decoded bytes."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.end, self.unknown = model.eos_id(), model.unk_id()
        names = [model.id_to_piece(i) for i in range(size)]
        normal = [not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(size)]
        self.byte_ids = np.full(256, self.unknown, np.int64)
        self.bytes: list[bytes] = []
        for i, name in enumerate(names):
            if model.is_byte(i):
                value = int(name[3:5], 16)
                self.byte_ids[value] = i
                self.bytes.append(bytes([value]))
            elif normal[i]:
                self.bytes.append(name.replace(MARK, " ").encode())
            else:
                self.bytes.append(b"")
        self.bytes[self.unknown] = " ⁇ ".encode()
        self.ids = {name: i for i, name in enumerate(names) if normal[i]}
        if any(re.search(f"[^{MARK}]{MARK}", name) for name in self.ids):
            raise ValueError("a piece has a space mark inside; words would not be independent")
        # Every way to cut a piece into two pieces is a pair; its rank is the order of the piece's score, best first, then its id.
        order = sorted(self.ids.values(), key=lambda i: (-model.get_score(i), i))
        score_rank: dict[float, int] = {}
        rank = {i: score_rank.setdefault(model.get_score(i), len(score_rank)) for i in order}
        keys, made, ranks = [], [], []
        for name, i in self.ids.items():
            for k in range(1, len(name)):
                left, right = self.ids.get(name[:k]), self.ids.get(name[k:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    made.append(i)
                    ranks.append(rank[i])
        self.pairs_of = PairTable(np.array(keys, np.int64), np.array(ranks, np.int64), np.array(made, np.int64))

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; ``_NO_RANK`` where the two do not merge.

        Symbols below zero are characters outside the vocabulary; they never merge.
        """
        return self.pairs_of.find(np.where((left >= 0) & (right >= 0), left << 32 | right, -1))

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all the words, one after the other, and each word's number of ids."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        text = "".join(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        odd: list[str] = []
        known = self.ids

        def symbol(c: str) -> int:
            i = known.get(c)
            if i is None:
                odd.append(c)
                return -len(odd)
            return i

        # Each character is looked up once.
        alphabet = {c: symbol(c) for c in set(text)}
        symbols = np.fromiter(map(alphabet.__getitem__, text), np.int64, len(text))
        word = np.repeat(np.arange(len(words)), lengths)
        # Of each symbol and the next one in its word.
        rank, made = self.pairs(symbols, np.append(symbols[1:], -1))
        rank[np.cumsum(lengths) - 1] = _NO_RANK
        finished: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(symbols))))
            live = best != _NO_RANK
            if not live.all():
                finished.append((word[~live], symbols[~live]))
                symbols, word, rank, made, best = symbols[live], word[live], rank[live], made[live], best[live]
                if not len(symbols):
                    break
            # Of touching candidates only every other one, from the left, can merge.
            at = np.flatnonzero(rank == best)
            run_start = np.concatenate([[True], np.diff(at) != 1])
            first = np.maximum.accumulate(np.where(run_start, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            # Where a merge makes a pair that ranks before it, only the word's leftmost merge is sure.
            merged, ranked = made[at], rank[at]
            left, right = np.maximum(at - 1, 0), np.minimum(at + 2, len(word) - 1)
            has_left, has_right = (at > 0) & (word[left] == word[at]), (at + 2 < len(word)) & (word[right] == word[at])
            # A neighbour that merges in this round is met as what it becomes.
            touching = np.concatenate([(np.diff(at) == 2) & (word[at[:-1]] == word[at[1:]]), [False]])
            right_rank, right_made = self.pairs(merged, np.where(has_right, symbols[right], -1))
            left_rank, left_made = self.pairs(np.where(has_left, symbols[left], -1), merged)
            near = np.minimum(left_rank, right_rank)
            if touching.any():
                k = np.flatnonzero(touching)
                both_rank, both_made = self.pairs(merged[k], merged[k + 1])
                near[k] = np.minimum(near[k], both_rank)
            hasty = near < ranked
            if hasty.any():
                unsafe = np.zeros(word[-1] + 1, bool)
                unsafe[word[at][hasty]] = True
                leftmost = np.concatenate([[True], word[at[1:]] != word[at[:-1]]])
                stays = leftmost | ~unsafe[word[at]]
                if touching.any():
                    both = np.full(len(at), -1)
                    both[k] = np.arange(len(k))
                    k = np.flatnonzero(touching & stays & np.append(stays[1:], False))
                    both_rank, both_made = both_rank[both[k]], both_made[both[k]]
                    at, k = at[stays], np.cumsum(stays)[k] - 1
                else:
                    at = at[stays]
                merged, has_left = merged[stays], has_left[stays]
                right_rank, right_made, left_rank, left_made = right_rank[stays], right_made[stays], left_rank[stays], left_made[stays]
            symbols[at] = merged
            rank[at], made[at] = right_rank, right_made
            before = at[has_left] - 1
            rank[before], made[before] = left_rank[has_left], left_made[has_left]
            if touching.any():
                # The place before a merge that follows another one at once is that other's second symbol, which goes.
                rank[at[k]], made[at[k]] = both_rank, both_made
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            symbols, word, rank, made = symbols[stay], word[stay], rank[stay], made[stay]
        flat_word = np.concatenate([w for w, _ in finished]) if finished else np.zeros(0, np.int64)
        flat = np.concatenate([s for _, s in finished]) if finished else np.zeros(0, np.int64)
        by_word = np.argsort(flat_word, kind="stable")
        flat_word, flat = flat_word[by_word], flat[by_word]
        if (flat < 0).any():
            spelled = {-k - 1: self.byte_ids[np.frombuffer(c.encode(), np.uint8)] for k, c in enumerate(odd)}
            counts = np.ones(len(flat), np.int64)
            below = np.flatnonzero(flat < 0)
            counts[below] = [len(spelled[s]) for s in flat[below].tolist()]
            out = np.repeat(flat, counts)
            out[np.repeat(flat < 0, counts)] = np.concatenate([spelled[s] for s in flat[below].tolist()])
            flat_word, flat = np.repeat(flat_word, counts), out
        return flat, np.bincount(flat_word, minlength=len(words))

    def decode(self, ids) -> str:
        """The text of ids: control ids give nothing, the first space mark goes, broken UTF-8 becomes U+FFFD."""
        table = self.bytes
        data = b"".join([table[i] for i in ids])
        first = next((i for i in ids if table[i]), None)
        return _decoded(data[1:] if first is not None and table[first][:1] == b" " and first != self.unknown else data)


def _whole(data: bytes) -> bytes:
    """The UTF-8 of what the bytes decode to, which is the bytes unless some are part of no character."""
    try:
        data.decode()
    except UnicodeDecodeError:
        return _decoded(data).encode()
    return data


def _decoded(data: bytes) -> str:
    """UTF-8 with one U+FFFD for each byte that is part of no character."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(data):
            try:
                out.append(data[at:].decode())
                break
            except UnicodeDecodeError as e:
                out.append(data[at : at + e.start].decode() + "�")
                at += e.start + 1
        return "".join(out)


class PieceEncoder:
    """Texts to ids by way of remembered words; a word stands without its first space mark."""

    def __init__(self, path: str) -> None:
        self.model = PieceModel(path)
        self.names = [str(i) for i in range(len(self.model.bytes))]
        # Ids as text and decoded bytes of the words met lately, and of those met before them. The values are no
        # containers, so that the garbage collector doesn't walk through them.
        self.shown: dict[str, str] = {}
        self.spelled: dict[str, bytes] = {}
        self.older: tuple[dict[str, str], dict[str, bytes]] = ({}, {})

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        if _DOUBLE.search(text) or text[0] == " ":
            return [w[1:] for w in _WORD.findall(MARK + text.replace(" ", MARK))]
        return text.split(" ")

    def look_up(self, words: list[str]) -> tuple[list[str], list[bytes]]:
        """Ids as text and decoded bytes of each word."""
        shown = list(map(self.shown.get, words))
        if None in shown:
            missing = {w for w, f in zip(words, shown, strict=True) if f is None}
            if len(self.shown) + len(missing) > CACHE_WORDS:
                self.older, self.shown, self.spelled = (self.shown, self.spelled), {}, {}
                missing = set(words)
            for mine, old in zip((self.shown, self.spelled), self.older, strict=True):
                mine.update({w: old[w] for w in missing if w in old})
            new = [w for w in missing if w not in self.shown]
            table, names = self.model.bytes, self.names
            for k in range(0, len(new), WORDS_AT_ONCE):
                part = new[k : k + WORDS_AT_ONCE]
                flat, sizes = self.model.encode_words([MARK + w for w in part])
                flat = flat.tolist()
                parts, data = [names[i] for i in flat], [table[i] for i in flat]
                ends = np.cumsum(sizes).tolist()
                starts = [0, *ends]
                self.shown.update(zip(part, [" ".join(parts[a:b]) for a, b in zip(starts, ends)], strict=True))
                self.spelled.update(zip(part, [b"".join(data[a:b]) for a, b in zip(starts, ends)], strict=True))
            shown = [self.shown[w] if f is None else f for w, f in zip(words, shown, strict=True)]
        return shown, list(map(self.spelled.__getitem__, words))

    def encode(self, text: str) -> list[int]:
        return [int(i) for shown in self.look_up(self.words(text))[0] for i in shown.split(" ")]


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


#: Texts are taken in groups of about so many characters, so that memory does not depend on the batch.
CHARS_AT_ONCE = 1 << 20


def encode_texts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Number and digest of every row's ids (an end id last), and digest of the decoded text.

    ``with_ids`` adds the ids and the decoded text themselves. No shuffle.
    """
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    def work(batches):
        own = encoder(path)
        end = str(own.model.end)
        for ids, texts in batches:
            out: list[list] = [[] for _ in range(4 + 2 * with_ids)]
            group, size = [], 0
            for k, (identifier, text) in enumerate(zip(ids, texts, strict=True)):
                group.append((identifier, own.words(text or "")))
                size += len(text or "")
                if size < CHARS_AT_ONCE and k + 1 < len(ids):
                    continue
                shown, spelled = own.look_up([w for _, words in group for w in words])
                at = 0
                for who, words in group:
                    line = " ".join([*shown[at : at + len(words)], end])
                    data = b"".join(spelled[at : at + len(words)])
                    at += len(words)
                    # The space mark before the text is no part of it.
                    data = _whole(data[1:] if data[:1] == b" " else data)
                    row = [who, line.count(" ") + 1, hashlib.sha256(line.encode()).hexdigest(), hashlib.sha256(data).hexdigest()]
                    if with_ids:
                        row += [list(map(int, line.split(" "))), data.decode()]
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                group, size = [], 0
            yield out

    return map_columns(docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")), schema, work)


def op4_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
