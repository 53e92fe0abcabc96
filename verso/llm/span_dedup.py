"""Substring deduplication by sliding sentence spans.

A text is cut into sentences: after ``.``, ``!`` or ``?`` and the white space behind it, and at a line's end.
A sentence of more than ``LONG`` words is cut further, after each word whose hash (taken with the word before
it) is the smallest among its ``REACH`` neighbours to either side, and where that gives no cut for ``MOST``
words, after those. Such cuts depend on the words around them only, so that a passage that two texts
share is cut alike in both, whatever stands before it. From every sentence starts a span: the shortest run
of at least two sentences that has at least ``SPAN_WORDS`` words. Spans are hashed over their sentences'
texts and joined over the whole corpus. Sentences covered by a span that is not the first of its kind (the
smallest id, there the first place) are removed; everything else stays, byte for byte.

A passage of more than 50 words that is repeated contains at least one whole span: at either end it loses what
belongs to a sentence that is cut differently, about ``LONG`` words at most.

One pass in Python makes the spans, written as one array for each document; the join is Spark's: a
grouping with partial aggregation for the first places, then a join that Spark may split at hot keys. A
last pass cuts the texts at the places found. Repetitions within one document are found in its own pass.

A null text stays null; rows that repeat an id are one document, told apart by their text's hash where
they differ; a row with a null id is first only where no row has an id. Ids are numbers (or text that casts to
bigint). Other columns pass through, whatever their names.
"""

from __future__ import annotations

import re
from itertools import chain
from zlib import crc32

import numpy as np
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, map_columns, table

SPAN_WORDS, LONG, REACH, MOST = 24, 12, 3, 16
_SENTENCE = re.compile(r"[^.!?\n]*(?:[.!?]+\s*|\n\s*|\Z)")
_WORDS = re.compile(r"\S+\s*")
#: Odd factors of the two rolling hashes of a run of words, and their inverses modulo 2**64.
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_INVERSES = {x: pow(x, -1, 1 << 64) for x in _FACTORS}
_powers: dict[int, np.ndarray] = {}


def _power(factor: int, n: int) -> np.ndarray:
    """Powers 0 to n - 1 of the factor."""
    found = _powers.get(factor)
    if found is None or len(found) < n:
        found = np.full(max(n, 4096), factor, np.uint64)
        found[0] = 1
        found = _powers[factor] = np.multiply.accumulate(found)
    return found[:n]


def _encoded(words: list[list[str]]) -> list[bytes]:
    """All the words in UTF-8; none has white space."""
    flat = "\n".join(chain.from_iterable(words))
    return flat.encode("utf-8", "surrogatepass").split(b"\n") if flat else []


def piece_ends(sizes: np.ndarray, encoded: list[bytes]) -> np.ndarray:
    """The numbers of words after which the words are cut: sentence ends, and the cuts of long sentences."""
    ends = np.cumsum(sizes)
    if not (sizes > LONG).any():
        return ends[sizes > 0]
    hashes = np.fromiter(map(crc32, encoded), np.int64, len(encoded))
    n, sentence = len(hashes), np.repeat(np.arange(len(sizes)), sizes)
    pairs = hashes.copy()
    pairs[1:] += np.where(sentence[1:] == sentence[:-1], hashes[:-1], 0) * 31
    pairs %= 2147483647
    low = (sizes > LONG)[sentence]
    for k in range(1, REACH + 1):
        apart = sentence[k:] != sentence[:-k]
        low[k:] &= apart | (pairs[k:] < pairs[:-k])
        low[: n - k] &= apart | (pairs[: n - k] <= pairs[k:])
    found = np.unique(np.concatenate([np.flatnonzero(low) + 1, ends[sizes > 0]]))
    wide = np.flatnonzero(np.diff(found, prepend=0) > MOST)
    if len(wide):
        forced = [np.arange((found[k - 1] if k else 0) + MOST, found[k], MOST) for k in wide.tolist()]
        found = np.union1d(found, np.concatenate(forced))
    return found


def sentences(text: str) -> tuple[list[str], list[int]]:
    """The sentences with what follows them, which together are the text, and their numbers of words."""
    parts = _SENTENCE.findall(text)
    words = [p.split() for p in parts]
    cuts = piece_ends(np.fromiter(map(len, words), np.int64, len(words)), _encoded(words)).tolist()
    out, sizes, at, k = [], [], 0, 0
    for part, own in zip(parts, words, strict=True):
        n = len(own)
        if n > LONG:
            pieces = _WORDS.findall(part)
            lead, last = part[: len(part) - sum(map(len, pieces))], 0
            while last < n:
                c = cuts[k] - at
                out.append((lead if last == 0 else "") + "".join(pieces[last:c]))
                sizes.append(c - last)
                last, k = c, k + 1
        elif part:
            out.append(part)
            sizes.append(n)
            k += n > 0
        at += n
    return out, sizes


def spans(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last piece (of those with words) of each span; the spans' hashes as two columns.

    A span's hash is that of its words, whatever the pieces that it is made of.
    """
    words = [p.split() for p in _SENTENCE.findall(text)]
    encoded = _encoded(words)
    ends = piece_ends(np.fromiter(map(len, words), np.int64, len(words)), encoded)
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    last = np.maximum(np.searchsorted(ends, starts + SPAN_WORDS), np.arange(1, len(ends) + 1))
    first = np.flatnonzero(last < len(ends))
    last = last[first]
    if not len(first):
        return first, last, np.zeros(0, np.int64), np.zeros(0, np.int32)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, encoded), np.uint64, len(encoded))
    a, b = starts[first], ends[last]
    values = []
    for factor in _FACTORS:
        total = np.concatenate([[np.uint64(0)], np.cumsum(hashes * _power(factor, len(hashes)))])
        value = (total[b] - total[a]) * _power(_INVERSES[factor], len(hashes))[a]
        value ^= value >> np.uint64(32)
        values.append(value * np.uint64(_FACTORS[0]) + (b - a).astype(np.uint64))
    return first, last, values[0].view(np.int64), (values[1] >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _kinds(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each span of a text, the number of its kind, in order of first places."""
    kinds: dict[tuple[int, int], int] = {}
    return np.array([kinds.setdefault(k, len(kinds)) for k in zip(low.tolist(), high.tolist(), strict=True)], np.int64)


def _describe(batches):
    row = TaskContext.get().partitionId() << 33
    for ids, texts, hashes in batches:
        out: list[list] = [[] for _ in range(6)]
        for identifier, text, h in zip(ids, texts, hashes, strict=True):
            _, _, low, high = spans(text or "")
            n = len(low)
            if n and len(np.unique(low)) < n:
                _, place = np.unique(_kinds(low, high), return_index=True)
                low, high = low[place], high[place]
            for column, value in zip(out, (row, identifier, h, low, high, len(low) < n), strict=True):
                column.append(value)
            row += 1
        yield out


def cut_text(text: str, gone: set[int]) -> tuple[str, int]:
    """The text without the sentences of spans whose kinds are in ``gone`` or that are not the first of their kind, and the number of words removed."""
    first, last, low, high = spans(text)
    seen = set(gone)
    hit = []
    for a, b, k in zip(first.tolist(), last.tolist(), _kinds(low, high).tolist(), strict=True):
        if k in seen:
            hit.append((a, b))
        seen.add(k)
    if not hit:
        return text, 0
    parts, sizes = sentences(text)
    places = np.flatnonzero(sizes)
    drop = np.zeros(len(parts) + 1, np.int64)
    for a, b in hit:
        drop[places[a]] += 1
        drop[places[b] + 1] -= 1
    away = np.cumsum(drop)[:-1] > 0
    removed = int(np.array(sizes)[away].sum())
    return "".join(p for p, x in zip(parts, away, strict=True) if not x), removed


def dedup_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", report: bool = False) -> DataFrame:
    """``docs`` with the covered sentences removed from ``text``; ``report`` adds ``removed_words``."""
    source = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("h"))
    made = cut(map_columns(source, "r bigint, id bigint, h bigint, low array<bigint>, high array<int>, again boolean", _describe))
    placed = made.select("r", "id", F.posexplode(F.arrays_zip("low", "high")).alias("k", "s"))
    # The upper half of a hash and the span's number travel as one.
    rows = placed.select("r", F.col("s.low").alias("low"), (F.shiftleft(F.col("s.high").cast("bigint"), 32) + F.col("k")).alias("hk"))
    first = placed.groupBy(F.col("s.low").alias("low"), F.col("s.high").alias("high")).agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").select("low", "high", "first")
    hits = rows.join(first, (rows.low == first.low) & (F.shiftright(rows.hk, 32).cast("int") == first.high)).select("r", F.col("hk").bitwiseAND(0x7FFFFFFF).cast("int").alias("k"), "first")
    away = hits.join(made.select("r", "id", "h"), "r").filter(~F.col("id").eqNullSafe(F.col("first"))).groupBy("id", "h").agg(F.collect_set("k").alias("gone"))
    within = made.filter("again").select("id", "h", F.array().cast("array<int>").alias("gone"))
    removal = away.unionByName(within).groupBy("id", "h").agg(F.flatten(F.collect_list("gone")).alias("gone"))
    id_, h, gone, k2, h2 = (fresh(docs, x) for x in ("span_id", "span_hash", "span_gone", "span_id2", "span_hash2"))
    whole = docs.withColumn(id_, F.col(key).cast("bigint")).withColumn(h, F.xxhash64(F.col(text)))
    named = removal.select(F.col("id").alias(k2), F.col("h").alias(h2), F.col("gone").alias(gone))
    joined = whole.join(named, F.col(id_).eqNullSafe(F.col(k2)) & (F.col(h) == F.col(h2)), "left")
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join(f"`{c}` {fields[c]}" for c in docs.columns) + ", removed_words bigint" * report

    docs_columns = list(docs.columns)

    def work(batches):
        at = docs_columns.index(text)
        for columns in batches:
            gone_lists = columns[-1]
            results = [(t, 0) if t is None or g is None else cut_text(t, set(g)) for t, g in zip(columns[at], gone_lists, strict=True)]
            out = list(columns[:-1])
            out[at] = [r[0] for r in results]
            yield [*out, [r[1] for r in results]] if report else out

    return map_columns(joined.select(*[F.col(f"`{c}`") for c in docs_columns], gone), schema, work)


#: The same by text instead of hashes: sentences, spans, first places and what they leave.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
s AS (SELECT r, part, row_number() OVER (PARTITION BY r ORDER BY i) AS i FROM (
  SELECT r, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM (SELECT r, regexp_extract_all(coalesce(text, ''), '[^.!?\n]*(?:[.!?]+\s*|\n\s*|\z)') AS parts FROM d)) WHERE part <> ''),
wd AS (SELECT r, i, part, regexp_extract_all(part, '\S+\s*') AS ws FROM s),
tw AS (SELECT r, i, unnest(ws) AS tok, generate_subscripts(ws, 1) AS j, len(ws) AS n FROM wd WHERE len(ws) > 12),
bits AS (SELECT b, list_reduce(list_prepend(b::BIGINT, range(8)), lambda a, i: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS t FROM range(256) x(b)),
crc AS (SELECT list(t ORDER BY b) AS tab FROM bits),
dw AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, [('0x' || x)::BIGINT FOR x IN regexp_extract_all(hex(encode(word)), '..')]), lambda a, x: xor(a >> 8, tab[1 + xor(a, x) % 256])), 4294967295) AS h
  FROM (SELECT DISTINCT rtrim(tok, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS word FROM tw), crc),
th AS (SELECT tw.*, h FROM tw JOIN dw ON word = rtrim(tok, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))),
tp AS (SELECT r, i, j, n, tok, (coalesce(lag(h) OVER (PARTITION BY r, i ORDER BY j), 0) * 31 + h) % 2147483647 AS h FROM th),
tl AS (SELECT *, j < n AND h < coalesce(min(h) OVER (PARTITION BY r, i ORDER BY j ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 1099511627776)
  AND h <= coalesce(min(h) OVER (PARTITION BY r, i ORDER BY j ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), 1099511627776) AS low FROM tp),
tg AS (SELECT *, j - 1 - coalesce(max(CASE WHEN low THEN j END) OVER (PARTITION BY r, i ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS since FROM tl),
tk AS (SELECT *, sum(CASE WHEN since % 16 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY r, i ORDER BY j) AS k FROM tg),
c AS (SELECT r, i, 0 AS k, part AS p, len(ws) AS n FROM wd WHERE len(ws) <= 12 UNION ALL
  SELECT tk.r, tk.i, k, CASE WHEN k = 1 THEN regexp_extract(any_value(part), '^\s*') ELSE '' END || string_agg(tok, '' ORDER BY j), count(*) FROM tk JOIN wd ON wd.r = tk.r AND wd.i = tk.i GROUP BY tk.r, tk.i, k),
q AS (SELECT r, row_number() OVER (PARTITION BY r ORDER BY i, k) AS pos, p, n FROM c),
w AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY pos) AS j, sum(n) OVER (PARTITION BY r ORDER BY pos) AS cum, array_to_string(regexp_extract_all(p, '\S+'), ' ') AS bare FROM q WHERE n > 0),
m AS (SELECT a.r, a.j, min(b.j) AS reach FROM w a JOIN w b ON b.r = a.r AND b.cum >= a.cum - a.n + 24 GROUP BY a.r, a.j),
e AS (SELECT m.r, m.j AS a, greatest(reach, m.j + 1) AS b FROM m),
sp AS (SELECT e.r, e.a, min(w.pos) AS pa, max(w.pos) AS pb, string_agg(w.bare, ' ' ORDER BY w.j) AS t FROM e JOIN w ON w.r = e.r AND w.j BETWEEN e.a AND e.b JOIN w z ON z.r = e.r AND z.j = e.b GROUP BY e.r, e.a),
f AS (SELECT t, min(doc_id) AS first FROM sp JOIN d USING (r) GROUP BY t),
o AS (SELECT sp.*, doc_id, first, row_number() OVER (PARTITION BY r, t ORDER BY a) AS nth FROM sp JOIN d USING (r) JOIN f USING (t)),
gone AS (SELECT DISTINCT q.r, q.pos FROM q JOIN o ON q.r = o.r AND q.pos BETWEEN pa AND pb WHERE nth > 1 OR (first IS NOT NULL AND doc_id IS DISTINCT FROM first)),
kept AS (SELECT q.r, coalesce(string_agg(p, '' ORDER BY q.pos) FILTER (WHERE gone.r IS NULL), '') AS t, coalesce(sum(n) FILTER (WHERE gone.r IS NOT NULL), 0)::BIGINT AS removed_words FROM q LEFT JOIN gone ON q.r = gone.r AND q.pos = gone.pos GROUP BY q.r)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(t, '') END AS text, coalesce(removed_words, 0) AS removed_words FROM d LEFT JOIN kept USING (r)
"""


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Every row with its remaining text and the number of words removed."""
    return dedup_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), report=True)
