"""Near-duplicate classes by Order MinHash, with candidates verified by banded alignment.

Documents are sequences of lower-cased words. Their items are five-word shingles, labelled by occurrence so that a
repeated shingle counts as often as it occurs. For each of ``SKETCHES`` hash functions a document keeps its
``ORDER`` smallest items in the order in which they stand in the text; texts of at most ``SHORT`` items keep
``SHORT_ORDER`` items, and those of up to a quarter more keep both kinds, so that texts of like length always
have a kind in common. Two documents that agree in a whole sketch are candidates.

A pair is a link if the longest common subsequence of its words, L, gives L / (n1 + n2 - L) >= 0.8, the share of
words that both have in the same order. A pair that reaches this leaves at most a ninth of its words unaligned,
so that the alignment may be banded without loss; cheap exact bounds (lengths, common words) come first. One
changed word spoils five shingles, so the alignment is of words; a pair whose shingles are similar by 0.8 agrees in
no sketch with probability 0.00003 at most, and of pairs of 200 words with 1, 2, 3, 4, 5 % of their words
replaced a test finds 1, 1, 0.98, 0.95 and 0.9 at least.

Classes are the connected components of the links:

1. Documents with equal words are one node; copies are never expanded into pairs.
2. In every bucket of equal sketches each node is compared with the bucket's first node. A bucket of n
   nodes costs n - 1 comparisons, however many of its pairs are links.
3. In buckets whose nodes are then still in different components, another node, chosen by hash for each
   bucket, is compared with those of other components; this is repeated while more pairs than nodes are left and
   it halves them.
4. What is left is compared in full across components. Nodes that are similar by 0.8 share one of the rarest
   fifth of their words (counted, in a table of fixed size, among the nodes that are left), so that only nodes with
   such a word in common stay; texts that share much common matter but little else go here, however many they are. The others are
   dealt to parts by the hashes of these words, so that a pair meets where its words do: a node goes to as many parts as
   it has such words at most, however large its bucket. Pairs are compared inside tasks and are never rows, only links
   leave a task. A part grows with the nodes that have one rare word in common.
5. Components are labelled by rounds of large-star and small-star joins over tables in the shared folder.

Texts with fewer than five words have one item, the text itself. Texts without words are one class. Nulls count as
empty texts. Ids are numbers (or text that casts to bigint). Rows that repeat an id are one document, whose class
is that of any of its texts and whose words, where they differ, are those of its smallest text. Rows with a null
id belong to the class of their text's copies that have an id; without such, equal texts of null ids are a class
with a null ``class_id`` and are compared with no other text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, map_columns

WORDS, SIMILARITY = 5, 0.8
SKETCHES, ORDER, SHORT, SHORT_ORDER = 20, 4, 40, 2
#: Nodes for each part of the full comparison.
BLOCK_NODES = 256
#: Bits of the places at which words are counted.
PLACES_BITS = 20
#: Distinct words whose hashes a worker remembers.
CACHE_WORDS = 400_000
_rng = np.random.default_rng(20)
_ODD = lambda n: _rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHINGLE, _PLACE, _SEED, _LABEL = _ODD(WORDS), _ODD(ORDER), _ODD(SKETCHES), _ODD(1)[0]
_known: dict[str, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def word_hashes(words: list[str]) -> np.ndarray:
    if len(_known) > CACHE_WORDS:
        _known.clear()
    found = list(map(_known.get, words))
    if None in found:
        for k, h in enumerate(found):
            if h is None:
                w = words[k]
                found[k] = _known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
    return np.array(found, np.uint64)


def shingles(hashes: np.ndarray) -> np.ndarray:
    """64-bit hashes of the shingles of words, in the text's order, not labelled yet."""
    n = len(hashes) - WORDS + 1
    if n < 1:
        return _mix((hashes * _SHINGLE[: len(hashes)]).sum(keepdims=True)) if len(hashes) else np.zeros(0, np.uint64)
    total = hashes[:n] * _SHINGLE[0]
    for k in range(1, WORDS):
        total = total + hashes[k : k + n] * _SHINGLE[k]
    return _mix(total)


def labelled(items: np.ndarray) -> np.ndarray:
    """Items made distinct by their occurrence number."""
    order = np.argsort(items, kind="stable")
    ordered = items[order]
    fresh = np.ones(len(items), bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    if fresh.all():
        return items
    at = np.arange(len(items))
    number = at - np.maximum.accumulate(np.where(fresh, at, 0))
    out = items.copy()
    out[order] = _mix(ordered + number.astype(np.uint64) * _LABEL)
    return np.where(np.isin(at, order[number > 0]), out, items)


def sketch(items: np.ndarray) -> np.ndarray:
    """One signed 64-bit number for each hash function and kind; none for an empty text."""
    n = len(items)
    kinds = [SHORT_ORDER] * (0 < n <= SHORT / SIMILARITY) + [ORDER] * (n > SHORT)
    return np.concatenate([np.zeros(0, np.int64), *[_sketch(items, min(size, n)) for size in kinds]])


def _sketch(items: np.ndarray, size: int) -> np.ndarray:
    n = len(items)
    chosen = np.empty((SKETCHES, size), np.int64)
    rows = max(1, min(SKETCHES, (1 << 18) // n))
    for k in range(0, SKETCHES, rows):
        values = _mix(items[None, :] ^ _SEED[k : k + rows, None])
        chosen[k : k + rows] = np.argpartition(values, size - 1, axis=1)[:, :size] if size < n else np.arange(n)
    chosen.sort(axis=1)
    return _mix((items[chosen] * _PLACE[:size]).sum(axis=1) + _SEED + _LABEL * np.uint64(size)).astype(np.int64)


def common_subsequence(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence whose aligned places differ by at most ``band``.

    Equal starts and ends are cut off. The rest is a bit-parallel dynamic program over rows of ``band`` to
    either side of the diagonal.
    """
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b, n = a[head:], b[head:], n - head
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(differ[0]) if len(differ) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return head + tail
    shared = np.intersect1d(a, b)
    at_b = np.flatnonzero(np.isin(b, shared))
    places: dict[int, int] = {}
    width = len(b)
    for v, j in zip(b[at_b].tolist(), at_b.tolist(), strict=True):
        places[v] = places.get(v, 0) | 1 << j
    full = (1 << width) - 1
    row = full
    at_a = np.flatnonzero(np.isin(a, shared))
    for v, i in zip(a[at_a].tolist(), at_a.tolist(), strict=True):
        low, high = max(0, i - band), min(width, i + band + 1)
        hits = places[v]
        if low or high < width:
            hits &= ((1 << high) - 1) >> low << low if high > low else 0
        if hits:
            u = row & hits
            row = ((row + u) | (row - u)) & full
    return head + tail + width - row.bit_count()


def linked(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether two documents' words are similar enough, by exact bounds and then by alignment."""
    n, m = len(a), len(b)
    if not n or not m:
        return n == m
    if min(n, m) < similarity * max(n, m):
        return False
    both = np.concatenate([np.sort(labelled(a)), np.sort(labelled(b))])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    if common < similarity * (n + m - common):
        return False
    spare = n + m - 2 * int(np.ceil(similarity / (1 + similarity) * (n + m) - 1e-9))
    length = common_subsequence(a, b, max(spare, 1))
    return length >= similarity * (n + m - length)


def _words(text: str | None) -> list[str]:
    return (text or "").lower().split()


def _describe(batches):
    for ids, hashes, texts in batches:
        out: list[list] = [[] for _ in range(5)]
        for identifier, h, text in zip(ids, hashes, texts, strict=True):
            words = _words(text)
            found = word_hashes(words)
            row = (identifier, h, xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass")), len(words), sketch(labelled(shingles(found))) if len(words) >= WORDS else [])
            for column, value in zip(out, row, strict=True):
                column.append(value)
        yield out


def _content(batches):
    for ids, texts in batches:
        yield [ids, [word_hashes(_words(t)).tobytes() for t in texts]]


def _places(words: np.ndarray) -> np.ndarray:
    return (_mix(words) >> np.uint64(64 - PLACES_BITS)).astype(np.int64)


def _frequencies(batches):
    """How many nodes have the words of each place."""
    total = np.zeros(1 << PLACES_BITS, np.int64)
    for (items,) in batches:
        for x in items:
            np.add.at(total, _places(labelled(np.frombuffer(x, np.uint64))), 1)
    at = np.flatnonzero(total)
    yield [at.tolist(), total[at].tolist()]


def rare_words(words: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The rarest words that two similar nodes cannot both do without, less those that no other node has.

    ``often``: for each place the number of nodes that have its words, which is no less than that of a word; with
    the word itself it is an order that all nodes share.
    """
    mine = labelled(words)
    count = often[_places(mine)]
    n = len(mine)
    first = np.lexsort((mine, count))[: n - int(np.ceil(SIMILARITY * n - 1e-9)) + 1]
    return mine[first[count[first] > 1]].view(np.int64)


def _across(part: pd.DataFrame, parts: int) -> pd.DataFrame:
    """Links between the components of one part's nodes.

    Only nodes that share a key of this part and a bucket are compared, each pair in the part of the smallest key that
    both have. A link joins its components at once.
    """
    found: list[tuple[int, int]] = []
    items = [np.frombuffer(x, np.uint64) for x in part["items"]]
    rep, size, label = part["rep"].to_numpy(), part["n"].to_numpy(), part["label"].to_numpy().copy()
    here = int(part["part"].iloc[0])
    homes, known = ([set(np.asarray(x).tolist()) for x in part[c]] for c in ("homes", "keys"))
    mine_here = [k[k % parts == here] for k in (np.asarray(k, np.int64) for k in part["keys"])]
    keys = np.concatenate(mine_here)
    owner = np.repeat(np.arange(len(rep)), [len(k) for k in mine_here])
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], owner[order]
    first = np.searchsorted(keys, keys, side="left")
    last = np.searchsorted(keys, keys, side="right")
    of = np.argsort(owner, kind="stable")
    bounds = np.searchsorted(owner[of], np.arange(len(rep) + 1))
    for x in range(len(rep) - 1):
        mine = of[bounds[x] : bounds[x + 1]]
        near = np.unique(np.concatenate([np.zeros(0, np.int64), *[owner[first[k] : last[k]] for k in mine.tolist()]]))
        near = near[near > x]
        ok = (label[near] != label[x]) & (np.minimum(size[near], size[x]) >= SIMILARITY * np.maximum(size[near], size[x]))
        for y in near[ok].tolist():
            if label[y] != label[x] and not homes[x].isdisjoint(homes[y]) and min(known[x] & known[y]) % parts == here and linked(items[x], items[y]):
                found.append((max(rep[x], rep[y]), min(rep[x], rep[y])))
                label[label == label[y]] = label[x]
    return pd.DataFrame(found, columns=["u", "v"], dtype="int64")


def _verify(batches):
    for us, vs, a, b in batches:
        keep = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(a, b, strict=True)]
        yield [[u for u, k in zip(us, keep, strict=True) if k], [v for v, k in zip(vs, keep, strict=True) if k]]


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """``node`` and ``label`` (the component's smallest node) of every node of ``edges`` (u, v).

    Each round points every node's larger neighbours, then its smaller ones, to the smallest node that it
    knows, until the edges are stars. No neighbour list is ever collected, only minima; a round is one query and
    one written table.
    """
    current = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    for _ in range(rounds):
        # In stars every node has one edge to a smaller node or none, and no node has edges of both kinds.
        sides = current.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(current.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if sides.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up + down > 1").isEmpty():
            return current.select(F.col("u").alias("node"), F.col("v").alias("label"))
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        current = cut(small, current)
    raise RuntimeError("components did not settle")


def _rare_words(nodes: DataFrame, content: DataFrame) -> DataFrame:
    """``rep`` and ``keys`` of nodes (``rep``, ``label``) that share a word of their rarest fifth with another one.

    Words are labelled by occurrence and ordered by how many nodes have them, estimated from above by a table of
    fixed size. Two nodes that are similar by ``SIMILARITY`` cannot both have all common words after these first ones.
    Where there are more words than places, words of their own count as shared: more nodes stay, none is lost.
    """
    filled = cut(nodes.select("rep").distinct().join(content.select(F.col("id").alias("rep"), "items"), "rep").select("rep", "items"))
    # At most one row for each place, whatever the nodes.
    found = map_columns(filled.select("items"), "place int, n bigint", _frequencies).groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(1 << PLACES_BITS, np.int64)
    often[found["place"].to_numpy()] = found["n"].to_numpy()
    choose = lambda batches: ([reps, [rare_words(np.frombuffer(x, np.uint64), often) for x in items]] for reps, items in batches)
    return map_columns(filled.select("rep", "items"), "rep bigint, keys array<bigint>", choose).filter(F.size("keys") > 0)


def _classes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``id``, ``h`` (hash of the text), ``words``, ``class_id``, ``class_size`` and ``kept`` of every row."""
    source = docs.select(F.col(key).cast("bigint").alias("id"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("text"))
    described = cut(map_columns(source, "id bigint, h bigint, words binary, n int, sketches array<bigint>", _describe))
    nodes = described.groupBy("words").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sketches").alias("sketches"))
    buckets = cut(nodes.filter("rep is not null").select("rep", "n", F.explode("sketches").alias("b")))
    first = buckets.groupBy("b").agg(F.min("rep").alias("lead"), F.count("*").alias("size")).filter("size > 1")
    crowded = cut(buckets.join(first, "b").select("b", "rep", "n", "lead"), buckets)
    starred = crowded.filter("rep <> lead").select(F.col("rep").alias("u"), F.col("lead").alias("v")).distinct()
    involved = crowded.select(F.col("rep").alias("id")).distinct()
    texts = source.join(involved, "id").groupBy("id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    content = cut(map_columns(texts, "id bigint, items binary", _content))

    def verified(pairs: DataFrame) -> DataFrame:
        joined = pairs.join(content.select(F.col("id").alias("u"), F.col("items").alias("a")), "u").join(content.select(F.col("id").alias("v"), F.col("items").alias("b")), "v")
        return map_columns(joined.select("u", "v", "a", "b"), "u bigint, v bigint", _verify)

    links = cut(verified(starred))
    labels = cut(components(links))
    before, turn = None, 0
    while True:
        placed = cut(crowded.join(labels, crowded.rep == labels.node, "left").select("b", "rep", "n", "lead", F.coalesce("label", "rep").alias("label")))
        parts = placed.groupBy("b", "label").agg(F.count("*").alias("k"))
        mixed = parts.groupBy("b").agg(F.count("*").alias("labels"), ((F.sum("k") * F.sum("k") - F.sum(F.col("k") * F.col("k"))) / 2).alias("across")).filter("labels > 1")
        rest = placed.join(mixed.select("b"), "b")
        left = mixed.agg(F.coalesce(F.sum("across"), F.lit(0))).first()[0]
        if not left:
            break
        last = left <= placed.count() or (before is not None and 2 * left > before)
        before, turn = left, turn + 1
        if last:
            keyed = cut(_rare_words(rest.select("rep", "label").distinct(), content))
            parts = max(1, -(-keyed.count() // BLOCK_NODES))
            homes = rest.groupBy("rep").agg(F.min("n").alias("n"), F.min("label").alias("label"), F.collect_set("b").alias("homes"))
            filled = keyed.join(homes, "rep").join(content.select(F.col("id").alias("rep"), "items"), "rep")
            of_part = F.array_distinct(F.transform("keys", lambda k: F.pmod(k, F.lit(parts).cast("bigint"))))
            dealt = filled.select("rep", "n", "label", "keys", "homes", "items", F.explode(of_part).alias("part"))
            # Little data may be much work, so that partitions are not put together by size.
            spread = dealt.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "part")
            more = cut(spread.groupBy("part").applyInPandas(lambda part: _across(part, parts), "u bigint, v bigint").distinct())
        else:
            close = (F.col("x.n") * SIMILARITY <= F.col("y.n")) & (F.col("y.n") * SIMILARITY <= F.col("x.n"))
            by_chance = F.min(F.struct(F.xxhash64("rep", "b", F.lit(turn)).alias("h"), "rep", "n", "label"))
            chosen = rest.groupBy("b").agg(by_chance.alias("y")).select("b", "y.rep", "y.n", "y.label")
            pairs = rest.alias("x").join(chosen.alias("y"), (F.col("x.b") == F.col("y.b")) & (F.col("x.label") != F.col("y.label")) & close)
            more = cut(verified(pairs.select(F.greatest("x.rep", "y.rep").alias("u"), F.least("x.rep", "y.rep").alias("v")).distinct()))
        if not more.isEmpty():
            stars = labels.select(F.col("node").alias("u"), F.col("label").alias("v"))
            labels = cut(components(stars.unionByName(more)), labels, more, placed)
        if last:
            break
    # Of texts without any id each is a class of its own.
    classes = nodes.join(labels, nodes.rep == labels.node, "left").select("words", "copies", F.coalesce("label", "rep").alias("class_id"))
    classes = classes.withColumn("alone", F.when(F.col("class_id").isNull(), F.col("words")))
    sizes = classes.groupBy(F.col("class_id").alias("c"), F.col("alone").alias("a")).agg(F.sum("copies").alias("class_size"))
    named = classes.join(sizes, F.col("class_id").eqNullSafe(F.col("c")) & F.col("alone").eqNullSafe(F.col("a"))).select("words", "class_id", "class_size")
    kept = F.coalesce(F.col("id") == F.col("class_id"), F.col("class_id").isNull())
    return described.select("id", "h", "words").join(named, "words").select("id", "h", "words", "class_id", "class_size", kept.alias("kept"))


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``class_id`` (smallest id of the class), ``class_size`` (rows) and ``kept`` of every row."""
    return _classes(docs, key, text).select(F.col("id").alias(key), "class_id", "class_size", "kept")


def drop_near(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each class the document with the smallest id, with all of its rows.

    Of texts that only rows with null ids have, one row stays, the one whose values hash lowest.
    """
    id_, h, id2, h2, words, rank = (fresh(docs, x) for x in ("near_id", "near_hash", "near_id2", "near_hash2", "near_words", "near_rank"))
    kept = _classes(docs, key, text).filter("kept").select(F.col("id").alias(id2), F.col("h").alias(h2), F.col("words").alias(words)).distinct()
    whole = docs.withColumn(id_, F.col(key).cast("bigint")).withColumn(h, F.xxhash64(F.col(text)))
    found = whole.join(kept, F.col(id_).eqNullSafe(F.col(id2)) & (F.col(h) == F.col(h2)))
    names = [F.col(f"`{c}`") for c in docs.columns]
    order = Window.partitionBy(words).orderBy(F.xxhash64(*names), *names)
    nameless = found.filter(F.col(id_).isNull()).withColumn(rank, F.row_number().over(order)).filter(F.col(rank) == 1)
    return found.filter(F.col(id_).isNotNull()).select(*names).unionByName(nameless.select(*names))


def op9_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
