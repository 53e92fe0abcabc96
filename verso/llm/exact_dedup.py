"""Exact deduplication by Patricia-trie owners.

Texts are equal when they are identical after each run of white space has become one space. Every task
first inserts its own texts into a compressed radix trie, so that a group of copies leaves the task as
one row. These rows go by (length, content hash) to their owner task, whose trie holds full byte strings
and, at each terminal node, the smallest identifier and the number of rows. Equality is decided by the
tries' byte comparisons; the hash only chooses the owner.

Memory is bounded by ``TRIE_BYTES`` and one text. A first trie that outgrows it is emitted and begun anew (the
owner merges the parts). An owner's trie fixes its heaviest path when it first outgrows the bound; subtrees that
hang off this path are written, largest first, to spill files of their own task, one for each place at which they
leave the path. Each file is settled in a trie of its own when the others are done, where a path that begins deeper
splits it again, so that texts with any common beginning stay within the bound. Rows get their group by a join on
length and SHA-256, which Spark can split at hot keys.

Null texts count as empty. A null ``doc_id`` never stays where another row has an id. Rows that repeat
an id are the same document: they count in ``group_size`` and are kept or dropped together. Ids are integers.
"""

from __future__ import annotations

import itertools
import os
import pickle
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, map_columns

#: Bytes that one trie holds before subtrees leave it, and what a node takes besides its bytes.
TRIE_BYTES, NODE_BYTES = 64 << 20, 400
#: Where keys leave the path that end on it.
ON_PATH = (-1, -1)


class PatriciaTrie:
    """A radix trie over byte strings. A node is [edge, children by first byte, terminal or None].

    A terminal is [smallest id or None, rows, digest].
    """

    def __init__(self) -> None:
        self.root: list = [b"", {}, None]
        self.bytes = 0

    def insert(self, key: bytes, identifier, rows: int, digest) -> None:
        node, at = self.root, 0
        while True:
            if at == len(key):
                break
            child = node[1].get(key[at])
            if child is None:
                child = [key[at:], {}, None]
                node[1][key[at]] = child
                self.bytes += len(key) - at + NODE_BYTES
                node = child
                break
            edge = child[0]
            if key.startswith(edge, at):
                node, at = child, at + len(edge)
                continue
            same = len(os.path.commonprefix((edge, key[at : at + len(edge)])))
            upper = [edge[:same], {edge[same]: child}, None]
            child[0] = edge[same:]
            node[1][key[at]] = upper
            self.bytes += NODE_BYTES
            node, at = upper, at + same
        found = node[2]
        if found is None:
            node[2] = [identifier, rows, digest]
        else:
            found[0] = identifier if found[0] is None else found[0] if identifier is None else min(found[0], identifier)
            found[1] += rows

    @staticmethod
    def walk(node: list, prefix: bytes) -> Iterator[tuple[bytes, list]]:
        """Every terminal below ``node`` with its full key, without recursion: keys can be very long."""
        stack = [(node, prefix)]
        while stack:
            node, prefix = stack.pop()
            key = prefix + node[0]
            if node[2] is not None:
                yield key, node[2]
            stack += [(child, key) for child in node[1].values()]

    def terminals(self) -> Iterator[tuple[int, list]]:
        """Every terminal with its key's length."""
        stack = [(self.root, 0)]
        while stack:
            node, size = stack.pop()
            size += len(node[0])
            if node[2] is not None:
                yield size, node[2]
            stack += [(child, size) for child in node[1].values()]

    @staticmethod
    def size(node: list) -> int:
        """Bytes of a subtree."""
        total, stack = 0, [node]
        while stack:
            node = stack.pop()
            total += len(node[0]) + NODE_BYTES
            stack += node[1].values()
        return total

    def heavy_path(self, least: int) -> bytes:
        """From the root down to the largest child each time, while that has more than ``least`` bytes."""
        node, path = self.root, b""
        while node[1]:
            size, child = max(((self.size(c), c) for c in node[1].values()), key=lambda x: x[0])
            if size <= least:
                break
            node, path = child, path + child[0]
        return path

    def hanging(self, path: bytes) -> list[tuple[tuple[int, int], bytes, dict, int]]:
        """The subtrees off ``path``: where and by which byte they leave it, their parent's key, and their parent's children."""
        found, node, at = [], self.root, 0
        while node is not None:
            follow = None
            for byte, child in node[1].items():
                edge = child[0]
                same = len(os.path.commonprefix((edge, path[at : at + len(edge)])))
                if same == len(edge):
                    follow = child
                else:
                    found.append(((at + same, edge[same]), path[:at], node[1], byte))
            node, at = follow, at + (len(follow[0]) if follow else 0)
        return found


def _local(batches):
    """One row for each distinct text that a task holds at a time: text, digest, smallest id, rows."""

    def rows(trie):
        found = trie.walk(trie.root, b"")
        while part := list(itertools.islice(found, 2000)):
            yield [[key.decode("utf-8", "surrogatepass") for key, _ in part], [t[2] for _, t in part], [t[0] for _, t in part], [t[1] for _, t in part]]

    trie = PatriciaTrie()
    for ids, texts, digests in batches:
        for identifier, text, digest in zip(ids, texts, digests, strict=True):
            trie.insert(text.encode("utf-8", "surrogatepass"), identifier, 1, digest)
            if trie.bytes > TRIE_BYTES:
                yield from rows(trie)
                trie = PatriciaTrie()
    yield from rows(trie)


def _settle(items, folder: str, watch=None, longest: int | None = None):
    """Digest, length, smallest id and rows of each distinct key of ``items`` (key, id, rows, digest).

    Keys that end on the path leave together, for a trie whose path is at most half as long (``longest``).
    ``watch`` is told the bytes held after each insertion.
    """
    trie, path = PatriciaTrie(), None
    files: dict[tuple[int, int], str] = {}

    def write(place, found):
        with open(files.setdefault(place, f"{folder}/{uuid.uuid4().hex}"), "ab") as out:
            for whole, (identifier, count, digest) in found:
                pickle.dump((whole, identifier, count, digest), out)

    def spill(place, key, children, byte):
        write(place, trie.walk(children[byte], key))
        trie.bytes -= trie.size(children.pop(byte))

    for item in items:
        trie.insert(*item)
        if trie.bytes > TRIE_BYTES:
            path = trie.heavy_path(TRIE_BYTES // 4)[:longest] if path is None else path
            for size, where in sorted(((trie.size(w[2][w[3]]), w) for w in trie.hanging(path)), key=lambda x: -x[0]):
                if trie.bytes <= TRIE_BYTES // 2:
                    break
                spill(*where)
            if trie.bytes > TRIE_BYTES and len(list(itertools.islice(trie.terminals(), 2))) == 2:
                write(ON_PATH, trie.walk(trie.root, b""))
                trie = PatriciaTrie()
        if watch is not None:
            watch(trie.bytes)
    if files:
        for where in trie.hanging(path):
            if where[0] in files:
                spill(*where)
    if ON_PATH in files:
        write(ON_PATH, trie.walk(trie.root, b""))
        trie = PatriciaTrie()
    found = trie.terminals()
    while part := list(itertools.islice(found, 10_000)):
        yield [[t[2] for _, t in part], [size for size, _ in part], [t[0] for _, t in part], [t[1] for _, t in part]]
    del trie, found
    for place, name in files.items():
        yield from _settle(_spilled(name), folder, watch, len(path) // 2 if place == ON_PATH else None)
        os.remove(name)


def _spilled(name: str):
    with open(name, "rb") as source:
        while True:
            try:
                yield pickle.load(source)
            except EOFError:
                return


def _owner(batches):
    """One row for each distinct text: digest, length in bytes, smallest id, rows."""

    def items():
        for texts, digests, ids, counts in batches:
            for text, digest, identifier, count in zip(texts, digests, ids, counts, strict=True):
                yield text.encode("utf-8", "surrogatepass"), identifier, count, digest

    with tempfile.TemporaryDirectory() as folder:
        yield from _settle(items(), folder)


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``."""
    normal = docs.select(F.col(key).alias("doc_id"), F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, " ").alias("body"))
    normal = normal.select("doc_id", "body", F.sha2("body", 256).alias("text_sha256"))
    local = map_columns(normal, "body string, text_sha256 string, keep_id bigint, n bigint", _local)
    dealt = local.repartition(F.octet_length("body"), F.col("text_sha256"))
    groups = map_columns(dealt, "text_sha256 string, bytes bigint, keep_id bigint, group_size bigint", _owner)
    rows = normal.select("doc_id", "text_sha256", F.octet_length("body").cast("long").alias("bytes"))
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull())
    return rows.join(groups, ["text_sha256", "bytes"]).select(F.col("doc_id").alias(key), "keep_id", "group_size", kept.alias("kept"), "text_sha256")


ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
g AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY body)
SELECT doc_id, keep_id, group_size, coalesce(doc_id = keep_id, keep_id IS NULL) AS kept, sha256(n.body) AS text_sha256
FROM n JOIN g ON n.body = g.body
"""


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
