"""Line deduplication by content-defined chunks, in DataFrame functions only.

A document's lines are hashed, and a hash that rolls over each two neighbouring lines chooses the chunk
boundaries: a chunk ends after a line where the rolled value is smaller than after the line before and not
larger than after the next one, but neither after the first line nor after the last but one. Boundaries so
depend on the lines around them and not on their place, and an insertion shifts no chunk but its own; every
chunk of a document of two lines or more has two lines or more, three in the mean.

A chunk of two lines or more, not all white space, that occurs more than once in the corpus is kept at
its first place only: in the row with the smallest id, there at its first occurrence. Equality is decided
by grouping on the chunks' bytes; MD5 only names the groups for the join back, and a name that stands for
two different chunks (seen in that same grouping) removes nothing.

Shuffles: the chunks once, with partial aggregation, so that a chunk that a third of all rows share
leaves each task as one row; names and ids once; whole rows once for attaching what to remove. Very
long documents are handled by sorting within the row.

A null text stays null; an empty text is one empty line, which stays. Rows that repeat an id are one document. A
row with a null id is first only where no row has an id. Every row and column is returned, with ``text`` replaced;
columns may have any names and ``key`` any type that can be ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let, table

NEWLINE = "\n"
#: Fixed values of the rolling hash: factor, modulus, and the two that spread it.
ROLL, PRIME, SPREAD, SHIFT = 31, 2147483647, 1103515245, 12345


def _hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("bigint")


def _chunked(docs: DataFrame, text: str, to: str) -> DataFrame:
    """``docs`` with the array ``to``: text, lines and name of each chunk; a chunk that always stays has no name."""
    lines, hashes, rolled, last = (fresh(docs, f"{to}_{x}") for x in ("lines", "hashes", "rolled", "last"))
    out = let(docs, lines, F.split(F.coalesce(F.col(text), F.lit("")), NEWLINE, -1))
    out = let(out, hashes, F.transform(lines, _hash))
    roll = lambda h, i: (((F.get(F.col(hashes), F.greatest(i - 1, F.lit(0))) * ROLL + h) % PRIME) * SPREAD + SHIFT) % PRIME
    out = let(out, rolled, F.transform(hashes, roll)).drop(hashes)
    end = F.size(lines) - 1
    at = lambda i: F.get(F.col(rolled), i)
    lowest = lambda i: (i > 0) & (i < end - 1) & (at(i) < at(F.greatest(i - 1, F.lit(0)))) & (at(i) <= at(i + 1))
    out = let(out, last, F.filter(F.sequence(F.lit(0), end), lambda i: (i == end) | lowest(i))).drop(rolled)
    start = lambda k: F.when(k == 0, 0).otherwise(F.get(F.col(last), F.greatest(k - 1, F.lit(0))) + 1)
    out = let(out, f"{to}_plain", F.transform(last, lambda e, k: F.struct(F.array_join(F.slice(F.col(lines), start(k) + 1, e - start(k) + 1), NEWLINE).alias("text"), (e - start(k) + 1).alias("lines"))))
    counts = lambda c: (c["lines"] > 1) & c["text"].rlike(r"[^\x20\x09-\x0D]")
    named = F.transform(f"{to}_plain", lambda c: F.struct(c["text"].alias("text"), c["lines"].alias("lines"), F.when(counts(c), F.unhex(F.md5(c["text"]))).alias("name")))
    return let(out, to, named).drop(lines, last, f"{to}_plain")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", report: bool = False) -> DataFrame:
    """``docs`` with repeated chunks removed from ``text``; ``report`` adds ``n_lines`` and ``n_removed``."""
    id_, parts, gone, first, own = (fresh(docs, x) for x in ("chunk_id", "chunk_parts", "chunk_gone", "chunk_first", "chunk_own"))
    base = _chunked(docs.select(F.col(key).alias(id_), F.col(text)), text, parts)
    rows = base.select(id_, F.explode(parts).alias("c")).select(id_, F.col("c.name").alias("name"), F.col("c.text").alias("chunk")).filter("name is not null")
    # A chunk's bytes are its group; its name is made again behind the shuffle.
    groups = rows.groupBy("chunk").agg(F.min(id_).alias(first), F.max(id_).alias("high"), F.count("*").alias("n"), F.count(id_).alias("ids")).withColumn("name", F.unhex(F.md5("chunk")))
    names = groups.groupBy("name").agg(F.count("*").alias("texts"), F.min(first).alias(first), F.max("n").alias("n"), F.max("high").alias("high"), F.max("ids").alias("ids"))
    # Repetition within one row needs no table: it is found in the row itself.
    repeated = names.filter(f"texts = 1 and n > 1 and ids > 0 and (high <> {first} or n > ids)").select("name", first)
    members = rows.select(id_, "name").join(repeated, "name").filter(~F.col(id_).eqNullSafe(F.col(first)))
    removal = members.groupBy(F.col(id_).alias(own)).agg(F.collect_set("name").alias(gone))
    whole = _chunked(docs, text, parts).join(removal, F.col(key).eqNullSafe(F.col(own)), "left")
    marks = F.concat(
        F.transform(parts, lambda c, k: F.struct(F.coalesce(c["name"], F.concat(F.lit("#"), k.cast("string")).cast("binary")).alias("name"), k.alias("k"))),
        F.coalesce(F.transform(gone, lambda n: F.struct(n.alias("name"), F.lit(-1).alias("k"))), F.array().cast("array<struct<name:binary,k:int>>")),
    )
    # After sorting, a name's first mark is its removal if there is one, else its first place.
    stay = fresh(docs, "chunk_stay")
    sorted_marks = fresh(docs, "chunk_marks")
    whole = let(whole, sorted_marks, F.array_sort(marks))
    kept = F.filter(sorted_marks, lambda m, i: (m["k"] >= 0) & ((i == 0) | (m["name"] != F.get(F.col(sorted_marks), F.greatest(i - 1, F.lit(0)))["name"])))
    whole = let(whole, stay, F.array_sort(F.transform(kept, lambda m: m["k"])))
    cleaned = F.when(F.col(text).isNotNull(), F.array_join(F.transform(stay, lambda k: F.get(F.col(parts), k)["text"]), NEWLINE))
    out = [cleaned.alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns]
    if report:
        total = F.aggregate(parts, F.lit(0), lambda a, c: a + c["lines"])
        left = F.aggregate(stay, F.lit(0), lambda a, k: a + F.get(F.col(parts), k)["lines"])
        out += [total.cast("bigint").alias("n_lines"), (total - left).cast("bigint").alias("n_removed")]
    return whole.select(*out)


#: From a documents table named by ``{docs}``: d (every row, a row number r, its text) and kept(r, new_text, n_lines, n_removed).
SQL_STAGE = r"""
{p}l AS (SELECT r, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM {docs}),
{p}h AS (SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h FROM {p}l),
{p}v AS (SELECT *, (((coalesce(lag(h) OVER (PARTITION BY r ORDER BY i), h) * 31 + h) % 2147483647) * 1103515245 + 12345) % 2147483647 AS v, count(*) OVER (PARTITION BY r) AS n FROM {p}h),
{p}b AS (SELECT *, CASE WHEN i > 0 AND i < n - 2 AND v < lag(v) OVER (PARTITION BY r ORDER BY i) AND v <= lead(v) OVER (PARTITION BY r ORDER BY i) THEN 1 ELSE 0 END AS ends FROM {p}v),
{p}k AS (SELECT *, coalesce(sum(ends) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM {p}b),
{p}c AS (SELECT r, any_value(doc_id) AS doc_id, k, string_agg(line, chr(10) ORDER BY i) AS chunk, count(*) AS lines FROM {p}k GROUP BY r, k),
{p}m AS (SELECT *, lines > 1 AND regexp_matches(chunk, '[^\x20\x09-\x0D]') AS counts FROM {p}c),
{p}f AS (SELECT chunk, min(doc_id) AS first FROM {p}m WHERE counts GROUP BY chunk),
{p}s AS (SELECT m.*, NOT counts OR ((doc_id = first OR first IS NULL) AND row_number() OVER (PARTITION BY r, m.chunk ORDER BY k) = 1) AS stays FROM {p}m m LEFT JOIN {p}f f ON counts AND m.chunk = f.chunk),
{p}kept AS (SELECT r, coalesce(string_agg(chunk, chr(10) ORDER BY k) FILTER (WHERE stays), '') AS new_text, sum(lines)::BIGINT AS n_lines, coalesce(sum(lines) FILTER (WHERE NOT stays), 0)::BIGINT AS n_removed FROM {p}s GROUP BY r)
"""
ORACLE = (
    "WITH d AS (SELECT row_number() OVER () AS r, * FROM documents),"
    + SQL_STAGE.format(p="x_", docs="d")
    + "SELECT doc_id, CASE WHEN text IS NOT NULL THEN new_text END AS text, n_lines, n_removed FROM d JOIN x_kept USING (r)"
)


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), report=True)
