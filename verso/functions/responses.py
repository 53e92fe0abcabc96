"""Model responses: marker parsing, JSON extraction and the status map."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim

MARKER = r"\[SEG_(\d+)\]"


def parse_batch(response: Column, expected: Column, requested: Column | None = None, trimmed: Callable[[Column], Column] = trim) -> Column:
    """``struct<ok: array<struct<idx, text>>, error>`` of a marked response.

    What stands before the first marker is dropped; the rest is trimmed and sorted by index, equal indices
    in order of appearance. ``requested`` (an array of indices) makes the set of indices binding too;
    ``trimmed`` tells what is trimmed.
    """
    numbers = F.transform(F.regexp_extract_all(response, F.lit(MARKER), F.lit(1)), lambda n: n.try_cast("decimal(38,0)"))
    parts = F.split(response, MARKER, -1)
    texts = F.transform(F.slice(parts, F.lit(2), F.size(parts)), trimmed)
    pairs = F.array_sort(F.transform(F.arrays_zip(numbers.alias("idx"), texts.alias("text")), lambda p, k: F.struct(p["idx"].alias("idx"), k.alias("k"), p["text"].alias("text"))))
    found = F.size(numbers)
    overflow = F.exists(numbers, lambda n: n.isNull() | (n > F.lit("18446744073709551615").cast("decimal(38,0)")))
    error = (
        F.when(F.coalesce(overflow, F.lit(False)), F.lit("Invalid segment index in response"))
        .when((found == 0) | (found != expected), F.concat(F.lit("Expected "), expected.cast("string"), F.lit(" translations in batch response, but found "), found.cast("string")))
    )
    if requested is not None:
        wanted = F.array_sort(F.transform(requested, lambda i: i.cast("decimal(38,0)")))
        error = F.coalesce(error, F.when(~F.array_sort(numbers).eqNullSafe(wanted), F.lit("Segment indices differ from those requested")))
    ok = F.transform(pairs, lambda p: F.struct(p["idx"].alias("idx"), p["text"].alias("text")))
    return F.struct(F.when(error.isNull(), ok).alias("ok"), error.alias("error"))


def openai_text(body: Column) -> Column:
    """Content of the first choice, empty if it has none; null if there is no choice."""
    schema = "choices array<struct<message: struct<content: string>, finish_reason: string>>, model string, usage struct<prompt_tokens: int, completion_tokens: int>"
    first = F.get(F.from_json(body, schema)["choices"], 0)
    return F.when(first.isNotNull(), F.coalesce(first["message"]["content"], F.lit("")))


def anthropic_text(body: Column) -> Column:
    """Text of the first text block, empty if there is none."""
    schema = "content array<struct<type: string, text: string, thinking: string>>, model string, stop_reason string"
    blocks = F.from_json(body, schema)["content"]
    return F.coalesce(F.get(F.filter(blocks, lambda b: b["type"] == "text"), 0)["text"], F.lit(""))


def status_error(status: Column, body: Column) -> Column:
    """``struct<kind, message>`` of an HTTP status, null for success."""
    return (
        F.when(status == 401, F.struct(F.lit("AuthFailed").alias("kind"), F.lit("Authentication failed: check API key").alias("message")))
        .when(status == 429, F.struct(F.lit("RateLimited").alias("kind"), F.lit("Rate limited: please retry later").alias("message")))
        .when((status < 200) | (status > 299), F.struct(F.lit("RequestFailed").alias("kind"), F.concat(F.lit("API request failed: "), body).alias("message")))
    )
