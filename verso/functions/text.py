"""Scalar text functions as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = r"\p{IsWhite_Space}"
ASCII_WHITE = " \t\n\f\r"
PLACEHOLDER = r"\[placeholder:([a-zA-Z0-9_]+)\]"
#: Zero-width space, non-joiner and joiner, and the byte-order mark.
ZERO_WIDTH = (0x200B, 0x200C, 0x200D, 0xFEFF)
#: Status codes of cached items.
UNTRANSLATED, TRANSLATED, POLISHED, EXCLUDED = 0, 1, 2, 7


def let(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with ``value`` computed once per row, so that lambdas that use it do not repeat it for each element."""
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def trim(c: Column) -> Column:
    """Without Unicode white space at both ends (``F.trim`` strips U+0020 only)."""
    return F.regexp_replace(c, rf"^{WHITE}+|{WHITE}+\z", "")


def trim_ascii(c: Column) -> Column:
    """Without space, tab, line feed, form feed and carriage return at both ends, which is what ``\\s`` means in SQL."""
    return F.regexp_replace(c, rf"^[{ASCII_WHITE}]+|[{ASCII_WHITE}]+\z", "")


def trim_end(c: Column) -> Column:
    return F.regexp_replace(c, rf"{WHITE}+\z", "")


def trim_start(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{WHITE}+", "")


def is_blank(c: Column) -> Column:
    """Whether there is nothing but white space; ends at the first other character."""
    return ~c.rlike(r"\P{IsWhite_Space}")


def remove_zero_width(c: Column) -> Column:
    return F.translate(c, "".join(map(chr, ZERO_WIDTH)), "")


def source_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def final_text(translated: Column, source: Column) -> Column:
    """The translation, or the source where the translation is null or empty."""
    return F.coalesce(F.nullif(translated, F.lit("")), source)


def is_translated(status: Column) -> Column:
    return status.isin(TRANSLATED, POLISHED)


def is_excluded(status: Column) -> Column:
    return status == EXCLUDED


def interleave(texts: Column, between: Column) -> Column:
    """``texts[0] between[0] texts[1] ...``: what is left of a regular-expression replacement with computed parts."""
    return F.array_join(F.zip_with(texts, between, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")


def extract_placeholders(c: Column) -> Column:
    """``struct<text, names>``: placeholders renamed ``ph_0``, ``ph_1``, ... in one pass, and what they were."""
    found = F.regexp_extract_all(c, F.lit(PLACEHOLDER), F.lit(0))
    renamed = F.transform(found, lambda x, i: F.concat(F.lit("[placeholder:ph_"), i.cast("string"), F.lit("]")))
    return F.struct(interleave(F.split(c, PLACEHOLDER, -1), renamed).alias("text"), found.alias("names"))


def restore_placeholders(text: Column, names: Column) -> Column:
    """Inverse of :func:`extract_placeholders`; an unknown number stays as it is."""
    pattern = r"\[placeholder:ph_(\d+)\]"
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    number = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    values = F.zip_with(whole, number, lambda w, n: F.coalesce(F.get(names, F.coalesce(n.try_cast("int"), F.lit(-1))), w))
    return interleave(F.split(text, pattern, -1), values)


def preprocess(c: Column) -> Column:
    return extract_placeholders(remove_zero_width(c))


def output_name(path: Column, extension: str | None = None) -> Column:
    """``{stem}_translated.{ext}`` beside the input."""
    ext = F.lit(extension) if extension else F.regexp_extract(path, r"\.([^./\\]*)$", 1)
    stem = F.regexp_replace(path, r"\.[^./\\]*$", "")
    return F.concat(stem, F.lit("_translated."), ext)


def basename(path: Column, extension: str) -> Column:
    name = F.regexp_extract(F.coalesce(path, F.lit("")), r"([^/\\]+)$", 1)
    return F.when(name == "", F.lit(f"unknown.{extension}")).otherwise(name)


def clean_echo(translation: Column, original: Column) -> Column:
    """A translation without an echo of its source before it: three forms, tried in order."""
    arrow, tight = F.concat(original, F.lit(" -> ")), F.concat(original, F.lit(" ->"))
    after = lambda prefix: F.substr(translation, F.length(prefix) + 1)
    bare = F.ltrim(after(original), F.lit(" ->"))
    return (
        F.when((original == "") | (translation == ""), translation)
        .when(translation.startswith(arrow), after(arrow))
        .when(translation.startswith(tight), trim_start(after(tight)))
        .when(translation.startswith(original) & (F.length(translation) > F.length(original)) & (bare != ""), trim(bare))
        .otherwise(translation)
    )


def code_tag_count(html: Column) -> Column:
    return F.size(F.regexp_extract_all(html, F.lit(r"<code|<pre"), F.lit(0)))


def first_code_text(html: Column) -> Column:
    """Text of the first non-empty code element, ``code`` before ``pre``; null if there is none."""
    inner = lambda tag: trim(F.regexp_extract(html, rf"(?s)<{tag}[^>]*>\s*([^<\s][^<]*)</{tag}>", 1))
    return F.coalesce(F.nullif(inner("code"), F.lit("")), F.nullif(inner("pre"), F.lit("")))
