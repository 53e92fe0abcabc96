"""Prompts, chat bodies and endpoint addresses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim

#: Texts that a model sees.
SYSTEM_PROMPT = "You are a professional translator. Translate the following text accurately."
GLOSSARY_HEAD = "\n\n[Terminology Glossary - follow these term mappings precisely]:\n"
BATCH_RULES = (
    "Each segment is wrapped in [SEG_N] markers.\n"
    "In your response, preserve the [SEG_N] markers exactly.\n"
    "Place each translation immediately after its marker.\n"
    "DO NOT translate code, variable names, or technical identifiers.\n"
)
RETRY_HEAD = (
    "CRITICAL: You must preserve ALL [SEG_N] markers exactly as shown in your response. "
    "Do not skip, merge, or modify any markers.\n\n"
)
PREVIOUS_HEAD = "[Previous translation]:\n"
MAX_TOKENS, TEMPERATURE = 4096, 0.7
OPENAI_URL, ANTHROPIC_URL = "https://api.openai.com/v1/chat/completions", "https://api.anthropic.com/v1/messages"


def system_prompt(prompt: Column, glossary: Column) -> Column:
    blank = F.coalesce(trim(glossary) == "", F.lit(True))
    return F.when(blank, prompt).otherwise(F.concat(prompt, F.lit(GLOSSARY_HEAD), glossary))


def single_prompt(text: Column, source: str, target: str) -> Column:
    return F.concat(F.lit(f"Translate the following from {source} to {target}:\n\n"), text)


def context_message(previous: Column) -> Column:
    return F.concat(F.lit(PREVIOUS_HEAD), previous)


def batch_prompt(segments: Column, source: str, target: str) -> Column:
    """``segments``: array of ``struct<idx, text>`` in order."""
    head = F.concat(F.lit("Translate the following "), F.size(segments).cast("string"), F.lit(f" segments from {source} to {target}.\n{BATCH_RULES}"))
    parts = F.transform(segments, lambda s: F.concat(F.lit("\n[SEG_"), s["idx"].cast("string"), F.lit("]\n"), s["text"], F.lit("\n")))
    return F.concat(head, F.array_join(parts, ""))


def retry_prompt(prompt: Column) -> Column:
    return F.concat(F.lit(RETRY_HEAD), prompt)


def openai_body(model: str, system: Column, messages: Column, max_tokens: int = MAX_TOKENS, temperature: float = TEMPERATURE) -> Column:
    """JSON of a chat request; the system message is always first. ``messages``: array of ``struct<role, content>``."""
    first = F.struct(F.lit("system").alias("role"), system.alias("content"))
    turns = F.transform(messages, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return F.to_json(F.struct(F.lit(model).alias("model"), F.concat(F.array(first), turns).alias("messages"), F.lit(max_tokens).alias("max_tokens"), F.lit(temperature).alias("temperature")))


def anthropic_body(model: str, system: Column, messages: Column, max_tokens: int = MAX_TOKENS) -> Column:
    """JSON of a messages request; the system text only if there is one, and its role becomes the user's."""
    turns = F.transform(messages, lambda m: F.struct(F.when(m["role"] == "assistant", "assistant").otherwise("user").alias("role"), m["content"].alias("content")))
    return F.to_json(F.struct(F.lit(model).alias("model"), F.nullif(system, F.lit("")).alias("system"), turns.alias("messages"), F.lit(max_tokens).alias("max_tokens")))


def endpoint(base_url: Column, path: str, default: str) -> Column:
    return F.coalesce(F.concat(F.rtrim(base_url, F.lit("/")), F.lit(path)), F.lit(default))
