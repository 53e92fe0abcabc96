"""Translation models behind one interface, retries, and the batch executor.

Batches go through ``mapInPandas``: a prompt, on failure a sterner prompt, then halves, and a single
segment that still fails goes to the errors. Tasks may be repeated, so calls are at least once; results are
keyed by document and segment and any writer of them must be idempotent.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol
from urllib import error, request

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verso.functions import prompts
from verso.sources.config import LLMConfig

_MARKER = re.compile(r"\[SEG_(\d+)\]")


class TranslationError(Exception):
    def __init__(self, kind: str, message: str) -> None:
        super().__init__(message)
        self.kind = kind


@dataclass(frozen=True)
class Result:
    translated_text: str
    prompt_tokens: int = 0
    completion_tokens: int = 0
    model: str = ""
    finish_reason: str | None = None
    think_content: str | None = None

    @property
    def total_tokens(self) -> int:
        return self.prompt_tokens + self.completion_tokens


class Translator(Protocol):
    def complete(self, system: str, messages: list[dict]) -> Result: ...


@dataclass(frozen=True)
class MarkedTranslator:
    """Deterministic: each marked segment comes back with ``change`` applied; other prompts come back changed whole."""

    change: Callable[[str], str]

    def complete(self, system: str, messages: list[dict]) -> Result:
        prompt = messages[-1]["content"]
        parts = re.split(r"\n\[SEG_(\d+)\]\n", prompt)
        if len(parts) == 1:
            return Result(self.change(prompt), len(prompt), len(prompt), "mock", "stop")
        answer = "".join(f"[SEG_{i}]\n{self.change(t[:-1] if t.endswith(chr(10)) else t)}\n\n" for i, t in zip(parts[1::2], parts[2::2], strict=True))
        return Result(answer, len(prompt), len(answer), "mock", "stop")


def prefix_translator() -> MarkedTranslator:
    return MarkedTranslator(lambda t: f"[TRANSLATED] {t}")


def identity_translator() -> MarkedTranslator:
    return MarkedTranslator(lambda t: t)


@dataclass(frozen=True)
class RefusingTranslator:
    """Fails on prompts that contain a word, else answers as ``inner`` does."""

    inner: Translator
    word: str

    def complete(self, system: str, messages: list[dict]) -> Result:
        if self.word in messages[-1]["content"]:
            raise TranslationError("RequestFailed", f"refused: {self.word}")
        return self.inner.complete(system, messages)


Transport = Callable[[str, dict, bytes, float], tuple[int, str]]


def http_transport(url: str, headers: dict, body: bytes, timeout: float) -> tuple[int, str]:
    try:
        with request.urlopen(request.Request(url, data=body, headers=headers, method="POST"), timeout=timeout) as r:
            return r.status, r.read().decode("utf-8", "replace")
    except error.HTTPError as e:
        return e.code, e.read().decode("utf-8", "replace")
    except TimeoutError as e:
        raise TranslationError("Timeout", f"Timeout: {e}") from e
    except error.URLError as e:
        kind = "Timeout" if isinstance(e.reason, TimeoutError) else "RequestFailed"
        raise TranslationError(kind, f"{'Timeout' if kind == 'Timeout' else 'API request failed'}: {e.reason}") from e


def _post(transport: Transport, url: str, headers: dict, body: dict, timeout: float) -> dict:
    status, text = transport(url, {"content-type": "application/json", **headers}, json.dumps(body, ensure_ascii=False).encode(), timeout)
    if status == 401:
        raise TranslationError("AuthFailed", "Authentication failed: check API key")
    if status == 429:
        raise TranslationError("RateLimited", "Rate limited: please retry later")
    if not 200 <= status < 300:
        raise TranslationError("RequestFailed", f"API request failed: {text}")
    try:
        return json.loads(text)
    except ValueError as e:
        raise TranslationError("ParseResponseFailed", f"Failed to parse API response: {e}") from e


@dataclass(frozen=True)
class OpenAITranslator:
    config: LLMConfig
    transport: Transport = http_transport

    def complete(self, system: str, messages: list[dict]) -> Result:
        c = self.config
        url = c.base_url.rstrip("/") + "/chat/completions" if c.base_url else prompts.OPENAI_URL
        body = {"model": c.model, "messages": [{"role": "system", "content": system}, *messages], "max_tokens": c.max_tokens or prompts.MAX_TOKENS, "temperature": c.temperature}
        found = _post(self.transport, url, {"authorization": f"Bearer {c.api_key}"}, body, c.timeout_secs)
        if not found.get("choices"):
            raise TranslationError("InvalidResponse", "Invalid response format: no choices")
        first, usage = found["choices"][0], found.get("usage") or {}
        return Result((first.get("message") or {}).get("content") or "", usage.get("prompt_tokens", 0), usage.get("completion_tokens", 0), found.get("model", c.model), first.get("finish_reason"))


@dataclass(frozen=True)
class AnthropicTranslator:
    config: LLMConfig
    transport: Transport = http_transport

    def complete(self, system: str, messages: list[dict]) -> Result:
        c = self.config
        url = c.base_url.rstrip("/") + "/v1/messages" if c.base_url else prompts.ANTHROPIC_URL
        body: dict = {"model": c.model, "messages": [{"role": "assistant" if m["role"] == "assistant" else "user", "content": m["content"]} for m in messages], "max_tokens": c.max_tokens or prompts.MAX_TOKENS}
        if system:
            body["system"] = system
        found = _post(self.transport, url, {"x-api-key": c.api_key, "anthropic-version": "2023-06-01"}, body, c.timeout_secs)
        blocks, usage = found.get("content") or [], found.get("usage") or {}
        text = next((b.get("text") or "" for b in blocks if b.get("type") == "text"), "")
        thought = next((b.get("thinking") for b in blocks if b.get("type") == "thinking"), None)
        return Result(text, usage.get("input_tokens", 0), usage.get("output_tokens", 0), found.get("model", c.model), found.get("stop_reason"), thought)


def create(config: LLMConfig, transport: Transport = http_transport) -> Translator:
    """The provider's own client, or the compatible one for all others."""
    return AnthropicTranslator(config, transport) if config.provider_type == "anthropic" else OpenAITranslator(config, transport)


def with_retry(call: Callable[[], Result], retries: int = 3, delay_ms: int = 1000, sleep: Callable[[float], None] = time.sleep) -> Result:
    """Repeat after rate limits and timeouts only, waiting twice as long each time."""
    for attempt in range(retries):
        try:
            return call()
        except TranslationError as e:
            if e.kind not in ("RateLimited", "Timeout") or attempt + 1 == retries:
                raise
            (sleep or time.sleep)(delay_ms / 1000 * 2**attempt)
    raise TranslationError("RequestFailed", "Max retries exceeded")


def parse_response(response: str, expected: list[int], strict: bool = True, white: str | None = None) -> list[str]:
    """Texts in order of their indices; ``strict`` wants exactly the requested ones. ``white``: the characters to trim, else all white space."""
    marks = list(_MARKER.finditer(response))
    if len(marks) != len(expected) or not marks:
        raise ValueError(f"Expected {len(expected)} translations in batch response, but found {len(marks)}")
    ends = [m.start() for m in marks[1:]] + [len(response)]
    found = sorted(((int(m[1]), k, response[m.end() : end].strip(white)) for k, (m, end) in enumerate(zip(marks, ends, strict=True))))
    if found[-1][0] >= 1 << 64:
        raise ValueError("Invalid segment index in response")
    if strict and [i for i, _, _ in found] != sorted(expected):
        raise ValueError("Segment indices differ from those requested")
    return [t for _, _, t in found]


def build_prompt(segments: list[tuple[int, str]], source: str, target: str) -> str:
    head = f"Translate the following {len(segments)} segments from {source} to {target}.\n{prompts.BATCH_RULES}"
    return head + "".join(f"\n[SEG_{i}]\n{t}\n" for i, t in segments)


def translate_batch(translator: Translator, segments: list[tuple[int, str]], source: str, target: str, system: str = prompts.SYSTEM_PROMPT, retries: int = 3, strict: bool = True, sleep: Callable[[float], None] = time.sleep, pause: float = 0.0, white: str | None = None) -> tuple[dict[int, str], dict[int, str], int]:
    """Translations and errors by index, and the number of prompts sent; ``pause``: seconds before each part; ``white``: what is trimmed off answers."""
    done: dict[int, str] = {}
    failed: dict[int, str] = {}
    sent = 0
    queue = [segments]
    while queue:
        part = queue.pop()
        if pause:
            (sleep or time.sleep)(pause)
        if not part:
            continue
        prompt, problem = build_prompt(part, source, target), ""
        for text in (prompt, prompts.RETRY_HEAD + prompt):
            sent += 1
            try:
                answer = with_retry(lambda t=text: translator.complete(system, [{"role": "user", "content": t}]), retries, sleep=sleep)
                done |= dict(zip([i for i, _ in part], parse_response(answer.translated_text, [i for i, _ in part], strict, white), strict=True))
                problem = ""
                break
            except (TranslationError, ValueError) as e:
                problem = str(e)
        if problem and len(part) > 1:
            middle = len(part) // 2
            queue += [part[middle:], part[:middle]]
        elif problem:
            failed[part[0][0]] = problem
    return done, failed, sent


RESULTS = "doc_id bigint, batch_idx int, seg_idx int, translation string, error string, attempts int"


def run_batches(batches: DataFrame, translator: Translator, source: str, target: str, **options) -> DataFrame:
    """``RESULTS`` of batches (``doc_id, batch_idx, segs: array<struct<idx, text>>``).

    The plan must be written before it is used twice: Catalyst may otherwise send prompts again. A task sends one
    prompt at a time, so that the number of partitions bounds the prompts in flight.
    """

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for b in part.itertuples():
                segments = [(int(s["idx"]), s["text"]) for s in b.segs]
                done, failed, sent = translate_batch(translator, segments, source, target, **options)
                rows += [(b.doc_id, b.batch_idx, i, done.get(i), failed.get(i), sent) for i, _ in segments]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RESULTS.split(", ")])

    return batches.select("doc_id", F.col("batch_idx").cast("int"), "segs").mapInPandas(work, RESULTS)
