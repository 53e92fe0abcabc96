"""Model configurations, prompt and glossary of a driver; keys never reach a file."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, replace

from verso.functions.prompts import MAX_TOKENS, SYSTEM_PROMPT, TEMPERATURE

#: Provider names and their codes.
PROVIDERS = {"openai": 0, "anthropic": 1, "google": 2, "amazonbedrock": 3, "localllm": 4, "sakura": 5}


def parse_provider(name: str) -> str:
    low = name.lower()
    if low not in PROVIDERS:
        raise ValueError(f"unknown provider: {name}")
    return low


@dataclass(frozen=True)
class LLMConfig:
    name: str = "default"
    provider_type: str = "openai"
    model: str = "gpt-4"
    api_key: str = field(default="", repr=False)
    base_url: str | None = None
    max_tokens: int | None = MAX_TOKENS
    temperature: float = TEMPERATURE
    timeout_secs: int = 120

    def validate(self) -> None:
        if not self.api_key:
            raise ValueError("the API key is empty")
        if not self.model:
            raise ValueError("the model is empty")


@dataclass
class Settings:
    """Prompt, glossary and the list of configurations, of which one is active."""

    system_prompt: str = SYSTEM_PROMPT
    glossary: str = ""
    configs: list[LLMConfig] = field(default_factory=lambda: [LLMConfig()])
    active: int = 0

    def current(self) -> LLMConfig:
        return self.configs[self.active]

    def update(self, **changes) -> None:
        self.configs[self.active] = replace(self.current(), **changes)

    def add(self, config: LLMConfig) -> None:
        self.configs.append(config)
        self.active = len(self.configs) - 1

    def remove(self, index: int) -> None:
        if not 0 <= index < len(self.configs):
            raise IndexError(f"no configuration {index}")
        if len(self.configs) == 1:
            raise ValueError("the last configuration stays")
        del self.configs[index]
        if self.active > index or self.active >= len(self.configs):
            self.active = max(0, self.active - 1)

    def activate(self, index: int) -> None:
        if not 0 <= index < len(self.configs):
            raise IndexError(f"no configuration {index}")
        self.active = index

    def save(self, path: str) -> None:
        plain = [{k: v for k, v in asdict(c).items() if k != "api_key"} for c in self.configs]
        with open(path, "w", encoding="utf-8") as f:
            json.dump({"system_prompt": self.system_prompt, "glossary": self.glossary, "llm_configs": plain, "active_llm_index": self.active}, f, ensure_ascii=False, indent=2)

    @classmethod
    def load(cls, path: str, glossary_path: str | None = None, key: str = "") -> Settings | None:
        """None without a file; an index out of bounds becomes 0; an empty glossary falls back to its own file."""
        if not os.path.exists(path):
            return None
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        configs = [LLMConfig(**c, api_key=key) for c in data.get("llm_configs", [])] or [LLMConfig(api_key=key)]
        active = data.get("active_llm_index", 0)
        glossary = data.get("glossary", "") or (load_glossary(glossary_path) if glossary_path else "")
        return cls(data["system_prompt"], glossary, configs, active if 0 <= active < len(configs) else 0)


def save_glossary(path: str, text: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def load_glossary(path: str) -> str:
    if not os.path.exists(path):
        return ""
    with open(path, encoding="utf-8") as f:
        return f.read()
