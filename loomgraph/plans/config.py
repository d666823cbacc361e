"""Settings: what is given outright, else the environment, else a file, else defaults."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Mapping
from dataclasses import dataclass

#: Base address and default model of each provider.
PROVIDERS = {
    "openrouter": ("https://openrouter.ai/api/v1", "google/gemini-2.0-flash-lite-001"),
    "openai": ("https://api.openai.com/v1", "gpt-4o-mini"),
    "groq": ("https://api.groq.com/openai/v1", "llama-3.1-8b-instant"),
    "ollama": ("http://localhost:11434/v1", "llama3.1"),
}


@dataclass(frozen=True)
class Config:
    provider: str
    api_key: str
    model: str
    base_url: str
    output: str = "./graph.json"
    max_concurrent: int = 3
    chunk_size: int = 6000
    yes: bool = False
    dry_run: bool = False
    verbose: bool = False


def _whole(value) -> int | None:
    """The leading digits of a value, or None."""
    found = re.match(r"[0-9]+", str(value).strip()) if value is not None else None
    return int(found.group()) if found else None


def resolve(flags: Mapping | None = None, env: Mapping | None = None, file: str | None = None) -> Config:
    flags, env = flags or {}, os.environ if env is None else env
    stored: dict = {}
    try:
        with open(file or os.path.expanduser("~/.loomgraph/config.json"), encoding="utf-8") as source:
            stored = json.load(source)
    except (OSError, ValueError):
        pass
    provider = flags.get("provider") or env.get("LOOMGRAPH_PROVIDER") or stored.get("provider") or "openrouter"
    url, model = PROVIDERS.get(provider, PROVIDERS["openrouter"])
    key = flags.get("api_key") or env.get("OPENROUTER_API_KEY") or env.get("OPENAI_API_KEY") or stored.get("apiKey") or ""
    return Config(
        provider, key,
        flags.get("model") or env.get("LOOMGRAPH_MODEL") or stored.get("model") or model,
        flags.get("base_url") or env.get("LOOMGRAPH_BASE_URL") or stored.get("baseUrl") or url,
        flags.get("output") or "./graph.json",
        _whole(flags.get("max_concurrent")) or stored.get("maxConcurrent") or 3,
        _whole(flags.get("chunk_size")) or stored.get("chunkSize") or 6000,
        bool(flags.get("yes")), bool(flags.get("dry_run")), bool(flags.get("verbose")),
    )
