"""A chat-completion endpoint as the callable that extractors use."""

from __future__ import annotations

import json
import urllib.request


def chat(base_url: str, api_key: str, model: str, temperature: float = 0.1, timeout: float = 120.0):
    """call(system, user, max_tokens) -> {"content", "usage"}. HTTP errors carry their status in `code`."""

    def call(system: str, user: str, max_tokens: int = 1024) -> dict:
        body = {"model": model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}], "temperature": temperature, "max_tokens": max_tokens}
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {api_key}"} if api_key else {})
        request = urllib.request.Request(f"{base_url}/chat/completions", json.dumps(body).encode(), headers)
        with urllib.request.urlopen(request, timeout=timeout) as response:
            answer = json.load(response)
        return {"content": answer["choices"][0]["message"]["content"], "usage": (answer.get("usage") or {}).get("total_tokens", 0)}

    return call
