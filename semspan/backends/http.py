"""A client for providers that speak the common chat-completions protocol; standard library only."""

from __future__ import annotations

import json
import os
import time
import urllib.request
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from semspan.backends.base import Backend, Prompt, Reply, price_of, rates_of
from semspan.backends.prompts import is_media

#: Provider by prefix of the model's name, with its public address and the variable that holds the key.
PROVIDERS = {
    "gpt": ("https://api.openai.com/v1", "OPENAI_API_KEY"),
    "text-embedding": ("https://api.openai.com/v1", "OPENAI_API_KEY"),
    "deepseek": ("https://api.deepseek.com", "DEEPSEEK_API_KEY"),
    "qwen": ("https://dashscope.aliyuncs.com/compatible-mode/v1", "DASHSCOPE_API_KEY"),
    "gemini": ("https://generativelanguage.googleapis.com/v1beta/openai", "GEMINI_API_KEY"),
}


def provider_of(model: str) -> tuple[str, str]:
    for prefix, found in PROVIDERS.items():
        if model.lower().startswith(prefix):
            return found
    raise ValueError(f"no known provider for model {model!r}")


def media_parts(prompt: Prompt) -> list[dict]:
    """What goes beside the text of a question: images, sound and files, each labelled by its place among the items."""
    parts = []
    for label, kind, value in prompt.items:
        if not is_media(kind, value):
            continue
        parts.append({"type": "text", "text": f"{label}:"})
        head, _, data = value.partition(";base64,")
        if kind == "image":
            parts.append({"type": "image_url", "image_url": {"url": value}})
        elif kind == "audio" and data:
            sound = {"mpeg": "mp3", "x-wav": "wav"}.get(head.rpartition("/")[2], head.rpartition("/")[2])
            parts.append({"type": "input_audio", "input_audio": {"data": data, "format": sound}})
        elif kind == "file" and data:
            parts.append({"type": "file", "file": {"filename": f"{label}.{head.rpartition('/')[2]}", "file_data": value}})
        else:  # an address of sound or a file: providers take the content only, so that the model is told where it is
            parts.append({"type": "text", "text": value})
    return parts


@dataclass(frozen=True)
class HttpBackend(Backend):
    """``key_file`` or the provider's variable holds the key; it is read on the executor and never enters a plan."""

    model: str = "gpt-4o"
    base_url: str | None = None
    key_file: str | None = None
    embedding_model: str = "text-embedding-3-large"
    timeout_seconds: float = 60.0

    #: (input, cached, output) USD per 1,000 tokens of models without a known price.
    prices: tuple[tuple[str, tuple[float, float, float]], ...] = ()

    def __post_init__(self) -> None:
        if self.base_url is None:
            provider_of(self.model)
        self._rates(self.model)

    def _rates(self, model: str) -> dict:
        """A price table that has the model; without one no call is made, since its cost could not be told."""
        own = dict(self.prices)
        return {model: own[model] if model in own else rates_of(model)}

    def _post(self, path: str, model: str, body: dict) -> dict:
        base, variable = (self.base_url, "") if self.base_url else provider_of(model)
        if self.key_file:
            with open(self.key_file, encoding="utf-8") as f:
                key = f.readline().strip()
        else:
            key = os.environ.get(variable, "")
        request = urllib.request.Request(
            f"{base}/{path}",
            json.dumps({"model": model, **body}).encode(),
            {"Content-Type": "application/json", "Authorization": f"Bearer {key}"},
        )
        with urllib.request.urlopen(request, timeout=self.timeout_seconds) as response:  # noqa: S310
            return json.load(response)

    def answer(self, prompt: Prompt, model: str) -> Reply:
        rates = self._rates(model)
        content: list[dict] = [{"type": "text", "text": prompt.text()}, *media_parts(prompt)]
        got = self._post(
            "chat/completions",
            model,
            {
                "messages": [{"role": "user", "content": content}],
                "max_tokens": self.sampling.max_tokens,
                "temperature": self.sampling.temperature,
            },
        )
        usage = got.get("usage", {})
        cached = (usage.get("prompt_tokens_details") or {}).get("cached_tokens", 0)
        cost = price_of(model, usage.get("prompt_tokens", 0), usage.get("completion_tokens", 0), cached, rates)
        return Reply(got["choices"][0]["message"]["content"], cost)

    def complete(self, prompts: Sequence[Prompt], model: str | None = None) -> list[Reply]:
        with ThreadPoolExecutor(max(1, self.max_in_flight)) as pool:
            return list(pool.map(lambda p: self._with_retries(p, model or self.model), prompts))

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        return self.embed_with_cost(texts)[0]

    def embed_with_cost(self, texts: Sequence[str]) -> tuple[list[list[float]], float]:
        """Tried again as often as a question is; the last failure is raised, since there is no vector to give."""
        rates, name = self._rates(self.embedding_model), self.embedding_model
        for attempt in range(self.sampling.attempts):
            try:
                got = self._post("embeddings", name, {"input": list(texts)})
                break
            except Exception:
                if attempt + 1 == self.sampling.attempts:
                    raise
                time.sleep(self.sampling.backoff_seconds * 2**attempt)
        cost = price_of(name, got.get("usage", {}).get("prompt_tokens", 0), 0, 0, rates)
        return [row["embedding"] for row in sorted(got["data"], key=lambda r: r["index"])], cost
