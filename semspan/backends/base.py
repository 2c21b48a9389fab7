"""What an operator asks of a language model, and what it costs.

A backend is a small picklable specification: it travels to the executors inside a UDF and builds
its connections there, once per worker. Calls are made in batches; a backend may run them
concurrently up to its own limit. Failures are answers with a status, never exceptions.
"""

from __future__ import annotations

import re
import time
from collections.abc import Sequence
from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Sampling:
    """Limits of one call. ``attempts`` counts the first try."""

    max_tokens: int = 512
    temperature: float = 0.1
    attempts: int = 3
    backoff_seconds: float = 0.5

    def __post_init__(self) -> None:
        if not 1 <= self.max_tokens <= 16384:
            raise ValueError("max_tokens must be between 1 and 16384")
        if not 0 <= self.temperature <= 1:
            raise ValueError("temperature must be between 0 and 1")
        if not 1 <= self.attempts <= 10:
            raise ValueError("attempts must be between 1 and 10")


@dataclass(frozen=True)
class Prompt:
    """One question. ``items`` are (label, kind, value), kind being 'str', 'numeric', 'image', 'audio' or 'file'."""

    operation: str
    instruction: str
    items: tuple[tuple[str, str, str], ...]
    tags: tuple[str, ...] = ("output",)
    demonstrations: tuple[tuple[tuple[tuple[str, str], ...], str], ...] = ()
    draft: str | None = None
    feedback: str | None = None

    def text(self) -> str:
        """The question as it is sent: task, answer format, demonstrations, data, instruction."""
        from semspan.backends.prompts import render

        return render(self)


@dataclass(frozen=True)
class Reply:
    """``text`` is None when every attempt failed; then ``status`` says why."""

    text: str | None
    cost: float = 0.0
    status: str = "ok"
    calls: int = 1


@dataclass
class Spend:
    """What a plan has cost so far."""

    cost: float = 0.0
    calls: int = 0
    errors: int = 0
    seconds: float = 0.0

    def add(self, cost: float, calls: int, errors: int = 0) -> None:
        self.cost += cost
        self.calls += calls
        self.errors += errors


#: Public list prices in USD per 1,000 tokens (input, cached input, output). A provider without a price for
#: cached tokens charges them as input.
PRICES: dict[str, tuple[float, float, float]] = {
    "gpt-5-2025-08-07": (0.00125, 0.000125, 0.01),
    "gpt-5-mini-2025-08-07": (0.00025, 0.000025, 0.002),
    "gpt-5-nano-2025-08-07": (0.00005, 0.000005, 0.0004),
    "gpt-4.1-2025-04-14": (0.002, 0.0005, 0.008),
    "gpt-4.1-mini-2025-04-14": (0.0004, 0.0001, 0.0016),
    "gpt-4.1-nano-2025-04-14": (0.0001, 0.000025, 0.0004),
    "gpt-4o-2024-08-06": (0.0025, 0.00125, 0.01),
    "gpt-4o-mini-2024-07-18": (0.00015, 0.000075, 0.0006),
    "text-embedding-3-large": (0.00013, 0.00013, 0.0),
    "deepseek-chat": (0.00028, 0.000028, 0.00042),
    "qwen-max-latest": (0.00033, 0.00033, 0.0013),
    "gemini-3-pro": (0.002, 0.0002, 0.012),
    "gemini-2.5-pro": (0.00125, 0.000125, 0.01),
    "gemini-2.5-flash": (0.0003, 0.00003, 0.0025),
}
#: Weakest to strongest.
MODEL_LADDER = ("gpt-4.1-nano", "gpt-4o-mini", "gpt-4.1-mini", "gpt-4.1")


def rates_of(model: str, prices: dict | None = None) -> tuple[float, float, float]:
    """The prices of a model, by its full name or its name without the date; an unknown model is an error."""
    table = PRICES if prices is None else prices
    if model in table:
        return table[model]
    for name, rates in table.items():
        if re.sub(r"-\d{4}-\d{2}-\d{2}$", "", name) == model:
            return rates
    raise KeyError(f"no price is known for model {model!r}")


def price_of(model: str, tokens_in: int, tokens_out: int, cached: int = 0, prices: dict | None = None) -> float:
    """USD of one call; tokens read from a provider's cache cost their own rate."""
    fresh, again, out = rates_of(model, prices)
    return ((tokens_in - cached) * fresh + cached * again + tokens_out * out) / 1000


def parse_tags(text: str | None, tags: Sequence[str]) -> dict[str, str | None]:
    """The stripped content of the first ``<tag>…</tag>`` of each tag; None where there is none."""
    found = {}
    for tag in tags:
        name = re.escape(tag)
        hit = re.search(rf"<{name}>(.*?)</{name}>", text or "", re.DOTALL)
        found[tag] = hit.group(1).strip() if hit else None
    return found


def parse_code(text: str | None, language: str = "python") -> str | None:
    """The first fenced block of a language."""
    hit = re.search(rf"```{re.escape(language)}\s*\n(.*?)```", text or "", re.DOTALL)
    return hit.group(1).strip() if hit else None


@dataclass(frozen=True)
class Backend:
    """Base of all backends: subclasses answer one prompt in ``answer``, or a batch in ``complete``."""

    model: str = "offline"
    sampling: Sampling = field(default_factory=Sampling)
    max_in_flight: int = 16

    def answer(self, prompt: Prompt, model: str) -> Reply:
        raise NotImplementedError

    def complete(self, prompts: Sequence[Prompt], model: str | None = None) -> list[Reply]:
        return [self._with_retries(p, model or self.model) for p in prompts]

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        """A vector for each text. The default is a hashed bag of words: deterministic and offline."""
        return [hashed_embedding(t) for t in texts]

    def embed_with_cost(self, texts: Sequence[str]) -> tuple[list[list[float]], float]:
        """The vectors, and what they cost together."""
        return self.embed(texts), 0.0

    def with_limit(self, calls: int) -> Backend:
        """The same backend with at most ``calls`` calls in flight at once."""
        return replace(self, max_in_flight=calls)

    def _with_retries(self, prompt: Prompt, model: str) -> Reply:
        problem = ""
        for attempt in range(self.sampling.attempts):
            try:
                reply = self.answer(prompt, model)
                return replace(reply, calls=reply.calls + attempt)
            except Exception as error:  # noqa: BLE001 - a failed call is a result
                problem = type(error).__name__
                if attempt + 1 < self.sampling.attempts and self.sampling.backoff_seconds:
                    time.sleep(self.sampling.backoff_seconds * 2**attempt)
        return Reply(None, 0.0, f"error:{problem}", self.sampling.attempts)


def hashed_embedding(text: str, dim: int = 64) -> list[float]:
    import zlib

    vector = [0.0] * dim
    for word in re.findall(r"[^\W_]+", text.lower()):
        code = zlib.crc32(word.encode())
        vector[code % dim] += 1.0 if (code >> 16) & 1 else -1.0
    norm = sum(v * v for v in vector) ** 0.5
    return [v / norm for v in vector] if norm else vector
