"""Language-model backends: the protocol, an offline rule backend, scripted answers, a cache and an HTTP client."""

from semspan.backends.base import Backend, Prompt, Reply, Sampling, Spend, parse_code, parse_tags, price_of
from semspan.backends.local import CachedBackend, FailingBackend, RuleBackend, ScriptedBackend

__all__ = [
    "Backend",
    "CachedBackend",
    "FailingBackend",
    "Prompt",
    "Reply",
    "RuleBackend",
    "Sampling",
    "ScriptedBackend",
    "Spend",
    "configure",
    "current_backend",
    "parse_code",
    "parse_tags",
    "price_of",
]

_current: dict[str, Backend] = {}


def configure(backend: Backend) -> Backend:
    """Sets the backend that operators use when none is given."""
    _current["backend"] = backend
    return backend


def current_backend() -> Backend:
    return _current.get("backend") or configure(RuleBackend())
