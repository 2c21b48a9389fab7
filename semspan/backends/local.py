"""Backends without a network: rules, scripted answers, failures, and a cache around any other."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from semspan.backends import grammar
from semspan.backends.base import Backend, Prompt, Reply
from semspan.backends.prompts import read_back


@dataclass(frozen=True)
class RuleBackend(Backend):
    """Answers rendered questions by the grammar of instructions, at a fixed price per call.

    A test double: it goes the whole way from rendered question to tagged reply, and says
    nothing about the quality of any language model.
    """

    cost_per_call: float = 0.01

    def answer(self, prompt: Prompt, model: str) -> Reply:
        items, instruction, draft = read_back(prompt.text())
        # Media are not in the text; a rule sees their addresses.
        items = [(k, v if v != f"(see the attached {kind})" else value) for (k, v), (_, kind, value) in zip(items, prompt.items)]
        return Reply(self._say(prompt, items, instruction, draft), self.cost_per_call)

    def _say(self, prompt: Prompt, items: list[tuple[str, str]], instruction: str, draft: str | None) -> str:
        values = [v for _, v in items]
        tag = prompt.tags[0] if prompt.tags else "output"
        whole = " ".join(values)
        if prompt.operation in ("filter", "relevance"):
            rule = grammar.predicate(instruction)
            if prompt.operation == "relevance" and not rule:
                words = set(re.findall(r"\w{4,}", instruction.lower()))
                return f"<{tag}>{bool(words & set(re.findall(r'\w{4,}', whole.lower())))}</{tag}>"
            return f"<{tag}>{bool(rule and rule.test(whole))}</{tag}>"
        if prompt.operation == "map" and prompt.demonstrations and not grammar.mapping(instruction):
            # What the instruction does not say the examples do: the first of which all words are there, else the last.
            words = set(re.findall(r"\w+", whole.lower()))
            fits = lambda d: all(set(re.findall(r"\w+", v.lower())) <= words for _, v in d[0])
            answer = next((d[1] for d in prompt.demonstrations if fits(d)), prompt.demonstrations[-1][1])
            return " ".join(f"<{t}>{answer}</{t}>" for t in prompt.tags)
        if prompt.operation in ("filter_map", "map"):
            return self._several(prompt, instruction, whole)
        if prompt.operation == "refine":
            if "capital letters" in (prompt.feedback or ""):
                return re.sub(r"(?<=>)[^<]+(?=</)", lambda m: m.group(0).upper(), draft)
            return self._several(prompt, instruction, whole)
        if prompt.operation == "judge":
            said = re.sub(r"<[^>]*>", "", draft or "").strip()
            if not draft:
                return f"<{tag}>empty</{tag}>"
            loud = re.search(r"\bin capital letters\b", instruction, re.IGNORECASE) and said != said.upper()
            return f"<{tag}>{'write it in capital letters' if loud else 'pass'}</{tag}>"
        if prompt.operation == "join":
            return f"<{tag}>{grammar.belongs(instruction, values[0], values[1])}</{tag}>"
        if prompt.operation == "join_block":
            left = [(k, v) for k, v in items if k.startswith("L")]
            right = [(k, v) for k, v in items if k.startswith("R")]
            pairs = [f"{a}-{b}" for a, x in left for b, y in right if grammar.belongs(instruction, x, y)]
            return f"<{tag}>{','.join(pairs)}</{tag}>"
        if prompt.operation == "rank":
            first, second = (grammar.better(instruction, *pair) for pair in (values[:2], values[1::-1]))
            return f"<{tag}>{0 if first == second else 1 if first else 2}</{tag}>"
        if prompt.operation == "reduce":
            times = [int(m.group(1)) if (m := re.search(r"\((\d+) times\)", k)) else 1 for k, _ in items]
            answer = grammar.aggregate_values(instruction, values, times)
            return f"<{tag}>{'; '.join(values) if answer is None else answer}</{tag}>"
        if prompt.operation == "summarize":
            names = [n for v in values for n in v.split(", ") if n]
            return f"<{tag}>" + " || ".join(f"{n}: values of {n.replace('_', ' ')}" for n in names) + f"</{tag}>"
        return ""


    @staticmethod
    def _several(prompt: Prompt, instruction: str, whole: str) -> str:
        """Answers for all tags; an instruction may have a line 'tag: what to do' for each."""
        own = dict(re.findall(r"^(\w+): (.+)$", instruction, re.MULTILINE))
        if condition := own.get("condition"):
            rule = grammar.predicate(condition)
            holds = bool(rule and rule.test(whole))
            own |= {t: str(holds) for t in prompt.tags if t.startswith("condition_holds")}
        answers = []
        for t in prompt.tags:
            if own.get(t) in ("True", "False"):
                answers.append(f"<{t}>{own[t]}</{t}>")
                continue
            rule = grammar.mapping(own.get(t, instruction))
            answer = rule.value(whole) if rule else whole
            if answer is not None:
                answers.append(f"<{t}>{answer}</{t}>")
        return " ".join(answers)


@dataclass(frozen=True)
class ScriptedBackend(Backend):
    """Replies looked up by a part of the rendered question, in order; else ``default``."""

    script: tuple[tuple[str, str], ...] = ()
    default: str = ""
    cost_per_call: float = 0.01

    def answer(self, prompt: Prompt, model: str) -> Reply:
        text = prompt.text()
        return Reply(next((reply for part, reply in self.script if part in text), self.default), self.cost_per_call)


@dataclass(frozen=True)
class FailingBackend(Backend):
    """Every call fails."""

    def answer(self, prompt: Prompt, model: str) -> Reply:
        raise TimeoutError("no answer")


@dataclass(frozen=True)
class CachedBackend(Backend):
    """Remembers replies by model and question, so that a question is paid for once.

    With ``folder`` (on storage that all executors share) replies outlive tasks: a retried or
    recomputed task finds what was answered before. Files are written aside and renamed, so two tasks never
    read half a reply. Without it, replies are kept per worker.
    """

    inner: Backend = field(default_factory=RuleBackend)
    folder: str | None = None

    def _key(self, prompt: Prompt, model: str) -> str:
        return hashlib.sha256(f"{model}\0{prompt.text()}".encode()).hexdigest()

    def complete(self, prompts: Sequence[Prompt], model: str | None = None) -> list[Reply]:
        name = model or self.inner.model
        keys = [self._key(p, name) for p in prompts]
        known = {k: text for k in dict.fromkeys(keys) if (text := self._load(k)) is not None}
        missing = {k: p for k, p in zip(keys, prompts) if k not in known}
        fresh = dict(zip(missing, self.inner.complete(list(missing.values()), name)))
        for k, reply in fresh.items():
            if reply.text is not None:
                self._save(k, reply.text)
        out, paid = [], set()
        for k in keys:
            if k in fresh and k not in paid:
                out.append(fresh[k])
                paid.add(k)
            elif k in fresh:
                out.append(Reply(fresh[k].text, 0.0, fresh[k].status, 0))
            else:
                out.append(Reply(known[k], 0.0, "ok", 0))
        return out

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        return self.inner.embed(texts)

    def embed_with_cost(self, texts: Sequence[str]) -> tuple[list[list[float]], float]:
        return self.inner.embed_with_cost(texts)

    def with_limit(self, calls: int) -> CachedBackend:
        return replace(self, inner=self.inner.with_limit(calls), max_in_flight=calls)

    def _load(self, key: str) -> str | None:
        if self.folder is None:
            return _WORKER_CACHE.get(key)
        try:
            with open(os.path.join(self.folder, key[:2], key), encoding="utf-8") as f:
                return f.read()
        except OSError:
            return None

    def _save(self, key: str, text: str) -> None:
        if self.folder is None:
            _WORKER_CACHE[key] = text
            return
        place = os.path.join(self.folder, key[:2])
        os.makedirs(place, exist_ok=True)
        aside = os.path.join(place, f".{key}.{os.getpid()}")
        with open(aside, "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(aside, os.path.join(place, key))


_WORKER_CACHE: dict[str, str] = {}
