"""Which model is good enough for an operator, found out on a sample.

The sample is answered by ever stronger models. With m0, m1, … the models from weak to strong, the gain of one
more step is estimated from how often neighbours disagree:

  s1 = P(m0 != m1)
  s2 = s1 + P(m1 != m2 | m0 = m1) (1 - s1)
  s3 = P(m2 != m3 | m0 = m1 = m2) (1 - s2) + (s2 - s1) + P(m1 = m2 | m0 != m1)

and a stronger model is chosen as long as the gain exceeds the margin; the strongest is asked only for the rows on
which all others agree. Joins and ranks take the weakest model, reduces the strongest, small inputs of a map or filter too.

The sample are the different values of least hash, so that it does not depend on the order of the rows; it has at most
``max_sample`` values. It is answered by executors like any other question, what it costs is in the ledger, and the chosen
model's answers are kept with the operator: the sample is not asked again. An operator's input that took calls to make is
written once, and the rest of the plan goes on from there.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import functions as F

from semspan.backends import Backend, current_backend
from semspan.backends.base import MODEL_LADDER
from semspan.operators.core import Ledger
from semspan.operators.evaluate import Question, ask, demonstrations, kind_of, normal_strategy
from semspan.plans.lower import lower
from semspan.plans.nodes import Filter, Join, Map, Node, Operator, Rank, Reduce, Scan
from semspan.runtime import reliable_checkpoint

#: Two answers of a map differ if the cosine of their embeddings is lower.
SAME_ANSWER = 0.5


@dataclass(frozen=True)
class OptimizeConfig:
    """``sample_ratio`` wins over ``sample_size``."""

    replacement: bool = True
    pushdown: bool = True
    fusion: bool = False
    choose_models: bool = False
    sample_ratio: float | None = None
    sample_size: int | None = 5
    margin: float = 0.2
    models: tuple[str, ...] = MODEL_LADDER
    #: Values a sample has at most, whatever the ratio.
    max_sample: int = 1_000
    #: Let a model write expressions for instructions that the grammar does not know.
    rewrite: bool = False
    rewrite_model: str | None = None


def sample_rows(n: int, config: OptimizeConfig) -> int:
    if config.sample_ratio is not None:
        return int(config.sample_ratio * n) + 1
    if config.sample_size is not None:
        return config.sample_size
    raise ValueError("sample_ratio or sample_size is needed")


def share(flags: Sequence[bool]) -> float:
    return sum(flags) / len(flags) if flags else 0.0


def choose_model(answers_of: Callable[[str, list[int]], list], n: int, models: Sequence[str], margin: float, same=None) -> str:
    """``answers_of(model, rows)`` answers the given rows of a sample of ``n``."""
    same = same or (lambda a, b: a == b)
    rows = list(range(n))
    if n == 0 or len(models) == 1:
        return models[0]
    answers = [answers_of(m, rows) for m in models[: min(3, len(models))]]
    differ = lambda i, j, at: [not same(answers[i][r], answers[j][r]) for r in at]
    apart = differ(0, 1, rows)
    s1 = share(apart)
    chosen = models[0]
    if s1 > margin:
        chosen = models[1]
    if len(models) < 3:
        return chosen
    together = [r for r in rows if not apart[r]]
    s2 = s1 + share(differ(1, 2, together)) * (1 - s1)
    if s2 - s1 > margin:
        chosen = models[2]
    if len(models) < 4:
        return chosen
    agreed = [r for r in together if same(answers[1][r], answers[2][r])]
    strongest = dict(zip(agreed, answers_of(models[3], agreed))) if agreed else {}
    missed = share([not same(answers[2][r], strongest[r]) for r in agreed])
    parted = [r for r in rows if apart[r]]
    s3 = missed * (1 - s2) + (s2 - s1) + share([same(answers[1][r], answers[2][r]) for r in parted])
    return models[3] if s3 - s2 > margin else chosen


def _close(backend: Backend, ledger: Ledger | None) -> Callable[[str | None, str | None], bool]:
    """Whether two answers of a map are alike, by the backend's own embeddings; every answer is embedded once."""
    vectors: dict[str, list[float]] = {}

    def vector(text: str) -> list[float]:
        if text not in vectors:
            (vectors[text],), cost = backend.embed_with_cost([text])
            if ledger is not None:
                ledger.spend.add(cost, 1 if cost else 0)
        return vectors[text]

    def close(a: str | None, b: str | None) -> bool:
        if a is None or b is None or a == b:
            return a == b
        x, y = vector(a), vector(b)
        size = (sum(p * p for p in x) * sum(q * q for q in y)) ** 0.5
        return bool(size) and sum(p * q for p, q in zip(x, y)) / size >= SAME_ANSWER

    return close


def _asks(node: Node) -> bool:
    return getattr(node, "cost_class", 0) == 2 or any(map(_asks, node.children))


def assign_models(node: Node, config: OptimizeConfig, backend: Backend | None = None, ledger: Ledger | None = None) -> Node:
    """The plan with a model for every operator that asks one; samples are drawn from each operator's real input."""
    children = [assign_models(c, config, backend, ledger) for c in node.children]
    node = node.with_children(*children) if children else node
    if not isinstance(node, (Operator, Join)) or node.cost_class != 2 or node.model:
        return node
    weakest, strongest = config.models[0], config.models[-1]
    if isinstance(node, (Rank, Join)):
        return replace(node, model=weakest)
    if isinstance(node, Reduce):
        return replace(node, model=strongest)
    frame = lower(node.child, backend, ledger)
    if _asks(node.child):
        frame = reliable_checkpoint(frame)
        if ledger is not None:
            ledger.settle()
        node = replace(node, child=Scan(frame, "computed"))
    wanted = min(config.max_sample, sample_rows(frame.count() if config.sample_ratio is not None else 0, config))
    columns = [F.col(f"`{c}`").cast("string").alias(f"v{i}") for i, c in enumerate(node.inputs)]
    names = [f"v{i}" for i in range(len(columns))]
    present = frame.select(*columns).na.drop()
    if present.count() < 2 * wanted:
        return replace(node, model=strongest)
    rows = [tuple(r) for r in present.distinct().orderBy(F.xxhash64(*names), *names).limit(wanted).collect()]
    options = dict(node.options)
    outputs = node.outputs if isinstance(node, Map) else ("output",)
    question = Question(
        "map" if isinstance(node, Map) else "filter",
        node.instruction,
        node.inputs,
        tuple(kind_of(frame, c) for c in node.inputs),
        outputs,
        normal_strategy(options.get("strategy", "plain")),
        demonstrations(options.get("context")),
    )
    chosen = backend or current_backend()
    answered: dict[tuple[str, int], tuple] = {}

    def answers_of(model: str, at: list[int]) -> list:
        if at:
            asked = frame.sparkSession.createDataFrame([(i, *rows[i]) for i in at], ", ".join(["i int", *[f"{c} string" for c in names]]))
            asked = asked.withColumn("a", ask(question, [F.col(c) for c in names], chosen, model))
            for r in asked.collect():
                answered[model, r["i"]] = tuple(r["a"]["values"] or ())
                if ledger is not None:
                    ledger.spend.add(r["a"]["cost"], r["a"]["calls"], int(r["a"]["status"].startswith("error")))
        return [answered[model, i] for i in at]

    close = _close(chosen, ledger)
    same = (lambda a, b: len(a) == len(b) and all(map(close, a, b))) if isinstance(node, Map) else None
    model = choose_model(answers_of, len(rows), config.models, config.margin, same)
    known = tuple((rows[i], said) for (m, i), said in answered.items() if m == model and said and None not in said)
    return replace(node, model=model, options=(*node.options, ("known", known)))


__all__ = ["Filter", "OptimizeConfig", "assign_models", "choose_model", "sample_rows"]
