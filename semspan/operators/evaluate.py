"""How one expression of an operator is evaluated: by Catalyst, by a Python function, or by a model.

N  native: a SQL expression; pushed down, pruned and compiled like any other.
U  function: a deterministic Arrow UDF with a result or an error for each row.
M  model: a non-deterministic Arrow UDF, so that Catalyst neither repeats nor reorders paid calls.
   Rows that are not to be asked are skipped inside the UDF, since a surrounding CASE does not keep
   rows out of it. What a call cost comes back beside its answer.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semspan.backends import Backend, Prompt, current_backend, parse_tags

STRATEGIES = ("plain", "fewshot", "self_refine")
ANSWER = "struct<values:array<string>,cost:double,calls:int,status:string>"


@dataclass(frozen=True)
class Question:
    """What is asked of every row."""

    operation: str
    instruction: str
    labels: tuple[str, ...]
    kinds: tuple[str, ...]
    tags: tuple[str, ...] = ("output",)
    strategy: str = "plain"
    demonstrations: tuple = ()
    null_means_no_call: bool = True
    #: Conditions an answer must meet; one that does not becomes null, with the status 'assert_failed'.
    assertions: tuple = ()
    #: (inputs, answers) that need no call.
    known: tuple = ()

    def __post_init__(self) -> None:
        if self.strategy not in STRATEGIES:
            raise ValueError(f"strategy must be one of {STRATEGIES}, not {self.strategy!r}")
        if self.strategy == "fewshot" and not self.demonstrations:
            raise ValueError("the fewshot strategy needs demonstrations")

    def prompt(self, values: Sequence[object], **more) -> Prompt:
        items = tuple((a, k, "" if v is None else str(v)) for a, k, v in zip(self.labels, self.kinds, values))
        shown = self.demonstrations if self.strategy == "fewshot" else ()
        return Prompt(self.operation, self.instruction, items, self.tags, shown, **more)


def normal_strategy(name: str) -> str:
    return name.replace("-", "_")


def demonstrations(context) -> tuple:
    """Demonstrations from ``[{"data": {column: value}, "answer": text}]``."""
    return tuple((tuple((str(k), str(v)) for k, v in dict(d["data"]).items()), str(d["answer"])) for d in context or ())


def kind_of(df: DataFrame, column: str) -> str:
    """'image', 'audio' or 'file' where the column's metadata says so, 'numeric' for numbers, else 'str'."""
    field = df.schema[column]
    if named := (field.metadata or {}).get("semtype"):
        return named
    return "numeric" if field.dataType.typeName() in ("integer", "long", "double", "float", "short", "byte", "decimal") else "str"


def answer_batch(question: Question, rows: list[Sequence[object] | None], backend: Backend, model: str | None) -> list[dict]:
    """The answers to a batch; None in ``rows`` is a row that is not asked."""
    out: list[dict] = [{"values": None, "cost": 0.0, "calls": 0, "status": "skipped"} for _ in rows]
    known = dict(question.known)
    at = []
    for i, r in enumerate(rows):
        if r is None:
            continue
        if known and (said := known.get(tuple(map(str, r)))) is not None:
            out[i] = {"values": list(said), "cost": 0.0, "calls": 0, "status": "known"}
        else:
            at.append(i)
    prompts = [question.prompt(rows[i]) for i in at]
    replies = backend.complete(prompts, model) if prompts else []
    for i, reply in zip(at, replies):
        found = parse_tags(reply.text, question.tags)
        out[i] = {"values": [found[t] for t in question.tags], "cost": reply.cost, "calls": reply.calls, "status": reply.status}
        out[i]["text"] = reply.text
    if question.strategy == "self_refine":
        good = [i for i in at if out[i]["status"] == "ok"]
        judge = Question("judge", question.instruction, question.labels, question.kinds)
        verdicts = backend.complete([judge.prompt(rows[i], draft=out[i]["text"]) for i in good], model) if good else []
        again, remarks = [], []
        for i, v in zip(good, verdicts):
            out[i]["cost"] += v.cost
            out[i]["calls"] += v.calls
            remark = parse_tags(v.text, ("output",))["output"]
            if v.text is not None and "pass" not in (remark or v.text).lower():
                again.append(i)
                remarks.append(remark or v.text)
        refine = Question("refine", question.instruction, question.labels, question.kinds, question.tags)
        prompts = [refine.prompt(rows[i], draft=out[i]["text"], feedback=r) for i, r in zip(again, remarks)]
        for i, reply in zip(again, backend.complete(prompts, model) if prompts else []):
            out[i]["cost"] += reply.cost
            out[i]["calls"] += reply.calls
            if reply.text is not None:
                found = parse_tags(reply.text, question.tags)
                out[i]["values"] = [found[t] for t in question.tags]
    for o in out:
        o.pop("text", None)
        for k, v in enumerate(o["values"] or ()):
            if v is not None and not all(check(v) for check in question.assertions):
                o["values"][k], o["status"] = None, "assert_failed"
    return out


def ask(question: Question, inputs: Sequence[Column], backend: Backend | None, model: str | None, when: Column | None = None) -> Column:
    """The model's answer to each row: a column of type ``ANSWER``."""
    chosen = backend or current_backend()

    @F.pandas_udf(ANSWER)
    def evaluate(row: pd.DataFrame) -> pd.DataFrame:
        names = [c for c in row.columns if c != "__when"]
        asked = row["__when"].fillna(False).to_numpy(bool)
        values = row[names].astype(object).where(row[names].notna(), None).to_numpy().tolist()
        rows = [
            None if not a or (question.null_means_no_call and any(v is None for v in r)) else r for a, r in zip(asked, values)
        ]
        return pd.DataFrame(answer_batch(question, rows, chosen, model), columns=["values", "cost", "calls", "status"])

    parts = [c.cast("string").alias(f"v{i}") for i, c in enumerate(inputs)]
    flag = (F.lit(True) if when is None else when).alias("__when")
    return evaluate.asNondeterministic()(F.struct(*parts, flag))


def call_function(func: Callable, inputs: Sequence[str], n_outputs: int = 1) -> Column:
    """A Python function's result for each row: struct<values, failed>; nulls are not passed to it.

    One input is passed as it is, several as a dict by name. A result for several outputs is a tuple, list or dict.
    """

    @F.pandas_udf("struct<values:array<string>,failed:boolean>")
    def evaluate(row: pd.DataFrame) -> pd.DataFrame:
        out = []
        for values in row.astype(object).where(row.notna(), None).to_dict("records"):
            if any(v is None for v in values.values()):
                out.append((None, False))
                continue
            try:
                got = func(next(iter(values.values())) if len(values) == 1 else values)
                many = list(got.values()) if isinstance(got, dict) else list(got) if isinstance(got, (tuple, list)) else [got]
                if len(many) != n_outputs:
                    raise ValueError("wrong number of outputs")
                out.append(([None if v is None else str(v) for v in many], False))
            except Exception:  # noqa: BLE001 - the row falls back to the model
                out.append((None, True))
        return pd.DataFrame(out, columns=["values", "failed"])

    return evaluate(F.struct(*[F.col(f"`{c}`").alias(c) for c in inputs]))


def truth(text: Column, ignore_case: bool = False) -> Column:
    """True if the answer says so; anything else, and no answer, is False."""
    said = F.lower(text) if ignore_case else text
    yes = "true" if ignore_case else "True"
    return F.coalesce(F.contains(said, F.lit(yes)), F.lit(False))
