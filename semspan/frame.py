"""``SemFrame``: a lazy, immutable frame over Spark with semantic operators."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semspan.backends import Backend, Spend, current_backend
from semspan.operators.core import Ledger
from semspan.plans import physical
from semspan.plans.lower import lower
from semspan.plans.nodes import Filter, Join, Map, Node, Rank, Reduce, Scan, tree
from semspan.plans.physical import OptimizeConfig
from semspan.plans.rules import optimize
from semspan.runtime import reliable_checkpoint


def _names(columns: str | Sequence[str]) -> tuple[str, ...]:
    return (columns,) if isinstance(columns, str) else tuple(columns)


def _tool(func) -> dict:
    """``func`` may be a Python function, or a string that is a SQL expression."""
    return {"expr": func} if isinstance(func, str) else {"func": func}


@dataclass(frozen=True)
class SemFrame:
    """Every method returns a new frame; nothing runs before ``to_spark`` is acted on or ``execute`` is called."""

    plan: Node
    #: What planning has cost: expressions written and models tried on samples.
    planning: Spend = field(default_factory=Spend, compare=False)

    @staticmethod
    def of(frame: DataFrame, name: str = "frame") -> SemFrame:
        return SemFrame(Scan(frame, name))

    @staticmethod
    def create(spark: SparkSession, data, schema=None) -> SemFrame:
        """From a dict of lists, rows, or a pandas frame."""
        if isinstance(data, dict):
            import pandas as pd

            data = pd.DataFrame(data)
        return SemFrame.of(spark.createDataFrame(data, schema), "memory")

    @property
    def columns(self) -> tuple[str, ...]:
        return self.plan.columns

    def __contains__(self, column: str) -> bool:
        return column in self.columns

    def semantic_map(
        self, instruction: str | None, input_column: str | Sequence[str], output_column: str | Sequence[str],
        func: Callable | str | None = None, model: str | None = None, **options,
    ) -> SemFrame:
        return SemFrame(
            Map(self.plan, instruction, _names(input_column), options=tuple(options.items()), model=model,
                outputs=_names(output_column), **_tool(func))
        )

    def semantic_filter(
        self, instruction: str | None, input_column: str | Sequence[str], func: Callable | str | None = None,
        model: str | None = None, **options,
    ) -> SemFrame:
        return SemFrame(
            Filter(self.plan, instruction, _names(input_column), options=tuple(options.items()), model=model, **_tool(func))
        )

    def semantic_rank(
        self, instruction: str | None, input_column: str, id_column: str, descend: bool = True,
        func: Callable | str | None = None, model: str | None = None, **options,
    ) -> SemFrame:
        return SemFrame(
            Rank(self.plan, instruction, (input_column,), options=tuple(options.items()), model=model,
                 id_column=id_column, descend=descend, **_tool(func))
        )

    def semantic_reduce(
        self, instruction: str | None, input_column: str, group_by: str | Sequence[str] = (),
        func: Callable | str | None = None, model: str | None = None, **options,
    ) -> SemFrame:
        return SemFrame(
            Reduce(self.plan, instruction, (input_column,), options=tuple(options.items()), model=model,
                   group_by=_names(group_by), **_tool(func))
        )

    def semantic_join(
        self, other: SemFrame, instruction: str | None, left_on: str, right_on: str, left_id: str, right_id: str,
        how: str = "inner", func: Callable | str | None = None, model: str | None = None, **options,
    ) -> SemFrame:
        return SemFrame(
            Join(self.plan, other.plan, instruction, left_on, right_on, left_id, right_id, how,
                 options=tuple(options.items()), model=model, **_tool(func))
        )

    def optimized(self, config: OptimizeConfig | None = None, backend: Backend | None = None) -> SemFrame:
        config, ledger = config or OptimizeConfig(), Ledger()
        writer = (backend or current_backend()) if config.rewrite else None
        plan = optimize(self.plan, config.replacement, config.pushdown, config.fusion, writer, config.rewrite_model, ledger.spend)
        if config.choose_models:
            plan = physical.assign_models(plan, config, backend, ledger)
        spent = ledger.settle()
        spent.add(self.planning.cost, self.planning.calls, self.planning.errors)
        return SemFrame(plan, spent)

    def explain(self) -> str:
        return tree(self.plan)

    def to_spark(self, backend: Backend | None = None, ledger: Ledger | None = None) -> DataFrame:
        return lower(self.plan, backend, ledger)

    def execute(self, backend: Backend | None = None) -> tuple[DataFrame, Spend]:
        """(the result, what it cost with its planning). The result is computed once and written to the shared folder."""
        ledger, began = Ledger(), time.time()
        done = reliable_checkpoint(self.to_spark(backend, ledger))
        spend = ledger.settle()
        spend.add(self.planning.cost, self.planning.calls, self.planning.errors)
        spend.seconds = time.time() - began
        return done, spend

    def optimize_and_execute(
        self, config: OptimizeConfig | None = None, backend: Backend | None = None
    ) -> tuple[DataFrame, Spend]:
        return self.optimized(config, backend).execute(backend)


def json_lines(df: DataFrame) -> DataFrame:
    """A frame as one JSON text a row (``value``), the form in which results are shown to a model."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value"))
