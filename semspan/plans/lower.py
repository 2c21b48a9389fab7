"""From the logical plan to a Spark DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame

from semspan.backends import Backend
from semspan.operators.core import Ledger, sem_filter, sem_join, sem_map, sem_rank, sem_reduce
from semspan.plans.nodes import Drop, Filter, Join, Map, Node, Rank, Reduce, Scan


def lower(node: Node, backend: Backend | None = None, ledger: Ledger | None = None) -> DataFrame:
    if isinstance(node, Scan):
        return node.frame
    frames = [lower(c, backend, ledger) for c in node.children]
    if isinstance(node, Drop):
        return frames[0].drop(*node.names)
    shared = {"func": node.func, "expr": node.expr, "backend": backend, "ledger": ledger, "model": node.model, **dict(node.options)}
    if isinstance(node, Join):
        return sem_join(
            *frames, node.instruction, node.left_on, node.right_on, node.left_id, node.right_id, node.how, node.suffix, **shared
        )
    (df,) = frames
    if isinstance(node, Map):
        return sem_map(df, node.instruction, node.inputs, node.outputs, **shared)
    if isinstance(node, Filter):
        return sem_filter(df, node.instruction, node.inputs, **shared)
    if isinstance(node, Rank):
        return sem_rank(df, node.instruction, node.inputs[0], node.id_column, node.descend, **shared)
    if isinstance(node, Reduce):
        return sem_reduce(df, node.instruction, node.inputs[0], node.group_by, **shared)
    raise TypeError(f"unknown node {type(node).__name__}")
