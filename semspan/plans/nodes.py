"""The logical plan: immutable nodes that say what an operator reads, makes and needs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Node:
    """Base of all nodes. ``depends`` are input columns, ``makes`` new ones."""

    @property
    def children(self) -> tuple[Node, ...]:
        return ()

    @property
    def depends(self) -> frozenset[str]:
        return frozenset()

    @property
    def makes(self) -> frozenset[str]:
        return frozenset()

    @property
    def columns(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys([*(c for child in self.children for c in child.columns), *sorted(self.makes)]))

    def with_children(self, *children: Node) -> Node:
        return self

    def label(self) -> str:
        return type(self).__name__


@dataclass(frozen=True)
class Scan(Node):
    frame: DataFrame = field(compare=False)
    name: str = "frame"

    @property
    def columns(self) -> tuple[str, ...]:
        return tuple(self.frame.columns)

    def label(self) -> str:
        return f"Scan {self.name} [{', '.join(self.columns)}]"


@dataclass(frozen=True)
class Operator(Node):
    """What map, filter, rank and reduce have in common."""

    child: Node
    instruction: str | None = None
    inputs: tuple[str, ...] = ()
    func: Callable | None = None
    expr: str | None = None
    options: tuple[tuple[str, Any], ...] = ()
    model: str | None = None

    @property
    def children(self) -> tuple[Node, ...]:
        return (self.child,)

    @property
    def depends(self) -> frozenset[str]:
        return frozenset(self.inputs)

    def with_children(self, *children: Node) -> Node:
        return replace(self, child=children[0])

    @property
    def cost_class(self) -> int:
        """0 native, 1 function, 2 model."""
        return 0 if self.expr is not None else 1 if self.func is not None else 2

    def label(self) -> str:
        how = ("native", "function", "model")[self.cost_class]
        said = self.expr or self.instruction or getattr(self.func, "__name__", "function")
        return f"{type(self).__name__} ({how}) [{', '.join(self.inputs)}] {said!r}"


@dataclass(frozen=True)
class Map(Operator):
    outputs: tuple[str, ...] = ()

    @property
    def makes(self) -> frozenset[str]:
        return frozenset(self.outputs)


@dataclass(frozen=True)
class Filter(Operator):
    pass


@dataclass(frozen=True)
class Rank(Operator):
    id_column: str = "row_id"
    descend: bool = True

    @property
    def depends(self) -> frozenset[str]:
        return frozenset((*self.inputs, self.id_column))

    @property
    def makes(self) -> frozenset[str]:
        return frozenset(["ranking"])


@dataclass(frozen=True)
class Reduce(Operator):
    group_by: tuple[str, ...] = ()

    @property
    def columns(self) -> tuple[str, ...]:
        return (*self.group_by, "reduce_result")


@dataclass(frozen=True)
class Join(Node):
    left: Node
    right: Node
    instruction: str | None
    left_on: str
    right_on: str
    left_id: str
    right_id: str
    how: str = "inner"
    func: Callable | None = None
    expr: str | None = None
    options: tuple[tuple[str, Any], ...] = ()
    suffix: str = "_right"
    model: str | None = None

    @property
    def cost_class(self) -> int:
        return 0 if self.expr is not None else 1 if self.func is not None else 2

    @property
    def children(self) -> tuple[Node, ...]:
        return (self.left, self.right)

    @property
    def depends(self) -> frozenset[str]:
        return frozenset((self.left_on, self.right_on, self.left_id, self.right_id))

    @property
    def columns(self) -> tuple[str, ...]:
        taken = {c.lower() for c in self.left.columns}
        return (*self.left.columns, *(c + self.suffix if c.lower() in taken else c for c in self.right.columns))

    def with_children(self, *children: Node) -> Node:
        return replace(self, left=children[0], right=children[1])

    def label(self) -> str:
        return f"Join ({self.how}) [{self.left_on}, {self.right_on}] {(self.expr or self.instruction)!r}"


@dataclass(frozen=True)
class Drop(Node):
    """Leaves columns out: what a fused question answers on the way."""

    child: Node
    names: tuple[str, ...] = ()

    @property
    def children(self) -> tuple[Node, ...]:
        return (self.child,)

    @property
    def columns(self) -> tuple[str, ...]:
        return tuple(c for c in self.child.columns if c not in self.names)

    def with_children(self, *children: Node) -> Node:
        return replace(self, child=children[0])

    def label(self) -> str:
        return f"Drop [{', '.join(self.names)}]"


def tree(node: Node, depth: int = 0) -> str:
    return "\n".join(["  " * depth + node.label(), *(tree(c, depth + 1) for c in node.children)])
