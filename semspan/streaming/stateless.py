"""Semantic map and filter on streams. Both are stateless, so they run in append mode on any streaming frame.

Rank, reduce and semantic joins need all rows and are refused on a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from semspan.backends import Backend
from semspan.frame import SemFrame
from semspan.plans.nodes import Filter, Map, Node, Scan


def check_streamable(node: Node) -> None:
    if not isinstance(node, (Scan, Map, Filter)):
        raise ValueError(f"{type(node).__name__} cannot run on a stream")
    for child in node.children:
        check_streamable(child)


def stream(frame: SemFrame, backend: Backend | None = None) -> DataFrame:
    """The streaming DataFrame of a frame whose scan is a stream."""
    check_streamable(frame.plan)
    return frame.to_spark(backend)


def start(frame: SemFrame, path: str, checkpoint: str, backend: Backend | None = None, fmt: str = "parquet", **trigger) -> StreamingQuery:
    """Writes the stream to files, exactly once; ``trigger`` as for Spark, all available rows by default."""
    writer = stream(frame, backend).writeStream.outputMode("append").option("checkpointLocation", checkpoint).format(fmt)
    return writer.trigger(**(trigger or {"availableNow": True})).start(path)
