"""A data lake: registered files, their summaries and index, and discovery over them."""

from __future__ import annotations

import csv
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semspan.backends import Backend
from semspan.functions.columns import lexical_tokens
from semspan.operators import discover
from semspan.operators.core import Ledger


def _plain_path(path: Column) -> Column:
    """One spelling of local paths, which sources give with one or three slashes."""
    return F.regexp_replace(path, "^file:/+", "file:///")


_PARSED = T.StructType(
    [T.StructField("column_names", T.ArrayType(T.StringType())), T.StructField("record_summary", T.StringType())]
)


@F.pandas_udf(_PARSED)
def _parse(header: pd.Series, rows: pd.Series) -> pd.DataFrame:
    out = []
    for first, lines in zip(header, rows):
        names = next(csv.reader([first]), [])
        records = csv.reader([] if lines is None else list(lines))
        text = " || ".join(" | ".join(f"{n}: {v}" for n, v in zip(names, r)) for r in records)
        out.append((names, text or None))
    return pd.DataFrame(out, columns=["column_names", "record_summary"])


@dataclass(frozen=True)
class Lake:
    """``catalog``: (table_id, path, column_names, context). Every method returns a new lake or a frame."""

    spark: SparkSession
    catalog: DataFrame | None = None
    index: DataFrame | None = None
    folder: str | None = None
    extension: str = "csv"
    backend: Backend | None = None

    def register(self, folder: str, extension: str = "csv") -> Lake:
        """All files of a folder and its subfolders, on any file system Spark can read; a file's id is its path's hash."""
        files = (
            self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{extension}").load(folder)
        )
        path = _plain_path(F.col("path"))
        catalog = files.select(F.xxhash64(path).alias("table_id"), path.alias("path")).withColumns(
            {"column_names": F.lit(None).cast("array<string>"), "context": F.lit(None).cast("string")}
        )
        return replace(self, catalog=catalog, folder=folder, extension=extension)

    def with_context(self, folder: str) -> Lake:
        """Adds the text of '<name>.txt' to the table '<name>.*'; other extensions are not read."""
        texts = self.spark.read.option("pathGlobFilter", "*.txt").option("recursiveFileLookup", True).text(folder, wholetext=True)
        stem = lambda c: F.regexp_extract(c, r"([^/]+)\.[^./]+$", 1)
        named = texts.select(stem(F.col("_metadata.file_path")).alias("__stem"), F.col("value").alias("__text"))
        joined = self.catalog.withColumn("__stem", stem(F.col("path"))).join(named, "__stem", "left")
        return replace(self, catalog=joined.withColumn("context", F.coalesce("__text", "context")).drop("__stem", "__text"))

    def add(self, path: str, context: str | None = None) -> Lake:
        """Appends one data set with its context to the catalog; one of the same path is replaced."""
        plain = _plain_path(F.lit(path if ":" in path else f"file:{path}"))
        one = self.spark.range(1).select(
            F.xxhash64(plain).alias("table_id"), plain.alias("path"), F.lit(None).cast("array<string>").alias("column_names"), F.lit(context).cast("string").alias("context")
        )
        if self.catalog is None:
            return replace(self, catalog=one, folder=path)
        others = self.catalog.filter(F.col("path") != plain)
        return replace(self, catalog=others.unionByName(one, allowMissingColumns=True))

    def summarize(self, records: int = 5, seed: int = 42, ledger: Ledger | None = None) -> Lake:
        """Headers and samples of all tables in one job over their lines, then one model call per table.

        A record is a line; a record that spans lines is sampled as its lines.
        """
        text = self.spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{self.extension}").text(self.folder)
        lines = text.select(
            _plain_path(F.col("_metadata.file_path")).alias("path"),
            F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().alias("no"),
            "value",
        ).filter(F.length(F.trim("value")) > 0)
        heads = lines.filter("start = 0").groupBy("path").agg(F.min_by("value", "no").alias("header"), F.min("no").alias("first"))
        order = Window.partitionBy("path").orderBy(F.xxhash64("value", F.lit(seed)), "value")
        picked = (
            lines.join(heads.select("path", "first"), "path")
            .filter("no <> first")
            .withColumn("rank", F.row_number().over(order))
            .filter(F.col("rank") <= records)
            .groupBy("path")
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]).alias("rows"))
        )
        read = heads.join(picked, "path", "left").select("path", _parse("header", "rows").alias("t")).select("path", "t.*")
        known = self.catalog.drop("column_names", "record_summary").join(read, "path", "left")
        return replace(self, catalog=discover.summarize(known, backend=self.backend, ledger=ledger))

    def build_index(self) -> Lake:
        return replace(self, index=discover.vectorize(self.catalog, backend=self.backend))

    def save_index(self, path: str) -> None:
        self.index.write.mode("overwrite").parquet(path)

    def load_index(self, path: str) -> Lake:
        return replace(self, index=self.spark.read.parquet(path))

    def discover(
        self, texts: list[str], topk: int = 5, alpha: float = 0.5, pool_factor: int = 3, rerank: bool = False, ledger: Ledger | None = None
    ) -> DataFrame:
        """(query_id, table_ids, scores, types, position) for each query text."""
        queries = self.spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
        asked = discover.embed(queries, "text", "vector", self.backend).withColumn("tokens", lexical_tokens(F.col("text")))
        found = discover.hybrid_search(self.index, asked, topk, pool_factor, alpha)
        if rerank:
            found = discover.rerank(found, self.index, queries, backend=self.backend, ledger=ledger)
        return discover.as_result(found)
