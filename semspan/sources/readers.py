"""Scans and sinks: delimited text, CSV, JSON, Parquet, text, and media files as data URIs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Extension to (kind, media type).
MEDIA = {
    **{e: ("image", f"image/{'jpeg' if e == 'jpg' else e}") for e in ("png", "jpg", "jpeg", "gif", "webp", "bmp")},
    **{e: ("audio", f"audio/{e}") for e in ("wav", "mp3", "flac", "ogg", "m4a")},
    "pdf": ("file", "application/pdf"),
}


def read_delimited(spark: SparkSession, path: str, sep: str = ",", schema: T.StructType | str | None = None, **options) -> DataFrame:
    reader = spark.read.options(sep=sep, header=True, multiLine=True, escape='"', **options)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_delimited(spark, path, ",", **options)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    return spark.read.schema(schema).json(path) if schema else spark.read.json(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def as_media(df: DataFrame, column: str, kind: str) -> DataFrame:
    """Marks a column as image, audio or file, so that operators send it as such."""
    if kind not in ("image", "audio", "file"):
        raise ValueError(f"unknown media kind {kind!r}")
    return df.withMetadata(column, {"semtype": kind})


def infer_media_kind(df: DataFrame, column: str) -> str:
    """The kind most values have by their extension, counted over all of them; 'str' if there is none."""
    extension = F.lower(F.regexp_extract(F.col(f"`{column}`").cast("string"), r"\.([A-Za-z0-9]+)(?:[?#].*)?$", 1))
    kinds = F.create_map(*[x for e, (k, _) in MEDIA.items() for x in (F.lit(e), F.lit(k))])
    kind = F.coalesce(kinds[extension], F.lit("str")).alias("kind")
    rows = df.filter(F.col(f"`{column}`").isNotNull()).groupBy(kind).count().collect()  # four kinds at most
    votes = {r["kind"]: r["count"] for r in rows}
    return max(votes, key=votes.get) if votes else "str"


def bytes_as_uri(content: Column, media_type: str = "image/png") -> Column:
    """Binary content as a data URI, in the JVM."""
    return F.when(content.isNotNull(), F.concat(F.lit(f"data:{media_type};base64,"), F.regexp_replace(F.base64(content), r"\s", "")))


def scan_media(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(path, kind, uri) of every media file below ``path``; executors read the files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
    extension = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kinds = F.create_map(*[x for e, (k, _) in MEDIA.items() for x in (F.lit(e), F.lit(k))])
    types = F.create_map(*[x for e, (_, t) in MEDIA.items() for x in (F.lit(e), F.lit(t))])
    known = files.withColumn("e", extension).withColumn("kind", kinds[F.col("e")]).filter("kind is not null")
    encoded = F.regexp_replace(F.base64("content"), r"\s", "")
    return known.select("path", "kind", F.concat(F.lit("data:"), types[F.col("e")], F.lit(";base64,"), encoded).alias("uri"))


def load_media(df: DataFrame, column: str, kind: str, spark: SparkSession | None = None, root: str | None = None) -> DataFrame:
    """References in ``column`` as data URIs, marked as ``kind``.

    Data URIs and https addresses stay as they are; binary content is encoded; other strings are paths below
    ``root``, read by a scan and joined by path. A path that is not there gives null.
    """
    field = df.schema[column]
    if isinstance(field.dataType, T.BinaryType):
        media_type = {"image": "image/png", "audio": "audio/wav", "file": "application/pdf"}[kind]
        return as_media(df.withColumn(column, bytes_as_uri(F.col(f"`{column}`"), media_type)), column, kind)
    value = F.col(f"`{column}`")
    remote = value.rlike("^(?:data:|https?://)")
    if root is None:
        return as_media(df, column, kind)
    files = scan_media(spark or df.sparkSession, root).select(F.regexp_replace("path", "^file:/+", "/").alias("__path"), F.col("uri").alias("__uri"))
    full = F.when(value.startswith("/"), value).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), value))
    joined = df.withColumn("__full", F.when(~remote, full)).join(files, F.col("__full") == F.col("__path"), "left")
    return as_media(joined.withColumn(column, F.when(remote, value).otherwise(F.col("__uri"))).drop("__full", "__path", "__uri"), column, kind)


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", partition_by: tuple[str, ...] = (), **options) -> None:
    """Writes a frame; parquet, csv, json, orc or text."""
    writer = df.write.mode(mode).options(**options)
    if fmt == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).format(fmt).save(path)
