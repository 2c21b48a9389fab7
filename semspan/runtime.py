"""Session, table and checkpoint helpers shared by the whole package."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Settings the library relies on for large inputs; a caller's own session is never changed.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.speculation": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.driver.memory": "12g",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = 8, **conf: str) -> SparkSession:
    """A local session with the library's defaults, for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("semspan")
    for key, value in {**SESSION_DEFAULTS, "spark.sql.shuffle.partitions": str(cores), **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once per context, so that their Python workers can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_semspan_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="semspan-package-"), "semspan-package.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(home):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(home)))
    sc.addPyFile(archive)
    sc._semspan_shipped = True


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``root`` (one file or a folder of parts)."""
    return spark.read.parquet(os.path.join(root, f"{name}.parquet"))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints.

    The cluster's ``spark.checkpoint.dir`` is used wherever it is set. Only a local
    session without one gets a temporary folder; on a cluster that is an error,
    since executors would not share it.
    """
    sc = spark.sparkContext
    if current := sc.getCheckpointDir():
        return current
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="semspan-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def reliable_checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cuts lineage through the shared checkpoint folder, so lost executors cost no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def written_table(df: DataFrame) -> DataFrame:
    """As ``reliable_checkpoint``, but as a compressed columnar table in the shared folder: for what is large and read often.

    The folder is deleted when the application ends.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/semspan-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.parquet(path)


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that does not clash with any column of ``df``."""
    taken = {c.lower() for c in df.columns}
    name, k = f"__{stem}", 0
    while name.lower() in taken:
        k += 1
        name = f"__{stem}_{k}"
    return name


def numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """``df`` with ``name``, a gapless number from 1 in the given order, without gathering all rows in one task.

    Rows are range-partitioned and written once, so that the partitions and their sizes stay as they are; a
    number is the rank within its partition plus the sizes of the partitions before it.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    part, before, n = fresh_name(df, "part"), fresh_name(df, "before"), fresh_name(df, "n")
    ranged = reliable_checkpoint(df.repartitionByRange(parts, *order).withColumn(part, F.spark_partition_id()))
    sizes = ranged.groupBy(part).agg(F.count("*").alias(n))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(part, F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(before))  # one row per partition
    within = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    return ranged.join(F.broadcast(starts), part).withColumn(name, (within + F.col(before)).cast("long")).drop(part, before)
