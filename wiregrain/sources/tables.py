"""Tables of a capture, and the few physical helpers all operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers: it is zipped and added to the application once.

    Workers do not share the driver's import path, on a local master neither.
    """
    sc = spark.sparkContext
    if getattr(sc, "_wiregrain_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="wiregrain-"), "wiregrain.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, files in os.walk(_PACKAGE_ROOT):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(_PACKAGE_ROOT)))
    sc.addPyFile(path)
    sc._wiregrain_shipped = True


def spread(scan: DataFrame) -> DataFrame:
    """``scan`` in as many partitions as there are cores, where it is small.

    Meant for reads of tables, before Python work: a table of few files would
    keep most cores idle. The decision is the optimizer's estimate of the
    scan's size and the number of its files, so nothing is run while a query
    is built. A scan that has a file or a full split per core already passes
    unchanged, and results of a shuffle are never dealt out again.
    """
    spark = scan.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = int(str(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return scan.repartition(cores) if size < cores * split and len(scan.inputFiles()) < cores else scan


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local master (as in tests) gets a temporary folder;
    on a cluster that is an error, since executors would write to disks of
    their own.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir() or getattr(sc, "_wiregrain_shared", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = sc._wiregrain_shared = "file://" + tempfile.mkdtemp(prefix="wiregrain-shared-")
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; what is written there goes when the application ends."""
    path = f"{shared_folder(spark)}/wiregrain/{label}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(at)
    files.deleteOnExit(at)
    return path


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back.

    Used where a plan reads an expensive result more than once: the table
    survives the loss of executors and cuts the lineage.
    """
    path = f"{scratch_path(df.sparkSession, label)}/table"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def latest_entries(entries: DataFrame, payload: dict[str, Column]) -> DataFrame:
    """One row per ``entry_id``: that of the greatest ``ingested_at``, reduced to ``payload``.

    The payload is computed before the shuffle, so only what a query needs is
    moved, and copies of one entry are combined on the map side. Rows without
    an ``entry_id`` are no entries. Of rows with equal ``ingested_at`` the one
    with the greatest payload hash is taken, whatever the partitioning.
    """
    row = F.struct(*[c.alias(k) for k, c in payload.items()])
    order = F.struct(F.col("ingested_at").alias("at"), F.xxhash64(F.to_json(row) if any_map(payload) else row).alias("tie"))
    best = (
        entries.where(F.col("entry_id").isNotNull())
        .select("entry_id", row.alias("_row"), order.alias("_order"))
        .groupBy("entry_id")
        .agg(F.max_by("_row", "_order").alias("_row"))
    )
    return best.select("entry_id", *[F.col(f"_row.{k}").alias(k) for k in payload])


def any_map(payload: dict[str, Column]) -> bool:
    """Maps cannot be hashed; payloads that hold one are tagged by the caller with a ``map_`` name."""
    return any(k.startswith("map_") for k in payload)


def columns_or_null(df: DataFrame, names: Sequence[str]) -> list[Column]:
    """The named columns, null where ``df`` lacks one."""
    return [F.col(n) if n in df.columns else F.lit(None).cast("string").alias(n) for n in names]


def places(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "place") -> DataFrame:
    """``df`` with the 0-based place of each row within its ``keys``, by ``order``.

    Rows are cut into ranges of (keys, order); a range counts for itself and
    starts where the ranges before it end. A key that holds most rows (or all,
    with no keys) is spread over many tasks, unlike with a window over it.
    ``order`` must tell all rows of a key apart.
    """
    cols = [F.col(c) for c in (*keys, *order)]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = stage(df.repartitionByRange(parts, *cols).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = cut.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*[F.col(k) for k in keys] or [F.lit(0)]).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*[F.col(k) for k in keys], "_part").orderBy(*[F.col(c) for c in order])
    ranked = cut.withColumn("_at", F.row_number().over(within) - 1)
    join = [ranked["_part"] == starts["_part"], *[ranked[k].eqNullSafe(starts[k]) for k in keys]]
    return ranked.join(starts, join, "inner").select(*[ranked[c] for c in df.columns], (ranked["_at"] + starts["_start"]).cast("bigint").alias(name))
