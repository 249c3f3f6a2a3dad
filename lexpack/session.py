"""Session helpers shared by every operator: shipping the package, shared storage, lineage cuts."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Give this package to the executors, once for each application.

    Workers import ``lexpack`` by name; on a cluster the driver's path isn't theirs.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as z:
            for p in sorted([*root.rglob("*.py"), *root.rglob("*.java")]):
                z.write(p, f"{root.name}/{p.relative_to(root)}")
        name = os.path.join(tempfile.mkdtemp(), f"{root.name}.zip")
        Path(name).write_bytes(buffer.getvalue())
        sc.addPyFile(name)
        _shipped.add(sc.applicationId)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. A local master without one gets a temporary folder; a cluster must name one."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lexpack-")
        sc.setCheckpointDir(found)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: a lineage cut that keeps column pruning."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lexpack/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, steady: bool = False) -> DataFrame:
    """``df`` dealt out over all cores where its scan has fewer partitions than the cluster has cores, or one with over twice a core's share; else ``df``.

    A file is split by its bytes, but a row group is read by one task: of the many splits of one large row group all but one are empty.
    ``steady``: the dealt rows are stored, so that partitions come out alike when they are read again.
    """
    cores, n = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    if n >= cores and not _lopsided(df, cores):
        return df
    dealt = df.repartition(max(n, cores))
    return stored(dealt, "spread") if steady else dealt


def _lopsided(df: DataFrame, cores: int) -> bool:
    """Whether a partition of a scan has over twice a core's share of the rows; Parquet's footers have the counts."""
    each = df.groupBy(F.spark_partition_id().alias("_p")).agg(F.count(F.lit(1)).alias("n"))
    seen = each.agg(F.max("n").alias("most"), F.sum("n").alias("n")).first()
    return bool(seen.n) and seen.most > 1 and seen.most * cores > 2 * seen.n
