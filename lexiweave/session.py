"""Session helpers: table access, lineage cuts, size-checked broadcasts, skew-safe joins."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_shipped: set[str] = set()
_local: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        package = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="lexiweave-")) / f"{package.name}.zip"  # Spark serves it from the driver
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(path))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The table ``<sf_dir>/<table>.parquet`` (one file or a folder)."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder shared by all executors: ``spark.checkpoint.dir`` of the session.

    A folder of this machine is used only where the setting is absent and the master is local.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId  # the setting can't be changed in a running session
        if app not in _local:
            _local[app] = tempfile.mkdtemp(prefix="lexiweave-")
        root = _local[app]
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str = "cut") -> str:
    """A fresh folder under the shared scratch root, deleted when the application ends."""
    path = f"{scratch_root(spark)}/lexiweave-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def has_files(spark: SparkSession, path: str, pattern: str) -> bool:
    """Whether files in the folder match the pattern."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{pattern}")
    return len(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p) or []) > 0


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df to the shared folder and read it back: ends lineage, survives the loss of executors,
    and gives the planner true sizes."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, for work that costs far more than a shuffle of its rows: tables so small that cores
    would stay idle are repartitioned, any larger table is left as it is."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # the planner's estimate
    return df if size >= cores * spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes() else df.repartition(cores)


def finished(spark: SparkSession, path: str) -> bool:
    """Whether the table at path was written to its end."""
    return exists(spark, f"{path}/_SUCCESS")


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether df has no more than ``rows`` rows; stops counting beyond that."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it is proven to have at most ``rows`` rows, else unchanged."""
    return F.broadcast(df) if at_most(df, rows) else df


def skew_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", per_partition: int = 4
) -> DataFrame:
    """Equi-join of left with a right side that is unique on ``on``, safe against hot keys of left.

    A key is hot if it holds more than 1 / (per_partition * shuffle partitions) of left's rows with a key, so
    there are at most per_partition * shuffle partitions of them and right's rows of these keys are
    a broadcast of proven size; left's hot rows are not shuffled at all. The other rows take the
    ordinary shuffle join. Keys are counted in one pass, with map-side combining. Null keys match nothing.
    """
    on = list(on)
    if how not in ("inner", "left"):
        raise ValueError(how)
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = per_partition * parts
    counts = left.filter(" and ".join(f"`{c}` is not null" for c in on)).groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    total = F.broadcast(counts.agg(F.sum("_n").alias("_total")))  # one row, from the same exchange
    hot = counts.join(total).filter(F.col("_n") * most > F.col("_total")).select(*on)
    hot_keys = hot.limit(most).collect()
    if not hot_keys:
        return left.join(right, on, how)
    keys = left.sparkSession.createDataFrame(hot_keys, hot.schema)
    flagged = left.join(F.broadcast(keys.withColumn("_hot", F.lit(True))), on, "left")
    hot_right = right.join(F.broadcast(keys), on, "left_semi")
    a = flagged.filter("_hot").drop("_hot").join(F.broadcast(hot_right), on, how)
    b = flagged.filter("_hot is null").drop("_hot").join(right, on, how)
    return a.unionByName(b)
