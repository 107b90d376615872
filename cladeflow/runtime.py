"""What every part of the package shares: table access, the shared folder, shipping of code."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a counted side of a join goes to every executor.
FEW = 1 << 19

_shipped: set[str] = set()
_roots: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables; read through Spark alone, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application (they may not share the driver's path)."""
    # a batch of texts is held by the JVM and by Python at once: bound it by bytes, not by rows alone
    for key, most in (("maxRecordsPerBatch", 4000), ("maxBytesPerBatch", 8 << 20)):
        name = f"spark.sql.execution.arrow.{key}"
        now = re.match(r"\d+", spark.conf.get(name))[0]
        if not 0 < int(now) <= most:
            spark.conf.set(name, str(most))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="code-")) / "cladeflow.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    spark.sparkContext.addPyFile(str(out))
    _shipped.add(app)


def shared_root(spark: SparkSession) -> str:
    """A folder of this application below ``spark.checkpoint.dir``, deleted when Python ends; where that is unset, a local
    one in local mode, and an error on a cluster, whose executors share no local folder."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="shared-")
            spark.sparkContext.setCheckpointDir(base)
            atexit.register(_remove_local, base.removeprefix("file://"))
        if "://" not in base and not base.startswith("file:"):
            base = "file://" + os.path.abspath(base)
        _roots[app] = f"{base.rstrip('/')}/cladeflow-{app}"
        atexit.register(_remove_shared, spark, _roots[app])
    return _roots[app]


def _remove_local(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def _remove_shared(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:  # else the session was stopped before
        drop_path(spark, path)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def sent(df: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """A side of a join that goes to every executor if it, or what it was made from row by row, has few rows: then the other
    side's rows stay where they are. Counting should be cheap."""
    return F.broadcast(df) if (df if counted is None else counted).count() <= FEW else df


def fewer(spark: SparkSession, parts: int) -> int:
    """Of so many partitions an eighth, but two a core."""
    return max(1, min(parts, max(2 * spark.sparkContext.defaultParallelism, parts // 8)))


def fewer_files(df: DataFrame, parts: int) -> DataFrame:
    """Of so many partitions the fewer: each file costs a shared store several requests.

    For what streams through a task, or is freed as it is read; a plain sort holds its memory to the task's end."""
    return df.coalesce(fewer(df.sparkSession, parts))


def materialize(df: DataFrame, name: str, shuffled: bool = False) -> DataFrame:
    """Cut the lineage with a written table in the shared folder: it outlives any executor. What comes from a shuffle and is
    small for its partitions is written to fewer files."""
    path = scratch(df.sparkSession, name)
    if shuffled:
        df = fewer_files(df, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if path.startswith("file:"):
        # Spark's local file system starts a program for each folder that it makes, and for a moment that one holds the
        # driver's memory a second time; these folders it finds
        os.makedirs(re.sub("^file:(//[^/]*)?", "", path) + "/_temporary/0/_temporary")
    # nothing looks for the marker file of a table that is read at once, by its schema
    df.write.mode("append").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back(spark: SparkSession) -> None:
    """Executors collect their garbage and return the heap that they no longer need, before a step that needs less of it.

    A heap that a step has grown stays the executor's, and counts beside the Python workers of all later steps. A task a
    core: an idle executor runs some of them, and collects once for those that ask at the same time."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete what scratch() named, when nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
