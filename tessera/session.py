"""Session defaults and the shared scratch area that cuts lineage."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "tessera", cores: str = "*", partitions: int = 8, **extra: str) -> SparkSession:
    """A session for tests and the bench; on a cluster the session comes from spark-submit."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir); a temporary one only in local mode, as in tests, where it is unset."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext._conf.set("spark.checkpoint.dir", root)
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df once as Parquet under the shared folder and read it back.

    Every later use reads the files, so an executor that is lost costs only the tasks that it was running,
    and plans that grow in a loop stay short. Files go when the driver ends.
    """
    path = scratch_folder(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks_for(rows: DataFrame, each: int = 500_000) -> int | None:
    """How many tasks a shuffle of rows needs for some each rows a task; None where the session's own number gives no more.

    A fixed number of shuffle partitions, or AQE that joins small ones, gives a task a share of the input that grows
    with it. Counts the rows: of a stored table that reads the footers alone.
    """
    spark = rows.sparkSession
    n = -(-rows.count() // each)
    return n if n > min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))) else None


def dealt(rows: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """rows dealt by keys to so many tasks (tasks_for); None: as they are, what follows makes its own shuffle."""
    return rows.repartition(tasks, *keys) if tasks else rows


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new place under the shared folder, not made yet; what is written there goes when the driver ends."""
    path = f"{scratch_root(spark).rstrip('/')}/tessera-{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    atexit.register(_drop, spark, path)
    return path


#: Paths written inside each open call of once().
_scopes: list[list[str]] = []


def once(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The table that make() returns, written; what make() wrote on the way goes from the shared folder at once."""
    _scopes.append([])
    try:
        made = make()
        spark = made.sparkSession
        inner = _scopes.pop()
    except BaseException:
        _scopes.pop()
        raise
    out = materialize(made, name)
    for path in inner:
        _drop(spark, path)
    return out


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is gone: nothing is left to ask
        pass
