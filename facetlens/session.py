"""Session construction and lineage helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, app: str = "facetlens",
                shuffle_partitions: int | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the library assumes.

    AQE stays on so shuffle partition counts coalesce at runtime and skewed
    join partitions are split; the session time zone is pinned to UTC so
    window boundaries do not depend on the host.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    A cluster names it in ``spark.checkpoint.dir``; only when the setting is
    absent (local tests) is a scratch folder created and registered.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="facetlens-ckpt-")
    spark.conf.set("spark.checkpoint.dir", path)
    sc.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder.

    Used after iterative or long chains so a lost executor recomputes from
    the written files instead of replaying the whole plan.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def sized_broadcast(df: DataFrame, max_rows: int = 2_000_000) -> DataFrame:
    """Broadcast ``df`` only when its row count is proven below ``max_rows``.

    The count runs on an already-aggregated side (model tables, label sets,
    centroids), so it is a cheap job; above the bound the frame is returned
    unchanged and the planner falls back to a shuffled join.
    """
    from pyspark.sql import functions as F

    n = df.count()
    return F.broadcast(df) if n <= max_rows else df


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``facetlens`` importable in Python workers (once per context).

    Python stages (the model stage) pickle library classes by reference; the
    package is zipped from its installed location and added with
    ``addPyFile``, which distributes it to every executor.
    """
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    import facetlens

    root = os.path.dirname(os.path.dirname(os.path.abspath(facetlens.__file__)))
    fd, path = tempfile.mkstemp(suffix=".zip", prefix="facetlens-pkg-")
    os.close(fd)
    with zipfile.ZipFile(path, "w") as z:
        for dirpath, _, files in os.walk(os.path.join(root, "facetlens")):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
