"""Session helpers: where intermediate tables go, and how they are written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# One folder per local session that names none; never used on a cluster.
_local_roots: dict[str, str] = {}


def local_session(cpus: int | str = "*", **conf: object) -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    settings = {
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        # Methods beyond this stay uncompiled in the JVM; wide projections then run
        # faster outside whole-stage code, cut into small methods.
        "spark.sql.codegen.hugeMethodLimit": "8000",
        # Skip recording a Python stack for every column expression.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **{key.replace("__", "."): str(value) for key, value in conf.items()},
    }
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("catalogforge")
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that every executor shares.

    The folder is the session's ``spark.checkpoint.dir``. Only a ``local[...]``
    session may leave it unset; it then gets a temporary folder of its own. All paths
    of an application share one subfolder, to be dropped when its work is done.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        app = spark.sparkContext.applicationId
        root = _local_roots.setdefault(app, "")
        if not root:
            root = _local_roots[app] = tempfile.mkdtemp(prefix="spark-catalogforge-")
    app = spark.sparkContext.applicationId
    return f"{root.rstrip('/')}/{app}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back.

    Cuts the lineage at a table that outlives any executor, so values that depend
    on how the rows were laid out (partition, row number) are fixed from here on,
    and later scans read only the columns they use.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
