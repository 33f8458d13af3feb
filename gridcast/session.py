"""Session helpers.

On a cluster the caller owns the session and nothing here changes its settings. A local session that
names no shared folder gets one, as the checkpoint folder of its context too.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: int | str = 8, app: str = "gridcast") -> SparkSession:
    """A local session for tests and bench.py."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores) if cores != "*" else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession, purpose: str = "stage") -> str:
    """A new, unique folder below the shared folder named by ``spark.checkpoint.dir``.

    Only a session that names no such folder and runs in local mode gets a temporary one;
    on a cluster a machine-local folder would be lost with its executor, so that is an error.
    """
    base = spark.conf.get(CHECKPOINT_CONF, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="gridcast-")
        spark.conf.set(CHECKPOINT_CONF, base)
        # Boosted trees cut their lineage in the context's folder.
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str = "table") -> DataFrame:
    """Write ``df`` into the shared folder and read it back: lineage ends there."""
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
