"""Sessions, and the package on executors that don't have it on their path."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that results depend on (UTC, ANSI) and adaptive execution; conf overrides them."""
    builder = SparkSession.builder.appName("motifold")
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    return builder.config(map=settings | conf).getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's Python files to the executors, once a session."""
    context = spark.sparkContext
    if not getattr(context, "_motifold_shipped", False):
        target = Path(tempfile.mkdtemp(prefix="spark-motifold-")) / "motifold.zip"
        with zipfile.ZipFile(target, "w") as out:
            for p in sorted(PACKAGE.rglob("*.py")):
                out.write(p, p.relative_to(PACKAGE.parent))
        context.addPyFile(str(target))
        context._motifold_shipped = True
    return spark


def shared_path(spark: SparkSession) -> str:
    """A new path under spark.checkpoint.dir, which driver and executors share. Where that is unset: a temporary folder on one
    machine (tests), an error on a cluster."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-motifold-")
    return f"{base.rstrip('/')}/motifold/{context.applicationId}/{uuid.uuid4().hex}"


#: Bytes a task slot of files up to which their rows are dealt anew.
SMALL_BYTES = 8 << 20


def dealt(files: DataFrame) -> DataFrame:
    """A table as read from files, or, if it is small, its rows dealt over all task slots: a small file is one task else,
    however much work its rows are. Larger tables have tasks enough, and are never moved."""
    slots = files.sparkSession.sparkContext.defaultParallelism
    size = int(str(files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return files.repartition(slots) if size <= slots * SMALL_BYTES else files
