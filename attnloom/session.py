"""Session construction and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app: str = "attnloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on, whose executors can import this package; `conf` overrides any setting."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_code(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, named by the cluster in `spark.checkpoint.dir`.

    Only where the setting is absent (a local test session) is a temporary
    folder made; on a cluster the setting decides.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if not configured:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a shared folder before running on {master}")
        configured = tempfile.mkdtemp(prefix="attnloom-")
        spark.conf.set(CHECKPOINT_CONF, configured)
    return configured.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors, unlike cached blocks."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors, once per Spark application, so that Python workers can import it anywhere."""
    context = spark.sparkContext
    name = f"attnloom-{context.applicationId}.zip"
    if any(path.endswith(name) for path in context.listFiles):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="attnloom-code-"), name)
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, files in os.walk(root):
            for file in sorted(files):
                if file.endswith(".py"):
                    path = os.path.join(folder, file)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(archive)
