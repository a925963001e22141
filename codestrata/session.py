"""Session helpers: settings that suit both a cluster and local tests, and shipping the package to executors."""

from __future__ import annotations

import atexit
import contextlib
import io
import os
import tempfile
import zipfile
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent
_SHIPPED: set[str] = set()
_DROPPED: set[str] = set()


def build_session(app: str = "codestrata", master: str | None = None, **settings: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow transfer; ``settings`` use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in settings.items()}
    return builder.config(map=conf).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent).as_posix())
    path = os.path.join(tempfile.mkdtemp(prefix="codestrata-"), "codestrata.zip")
    Path(path).write_bytes(data.getvalue())
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.  Where that is unset, a local one is made if all
    executors run inside the driver; on a cluster other machines would not see it, so that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = Path(tempfile.mkdtemp(prefix="codestrata-checkpoints-")).as_uri()
        spark.conf.set("spark.checkpoint.dir", folder)
        _drop_at_exit(spark, folder)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def own_folder(spark: SparkSession, kind: str) -> str:
    """The path of a new folder below the shared one, for tables that later steps read; those of one application are removed
    together when the program ends."""
    top = f"{shared_dir(spark)}/codestrata-{spark.sparkContext.applicationId}"
    _drop_at_exit(spark, top)
    return f"{top}/{kind}-{uuid4().hex}"


def _drop_at_exit(spark: SparkSession, folder: str) -> None:
    if folder in _DROPPED:
        return
    _DROPPED.add(folder)
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def drop() -> None:
        with contextlib.suppress(Exception):  # the program is ending: the JVM or the store may be gone
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)

    atexit.register(drop)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
