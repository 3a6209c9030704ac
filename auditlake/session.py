"""Session defaults and small helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
    "spark.ui.enabled": "false",
}


def build_session(app: str = "auditlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; `conf` overrides them."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**DEFAULTS, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; set a local one only where none is named."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("on a cluster, name a shared folder in spark.checkpoint.dir")
    sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "auditlake-checkpoints"))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give every executor this package's code, once per application.

    Python workers import the functions they run; on a cluster the package need not be
    installed there. The archive holds code only and travels through Spark's file server.
    """
    import atexit
    import shutil
    from pathlib import Path

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    here = Path(__file__).resolve().parent
    to = tempfile.mkdtemp(prefix="auditlake-code-")
    atexit.register(shutil.rmtree, to, True)
    stage = Path(to) / "stage"
    shutil.copytree(here, stage / here.name, ignore=shutil.ignore_patterns("__pycache__", "*.pyc"))
    sc.addPyFile(shutil.make_archive(str(Path(to) / "auditlake_code"), "zip", stage))
    _SHIPPED.add(sc.applicationId)
