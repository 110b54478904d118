"""Session defaults and the shared-folder checkpoint rule."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings for a session we create ourselves; a session given to us is never changed.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4000",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",  # what no DataFrame refers to any more is deleted
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int = 8, memory: str = "12g", app: str = "graphloom") -> SparkSession:
    """A local session for tests, the bench and notebooks."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for k, v in DEFAULTS.items():
        b = b.config(k, v)
    b = b.config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", str(cpus))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in spark.checkpoint.dir; set one only where none is named (local tests)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named and not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="graphloom-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder: later steps read files, so a lost executor costs no recomputation of the lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_SHIPPED: dict[int, str] = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of the session, once, so that they need no installation of it."""
    sc = spark.sparkContext
    key = id(sc)
    if _SHIPPED.get(key) == sc.applicationId:
        return
    here = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="graphloom-code-")) / "graphloom.zip"  # read once by the driver's file server
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, Path("graphloom") / p.relative_to(here))
    sc.addPyFile(str(target))
    _SHIPPED[key] = sc.applicationId
