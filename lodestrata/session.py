"""Session factory, table access and the checkpoint folder."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "lodestrata", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume: UTC, AQE, Arrow."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once a context, so that their Python workers can import it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_lodestrata_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="lodestrata-package-")) / "lodestrata.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    sc._lodestrata_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide(spark: SparkSession, least: int = 1) -> int:
    """Partitions for a shuffle in front of heavy work: a number that is given isn't coalesced to the size of the data."""
    conf = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(conf, 2 * spark.sparkContext.defaultParallelism, least)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    ``spark.checkpoint.dir`` wins where it is set (a folder all executors share); where it is unset, a
    temporary folder is made for a local master, and any other master raises: no machine's own folder serves a cluster.
    """
    sc = spark.sparkContext
    have = sc.getCheckpointDir()
    if have:
        return have
    where = sc.getConf().get("spark.checkpoint.dir", None)
    if not where:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="lodestrata-checkpoint-", dir=os.environ.get("TMPDIR"))
    sc.setCheckpointDir(where)
    return where


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written once to the checkpoint folder and read from there on."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the checkpoint folder; smaller than a checkpoint, and ``drop_written`` can take it back."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestrata_path = path
    return out


def drop_written(df: DataFrame) -> None:
    """Deletes the table of a DataFrame that ``written`` returned; nothing may read it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._lodestrata_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of finished rounds, which otherwise stay until the driver happens to collect its garbage.

    What holds them is released in two steps (plans, then the shuffles they refer to), and the cleaner works on its own, so it is given a moment after each.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)
