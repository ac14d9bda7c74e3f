"""Session settings, and this package on the executors."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def session(name: str = "platelab", **settings: str) -> SparkSession:
    """A session with the library's settings; shuffle partitions and memory are the cluster's business."""
    builder = SparkSession.builder.appName(name)
    for key, value in (SETTINGS | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: A batch handed to Python ends here even if it holds few rows.
BATCH_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that Arrow functions can import it, and bound the
    batches that these get."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub(r"\D", "", spark.conf.get(key))) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    sc = spark.sparkContext
    if getattr(sc, "_has_platelab", None) != sc.applicationId:
        root = Path(__file__).resolve().parent
        packed = Path(tempfile.mkdtemp(prefix="platelab-")) / "platelab_code.zip"
        with zipfile.ZipFile(packed, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(str(packed))
        sc._has_platelab = sc.applicationId


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Where none is set, a session on one machine gets a folder of its own; on a cluster that is an error.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def checkpointed(rows: DataFrame) -> DataFrame:
    """Write ``rows`` to the shared folder as Parquet and read it again: lineage is cut, and each row is made once."""
    path = scratch(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
