"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from functools import wraps
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A batch handed to Python ends here even if it holds few rows, so that very long texts do not pile up.
BATCH_BYTES = 8 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def prepare(spark: SparkSession) -> None:
    """What operators with Python code need: this package on the executors, and batches of bounded size."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub(r"\D", "", spark.conf.get(key))) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    sc = spark.sparkContext
    if getattr(sc, "_has_platelab", None) != sc.applicationId:
        root = Path(__file__).resolve().parents[1]
        packed = Path(tempfile.mkdtemp(prefix="platelab-")) / "platelab_code.zip"
        with zipfile.ZipFile(packed, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(str(packed))
        sc._has_platelab = sc.applicationId


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares: the session's ``spark.checkpoint.dir``.

    Where none is set, a session on one machine gets a folder of its own; on a cluster that is an error.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def clean(spark: SparkSession) -> None:
    """Delete what this application has written to the shared folder, when its results are no longer needed."""
    sc = spark.sparkContext
    if folder := sc.getCheckpointDir():
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).mkdirs(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it again."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def nested(docs: DataFrame, *more: Column) -> DataFrame:
    """Each whole row as the struct ``row``, next to columns of the operator's own, which then can't clash with it."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *more)


def as_bytes(text: str | None) -> bytes:
    """UTF-8 of a text; null counts as empty, lone surrogates as question marks."""
    return b"" if text is None else text.encode("utf-8", "replace")


#: A joined side is broadcast if it has been counted and has no more rows than this.
BROADCAST_ROWS = 10_000


def counted_side(df: DataFrame) -> DataFrame:
    """``df``, written and counted; marked for broadcast only within the bound, else joined by shuffling."""
    done = checkpointed(df)
    return F.broadcast(done) if done.count() <= BROADCAST_ROWS else done


def give_back() -> None:
    """Memory that this process has freed goes back to the system, as the executor's other workers share its limit."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not the C library of GNU
        ctypes.CDLL(None).malloc_trim(0)


def freeing(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``task`` of ``mapInArrow``, after which the worker gives back memory, as it may stay idle for long."""

    @wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        give_back()

    return run


def freeing_group(task: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """The same for a function of ``applyInArrow``."""

    def run(table: pa.Table) -> pa.Table:
        out = task(table)
        give_back()
        return out

    return run


_held: dict[str, Callable[[], None]] = {}
_turned: list[str] = []


def turn_to(operator: str, drop: Callable[[], None] | None = None) -> None:
    """A worker turns to an operator: what it remembers for others is dropped. ``drop`` forgets what this one remembers."""
    if _turned == [operator]:
        return
    _turned[:] = [operator]
    for name in [n for n in _held if n != operator]:
        _held.pop(name)()
    give_back()
    if drop:
        _held[operator] = drop
