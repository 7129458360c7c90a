"""Session plumbing: tables, shared scratch space and shipping this package to executors."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()
#: Frames written in each open ``scratch``.
_open: list[list[DataFrame]] = []
#: Spark deletes the shuffles of a command when it ends; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; only Spark opens the path, so any Hadoop file system will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only where the setting is absent and the master is local (unit tests, a laptop) is a temporary folder made, and it
    is removed when the process ends. A cluster without the setting gets an error: its executors share no such folder.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not getattr(scratch_dir, "own", None):
        scratch_dir.own = tempfile.mkdtemp(prefix="marginalia-")
        atexit.register(shutil.rmtree, scratch_dir.own, ignore_errors=True)
    return f"file://{scratch_dir.own}"


def materialise(df: DataFrame, label: str = "stage") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage is cut, and a lost
    executor costs a re-read instead of a recomputation. The shuffles of the write go as it ends."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/marginalia/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    frame = spark.read.schema(df.schema).parquet(path)
    frame.written_to = [path]
    if _open:
        _open[-1].append(frame)
    return frame


def release(*frames: DataFrame | None) -> None:
    """Deletes the files of frames that ``materialise`` gave and that nothing will read again; other frames are left alone."""
    for frame in frames:
        paths = frame.__dict__.get("written_to", []) if frame is not None else []
        while paths:
            at = frame.sparkSession._jvm.org.apache.hadoop.fs.Path(paths.pop())
            at.getFileSystem(frame.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def told(frame: DataFrame, of: DataFrame) -> DataFrame:
    """``frame``, which reads only ``of``: releasing one releases the other."""
    frame.written_to = of.__dict__.get("written_to", [])
    return frame


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What ``materialise`` writes inside is released at the end, but for the frames given to the function that this gives."""
    mine: list[DataFrame] = []
    kept: list[DataFrame] = []
    _open.append(mine)
    try:
        yield lambda frame: kept.append(frame) or frame
    finally:
        _open.pop()
        release(*[f for f in mine if not any(f.written_to is k.written_to for k in kept)])
        if _open:
            _open[-1].extend(kept)


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df`` with the broadcast hint if it has at most ``rows`` rows, which are counted; else as it is."""
    return F.broadcast(df) if df.count() <= rows else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt anew over the shuffle's partitions: rows that are little to read and much to work on lie in few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def ship_package(spark: SparkSession) -> None:
    """Gives the Python workers this package, once per application, wherever it was imported from."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    folder = tempfile.mkdtemp(prefix="marginalia-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, f"{root.name}.zip")
    Path(path).write_bytes(buffer.getvalue())
    context.addPyFile(path)
    _shipped.add(context.applicationId)
