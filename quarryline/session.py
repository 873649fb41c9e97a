"""What every query needs of a session: tables, and the package on the workers."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes that go to a Python worker at once at most, but for one row that is larger.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
#: Applications whose Python workers have been given the package.
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package wherever they run: its sources go along with the application, once.

    Batches are bounded, so that what a worker holds follows neither the rows of a partition nor their texts.
    """
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}").rstrip("bB")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent))
    target = os.path.join(tempfile.mkdtemp(prefix="quarryline-"), f"{root.name}.zip")
    Path(target).write_bytes(data.getvalue())
    context.addPyFile(target)
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a fresh one in local runs without it.

    On a cluster a session without that setting raises an error: a folder of one machine is not shared.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="quarryline-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: The tables that are stored within each open scope.
_scopes: list[list[str]] = []


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that were stored within it at its end: what is made of them must have been written by then.

    A table that is stored with ``kept`` belongs to the scope around it.
    """
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def stored(df: DataFrame, label: str, kept: bool = False) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read again, so that a lost executor costs one step."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    if len(_scopes) > kept:
        _scopes[-1 - kept].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
