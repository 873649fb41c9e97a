"""Work on many units, one by one, so that nothing is lost or done twice: units come as a stream, and each attempt at a batch
becomes one folder with results and marks together. A folder that is whole counts; a run that died goes on behind it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

#: Characters of an error that are kept.
ERROR = 500


def work_through(units: DataFrame, key: str, do: Callable[[dict], list[dict]], schema: StructType, out: str, checkpoint: str, tries: int = 3) -> None:
    """Does ``do`` for each unit of a stream that is there now; ``do`` takes a row as a dict and gives its result rows.

    Units that raise an error are tried again, ``tries`` times in all, and then set aside as poison with their last error. A
    unit whose key was done in an earlier batch isn't done again. Of equal keys in a batch one row counts, the largest. A null
    key is one key. ``out`` has a folder for each attempt; an attempt that was whole before a run died isn't repeated.
    """
    spark = units.sparkSession
    shape = StructType([units.schema[key], StructField("status", StringType()), StructField("error", StringType()), StructField("tries", IntegerType()), StructField("rows", ArrayType(schema))])

    def attempt(todo: DataFrame, number: int) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                made = []
                for row in frame.to_dict("records"):
                    try:
                        made.append((row[key], "done", None, number, list(do(row))))
                    except Exception as e:
                        made.append((row[key], "poison" if number == tries else "failed", f"{type(e).__name__}: {e}"[:ERROR], number, None))
                yield pd.DataFrame(made, columns=[f.name for f in shape])

        return todo.mapInPandas(run, shape)

    def batch(frame: DataFrame, batch_id: int) -> None:
        rest = [c for c in frame.columns if c != key]
        todo = frame.groupBy(key).agg(F.max(F.struct(F.lit(0).alias("__"), *rest)).alias("v")).select(key, *(F.col(f"v.{c}").alias(c) for c in rest))
        before = marks(spark, out, shape, batch_id)
        if before is not None:
            todo = _without(todo, before.filter("status != 'failed'"), key)
        for number in range(1, tries + 1):
            folder = f"{out}/batch={batch_id}/attempt={number}"
            if not _whole(spark, folder):
                attempt(todo, number).write.mode("overwrite").parquet(folder)
            failed = spark.read.schema(shape).parquet(folder).filter("status = 'failed'").select(F.col(key).alias("__k"))
            if failed.isEmpty():
                break
            todo = todo.join(failed.distinct(), F.col(key).eqNullSafe(F.col("__k")), "left_semi")

    query = units.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def _without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(F.col(key).alias("__k")).distinct(), F.col(key).eqNullSafe(F.col("__k")), "left_anti")


def _whole(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def marks(spark: SparkSession, out: str, schema: StructType, before: int | None = None) -> DataFrame | None:
    """The attempts of all whole folders of batches below ``before``: key, status, error, tries, rows; None without any."""
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    whole = []
    for folder in store.listStatus(path) if store.exists(path) else []:
        name = folder.getPath().getName()
        if name.startswith("batch=") and (before is None or int(name[6:]) < before):
            whole += [f"{out}/{name}/{a.getPath().getName()}" for a in store.listStatus(folder.getPath()) if _whole(spark, f"{out}/{name}/{a.getPath().getName()}")]
    return spark.read.schema(schema).parquet(*whole) if whole else None


def outcome(spark: SparkSession, out: str, key: StructField, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """The result rows with their unit's key, and each unit with its last status: done, or poison with its error."""
    shape = StructType([key, StructField("status", StringType()), StructField("error", StringType()), StructField("tries", IntegerType()), StructField("rows", ArrayType(schema))])
    every = marks(spark, out, shape)
    every = spark.createDataFrame([], shape) if every is None else every
    results = every.filter("status = 'done'").select(key.name, F.explode("rows").alias("row")).select(key.name, "row.*")
    return results, every.filter("status != 'failed'").select(key.name, "status", "error", "tries")
