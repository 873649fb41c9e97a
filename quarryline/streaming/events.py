"""Event streams: windowed counts under a watermark, deduplication, and idempotent upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quarryline.operators.dedup import upserted


def read_stream(spark: SparkSession, folder: str, schema: str | StructType, files_per_batch: int = 64) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def window_counts(events: DataFrame, time: str, width: str, keys: Sequence[str], late: str | None = None) -> DataFrame:
    """Counts by fixed window and keys; of a stream with a watermark, windows are final once it has passed them."""
    source = events.withWatermark(time, late) if late else events
    return source.groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")


def deduplicated(events: DataFrame, time: str, key: str, late: str) -> DataFrame:
    """Events of a stream, each key once among those that come at most ``late`` apart."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def upsert_into(
    stream: DataFrame, table: str, keys: Sequence[str], updates: Sequence[str], checkpoint: str, order: Sequence[str] = (), buckets: int = 16
) -> StreamingQuery:
    """Merges each batch into a Parquet table; a batch that runs again leaves the same table.

    Of a batch's rows with equal keys the largest by ``order``, then by all columns, counts. Rows lie in buckets by the hash of
    their keys; a batch writes the buckets that it touches into a version of its own, which counts once it is whole. Use
    ``read_upserted`` to read the table.
    """
    spark = stream.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        rest = [c for c in batch.columns if c not in keys]
        last = F.max_by(F.struct(*rest), F.struct(*order, *(c for c in rest if c not in order)))
        latest = batch.groupBy(*keys).agg(last.alias("__v")).select(*keys, *(f"__v.{c}" for c in rest)).select(batch.columns)
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        touched = [r[0] for r in latest.select(bucket).distinct().collect()]
        before = read_upserted(spark, table, batch.schema, number, touched)
        if before is not None:
            latest = upserted(before, latest, keys, updates).drop("is_new")
        latest.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/v={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_upserted(spark: SparkSession, table: str, schema: StructType | None = None, before: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame | None:
    """The rows of a table that ``upsert_into`` wrote: of each bucket the newest whole version, below ``before``; None without any."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    newest: dict[int, int] = {}
    for folder in store.listStatus(path) if store.exists(path) else []:
        number = folder.getPath().getName().removeprefix("v=")
        whole = number.isdigit() and store.exists(spark._jvm.org.apache.hadoop.fs.Path(folder.getPath(), "_SUCCESS"))
        if whole and (before is None or int(number) < before):
            for part in store.listStatus(folder.getPath()):
                name = part.getPath().getName()
                if name.startswith("bucket=") and (buckets is None or int(name[7:]) in buckets):
                    newest[int(name[7:])] = max(newest.get(int(name[7:]), -1), int(number))
    if not newest:
        return None
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(*(f"{table}/v={v}/bucket={b}" for b, v in sorted(newest.items())))


def pending(every: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What a resumed run still has to do."""
    return every.join(done.select(*keys).distinct(), list(keys), "left_anti")


def backfilled(rows: DataFrame, computed: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """``rows`` where a null in a column has the computed value."""
    fresh = computed.select(*keys, F.col(column).alias("__c")).dropDuplicates(list(keys))
    return rows.join(fresh, list(keys), "left").withColumn(column, F.coalesce(column, "__c")).drop("__c")
