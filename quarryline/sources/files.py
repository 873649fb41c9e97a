"""Readers and writers with explicit contracts: text tables, lists of several formats, guarded appends, packages."""

from __future__ import annotations

import json
import zipfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CSV = {"header": True, "multiLine": True, "escape": '"', "quote": '"', "mode": "PERMISSIVE"}


def read_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A table of texts with names from its header; fields may have line breaks. Gzip is read as it is."""
    return spark.read.options(**CSV).csv(path)


def read_or_empty(spark: SparkSession, path: str, schema: str, form: str = "parquet") -> DataFrame:
    """A table, or an empty one of the schema if there is nothing at the path."""
    try:
        reader = spark.read.schema(schema)
        return reader.options(**CSV).csv(path) if form == "csv" else reader.format(form).load(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def has_rows(df: DataFrame, condition: str = "true") -> bool:
    return not df.filter(condition).isEmpty()


def language_from_name(df: DataFrame, pattern: str = r"^([A-Za-z]+)", name: str = "language") -> DataFrame:
    """``df`` with the language in its rows' file names."""
    return df.withColumn(name, F.lower(F.regexp_extract(F.col("_metadata.file_name"), pattern, 1)))


#: Endings of list files, the preferred first.
PREFERRED = (".csv.gz", ".csv", ".json.gz", ".json", ".txt", ".list")


def preferred(paths: Sequence[str]) -> list[str]:
    """Of files that differ only in their ending the one with the preferred ending."""
    chosen: dict[str, tuple[int, str]] = {}
    for path in sorted(paths):
        for rank, ending in enumerate(PREFERRED):
            if path.endswith(ending):
                base = path[: -len(ending)]
                chosen[base] = min(chosen.get(base, (rank, path)), (rank, path))
                break
    return sorted(p for _, p in chosen.values())


def read_names(spark: SparkSession, path: str, column: str = "name") -> DataFrame:
    """Names from a list file: a CSV column, a line each, or JSON: texts, objects, or objects in ``items``."""
    if path.endswith((".csv", ".csv.gz")):
        return read_csv(spark, path).select(F.trim(column).alias("name")).filter("name <> ''")
    if path.endswith((".json", ".json.gz")):
        whole = spark.read.text(path, wholetext=True)
        parsed = whole.select(F.try_parse_json("value").alias("v"))
        root = F.coalesce(F.expr("try_variant_get(v, '$.items', 'array<variant>')"), F.expr("try_variant_get(v, '$', 'array<variant>')"))
        each = parsed.select(F.explode(root).alias("x"))
        # A text of its own can't be asked for a field, and an object isn't a name.
        field = F.coalesce(F.expr("try_variant_get(x, '$.repository', 'string')"), F.expr(f"try_variant_get(x, '$.{column}', 'string')"))
        own = F.when(F.expr("schema_of_variant(x) = 'STRING'"), F.expr("try_variant_get(x, '$', 'string')"))
        return each.select(F.trim(F.coalesce(field, own)).alias("name")).filter("name <> ''")
    lines = spark.read.text(path).select(F.trim("value").alias("name"))
    return lines.filter((F.col("name") != "") & ~F.col("name").startswith("#"))


def write_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Overwrites a CSV table with fixed columns; what is missing is an empty text."""
    full = df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns))
    full.write.mode("overwrite").options(header=True, escape='"', quote='"', emptyValue="").csv(path)


class SchemaDrift(ValueError):
    """Rows to be appended don't have the columns of the table."""


def append(df: DataFrame, path: str, form: str = "parquet", partition: Sequence[str] = ()) -> None:
    """Appends rows to a table; other columns or types than its own are an error, before anything is written."""
    try:
        have = df.sparkSession.read.format(form).load(path).schema
    except AnalysisException:
        have = None
    if have is not None and {(f.name, f.dataType.simpleString()) for f in have} != {(f.name, f.dataType.simpleString()) for f in df.schema}:
        raise SchemaDrift(f"columns are {df.schema.simpleString()}, the table has {have.simpleString()}")
    ordered = df if have is None else df.select(*(f.name for f in have))
    ordered.write.mode("append").format(form).partitionBy(*partition).save(path)


def with_columns_of(df: DataFrame, defaults: dict[str, tuple[str, object]]) -> DataFrame:
    """``df`` with the columns that it lacks, as (type, default)."""
    for name, (kind, value) in defaults.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(value).cast(kind))
    return df


def read_rules(path: str) -> list[dict]:
    """A rule table: YAML if it ends so, else CSV whose lines with # are comments."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        import yaml

        return yaml.safe_load(text)
    import csv

    return list(csv.DictReader(x for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#")))


def write_summary(rows: dict, path: str) -> None:
    Path(path).write_text(json.dumps(rows, indent=2, sort_keys=True, default=str), encoding="utf-8")


def markdown_table(df: DataFrame, digits: int = 3, most: int = 1000) -> str:
    """A small result as a Markdown table; a result of more than ``most`` rows is an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report table has more than {most} rows")
    cell = lambda v: "--" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)])


def package(files: dict[str, bytes], path: str) -> None:
    """Small files in a ZIP archive, in name order and with a fixed date."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for name in sorted(files):
            archive.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), files[name])


def package_problems(path: str, headers: dict[str, Sequence[str]]) -> list[str]:
    """What a package lacks: files, or columns in the first line of its CSV files."""
    with zipfile.ZipFile(path) as archive:
        names = set(archive.namelist())
        found = [f"missing {n}" for n in headers if n not in names]
        for name, columns in headers.items():
            if name in names:
                first = archive.read(name).decode("utf-8").split("\n", 1)[0].strip().split(",")
                found += [f"{name} has no column {c}" for c in columns if c not in first]
    return found
