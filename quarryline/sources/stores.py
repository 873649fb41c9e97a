"""Stores beside plain files: SQLite tables as a data source, partial updates, schema growth, progress and stage folders."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from quarryline.sources.files import append, read_csv, read_or_empty, write_csv, write_summary

#: Types of SQLite's affinities.
AFFINITY = {"INTEGER": "bigint", "INT": "bigint", "BIGINT": "bigint", "REAL": "double", "DOUBLE": "double", "FLOAT": "double", "NUMERIC": "double", "TEXT": "string", "BLOB": "binary", "BOOLEAN": "bigint", "TIMESTAMP": "string"}


class SqliteSource(DataSource):
    """Tables of a SQLite file that all machines can open: options path, table and partitions.

    Partitions are ranges of row ids, read side by side without a lock; a file that isn't there is an error.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        import sqlite3

        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as c:
            columns = c.execute("SELECT name, type FROM pragma_table_info(?)", (self.options["table"],)).fetchall()
            # Affinities don't bind: a column with another kind of value is text.
            odd = {"INTEGER": "('integer', 'null')", "REAL": "('integer', 'real', 'null')"}
            names = {"bigint": "INTEGER", "double": "REAL"}
            for i, (n, t) in enumerate(columns):
                kind = names.get(AFFINITY.get(t.split("(")[0].upper(), "string"))
                if kind and c.execute(f"SELECT 1 FROM {_quoted(self.options['table'])} WHERE typeof({_quoted(n)}) NOT IN {odd[kind]} LIMIT 1").fetchone():
                    columns[i] = (n, "TEXT")
        if not columns:
            raise ValueError(f"there is no table {self.options['table']}")
        return ", ".join(f"`{n}` {AFFINITY.get(t.split('(')[0].upper(), 'string')}" for n, t in columns)

    def reader(self, schema) -> DataSourceReader:
        return SqliteReader(self.options, schema)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return SqliteWriter(self.options, schema, overwrite)


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, schema) -> None:
        self.path, self.table, self.parts = options["path"], options["table"], int(options.get("partitions", 8))
        self.names = [f.name for f in schema.fields]
        self.kinds = [f.dataType.simpleString() for f in schema.fields]

    def _open(self):
        import sqlite3

        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self) -> list[InputPartition]:
        import sqlite3

        with self._open() as c:
            try:
                low, high = c.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
            except sqlite3.OperationalError:
                # Views, and tables without row ids, are one part.
                return [InputPartition(None)]
        if low is None:
            return [InputPartition(None)]
        step = -(-(high - low + 1) // self.parts)
        return [InputPartition((at, min(at + step, high + 1) - 1)) for at in range(low, high + 1, step)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        columns = ", ".join(map(_quoted, self.names))
        make = {"bigint": int, "double": float, "string": str, "binary": bytes}
        with self._open() as c:
            where, values = (" WHERE rowid BETWEEN ? AND ?", partition.value) if partition.value else ("", ())
            for row in c.execute(f"SELECT {columns} FROM {_quoted(self.table)}{where}", values):
                yield tuple(None if v is None else make.get(k, lambda x: x)(v) for v, k in zip(row, self.kinds, strict=True))


@dataclass
class Shard(WriterCommitMessage):
    path: str


class SqliteWriter(DataSourceWriter):
    """Tasks write shards, SQLite files beside the target; the commit puts them into the table in one transaction.

    A task that fails, or a write that is aborted, leaves the target as it was. The rows of a commit go through one file, as
    the format has it: it is for exports and samples.
    """

    def __init__(self, options: dict, schema, overwrite: bool) -> None:
        import uuid

        self.path, self.table, self.overwrite = options["path"], options["table"], overwrite
        self.folder = f"{self.path}.parts-{uuid.uuid4().hex}"
        kinds = {"bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER", "tinyint": "INTEGER", "boolean": "INTEGER", "double": "REAL", "float": "REAL", "binary": "BLOB"}
        self.columns = ", ".join(f"{_quoted(f.name)} {kinds.get(f.dataType.simpleString(), 'TEXT')}" for f in schema.fields)
        self.values = ", ".join("?" for _ in schema.fields)
        self.plain = [f.dataType.simpleString() in kinds for f in schema.fields]

    def write(self, iterator: Iterator) -> Shard:
        import os
        import sqlite3
        import uuid

        os.makedirs(self.folder, exist_ok=True)
        path = f"{self.folder}/{uuid.uuid4().hex}.db"
        with sqlite3.connect(path) as c:
            c.execute(f"CREATE TABLE shard ({self.columns})")
            c.executemany(f"INSERT INTO shard VALUES ({self.values})", (tuple(v if v is None or plain else str(v) for v, plain in zip(row, self.plain, strict=True)) for row in iterator))
        c.close()
        return Shard(path)

    def commit(self, messages: list[Shard | None]) -> None:
        import sqlite3

        c = sqlite3.connect(self.path, isolation_level=None)
        try:
            name = _quoted(self.table)
            c.execute("BEGIN IMMEDIATE")
            if self.overwrite:
                c.execute(f"DROP TABLE IF EXISTS {name}")
            c.execute(f"CREATE TABLE IF NOT EXISTS {name} ({self.columns})")
            for message in messages:
                if message is not None:
                    shard = sqlite3.connect(f"file:{message.path}?mode=ro", uri=True)
                    c.executemany(f"INSERT INTO {name} VALUES ({self.values})", shard.execute("SELECT * FROM shard ORDER BY rowid"))
                    shard.close()
            c.execute("COMMIT")
        finally:
            c.close()
            self._drop()

    def abort(self, messages: list[Shard | None]) -> None:
        self._drop()

    def _drop(self) -> None:
        import shutil

        shutil.rmtree(self.folder, ignore_errors=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def write_sqlite(tables: dict[str, DataFrame], path: str) -> None:
    """Tables as a SQLite file of its own, on a path that all machines share: the file is there whole, or as it was before.

    Numbers and bytes keep their kind, other values are text; a table without rows has its columns.
    """
    import os
    import uuid

    draft = f"{path}.{uuid.uuid4().hex}"
    try:
        for name, rows in tables.items():
            rows.sparkSession.dataSource.register(SqliteSource)
            rows.write.format("sqlite_table").mode("append").options(path=draft, table=name).save()
        os.replace(draft, path)
    finally:
        if os.path.exists(draft):
            os.remove(draft)


def read_sqlite(spark: SparkSession, path: str, table: str, partitions: int = 8) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite_table").options(path=path, table=table, partitions=str(partitions)).load()


def read_sqlite_or_none(spark: SparkSession, path: str, table: str) -> DataFrame | None:
    """None without the file, so that a caller can skip it."""
    return read_sqlite(spark, path, table) if Path(path).exists() else None


def folded(rows: DataFrame, column: str = "language") -> DataFrame:
    """``rows`` with TypeScript counted as JavaScript."""
    return rows.withColumn(column, F.when(F.col(column) == "typescript", "javascript").otherwise(F.col(column)))


def sql_rows(spark: SparkSession, statement: str, tables: dict[str, DataFrame], column: str | None = "language") -> DataFrame:
    """A statement over tables that it names in braces, with languages folded if the result has that column."""
    out = spark.sql(statement, **tables)
    return folded(out, column) if column in out.columns else out


def updated(rows: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` where a change has the key: its values that aren't null replace the old ones. Of several changes the least counts."""
    values = [c for c in changes.columns if c not in keys]
    one = changes.groupBy(*keys).agg(F.min(F.struct(*values)).alias("__new"))
    out = rows.join(one, list(keys), "left")
    return out.select(*(F.coalesce(F.col(f"__new.{c}"), F.col(c)).alias(c) if c in values else F.col(c) for c in rows.columns))


def grown(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``rows`` with columns that a newer schema has, as nulls of their types; running it again changes nothing."""
    for name, kind in columns.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    return rows


def create_tables(spark: SparkSession, root: str, schemas: dict[str, str]) -> None:
    """Empty tables where there are none yet."""
    for name, schema in schemas.items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{root}/{name}")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of tables, 0 for an empty one."""
    out = None
    for name, rows in sorted(tables.items()):
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def split_by_names(rows: DataFrame, key: str, lists: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The rows whose key is in each list (name); a key in none of them is in none of the parts."""
    return {part: rows.join(names.select(F.col("name").alias(key)).distinct(), key, "left_semi") for part, names in lists.items()}


def write_by_language(rows: DataFrame, folder: str, column: str = "language") -> None:
    """One folder for each language, and all rows together, in place of what was there."""
    rows.write.mode("overwrite").partitionBy(column).options(header=True, escape='"').csv(f"{folder}/by_language")
    write_csv(rows, f"{folder}/all", rows.columns)


def append_commits(rows: DataFrame, folder: str, state: str) -> dict:
    """Appends commit rows by language that aren't there yet, and writes what is there now as JSON."""
    spark = rows.sparkSession
    have = read_or_empty(spark, folder, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema))
    fresh = rows.join(have.select("repo", "sha"), ["repo", "sha"], "left_anti").dropDuplicates(["repo", "sha"])
    append(fresh, folder, partition=["language"])
    counts = {r.language: r.n for r in spark.read.parquet(folder).groupBy("language").agg(F.count("*").alias("n")).collect()}
    write_summary({"commits": counts}, state)
    return counts


def truncated(spark: SparkSession, paths: dict[str, Sequence[str]]) -> None:
    """Tables with their header alone, so that rows of an older run can't stay."""
    for path, columns in paths.items():
        write_csv(spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns)), path, columns)


def read_tree(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, length, source) of the text files below a folder, in path order of their names."""
    files = spark.read.format("binaryFile").options(recursiveFileLookup="true", pathGlobFilter=pattern).load(folder)
    base = folder.rstrip("/").split("://")[-1]
    inner = F.regexp_replace(F.col("path"), f"^(?:[a-z]+:)?/*{base.lstrip('/')}/", "")
    return files.select(inner.alias("path"), "length", F.decode("content", "UTF-8").alias("source"))


class Progress:
    """Steps that units have completed, in a table of its own; marking a step again changes nothing."""

    SCHEMA = "unit string, step string"
    #: The unit of a step that concerns a whole run.
    WHOLE = "*"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        return read_or_empty(self.spark, self.path, self.SCHEMA).distinct()

    def mark(self, units: DataFrame | None, step: str) -> None:
        """Marks a step of units (unit), or of the whole run."""
        new = self.spark.range(1).select(F.lit(self.WHOLE).alias("unit")) if units is None else units.select("unit").distinct()
        fresh = new.withColumn("step", F.lit(step)).join(self.rows(), ["unit", "step"], "left_anti")
        append(fresh, self.path)

    def is_done(self, step: str, unit: str | None = None) -> bool:
        return not self.rows().filter((F.col("step") == step) & (F.col("unit") == (unit or self.WHOLE))).isEmpty()

    def pending(self, units: DataFrame, step: str) -> DataFrame:
        return units.join(self.rows().filter(F.col("step") == step).select("unit"), "unit", "left_anti")

    def unless_done(self, step: str, work: Callable[[], None], force: bool = False) -> bool:
        """Runs a step that isn't marked, or any with ``force``, and marks it when it is over; tells whether it ran."""
        if self.is_done(step) and not force:
            return False
        work()
        self.mark(None, step)
        return True


def newest(spark: SparkSession, pattern: str) -> str | None:
    """Of the files and folders that a path pattern names, in any store, the one that was changed last; of several the last by
    name. None without any."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return max(((s.getModificationTime(), s.getPath().toString()) for s in found), default=(0, None))[1]


def latest_file(folder: str, pattern: str) -> str | None:
    """The last file by name, which has its time, under a pattern; None without any."""
    found = sorted(str(p) for p in Path(folder).glob(pattern))
    return found[-1] if found else None


@dataclass(frozen=True)
class Stages:
    """Folders of the stages of a run, in their order."""

    root: str
    names: tuple[str, ...] = ("search", "quality", "commits", "fixtures", "export")

    def folder(self, stage: str) -> str:
        return f"{self.root}/{self.names.index(stage) + 1:02d}-{stage}"

    def before(self, stage: str) -> str | None:
        at = self.names.index(stage)
        return self.folder(self.names[at - 1]) if at else None

    def summary(self, stage: str) -> str:
        return f"{self.folder(stage)}/summary.json"

    def source(self, spark: SparkSession, stage: str) -> DataFrame | None:
        """The newest stage before this one that has a table."""
        for name in reversed(self.names[: self.names.index(stage)]):
            try:
                return spark.read.parquet(self.folder(name))
            except AnalysisException:
                continue
        return None


@dataclass(frozen=True)
class Parameters:
    """Limits of a study; a file may set some of them, and a name that isn't one is an error."""

    start_date: str = "2025-01-01"
    cutoff_date: str = "2020-12-31"
    min_commits: int = 100
    min_lines: int = 5000
    min_test_files: int = 5
    max_file_bytes: int = 5 << 20
    languages: tuple[str, ...] = ("python", "java", "javascript", "typescript")

    @classmethod
    def load(cls, path: str) -> Parameters:
        given = json.loads(Path(path).read_text(encoding="utf-8")) if path.endswith(".json") else _yaml(path)
        known = {f.name for f in fields(cls)}
        if strange := set(given) - known:
            raise ValueError(f"unknown parameters: {', '.join(sorted(strange))}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


def _yaml(path: str) -> dict:
    import yaml

    return yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}


def load_rules(path: str, columns: Sequence[str]) -> list[dict]:
    """A rule table with the given columns; a rule without one of them is an error."""
    from quarryline.sources.files import read_rules

    rules = read_rules(path)
    for k, rule in enumerate(rules):
        if lacks := [c for c in columns if not rule.get(c)]:
            raise ValueError(f"rule {k + 1} of {path} has no {', '.join(lacks)}")
    return rules


def load_repos(spark: SparkSession, path: str) -> DataFrame:
    """Repositories (repo_name, language, stars, clone_url) of a list with any further columns; rows without a name are left out."""
    rows = read_csv(spark, path)
    named = grown(rows, {"repo_name": "string", "full_name": "string", "language": "string", "stars": "string", "clone_url": "string"})
    name = F.coalesce(F.nullif(F.trim("repo_name"), F.lit("")), F.nullif(F.trim("full_name"), F.lit("")))
    url = F.coalesce(F.nullif(F.trim("clone_url"), F.lit("")), F.concat(F.lit("https://github.com/"), name, F.lit(".git")))
    stars = F.coalesce(F.trim("stars").try_cast("double").try_cast("long"), F.lit(0).cast("long"))
    return named.select(name.alias("repo_name"), F.lower(F.trim("language")).alias("language"), stars.alias("stars"), url.alias("clone_url")).filter(F.contains("repo_name", F.lit("/")))
