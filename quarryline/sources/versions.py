"""Tables that change together: a version is a manifest that names the files of all of them, and counts once it is there.

A writer reads a version, writes whole new tables beside it, checks that no child lacks its parent, and puts the next manifest
in place without overwriting. If a rival's manifest is there first, it starts again from that. Readers take one manifest, so
they see all changes of a version or none, and a writer that dies leaves only files that no manifest names.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarryline.operators.dedup import orphans, resynced, upserted


@dataclass(frozen=True)
class Link:
    """Rows of ``child`` whose ``foreign`` isn't null need a row of ``parent`` with that ``key``."""

    child: str
    foreign: str
    parent: str
    key: str


class OrphanError(ValueError):
    """A version would have children without a parent."""


class TooManyRivals(RuntimeError):
    """Other writers were first each time."""


class Versions:
    """The versions of some tables below ``root``, a folder that all machines share."""

    def __init__(self, spark: SparkSession, root: str, links: Sequence[Link] = ()) -> None:
        self.spark, self.root, self.links = spark, root.rstrip("/"), links
        self.jvm = spark._jvm.org.apache.hadoop.fs
        self.files = self.jvm.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.Path(f"{self.root}/{name}")

    def newest(self) -> int:
        """The number of the newest version; 0 before the first."""
        folder = self._path("manifests")
        names = [s.getPath().getName() for s in self.files.listStatus(folder)] if self.files.exists(folder) else []
        return max((int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.newest() if version is None else version
        if not version:
            return {}
        stream = self.files.open(self._path(f"manifests/{version:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def tables(self, version: int | None = None) -> dict[str, DataFrame]:
        """All tables of one version, the newest if none is given."""
        found = self.manifest(version)
        return {name: self.spark.read.schema(StructType.fromJson(t["schema"])).parquet(f"{self.root}/{t['path']}") for name, t in found.items()}

    def _publish(self, version: int, manifest: dict) -> bool:
        """Whether the manifest is now that of ``version``; not if there is one already."""
        self.files.mkdirs(self._path("manifests"))
        draft = self._path(f"manifests/.{version:012d}-{uuid.uuid4().hex}")
        stream = self.files.create(draft, False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        target = self._path(f"manifests/{version:012d}.json")
        try:
            if self.files.getScheme() == "file":
                # A local rename may overwrite; a link doesn't.
                os.link(draft.toUri().getPath(), target.toUri().getPath())
            else:
                options = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
                nothing = self.spark.sparkContext._gateway.new_array(options, 1)
                nothing[0] = options.NONE
                self.jvm.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, target, nothing)
            return True
        except Exception:
            if self.files.exists(target):
                return False
            raise
        finally:
            self.files.delete(draft, False)

    def _write(self, tables: dict[str, DataFrame], folder: str) -> dict:
        out = {}
        for name, rows in tables.items():
            rows.write.parquet(f"{self.root}/{folder}/{name}")
            out[name] = {"path": f"{folder}/{name}", "schema": rows.schema.jsonValue()}
        return out

    def _check(self, manifest: dict, changed: set[str]) -> None:
        def table(name: str) -> DataFrame:
            return self.spark.read.schema(StructType.fromJson(manifest[name]["schema"])).parquet(f"{self.root}/{manifest[name]['path']}")

        for link in self.links:
            if link.child in manifest and {link.child, link.parent} & changed:
                children = table(link.child).filter(F.col(link.foreign).isNotNull())
                lost = orphans(children, table(link.parent), link.foreign, link.key) if link.parent in manifest else children
                if not lost.isEmpty():
                    raise OrphanError(f"{link.child}.{link.foreign} without {link.parent}.{link.key}: {lost.select(link.foreign).first()[0]}")

    def change(self, make: Callable[[dict[str, DataFrame]], dict[str, DataFrame]], tries: int = 20) -> int:
        """Makes a new version of what ``make`` gives for the tables of the newest one; tables that it doesn't give stay.

        Returns the version's number. ``make`` runs again on a rival's version if that came first, ``tries`` times at most. An
        orphan raises OrphanError, and no version comes of it.
        """
        for _ in range(tries):
            base = self.newest()
            folder = f"data/{uuid.uuid4().hex}"
            try:
                changed = make(self.tables(base))
                manifest = self.manifest(base) | self._write(changed, folder)
                self._check(manifest, set(changed))
                if self._publish(base + 1, manifest):
                    return base + 1
            except BaseException:
                self.files.delete(self._path(folder), True)
                raise
            self.files.delete(self._path(folder), True)
        raise TooManyRivals(self.root)

    def clean(self, keep: int = 2) -> int:
        """Removes the versions before the last ``keep`` and the files that none names; only while no writer is at work."""
        newest = self.newest()
        used = {t["path"].split("/")[1] for v in range(max(1, newest - keep + 1), newest + 1) for t in self.manifest(v).values()}
        gone = 0
        for folder, wanted in (("data", lambda n: n in used), ("manifests", lambda n: n.removesuffix(".json").isdigit() and int(n.removesuffix(".json")) > newest - keep)):
            for status in self.files.listStatus(self._path(folder)) if self.files.exists(self._path(folder)) else []:
                if not wanted(status.getPath().getName()):
                    gone += self.files.delete(status.getPath(), True)
        return gone


@dataclass(frozen=True)
class Level:
    """New rows of a table of a nested load, keyed by ``keys``; ``counts`` is the parent's column with the number of its rows."""

    table: str
    rows: DataFrame
    keys: tuple[str, ...]
    foreign: str | None = None
    parent: str | None = None
    parent_key: str | None = None
    counts: str | None = None


def persist(store: Versions, levels: Sequence[Level], tries: int = 20) -> int:
    """Upserts rows of nested tables, parents first in ``levels``, and counts children anew, all as one version.

    Rows with a key that is there replace what they bring; of equal keys among the new rows the largest row counts. Children
    without a parent in the new version raise OrphanError.
    """

    def make(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        out: dict[str, DataFrame] = {}
        for level in levels:
            rest = [c for c in level.rows.columns if c not in level.keys]
            latest = level.rows.groupBy(*level.keys).agg(F.max(F.struct(*rest)).alias("v")).select(*level.keys, *(F.col(f"v.{c}").alias(c) for c in rest))
            old = tables.get(level.table)
            if old is not None:
                for c in old.columns:
                    if c not in latest.columns:
                        latest = latest.withColumn(c, F.lit(None).cast(old.schema[c].dataType))
                latest = upserted(old, latest.select(old.columns), level.keys, rest).drop("is_new").select(old.columns)
            out[level.table] = latest
        for level in levels:
            if level.counts and level.parent:
                parents = out.get(level.parent, tables.get(level.parent))
                if parents is not None:
                    out[level.parent] = resynced(parents, out[level.table], level.parent_key, level.foreign, {level.counts: F.count("*")})
        return out

    return store.change(make, tries)
