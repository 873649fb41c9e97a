"""Commits of repositories on disk, read from loose objects and pack files without any other program.

Partitions are ranges of a pack's index and the folders of loose objects, so one large repository is read by many tasks. Of an
object only its head is read until that tells a commit; a delta's head leads to its base, and only commits are put together.
"""

from __future__ import annotations

import mmap
import os
import struct
import zlib
from collections.abc import Iterator, Sequence
from datetime import UTC, datetime, timedelta, timezone
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quarryline.operators.graph import ancestors

SCHEMA = "repo string, sha string, parents array<string>, author_name string, author_email string, date string, committed string, message string"
#: Kinds of packed objects (fixed values).
COMMIT, OFFSET_DELTA, NAMED_DELTA = 1, 6, 7
#: Entries of a pack's index in one partition.
ENTRIES = 50_000


def git_folder(path: str) -> Path:
    """The folder with a repository's objects: the path itself, or what lies or is named in its .git."""
    inner = Path(path) / ".git"
    if inner.is_file():
        return Path(path) / inner.read_text().removeprefix("gitdir:").strip()
    return inner if inner.is_dir() else Path(path)


class Pack:
    """A pack file with its index of version 2."""

    def __init__(self, path: str) -> None:
        with open(path.removesuffix(".pack") + ".idx", "rb") as file:
            self.index = file.read()
        if self.index[:8] != b"\xfftOc\x00\x00\x00\x02":
            raise ValueError(f"not an index of version 2: {path}")
        self.fan = struct.unpack(">256I", self.index[8:1032])
        self.n = self.fan[255]
        self.file = open(path, "rb")  # noqa: SIM115
        self.data = mmap.mmap(self.file.fileno(), 0, access=mmap.ACCESS_READ)

    def name(self, i: int) -> bytes:
        return self.index[1032 + 20 * i : 1052 + 20 * i]

    def offset(self, i: int) -> int:
        at = 1032 + 24 * self.n + 4 * i
        (value,) = struct.unpack(">I", self.index[at : at + 4])
        if value < 1 << 31:
            return value
        at = 1032 + 28 * self.n + 8 * (value & 0x7FFFFFFF)
        return struct.unpack(">Q", self.index[at : at + 8])[0]

    def find(self, name: bytes) -> int | None:
        """The offset of an object."""
        low, high = self.fan[name[0] - 1] if name[0] else 0, self.fan[name[0]]
        while low < high:
            middle = (low + high) // 2
            if self.name(middle) < name:
                low = middle + 1
            else:
                high = middle
        return self.offset(low) if low < self.n and self.name(low) == name else None

    def head(self, at: int) -> tuple[int, int, int | bytes | None]:
        """An object's kind, where its content begins, and its base: an offset or a name."""
        byte = self.data[at]
        kind, at = byte >> 4 & 7, at + 1
        begin = at - 1
        while byte & 0x80:
            byte, at = self.data[at], at + 1
        if kind == OFFSET_DELTA:
            byte, at = self.data[at], at + 1
            back = byte & 0x7F
            while byte & 0x80:
                byte, at = self.data[at], at + 1
                back = (back + 1 << 7) | byte & 0x7F
            return kind, at, begin - back
        if kind == NAMED_DELTA:
            return kind, at + 20, bytes(self.data[at : at + 20])
        return kind, at, None

    def inflated(self, at: int) -> bytes:
        machine, parts = zlib.decompressobj(), []
        while not machine.eof:
            part = self.data[at : at + (1 << 16)]
            if not part:
                raise ValueError("a pack ends within an object")
            parts.append(machine.decompress(part))
            at += len(part)
        return b"".join(parts)


def patched(base: bytes, delta: bytes) -> bytes:
    """What a delta makes of its base."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = delta[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if not byte & 0x80:
                return value

    if number() != len(base):
        raise ValueError("a delta of another base")
    size, out = number(), []
    while at < len(delta):
        code, at = delta[at], at + 1
        if not code & 0x80:
            out.append(delta[at : at + code])
            at += code
            continue
        place = length = 0
        for k in range(7):
            if code >> k & 1:
                if k < 4:
                    place |= delta[at] << 8 * k
                else:
                    length |= delta[at] << 8 * (k - 4)
                at += 1
        length = length or 1 << 16
        out.append(base[place : place + length])
    made = b"".join(out)
    if len(made) != size:
        raise ValueError("a delta of another size")
    return made


class Objects:
    """The objects of one repository."""

    def __init__(self, folder: Path) -> None:
        self.folder = folder / "objects"
        self.packs: dict[str, Pack] = {}

    def pack(self, name: str) -> Pack:
        if name not in self.packs:
            self.packs[name] = Pack(str(self.folder / "pack" / name))
        return self.packs[name]

    def loose(self, name: str) -> bytes | None:
        """The text of a loose commit; None of anything else."""
        with open(self.folder / name[:2] / name[2:], "rb") as file:
            machine = zlib.decompressobj()
            begin = machine.decompress(file.read(1 << 12))
            if not begin.startswith(b"commit "):
                return None
            return (begin + machine.decompress(file.read()) + machine.flush()).split(b"\x00", 1)[1]

    def packed(self, pack: Pack, at: int) -> bytes | None:
        """The text of a packed commit; None of anything else."""
        deltas = []
        while True:
            kind, content, base = pack.head(at)
            if base is None:
                break
            deltas.append(content)
            at = base if isinstance(base, int) else pack.find(base)
            if at is None:
                raise ValueError("a delta whose base is in no index of its pack")
        if kind != COMMIT:
            return None
        text = pack.inflated(content)
        for content in reversed(deltas):
            text = patched(text, pack.inflated(content))
        return text


def signature(line: str) -> tuple[str, str, str | None]:
    """Name, address and local time of an author's or committer's line."""
    person, _, when = line.rpartition("> ")
    name, _, address = person.partition(" <")
    try:
        seconds, zone = when.split()
        offset = timedelta(hours=int(zone[:3]), minutes=int(zone[0] + zone[3:5]))
        return name, address, datetime.fromtimestamp(int(seconds), timezone(offset) if offset else UTC).isoformat()
    except (ValueError, OverflowError):
        return name, address, None


def commit_row(repo: str, sha: str, text: bytes) -> tuple:
    head, _, message = text.partition(b"\n\n")
    fields: dict[str, list[str]] = {}
    for line in head.decode("utf-8", "replace").split("\n"):
        key, _, value = line.partition(" ")
        if key:
            fields.setdefault(key, []).append(value)
    try:
        body = message.decode(fields.get("encoding", ["utf-8"])[0], "replace")
    except LookupError:
        body = message.decode("utf-8", "replace")
    name, address, written = signature(fields.get("author", [""])[0])
    return repo, sha, fields.get("parent", []), name, address, written, signature(fields.get("committer", [""])[0])[2], body


class CommitSource(DataSource):
    """All commits of the repositories at the paths of the option paths, one a line, on folders that all machines can open."""

    @classmethod
    def name(cls) -> str:
        return "repository_commits"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return CommitReader(self.options["paths"].split("\n"), int(self.options.get("entries", ENTRIES)))


class CommitReader(DataSourceReader):
    def __init__(self, paths: list[str], entries: int) -> None:
        self.paths, self.entries = paths, entries

    def partitions(self) -> list[InputPartition]:
        found = []
        for path in self.paths:
            objects = git_folder(path) / "objects"
            if not objects.is_dir():
                raise FileNotFoundError(f"no repository at {path}")
            found += [InputPartition((path, "loose", None, None))]
            for pack in sorted((objects / "pack").glob("*.pack")) if (objects / "pack").is_dir() else []:
                n = Pack(str(pack)).n
                found += [InputPartition((path, pack.name, k, min(k + self.entries, n))) for k in range(0, n, self.entries)]
        return found

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        path, where, begin, end = partition.value
        objects = Objects(git_folder(path))
        if where == "loose":
            for folder in sorted(objects.folder.iterdir()):
                if len(folder.name) == 2:
                    for name in sorted(os.listdir(folder)):
                        if len(name) == 38 and (text := objects.loose(folder.name + name)) is not None:
                            yield commit_row(path, folder.name + name, text)
            return
        pack = objects.pack(where)
        for i in range(begin, end):
            if (text := objects.packed(pack, pack.offset(i))) is not None:
                yield commit_row(path, pack.name(i).hex(), text)


def read_commits(spark: SparkSession, paths: Sequence[str], entries: int = ENTRIES) -> DataFrame:
    """The commits of repositories (repo, sha, parents, author_name, author_email, date, committed, message), each once. Times are
    those of the author's and the committer's own zone; a broken one is null."""
    spark.dataSource.register(CommitSource)
    rows = spark.read.format("repository_commits").options(paths="\n".join(paths), entries=str(entries)).load()
    return rows.dropDuplicates(["repo", "sha"])


def heads(spark: SparkSession, paths: Sequence[str], ref: str = "HEAD") -> DataFrame:
    """(repo, sha) of what a reference names in each repository; repositories without it are left out."""
    rows = []
    for path in paths:
        folder, value = git_folder(path), f"ref: {ref}"
        packed = folder / "packed-refs"
        known = dict(reversed(x.split(" ", 1)) for x in packed.read_text().splitlines() if x and x[0] not in "#^") if packed.exists() else {}
        while value and value.startswith("ref: "):
            name = value[5:].strip()
            value = (folder / name).read_text().strip() if (folder / name).is_file() else known.get(name, "")
        if value:
            rows.append((path, value))
    return spark.createDataFrame(rows, "repo string, sha string")


def log(spark: SparkSession, paths: Sequence[str], begin: Column | None = None, merges: bool = False, ref: str = "HEAD") -> DataFrame:
    """The commits that a reference of each repository can reach, without merges, whose author's day is ``begin`` or later."""
    commits = read_commits(spark, paths)
    reached = ancestors(commits, heads(spark, paths, ref)).select("repo", F.col("ancestor").alias("sha"))
    out = commits.join(reached, ["repo", "sha"], "left_semi")
    out = out if merges else out.filter(F.size("parents") < 2)
    return out if begin is None else out.filter(F.to_date(F.substring("date", 1, 10)) >= begin)
