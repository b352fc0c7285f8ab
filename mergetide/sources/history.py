"""History of a git repository as two data sources: the log with its commits numbered, and the tree at a commit.

The repository must be readable on the driver and on all executors.  A commit's name is resolved once, when a read is
planned, so that all tasks read one history, also while branches move on.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

LOG = "path string, seq long, hash string, date string, author string"
TREE = "path string, content string"
COMMITS, FOLDERS, BATCH_ROWS, BATCH_BYTES, ASKED = 5_000, 64, 10_000, 4 << 20, 100


def git(repository: str, *words: str) -> bytes:
    """What one call prints; its complaint is the error's text."""
    done = subprocess.run(["git", "-C", repository, *words], capture_output=True)
    if done.returncode:
        raise ValueError(f"git {words[0]}: {done.stderr.decode(errors='replace').strip()}")
    return done.stdout


def resolved(repository: str, commit: str) -> str:
    return git(repository, "rev-parse", "--verify", "--end-of-options", commit + "^{commit}").decode().strip()


@dataclass
class Stretch(InputPartition):
    """``count`` commits of the log of ``commit`` after the newest ``skip``, of ``total``."""

    commit: str
    skip: int
    count: int
    total: int


class LogReader(DataSourceReader):
    """The log in stretches; the walk over the commits before a stretch looks at no file."""

    def __init__(self, repository: str, commit: str, each: int):
        self.repository, self.commit, self.each = repository, commit, each

    def partitions(self) -> list[Stretch]:
        commit = resolved(self.repository, self.commit)
        total = int(git(self.repository, "rev-list", "--count", commit))
        return [Stretch(commit, skip, min(self.each, total - skip), total) for skip in range(0, total, self.each)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        say = ["--format=%x02%H%x01%aI%x01%an%x01", "--name-only", "-z", "-c", "--no-renames", "--root"]  # -c: files that a merge itself changed
        words = ["git", "-C", self.repository, "log", f"--skip={partition.skip}", f"--max-count={partition.count}", *say, partition.commit]
        rows: list[tuple[str, int, str, str, str]] = []
        with subprocess.Popen(words, stdout=subprocess.PIPE) as log:
            for n, record in enumerate(records(log.stdout)):
                commit, date, author, names = record.split("\x01", 3)
                seq = partition.total - 1 - partition.skip - n
                rows += [(name, seq, commit, date, author) for name in names.strip("\n").split("\0") if name.strip("\n")]
                if len(rows) >= BATCH_ROWS:
                    yield batch_of(rows)
                    rows = []
        if log.returncode:
            raise ValueError(f"git log failed in {self.repository}")
        yield batch_of(rows)


def records(stream: Iterator[bytes]) -> Iterator[str]:
    """The parts of a stream that begin with the byte 2, one in memory at a time."""
    left = b""
    while block := stream.read(1 << 20):
        *whole, left = (left + block).split(b"\x02")
        yield from (r.decode(errors="replace") for r in whole if r.strip(b"\0\n"))
    if left.strip(b"\0\n"):
        yield left.decode(errors="replace")


def batch_of(rows: list[tuple[str, int, str, str, str]]) -> pa.RecordBatch:
    path, seq, commit, date, author = zip(*rows, strict=True) if rows else ((),) * 5
    text = lambda x: pa.array(x, pa.string())
    columns = [text([p.removeprefix("\n") for p in path]), pa.array(seq, pa.int64()), text(commit), text(date), text(author)]
    return pa.RecordBatch.from_arrays(columns, ["path", "seq", "hash", "date", "author"])


class GitLog(DataSource):
    """The format ``git-log``; options ``path``, the repository, ``commit`` (HEAD) and ``commitsPerPartition``."""

    @classmethod
    def name(cls) -> str:
        return "git-log"

    def schema(self) -> str:
        return LOG

    def reader(self, schema: StructType) -> LogReader:
        return LogReader(self.options["path"], self.options.get("commit", "HEAD"), int(self.options.get("commitsPerPartition", COMMITS)))


@dataclass
class Folder(InputPartition):
    """A folder of a tree (the root: empty), with all below it or only the files in it."""

    commit: str
    prefix: str
    deep: bool


class TreeReader(DataSourceReader):
    """A tree by folders: those nearest the root are opened until there are enough parts."""

    def __init__(self, repository: str, commit: str, ends: list[str], most: int, folders: int):
        self.repository, self.commit, self.ends, self.most, self.folders = repository, commit, ends, most, folders

    def entries(self, at: Folder) -> Iterator[tuple[str, str, str, str]]:
        """(kind, hash, size, path) of what lies in a folder."""
        words = ["ls-tree", "-z", "-l", "--full-tree", *(["-r"] if at.deep else []), at.commit, *(["--", at.prefix] if at.prefix else [])]
        for line in git(self.repository, *words).split(b"\0"):
            if line:
                head, path = line.split(b"\t", 1)
                _, kind, blob, size = head.decode().split()
                yield kind, blob, size, path.decode(errors="surrogateescape")

    def partitions(self) -> list[Folder]:
        commit = resolved(self.repository, self.commit)
        done: list[Folder] = []
        waiting = [Folder(commit, "", True)]
        while waiting and len(done) + len(waiting) < self.folders:
            at = waiting.pop(0)
            done.append(Folder(commit, at.prefix, False))
            waiting += [Folder(commit, path + "/", True) for kind, _, _, path in self.entries(done[-1]) if kind == "tree"]
        return done + waiting

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        wanted = [(blob, path) for kind, blob, size, path in self.entries(partition) if kind == "blob" and int(size) <= self.most and path.endswith(tuple(self.ends))]
        with subprocess.Popen(["git", "-C", self.repository, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as blobs:
            paths, texts, size = [], [], 0
            for some in (wanted[i : i + ASKED] for i in range(0, len(wanted), ASKED)):  # so few names fit into a pipe
                blobs.stdin.write("".join(f"{blob}\n" for blob, _ in some).encode())
                blobs.stdin.flush()
                for _, path in some:
                    n = int(blobs.stdout.readline().split()[2])
                    texts.append(blobs.stdout.read(n).decode(errors="replace"))
                    blobs.stdout.read(1)
                    paths.append(path.encode(errors="surrogateescape").decode(errors="replace"))
                    size += n
                    if size >= BATCH_BYTES:
                        yield files_of(paths, texts)
                        paths, texts, size = [], [], 0
            yield files_of(paths, texts)
            blobs.stdin.close()


def files_of(paths: list[str], texts: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.string())], ["path", "content"])


class GitTree(DataSource):
    """The format ``git-tree``; options ``path``, the repository, ``commit`` (HEAD), ``ends`` (endings with commas between), ``maxBytes``, ``folders``."""

    @classmethod
    def name(cls) -> str:
        return "git-tree"

    def schema(self) -> str:
        return TREE

    def reader(self, schema: StructType) -> TreeReader:
        o = self.options
        ends = [e for e in o.get("ends", "").split(",") if e]
        return TreeReader(o["path"], o.get("commit", "HEAD"), ends or [""], int(o.get("maxBytes", 10 << 20)), int(o.get("folders", FOLDERS)))


def commits_at(spark: SparkSession, repository: str, commit: str = "HEAD", each: int = COMMITS) -> DataFrame:
    """``path, seq, hash, date, author``: a row for each file of each commit that ``commit`` holds, later ones with higher ``seq``.

    ``seq`` counts the commits of the log itself from the oldest (0), whatever Spark reads first.  A merge counts only for files
    that differ from all its parents; renamed files are new ones; nothing is left out, changes on branches whose merge took
    the other side included.
    """
    spark.dataSource.register(GitLog)
    return spark.read.format("git-log").option("commit", commit).option("commitsPerPartition", each).load(repository)


def tree_at(spark: SparkSession, repository: str, commit: str = "HEAD", ends: list[str] | None = None, most: int = 10 << 20, folders: int = FOLDERS) -> DataFrame:
    """``path, content`` of the files at a commit, in parts by folder; blobs over ``most`` bytes, links to other repositories and
    files of other endings are left out, and bytes that are no UTF-8 become the replacement character."""
    spark.dataSource.register(GitTree)
    options = {"commit": commit, "ends": ",".join(ends or []), "maxBytes": most, "folders": folders}
    return spark.read.format("git-tree").options(**options).load(repository)
