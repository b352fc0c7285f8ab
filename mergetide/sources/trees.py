"""Snapshots of file trees and their companions: scans, mapping files, path aliases, commits."""

from __future__ import annotations

import json
import os
import re
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergetide.operators.matching import ordinals
from mergetide.operators.resolving import Aliases
from mergetide.sources.shared import cut

CODE_ENDS = [".ts"]
FOUND_ENDS = [".ts", ".tsx", ".scss", ".html"]
PRUNED = r"(^|/)(node_modules|dist|\.[^/]*)/"
FOUND_PRUNED = r"(^|/)(node_modules|\.git|dist)/"


def listed(spark: SparkSession, root: str, ends: list[str], pruned: str) -> DataFrame | None:
    """``path, content`` (bytes) of the files below ``root``, paths relative to it; None where there is no such folder."""
    uri = root if "://" in root else "file://" + os.path.abspath(root)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(uri)
    system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(hadoop):
        return None
    top = system.resolvePath(hadoop).toUri().getPath().rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*{" + ",".join(ends) + "}").load(uri)
    path = F.regexp_replace(F.expr("parse_url(path, 'PATH')"), "^" + re.escape(top), "")
    return files.select(path.alias("path"), "content").where(~F.col("path").rlike(pruned))


def scan_tree(spark: SparkSession, root: str, branch: str, ends: list[str] | None = None) -> DataFrame:
    """``branch, ordinal, path, content`` of the files below ``root``; a missing folder is an empty tree.

    Paths are relative, ordinals rank them; folders named node_modules or dist, and those that begin with a dot, are
    left out.  Paths alone are ranked; contents are read once, by whoever reads the table, and stay where they are as long as
    the ranks are small enough to be broadcast by the engine's own rule, else they pass one exchange.
    """
    files = listed(spark, root, ends or CODE_ENDS, PRUNED)
    if files is None:
        return spark.createDataFrame([], "branch string, ordinal long, path string, content string")
    ranks = cut(ordinals(files.select("path")).select("path", "ordinal"), "ranks")
    return files.join(ranks, "path").select(F.lit(branch).alias("branch"), "ordinal", "path", F.decode("content", "UTF-8").alias("content"))


def found_files(spark: SparkSession, root: str, ends: list[str] | None = None) -> DataFrame:
    """``path``: the independent scan of a validation, by other rules of pruning; contents are not read."""
    files = listed(spark, root, ends or FOUND_ENDS, FOUND_PRUNED)
    return spark.createDataFrame([], "path string") if files is None else files.select("path")


def commits_from_log(spark: SparkSession, path: str) -> DataFrame:
    """``path, seq, hash, date, author``, a row for each file of each commit, from text files of a log.

    The log is that of ``git log --name-only --format=%x02%H%x01%aI%x01%an%x01``, newest first; later commits have higher
    ``seq``: within a file by their place in it, however Spark cuts the files; of several files, parts of one log, those with
    the newest commit come last.  A commit without files gives no rows.
    """
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")]
    log = spark.read.option("lineSep", "\x02").text(path).select("value", *place)
    part = F.split("value", "\x01")
    rows = log.where(F.size(part) >= 4).select("file", "block", "row", part[0].alias("hash"), part[1].alias("date"), part[2].alias("author"), F.explode(F.split(part[3], "\n")).alias("path"))
    rows = rows.where("path <> ''")
    newest = rows.groupBy("file").agg(F.max(F.expr("try_cast(date AS timestamp)")).alias("newest"))  # one row a file of the log
    seq = F.struct("newest", "file", (-F.col("block")).alias("block"), (-F.col("row")).alias("row"))
    return rows.join(newest, "file").select("path", seq.alias("seq"), "hash", "date", "author")


def mapping_overrides(spark: SparkSession, path: str) -> DataFrame:
    """``left_path, right_path`` of the manual overrides in a mapping file or a folder of them; none where it is missing or not JSON."""
    try:
        rows = spark.read.schema("manualOverrides map<string,string>").option("multiLine", os.path.splitext(path)[1] != "").json(path)
        rows.take(1)
    except Exception as error:  # a path that does not exist
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], "left_path string, right_path string")
    return rows.select(F.explode("manualOverrides").alias("left_path", "right_path"))


def write_mapping(matches: DataFrame, overrides: DataFrame | None, path: str) -> None:
    """``path/mappings``: JSON lines, an object for each pair or lonely file; ``path/overrides``: an object for each override."""
    matches.write.mode("overwrite").json(f"{path}/mappings")
    if overrides is not None:
        one = F.create_map("left_path", "right_path").alias("manualOverrides")
        overrides.select(one).write.mode("overwrite").json(f"{path}/overrides")  # reads back with mapping_overrides


def relaxed_json(text: str) -> dict:
    """Strict JSON, else without whole-line comments and trailing commas."""
    try:
        return json.loads(text)
    except ValueError:
        return json.loads(re.sub(r",(\s*[}\]])", r"\1", re.sub(r"(?m)^\s*//.*$", "", text)))


def path_aliases(text: str, folder: str) -> Aliases:
    """Aliases of a tsconfig's text that lies in ``folder``; the base folder defaults to it."""
    options = relaxed_json(text).get("compilerOptions", {})
    base = os.path.normpath(os.path.join(folder, options.get("baseUrl", ".")))
    entries = [(a, [os.path.normpath(os.path.join(base, p)) for p in ps]) for a, ps in options.get("paths", {}).items()]
    return Aliases(entries, base)


def other_branch(aliases: Aliases, left: str, right: str) -> Aliases:
    """The same aliases for the other branch: its name in place of this one's."""
    swap = lambda p: p.replace(left, right)
    return Aliases([(a, [swap(p) for p in ps]) for a, ps in aliases.entries], None if aliases.base_url is None else swap(aliases.base_url))


def branch_aliases(text: str, folder: str, left: str, right: str) -> tuple[Aliases, Aliases]:
    """Aliases for both branches of a tsconfig; where its folder lies in neither, its base folder is taken below each."""
    own = path_aliases(text, folder)
    if any(f"/{b.strip('/')}/" in f"{own.base_url}/" or f"{own.base_url}/".startswith(f"{b.strip('/')}/") for b in (left, right)):
        return own, other_branch(own, left, right)
    below = lambda b, p: os.path.normpath(os.path.join(b, os.path.relpath(p, folder)))
    both = [Aliases([(a, [below(b, p) for p in ps]) for a, ps in own.entries], below(b, own.base_url or folder)) for b in (left, right)]
    return both[0], both[1]


def git_root(start: str) -> str:
    at = os.path.abspath(start)
    while not os.path.exists(os.path.join(at, ".git")):
        if at == os.path.dirname(at):
            raise FileNotFoundError(f"no repository above {start}")
        at = os.path.dirname(at)
    return at


def base_files(paths: DataFrame, repository: str, commit: str, most: int = 10 << 20) -> DataFrame:
    """``path, content`` at a commit, of paths that it holds; one git process a partition, larger blobs are left out.

    The repository must be readable on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with subprocess.Popen(["git", "-C", repository, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as git:
            for b in batches:
                found, texts = [], []
                for path in b["path"].to_pylist():
                    git.stdin.write(f"{commit}:{path}\n".encode())
                    git.stdin.flush()
                    head = git.stdout.readline().split()
                    if head[-1] == b"missing" or len(head) != 3:
                        continue
                    content = git.stdout.read(int(head[2]))
                    git.stdout.read(1)
                    if head[1] == b"blob" and len(content) <= most:
                        found.append(path)
                        texts.append(content.decode(errors="replace"))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(texts, pa.string())], ["path", "content"])
            git.stdin.close()

    return paths.select("path").mapInArrow(run, "path string, content string")
