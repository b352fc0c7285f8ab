"""Writing a tree as files: a table of what may be written, and a data source that puts it under a new folder.

``tree`` has ``path, content``; the folder must be mounted on the driver and on all executors.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: What a row of a tree says of itself once it is checked or written.
OUTCOME = "path string, n_bytes long, error string"


def checked(tree: DataFrame) -> DataFrame:
    """``path, content, error``: why a row can't become a file, null where it can.

    No path, no content, a path that leaves the folder or names a folder, a path that is there twice (neither row is written,
    whatever they hold) and a file where another file's folder must be.  Contents stay where they are: paths alone are
    counted, and only those that are wrong come back.
    """
    paths = tree.select("path").where("path is not null")
    twice = paths.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").select("path", F.lit("path twice").alias("why"))
    steps = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))
    folders = paths.where(F.size(steps) > 1).select(F.explode(above).alias("path")).distinct()
    blocked = paths.distinct().join(folders, "path", "left_semi").select("path", F.lit("a folder for other files").alias("why"))
    wrong = twice.unionByName(blocked).groupBy("path").agg(F.max("why").alias("why"))
    shape = F.when(F.col("path").isNull() | (F.col("path") == ""), "no path").when(F.col("content").isNull(), "no content")
    shape = shape.when(F.col("path").rlike(r"(^|/)[.]{1,2}(/|$)|^/|/$|//|\x00"), "path outside the folder or of a folder")
    return tree.select("path", "content", shape.alias("shape")).join(wrong, "path", "left").select("path", "content", F.coalesce("shape", "why").alias("error"))


@dataclass
class Written(WriterCommitMessage):
    """What a task has put down."""

    files: int
    errors: int


class TreeWriter(DataSourceArrowWriter):
    """Files go to a folder beside the root, which takes the root's name when all tasks are done.

    A task writes each file under a name of its own and then gives it its place, so that a killed, repeated or second attempt
    leaves a whole file or none; files that the system refuses are rows of the task's list of outcomes.
    """

    def __init__(self, root: str, staging: str):
        self.root, self.staging = root, staging

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        parts = os.path.join(self.staging, "parts")
        files = errors = 0
        name = os.path.join(parts, uuid.uuid4().hex)  # one file at a time
        outcomes = os.path.join(self.staging, "outcomes", f"{TaskContext.get().partitionId()}.json")
        with open(name + ".json", "w", encoding="utf-8") as log:
            for batch in iterator:
                for path, content in zip(batch["path"], batch["content"]):
                    path, data = path.as_py(), content.as_py().encode()
                    row = {"path": path, "n_bytes": len(data), "error": None}
                    try:
                        target = os.path.join(self.staging, "tree", path)
                        os.makedirs(os.path.dirname(target), exist_ok=True)
                        with open(name, "wb") as f:
                            f.write(data)
                        os.replace(name, target)
                        files += 1
                    except (OSError, ValueError) as e:
                        if isinstance(e, OSError) and e.strerror == "No space left on device":
                            raise  # the task's fault, not the file's
                        row["error"] = getattr(e, "strerror", None) or str(e)
                        errors += 1
                    log.write(json.dumps(row) + "\n")
        os.replace(name + ".json", outcomes)  # of two attempts at a task the last one tells
        return Written(files, errors)

    def commit(self, messages: list[Written | None]) -> None:
        """The whole tree appears at once."""
        os.rename(os.path.join(self.staging, "tree"), self.root)
        shutil.rmtree(os.path.join(self.staging, "parts"))  # what lost attempts left

    def abort(self, messages: list[Written | None]) -> None:
        """Nothing appears."""
        shutil.rmtree(self.staging, ignore_errors=True)


class TreeFiles(DataSource):
    """The format ``tree-files``; options ``path``, the folder to make, and ``staging``, a folder beside it."""

    @classmethod
    def name(cls) -> str:
        return "tree-files"

    def writer(self, schema: StructType, overwrite: bool) -> TreeWriter:
        if [f.name for f in schema] != ["path", "content"]:
            raise ValueError("a tree has the columns path and content")
        root, staging = self.options["path"].rstrip("/"), self.options["staging"]
        if overwrite or os.path.exists(root) or os.path.exists(f"{root}.outcomes"):
            raise FileExistsError(f"{root} is there already; trees are never overwritten")
        for folder in ("tree", "parts", "outcomes"):
            os.makedirs(os.path.join(staging, folder), exist_ok=True)
        return TreeWriter(root, staging)


def write_tree(tree: DataFrame, root: str, dry_run: bool = False) -> DataFrame:
    """Write the tree's files below the new folder ``root``; ``path, n_bytes, error`` for every row, null where it is a file now.

    One row's error does not hinder the others.  dry_run: writes nothing, and tells what is known beforehand.  Where the job
    fails there is no ``root`` and nothing beside it.  The lists of outcomes stay in ``<root>.outcomes``.
    """
    spark = tree.sparkSession
    rows = checked(tree)
    size = F.octet_length("content").cast("long").alias("n_bytes")
    if dry_run:
        return rows.select("path", size, "error")
    root = os.path.abspath(root.removeprefix("file://"))
    staging = f"{root}.{uuid.uuid4().hex}"
    spark.dataSource.register(TreeFiles)
    rows.where("error is null").select("path", "content").write.format("tree-files").mode("append").option("staging", staging).save(root)
    os.rename(os.path.join(staging, "outcomes"), f"{root}.outcomes")
    os.rmdir(staging)
    done = spark.read.schema(OUTCOME).json(f"file://{root}.outcomes")
    return done.unionByName(rows.where("error is not null").select("path", size, "error"))
