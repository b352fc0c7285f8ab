"""Working folder that driver and executors share, and lineage cuts that survive a lost executor."""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows up to which the engine may choose to broadcast a table of a loop; larger ones are sorted and merged, however small their files are.
FEW = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; set to a temporary folder only where it is unset (local tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if context._jsc.sc().getCheckpointDir().isDefined():
            return context._jsc.sc().getCheckpointDir().get()
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(found)
        return context._jsc.sc().getCheckpointDir().get()
    return found


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it again, so that later jobs neither recompute it nor keep its shuffles."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, None)
    spark.conf.set(cleanup, "true")  # what is written needs its shuffle files no more
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(cleanup) if before is None else spark.conf.set(cleanup, before)
    return spark.read.schema(df.schema).parquet(path)


def cut_counting(df: DataFrame, name: str, **counters: Column) -> tuple[DataFrame, dict[str, int]]:
    """:func:`cut`, and counters (aggregates that are 0 for no rows) of the rows, added up while they are written.

    They stand at the top of the plan that writes, whose tasks count once each, however often one is tried.
    """
    seen = Observation()
    kept = cut(df.observe(seen, *[c.alias(n) for n, c in counters.items()]), name)
    told = seen.get
    return kept, {n: told.get(n) or 0 for n in counters}


def cut_sized(df: DataFrame, name: str = "cut") -> tuple[DataFrame, int]:
    """:func:`cut`, and how many rows there are; beyond :data:`FEW` the table asks for merge joins, see :func:`merged`."""
    kept, seen = cut_counting(df, name, n=F.count("*"))
    return (merged(kept) if seen["n"] > FEW else kept), seen["n"]


def merged(df: DataFrame) -> DataFrame:
    """``df`` for a join that grows with the tables: both sides are sorted and merged.

    Engines judge a table by the bytes of its compressed files or shuffles; a broadcast is unpacked and hashed in the
    driver first, which takes many times that.
    """
    return df.hint("merge")


def folders(df: DataFrame) -> list[str]:
    """Where a table made by :func:`cut` lies."""
    return sorted({unquote(f).rsplit("/", 1)[0] for f in df.inputFiles()})


def together(*written: DataFrame) -> DataFrame:
    """Tables made by :func:`cut` with the same columns, one below the other: one scan, where a union has one for each table.

    The driver plans, generates code for and sends the file system's settings along with each scan, so that the rounds of a loop
    cost it more the more tables they read.
    """
    kinds = {tuple(df.dtypes) for df in written}
    if len(kinds) > 1:
        raise ValueError(f"tables of different columns: {kinds}")
    return written[0].sparkSession.read.schema(written[0].schema).parquet(*[f for df in written for f in folders(df)])


def free(spark: SparkSession, *written: DataFrame) -> None:
    """Delete tables made by :func:`cut` that nothing reads any more."""
    for df in written:
        for folder in folders(df):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
