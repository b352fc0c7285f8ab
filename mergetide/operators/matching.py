"""Pairing the files of two snapshots: four passes, each one to one, in order of trust.

``files`` tables have ``path, ordinal, class_name, selector``; ordinals decide ties and are unique on each side.
A pass looks its key up over all right files - the last one that holds it - and uses the file only if no earlier pass
took it; of several left files that find one right file the first gets it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mergetide.sources.shared import cut, cut_counting, merged


def by_path(left: DataFrame, right: DataFrame) -> DataFrame:
    """Files at one path on both sides."""
    return left.select("path").join(merged(right.select("path")), "path").select(F.col("path").alias("left_path"), F.col("path").alias("right_path"), F.lit("path").alias("match_method"))


def by_key(left: DataFrame, right: DataFrame, right_left_over: DataFrame, key: str, method: str) -> DataFrame:
    last = right.where(F.col(key) != "").groupBy(key).agg(F.max_by("path", "ordinal").alias("right_path"))
    free = last.join(merged(right_left_over.select(F.col("path").alias("right_path"))), "right_path", "left_semi")
    found = left.where(F.col(key) != "").join(merged(free), key)
    first = found.groupBy("right_path").agg(F.min_by("path", "ordinal").alias("left_path"))
    return first.select("left_path", "right_path", F.lit(method).alias("match_method"))


def by_override(left: DataFrame, right: DataFrame, overrides: DataFrame) -> DataFrame:
    """``overrides(left_path, right_path)``: an unknown left file is ignored, an unknown right one leaves the left file alone."""
    known = overrides.join(merged(left.select(F.col("path").alias("left_path"))), "left_path", "left_semi")
    there = right.select(F.col("path").alias("right_path"), F.lit(True).alias("there"))
    joined = known.join(merged(there), "right_path", "left")
    return joined.select("left_path", F.when(F.col("there"), F.col("right_path")).alias("right_path"), F.lit("manual").alias("match_method"))


def match_files(left: DataFrame, right: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """``left_path, right_path, match_method`` of every file of both sides; ``unmatched`` ones have one path.

    Each pass writes its pairs: all later ones read them, and a plan that holds each pass in all later ones has hundreds of joins.
    """
    found = [cut(by_override(left, right, overrides), "pairs")] if overrides is not None else []

    def unused(files: DataFrame, column: str, of: list[DataFrame]) -> DataFrame:
        if not of:
            return files
        used = reduce(DataFrame.unionByName, [m.where(F.col(column).isNotNull()).select(F.col(column).alias("path")) for m in of])
        return files.join(merged(used), "path", "left_anti")

    passes = [lambda a, b: by_path(a, b), lambda a, b: by_key(a, right, b, "class_name", "classname"), lambda a, b: by_key(a, right, b, "selector", "selector")]
    for one in passes:
        found.append(cut(one(unused(left, "left_path", found), unused(right, "right_path", found)), "pairs"))
    lonely = unused(left, "left_path", found).select(F.col("path").alias("left_path"), F.lit(None).cast("string").alias("right_path"), F.lit("unmatched").alias("match_method"))
    others = unused(right, "right_path", found).select(F.lit(None).cast("string").alias("left_path"), F.col("path").alias("right_path"), F.lit("unmatched").alias("match_method"))
    out = lonely.unionByName(others)
    for m in found:
        out = out.unionByName(m)
    return out


def left_only(matches: DataFrame) -> DataFrame:
    return matches.where("right_path is null").select("left_path")


def right_only(matches: DataFrame) -> DataFrame:
    return matches.where("left_path is null").select("right_path")


def method_counts(matches: DataFrame) -> DataFrame:
    """Pairs by method."""
    return matches.where("left_path is not null and right_path is not null").groupBy("match_method").agg(F.count("*").alias("n"))


def match_counters() -> dict[str, Column]:
    """What :func:`reconciliation` needs of the matches."""
    pair = F.col("left_path").isNotNull() & F.col("right_path").isNotNull()
    return {"pairs": F.count_if(pair), "left_only": F.count_if(F.col("right_path").isNull()), "right_only": F.count_if(F.col("left_path").isNull())}


def match_counting(left: DataFrame, right: DataFrame, overrides: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The matches of :func:`match_files`, and their reconciliation, which is counted in passing while files and matches are written."""
    left, a = cut_counting(left, "left", left_files=F.count("*"))
    right, b = cut_counting(right, "right", right_files=F.count("*"))
    matches, c = cut_counting(match_files(left, right, overrides), "matches", **match_counters())
    return matches, reconciliation(matches, a | b | c)


def reconciliation(like: DataFrame, seen: dict[str, int]) -> DataFrame:
    """One row: files of each side, and files accounted for by pairs and lonely ones, as they were ``seen`` by name."""
    names = ["pairs", "left_only", "right_only", "left_files", "right_files"]
    got = like.sparkSession.range(1).select(*[F.lit(seen[n]).cast("long").alias(n) for n in names])
    return got.withColumn("left_ok", F.col("pairs") + F.col("left_only") == F.col("left_files")).withColumn("right_ok", F.col("pairs") + F.col("right_only") == F.col("right_files"))


def suspicious(matches: DataFrame) -> DataFrame:
    """Pairs found otherwise than by path whose first folders differ, the left file at least two folders deep."""
    a, b = F.split("left_path", "/"), F.split("right_path", "/")
    return matches.where((F.col("match_method") != "path") & F.col("left_path").isNotNull() & F.col("right_path").isNotNull() & (a[0] != b[0]) & (F.size(a) > 2))


def ordinals(files: DataFrame, *by: str) -> DataFrame:
    """``files`` with an ordinal by rank of the path, or of the columns ``by``; equal rows get different ones.

    Ranges of paths are sorted apart, so that no task sorts all files, and written once with their place: all that follows
    reads the same ranges, whatever the engine merges or splits.
    """
    by = by or ("path",)
    placed = cut(files.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    placed = placed.withColumn("_p", F.shiftright("_at", 33))  # number of the range; the lower 33 bits count its rows
    before = Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))  # one row a range
    joined = placed.join(F.broadcast(sizes), "_p")  # as many rows as shuffle partitions
    return joined.withColumn("ordinal", (F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).cast("long")).drop("_p", "_at", "_n", "_before")
