"""Counts, rankings and reports over classified nodes and trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mergetide.functions.text import extension
from mergetide.operators.matching import ordinals

TYPES = ["CLEAN", "LEFT_ONLY", "RIGHT_ONLY", "SAME_CHANGE", "CONFLICT"]
CLEAN_TYPES = ["CLEAN", "SAME_CHANGE"]


def stat_counters() -> dict[str, Column]:
    """The counters of :func:`stats` by name, for a write that counts in passing."""
    types = {f"n_{t.lower()}": F.count_if(F.col("div_type") == t) for t in TYPES}
    return {"n_total": F.count("*")} | types | {"n_unmatched_left": F.count_if(F.col("right_path").isNull()), "n_unmatched_right": F.count_if(F.col("left_path").isNull())}


def stats(nodes: DataFrame) -> DataFrame:
    """One row of counters over ``nodes(left_path, right_path, div_type)``."""
    return nodes.agg(*[c.alias(n) for n, c in stat_counters().items()])


def quick_stats(nodes: DataFrame) -> DataFrame:
    """Types of matched pairs only, and files of one side."""
    pair = F.col("left_path").isNotNull() & F.col("right_path").isNotNull()
    types = [F.count_if(pair & (F.col("div_type") == t)).alias(f"n_{t.lower()}") for t in TYPES]
    return nodes.agg(*types, F.count_if(F.col("right_path").isNull()).alias("n_left_files_only"), F.count_if(F.col("left_path").isNull()).alias("n_right_files_only"))


def trivial_merges(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("div_type").isin("LEFT_ONLY", "RIGHT_ONLY"))


def conflicts(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("div_type") == "CONFLICT")


def effort() -> Column:
    return F.col("left_add") + F.col("left_del") + F.col("right_add") + F.col("right_del")


def extension_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    """``ext, n_left, n_right``."""
    sides = left.select(extension(F.col("path")).alias("ext"), F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(extension(F.col("path")).alias("ext"), F.lit(0).alias("l"), F.lit(1).alias("r")))
    return sides.groupBy("ext").agg(F.sum("l").alias("n_left"), F.sum("r").alias("n_right"))


def tree_sizes(trees: DataFrame, nodes: DataFrame) -> DataFrame:
    """``root, size`` and members by type, of ``trees(root, id)``."""
    typed = trees.join(nodes.select("id", "div_type"), "id")
    return typed.groupBy("root").agg(F.count("*").alias("size"), *[F.count_if(F.col("div_type") == t).alias(f"n_{t.lower()}") for t in CLEAN_TYPES])


def tree_summary(sizes: DataFrame) -> DataFrame:
    """One row; ``n_files`` sums over trees that may overlap."""
    return sizes.agg(F.count("*").alias("n_trees"), F.count_if(F.col("size") == 1).alias("n_single"), F.count_if(F.col("size") > 1).alias("n_multi"), F.sum("size").alias("n_files"))


def top_trees(sizes: DataFrame, trees: DataFrame, most: int = 20) -> DataFrame:
    """The largest trees of several files: all members up to five, else three and how many more."""
    top = sizes.where("size > 1").orderBy(F.desc("size"), "root").limit(most)
    place = F.row_number().over(Window.partitionBy("root").orderBy("id"))
    first = trees.join(F.broadcast(top.select("root", "size")), "root").withColumn("place", place).where("place <= 5")  # of `most` trees
    names = first.groupBy("root", "size").agg(F.array_sort(F.collect_list("id")).alias("m"))
    more = F.concat(F.array_join(F.slice("m", 1, 3), ", "), F.lit(" and "), (F.col("size") - 3).cast("string"), F.lit(" more"))
    return names.select("root", "size", F.when(F.col("size") <= 5, F.array_join("m", ", ")).otherwise(more).alias("members"))


def priorities(nodes: DataFrame) -> DataFrame:
    """``id, priority, reason`` of ``nodes(id, div_type, is_clean, n_dependencies, effort)``; others get no row."""
    clean = F.col("div_type").isin(*CLEAN_TYPES) & F.col("is_clean") & (F.col("n_dependencies") > 0)
    one_sided = F.col("div_type").isin("LEFT_ONLY", "RIGHT_ONLY")
    side = F.when(F.col("div_type") == "LEFT_ONLY", "left").otherwise("right")
    conflict = F.col("div_type") == "CONFLICT"
    reason = (
        F.when(clean, "Clean subtree root with dependencies").when(one_sided, F.concat(F.lit("Trivial merge: only "), side, F.lit(" changed")))
        .when(conflict, F.concat(F.lit("Conflict with "), F.col("effort").cast("string"), F.lit(" total changed lines")))
    )
    return nodes.select("id", F.when(clean, "high").when(one_sided, "medium").when(conflict, "low").alias("priority"), reason.alias("reason")).where("priority is not null")


def impact_band(unlocks: Column) -> Column:
    return F.when(unlocks > 10, "high").when(unlocks > 3, "medium").otherwise("low")


def unlocking(bottlenecks: DataFrame) -> DataFrame:
    """Bottlenecks that hold up at least one node, themselves counted."""
    return bottlenecks.where("unlock_count > 0")


def unresolved_samples(unresolved: DataFrame, nodes: int = 5, imports: int = 3) -> DataFrame:
    """The first nodes with unresolved imports, and the first of these, of ``unresolved(src, n_unresolved, samples)``."""
    return unresolved.orderBy("src").limit(nodes).select("src", "n_unresolved", F.slice("samples", 1, imports).alias("samples"))


def unresolved_summary(unresolved: DataFrame) -> DataFrame:
    return unresolved.agg(F.count("*").alias("n_nodes"), F.coalesce(F.sum("n_unresolved"), F.lit(0)).alias("n_imports"))


def seen_by(found: DataFrame, parsed: DataFrame) -> DataFrame:
    """``path, n_found, n_parsed``: how often each of two scans saw a path; each is read once."""
    both = found.select("path", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(parsed.select("path", F.lit(0).alias("a"), F.lit(1).alias("b")))
    return both.groupBy("path").agg(F.sum("a").alias("n_found"), F.sum("b").alias("n_parsed"))


def validation(found: DataFrame, parsed: DataFrame) -> DataFrame:
    """One row: file counts by an independent scan and by the parser, paths each lacks, coverage in percent."""
    sums = [F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("n_found", "n_parsed")]
    lacks = [F.count_if(F.col("n_parsed") == 0).alias("n_missing"), F.count_if(F.col("n_found") == 0).alias("n_extra")]
    out = seen_by(found, parsed).agg(*sums, *lacks)
    share = F.when(F.col("n_found") > 0, F.round(100 * F.col("n_parsed") / F.col("n_found"), 1))
    return out.select("*", (F.col("n_found") - F.col("n_parsed")).alias("difference"), share.alias("coverage"))


def validation_samples(found: DataFrame, parsed: DataFrame, most: int = 10) -> DataFrame:
    """``kind, path``: the first paths that only one of the two scans saw, ``most`` of each kind."""
    seen = seen_by(found, parsed)
    few = lambda lacks, kind: seen.where(F.col(lacks) == 0).orderBy("path").limit(most).select(F.lit(kind).alias("kind"), "path")
    return few("n_parsed", "missing").unionByName(few("n_found", "extra"))


def first_members(trees: DataFrame, most: int = 10) -> DataFrame:
    """``root, members``: the first members of each tree by id."""
    place = F.row_number().over(Window.partitionBy("root").orderBy("id"))
    return trees.withColumn("place", place).where(F.col("place") <= most).groupBy("root").agg(F.array_sort(F.collect_list("id")).alias("members"))


def file_pattern(path: Column) -> Column:
    """The first of ten patterns that a path falls under, else its extension."""
    out = F.when(path.contains(".spec."), "*.spec.*").when(path.contains(".test."), "*.test.*").when(path.contains("__tests__"), "__tests__/*").when(path.contains(".d.ts"), "*.d.ts")
    for end in (".scss", ".html", ".tsx"):
        out = out.when(F.endswith(path, F.lit(end)), f"*{end}")
    out = out.when(path.contains("/e2e/"), "e2e/*").when(path.contains("/test/") | path.contains("/tests/"), "test(s)/*")
    return out.otherwise(F.concat(F.lit("other "), extension(path)))


def next_report(names: DataFrame) -> DataFrame:
    """The number after the highest ``reportN.html``; 1 where there is none."""
    n = F.regexp_extract("name", r"^report(\d+)\.html$", 1)
    return names.agg((F.coalesce(F.max(F.when(n != "", n.cast("int"))), F.lit(0)) + 1).alias("next_number"))


def search(nodes: DataFrame, text: str = "", types: list[str] | None = None) -> DataFrame:
    """Nodes of some types whose path holds ``text``, in any case."""
    out = nodes if types is None else nodes.where(F.col("div_type").isin(*types))
    return out.where(F.lower("path").contains(text.lower())) if text else out


def page(nodes: DataFrame, number: int, size: int = 100) -> DataFrame:
    """A page (from 1) in order of path: paths are ranked in sorted ranges, and a late page keeps no more rows than an early one."""
    wanted = ordinals(nodes.select("path"), "path").where(F.col("ordinal").between((number - 1) * size, number * size - 1)).select("path").distinct()
    return nodes.join(F.broadcast(wanted), "path", "left_semi").orderBy("path")  # at most ``size`` paths


def page_count(nodes: DataFrame, size: int = 100) -> DataFrame:
    return nodes.agg(F.ceil(F.count("*") / size).alias("n_pages"))
