"""Plans that move files into a shared tree: what moves, which imports change, which barrels, what can go.

A plan is tables; applying it makes the rewritten tree as a table, and writes no input file.
``nodes`` have ``id, left_path, right_path``; ``files`` have ``path, content`` of both branches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergetide.functions import references as R
from mergetide.functions.text import beside, import_between
from mergetide.operators.resolving import Aliases, resolve
from mergetide.sources.shared import cut, free, merged

STYLE_ENDS = [".html", ".scss", ".css", ".less"]
IMPORT_LINE = r"^(?:import|export).*?from\s+['\"]([^'\"\n]+)['\"]"


def selection(text: str, all_clean: DataFrame) -> DataFrame:
    """``id`` of a comma list, or all members of movable trees for ``all-clean``."""
    if text.strip() == "all-clean":
        return all_clean.select("id").distinct()
    names = all_clean.sparkSession.range(1).select(F.explode(F.transform(F.split(F.lit(text), ","), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))).alias("id"))
    return names.where("id <> ''").distinct()


def file_moves(order: DataFrame, nodes: DataFrame, shared: str) -> DataFrame:
    """``id, position, source, target`` in order; the left file moves where there is one."""
    at = order.join(merged(nodes), "id").withColumn("source", F.coalesce("left_path", "right_path")).where("source is not null")
    return at.select("id", "position", "source", F.concat(F.lit(shared.rstrip("/") + "/"), F.col("id")).alias("target"))


def plan_warnings(ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id, warning`` of chosen ids that cannot move."""
    unknown = ids.join(nodes, "id", "left_anti").select("id", F.lit("unknown node").alias("warning"))
    nowhere = ids.join(nodes.where("left_path is null and right_path is null"), "id", "left_semi").select("id", F.lit("no path").alias("warning"))
    return unknown.unionByName(nowhere)


def in_branch(path: Column, branches: tuple[str, str], to: int) -> Column:
    """The same path in the left (0) or right (1) branch; paths of neither stay."""
    own, other = branches[to].rstrip("/") + "/", branches[1 - to].rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(other)), F.concat(F.lit(own), F.substring(path, F.lit(len(other) + 1), F.length(path)))).otherwise(path)


def named_files(moves: DataFrame, files: DataFrame, branches: tuple[str, str] | None) -> DataFrame:
    """``id, url, source, target``: what moved files name as template or style; ``source`` is null where there is none.

    A file is looked for beside the one that names it, then at that place in the left branch, then in the right one.
    """
    urls = F.filter(F.concat(F.array(R.template_url(F.col("content"))), R.style_urls(F.col("content"))), lambda x: x.isNotNull())
    naming = files.select(F.col("path").alias("source"), urls.alias("urls")).where(F.size("urls") > 0)  # contents stay where they are read
    named = moves.join(merged(naming), "source").select("id", F.col("source").alias("_source"), F.col("target").alias("_target"), F.explode("urls").alias("url"))
    at = beside(F.col("_source"), F.col("url"))
    tried = [at] if branches is None else [at, in_branch(at, branches, 0), in_branch(at, branches, 1)]
    named = named.withColumn("_tried", F.array_distinct(F.array(*tried))).withColumn("target", beside(F.col("_target"), F.col("url")))
    there = named.select("id", "url", F.posexplode("_tried").alias("rank", "source")).join(merged(files.select(F.col("path").alias("source"))), "source", "left_semi")
    best = there.groupBy("id", "url").agg(F.min_by("source", "rank").alias("source"))
    return named.select("id", "url", "target").join(merged(best), ["id", "url"], "left").select("id", "url", "source", "target")


def associated_files(moves: DataFrame, files: DataFrame, branches: tuple[str, str] | None = None) -> DataFrame:
    """``id, source, target`` of templates and styles that go along: named ones, then those of the same base name."""
    named = named_files(moves, files, branches).where("source is not null").select("id", "source", "target")
    stem = lambda c: F.regexp_replace(c, r"\.tsx?$", "")
    alike = F.explode(F.array(*[F.struct(F.concat(stem("source"), F.lit(e)).alias("source"), F.concat(stem("target"), F.lit(e)).alias("target")) for e in STYLE_ENDS])).alias("x")
    alike = moves.select("id", alike).select("id", "x.source", "x.target").join(merged(files.select(F.col("path").alias("source"))), "source", "left_semi")
    return named.unionByName(alike.select("id", "source", "target")).dropDuplicates(["id", "source"])


def association_warnings(moves: DataFrame, files: DataFrame, branches: tuple[str, str] | None = None) -> DataFrame:
    """``id, warning``: templates and styles that are named and lie nowhere."""
    return named_files(moves, files, branches).where("source is null").select("id", F.concat(F.lit("not found: "), "url").alias("warning"))


def path_mapping(moves: DataFrame, nodes: DataFrame) -> DataFrame:
    """``old_path, new_path`` for the copies of both branches."""
    both = moves.select("id", "target").join(merged(nodes), "id")
    return both.select(F.explode(F.array("left_path", "right_path")).alias("old_path"), F.col("target").alias("new_path")).where("old_path is not null").distinct()


def deleted_paths(moves: DataFrame, nodes: DataFrame, along: DataFrame, files: DataFrame, branches: tuple[str, str] | None = None) -> DataFrame:
    """``path``: what a plan deletes, once for each reason: copies of moved nodes, files that go along and their copies."""
    both = moves.join(merged(nodes.select("id", "left_path", "right_path")), "id").select(F.explode(F.array("left_path", "right_path")).alias("path")).where("path is not null")
    out = both.unionByName(along.select(F.col("source").alias("path")))
    if branches is not None:
        left = F.startswith("source", F.lit(branches[0].rstrip("/") + "/"))
        other = along.select("source", F.when(left, in_branch(F.col("source"), branches, 1)).otherwise(in_branch(F.col("source"), branches, 0)).alias("path")).where("path <> source")
        out = out.unionByName(other.join(merged(files.select("path")), "path", "left_semi").select("path"))
    return out


def affected_importers(moves: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``path`` of moved files at their source, and of both copies of nodes that depend on a moved one."""
    users = edges.join(merged(moves.select(F.col("id").alias("dst"))), "dst", "left_semi").select(F.col("src").alias("id")).distinct()
    paths = users.join(merged(nodes), "id").select(F.explode(F.array("left_path", "right_path")).alias("path")).where("path is not null")
    return paths.unionByName(moves.select(F.col("source").alias("path"))).distinct()


def import_rewrites(files: DataFrame, mapping: DataFrame, aliases: Aliases | None = None) -> DataFrame:
    """``path, new_path, position, line, old_import, new_import`` of every single-line import that must change.

    Imports of moved files lead to their new place, and imports of moved files back to files that stay; paths with
    ``.spec.`` or ``.test.`` in them are left as they are; specifiers that resolve to nothing stay.  Contents are parsed
    once, and only their imports travel.
    """
    code = files.where(F.col("path").rlike(r"\.tsx?$") & ~F.col("path").contains(".spec.") & ~F.col("path").contains(".test."))
    numbered = F.transform(F.split("content", "\n"), lambda x, i: F.struct((i + 1).alias("line"), F.regexp_extract(x, IMPORT_LINE, 1).alias("spec")))
    found = cut(code.select("path", F.posexplode(F.filter(numbered, lambda x: x["spec"] != "")).alias("position", "x")).select("path", "position", "x.line", "x.spec"), "imports")
    # written, so that the driver plans the resolving, the mapping and their joins one after the other, and the mapping once for both joins
    resolved = cut(resolve(found, files, aliases, planner=True).where("target is not null"), "resolved")
    free(files.sparkSession, found)
    mapping = cut(mapping, "mapping")
    own = mapping.select(F.col("old_path").alias("path"), F.col("new_path").alias("own_new"))
    to = mapping.select(F.col("old_path").alias("target"), F.col("new_path").alias("target_new"))
    both = resolved.join(merged(own), "path", "left").join(merged(to), "target", "left").where("own_new is not null or target_new is not null")
    new = import_between(F.coalesce("own_new", "path"), F.coalesce("target_new", "target"))
    both = both.withColumn("new_import", new).where(F.col("new_import") != F.col("spec"))
    return both.select("path", F.col("own_new").alias("new_path"), "position", "line", F.col("spec").alias("old_import"), "new_import")


def rewrites_by_file(rewrites: DataFrame) -> DataFrame:
    """``path, n_imports, changes``: the rewrites of each file in order."""
    changes = F.array_sort(F.collect_list(F.struct("position", "line", "old_import", "new_import")))  # a file's imports
    return rewrites.groupBy("path").agg(F.count("*").alias("n_imports"), changes.alias("changes"))


def barrel_updates(files: DataFrame, mapping: DataFrame) -> DataFrame:
    """``path, remove, old_path``: for each ``index.ts`` above a moved file that holds the file's path, one update at most.

    A barrel belongs to the first moved file (by path) below it, found in it or not.
    """
    code = mapping.where(F.col("old_path").rlike(r"\.tsx?$")).select("old_path")
    steps = F.split("old_path", "/")
    above = code.select("old_path", F.explode(F.sequence(F.lit(1), F.size(steps) - 1)).alias("n")).withColumn("dir", F.array_join(F.slice(F.split("old_path", "/"), F.lit(1), F.col("n")), "/"))
    tried = above.select("old_path", F.concat("dir", F.lit("/index.ts")).alias("path"), F.concat(F.lit("./"), F.regexp_replace(F.expr("substring(old_path, length(dir) + 2)"), r"\.tsx?$", "")).alias("remove"))
    first = tried.where("path <> old_path").groupBy("path").agg(F.min_by(F.struct("old_path", "remove"), "old_path").alias("x"))
    barrels = files.where(F.col("path").endswith("/index.ts")).select("path", "content")  # no other contents travel
    return first.join(merged(barrels), "path").where(F.contains("content", F.col("x.remove"))).select("path", "x.remove", "x.old_path")


def plan_counters(moves: DataFrame, along: DataFrame, importers: DataFrame, rewrites: DataFrame, barrels: DataFrame, gone: DataFrame) -> DataFrame:
    """One row of totals: files that move or go along, files looked through for imports (tests too), and deletions by reason."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    files = moves.select("source").unionByName(along.select("source"))
    parts = [one(importers, "n_files_to_update"), one(rewrites, "n_imports"), one(barrels, "n_barrels"), one(gone, "n_deletions")]
    out = one(files, "n_files")
    for p in parts:
        out = out.crossJoin(p)  # one row each
    return out


def rewritten(files: DataFrame, mapping: DataFrame, rewrites: DataFrame, barrels: DataFrame, along: DataFrame | None = None, gone: DataFrame | None = None) -> DataFrame:
    """The tree after the plan, ``path, content``: moved files at their new place (the left copy's content), imports and barrels changed.

    along: templates and styles (``source, target``) that go with them, each to all its targets.  gone: ``path`` of files that
    the plan deletes; what moves is read before.  Where two files go to one place the first by path is taken, and what moves
    there stands before what lay there.
    """
    changes = rewrites_by_file(rewrites).select("path", "changes")
    moved = mapping.select(F.col("old_path").alias("path"), "new_path")
    if along is not None:
        moved = moved.unionByName(along.select(F.col("source").alias("path"), F.col("target").alias("new_path"))).distinct()
    names = files.select("path").join(merged(moved), "path", "left").select("path", F.coalesce("new_path", "path").alias("_to"), F.col("new_path").isNull().alias("_stays"))
    if gone is not None:
        lost = names.where("_stays").join(merged(gone.select("path")), "path", "left_anti")
        names = lost.unionByName(names.where("not _stays"))
    first = names.groupBy("_to").agg(F.min(F.struct("_stays", "path")).alias("x")).select("_to", "x.path")  # contents of others are not read
    both = files.join(merged(first), "path").join(merged(changes), "path", "left").join(merged(barrels.select("path", "remove")), "path", "left")

    def apply(text: Column, c: Column) -> Column:
        for q in ("'", '"'):
            text = F.replace(text, F.concat(F.lit(f"from {q}"), c["old_import"], F.lit(q)), F.concat(F.lit(f"from {q}"), c["new_import"], F.lit(q)))
        return text

    text = F.when(F.col("changes").isNull(), F.col("content")).otherwise(F.aggregate("changes", F.col("content"), apply))
    kept = F.filter(F.split(text, "\n"), lambda x: ~F.regexp_replace(x, "\"", "'").contains(F.concat(F.lit("'"), F.col("remove"), F.lit("'"))))
    text = F.when(F.col("remove").isNotNull(), F.array_join(kept, "\n")).otherwise(text)
    return both.select(F.col("_to").alias("path"), text.alias("content"))
