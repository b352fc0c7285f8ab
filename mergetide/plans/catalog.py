"""Registered queries of the divergence engine; their DuckDB equivalents are in :mod:`mergetide.plans.oracles`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergetide.functions import references as R
from mergetide.functions.text import file_type, state_kind
from mergetide.operators import analytics, diffing, edges, extracting, graph, matching, moving, resolving
from mergetide.plans import adapters as A
from mergetide.plans.oracles import ORACLES  # noqa: F401
from mergetide.session import Divergence
from mergetide.sources.shared import cut, merged

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


# two snapshots of the documents


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.sql_for_spark(spark, sf_dir, A.SNAP, "documents").withColumnsRenamed({"l": "left", "r": "right", "b": "base"})


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = diffing.classify(snapshot(spark, sf_dir).where("left is not null or right is not null"))
    return rows.withColumn("left_path", F.when(F.col("left").isNotNull(), F.col("path"))).withColumn("right_path", F.when(F.col("right").isNotNull(), F.col("path")))


@query
def divergence_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffing.classify(snapshot(spark, sf_dir)).select("path", "div_type")


@query
def divergence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.stats(classified(spark, sf_dir))


@query
def divergence_quick_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.quick_stats(classified(spark, sf_dir))


@query
def trivial_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.trivial_merges(classified(spark, sf_dir)).select("path", "div_type")


@query
def conflict_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.conflicts(classified(spark, sf_dir)).select("path")


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffing.measure(diffing.classify(snapshot(spark, sf_dir)), ["path"])


@query
def line_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [F.col(c).cast("long").alias(c) for c in ("left_add", "left_del", "right_add", "right_del")]
    return measured(spark, sf_dir).select("path", "div_type", *counts, "auto_mergeable")


@query
def conflict_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = measured(spark, sf_dir).select("path", F.explode("conflict_regions").alias("r"))
    return regions.select("path", F.col("r.start_line").cast("long").alias("start_line"), F.col("r.end_line").cast("long").alias("end_line"))


@query
def conflict_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's order of conflicts: by lines added on both sides, most first."""
    added = (F.col("left_add") + F.col("right_add")).cast("long")
    return measured(spark, sf_dir).where("div_type = 'CONFLICT'").select("path", added.alias("added")).orderBy(F.desc("added"), "path")


@query
def patch_line_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by class of the patches from ancestor to left copy of all changed files."""
    rows = classified(spark, sf_dir).where("div_type <> 'CLEAN'")
    patches = rows.select("path", diffing.unified_patch("path", "base", "left").alias("patch")).where("patch <> ''")
    return diffing.patch_lines(patches, ["path"]).groupBy("line_class").agg(F.count("*").alias("n"))


@query
def shortened_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the report's patches from ancestor to left copy, cut after twenty."""
    rows = classified(spark, sf_dir).where("div_type <> 'CLEAN'")
    patch = diffing.unified_patch("path", "base", "left").alias("patch")
    cut_off = rows.select("path", patch).where("patch <> ''").select("path", diffing.shortened(F.col("patch"), 20).alias("patch"))
    return cut_off.select("path", F.size(F.split("patch", "\n")).cast("long").alias("n_lines"), F.regexp_extract("patch", r"\.\.\. truncated \((\d+) more lines\)$", 1).alias("n_more"))


@query
def last_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest order of each customer, as commits of a path."""
    from mergetide.sources.tables import table

    o = table(spark, sf_dir, "orders")
    commits = o.select(F.col("o_custkey").cast("string").alias("path"), F.struct("o_orderdate", "o_orderkey").alias("seq"), F.col("o_orderkey").cast("string").alias("hash"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_orderpriority").alias("author"))
    return diffing.last_commits(commits)


# pairing


def moved_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    m = A.sql_for_spark(spark, sf_dir, A.MOVED, "documents")
    side = lambda p, there: m.where(there).select(F.col(p).alias("path"), "ordinal", "class_name", "selector")
    return side("left_path", "in_left"), side("right_path", "in_right")


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match_files(*moved_sides(spark, sf_dir))


@query
def match_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark, sf_dir)


@query
def match_with_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = moved_sides(spark, sf_dir)
    m = A.sql_for_spark(spark, sf_dir, A.MOVED, "documents")
    x = m.where("ordinal % 97 in (1, 3)").select("left_path", (F.col("ordinal") + 1).alias("ordinal"))
    overrides = x.join(m.select("ordinal", "right_path"), "ordinal").select("left_path", "right_path")
    return matching.match_files(left, right, overrides)


@query
def left_only_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.left_only(matches(spark, sf_dir))


@query
def right_only_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.right_only(matches(spark, sf_dir))


@query
def match_method_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.method_counts(matches(spark, sf_dir))


@query
def match_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match_counting(*moved_sides(spark, sf_dir))[1]


@query
def suspicious_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.suspicious(matches(spark, sf_dir)).select("left_path", "right_path", "match_method")


@query
def extension_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = snapshot(spark, sf_dir)
    return analytics.extension_counts(s.where("left is not null").select("path"), s.where("right is not null").select("path"))


@query
def file_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot(spark, sf_dir).select("path", file_type(F.col("path")).alias("file_type")).groupBy("file_type").agg(F.count("*").alias("n"))


@query
def path_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.ordinals(snapshot(spark, sf_dir).select("path")).select("path", "ordinal")


# source text


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.sql_for_spark(spark, sf_dir, A.SOURCES, "part", dealt=spark.sparkContext.defaultParallelism)  # the texts are far larger than their table


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(extracting.parse_files(sources(spark, sf_dir)).withColumn("node_id", F.col("path")), "parsed")  # each text is parsed once


ALIASES = resolving.Aliases([("@app/*", ["left/*"])])


def resolved(p: DataFrame) -> DataFrame:
    """Imports of parsed files, by all their paths."""
    return resolving.resolve(extracting.import_rows(p), p, ALIASES)


@query
def parsed_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parsed(spark, sf_dir)
    lists = [F.array_join(c, ",").alias(c) for c in ("imports", "component_providers", "injections", "action_names", "action_ids", "action_refs", "selector_names", "selector_refs")]
    return p.select("path", "file_type", "class_name", "selector", *lists)


@query
def services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where services are provided: every part as one, in the root, in a module, in several ways of writing or nowhere."""
    files = sources(spark, sf_dir)
    ways = ["@Injectable({ providedIn: 'root' })", '@Injectable({ deps: [f(g(1))], "providedIn": "any" })', "@Injectable({ providedIn: Mod })", "@Injectable()", "/* @Injectable({ providedIn: 'x' }) */ @Injectable({ useFactory: () => ({ providedIn: 'y' }) })"]
    content = F.concat(F.element_at(F.array(*map(F.lit, ways)), (F.col("ordinal") % len(ways) + 1).cast("int")), F.lit("\nexport class S"), F.col("ordinal").cast("string"), F.lit(" { constructor(private h: Http) {} }"))
    return extracting.parse_files(files.select("path", content.alias("content"))).select("path", "file_type", "class_name", "provided_in", F.array_join("injections", ",").alias("injections"))


@query
def template_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(spark, sf_dir).select("path", F.explode("template_refs").alias("r")).select("path", F.col("r.type").alias("ref_type"), F.col("r.name").alias("ref_name"))


@query
def page_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipes that the text of pages seems to use, by name."""
    from mergetide.sources.tables import table

    return table(spark, sf_dir, "pages").select(F.explode(R.pipes(F.col("html"))).alias("ref_name")).groupBy("ref_name").agg(F.count("*").alias("n"))


@query
def state_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = snapshot(spark, sf_dir).select(F.concat(F.element_at(F.array(*map(F.lit, ["a.Actions.", "b.reducer.", "c.effects.", "d.selector.", "e.state.", "transaction"])), (F.col("doc_id") % 6 + 1).cast("int")), F.lit("/"), "path").alias("path"))
    return paths.groupBy(state_kind(F.col("path")).alias("state_kind")).agg(F.count("*").alias("n"))


@query
def resolved_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved(parsed(spark, sf_dir)).select("path", F.col("position").cast("long").alias("position"), "spec", "target")


def typed_edges(p: DataFrame) -> DataFrame:
    return edges.build_edges(p, resolved(p))


@query
def dependency_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed_edges(parsed(spark, sf_dir))


@query
def edge_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed_edges(parsed(spark, sf_dir)).groupBy("edge_type").agg(F.count("*").alias("n"))


@query
def unresolved_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports of files that exist but are no nodes: here every eleventh part is none."""
    p = parsed(spark, sf_dir)
    nodes = p.where("ordinal % 11 <> 4")
    return edges.resolved_imports(nodes, resolved(p))[1].select("src", "n_unresolved")


@query
def unresolved_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.unresolved_summary(unresolved_imports(spark, sf_dir))


# graphs


def tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return A.sql_for_spark(spark, sf_dir, A.NODES, "part").withColumn("effort", analytics.effort()), A.sql_for_spark(spark, sf_dir, A.TREE_EDGES, "part")


def cyclic(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return A.sql_for_spark(spark, sf_dir, A.CYCLE_NODES, "part", "supplier").withColumn("effort", analytics.effort()), A.sql_for_spark(spark, sf_dir, A.CYCLE_EDGES, "part", "supplier")


def tree_clean(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes, e = tree(spark, sf_dir)
    return nodes, e, cut(graph.clean_nodes(nodes, e), "clean")


@query
def node_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(*cyclic(spark, sf_dir))


@query
def graph_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.roots(*cyclic(spark, sf_dir))


@query
def node_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.depths(*cyclic(spark, sf_dir)).select("id", F.col("depth").cast("long").alias("depth"))


@query
def clean_subtrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, e = cyclic(spark, sf_dir)
    clean = graph.clean_nodes(nodes, e).withColumn("is_clean_subtree", F.lit(True))
    return nodes.select("id").join(merged(clean), "id", "left").na.fill(False, ["is_clean_subtree"])


@query
def clean_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, e, clean = tree_clean(spark, sf_dir)
    return graph.clean_roots(nodes, clean, e)


@query
def movable_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, e, clean = tree_clean(spark, sf_dir)
    return graph.movable_roots(nodes, clean, e)


def movable_trees(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes, e, clean = tree_clean(spark, sf_dir)
    return graph.subtrees(graph.movable_roots(nodes, clean, e), clean, e), nodes


@query
def movable_tree_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.tree_sizes(*movable_trees(spark, sf_dir))


@query
def movable_tree_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.tree_summary(analytics.tree_sizes(*movable_trees(spark, sf_dir)))


@query
def top_movable_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the trees that can be among the largest are made."""
    _, e, clean = tree_clean(spark, sf_dir)
    trees = cut(graph.subtrees(graph.largest_roots(graph.movable_roots(clean, clean, e), clean, e, 20), clean, e), "trees")
    return analytics.top_trees(trees.groupBy("root").agg(F.count("*").alias("size")), trees)


@query
def bottlenecks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.bottlenecks(*tree(spark, sf_dir)).select("id", "effort", "unlock_count", F.round("impact", 6).alias("impact"), analytics.impact_band(F.col("unlock_count")).alias("band"))


@query
def dirty_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.conflicts(tree(spark, sf_dir)[0]).select("id", "effort")


@query
def consolidation_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, e, clean = tree_clean(spark, sf_dir)
    flags = nodes.join(merged(clean.withColumn("is_clean", F.lit(True))), "id", "left").na.fill(False, ["is_clean"]).join(merged(graph.degrees(nodes, e)), "id")
    return analytics.priorities(flags)


@query
def expanded_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, e = cyclic(spark, sf_dir)
    return graph.expand(nodes.where("id like 'p:%9' or id like 's:%1'").select("id"), nodes, e)


@query
def dependency_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, e = tree(spark, sf_dir)
    return graph.levels(nodes.select("id"), e).select("id", F.col("level").cast("long").alias("level"))


@query
def cyclic_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels where nodes depend on each other in circles."""
    nodes, e = cyclic(spark, sf_dir)
    return graph.levels(nodes.select("id"), e).select("id", F.col("level").cast("long").alias("level"))


@query
def dependency_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that depend on each other, by the smallest of them."""
    nodes, e = cyclic(spark, sf_dir)
    return graph.strong_components(nodes.select("id"), graph.dependencies(e))


@query
def connected_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, e = cyclic(spark, sf_dir)
    return graph.connected(nodes.select("id"), graph.edges_within(e, nodes.where("ok")))


@query
def edges_of_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, e = cyclic(spark, sf_dir)
    return graph.edges_within(e, nodes.where("ok"))


# validation, governance, reports


@query
def scan_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = snapshot(spark, sf_dir)
    return analytics.validation(s.where("doc_id % 10 <> 1").select("path"), s.where("doc_id % 7 <> 2").select("path"))


@query
def missing_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = snapshot(spark, sf_dir)
    spots = F.when(F.col("doc_id") % 8 < 7, F.get(F.array(*map(F.lit, ["a.spec.", "a.test.", "__tests__/", "x/e2e/", "x/tests/", "y/", "z.d.ts."])), (F.col("doc_id") % 8).cast("int"))).otherwise(F.lit("w/"))
    return s.select(analytics.file_pattern(F.concat(spots, F.col("path"))).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n"))


@query
def next_report_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = snapshot(spark, sf_dir).select(F.concat(F.lit("report"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, F.lit(".html")).otherwise(F.lit(".txt"))).alias("name"))
    return analytics.next_report(names).select(F.col("next_number").cast("long").alias("next_number"))


@query
def shared_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = sources(spark, sf_dir)
    files = files.select("ordinal", "path", F.replace("content", F.lit("'rxjs'"), F.when(F.col("ordinal") % 2 == 0, F.lit("'../../right/x'")).otherwise(F.lit("'/lib/left/y'"))).alias("content"))
    return extracting.shared_violations(files, resolved(cut(extracting.parse_files(files).select("path", "imports"), "parsed")).where("target is not null"), "left", "right")


@query
def report_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classified(spark, sf_dir)
    return analytics.search(rows, "DE/doc1", ["CONFLICT", "LEFT_ONLY"]).select("path", "div_type")


@query
def report_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.page(classified(spark, sf_dir), 2).select("path", "div_type")


@query
def report_page_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.page_count(classified(spark, sf_dir))


# moving files


def plan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """Moves every fortieth part and all that it depends on."""
    p = parsed(spark, sf_dir)
    nodes = p.select(F.col("path").alias("id"), F.col("path").alias("left_path"), F.lit(None).cast("string").alias("right_path"))
    e = cut(typed_edges(p), "edges")
    seeds = p.where("ordinal % 40 = 39").select(F.col("path").alias("id"))
    ids = cut(graph.expand(seeds, nodes, e), "selection")
    moves = moving.file_moves(ids.withColumn("position", F.lit(None).cast("long")), nodes, "shared")  # order only matters where it is shown
    return nodes, e, ids, moves, moving.path_mapping(moves, nodes)


@query
def plan_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, e, ids, *_ = plan(spark, sf_dir)
    return moving.file_moves(graph.ordered(graph.levels(ids, e)), nodes, "shared").select("position", "source", "target")


@query
def plan_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _, _, moves, _ = plan(spark, sf_dir)
    files = sources(spark, sf_dir)
    return moving.deleted_paths(moves, nodes, moving.associated_files(moves, files), files).distinct()


@query
def plan_importers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, e, _, moves, _ = plan(spark, sf_dir)
    return moving.affected_importers(moves, nodes, e)


@query
def plan_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = plan(spark, sf_dir)[4]
    found = moving.import_rewrites(sources(spark, sf_dir), mapping, ALIASES)
    return found.select("path", F.col("line").cast("long").alias("line"), "old_import", "new_import")


@query
def plan_rewrite_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewrites grouped by file."""
    mapping = plan(spark, sf_dir)[4]
    return moving.rewrites_by_file(moving.import_rewrites(sources(spark, sf_dir), mapping, ALIASES)).select("path", "n_imports")


def with_barrels(files: DataFrame) -> DataFrame:
    """The tree with a barrel in each folder of modules, which exports the folder's files: a hundred at most."""
    names = files.select(F.regexp_extract("path", "^(.*)/", 1).alias("dir"), F.regexp_extract("path", "/([^/]*)[.]ts$", 1).alias("name"))
    exports = F.transform(F.array_sort(F.collect_list("name")), lambda n: F.concat(F.lit("export * from './"), n, F.lit("';")))
    lines = names.groupBy("dir").agg(F.concat(F.array_join(exports, "\n"), F.lit("\n")).alias("content"))
    return files.select("path", "content").unionByName(lines.select(F.concat("dir", F.lit("/index.ts")).alias("path"), "content"))


@query
def plan_barrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moving.barrel_updates(with_barrels(sources(spark, sf_dir)), plan(spark, sf_dir)[4])


@query
def plan_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, e, _, moves, mapping = plan(spark, sf_dir)
    files = with_barrels(sources(spark, sf_dir))
    along = moving.associated_files(moves, files)
    gone = moving.deleted_paths(moves, nodes, along, files)
    return moving.plan_counters(moves, along, moving.affected_importers(moves, nodes, e), moving.import_rewrites(files, mapping, ALIASES), moving.barrel_updates(files, mapping), gone)


@query
def rewritten_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = plan(spark, sf_dir)[4]
    files = with_barrels(sources(spark, sf_dir))
    return moving.rewritten(files, mapping, moving.import_rewrites(files, mapping, ALIASES), moving.barrel_updates(files, mapping))


# the session, over two branches of a tree


def session(spark: SparkSession, sf_dir: str) -> Divergence:
    both = A.sql_for_spark(spark, sf_dir, A.BRANCHES, "part", dealt=spark.sparkContext.defaultParallelism)
    left, right = (cut(both.where(F.col("side") == i).select("ordinal", "path", "content"), "files") for i in (0, 1))
    return Divergence(left, right, left).match().diff().graph()


@query
def session_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session(spark, sf_dir).edges


@query
def session_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [F.col(c).cast("long").alias(c) for c in ("left_add", "left_del", "right_add", "right_del")]
    return session(spark, sf_dir).divergence.select("id", "div_type", *counts, "auto_mergeable")


@query
def session_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added and removed lines of the patches of changed pairs, empty ones left out."""
    lines = diffing.patch_lines(session(spark, sf_dir).patches, ["id", "side"])
    lines = lines.where(F.col("line_class").isin("added", "removed") & ~F.col("line").rlike(r"^(--- |[+]{3} |[-+]$)"))  # no heads and no empty lines
    return lines.select("id", "side", "line_class", "line")


@query
def session_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session(spark, sf_dir).unresolved.select("src", "n_unresolved", F.array_join("samples", ",").alias("samples"))


@query
def session_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type, names and clean subtrees of all nodes."""
    d = session(spark, sf_dir).analyse()
    nodes = d.nodes.join(merged(d.clean.withColumn("is_clean", F.lit(True))), "id", "left").na.fill(False, ["is_clean"])
    return nodes.select("id", "file_type", F.col("metadata.class_name").alias("class_name"), F.col("metadata.selector").alias("selector"), "div_type", "is_clean")
