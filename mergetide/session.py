"""The whole analysis over two snapshots and their common ancestor, step by step.

    Divergence(left, right, base).match().diff().graph().analyse()

Snapshots are tables ``ordinal, path, content`` of all files of a tree; those that end with ``code`` become nodes, the
others can be what templates name or imports lead to.  Each step keeps its tables as attributes and as temporary views.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergetide.operators import analytics, diffing, edges, extracting, graph, matching, resolving
from mergetide.sources.shared import cut, cut_counting, merged

#: order of nodes by the way they were matched: later nodes win where two hold one key
PASSES = ["manual", "path", "classname", "selector"]


class Divergence:
    """``aliases``: of both branches, or a pair of them; ``commits``: a pair of tables ``path, seq, hash, date, author``."""

    def __init__(
        self, left: DataFrame, right: DataFrame, base: DataFrame | None = None, overrides: DataFrame | None = None,
        aliases: resolving.Aliases | tuple[resolving.Aliases, resolving.Aliases] | None = None, commits: tuple[DataFrame, DataFrame] | None = None, code: str = ".ts",
    ) -> None:
        self.left, self.right, self.base, self.overrides, self.commits, self.code = left, right, base, overrides, commits, code
        self.aliases = aliases if isinstance(aliases, tuple) else (aliases, aliases)

    def _keep(self, name: str, table: DataFrame) -> DataFrame:
        table.createOrReplaceTempView(f"divergence_{name}")
        setattr(self, name, table)
        return table

    def match(self) -> Divergence:
        def parse(files: DataFrame) -> DataFrame:
            files = files.select("ordinal", "path", "content")
            code = files.where(F.endswith("path", F.lit(self.code)))
            told = code.select("*", diffing.content_hash(F.col("content")).alias("hash"), (F.coalesce("content", F.lit("")) != "").alias("filled"))
            return extracting.with_templates(extracting.parse_files(told), files)

        seen = {}
        for side, files in (("left", self.left), ("right", self.right)):
            parsed, n = cut_counting(parse(files), "parsed", **{f"{side}_files": F.count("*")})
            self._keep(f"parsed_{side}", parsed)
            seen |= n
        found = matching.match_files(self.parsed_left, self.parsed_right, self.overrides)
        matches, n = cut_counting(found, "matches", **matching.match_counters())
        self._keep("matches", matches)
        self._keep("reconciliation", matching.reconciliation(matches, seen | n))
        return self

    def diff(self) -> Divergence:
        """Types by hash; only contents of changed pairs are read again, for line counts and patches."""
        base = None if self.base is None else cut(diffing.hashed(self.base), "hashes")
        typed = cut(diffing.typed_pairs(self.matches, self.parsed_left, self.parsed_right, base), "typed")
        self._keep("changed", cut(diffing.changed_contents(typed, self.left, self.right, self.base), "changed"))
        keys = ["id", "left_path", "right_path"]
        found = diffing.unchanged(typed.where("div_type = 'CLEAN'"), keys).unionByName(diffing.counted(self.changed, keys))
        if self.commits is not None:
            found = diffing.with_commits(found, *self.commits)
        self._keep("divergence", cut(found, "divergence"))
        self._keep("patches", diffing.patches(self.changed))
        return self

    def graph(self) -> Divergence:
        """Edges of both branches' files: paths mean a file of the branch that names them; indexes take the left file of a pair."""
        pairs = self.divergence.select("id", "left_path", "right_path")
        method = F.array_position(F.array(*[F.lit(p) for p in PASSES]), F.col("match_method")).cast("long")
        order = self.matches.select(F.coalesce("left_path", "right_path").alias("id"), F.when(method > 0, method).when(F.col("right_path").isNull(), 8).otherwise(9).alias("turn"))
        ids = cut(pairs.join(merged(order), "id"), "ids")
        sides, linked, lost = [], [], []
        for parsed, files, column, aliases in ((self.parsed_left, self.left, "left_path", self.aliases[0]), (self.parsed_right, self.right, "right_path", self.aliases[1])):
            own = ids.where(F.col(column).isNotNull()).select(F.col(column).alias("path"), F.col("id").alias("node_id"), "turn", F.col("left_path").isNotNull().alias("has_left"))
            own = parsed.join(merged(own), "path").withColumn("ordinal", F.col("turn") * F.lit(1 << 48) + F.col("ordinal"))
            imports = cut(resolving.resolve(extracting.import_rows(own), files, aliases), "imports")  # edges and unresolved ones read them
            found, missed = edges.resolved_imports(own, imports)
            sides.append(own)
            linked.append(found)
            lost.append(missed)
        both = sides[0].unionByName(sides[1])
        indexed = sides[0].unionByName(sides[1].where("not has_left"))
        found = edges.build_edges(both, indexed=indexed).unionByName(linked[0]).unionByName(linked[1])
        self._keep("edges", cut(found.where("src <> dst").distinct(), "edges"))
        missed = lost[0].unionByName(lost[1]).groupBy("src").agg(F.sum("n_unresolved").alias("n_unresolved"), F.slice(F.array_sort(F.flatten(F.collect_list("samples"))), 1, edges.SAMPLES).alias("samples"))
        self._keep("unresolved", cut(missed, "unresolved"))  # two rows a node at most
        return self

    def analyse(self) -> Divergence:
        d = extracting.node_rows(self.divergence, self.parsed_left, self.parsed_right).withColumn("effort", analytics.effort())
        n = d.join(merged(self.unresolved.withColumnsRenamed({"src": "id", "samples": "unresolved_imports"})), "id", "left")
        n = n.withColumn("dirty", ~F.col("div_type").isin(*analytics.CLEAN_TYPES)).withColumn("ok", ~F.col("dirty") & F.col("n_unresolved").isNull())
        nodes, seen = cut_counting(n, "nodes", **analytics.stat_counters())
        self._keep("nodes", nodes)
        self._keep("stats", nodes.sparkSession.range(1).select(*[F.lit(n).cast("long").alias(name) for name, n in seen.items()]))
        clean = self._keep("clean", cut(graph.clean_nodes(self.nodes, self.edges), "clean"))
        self._keep("depths", graph.depths(self.nodes, self.edges))
        self._keep("trees", cut(graph.subtrees(graph.movable_roots(self.nodes, clean, self.edges), clean, self.edges), "trees"))
        self._keep("bottlenecks", graph.bottlenecks(self.nodes, self.edges))
        flags = self.nodes.join(merged(clean.withColumn("is_clean", F.lit(True))), "id", "left").na.fill(False, ["is_clean"]).join(merged(graph.degrees(self.nodes, self.edges)), "id")
        self._keep("priorities", analytics.priorities(flags))
        return self
