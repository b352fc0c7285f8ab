"""Metadata of source files: one projection over ``files(branch, ordinal, path, content)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergetide.functions import references as R
from mergetide.functions.scanner import scanned
from mergetide.functions.text import beside, file_type, state_kind
from mergetide.sources.shared import cut_counting, merged


def parse_files(files: DataFrame) -> DataFrame:
    """``parsed``: type, class, selector and all references of each file; templates by URL are added by :func:`with_templates`.

    Source files are scanned once, in Arrow batches; what templates and stores name is found by native expressions.  Imports
    come before re-exports, each in order.
    """
    text = F.when(F.col("path").rlike(r"\.tsx?$"), F.col("content")).otherwise(F.lit(""))
    store = F.when(F.endswith(F.col("path"), F.lit(".ts")), F.col("content")).otherwise(F.lit(""))
    said = scanned(text)
    plain = ["class_name", "selector", "provided_in", "imports", "module_imports", "declarations", "exports", "providers", "component_providers", "injections", "template_url", "style_urls"]
    return files.select(
        *[c for c in files.columns if c != "content"],
        F.coalesce(said["kind"], file_type(F.col("path"))).alias("file_type"), *[said[c].alias(c) for c in plain], R.template_refs(said["template"]).alias("template_refs"),
        R.action_names(store).alias("action_names"), R.action_ids(store).alias("action_ids"), R.action_refs(store).alias("action_refs"),
        R.selector_names(store).alias("selector_names"), R.selector_refs(store).alias("selector_refs"), R.feature_name(store).alias("feature_name"),
        state_kind(F.col("path")).alias("state_kind"),
    )


def with_templates(parsed: DataFrame, files: DataFrame) -> DataFrame:
    """Template references of the file that ``template_url`` names, where there is one, in place of inline ones."""
    html = files.select(F.col("path").alias("_at"), R.template_refs(F.col("content")).alias("_refs"))
    nowhere = F.concat("path", F.lit("\0"))  # no file's path; one null for all would lie in one partition
    at = F.when(F.col("template_url").isNotNull(), beside(F.col("path"), F.col("template_url"))).otherwise(nowhere)
    joined = parsed.withColumn("_at", at).join(merged(html), "_at", "left")
    return joined.withColumn("template_refs", F.coalesce("_refs", "template_refs")).drop("_at", "_refs")


def node_rows(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """``pairs(id, left_path, right_path, ...)`` with ``file_type`` and ``metadata`` of their parsed files.

    Type and metadata are those of the left file where there is one, else of the right one; a type that neither gives is
    ``unknown``, and empty lists of the metadata are null.
    """

    def told(parsed: DataFrame, side: str) -> DataFrame:
        lists = [F.when(F.size(c) > 0, F.col(c)).alias(c) for c in ("declarations", "module_imports", "exports", "providers")]
        return parsed.select(F.col("path").alias(f"{side}_path"), F.col("file_type").alias(f"_{side}_type"), F.struct("selector", "class_name", "provided_in", *lists).alias(f"_{side}"))

    both = pairs.join(merged(told(left, "left")), "left_path", "left").join(merged(told(right, "right")), "right_path", "left")
    kind = F.coalesce("_left_type", "_right_type", F.lit("unknown"))
    return both.select(*pairs.columns, kind.alias("file_type"), F.coalesce("_left", "_right").alias("metadata"))


class SharedViolations(Exception):
    """A shared tree imports from a branch; ``rows`` are the first violations, ``count`` how many there are."""

    def __init__(self, count: int, rows: list) -> None:
        super().__init__(f"{count} imports of shared files lead back into a branch: " + "; ".join(f"{r['path']} -> {r['points_to']}: {r['import_path']}" for r in rows))
        self.count, self.rows = count, rows


def require_clean(violations: DataFrame, shown: int = 20) -> None:
    """Fails the job where ``violations(path, import_path, points_to)`` has rows; the message names the first ``shown``.

    Violations are found once: written, and counted meanwhile.
    """
    violations, seen = cut_counting(violations, "violations", n=F.count("*"))
    if n := seen["n"]:
        raise SharedViolations(n, violations.orderBy("path", "import_path").limit(shown).collect())


def import_rows(parsed: DataFrame) -> DataFrame:
    """``path, position, spec``."""
    return parsed.select("path", F.posexplode("imports").alias("position", "spec"))


def shared_violations(files: DataFrame, resolved: DataFrame, left: str, right: str) -> DataFrame:
    """``path, import_path, points_to``: imports of shared files that lead back into a branch.

    First by resolved imports, left tested before right; then by raw specifiers, unless one already reported for the
    file contains the string.
    """

    def side(x: Column, strict: bool) -> Column:
        test = lambda name: x.contains(f"/{name}/") | (x.contains(f"../{name}/") if strict else F.startswith(x, F.lit(f"{name}/")))
        return F.when(test(left), "left").when(test(right), "right")

    first = resolved.select("path", F.col("target").alias("import_path"), side(F.col("target"), False).alias("points_to")).where("points_to is not null")
    raw = files.where(F.col("path").rlike(r"\.tsx?$")).select("path", F.explode(R.raw_imports(F.col("content"))).alias("import_path")).distinct()
    raw = raw.select("path", "import_path", side(F.col("import_path"), True).alias("points_to")).where("points_to is not null")
    said = first.select(F.col("path").alias("_path"), F.col("import_path").alias("_found"))
    more = raw.join(merged(said), (F.col("path") == F.col("_path")) & F.col("_found").contains(F.col("import_path")), "left_anti")
    return first.unionByName(more)
