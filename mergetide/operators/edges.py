"""Typed dependency edges between nodes: all kinds of references in one equi join, imports in another.

``parsed`` tables have a row per file: ``path, ordinal, node_id`` and its references as arrays.  Indexes give the last
node that holds a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mergetide.sources.shared import merged

SAMPLES = 5
#: kind of edge, arrays of the parsed table that name its targets, what they are names of
REFERENCES = [
    ("injection", ["injections"], "class"),
    ("ngmodule-import", ["module_imports"], "class"),
    ("ngmodule-declaration", ["declarations"], "class"),
    ("provider", ["providers", "component_providers"], "class"),
    ("ngrx-action", ["action_refs"], "action"),
    ("ngrx-selector", ["selector_refs"], "store_selector"),
]
#: kind of edge, types of template references that make it; all name a selector
TEMPLATE_REFERENCES = [("template-selector", ["component", "directive"]), ("template-pipe", ["pipe"])]
#: what names are of, arrays or single columns of the parsed table that hold them
NAMES = {"class": ["class_name"], "selector": ["selector"], "action": ["action_names", "action_ids"], "store_selector": ["selector_names"]}


def index(keyed: DataFrame, *keys: str) -> DataFrame:
    """``keys, dst``: the last node (by ordinal) that holds each key; the last of ``keys`` is not empty."""
    return keyed.where(F.col(keys[-1]) != "").groupBy(*keys).agg(F.max_by("node_id", "ordinal").alias("dst"))


def listed(column: Column, *said: Column) -> Column:
    """An array's strings as structs of ``said`` and ``key``; none for null."""
    return F.transform(F.coalesce(column, F.array().cast("array<string>")), lambda x: F.struct(*said, x.alias("key")))


def template_names(types: list[str]) -> Column:
    return F.transform(F.filter("template_refs", lambda r: r["type"].isin(*types)), lambda r: r["name"])


def references(parsed: DataFrame) -> DataFrame:
    """``src, edge_type, space, key``: all that files refer to by name."""
    said = lambda kind, space: (F.lit(kind).alias("edge_type"), F.lit(space).alias("space"))
    found = [listed(F.col(c), *said(kind, space)) for kind, arrays, space in REFERENCES for c in arrays]
    for kind, types in TEMPLATE_REFERENCES:
        found.append(listed(template_names(types), *said(kind, "selector")))
    return parsed.select(F.col("node_id").alias("src"), F.explode(F.concat(*found)).alias("x")).select("src", "x.*")


def names(indexed: DataFrame) -> DataFrame:
    """``node_id, ordinal, space, key``: all names that files go by."""
    kinds = dict(indexed.dtypes)
    array = lambda c: F.col(c) if kinds[c].startswith("array") else F.array(c)
    found = [listed(array(c), F.lit(space).alias("space")) for space, columns in NAMES.items() for c in columns]
    return indexed.select("node_id", "ordinal", F.explode(F.concat(*found)).alias("x")).select("node_id", "ordinal", "x.*")


def resolved_imports(parsed: DataFrame, imports: DataFrame, nodes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges, unresolved): ``imports(path, target)`` whose target is a node's file, and those whose is not.

    nodes: the files that are nodes, where they are not those of ``parsed``.  Unresolved rows are ``src, n_unresolved,
    samples``, the samples at most five targets in order.
    """
    of = merged(parsed.select("path", "node_id"))
    named = imports.where("target is not null").join(of, "path").select(F.col("node_id").alias("src"), "target")
    found = merged(index((parsed if nodes is None else nodes).select(F.col("path").alias("target"), "node_id", "ordinal"), "target"))
    edges = named.join(found, "target").select("src", "dst", F.lit("import").alias("edge_type"))
    place = F.row_number().over(Window.partitionBy("src").orderBy("target"))  # a file's imports
    lost = named.join(found, "target", "left_anti").withColumn("place", place)
    few = F.array_sort(F.collect_list(F.when(F.col("place") <= SAMPLES, F.col("target"))))
    return edges, lost.groupBy("src").agg(F.count("*").alias("n_unresolved"), few.alias("samples"))


def build_edges(parsed: DataFrame, imports: DataFrame | None = None, indexed: DataFrame | None = None) -> DataFrame:
    """``src, dst, edge_type``, distinct and without loops.

    indexed: the rows that indexes of classes, selectors and stores are made of, where these are not all of ``parsed``.
    """
    found = merged(index(names(parsed if indexed is None else indexed), "space", "key"))
    edges = references(parsed).join(found, ["space", "key"]).select("src", "dst", "edge_type")
    if imports is not None:
        edges = edges.unionByName(resolved_imports(parsed, imports)[0])
    return edges.where("src <> dst").distinct()
