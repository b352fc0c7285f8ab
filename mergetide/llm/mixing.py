"""Mixing sources to target weights by Pareto order sampling, with DataFrame operations only.

Sources get shares of the mix by weight, each up to ``max_repeats`` times its own size; the excess is shared again by
weight until no source is above its cap (water filling).  Inside a source documents weigh by size: those under half the
source's mean ``size_weights[0]``, those over twice the mean ``size_weights[2]``, others ``size_weights[1]``.  The source's
target is filled over these three strata in the same way, which gives each stratum its expected copies: whole copies are
certain, and the fraction left is the inclusion probability of its documents.  The source then draws one sample of fixed
size over all strata by Pareto order sampling: documents rank by ``odds(u) / odds(p)`` with ``u`` uniform from a keyed hash
of id and text, and the lowest ranks are taken until the source's words are full.

Ranks are cut into bins; word sums by (source, bin) give each source's boundary bin, and only documents inside it are
put in order by a window, so that a source holding most rows spreads over all tasks.

Edges: null text has size 0; the null source is a source of its own and comes last; sources of size 0 get target 0;
repeated rows are separate documents that share their rank, and ties at a boundary fall on equal ranks ordered by id and
size (rows that share an id but not a text have ranks of their own; rows alike in both all fall in one bin); an empty
table gives an empty mix; columns other than id, source and text are dropped.  Sources are taken to be few: a row each
is broadcast, and beyond ``MOST_SOURCES`` of them the joins are left to the engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mergetide.llm.quality import joined_words
from mergetide.sources.shared import cut

BINS, MOST_SOURCES = 4096, 100_000


def uniform(id_col: Column, text: Column, seed: str) -> Column:
    """A number in (0, 1) from 52 bits of a keyed hash."""
    key = F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def water_filled(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``rows(weight, cap, turn, total)`` with ``filled``: the total of each group dealt out by weight, none above its cap.

    With rows in order of cap over weight (``turn``), all up to some place stop at their caps, and the rest share what is
    left by weight; a row stops at its cap iff its cap is at most its weight times the level ``(total - caps before) /
    weights from here``.
    """
    group = Window.partitionBy(*(by or [F.lit(0)]))
    turn = group.orderBy("turn", *order)
    before, after = turn.rowsBetween(Window.unboundedPreceding, -1), turn.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    s = rows.withColumn("level", F.coalesce(F.try_divide(left, F.sum("weight").over(after)), F.lit(0.0)))
    s = s.withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    # levels fall from the first row that is not full on: that one holds
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(group)
    return s.withColumn("filled", F.when(F.col("full"), F.col("cap")).otherwise(level * F.col("weight"))).drop("level", "full")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, max_repeats: float) -> DataFrame:
    """``sizes(source, source_size, ...)``, a row per source, with its ``target`` in words."""
    everything = Window.partitionBy(F.lit(0))
    ranks = sizes.withColumn("rank", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    s = ranks.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_repeats)))
    s = s.withColumn("turn", F.col("cap") / F.col("weight")).withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
    return water_filled(s, [], ["rank"]).select(*sizes.columns, F.col("filled").alias("target"))


def stratum_copies(strata: DataFrame, size_weights: tuple[float, float, float], max_repeats: float) -> DataFrame:
    """``strata(source, stratum, words, target, ...)`` with whole copies, inclusion probability and the source's words to draw."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in size_weights]), F.col("stratum") + 1)
    s = strata.withColumn("turn", float(max_repeats) / weight).withColumn("weight", weight * F.col("words"))
    s = s.withColumn("cap", F.col("words") * F.lit(float(max_repeats))).withColumn("total", F.col("target"))
    s = water_filled(s, ["source"], ["stratum"])
    copies = F.least(F.lit(float(max_repeats)), F.round(F.coalesce(F.try_divide("filled", "words"), F.lit(0.0)), 9))
    s = s.withColumn("whole", F.floor(copies)).withColumn("p", copies - F.floor(copies))
    rest = F.col("target") - F.sum(F.col("whole") * F.col("words")).over(Window.partitionBy("source"))
    return s.withColumn("rest", rest).select("source", "stratum", "source_size", "target", "whole", "p", "rest")


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_repeats: float = 2.0, size_weights: tuple[float, float, float] = (1.0, 2.0, 3.0), seed: str = "mix",
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row of ``docs``; ``taken`` counts words, repeats included."""
    joined = joined_words(F.col(text_col))
    n_words = F.when(joined == "", F.lit(0)).otherwise(F.length(joined) - F.length(F.replace(joined, F.lit(" "), F.lit(""))) + 1)
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words.cast("long").alias("size"), uniform(F.col(id_col), F.col(text_col), seed).alias("u"))
    d = cut(d, "sizes")  # numbers only: the texts are read once
    per_source = d.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    per_source = cut(source_targets(per_source, weights, share, max_repeats), "sources")
    small = F.broadcast if per_source.limit(MOST_SOURCES + 1).count() <= MOST_SOURCES else (lambda df: df)

    def of_source(d: DataFrame, s: DataFrame, how: str = "inner") -> DataFrame:
        return d.join(small(s.withColumnRenamed("source", "of")), F.col("source").eqNullSafe(F.col("of")), how).drop("of")

    times = F.col("size") * F.col("n_docs")
    stratum = F.when(2 * times < F.col("source_size"), 0).when(times > 2 * F.col("source_size"), 2).otherwise(1)
    d = of_source(d, per_source.select("source", "source_size", "n_docs")).withColumn("stratum", stratum).drop("source_size", "n_docs")
    strata = d.groupBy("source", "stratum").agg(F.sum("size").alias("words"))
    # three rows a source, written: what follows reads them three times
    strata = cut(stratum_copies(of_source(strata, per_source), size_weights, max_repeats).withColumnRenamed("stratum", "part"), "strata")
    u, p = F.col("u"), F.col("p")
    d = d.join(small(strata.withColumnRenamed("source", "of")), F.col("source").eqNullSafe(F.col("of")) & (F.col("stratum") == F.col("part"))).drop("of", "part")
    d = d.withColumn("rank", F.when(p > 0, (u / (1 - u)) / (p / (1 - p))))
    d = d.withColumn("bin", F.least(F.floor(F.col("rank") / (1 + F.col("rank")) * BINS), F.lit(BINS - 1)))
    bins = d.where("p > 0").groupBy("source", "bin").agg(F.sum("size").alias("bin_size"), F.first("rest").alias("rest"))
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("below", F.coalesce(F.sum("bin_size").over(upto), F.lit(0)))
    # the boundary bin of a source: the one in which its words reach the rest of the target
    edge = cut(bins.where((F.col("below") < F.col("rest")) & (F.col("below") + F.col("bin_size") >= F.col("rest"))).select("source", F.col("bin").alias("edge_bin"), F.col("below").alias("edge_below")), "edges")
    d = of_source(d, edge, "left")
    at_edge = F.col("bin") == F.col("edge_bin")
    inside = Window.partitionBy("source", "bin").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    edges = d.where(at_edge).withColumn("before", F.col("edge_below") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    # the document that crosses the target is taken if that brings the source nearer to it
    edges = edges.withColumn("extra", (F.col("before") < F.col("rest")) & (F.col("before") + F.col("size") - F.col("rest") <= F.col("rest") - F.col("before")))
    others = d.where(~F.coalesce(at_edge, F.lit(False))).withColumn("extra", F.coalesce((p > 0) & (F.col("edge_bin").isNull() | (F.col("bin") < F.col("edge_bin"))), F.lit(False)))
    out = others.unionByName(edges.drop("before"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("whole") + F.col("extra").cast("int"))).cast("long").alias("taken"))
