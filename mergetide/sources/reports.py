"""Report of an analysis: rows and pages in order of id, written by Spark, of any number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mergetide.functions.text import escaped_json
from mergetide.operators.matching import ordinals

PAGE_ROWS = 100
HEAD = "<!DOCTYPE html><html><head><meta charset='utf-8'><title>Divergence</title></head><body><p>page %d of %d</p><table id='t'></table><pre id='p'></pre><script>const rows=["
TAIL = (
    "];for(const r of rows){const x=t.insertRow();x.insertCell().textContent=r.div_type;x.insertCell().textContent=r.id;"
    "x.onclick=()=>p.textContent=(r.patches||[]).map(q=>q.patch).join('\\n')}</script></body></html>"
)


def report_rows(nodes: DataFrame) -> DataFrame:
    """``json``: one object per node, safe inside a page."""
    return nodes.select(escaped_json(F.to_json(F.struct(*nodes.columns))).alias("json"))


def numbered(page: Column, pages: int) -> Column:
    first, second = HEAD.split("%d", 1)
    return F.concat(F.lit(first), page.cast("string"), F.lit(second % pages))


def write_report(nodes: DataFrame, folder: str, patches: DataFrame | None = None, page_rows: int = PAGE_ROWS) -> int:
    """Writes all of ``nodes(id, ...)`` and returns the number of pages.

    ``folder/nodes`` has ``page, place, id, json`` in order of id, sorted by range, so that a page lies in one file or, at the
    edge of two ranges, in two; ``folder/pages`` has ``page, html``, sorted likewise.  patches: ``id, side, path, patch``, which become a
    list in their node's object.
    """
    spark = nodes.sparkSession
    if patches is not None:
        own = patches.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("side", "path", "patch"))).alias("patches"))  # two a node
        nodes = nodes.join(own, "id", "left")
    rows = nodes.select("id", escaped_json(F.to_json(F.struct(*nodes.columns))).alias("json"))
    ranked = ordinals(rows, "id")
    page = (F.floor(F.col("ordinal") / page_rows) + 1).cast("long")
    placed = ranked.select(page.alias("page"), F.col("ordinal").alias("place"), "id", "json")
    placed.write.mode("overwrite").parquet(f"{folder}/nodes")
    written = spark.read.schema(placed.schema).parquet(f"{folder}/nodes")
    pages = written.agg(F.coalesce(F.max("page"), F.lit(0)).alias("n")).first()["n"]
    texts = F.transform(F.array_sort(F.collect_list(F.struct("place", "json"))), lambda r: r["json"])  # a page's rows
    html = F.concat(numbered(F.col("page"), pages), F.array_join(texts, ","), F.lit(TAIL))
    written.groupBy("page").agg(html.alias("html")).repartitionByRange("page").sortWithinPartitions("page").write.mode("overwrite").parquet(f"{folder}/pages")
    return pages


def report_page(spark: SparkSession, folder: str, number: int) -> DataFrame:
    """``place, id, json`` of one page (from 1) of a written report; the files' statistics lead to those that hold it."""
    return spark.read.parquet(f"{folder}/nodes").where(F.col("page") == number).select("place", "id", "json")


def report_html(spark: SparkSession, folder: str, number: int) -> str | None:
    """The page as HTML; None where there is no such page."""
    found = spark.read.parquet(f"{folder}/pages").where(F.col("page") == number).first()
    return None if found is None else found["html"]
