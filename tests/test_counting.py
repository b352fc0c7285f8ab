"""Counters that writes add up in passing, and scans whose contents stay where they are."""

import random
import re

from pyspark.sql import functions as F

from mergetide.operators import analytics, matching
from mergetide.session import Divergence
from mergetide.sources import trees
from mergetide.sources.shared import cut_counting

SIDE = "path string, ordinal long, class_name string, selector string"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_counters_of_a_write(spark):
    rows = spark.range(1000).repartition(7).select("id", (F.col("id") % 3 == 0).alias("third"))
    kept, seen = cut_counting(rows, "counted", n=F.count("*"), thirds=F.count_if("third"), total=F.sum("id"))
    assert seen == {"n": 1000, "thirds": 334, "total": 499_500} and kept.count() == 1000
    for empty in (rows.where("id < 0"), rows.limit(0), spark.createDataFrame([], rows.schema)):
        kept, seen = cut_counting(empty, "counted", n=F.count("*"), total=F.sum("id"))
        assert seen == {"n": 0, "total": 0} and kept.columns == ["id", "third"] and not kept.count()


def test_reconciliation_reads_no_table(spark):
    rng = random.Random(3)
    side = lambda name: [(f"{name if rng.random() < 0.3 else 'x'}/{i}", i, rng.choice([None, "", f"C{i // 2}"]), f"s{i // 3}") for i in range(200) if rng.random() < 0.8]
    left, right = (spark.createDataFrame(side(n), SIDE) for n in "lr")
    matches, told = matching.match_counting(left, right)
    assert "Scan parquet" not in plan_of(told) and "Exchange" not in plan_of(told)
    pairs = [tuple(r) for r in matches.select("left_path", "right_path").collect()]
    got = told.first().asDict()
    assert got == {
        "pairs": sum(a is not None and b is not None for a, b in pairs), "left_only": sum(b is None for _, b in pairs), "right_only": sum(a is None for a, _ in pairs),
        "left_files": left.count(), "right_files": right.count(), "left_ok": True, "right_ok": True,
    }
    none = spark.createDataFrame([], SIDE)
    assert tuple(matching.match_counting(none, none)[1].first()) == (0, 0, 0, 0, 0, True, True)


def test_session_counts_in_passing(spark):
    files = lambda n: [(i, f"f{i}.ts", f"export class C{i} {{ a = {i % n} }}") for i in range(n)]
    left, right = (spark.createDataFrame(files(n), "ordinal long, path string, content string") for n in (20, 26))
    d = Divergence(left, right, left).match().diff().graph().analyse()
    assert d.stats.first() == analytics.stats(d.nodes).first() and d.stats.first()["n_total"] == 26
    assert "Scan parquet" not in plan_of(d.stats) + plan_of(d.reconciliation)
    assert d.reconciliation.first().asDict() == {"pairs": 20, "left_only": 0, "right_only": 6, "left_files": 20, "right_files": 26, "left_ok": True, "right_ok": True}


def test_validation_reads_each_scan_once(spark):
    rng = random.Random(4)
    a, b = ([(f"p{rng.randint(0, 60)}",) for _ in range(80)] for _ in range(2))
    found, parsed = (spark.createDataFrame(x, "path string").repartition(3) for x in (a, b))
    out = analytics.validation(found, parsed)
    assert plan_of(out).count("Join") == 0
    missing, extra = {x for x, in a} - {x for x, in b}, {x for x, in b} - {x for x, in a}
    assert tuple(out.first()) == (80, 80, len(missing), len(extra), 0, 100.0)
    none = found.limit(0)
    assert tuple(analytics.validation(none, none).first()) == (0, 0, 0, 0, 0, None)


def test_ranks_come_to_the_contents(spark, tmp_path):
    rng = random.Random(6)
    names = sorted({f"d{rng.randint(0, 5)}/f{rng.randint(0, 500)}.ts" for _ in range(120)})
    for name in names:
        at = tmp_path / "tree" / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(f"// {name}")
    tree = trees.scan_tree(spark, str(tmp_path / "tree"), "left")
    exchanges = [x for x in re.findall(r"[^\n]*Exchange[^\n]*", plan_of(tree)) if "content" in x]
    assert not exchanges
    assert sorted(tuple(r) for r in tree.collect()) == [("left", i, n, f"// {n}") for i, n in enumerate(names)]
