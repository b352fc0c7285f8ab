"""Joins that grow with the tables are never broadcast; the plans are read at the smallest scale, where the engine would."""

import pytest

from mergetide.operators import diffing, graph, matching, moving
from mergetide.plans import catalog

SF = "/root/testdata/sf0.001"


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["dependency_edges", "edge_type_counts"])
def test_edges(spark, name):
    plan = planned(catalog.QUERIES[name](spark, SF))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_matches(spark):
    assert "Broadcast" not in planned(matching.match_files(*catalog.moved_sides(spark, SF)))


def test_matches_plan_grows_with_the_passes(spark):
    """No pass is planned again in each later one: what is left of two sides is two joins with the pairs written before."""
    sides = catalog.moved_sides(spark, SF)
    for overrides in (None, sides[0].select(sides[0].path.alias("left_path"), sides[0].path.alias("right_path")).limit(3)):
        assert planned(matching.match_files(*sides, overrides)).count("SortMergeJoin") == 2


def test_moves(spark):
    nodes = spark.createDataFrame([("a", "l/a", "r/a")], "id string, left_path string, right_path string")
    moves = spark.createDataFrame([("a", 0, "l/a", "shared/a")], "id string, position long, source string, target string")
    assert "Broadcast" not in planned(moving.path_mapping(moves, nodes))
    e = spark.createDataFrame([("b", "a")], "src string, dst string")
    assert "Broadcast" not in planned(moving.affected_importers(moves, nodes, e))


def test_rewrites_plan_the_mapping_and_the_resolving_once(spark):
    """What is left of the plan of the rewrites is two joins of tables written before, however the mapping was made."""
    files = spark.createDataFrame([("left/m/a.ts", "import { B } from './b';"), ("left/m/b.ts", "")], "path string, content string")
    nodes = spark.createDataFrame([("b", "left/m/b.ts", None)], "id string, left_path string, right_path string")
    moves = spark.createDataFrame([("b", 0, "left/m/b.ts", "shared/b.ts")], "id string, position long, source string, target string")
    found = moving.import_rewrites(files, moving.path_mapping(moves, nodes))
    assert planned(found).count("SortMergeJoin") == 2
    assert [tuple(r) for r in found.select("path", "line", "old_import", "new_import").collect()] == [("left/m/a.ts", 1, "./b", "../../shared/b")]


def test_large_tables_of_loops(spark, monkeypatch):
    """A frontier beyond the bound asks for merge joins, one within it does not."""
    from mergetide.sources import shared

    edges = spark.createDataFrame([(i, i + 1) for i in range(20)], "id long, dependency long")
    for few, said in ((3, "SortMergeJoin"), (100, "Broadcast")):
        monkeypatch.setattr(shared, "FEW", few)
        found, n = shared.cut_sized(edges.select("id"))
        assert n == 20 and said in planned(edges.join(found, "id"))
    assert "Broadcast" not in planned(graph.degrees(edges.select("id"), edges.select(edges.id.alias("src"), edges.dependency.alias("dst"))))


def test_rounds_of_loops_write_one_table_and_are_read_by_one_scan(spark, monkeypatch):
    """What the driver plans in a round does not grow with the rounds before it."""
    from mergetide.sources import shared

    scans, cut, n = [], shared.cut, 6  # a ladder: no chains to draw together
    pairs = [(i, i + 1) for i in range(n - 1)] + [(i, n + i) for i in range(n)] + [(n - 1, 2 * n)]
    step = spark.createDataFrame(pairs, "id int, dependency int")
    need = spark.createDataFrame([(i, 2 if i < n else 0) for i in range(2 * n + 1)], "id int, missing long")
    monkeypatch.setattr(shared, "cut", lambda df, name="cut": scans.append(planned(df).count("FileScan")) or cut(df, name))
    done = graph.peel(need, step)
    assert planned(done).count("FileScan") == 1
    assert len(scans) == n + 3 and max(scans) <= 3  # chains, the first frontier, a round for each level and one that finds nothing
    assert {r["id"]: r["turn"] for r in done.collect()} == {i: n - i for i in range(n)} | {i: 0 for i in range(n, 2 * n + 1)}
    found = graph.spread(spark.createDataFrame([(0,)], "id int"), step.withColumnsRenamed({"id": "src", "dependency": "dst"}), [])
    assert planned(found).count("FileScan") == 1
    assert {r["id"]: r["depth"] for r in found.collect()} == {i: i for i in range(n)} | {n + i: i + 1 for i in range(n)} | {2 * n: n}


def test_contents_come_by_hundreds(spark):
    """Contents are diffed in small batches: no Arrow batch of ten thousand texts."""
    rows = spark.createDataFrame([("a", "CONFLICT", "1\n2", "1\nx", "1\ny")], "path string, div_type string, base string, left string, right string")
    for df in (diffing.measure(rows, ["path"]), rows.select(diffing.unified_patch("path", "base", "left"))):
        assert "BatchEvalPython" in planned(df) and "ArrowEvalPython" not in planned(df)
    found = diffing.measure(rows, ["path"]).first()
    assert (found.left_add, found.left_del, found.right_add, found.right_del, found.auto_mergeable) == (1, 1, 1, 1, False)
