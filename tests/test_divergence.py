import json
import random
import subprocess

import pytest
from pyspark.sql import functions as F

from mergetide.functions import references
from mergetide.functions.text import import_between, normalised, relative_to, state_kind, tidy_path
from mergetide.operators import analytics, diffing, extracting, graph, matching, moving, resolving
from mergetide.session import Divergence
from mergetide.sources import reports, trees
from mergetide.sources.writers import write_tree

FILES = "ordinal long, path string, content string"


@pytest.mark.parametrize(
    ("base", "left", "right", "expected"),
    [
        (None, "a", "a", "CLEAN"), (None, "a", "b", "CONFLICT"), (None, "a", None, "LEFT_ONLY"), (None, None, "b", "RIGHT_ONLY"), (None, None, " \n", "CLEAN"),
        ("a", "a", "a", "CLEAN"), ("a", "b", "b", "SAME_CHANGE"), ("a", "a", "b", "RIGHT_ONLY"), ("a", "b", "a", "LEFT_ONLY"), ("a", "b", "c", "CONFLICT"),
        ("a", "a", None, "RIGHT_ONLY"), ("a", "b", None, "CONFLICT"), ("a", None, None, "SAME_CHANGE"), ("a\nb", "a\r\nb", "a\nb\n", "CLEAN"),
    ],
)
def test_decision_table(spark, base, left, right, expected):
    d = spark.createDataFrame([(base, left, right)], "base string, left string, right string")
    assert diffing.classify(d).first()["div_type"] == expected


def shortest(a, b):
    m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            m[i + 1][j + 1] = m[i][j] + 1 if x == y else max(m[i][j + 1], m[i + 1][j])
    return len(a) + len(b) - 2 * m[-1][-1]


def test_edit_scripts_are_shortest_and_right():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(9))] for _ in range(2))
        script = diffing.edit_script(a, b)
        assert len(script) == shortest(a, b)
        gone, new = {i for op, i, _ in script if op == "-"}, [j for op, _, j in script if op == "+"]
        kept = [x for i, x in enumerate(a) if i not in gone]
        assert kept == [y for j, y in enumerate(b) if j not in set(new)]
        added, removed, _ = diffing.changed("\n".join(a), "\n".join(b))
        assert added - removed == len(b) - len(a)


def test_conflict_regions(spark):
    rows = [("same", "a\nb\nc", "x\nb\nc", "y\nb\nc"), ("two", "a\nb\nc\nd", "x\nb\ny\nd", "p\nb\nq\nd"), ("insert", "a\nb", "a\nx\nb", "a\ny\nb"), ("two way", None, "a", "b")]
    d = spark.createDataFrame(rows, "path string, base string, left string, right string")
    got = {r["path"]: ([tuple(x) for x in r["conflict_regions"]], r["auto_mergeable"]) for r in diffing.measure(diffing.classify(d), ["path"]).collect()}
    assert got == {"same": ([(1, 1)], False), "two": ([(1, 1), (3, 3)], False), "insert": ([], True), "two way": ([], False)}


def greedy(left, right, overrides):
    done, used_l, used_r = [], set(), set()
    known_l, known_r = {x[0] for x in left}, {x[0] for x in right}
    for a, b in overrides:
        if a in known_l:
            done.append((a, b if b in known_r else None, "manual"))
            used_l.add(a)
            used_r.add(b)
    for method, key in (("path", 0), ("classname", 2), ("selector", 3)):
        last = {x[key]: x[0] for x in right if x[key]}
        for x in left:
            b = last.get(x[key]) if x[key] else None
            if x[0] not in used_l and b and b not in used_r:
                done.append((x[0], b, method))
                used_l.add(x[0])
                used_r.add(b)
    done += [(x[0], None, "unmatched") for x in left if x[0] not in used_l] + [(None, x[0], "unmatched") for x in right if x[0] not in used_r]
    return sorted(done, key=str)


def test_matching_equals_greedy_loop(spark):
    rng = random.Random(7)
    for _ in range(3):
        side = lambda n: [(p, i, rng.choice([None, "", "A", "B", "C"]), rng.choice([None, "s", "t", "u"])) for i, p in enumerate(rng.sample("abcdefghijkl", n))]
        left, right = side(8), side(8)
        overrides = [(left[0][0], right[3][0]), ("zz", right[1][0]), (left[1][0], "zz")]
        schema = "path string, ordinal long, class_name string, selector string"
        got = matching.match_files(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), spark.createDataFrame(overrides, "left_path string, right_path string"))
        assert sorted((tuple(r) for r in got.select("left_path", "right_path", "match_method").collect()), key=str) == greedy(left, right, overrides)


def test_graph_against_search(spark):
    rng = random.Random(3)
    n = 24
    pairs = {(rng.randrange(n), rng.randrange(n)) for _ in range(30)} | {(i, i + 1) for i in range(16, 20)}
    edges = sorted((a, b) for a, b in pairs if a != b)
    ok = [rng.random() < 0.85 for _ in range(n)]
    out = {i: {b for a, b in edges if a == i} for i in range(n)}

    def reach(i):
        seen, todo = set(), list(out[i])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += out[x]
        return seen

    bad = {i for i in range(n) if not ok[i] or i in reach(i)}
    clean = {i for i in range(n) if i not in bad and not reach(i) & bad}
    nodes = spark.createDataFrame([(i, ok[i], not ok[i], i % 3) for i in range(n)], "id int, ok boolean, dirty boolean, effort int")
    e = spark.createDataFrame(edges, "src int, dst int")
    assert {r["id"] for r in graph.clean_nodes(nodes, e).collect()} == clean
    blockers = {i: {x for x in reach(i) | {i} if not ok[x]} for i in range(n)}
    alone = [min(b) for b in blockers.values() if len(b) == 1]
    got = {r["id"]: r["unlock_count"] for r in graph.bottlenecks(nodes, e).collect()}
    assert got == {i: alone.count(i) for i in range(n) if not ok[i]}
    levels = {r["id"]: r["level"] for r in graph.levels(nodes.select("id"), e).collect()}
    acyclic = {i for i in range(n) if not any(j in reach(j) for j in reach(i) | {i})}
    assert all(levels[a] > levels[b] for a, b in edges if a in acyclic)


def test_long_chains(spark):
    """More rounds than tables are kept for, where every second node has a side way and chains cannot be drawn together."""
    n = 21
    nodes = spark.createDataFrame([(i, True) for i in range(2 * n)], "id int, ok boolean")
    e = spark.createDataFrame([(i, i + 1) for i in range(n - 1)] + [(i, n + i) for i in range(n)], "src int, dst int")
    assert {r["id"]: r["depth"] for r in graph.depths(nodes, e).collect()} == {i: i for i in range(n)} | {n + i: i + 1 for i in range(n)}
    assert graph.clean_nodes(nodes, e).count() == 2 * n


def test_chains_of_any_length_take_few_rounds(spark, monkeypatch):
    n = 2000
    chain = [(i, i + 1) for i in range(n)]
    short = [(0, 5000), (5000, 5001), (5001, n), (n, 6000), (6000, 6001), (7000, 7001), (7001, 7000), (7001, 7002)]  # a shorter way, a tail and a cycle
    e = spark.createDataFrame(chain + short, "src int, dst int")
    ids = sorted({x for pair in chain + short for x in pair})
    nodes = spark.createDataFrame([(i, True) for i in ids], "id int, ok boolean")
    rounds, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df, name="cut": rounds.append(name) or cut(df, name))
    got = {r["id"]: r["depth"] for r in graph.depths(nodes, e).collect()}
    assert got == {i: i for i in range(n)} | {5000: 1, 5001: 2, n: 3, 6000: 4, 6001: 5, 7000: 0, 7001: 0, 7002: 0}
    assert len(rounds) <= 30
    rounds.clear()
    level = {r["id"]: r["level"] for r in graph.levels(nodes.where("id < 7000").select("id"), e).collect()}
    assert level == {i: n + 2 - i for i in range(n + 1)} | {5000: 4, 5001: 3, 6000: 1, 6001: 0} and len(rounds) <= 30
    assert {r["id"] for r in graph.clean_nodes(nodes, e).collect()} == set(ids) - {7000, 7001}
    trees_ = graph.subtrees(nodes.where("id in (0, 1000)").select("id"), nodes.select("id"), e).groupBy("root").agg(F.count("*").alias("n"), F.max("depth").alias("deepest"))
    assert {tuple(r) for r in trees_.collect()} == {(0, n + 5, n - 1), (1000, 1003, 1002)}


def test_paths(spark):
    d = spark.createDataFrame([("a/./b/../c.ts", "x/y/a.ts", "x/z/b.ts"), ("../q/r", "a.ts", "b.tsx")], "p string, s string, t string")
    got = d.select(tidy_path(F.col("p")).alias("p"), import_between(F.col("s"), F.col("t")).alias("i"), normalised(F.lit("  a\r\nb \n")).alias("n")).collect()
    assert [tuple(r) for r in got] == [("a/c.ts", "../z/b", "a\nb"), ("../q/r", "./b", "a\nb")]


def test_resolution_order(spark):
    files = spark.createDataFrame([(p,) for p in ("a/x.ts", "a/x/index.ts", "a/y.component.ts", "a/d/index.ts", "lib/k.ts", "a/j.js")], "path string")
    specs = ["./x", "./y.component", "./d", "@l/k", "rxjs", "./j.js", "./j"]
    imports = spark.createDataFrame([("a/main.ts", i, s) for i, s in enumerate(specs)], "path string, position int, spec string")
    aliases = resolving.Aliases([("@l/*", ["lib/*"])])
    got = {r["spec"]: r["target"] for r in resolving.resolve(imports, files, aliases).collect()}
    assert got == {"./x": "a/x.ts", "./y.component": "a/y.component.ts", "./d": "a/d/index.ts", "@l/k": "lib/k.ts", "rxjs": None, "./j.js": "a/j.js", "./j": None}
    assert {r["spec"]: r["target"] for r in resolving.resolve(imports, files, aliases, planner=True).collect()}["./j"] == "a/j.js"


CODE = """import { S } from './s';
@NgModule({ imports: [A, B.forRoot({x: 1}), C.y, ...rest], declarations: [D] })
export class M { constructor(private s: S, n: number, t: Store<X>) {} }
const r = on(go, () => 1); function (x) {} ofType('[P] q', b)
"""


def test_extraction(spark):
    r = extracting.parse_files(spark.createDataFrame([(0, "a/m.ts", CODE), (1, "a/t.html", "<app-x [appD]='1'> <NG-CONTAINER> {{ a || b | async }}")], FILES)).orderBy("ordinal").first()
    assert (r["file_type"], r["class_name"], r["module_imports"], r["declarations"], r["injections"]) == ("module", "M", ["A", "B", "C"], ["D"], [])
    same = extracting.parse_files(spark.createDataFrame([(0, "a/m.ts", CODE.replace("@NgModule", "@Directive"))], FILES)).first()
    assert (same["file_type"], same["module_imports"], same["injections"]) == ("directive", [], ["S", "Store<X>"])  # a module's constructor does not count
    assert r["action_refs"] == ["go", "x", "[P] q", "b"]


def tree_of(tmp_path, name, files):
    for path, text in files.items():
        at = tmp_path / name / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)
    return str(tmp_path / name)


def test_session_over_trees(spark, tmp_path):
    a = {"m.ts": "import { S } from './s';\n@Injectable()\nexport class M { constructor(s: S) {} }", "s.ts": "export class S {}", "node_modules/z.ts": "x", "only.ts": "export class O {}"}
    b = dict(a, **{"s.ts": "export class S { x = 1 }"})
    b.pop("only.ts")
    left, right = (trees.scan_tree(spark, tree_of(tmp_path, n, f), n) for n, f in (("left", a), ("right", b)))
    assert trees.scan_tree(spark, str(tmp_path / "none"), "x").count() == 0
    d = Divergence(left, right, left).match().diff().graph().analyse()
    assert {r["id"]: r["div_type"] for r in d.divergence.collect()} == {"m.ts": "CLEAN", "s.ts": "RIGHT_ONLY", "only.ts": "RIGHT_ONLY"}
    assert {(r["src"], r["dst"], r["edge_type"]) for r in d.edges.collect()} == {("m.ts", "s.ts", "import"), ("m.ts", "s.ts", "injection")}
    assert d.clean.count() == 0
    assert spark.sql("select count(*) as n from divergence_nodes").first()["n"] == 3
    reports.write_report(d.divergence.select("id", "div_type"), str(tmp_path / "report"))
    assert "\\u003c" in reports.report_rows(spark.createDataFrame([("<a>",)], "id string")).first()["json"]


def test_mapping_aliases_and_base(spark, tmp_path):
    (tmp_path / "map.json").write_text(json.dumps({"manualOverrides": {"a.ts": "b.ts"}}))
    assert [tuple(r) for r in trees.mapping_overrides(spark, str(tmp_path / "map.json")).collect()] == [("a.ts", "b.ts")]
    assert trees.mapping_overrides(spark, str(tmp_path / "none.json")).count() == 0
    aliases = trees.path_aliases('{\n // c\n "compilerOptions": {"baseUrl": "src", "paths": {"@a/*": ["app/*",]},},}', "/r/left")
    assert aliases == resolving.Aliases([("@a/*", ["/r/left/src/app/*"])], "/r/left/src")
    assert trees.other_branch(aliases, "left", "right").base_url == "/r/right/src"
    repo = tree_of(tmp_path, "repo", {"f.ts": "one\n"})
    git = ["git", "-C", repo, "-c", "user.email=a@b", "-c", "user.name=n"]
    for args in (["init", "-q"], ["add", "."], ["commit", "-qm", "x"]):
        subprocess.run([*git, *args], check=True)
    paths = spark.createDataFrame([("f.ts",), ("g.ts",)], "path string")
    assert [tuple(r) for r in trees.base_files(paths, trees.git_root(repo), "HEAD").collect()] == [("f.ts", "one\n")]


def test_plan(spark):
    files = spark.createDataFrame([
        (0, "r/a/x.ts", "import { Y } from '../b/y';\nimport z from 'lib';\nexport class X {}"), (1, "r/b/y.ts", "export class Y {}"), (2, "r/c/u.ts", "import { X } from '../a/x';"),
        (3, "r/a/index.ts", "export * from './x';\nexport * from './w';"), (4, "r/a/x.html", "<p>"), (5, "r/c/u.spec.ts", "import { X } from '../a/x';"),
    ], FILES)
    nodes = spark.createDataFrame([("a/x.ts", "r/a/x.ts", None)], "id string, left_path string, right_path string")
    moves = moving.file_moves(spark.createDataFrame([("a/x.ts", 0)], "id string, position long"), nodes, "shared")
    mapping = moving.path_mapping(moves, nodes)
    rewrites = moving.import_rewrites(files, mapping)
    assert {(r["path"], r["line"], r["old_import"], r["new_import"]) for r in rewrites.collect()} == {
        ("r/a/x.ts", 1, "../b/y", "../../r/b/y"), ("r/c/u.ts", 1, "../a/x", "../../shared/a/x"), ("r/a/index.ts", 1, "./x", "../../shared/a/x"),
    }
    barrels = moving.barrel_updates(files, mapping)
    assert [tuple(r) for r in barrels.collect()] == [("r/a/index.ts", "./x", "r/a/x.ts")]
    assert {r["source"] for r in moving.associated_files(moves, files).collect()} == {"r/a/x.html"}
    tree = {r["path"]: r["content"] for r in moving.rewritten(files, mapping, rewrites.where("path <> 'r/a/index.ts'"), barrels).collect()}
    assert tree["shared/a/x.ts"].startswith("import { Y } from '../../r/b/y';") and tree["r/a/index.ts"] == "export * from './w';" and "r/a/x.ts" not in tree
    assert {r["id"] for r in moving.selection(" a , b,", nodes).collect()} == {"a", "b"}


def random_text(rng, n):
    return "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789\n", k=n))


def test_ordinals_keep_wide_rows(spark):
    """Contents that do not compress, so that the engine merges ranges differently for rows and for counts."""
    texts = spark.range(30_000).selectExpr("concat('p', lpad(id, 6, '0')) as path", "concat_ws('', transform(sequence(1, 80), i -> sha2(concat(id, ':', i), 256))) as content")
    for plan in (matching.ordinals(texts), matching.ordinals(texts.repartition(7))):
        got = plan.selectExpr("count(*)", "count(distinct ordinal)", "min(ordinal)", "max(ordinal)", "count_if(cast(substr(path, 2) as int) = ordinal)").first()
        assert tuple(got) == (30_000, 30_000, 0, 29_999, 30_000)
    twice = spark.createDataFrame([("a",), ("a",), ("b",)], "path string")
    assert sorted(tuple(r) for r in matching.ordinals(twice).collect()) == [("a", 0), ("a", 1), ("b", 2)]
    assert matching.ordinals(twice.limit(0)).count() == 0


def test_scan_keeps_all_files(spark, tmp_path):
    rng = random.Random(1)
    for i in range(1500):
        at = tmp_path / "t" / f"d{i % 9}"
        at.mkdir(parents=True, exist_ok=True)
        (at / f"f{i}.ts").write_text(random_text(rng, 12_000))
    tree = trees.scan_tree(spark, str(tmp_path / "t"), "left")
    got = tree.selectExpr("count(*)", "count(distinct ordinal)", "max(ordinal)", "min(length(content))").first()
    assert tuple(got) == (1500, 1500, 1499, 12_000)
    assert trees.found_files(spark, str(tmp_path / "t")).count() == 1500
    assert trees.found_files(spark, str(tmp_path / "none")).count() == 0


def test_session_keeps_branches_apart(spark):
    """One path imports different files on each side, and one imports a file that is no node."""
    left = [(0, "a.ts", "import x from './x';\nexport class A {}"), (1, "x.ts", "export class X {}"), (2, "y.ts", "export class Y {}"), (3, "u.ts", "import z from './z.js';"), (4, "z.js", "1")]
    right = [(0, "a.ts", "import y from './y';\nexport class A {}"), *left[1:3], (3, "w.ts", "export class X {}"), (4, "v.ts", "@Directive() export class V { constructor(x: X) {} }")]
    tables = [spark.createDataFrame(t, FILES) for t in (left, right)]
    logs = [spark.createDataFrame([("a.ts", 1, f"{h}1", "d", "n"), ("a.ts", 2, f"{h}2", "d", "n")], "path string, seq long, hash string, date string, author string") for h in "lr"]
    d = Divergence(*tables, tables[0], commits=tuple(logs)).match().diff().graph().analyse()
    found = {(r["src"], r["dst"], r["edge_type"]) for r in d.edges.collect()}
    assert found == {("a.ts", "x.ts", "import"), ("a.ts", "y.ts", "import"), ("v.ts", "w.ts", "injection")}  # the last holder of a class wins
    assert [tuple(r) for r in d.unresolved.collect()] == [("u.ts", 1, ["z.js"])]
    nodes = {r["id"]: r for r in d.nodes.collect()}
    assert set(nodes) == {"a.ts", "x.ts", "y.ts", "u.ts", "w.ts", "v.ts"} and not nodes["u.ts"]["ok"]
    assert (nodes["a.ts"]["last_left"]["hash"], nodes["a.ts"]["last_right"]["hash"], nodes["x.ts"]["last_left"]) == ("l2", "r2", None)
    assert nodes["a.ts"]["file_type"] == "unknown" and nodes["v.ts"]["metadata"]["class_name"] == "V" and nodes["v.ts"]["metadata"]["exports"] is None


def test_template_rules(spark):
    html = "<app-x> <x-> <y-z <Kit-Box/> <a-b-9\n> [Index]=1 [appD] *Foo *ngIf {{ v | Size }} <c-d"
    r = spark.range(1).select(references.template_refs(F.lit(html)).alias("r")).first()["r"]
    assert [(x["type"], x["name"]) for x in r] == [("component", "app-x"), ("component", "y-z"), ("component", "kit-box"), ("component", "a-b-9"), ("directive", "appD"), ("directive", "ngIf"), ("pipe", "Size")]
    paths = ["transaction.service.ts", "a/B.Actions.ts", "x.reducer.ts", "x.effects.ts", "x.selector.ts", "x.selectors.ts", "x.state.ts", "actions.ts", "x.actions.tsx"]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select(state_kind(F.col("p")).alias("k")).collect()
    assert [x["k"] for x in got] == [None, "action", "reducer", "effect", "selector", "selector", "state", None, None]
    d = spark.createDataFrame([("/r/a/b.ts", "/r/"), ("C:\\r\\x.ts", "C:/r"), ("/q/x", "/r")], "p string, r string")
    assert [x[0] for x in d.select(relative_to(F.col("p"), F.col("r"))).collect()] == ["a/b.ts", "x.ts", "/q/x"]
    aliases = resolving.Aliases([("@l/*", ["lib/*"]), ("@one", ["one.ts"])])
    specs = spark.createDataFrame([("@l/x",), ("@l",), ("@one",), ("@lx/y",), ("./@l/x",)], "s string")
    assert [x[0] for x in specs.select(resolving.is_aliased(F.col("s"), aliases)).collect()] == [True, True, True, False, False]


def test_patches_apply(spark):
    rng = random.Random(8)
    for _ in range(200):
        a, b = ([rng.choice("abcde") for _ in range(rng.randrange(30))] for _ in range(2))
        b = a[: rng.randrange(30)] + b[:3] + a[rng.randrange(1, 30) :]
        patch = diffing.patch_text("p", "\n".join(a), "\n".join(b)).split("\n")
        out, at = [], 0
        for line in patch[2:]:
            if line.startswith("@@"):
                start, _, n = line.split(" ")[1][1:].partition(",")
                start = int(start) - (n != "0")
                out, at = out + a[at:start], start
            elif line[0] == "+":
                out.append(line[1:])
            else:
                assert a[at] == line[1:]
                out, at = (out + [line[1:]] if line[0] == " " else out), at + 1
        assert out + a[at:] == b or a == b
    big = [f"l{rng.randrange(10**9)}" for _ in range(20_000)]
    assert len(diffing.edit_script(big, [f"m{i}" for i in range(20_000)])) == 40_000


def test_governance_and_samples(spark):
    none = spark.createDataFrame([], "path string, import_path string, points_to string")
    extracting.require_clean(none)
    with pytest.raises(extracting.SharedViolations, match="1 imports"):
        extracting.require_clean(none.union(spark.createDataFrame([("s.ts", "/left/x", "left")], none.schema)))
    a, b = (spark.createDataFrame([(f"{x}{i:02d}",) for i in range(15)] + [("same",)], "path string") for x in "ab")
    got = analytics.validation_samples(a, b).collect()
    assert [tuple(r) for r in got] == [("missing", f"a{i:02d}") for i in range(10)] + [("extra", f"b{i:02d}") for i in range(10)]
    lost = spark.createDataFrame([(f"n{i}", 4, list("abcd")) for i in range(7)], "src string, n_unresolved long, samples array<string>")
    assert [tuple(r) for r in analytics.unresolved_samples(lost).collect()] == [(f"n{i}", 4, list("abc")) for i in range(5)]
    trees_ = spark.createDataFrame([("r", f"m{i:02d}") for i in range(12)], "root string, id string")
    assert analytics.first_members(trees_).first()["members"] == [f"m{i:02d}" for i in range(10)]
    nodes = spark.createDataFrame([("d", True, 0), ("a", False, 0), ("b", False, 0)], "id string, dirty boolean, effort int")
    e = spark.createDataFrame([("a", "d"), ("b", "d"), ("b", "gone")], "src string, dst string")
    assert [tuple(r) for r in analytics.unlocking(graph.bottlenecks(nodes, e, samples=2)).select("id", "unlock_count", "samples").collect()] == [("d", 3, ["a", "b"])]
    assert [tuple(r)[:2] for r in graph.missing_dependencies(nodes, e).collect()] == [("b", "gone")]


def test_commits_mapping_and_branches(spark, tmp_path):
    (tmp_path / "log.txt").write_text("\x02h2\x012024\x01An\x01\na.ts\nb.ts\n\n\x02h1\x012023\x01Bo\x01\na.ts\n\x02h0\x012022\x01Bo\x01\n")
    commits = trees.commits_from_log(spark, str(tmp_path / "log.txt"))
    assert sorted((r["path"], r["hash"]) for r in diffing.last_commits(commits).collect()) == [("a.ts", "h2"), ("b.ts", "h2")] and commits.count() == 3
    (tmp_path / "bad.json").write_text("not json")
    assert trees.mapping_overrides(spark, str(tmp_path / "bad.json")).count() == 0
    pairs = spark.createDataFrame([("a", "b", "path")], "left_path string, right_path string, match_method string")
    trees.write_mapping(pairs, pairs.select("left_path", "right_path"), str(tmp_path / "m"))
    assert [tuple(r) for r in trees.mapping_overrides(spark, str(tmp_path / "m/overrides")).collect()] == [("a", "b")]
    text = '{"compilerOptions": {"baseUrl": "src", "paths": {"@a/*": ["app/*"]}}}'
    one, two = trees.branch_aliases(text, "/r/left", "/r/left", "/r/right")
    assert (one.base_url, two.base_url) == ("/r/left/src", "/r/right/src")
    one, two = trees.branch_aliases(text, "/cfg", "/r/left", "/r/right")
    assert (one.base_url, two.entries) == ("/r/left/src", [("@a/*", ["/r/right/src/app/*"])])


def test_plan_over_two_branches(spark):
    code = "@Component({ templateUrl: './t.html', styleUrls: ['./no.css'] })\nexport class X {}"
    files = spark.createDataFrame([(0, "left/x.ts", code), (1, "right/x.ts", code), (2, "right/t.html", ""), (3, "left/x.scss", ""), (4, "right/x.scss", ""), (5, "left/u.test.ts", "import './x';")], FILES)
    nodes = spark.createDataFrame([("x.ts", "left/x.ts", "right/x.ts"), ("u.test.ts", "left/u.test.ts", None), ("n", None, None)], "id string, left_path string, right_path string")
    moves = moving.file_moves(spark.createDataFrame([("x.ts", 0)], "id string, position long"), nodes, "shared")
    both = ("left", "right")
    along = moving.associated_files(moves, files, both)
    assert {(r["source"], r["target"]) for r in along.collect()} == {("right/t.html", "shared/t.html"), ("left/x.scss", "shared/x.scss")}
    assert [r["warning"] for r in moving.association_warnings(moves, files, both).collect()] == ["not found: ./no.css"]
    gone = moving.deleted_paths(moves, nodes, along, files, both)
    assert sorted(r["path"] for r in gone.collect()) == ["left/x.scss", "left/x.ts", "right/t.html", "right/x.scss", "right/x.ts"]
    e = spark.createDataFrame([("u.test.ts", "x.ts")], "src string, dst string")
    users = moving.affected_importers(moves, nodes, e)
    assert sorted(r["path"] for r in users.collect()) == ["left/u.test.ts", "left/x.ts"]
    mapping = moving.path_mapping(moves, nodes)
    rewrites = moving.import_rewrites(files, mapping)
    totals = moving.plan_counters(moves, along, users, rewrites, moving.barrel_updates(files, mapping), gone).first()
    assert tuple(totals) == (3, 2, 0, 0, 5)
    ids = spark.createDataFrame([("n",), ("zz",), ("x.ts",)], "id string")
    assert sorted(tuple(r) for r in moving.plan_warnings(ids, nodes).collect()) == [("n", "no path"), ("zz", "unknown node")]


def test_log_in_several_files(spark, tmp_path):
    """The newest part of a log may be the smaller file, and Spark packs files by size."""
    log = tmp_path / "log"
    log.mkdir()
    old = "".join(f"\x02old{i}\x012019-01-{28 - i:02d}T00:00:00+00:00\x01Bo\x01\n{'a.ts' if i < 3 else f'x{i}.ts'}\n{'b.ts' if i == 5 else ''}\n" for i in range(20))
    (log / "2-old.txt").write_text(old + "\x02older\x012018\x01Bo\x01\n" + "\n".join(f"y{i}.ts" for i in range(2000)))
    (log / "1-new.txt").write_text("\x02new2\x012023-12-31T00:00:00+00:00\x01An\x01\na.ts\n\x02new1\x012024-01-01T00:00:00+00:00\x01An\x01\na.ts\n")
    got = {r["path"]: r["hash"] for r in diffing.last_commits(trees.commits_from_log(spark, str(log))).collect()}
    assert (got["a.ts"], got["b.ts"], got["x7.ts"], got["y3.ts"]) == ("new2", "old5", "old7", "older")  # within a file the place decides
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # a file in several blocks
    try:
        assert {r["path"]: r["hash"] for r in diffing.last_commits(trees.commits_from_log(spark, str(log))).collect()} == got
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_report_has_no_end(spark, tmp_path):
    nodes = spark.range(1, 2501).select(F.format_string("n%05d", "id").alias("id"), F.lit("</script>").alias("div_type"))
    patches = spark.createDataFrame([("n02450", "left", "p", "-<b>\n+c"), ("n02450", "right", "p", "+d")], "id string, side string, path string, patch string")
    assert reports.write_report(nodes.repartition(7), str(tmp_path / "r"), patches, page_rows=100) == 25
    rows = reports.report_page(spark, str(tmp_path / "r"), 25).orderBy("place").collect()
    assert [r["id"] for r in rows] == [f"n{i:05d}" for i in range(2401, 2501)]
    assert [p["patch"] for p in json.loads(rows[49]["json"])["patches"]] == ["-<b>\n+c", "+d"]
    html = reports.report_html(spark, str(tmp_path / "r"), 25)
    assert html.startswith("<!DOCTYPE html>") and "page 25 of 25" in html and html.count("</script>") == 1 and html.index("n02401") < html.index("n02500")
    assert reports.report_html(spark, str(tmp_path / "r"), 26) is None
    assert reports.write_report(nodes.limit(0), str(tmp_path / "e")) == 0


def test_contents_stay_behind(spark):
    """Types are told by hashes alone, and contents of clean files are not put together."""
    files = lambda rows: spark.createDataFrame(rows, "path string, content string")
    left, right = files([("a", "1"), ("b", "1\n2"), ("c", " "), ("d", "x"), ("f", "q")]), files([("a", "1\r\n"), ("b", "1\n3"), ("c", None), ("e", "x"), ("f", "w")])
    base = files([("a", "1"), ("b", "1\n2"), ("d", ""), ("e", "y"), ("f", "  ")])
    matches = spark.createDataFrame([("a", "a"), ("b", "b"), ("c", "c"), ("d", "e"), ("f", "f"), ("g", None)], "left_path string, right_path string")
    typed = diffing.typed_pairs(matches, *[diffing.hashed(t) for t in (left, right, base)])
    plan = typed._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and not any("content#" in x for x in plan.split("\n") if "Exchange" in x and "Output" in x)
    got = {r["id"]: (r["div_type"], r["base_path"]) for r in typed.collect()}
    assert got == {"a": ("CLEAN", "a"), "b": ("RIGHT_ONLY", "b"), "c": ("CLEAN", None), "d": ("SAME_CHANGE", "e"), "f": ("CONFLICT", "f"), "g": ("CLEAN", None)}
    changed = diffing.changed_contents(typed, left, right, base)
    texts = {r["id"]: (r["base"], r["left"], r["right"]) for r in changed.collect()}
    assert texts == {"b": ("1\n2", "1\n2", "1\n3"), "d": ("y", "x", "x"), "f": ("  ", "q", "w")}
    whole = diffing.measure(diffing.classify(changed.drop("div_type")), ["id"]).select("id", "div_type", "left_add", "right_add", "right_del")
    parts = diffing.counted(changed, ["id"]).select(*whole.columns)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))
    said = {(r["id"], r["side"]): r["patch"] for r in diffing.patches(changed).collect()}
    assert set(said) == {("b", "right"), ("d", "left"), ("d", "right"), ("f", "left"), ("f", "right")} and said["b", "right"].endswith("\n-2\n+3")


def test_cycles_are_drawn_together(spark):
    rng = random.Random(8)
    for n, m in ((14, 20), (16, 40)):
        pairs = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(m)})
        out = {i: {b for a, b in pairs if a == i} for i in range(n)}
        reach = {}
        for i in range(n):
            seen, todo = set(), list(out[i])
            while todo:
                if (x := todo.pop()) not in seen:
                    seen.add(x)
                    todo += out[x]
            reach[i] = seen
        want = {i: min(j for j in reach[i] if i in reach[j]) for i in range(n) if i in reach[i]}
        ids = spark.range(n).select(F.col("id").cast("int").alias("id"))
        e = spark.createDataFrame(pairs, "src int, dst int")
        loops = graph.strong_components(ids, graph.dependencies(e.where("src <> dst")))
        assert {r["id"]: r["component"] for r in loops.collect()} == {i: c for i, c in want.items() if any(want.get(j) == c for j in range(n) if j != i)}
        place = {r["id"]: (r["level"], r["position"]) for r in graph.ordered(graph.levels(ids, e)).collect()}
        assert sorted(p for _, p in place.values()) == list(range(n))
        for a, b in pairs:
            if a != b:
                together = a in want and want.get(b) == want[a]
                assert (place[a][0] == place[b][0]) if together else (place[a][1] > place[b][1] and place[a][0] > place[b][0])


def test_plan_becomes_files(spark, tmp_path):
    """Associated files go along, deleted copies go, and the files are those of the table."""
    code = "@Component({ templateUrl: './t.html' })\nexport class X {}"
    files = spark.createDataFrame([(0, "left/x.ts", code), (1, "right/x.ts", "old"), (2, "right/t.html", "<p>"), (3, "left/x.scss", "a {}"), (4, "right/x.scss", "b {}"), (5, "left/u.ts", "import { X } from './x';"), (6, "shared/x.scss", "older")], FILES)
    nodes = spark.createDataFrame([("x.ts", "left/x.ts", "right/x.ts")], "id string, left_path string, right_path string")
    moves = moving.file_moves(spark.createDataFrame([("x.ts", 0)], "id string, position long"), nodes, "shared")
    along = moving.associated_files(moves, files, ("left", "right"))
    gone = moving.deleted_paths(moves, nodes, along, files, ("left", "right"))
    mapping = moving.path_mapping(moves, nodes)
    tree = moving.rewritten(files, mapping, moving.import_rewrites(files, mapping), moving.barrel_updates(files, mapping), along, gone)
    want = {"shared/x.ts": code, "shared/t.html": "<p>", "shared/x.scss": "a {}", "left/u.ts": "import { X } from '../shared/x';"}
    assert {r["path"]: r["content"] for r in tree.collect()} == want
    root = str(tmp_path / "new")
    planned = write_tree(tree, root, dry_run=True)
    assert {tuple(r) for r in planned.collect()} == {(p, len(c), None) for p, c in want.items()} and not list(tmp_path.iterdir())
    assert sorted(map(tuple, write_tree(tree, root).collect())) == sorted(map(tuple, planned.collect()))
    back = trees.scan_tree(spark, root, "new", [".ts", ".html", ".scss"])
    assert {r["path"]: r["content"] for r in back.collect()} == want
    assert sorted(x.name for x in tmp_path.iterdir()) == ["new", "new.outcomes"]
    with pytest.raises(Exception, match="never overwritten"):
        write_tree(tree, root)


def test_rows_that_are_no_files(spark, tmp_path):
    """Each wrong row is told, and the others are written."""
    rows = [("a/b.ts", "ü"), ("a", "x"), ("c.ts", "1"), ("c.ts", "1"), ("../d.ts", "x"), ("/e.ts", "x"), ("f/", "x"), ("g//h", "x"), (None, "x"), ("", "x"), ("i.ts", None), ("n" * 300, "x"), ("j.ts", "")]
    tree = spark.createDataFrame([(*r, 1) for r in rows], "path string, content string, error int")
    got = {(r["path"], r["n_bytes"], r["error"]) for r in write_tree(tree, str(tmp_path / "t")).collect()}
    outside, twice = "path outside the folder or of a folder", "path twice"
    assert got == {
        ("a/b.ts", 2, None), ("a", 1, "a folder for other files"), ("c.ts", 1, twice), ("../d.ts", 1, outside), ("/e.ts", 1, outside), ("f/", 1, outside), ("g//h", 1, outside),
        (None, 1, "no path"), ("", 1, "no path"), ("i.ts", None, "no content"), ("n" * 300, 1, "File name too long"), ("j.ts", 0, None),
    }
    assert sorted(str(p.relative_to(tmp_path / "t")) for p in (tmp_path / "t").rglob("*") if p.is_file()) == ["a/b.ts", "j.ts"]
    assert write_tree(tree.limit(0), str(tmp_path / "empty")).count() == 0 and (tmp_path / "empty").is_dir()


def test_failed_write_leaves_nothing(spark, tmp_path):
    """A task that dies takes the whole tree with it."""
    tree = spark.range(0, 400, 1, 4).selectExpr("concat('f', id) AS path", "if(id = 399, raise_error('dies'), cast(id AS string)) AS content")
    with pytest.raises(Exception, match="dies"):
        write_tree(tree, str(tmp_path / "t")).collect()
    assert not list(tmp_path.iterdir())


def test_imports_travel_once(spark):
    """An import is one row however many endings are tried, and finds what a search through all candidates finds."""
    rng = random.Random(9)
    ends = ["", ".ts", ".tsx", "/index.ts", ".js", "/index.js", ".spec.ts", "/index", ".html"]
    paths = sorted({"r/" + "/".join(rng.choices("abc", k=rng.randrange(1, 3))) + rng.choice(ends) for _ in range(40)})
    specs = [rng.choice(["./", "../", "@/", "one", "r/", "/r/"]) + "/".join(rng.choices("abc", k=rng.randrange(1, 3))) + rng.choice(["", "", ".ts", ".js", "/index", ".html"]) for _ in range(300)]
    imports = spark.createDataFrame([("r/a/b.ts", i, s) for i, s in enumerate(specs)], "path string, position int, spec string")
    files = spark.createDataFrame([(p,) for p in [*paths, *paths[:5]]], "path string")
    aliases = resolving.Aliases([("@/*", ["r/*", "r/a/*"]), ("onea", ["r/a", "r/b"])], "r")
    for planner in (False, True):
        tried = imports.select("spec", resolving.candidates(F.col("path"), F.col("spec"), aliases, planner).alias("c"), F.size(resolving.places(F.col("path"), F.col("spec"), aliases, planner)).alias("n")).collect()
        assert all(r["n"] == 1 for r in tried if r["spec"][0] in "./")
        want = [next((p for p in r["c"] if p in paths), None) for r in tried]
        got = {r["position"]: r["target"] for r in resolving.resolve(imports, files, aliases, planner).collect()}
        assert [got[i] for i in range(len(specs))] == want and 20 < sum(w is not None for w in want) < 290


def test_largest_trees_are_found_without_all_trees(spark):
    """Estimates lie within their error, and the roots kept hold the largest trees and few others."""
    rng = random.Random(12)
    size = {f"r{i}": rng.choice([1, 3, 40, 700, 2000]) + rng.randrange(3) for i in range(30)}
    edges, want = set(), {}
    for r, n in size.items():  # chains, fans and shared members; every member of a tree hangs below its root
        own = [r, *(f"{r}.{i}" for i in range(n))]
        edges |= {(own[0] if i % 50 == 1 else own[rng.randrange(i)] if i % 3 else own[i - 1], own[i]) for i in range(1, len(own))}
        edges |= {(rng.choice(own), f"s{rng.randrange(200)}")}
    edges |= {(f"s{i}", f"s{i + 1}") for i in range(200)}
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    for r in size:
        seen, todo = {r}, [r]
        while todo:
            new = out.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        want[r] = len(seen)
    e = spark.createDataFrame(sorted(edges), "src string, dst string")
    clean = spark.createDataFrame([(x,) for x in sorted({x for pair in edges for x in pair})], "id string")
    tops = graph.movable_roots(clean, clean, e)
    got = {r["id"]: r["size"] for r in graph.tree_estimates(tops, clean, e).collect()}
    assert {r for r in got if r.startswith("r")} == set(want) and all(abs(got[r] - n) <= graph.SKETCH_ERROR * n for r, n in want.items())
    kept = {r["id"] for r in graph.largest_roots(tops, clean, e, 5).collect()}
    fifth = sorted(want.values())[-5]
    assert {r for r, n in want.items() if n >= fifth} <= kept and all(want[r] > 0.7 * fifth for r in kept)
    none = clean.limit(0)
    assert graph.largest_roots(none, none, e, 5).count() == 0
