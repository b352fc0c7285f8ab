"""DuckDB equivalents of the registered queries."""

from __future__ import annotations

from mergetide.plans import adapters as A

D = A.sql_for_duckdb
SNAP, MOVED, SOURCES = D(A.SNAP), D(A.MOVED), D(A.SOURCES)
TREE, CYC, NODES, CYC_NODES = D(A.TREE_EDGES), D(A.CYCLE_EDGES), D(A.NODES), D(A.CYCLE_NODES)


def norm(x: str) -> str:
    return rf"regexp_replace(replace(coalesce({x}, ''), chr(13) || chr(10), chr(10)), '^\s+|\s+$', '', 'g')"


CLASSED = f"""
s AS ({SNAP}),
m AS (SELECT doc_id, path, l, r, b, {norm("l")} AS x, {norm("r")} AS y, {norm("b")} AS z FROM s),
t AS (SELECT *, CASE
    WHEN z = '' AND x = y THEN 'CLEAN' WHEN z = '' AND y = '' THEN 'LEFT_ONLY' WHEN z = '' AND x = '' THEN 'RIGHT_ONLY' WHEN z = '' THEN 'CONFLICT'
    WHEN x = z AND y = z THEN 'CLEAN' WHEN x = y THEN 'SAME_CHANGE' WHEN x = z THEN 'RIGHT_ONLY' WHEN y = z THEN 'LEFT_ONLY' ELSE 'CONFLICT' END AS div_type FROM m),
n AS (SELECT * FROM t WHERE l IS NOT NULL OR r IS NOT NULL)"""

TYPE_COUNTS = ", ".join(f"count(*) FILTER (WHERE {{p}}div_type = '{t}') AS n_{t.lower()}" for t in ("CLEAN", "LEFT_ONLY", "RIGHT_ONLY", "SAME_CHANGE", "CONFLICT"))

#: lines of all texts with how often each occurs; edits here replace a first line or add a last one, so that common lines keep their order
COUNTS = f"""
WITH {CLASSED},
u AS (SELECT path, side, unnest(string_split(txt, chr(10))) AS line FROM (
  SELECT path, 'x' AS side, x AS txt FROM t WHERE x <> '' UNION ALL SELECT path, 'y', y FROM t WHERE y <> '' UNION ALL SELECT path, 'z', z FROM t WHERE z <> '')),
c AS (SELECT path, line, count(*) FILTER (WHERE side = 'x') AS cx, count(*) FILTER (WHERE side = 'y') AS cy, count(*) FILTER (WHERE side = 'z') AS cz FROM u WHERE line <> '' GROUP BY 1, 2),
k AS (SELECT path, sum(greatest(cx - cz, 0)) AS xz, sum(greatest(cz - cx, 0)) AS zx, sum(greatest(cy - cz, 0)) AS yz, sum(greatest(cz - cy, 0)) AS zy,
        sum(greatest(cx - cy, 0)) AS xy, sum(greatest(cy - cx, 0)) AS yx FROM c GROUP BY path),
e AS (SELECT t.path, div_type, z = '' AS two_way,
    CASE WHEN div_type = 'CONFLICT' AND z = '' THEN xy WHEN div_type IN ('CONFLICT', 'SAME_CHANGE', 'LEFT_ONLY') THEN xz ELSE 0 END AS left_add,
    CASE WHEN div_type = 'CONFLICT' AND z = '' THEN yx WHEN div_type IN ('CONFLICT', 'SAME_CHANGE', 'LEFT_ONLY') THEN zx ELSE 0 END AS left_del,
    CASE WHEN div_type = 'CONFLICT' AND z = '' THEN yx WHEN div_type IN ('CONFLICT', 'SAME_CHANGE', 'RIGHT_ONLY') THEN yz ELSE 0 END AS right_add,
    CASE WHEN div_type = 'CONFLICT' AND z = '' THEN xy WHEN div_type IN ('CONFLICT', 'SAME_CHANGE', 'RIGHT_ONLY') THEN zy ELSE 0 END AS right_del,
    div_type = 'CONFLICT' AND z <> '' AND (x = '' OR x LIKE 'left head%') AND (y = '' OR y LIKE 'right head%') AS region
  FROM t LEFT JOIN k ON k.path = t.path)"""

PAIRS = f"""
m AS ({MOVED}),
l AS (SELECT left_path AS path, ordinal, class_name, selector FROM m WHERE in_left),
r AS (SELECT right_path AS path, ordinal, class_name, selector FROM m WHERE in_right),
{{override}}
l1 AS (SELECT * FROM l WHERE path NOT IN (SELECT lp FROM p0)), r1 AS (SELECT * FROM r WHERE path NOT IN (SELECT rp FROM p0 WHERE rp IS NOT NULL)),
p1 AS (SELECT l1.path AS lp, r1.path AS rp FROM l1 JOIN r1 ON l1.path = r1.path),
l2 AS (SELECT * FROM l1 WHERE path NOT IN (SELECT lp FROM p1)), r2 AS (SELECT * FROM r1 WHERE path NOT IN (SELECT rp FROM p1)),
k2 AS (SELECT class_name AS k, arg_max(path, ordinal) AS rp FROM r WHERE class_name <> '' GROUP BY 1),
p2 AS (SELECT lp, rp FROM (SELECT l2.path AS lp, k2.rp, row_number() OVER (PARTITION BY rp ORDER BY ordinal) AS n FROM l2 JOIN k2 ON l2.class_name = k2.k WHERE rp IN (SELECT path FROM r2)) WHERE n = 1),
l3 AS (SELECT * FROM l2 WHERE path NOT IN (SELECT lp FROM p2)), r3 AS (SELECT * FROM r2 WHERE path NOT IN (SELECT rp FROM p2)),
k3 AS (SELECT selector AS k, arg_max(path, ordinal) AS rp FROM r WHERE selector <> '' GROUP BY 1),
p3 AS (SELECT lp, rp FROM (SELECT l3.path AS lp, k3.rp, row_number() OVER (PARTITION BY rp ORDER BY ordinal) AS n FROM l3 JOIN k3 ON l3.selector = k3.k WHERE rp IN (SELECT path FROM r3)) WHERE n = 1),
a AS (
  SELECT lp AS left_path, rp AS right_path, 'manual' AS match_method FROM p0 UNION ALL SELECT lp, rp, 'path' FROM p1 UNION ALL SELECT lp, rp, 'classname' FROM p2 UNION ALL SELECT lp, rp, 'selector' FROM p3
  UNION ALL SELECT path, NULL, 'unmatched' FROM l3 WHERE path NOT IN (SELECT lp FROM p3)
  UNION ALL SELECT NULL, path, 'unmatched' FROM r3 WHERE path NOT IN (SELECT rp FROM p3))"""
MATCHED = "WITH " + PAIRS.format(override="p0 AS (SELECT path AS lp, path AS rp FROM l WHERE false),")
OVERRIDDEN = "WITH " + PAIRS.format(override="""p0 AS (SELECT x.left_path AS lp, CASE WHEN y.in_right THEN y.right_path END AS rp FROM m x JOIN m y ON y.ordinal = x.ordinal + 1 WHERE x.ordinal % 97 IN (1, 3) AND x.in_left),""")

REACH = "r(s, d) AS (SELECT src, dst FROM e UNION SELECT r.s, e.dst FROM r JOIN e ON e.src = r.d)"
CLEAN = "bad AS (SELECT id FROM n WHERE NOT ok OR id IN (SELECT s FROM r WHERE s = d)), c AS (SELECT id FROM n WHERE NOT (id IN (SELECT id FROM bad) OR id IN (SELECT s FROM r JOIN bad ON r.d = bad.id)))"
TREE_CLEAN = f"WITH RECURSIVE e AS ({TREE}), n AS ({NODES}), {REACH}, {CLEAN}"
MOVABLE = "mv AS (SELECT id FROM c WHERE id NOT IN (SELECT e.dst FROM e JOIN c ON c.id = e.src))"
#: below a clean node everything is clean
SUBTREES = f"{TREE_CLEAN}, {MOVABLE}, st AS (SELECT id AS root, id FROM mv UNION SELECT mv.id, r.d FROM mv JOIN r ON r.s = mv.id), sz AS (SELECT root, count(*) AS size, count(*) FILTER (WHERE div_type = 'CLEAN') AS n_clean, count(*) FILTER (WHERE div_type = 'SAME_CHANGE') AS n_same_change FROM st JOIN n ON n.id = st.id GROUP BY root)"

K = A.half
PART = f"p AS (SELECT p_partkey AS k, 'left/' || {A.module(1)} || '.ts' AS path, " + ", ".join(f"{K(i)} AS k{i}, 'left/' || {A.module(i)} || '.ts' AS p{i}" for i in (2, 3, 4, 5, 7)) + " FROM part)"
EDGES = f"""
WITH {PART}, e AS (
  SELECT DISTINCT src, dst, edge_type FROM (
    SELECT path AS src, p2 AS dst, 'import' AS edge_type FROM p UNION ALL SELECT path, p3, 'import' FROM p UNION ALL SELECT path, p2, 'injection' FROM p
    UNION ALL SELECT path, p5, 'provider' FROM p UNION ALL SELECT path, p3, 'template-selector' FROM p
    UNION ALL SELECT path, p7, 'ngrx-action' FROM p UNION ALL SELECT path, p4, 'ngrx-selector' FROM p) WHERE src <> dst)"""
PLAN = EDGES.replace("WITH ", "WITH RECURSIVE ", 1) + """,
g AS (SELECT DISTINCT src, dst FROM e), q(id) AS (SELECT path FROM p WHERE k % 40 = 39 UNION SELECT g.dst FROM q JOIN g ON g.src = q.id),
mv AS (SELECT id, 'shared/' || id AS target FROM q)"""


def rel(own: str, to: str) -> str:
    """The import between files two folders deep below ``left`` or ``shared/left``."""
    return f"""CASE WHEN {own}.id IS NOT NULL AND {to}.id IS NULL THEN '../../../left/' WHEN {own}.id IS NULL THEN '../../shared/left/' WHEN split_part({{a}}, '/', 2) = split_part({{b}}, '/', 2) THEN './' ELSE '../' END || CASE WHEN {own}.id IS NOT NULL AND {to}.id IS NOT NULL AND split_part({{a}}, '/', 2) = split_part({{b}}, '/', 2) THEN split_part({{b}}, '/', 3) ELSE split_part({{b}}, '/', 2) || '/' || split_part({{b}}, '/', 3) END"""


NEW = rel("o", "t").format(a="i.path", b="i.dst")
REWRITES = f"""
{PLAN}, i AS (SELECT path, p2 AS dst, 1 AS line, '../' || replace(substr(p2, 6), '.ts', '') AS old_import FROM p UNION ALL SELECT path, p3, 2, '@app/' || replace(substr(p3, 6), '.ts', '') FROM p),
w AS (SELECT i.path, CAST(line AS BIGINT) AS line, old_import, replace({NEW}, '.ts', '') AS new_import FROM i LEFT JOIN mv o ON o.id = i.path LEFT JOIN mv t ON t.id = i.dst WHERE (o.id IS NOT NULL OR t.id IS NOT NULL))"""

BARRELS = f"""
{PLAN}, h AS (SELECT regexp_extract(id, '^(.*)/', 1) AS dir, min(id) AS id FROM mv GROUP BY 1),
b AS (SELECT dir || '/index.ts' AS path, './' || replace(substr(id, length(dir) + 2), '.ts', '') AS remove, id AS old_path FROM h)"""

#: lines of the barrels; a moved file's export leads to its new place, and so is not removed
TREE_AFTER = f"""
{REWRITES}, x AS (SELECT path, line, old_import, new_import FROM w WHERE new_import <> old_import),
s AS ({SOURCES}), f AS (SELECT s.path, s.content, x1.old_import AS o1, x1.new_import AS n1, x2.old_import AS o2, x2.new_import AS n2
  FROM s LEFT JOIN x x1 ON x1.path = s.path AND x1.line = 1 LEFT JOIN x x2 ON x2.path = s.path AND x2.line = 2),
g1 AS (SELECT path, CASE WHEN o1 IS NULL THEN content ELSE replace(content, 'from ''' || o1 || '''', 'from ''' || n1 || '''') END AS content, o2, n2 FROM f),
g2 AS (SELECT path, CASE WHEN o2 IS NULL THEN content ELSE replace(content, 'from ''' || o2 || '''', 'from ''' || n2 || '''') END AS content FROM g1),
ex AS (SELECT regexp_extract(p.path, '^(.*)/', 1) AS dir, regexp_extract(p.path, '([^/]*)[.]ts$', 1) AS name, mv.id IS NOT NULL AS moved FROM p LEFT JOIN mv ON mv.id = p.path),
br AS (SELECT dir || '/index.ts' AS path, string_agg('export * from ''' || CASE WHEN moved THEN '../../shared/' || dir || '/' ELSE './' END || name || ''';', chr(10) ORDER BY name) || chr(10) AS content FROM ex GROUP BY dir)"""

#: lines of the patch from ancestor to left copy: an edit replaces the first line, adds one at the end, or changes every line
PATCHES = f"""
WITH {CLASSED}, q AS (SELECT *, coalesce(b, '') AS o, coalesce(l, '') AS a FROM n WHERE div_type <> 'CLEAN' AND coalesce(b, '') <> coalesce(l, '')),
z AS (SELECT *, CASE WHEN o = '' THEN 0 ELSE len(string_split(o, chr(10))) END AS no, CASE WHEN a = '' THEN 0 ELSE len(string_split(a, chr(10))) END AS na,
        o <> '' AND starts_with(a, o || chr(10)) AS tail, o <> '' AND starts_with(a, 'left head') AS head FROM q),
y AS (SELECT path, CASE WHEN tail THEN 0 WHEN head THEN 1 ELSE no END AS gone, CASE WHEN tail THEN na - no WHEN head THEN 1 ELSE na END AS new,
        CASE WHEN tail THEN least(3, no) WHEN head THEN least(3, no - 1) ELSE 0 END AS kept FROM z)"""

#: files of both branches, and what their text says
BRANCHES = f"""
t AS ({D(A.BRANCHES)}), f AS (SELECT * FROM t WHERE path LIKE '%.ts'),
c AS (SELECT side, path, regexp_extract(content, '\nexport class (C[0-9]+)', 1) AS class_name, nullif(regexp_extract(content, '\n@[A-Za-z]+[(][^\n]*(?:selector|name): ''([^'']*)''', 1), '') AS selector,
        regexp_extract(content, '\n@([A-Za-z]+)[(]', 1) AS kind, content FROM f),
i AS (SELECT side, path, unnest(regexp_extract_all(content, 'from ''[.][.]/([^'']+)''', 1)) AS spec FROM f),
r AS (SELECT i.side, i.path, t.path AS target FROM i JOIN t ON t.side = i.side AND t.path = CASE WHEN spec LIKE '%.js' THEN spec ELSE spec || '.ts' END),
h AS (SELECT side, replace(path, '.html', '.ts') AS path, content FROM t WHERE path LIKE '%.html'),
m AS (SELECT DISTINCT path AS dst, class_name, selector FROM c),
u AS (SELECT side, path, 'class' AS way, 'ngmodule-import' AS edge_type, unnest(regexp_extract_all(regexp_extract(content, 'imports: .([^]]*)', 1), 'C[0-9]+')) AS key FROM c
  UNION ALL SELECT side, path, 'class', 'injection', unnest(regexp_extract_all(regexp_extract(content, 'constructor[^\n]*'), ': (C[0-9]+)', 1)) FROM c WHERE kind IN ('Component', 'Directive')
  UNION ALL SELECT side, path, 'class', 'ngmodule-declaration', unnest(regexp_extract_all(regexp_extract(content, 'declarations: .([^]]*)', 1), 'C[0-9]+')) FROM c
  UNION ALL SELECT h.side, h.path, 'selector', 'template-selector', unnest(list_concat([lower(regexp_extract(h.content, '<([A-Za-z0-9]+-[A-Za-z0-9]+)', 1))], regexp_extract_all(h.content, '[[]([a-z][A-Za-z0-9]*)[]]', 1))) FROM h JOIN c ON c.side = h.side AND c.path = h.path
  UNION ALL SELECT h.side, h.path, 'selector', 'template-pipe', unnest(regexp_extract_all(h.content, '[|] ([a-z0-9]+)', 1)) FROM h JOIN c ON c.side = h.side AND c.path = h.path),
e AS (SELECT DISTINCT src, dst, edge_type FROM (
  SELECT path AS src, target AS dst, 'import' AS edge_type FROM r WHERE target LIKE '%.ts'
  UNION ALL SELECT u.path, m.dst, edge_type FROM u JOIN m ON key = CASE WHEN way = 'class' THEN class_name ELSE selector END) WHERE src <> dst),
un AS (SELECT path AS src, count(*) AS n_unresolved, string_agg(target, ',') AS samples FROM r WHERE target NOT LIKE '%.ts' GROUP BY path),
n AS (SELECT coalesce(x.path, y.path) AS id, coalesce(x.kind, y.kind) AS kind, coalesce(x.class_name, y.class_name) AS class_name, coalesce(x.selector, y.selector) AS selector,
        CASE WHEN x.content IS NULL THEN 'RIGHT_ONLY' WHEN y.content IS NULL OR x.content <> y.content THEN 'RIGHT_ONLY' ELSE 'CLEAN' END AS div_type
      FROM (SELECT * FROM c WHERE side = 0) x FULL JOIN (SELECT * FROM c WHERE side = 1) y ON x.path = y.path)"""

#: lines of both sides, which have as many; none repeats within a file
SESSION_LINES = """sl AS (SELECT n.id, n.div_type, string_split(rtrim(x.content, chr(10)), chr(10)) AS xs, string_split(rtrim(y.content, chr(10)), chr(10)) AS ys FROM n
    LEFT JOIN c x ON x.path = n.id AND x.side = 0 LEFT JOIN c y ON y.path = n.id AND y.side = 1)"""

ORACLES: dict[str, str] = {
    "divergence_types": f"WITH {CLASSED} SELECT path, div_type FROM t",
    "divergence_stats": f"WITH {CLASSED} SELECT count(*) AS n_total, {TYPE_COUNTS.format(p='')}, count(*) FILTER (WHERE r IS NULL) AS n_unmatched_left, count(*) FILTER (WHERE l IS NULL) AS n_unmatched_right FROM n",
    "divergence_quick_stats": f"WITH {CLASSED} SELECT {TYPE_COUNTS.format(p='l IS NOT NULL AND r IS NOT NULL AND ')}, count(*) FILTER (WHERE r IS NULL) AS n_left_files_only, count(*) FILTER (WHERE l IS NULL) AS n_right_files_only FROM n",
    "trivial_merges": f"WITH {CLASSED} SELECT path, div_type FROM n WHERE div_type IN ('LEFT_ONLY', 'RIGHT_ONLY')",
    "conflict_files": f"WITH {CLASSED} SELECT path FROM n WHERE div_type = 'CONFLICT'",
    "line_changes": f"""{COUNTS} SELECT path, div_type, CAST(coalesce(left_add, 0) AS BIGINT) AS left_add, CAST(coalesce(left_del, 0) AS BIGINT) AS left_del, CAST(coalesce(right_add, 0) AS BIGINT) AS right_add,
        CAST(coalesce(right_del, 0) AS BIGINT) AS right_del, NOT (div_type = 'CONFLICT' AND (two_way OR region)) AS auto_mergeable FROM e""",
    "conflict_regions": f"{COUNTS} SELECT path, CAST(1 AS BIGINT) AS start_line, CAST(1 AS BIGINT) AS end_line FROM e WHERE region",
    "conflict_ranking": f"{COUNTS} SELECT path, CAST(coalesce(left_add, 0) + coalesce(right_add, 0) AS BIGINT) AS added FROM e WHERE div_type = 'CONFLICT'",
    "last_commits": "SELECT CAST(o_custkey AS VARCHAR) AS path, CAST(o_orderkey AS VARCHAR) AS hash, strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderpriority AS author FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1",
    "match_pairs": f"{MATCHED} SELECT * FROM a",
    "match_with_overrides": f"{OVERRIDDEN} SELECT * FROM a",
    "left_only_files": f"{MATCHED} SELECT left_path FROM a WHERE right_path IS NULL",
    "right_only_files": f"{MATCHED} SELECT right_path FROM a WHERE left_path IS NULL",
    "match_method_counts": f"{MATCHED} SELECT match_method, count(*) AS n FROM a WHERE left_path IS NOT NULL AND right_path IS NOT NULL GROUP BY 1",
    "match_reconciliation": f"""{MATCHED}, z AS (SELECT count(*) FILTER (WHERE left_path IS NOT NULL AND right_path IS NOT NULL) AS pairs, count(*) FILTER (WHERE right_path IS NULL) AS left_only, count(*) FILTER (WHERE left_path IS NULL) AS right_only,
        (SELECT count(*) FROM l) AS left_files, (SELECT count(*) FROM r) AS right_files FROM a) SELECT *, pairs + left_only = left_files AS left_ok, pairs + right_only = right_files AS right_ok FROM z""",
    "suspicious_matches": f"{MATCHED} SELECT * FROM a WHERE match_method <> 'path' AND left_path IS NOT NULL AND right_path IS NOT NULL AND split_part(left_path, '/', 1) <> split_part(right_path, '/', 1) AND len(string_split(left_path, '/')) > 2",
    "extension_counts": f"SELECT '.' || regexp_extract(path, '([^.]*)$', 1) AS ext, count(l) AS n_left, count(r) AS n_right FROM ({SNAP}) WHERE l IS NOT NULL OR r IS NOT NULL GROUP BY 1",
    "file_types": f"SELECT CASE WHEN path LIKE '%.component.ts' THEN 'component' WHEN path LIKE '%.service.ts' THEN 'service' WHEN path LIKE '%.scss' THEN 'util' ELSE 'unknown' END AS file_type, count(*) AS n FROM ({SNAP}) GROUP BY 1",
    "path_ordinals": f"SELECT path, row_number() OVER (ORDER BY path) - 1 AS ordinal FROM ({SNAP})",
    "parsed_classes": f"""WITH {PART} SELECT path, 'component' AS file_type, 'C' || k AS class_name, 'app-f' || k AS selector, '../' || replace(substr(p2, 6), '.ts', '') || ',@app/' || replace(substr(p3, 6), '.ts', '') || ',rxjs' AS imports,
        'C' || k5 || ',Z' AS component_providers, 'C' || k2 || ',Map<string, C' || k3 || '>' AS injections, '[Part] Load ' || k AS action_names, 'load' || k AS action_ids, 'load' || k7 || ',other,Go' AS action_refs, 'selectP' || k AS selector_names, 'selectP' || k4 AS selector_refs FROM p""",
    "services": f"WITH {PART} SELECT path, 'service' AS file_type, 'S' || k AS class_name, CASE k % 5 WHEN 0 THEN 'root' WHEN 1 THEN 'any' END AS provided_in, 'Http' AS injections FROM p",
    "template_references": f"WITH {PART} SELECT path, v.a AS ref_type, CASE WHEN v.b = 'app' THEN 'app-f' || k3 ELSE v.b END AS ref_name FROM p, (VALUES ('component', 'app'), ('directive', 'appD'), ('directive', 'ngIf'), ('pipe', 'b'), ('pipe', 'size')) AS v(a, b)",
    "page_references": r"SELECT ref_name, count(*) AS n FROM (SELECT unnest(list_distinct(list_filter(regexp_extract_all(html, '\|\s*([A-Za-z][A-Za-z0-9]*)', 1), lambda x: x NOT IN ('async', 'currency', 'date', 'decimal', 'i18nPlural', 'i18nSelect', 'json', 'keyvalue', 'lowercase', 'number', 'percent', 'slice', 'titlecase', 'uppercase')))) AS ref_name FROM pages) GROUP BY 1",
    "state_kinds": f"SELECT CASE WHEN path NOT LIKE '%.ts' THEN NULL ELSE CASE doc_id % 6 WHEN 0 THEN 'action' WHEN 1 THEN 'reducer' WHEN 2 THEN 'effect' WHEN 3 THEN 'selector' WHEN 4 THEN 'state' END END AS state_kind, count(*) AS n FROM ({SNAP}) GROUP BY 1",
    "resolved_imports": f"WITH {PART} SELECT path, CAST(0 AS BIGINT) AS position, '../' || replace(substr(p2, 6), '.ts', '') AS spec, p2 AS target FROM p UNION ALL SELECT path, 1, '@app/' || replace(substr(p3, 6), '.ts', ''), p3 FROM p UNION ALL SELECT path, 2, 'rxjs', NULL FROM p",
    "dependency_edges": f"{EDGES} SELECT * FROM e",
    "edge_type_counts": f"{EDGES} SELECT edge_type, count(*) AS n FROM e GROUP BY 1",
    "unresolved_imports": f"WITH {PART} SELECT path AS src, CAST((CASE WHEN k2 % 11 = 4 THEN 1 ELSE 0 END) + (CASE WHEN k3 % 11 = 4 THEN 1 ELSE 0 END) AS BIGINT) AS n_unresolved FROM p WHERE k % 11 <> 4 AND (k2 % 11 = 4 OR k3 % 11 = 4)",
    "unresolved_summary": f"WITH {PART} SELECT count(*) AS n_nodes, CAST(sum((CASE WHEN k2 % 11 = 4 THEN 1 ELSE 0 END) + (CASE WHEN k3 % 11 = 4 THEN 1 ELSE 0 END)) AS BIGINT) AS n_imports FROM p WHERE k % 11 <> 4 AND (k2 % 11 = 4 OR k3 % 11 = 4)",
    "node_degrees": f"WITH e AS ({CYC}), n AS ({CYC_NODES}) SELECT n.id, (SELECT count(DISTINCT dst) FROM e WHERE src = n.id) AS n_dependencies, (SELECT count(DISTINCT src) FROM e WHERE dst = n.id) AS n_dependents FROM n",
    "graph_roots": f"WITH e AS ({CYC}), n AS ({CYC_NODES}) SELECT id FROM n WHERE id NOT IN (SELECT dst FROM e)",
    "node_depths": f"""WITH RECURSIVE e AS ({CYC}), n AS ({CYC_NODES}), b(id, d) AS (SELECT id, 0 FROM n WHERE id NOT IN (SELECT dst FROM e) UNION SELECT e.dst, b.d + 1 FROM b JOIN e ON e.src = b.id WHERE b.d < 24)
        SELECT n.id, CAST(coalesce(min(d), 0) AS BIGINT) AS depth FROM n LEFT JOIN b ON b.id = n.id GROUP BY n.id""",
    "clean_subtrees": f"WITH RECURSIVE e AS ({CYC}), n AS ({CYC_NODES}), {REACH}, {CLEAN} SELECT id, id IN (SELECT id FROM c) AS is_clean_subtree FROM n",
    "clean_roots": f"{TREE_CLEAN} SELECT id FROM c WHERE id NOT IN (SELECT dst FROM e) OR id IN (SELECT dst FROM e WHERE src NOT IN (SELECT id FROM c))",
    "movable_roots": f"{TREE_CLEAN}, {MOVABLE} SELECT id FROM mv",
    "movable_tree_sizes": f"{SUBTREES} SELECT * FROM sz",
    "movable_tree_summary": f"{SUBTREES} SELECT count(*) AS n_trees, count(*) FILTER (WHERE size = 1) AS n_single, count(*) FILTER (WHERE size > 1) AS n_multi, CAST(sum(size) AS BIGINT) AS n_files FROM sz",
    "top_movable_trees": f"""{SUBTREES}, tp AS (SELECT root, size FROM sz WHERE size > 1 ORDER BY size DESC, root LIMIT 20), pl AS (SELECT tp.root, tp.size, st.id, row_number() OVER (PARTITION BY tp.root ORDER BY st.id) AS k FROM tp JOIN st ON st.root = tp.root)
        SELECT root, size, CASE WHEN size <= 5 THEN string_agg(id, ', ' ORDER BY id) ELSE string_agg(id, ', ' ORDER BY id) FILTER (WHERE k <= 3) || ' and ' || (size - 3) || ' more' END AS members FROM pl GROUP BY root, size""",
    "bottlenecks": f"""WITH RECURSIVE e AS ({TREE}), n AS ({NODES}), r(node, b) AS (SELECT id, id FROM n WHERE dirty UNION SELECT e.src, r.b FROM r JOIN e ON e.dst = r.node),
        u AS (SELECT node, min(b) AS b FROM r GROUP BY node HAVING count(*) = 1), x AS (SELECT n.id, left_add + left_del + right_add + right_del AS effort, (SELECT count(*) FROM u WHERE u.b = n.id) AS unlock_count FROM n WHERE dirty)
        SELECT id, effort, unlock_count, round(CASE WHEN effort > 0 THEN unlock_count / effort ELSE unlock_count END, 6) AS impact, CASE WHEN unlock_count > 10 THEN 'high' WHEN unlock_count > 3 THEN 'medium' ELSE 'low' END AS band FROM x""",
    "dirty_nodes": f"SELECT id, left_add + left_del + right_add + right_del AS effort FROM ({NODES}) WHERE div_type = 'CONFLICT'",
    "consolidation_priorities": f"""{TREE_CLEAN}, q AS (SELECT id, CASE WHEN div_type IN ('CLEAN', 'SAME_CHANGE') AND id IN (SELECT id FROM c) AND id IN (SELECT src FROM e) THEN 'high' WHEN div_type IN ('LEFT_ONLY', 'RIGHT_ONLY') THEN 'medium' WHEN div_type = 'CONFLICT' THEN 'low' END AS priority,
        CASE WHEN div_type = 'LEFT_ONLY' THEN 'Trivial merge: only left changed' WHEN div_type = 'RIGHT_ONLY' THEN 'Trivial merge: only right changed' WHEN div_type = 'CONFLICT' THEN 'Conflict with ' || (left_add + left_del + right_add + right_del) || ' total changed lines' ELSE 'Clean subtree root with dependencies' END AS reason FROM n)
        SELECT * FROM q WHERE priority IS NOT NULL""",
    "expanded_selection": f"WITH RECURSIVE e AS ({CYC}), n AS ({CYC_NODES}), q(id) AS (SELECT id FROM n WHERE id LIKE 'p:%9' OR id LIKE 's:%1' UNION SELECT e.dst FROM q JOIN e ON e.src = q.id) SELECT id FROM q",
    "dependency_levels": f"""WITH RECURSIVE e AS ({TREE}), n AS ({NODES}), b(id, d) AS (SELECT id, 0 FROM n UNION SELECT e.src, b.d + 1 FROM b JOIN e ON e.dst = b.id) SELECT id, CAST(max(d) AS BIGINT) AS level FROM b GROUP BY id""",
    "dependency_cycles": f"WITH RECURSIVE e AS ({CYC}), n AS ({CYC_NODES}), {REACH} SELECT a.s AS id, min(b.s) AS component FROM r a JOIN r b ON a.d = b.s AND a.s = b.d GROUP BY a.s",
    "cyclic_levels": f"""WITH RECURSIVE e AS ({CYC}), n AS ({CYC_NODES}), {REACH}, k AS (SELECT a.s AS id, min(b.s) AS component FROM r a JOIN r b ON a.d = b.s AND a.s = b.d GROUP BY a.s),
        m AS (SELECT n.id, coalesce(component, n.id) AS c FROM n LEFT JOIN k ON k.id = n.id), o AS (SELECT DISTINCT x.c AS src, y.c AS dst FROM e JOIN m x ON x.id = e.src JOIN m y ON y.id = e.dst WHERE x.c <> y.c),
        b(c, d) AS (SELECT DISTINCT c, 0 FROM m UNION SELECT o.src, b.d + 1 FROM b JOIN o ON o.dst = b.c) SELECT m.id, CAST(max(d) AS BIGINT) AS level FROM m JOIN b ON b.c = m.c GROUP BY m.id""",
    "connected_nodes": f"WITH e AS ({CYC}), n AS ({CYC_NODES}), o AS (SELECT src, dst FROM e WHERE src IN (SELECT id FROM n WHERE ok) AND dst IN (SELECT id FROM n WHERE ok)) SELECT id FROM n WHERE id IN (SELECT src FROM o UNION SELECT dst FROM o)",
    "edges_of_survivors": f"WITH e AS ({CYC}), n AS ({CYC_NODES}) SELECT src, dst FROM e WHERE src IN (SELECT id FROM n WHERE ok) AND dst IN (SELECT id FROM n WHERE ok)",
    "scan_validation": f"""WITH s AS ({SNAP}), z AS (SELECT count(*) FILTER (WHERE doc_id % 10 <> 1) AS n_found, count(*) FILTER (WHERE doc_id % 7 <> 2) AS n_parsed, count(*) FILTER (WHERE doc_id % 10 <> 1 AND doc_id % 7 = 2) AS n_missing,
        count(*) FILTER (WHERE doc_id % 10 = 1 AND doc_id % 7 <> 2) AS n_extra FROM s) SELECT *, n_found - n_parsed AS difference, round(100 * n_parsed / n_found, 1) AS coverage FROM z""",
    "missing_patterns": f"""SELECT CASE doc_id % 8 WHEN 0 THEN '*.spec.*' WHEN 1 THEN '*.test.*' WHEN 2 THEN '__tests__/*' WHEN 6 THEN '*.d.ts' ELSE CASE WHEN doc_id % 4 = 2 THEN '*.html' WHEN doc_id % 4 = 3 THEN '*.scss' WHEN doc_id % 8 = 3 THEN 'e2e/*' WHEN doc_id % 8 = 4 THEN 'test(s)/*' ELSE 'other .ts' END END AS pattern, count(*) AS n
        FROM ({SNAP}) GROUP BY 1""",
    "next_report_number": f"SELECT CAST(max(doc_id) + 1 AS BIGINT) AS next_number FROM ({SNAP}) WHERE doc_id % 3 = 0",
    "shared_violations": f"""WITH {PART} SELECT path, p2 AS import_path, 'left' AS points_to FROM p UNION ALL SELECT path, p3, 'left' FROM p
        UNION ALL SELECT path, CASE WHEN k % 2 = 0 THEN '../../right/x' ELSE '/lib/left/y' END, CASE WHEN k % 2 = 0 THEN 'right' ELSE 'left' END FROM p""",
    "report_search": f"WITH {CLASSED} SELECT path, div_type FROM n WHERE div_type IN ('CONFLICT', 'LEFT_ONLY') AND contains(lower(path), 'de/doc1')",
    "report_page": f"WITH {CLASSED} SELECT path, div_type FROM n ORDER BY path LIMIT 100 OFFSET 100",
    "report_page_count": f"WITH {CLASSED} SELECT CAST(ceil(count(*) / 100) AS BIGINT) AS n_pages FROM n",
    "plan_moves": f"""{PLAN}, lv(id, d) AS (SELECT id, 0 FROM q UNION SELECT g.src, lv.d + 1 FROM lv JOIN g ON g.dst = lv.id JOIN q ON q.id = g.src), lm AS (SELECT id, max(d) AS level FROM lv GROUP BY id)
        SELECT row_number() OVER (ORDER BY level, lm.id) - 1 AS position, lm.id AS source, target FROM lm JOIN mv ON mv.id = lm.id""",
    "plan_deletions": f"{PLAN} SELECT id AS path FROM mv",
    "plan_importers": f"{PLAN} SELECT id AS path FROM mv UNION SELECT src FROM g WHERE dst IN (SELECT id FROM mv)",
    "plan_rewrites": f"{REWRITES} SELECT * FROM w WHERE new_import <> old_import",
    "plan_barrels": f"{BARRELS} SELECT * FROM b",
    "plan_rewrite_counts": f"{REWRITES} SELECT path, count(*) AS n_imports FROM w WHERE new_import <> old_import GROUP BY path",
    "plan_totals": f"""{REWRITES}, im AS (SELECT id FROM mv UNION SELECT src FROM g WHERE dst IN (SELECT id FROM mv)),
        dr AS (SELECT DISTINCT regexp_extract(id, '^(.*)/', 1) FROM mv)
        SELECT (SELECT count(*) FROM mv) AS n_files, (SELECT count(*) FROM im) AS n_files_to_update, (SELECT count(*) FROM w WHERE new_import <> old_import) + (SELECT count(*) FROM mv) AS n_imports,
        (SELECT count(*) FROM dr) AS n_barrels, (SELECT count(*) FROM mv) AS n_deletions""",
    "rewritten_tree": f"{TREE_AFTER} SELECT coalesce(mv.target, g2.path) AS path, content FROM g2 LEFT JOIN mv ON mv.id = g2.path UNION ALL SELECT path, content FROM br",
    "patch_line_classes": f"{PATCHES}, x AS (SELECT 'hunk' AS line_class, count(*) AS n FROM y UNION ALL SELECT 'added', sum(new) + count(*) FROM y UNION ALL SELECT 'removed', sum(gone) + count(*) FROM y UNION ALL SELECT 'context', sum(kept) FROM y) SELECT line_class, CAST(n AS BIGINT) AS n FROM x WHERE n > 0",
    "shortened_patches": f"{PATCHES}, x AS (SELECT path, 3 + gone + new + kept AS t FROM y) SELECT path, CAST(least(t, 21) AS BIGINT) AS n_lines, CASE WHEN t > 20 THEN CAST(CAST(t - 20 AS BIGINT) AS VARCHAR) ELSE '' END AS n_more FROM x",
    "session_edges": f"WITH {BRANCHES} SELECT * FROM e",
    "session_divergence": f"""WITH {BRANCHES}, {SESSION_LINES} SELECT id, div_type, CAST(0 AS BIGINT) AS left_add, CAST(0 AS BIGINT) AS left_del,
        CAST(CASE WHEN xs IS NULL THEN len(ys) WHEN ys IS NULL THEN 0 ELSE len(list_filter(range(1, len(xs) + 1), lambda i: xs[i] <> ys[i])) END AS BIGINT) AS right_add,
        CAST(CASE WHEN xs IS NULL THEN 0 WHEN ys IS NULL THEN len(xs) ELSE len(list_filter(range(1, len(xs) + 1), lambda i: xs[i] <> ys[i])) END AS BIGINT) AS right_del, true AS auto_mergeable FROM sl""",
    "session_patches": f"""WITH {BRANCHES}, {SESSION_LINES}, pl AS (SELECT *, unnest(range(1, greatest(coalesce(len(xs), 0), coalesce(len(ys), 0)) + 1)) AS i FROM sl)
        SELECT id, 'right' AS side, 'removed' AS line_class, '-' || xs[i] AS line FROM pl WHERE xs IS NOT NULL AND (ys IS NULL OR xs[i] <> ys[i])
        UNION ALL SELECT id, CASE WHEN xs IS NULL THEN 'both' ELSE 'right' END, 'added', '+' || ys[i] FROM pl WHERE ys IS NOT NULL AND (xs IS NULL OR xs[i] <> ys[i])""",
    "session_unresolved": f"WITH {BRANCHES} SELECT * FROM un",
    "session_nodes": f"""WITH RECURSIVE {BRANCHES}, {REACH.replace("r(s, d)", "rr(s, d)").replace("SELECT r.s", "SELECT rr.s").replace("FROM r JOIN", "FROM rr JOIN").replace("= r.d", "= rr.d")},
        bad AS (SELECT id FROM n WHERE div_type <> 'CLEAN' OR id IN (SELECT src FROM un) OR id IN (SELECT s FROM rr WHERE s = d))
        SELECT id, CASE kind WHEN 'NgModule' THEN 'module' ELSE lower(kind) END AS file_type, class_name, selector, div_type,
        NOT (id IN (SELECT id FROM bad) OR id IN (SELECT s FROM rr JOIN bad ON rr.d = bad.id)) AS is_clean FROM n""",
}
