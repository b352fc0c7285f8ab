"""The engine's inputs derived from the given tables; the SQL reads alike in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mergetide.sources.tables import table

ENDS = "CASE doc_id % 4 WHEN 0 THEN '.component.ts' WHEN 1 THEN '.service.ts' WHEN 2 THEN '.html' ELSE '.scss' END"
REST = "CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10))) ELSE '' END"

#: Two edited copies of each document and their ancestor, some missing, blank, or with other line ends.
SNAP = f"""
SELECT doc_id, source || '/' || lang || '/doc' || CAST(doc_id AS STRING) || {ENDS} AS path,
  CASE WHEN doc_id % 11 = 3 THEN NULL WHEN doc_id % 29 = 0 THEN '  ' WHEN doc_id % 31 = 0 THEN replace(text, chr(10), chr(13) || chr(10)) || '  '
       WHEN doc_id % 5 = 1 THEN text || chr(10) || 'left edit' WHEN doc_id % 5 = 3 THEN 'left head' || {REST} WHEN doc_id % 5 = 4 THEN text || chr(10) || 'both edit' ELSE text END AS l,
  CASE WHEN doc_id % 13 = 5 THEN NULL WHEN doc_id % 5 = 2 THEN text || chr(10) || 'right edit' WHEN doc_id % 5 = 3 THEN 'right head' || {REST}
       WHEN doc_id % 5 = 4 THEN text || chr(10) || 'both edit' ELSE text END AS r,
  CASE WHEN doc_id % 17 = 7 THEN NULL ELSE text END AS b
FROM {{documents}}"""

MOVED = """
SELECT doc_id AS ordinal, doc_id % 11 <> 3 AS in_left, doc_id % 13 <> 5 AS in_right,
  source || '/' || lang || '/doc' || CAST(doc_id AS STRING) AS left_path,
  CASE WHEN doc_id % 7 = 0 THEN 'moved/' ELSE '' END || source || '/' || lang || '/doc' || CAST(doc_id AS STRING) AS right_path,
  CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'C' || CAST(CAST(floor(doc_id / 2) AS BIGINT) AS STRING) END AS class_name,
  'app-' || CAST(CAST(floor(doc_id / 3) AS BIGINT) AS STRING) AS selector
FROM {documents}"""

def half(n: int, key: str = "p_partkey") -> str:
    return f"CAST(floor({key} / {n}) AS BIGINT)"


TREE_EDGES = f"""
SELECT DISTINCT 'p:' || CAST({half(2)} AS STRING) AS src, 'p:' || CAST(p_partkey AS STRING) AS dst FROM {{part}} WHERE p_partkey > 0
UNION SELECT DISTINCT 'p:' || CAST({half(3)} AS STRING), 'p:' || CAST(p_partkey AS STRING) FROM {{part}} WHERE p_partkey > 0"""

CYCLE_EDGES = TREE_EDGES + f"""
UNION SELECT 'p:' || CAST({half(10)} * 10 + (7 * p_partkey + 3) % 10 AS STRING), 'p:' || CAST(p_partkey AS STRING) FROM {{part}} WHERE p_size % 4 = 0 AND p_partkey >= 10 AND {half(10)} * 10 + (7 * p_partkey + 3) % 10 <> p_partkey
UNION SELECT 's:' || CAST(s_suppkey AS STRING), 's:' || CAST({half(10, "s_suppkey")} * 10 + (7 * s_suppkey + 3) % 10 AS STRING) FROM {{supplier}} WHERE {half(10, "s_suppkey")} * 10 + (7 * s_suppkey + 3) % 10 <> s_suppkey"""

NODES = """
SELECT 'p:' || CAST(p_partkey AS STRING) AS id, p_name AS path,
  CASE WHEN p_size % 7 = 0 THEN CASE p_partkey % 3 WHEN 0 THEN 'LEFT_ONLY' WHEN 1 THEN 'RIGHT_ONLY' ELSE 'CONFLICT' END WHEN p_partkey % 5 = 0 THEN 'SAME_CHANGE' ELSE 'CLEAN' END AS div_type,
  p_size % 7 = 0 AS dirty, NOT (p_size % 7 = 0 OR p_partkey % 37 = 0) AS ok,
  CAST(CASE WHEN p_size % 7 = 0 THEN p_partkey % 6 ELSE 0 END AS BIGINT) AS left_add, CAST(CASE WHEN p_size % 7 = 0 THEN p_partkey % 4 ELSE 0 END AS BIGINT) AS left_del,
  CAST(CASE WHEN p_size % 7 = 0 THEN p_size % 5 ELSE 0 END AS BIGINT) AS right_add, CAST(0 AS BIGINT) AS right_del
FROM {part}"""

CYCLE_NODES = NODES + """
UNION ALL SELECT 's:' || CAST(s_suppkey AS STRING), s_name, 'CLEAN', false, true, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM {supplier}"""


def module(n: int) -> str:
    """``m<k / 100>/f<k>`` for k the part's number over n."""
    return f"'m' || CAST({half(100 * n)} AS STRING) || '/f' || CAST({half(n)} AS STRING)"


#: A source tree: every part is a file whose class uses those of lower parts.
SOURCES = f"""
SELECT p_partkey AS ordinal, 'left/' || {module(1)} || '.ts' AS path,
  'import {{{{ A }}}} from ''../' || {module(2)} || ''';' || chr(10) ||
  'import {{{{ B }}}} from ''@app/' || {module(3)} || ''';' || chr(10) || 'export * from ''rxjs'';' || chr(10) ||
  '// class Old {{{{ constructor(x: Y) {{{{}}}} }}}}' || chr(10) || '@Component({{{{ selector: ''app-f' || CAST(p_partkey AS STRING) || ''', providers: [C' || CAST({half(5)} AS STRING) || ', Z.forRoot(env(a, [1]), b), provideW(2), ...more], template: `:) <app-f' ||
  CAST({half(3)} AS STRING) || ' [appD]="v | async" [hidden]="a || b" *ngIf="v | size" (click)="go(f())"></app-f' || CAST({half(3)} AS STRING) || '>` }}}})' || chr(10) || '@UntilDestroy()' || chr(10) ||
  'export class C' || CAST(p_partkey AS STRING) || ' {{{{ constructor(@Inject(tok(f(1))) private s: C' || CAST({half(2)} AS STRING) ||
  ', n: number, m = make(1, 2), private t: Map<string, C' || CAST({half(3)} AS STRING) || '> = new Map()) {{{{}}}} }}}}' || chr(10) ||
  'export const load' || CAST(p_partkey AS STRING) || ' = createAction(''[Part] Load ' || CAST(p_partkey AS STRING) || ''');' || chr(10) ||
  'export const selectP' || CAST(p_partkey AS STRING) || ' = createSelector(x);' || chr(10) ||
  'ofType(load' || CAST({half(7)} AS STRING) || ', other); store.dispatch(new Go()); store.select(selectP' || CAST({half(4)} AS STRING) || ');' || chr(10) AS content
FROM {{part}}"""


#: Two branches of a tree of components with templates beside them, directives, pipes and modules; some files are missing on a
#: side, some import another file on each side, some a file that is no node; decorators, arguments and defaults nest, and
#: comments hold what looks like code.  Sides: 0 left, 1 right.
BRANCHES = f"""
SELECT side, p_partkey * 2 AS ordinal, 'm' || CAST({half(100)} AS STRING) || '/f' || CAST(p_partkey AS STRING) || '.ts' AS path,
  'import {{{{ A }}}} from ''../' || CASE WHEN side = 1 AND p_size % 3 = 0 THEN {module(3)} ELSE {module(2)} END || ''';' || chr(10) ||
  CASE WHEN p_partkey % 7 = 2 THEN 'import x from ''../lib/old.js'';' || chr(10) ELSE '' END ||
  '/* class C0 */ // @Pipe({{{{ name: ''none'' }}}})' || chr(10) || CASE p_partkey % 4
    WHEN 0 THEN '@Component({{{{ selector: ''app-f' || CAST(p_partkey AS STRING) || ''', templateUrl: ''./f' || CAST(p_partkey AS STRING) || '.html'' }}}})'
    WHEN 1 THEN '@Directive({{{{ selector: ''dir' || CAST(p_partkey AS STRING) || ''' }}}})'
    WHEN 2 THEN '@Pipe({{{{ name: ''pipe' || CAST(p_partkey AS STRING) || ''' }}}})'
    ELSE '@NgModule({{{{ imports: [C' || CAST({half(3)} AS STRING) || '.forChild([r(1), s({{{{ a: f(g(2)) }}}})]), provideX(), ...rest], declarations: [C' || CAST({half(2)} AS STRING) || ', C' || CAST({half(5)} AS STRING) || '] }}}})' END || chr(10) || CASE WHEN p_partkey % 3 = 0 THEN '@UntilDestroy()' || chr(10) ELSE '' END ||
  'export class C' || CAST(p_partkey AS STRING) || ' {{{{ n = ' || CASE WHEN side = 1 AND p_size % 5 = 0 THEN '2' ELSE '1' END || '; constructor(@Inject(T(f(1))) private a: C' ||
  CAST({half(2)} AS STRING) || ', b = make([1, 2]), private readonly c: C' || CAST({half(7)} AS STRING) || ') {{{{}}}} }}}}' || chr(10) AS content
FROM {{part}} CROSS JOIN (SELECT 0 AS side UNION ALL SELECT 1) AS s
WHERE NOT (side = 0 AND p_partkey % 17 = 3) AND NOT (side = 1 AND p_partkey % 13 = 5)
UNION ALL
SELECT side, p_partkey * 2 + 1, 'm' || CAST({half(100)} AS STRING) || '/f' || CAST(p_partkey AS STRING) || '.html',
  '<App-f' || CAST(4 * {half(8)} AS STRING) || ' [dir' || CAST(4 * {half(12)} + 1 AS STRING) || ']="v | pipe' || CAST(4 * {half(16)} + 2 AS STRING) || ' | async" [Hidden]="1" *ngIf="x">'
FROM {{part}} CROSS JOIN (SELECT 0 AS side UNION ALL SELECT 1) AS s
WHERE p_partkey % 4 = 0
UNION ALL SELECT side, CAST(-1 AS BIGINT), 'lib/old.js', 'x' FROM (SELECT 0 AS side UNION ALL SELECT 1) AS s"""


def sql_for_spark(spark: SparkSession, sf_dir: str, sql: str, *names: str, dealt: int | None = None) -> DataFrame:
    """An adapter over the given tables; dealt: over how many parts their rows are spread before the adapter makes anything of them."""
    given = {n: table(spark, sf_dir, n) for n in names}
    return spark.sql(sql, **{n: t if dealt is None else t.repartition(dealt) for n, t in given.items()})


def sql_for_duckdb(sql: str) -> str:
    """The same adapter over the views of these names."""
    return sql.format(documents="documents", part="part", supplier="supplier", moved=MOVED.format(documents="documents"))
