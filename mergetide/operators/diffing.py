"""Three-way comparison of file contents.

Contents are compared by hash; texts are only carried where lines have to be compared.  Lines are compared without
their ends, along a shortest edit script with deletions first; empty lines do not count as added or removed.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergetide.functions.text import content_hash, normalised
from mergetide.sources.shared import merged

CHANGES = "struct<left_add:int,left_del:int,right_add:int,right_del:int,regions:array<struct<start_line:int,end_line:int>>>"


def divergence_type(base: Column, left: Column, right: Column) -> Column:
    """By content hashes, null for a missing or empty file."""
    with_base = (
        F.when(left.eqNullSafe(base) & right.eqNullSafe(base), "CLEAN").when(left.eqNullSafe(right), "SAME_CHANGE")
        .when(left.eqNullSafe(base), "RIGHT_ONLY").when(right.eqNullSafe(base), "LEFT_ONLY").otherwise("CONFLICT")
    )
    without = F.when(left.eqNullSafe(right), "CLEAN").when(right.isNull(), "LEFT_ONLY").when(left.isNull(), "RIGHT_ONLY").otherwise("CONFLICT")
    return F.when(base.isNull(), without).otherwise(with_base)


def classify(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``base, left, right`` contents plus ``div_type``."""
    hashes = [content_hash(F.col(c)).alias(f"_{c}") for c in ("base", "left", "right")]
    return pairs.select("*", *hashes).withColumn("div_type", divergence_type(F.col("_base"), F.col("_left"), F.col("_right"))).drop("_base", "_left", "_right")


def base_of(explicit: Column, at_left: Column, at_right: Column) -> Column:
    """The ancestor's content: at the path given, else at the left path, else at the right one; an empty blob falls through."""
    return F.coalesce(F.nullif(explicit, F.lit("")), F.nullif(at_left, F.lit("")), F.nullif(at_right, F.lit("")))


def middle(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """A place ``(i, j)`` on a shortest edit script of two sequences that begin and end unlike, from both ends at once.

    ``front[k]`` is how far ``a`` can be read on diagonal ``k = i - j`` with so many edits, ``back[k]`` the same from the
    ends; only these two rows are kept.
    """
    n, m = len(a), len(b)
    size = n + m + 3
    front, back = np.full(size, -1), np.full(size, -1)
    front[m + 2] = back[m + 2] = 0  # diagonal k lies at k + m + 1
    turned = (a[::-1], b[::-1])
    for d in range((n + m + 1) // 2 + 1):
        k = np.arange(-d + 2 * max(0, d - m), d - 2 * max(0, d - n) + 1, 2)
        at = k + m + 1
        for x, y, row, other, odd in ((a, b, front, back, True), (*turned, back, front, False)):
            down = (k == -d) | ((k != d) & (row[at - 1] < row[at + 1]))
            i = np.where(down, row[at + 1], row[at - 1] + 1)
            i = np.minimum(i, np.minimum(n, m + k))
            live = np.flatnonzero((i < n) & (i - k < m))
            while len(live):
                live = live[x[i[live]] == y[i[live] - k[live]]]
                i[live] += 1
                live = live[(i[live] < n) & (i[live] - k[live] < m)]
            row[at] = i
            if ((n - m) % 2 == 1) == odd:
                mirror = (n - m - k) + m + 1
                met = np.flatnonzero((i >= 0) & (other[mirror] >= 0) & (i + other[mirror] >= n))
                if len(met):
                    z = int(met[0])
                    i0, j0 = int(i[z]), int(i[z] - k[z])
                    return (i0, j0) if odd else (n - i0, m - j0)
    raise AssertionError("two sequences always meet")


def edit_script(a: list[str], b: list[str]) -> list[tuple[str, int, int]]:
    """Shortest edit script from ``a`` to ``b``: (``-``, line of a, place in b) and (``+``, place in a, line of b), in order.

    Lines that the other side lacks are edits in any script, and are set aside; the rest is halved at a place that a
    shortest script passes, so that memory grows with the lines, not with their square.
    """
    number: dict[str, int] = {}
    x = np.array([number.setdefault(line, len(number)) for line in a], np.int64)
    y = np.array([number.setdefault(line, len(number)) for line in b], np.int64)
    own, other = np.flatnonzero(np.isin(x, y)), np.flatnonzero(np.isin(y, x))
    gone, new = np.ones(len(a), bool), np.ones(len(b), bool)
    x, y = x[own], y[other]
    todo = [(0, len(x), 0, len(y))]
    while todo:
        p, q, r, s = todo.pop()
        near = min(q - p, s - r)
        unlike = np.flatnonzero(x[q - near : q][::-1] != y[s - near : s][::-1])
        tail = int(unlike[0]) if len(unlike) else near
        unlike = np.flatnonzero(x[p : p + near - tail] != y[r : r + near - tail])
        head = int(unlike[0]) if len(unlike) else near - tail
        gone[own[p : p + head]] = gone[own[q - tail : q]] = False
        new[other[r : r + head]] = new[other[s - tail : s]] = False
        p, q, r, s = p + head, q - tail, r + head, s - tail
        if p < q and r < s:
            i, j = middle(x[p:q], y[r:s])
            todo += [(p, p + i, r, r + j), (p + i, q, r + j, s)]
    script, i, j = [], 0, 0
    while i < len(a) or j < len(b):  # kept lines come in pairs
        if i < len(a) and gone[i]:
            script.append(("-", i, j))
            i += 1
        elif j < len(b) and new[j]:
            script.append(("+", i, j))
            j += 1
        else:
            i, j = i + 1, j + 1
    return script


def lines_of(text: str) -> list[str]:
    return text.split("\n") if text else []


def changed(a: str, b: str) -> tuple[int, int, set[int]]:
    """Added and removed lines that are not empty, and all removed lines of ``a``."""
    x, y = lines_of(a), lines_of(b)
    script = edit_script(x, y)
    added = sum(1 for op, _, j in script if op == "+" and y[j])
    gone = [i for op, i, _ in script if op == "-"]
    return added, sum(1 for i in gone if x[i]), set(gone)


def runs_of(lines: set[int]) -> list[dict[str, int]]:
    """Maximal runs, counted from 1, both ends included."""
    out: list[dict[str, int]] = []
    for i in sorted(lines):
        if out and i == out[-1]["end_line"]:
            out[-1]["end_line"] = i + 1
        else:
            out.append({"start_line": i + 1, "end_line": i + 1})
    return out


def line_changes(t: str, b: str, x: str, y: str) -> tuple:
    """Line counts and regions of a file by its type, from its ancestor and its left and right content."""
    la = ld = ra = rd = 0
    regions: list[dict[str, int]] = []
    if t == "CONFLICT" and not b:
        la, ld, _ = changed(y, x)
        ra, rd, _ = changed(x, y)
    elif t == "CONFLICT":
        la, ld, gone = changed(b, x)
        ra, rd, also = changed(b, y)
        regions = runs_of(gone & also)
    elif t == "SAME_CHANGE":
        la, ld, _ = changed(b, x)
        ra, rd = la, ld
    elif t == "LEFT_ONLY":
        la, ld, _ = changed(b, x)
    elif t == "RIGHT_ONLY":
        ra, rd, _ = changed(b, y)
    return la, ld, ra, rd, regions


def by_hundreds(of: Callable, kind: str) -> Callable[..., Column]:
    """A function of contents, row by row: a Python worker holds a hundred rows at a time, where an Arrow batch has ten thousand."""
    return F.udf(of, kind, useArrow=False)


def measure(classified: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, div_type``, line counts, conflict regions and ``auto_mergeable``; clean files never reach Python."""
    clean = F.col("div_type") == "CLEAN"
    return unchanged(classified.where(clean), keys).unionByName(counted(classified.where(~clean), keys))


NO_CHANGES = '{"left_add":0,"left_del":0,"right_add":0,"right_del":0,"regions":[]}'


def measured_columns(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.select(*keys, "div_type", "c.left_add", "c.left_del", "c.right_add", "c.right_del", F.col("c.regions").alias("conflict_regions"), "auto_mergeable")


def unchanged(clean: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of clean files: nothing is added or removed."""
    none = F.from_json(F.lit(NO_CHANGES), CHANGES)
    return measured_columns(clean.select(*keys, "div_type", none.alias("c"), F.lit(True).alias("auto_mergeable")), keys)


def counted(dirty: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of files that are not clean, from their ``base, left, right`` contents."""
    texts = [normalised(F.col(c)).alias(c) for c in ("base", "left", "right")]
    rows = dirty.select(*keys, "div_type", *texts).withColumn("c", by_hundreds(line_changes, CHANGES)("div_type", "base", "left", "right"))
    two_way = (F.col("div_type") == "CONFLICT") & (F.col("base") == "")
    return measured_columns(rows.withColumn("auto_mergeable", F.when(F.col("div_type") == "CONFLICT", ~two_way & (F.size("c.regions") == 0)).otherwise(True)), keys)


# whole trees, by the hashes of their files


def hashed(files: DataFrame) -> DataFrame:
    """``path, hash, filled`` of ``files(path, content)``: what trees are compared by; ``filled`` is false for an empty blob."""
    return files.select("path", content_hash(F.col("content")).alias("hash"), (F.coalesce("content", F.lit("")) != "").alias("filled"))


def typed_pairs(matches: DataFrame, left: DataFrame, right: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """``id, left_path, right_path, base_path, div_type`` of ``matches(left_path, right_path)``; trees come as :func:`hashed`.

    Only paths and hashes are joined.  The ancestor is the blob at the left path, else the one at the right path; an empty
    blob falls through.
    """
    at = lambda side, column, name: merged(side.select(F.col("path").alias(column), F.col("hash").alias(f"_{name}"), F.col("filled").alias(f"_{name}_filled")))
    pairs = matches.select("left_path", "right_path").join(at(left, "left_path", "left"), "left_path", "left").join(at(right, "right_path", "right"), "right_path", "left")
    none = F.lit(None).cast("string")
    if base is None:
        pairs = pairs.withColumns({"base_path": none, "_base": none})
    else:
        pairs = pairs.join(at(base, "left_path", "b1"), "left_path", "left").join(at(base, "right_path", "b2"), "right_path", "left")
        chosen = lambda one, two: F.when(F.col("_b1_filled"), F.col(one)).when(F.col("_b2_filled"), F.col(two))
        pairs = pairs.withColumns({"base_path": chosen("left_path", "right_path"), "_base": chosen("_b1", "_b2")})
    return pairs.select(F.coalesce("left_path", "right_path").alias("id"), "left_path", "right_path", "base_path", divergence_type(F.col("_base"), F.col("_left"), F.col("_right")).alias("div_type"))


def changed_contents(typed: DataFrame, left: DataFrame, right: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """``id, left_path, right_path, div_type, base, left, right``: the contents of the typed pairs that are not clean.

    ``left``, ``right`` and ``base`` are trees ``path, content``.  They are cut down to the files that changed pairs name before
    anything is put together by id, so that a content moves once, and only where it is read.
    """
    dirty = typed.where("div_type <> 'CLEAN'")
    trees = {"left": left, "right": right} | ({} if base is None else {"base": base})
    rows = None
    for side, files in trees.items():
        wanted = dirty.where(F.col(f"{side}_path").isNotNull()).select("id", F.col(f"{side}_path").alias("path"))
        own = files.select("path", "content").join(merged(wanted), "path").select("id", F.lit(side).alias("side"), "content")
        rows = own if rows is None else rows.unionByName(own)
    of = lambda side: F.any_value(F.when(F.col("side") == side, F.col("content")), F.lit(True)).alias(side)
    texts = rows.groupBy("id").agg(of("base"), of("left"), of("right"))
    return dirty.select("id", "left_path", "right_path", "div_type").join(merged(texts), "id", "left")


def patches(changed: DataFrame, most: int = 200) -> DataFrame:
    """``id, side, path, patch``: from the ancestor to each side that differs from it, or from left to right where there is none;
    patches of more than ``most`` lines are shortened."""
    texts = changed.select("id", "left_path", "right_path", *[F.coalesce(c, F.lit("")).alias(c) for c in ("base", "left", "right")])
    based, alone = texts.where("base <> ''"), texts.where("base = ''")
    of = lambda side: based.select("id", F.lit(side).alias("side"), F.coalesce(f"{side}_path", "id").alias("path"), F.col("base").alias("before"), F.col(side).alias("after"))
    both = alone.select("id", F.lit("both").alias("side"), F.col("id").alias("path"), F.col("left").alias("before"), F.col("right").alias("after"))
    rows = of("left").unionByName(of("right")).unionByName(both).where("before <> after")
    return rows.select("id", "side", "path", shortened(unified_patch("path", "before", "after"), most).alias("patch")).where("patch <> ''")


def patch_text(path: str, before: str, after: str, context: int = 3) -> str:
    """Unified patch along a shortest edit script; empty where nothing changed."""
    a, b = lines_of(before), lines_of(after)
    hunks: list[list[tuple[str, int, int]]] = []
    for edit in edit_script(a, b):  # edits with at most 2 * context kept lines between them share a hunk
        if hunks and edit[1] - hunks[-1][-1][1] - (hunks[-1][-1][0] == "-") <= 2 * context:
            hunks[-1].append(edit)
        else:
            hunks.append([edit])
    out = [f"--- {path}", f"+++ {path}"] if hunks else []
    span = lambda first, n: f"{first + (n > 0)}" + (f",{n}" if n != 1 else "")
    for edits in hunks:
        low = max(0, edits[0][1] - context)
        high = min(len(a), edits[-1][1] + (edits[-1][0] == "-") + context)
        lines, at = [], low
        for sign, i, j in edits:
            lines += [f" {x}" for x in a[at:i]]
            lines.append(f"-{a[i]}" if sign == "-" else f"+{b[j]}")
            at = i + (sign == "-")
        lines += [f" {x}" for x in a[at:high]]
        grown = sum(1 if sign == "+" else -1 for sign, _, _ in edits)
        out += [f"@@ -{span(low, high - low)} +{span(edits[0][2] - (edits[0][1] - low), high - low + grown)} @@", *lines]
    return "\n".join(out)


def unified_patch(path: str, before: str, after: str) -> Column:
    """Unified patch between two columns, with three lines of context; contents as they are, null as empty."""

    patch = by_hundreds(lambda p, a, b: patch_text(p, a or "", b or ""), "string")
    return patch(path, before, after)


def shortened(patch: Column, most: int = 200) -> Column:
    lines = F.split(patch, "\n")
    more = F.concat(F.lit("\n... truncated ("), (F.size(lines) - most).cast("string"), F.lit(" more lines)"))
    return F.when(F.size(lines) > most, F.concat(F.array_join(F.slice(lines, 1, most), "\n"), more)).otherwise(patch)


def patch_lines(patches: DataFrame, keys: list[str], patch: str = "patch") -> DataFrame:
    """One row per line of a patch with its class."""
    lines = patches.select(*keys, F.posexplode(F.split(patch, "\n")).alias("line_no", "line"))
    kind = F.when(F.col("line").startswith("@@"), "hunk").when(F.col("line").startswith("+"), "added").when(F.col("line").startswith("-"), "removed").otherwise("context")
    return lines.withColumn("line_class", kind)


def last_commits(commits: DataFrame) -> DataFrame:
    """``commits(path, seq, hash, date, author)``: the latest of each path."""
    return commits.groupBy("path").agg(F.max_by(F.struct("hash", "date", "author"), "seq").alias("c")).select("path", "c.hash", "c.date", "c.author")


def with_commits(divergence: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """``divergence`` with the latest commit of each side, ``last_left`` and ``last_right`` structs; null where there is none."""
    for side, commits in (("left", left), ("right", right)):
        last = last_commits(commits).select(F.col("path").alias(f"{side}_path"), F.struct("hash", "date", "author").alias(f"last_{side}"))
        divergence = divergence.join(merged(last), f"{side}_path", "left")
    return divergence
